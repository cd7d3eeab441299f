"""All registered queries; importing a plan module registers its queries."""

from loomspan.plans import cleaning_plans, evaluation_plans, feature_plans, news_plans, stream_plans  # noqa: F401
from loomspan.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
