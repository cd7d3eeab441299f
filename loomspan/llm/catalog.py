"""All queries of this subpackage; importing a module registers its query."""

from loomspan.llm import alignment, byte_repeats, language, metric_join, mixing, multi_index, odd_sketch, packing, pieces, pii, toxicity, whitening, word_repeats  # noqa: F401
from loomspan.llm.registry import REGISTRY

__all__ = ["REGISTRY"]
