"""loomspan: panel analytics (many keyed daily series on one calendar) as Spark DataFrame operators."""

from loomspan.config import EngineConfig

__all__ = ["EngineConfig"]
