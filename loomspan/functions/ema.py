"""Exponential moving averages as window expressions.

The recursion e[t] = a*x[t] + (1-a)*e[t-1], e[0] = x[0], has the closed form
e[t] = sum_k w[k]*x[k]*(1-a)^(t-k). Inside a block of rows this is a running sum scaled by
(1-a)^-k; the block length is chosen so that (1-a)^block < 1e-18, so beyond the previous block
nothing is left at double precision and one carried value per block is enough. It stays inside the JVM,
needs O(1) work per row and reuses the per-series exchange of the other windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.expr import by_series


def block_length(span: int) -> int:
    return math.ceil(18 * math.log(10) / -math.log(1.0 - 2.0 / (span + 1.0)))


def with_ema(df: DataFrame, columns: dict[str, tuple[Column, int]], between: dict[str, Column] | None = None,
             second: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """Add one EMA per entry {output: (input, span)}; inputs must be non-null.

    `between` are row expressions over the first EMAs and `second` are EMAs over those. All windows after the
    row number share the order (Ticker, block, Date), so they cost one sort.
    """
    spans = [s for _, s in columns.values()] + [s for _, s in (second or {}).values()]
    block = max(block_length(s) for s in spans)
    out = df.withColumn("_pos", F.row_number().over(by_series()) - 1).withColumns(
        {"_block": F.floor(F.col("_pos") / block), "_j": (F.col("_pos") % block).cast("double")}
    )
    out = _averages(out, columns)
    if second:
        out = _averages(out.withColumns(between or {}), second)
    return out.drop("_pos", "_block", "_j")


def _averages(df: DataFrame, columns: dict[str, tuple[Column, int]]) -> DataFrame:
    inside = Window.partitionBy("Ticker", "_block").orderBy("Date")
    through = Window.partitionBy("Ticker").orderBy("_block", "Date")
    local, carry, final = {}, {}, {}
    for name, (x, span) in columns.items():
        alpha = 2.0 / (span + 1.0)
        decay = F.lit(1.0 - alpha)
        weight = F.when(F.col("_pos") == 0, 1.0).otherwise(alpha)
        local[f"_l_{name}"] = F.sum(x * weight * F.pow(decay, -F.col("_j"))).over(inside) * F.pow(decay, F.col("_j"))
        carry[f"_c_{name}"] = F.lag(f"_l_{name}").over(through)
        seen = F.first(f"_c_{name}").over(inside)
        final[name] = F.col(f"_l_{name}") + F.pow(decay, F.col("_j") + 1.0) * F.coalesce(seen, F.lit(0.0))
    return df.withColumns(local).withColumns(carry).withColumns(final).drop(*local, *carry)
