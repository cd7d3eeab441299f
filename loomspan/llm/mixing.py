"""Mixing sources to target weights: repetition rates from token totals, then whole copies plus one drawn copy.

Every document of a source is emitted floor(rate) times, and once more with probability rate - floor(rate). The draws
are seeded by hashes of ids, so reruns agree. They are systematic: documents of a source and a size class are put
in hash order and every 1/p-th one, from a hashed start, gets its extra copy. Each single draw is a Bernoulli draw with
the wanted probability, but draws of like-sized documents balance, so a source's total stays nearer to its target.

Only (source, totals) and (source, size class, count) are aggregated, with a map-side part. A class of any size is cut
into lots of about LOT rows by hash, so no window holds an unbounded group, however hot a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import WORD, read
from loomspan.llm.registry import query

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
LOT = 2_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words between ASCII blanks; 0 for null."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(plain, " "), "")), F.lit(0)).cast("long")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of sources (source, _total): share of all words by weight, none above cap times its total.

    Weights repeat along the sources in code point order, null last. The excess of capped sources is shared again by
    weight until none is above: a source is capped when its cap per weight is at most what the rest per weight gives.
    The windows run over one row per source.
    """
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    rising = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = totals.select("source", "_total", w.alias("_w"))
    t = t.withColumns({"_cap": F.col("_total") * F.lit(float(cap)), "_all": F.sum("_total").over(everything) * F.lit(float(share))})
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rest = F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_level", rest / left)
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(everything)
    return t.withColumn("_target", F.coalesce(F.least("_cap", F.col("_w") * level), F.col("_cap"))).select("source", "_total", "_target")


def with_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, size: str | None = None) -> DataFrame:
    """One row per document: _row (all its columns), _size, _total and _target of its source, _copies.

    size names a column with the word counts, if they were taken before; text is then not needed.
    A null or empty text has size 0 and its copies do not matter to the totals. Repeated rows are separate documents.
    A null source is a source of its own, last in order. An empty table gives an empty result.
    """
    count = word_count(F.col("text")) if size is None else F.col(size)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").alias("_source"),
                       count.alias("_size"), F.coalesce(F.col("doc_id").cast("string"), F.lit("n")).alias("_id"))
    digits = F.col("_size").cast("string")
    rows = rows.withColumn("_class", F.concat(F.length(digits).cast("string"), F.lit("."), F.substring(digits, 1, 1)))
    classes = docs.select(F.col("source").alias("source"), count.alias("_size"))
    digits = F.col("_size").cast("string")
    classes = (classes.withColumn("_class", F.concat(F.length(digits).cast("string"), F.lit("."), F.substring(digits, 1, 1)))
               .groupBy("source", "_class").agg(F.sum("_size").alias("_words"), F.count("*").alias("_n")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("_words").alias("_total")), weights, share, cap)
    targets = targets.withColumnRenamed("source", "_s")
    plan = classes.join(targets, F.col("source").eqNullSafe(F.col("_s"))).select(
        "_s", F.col("_class").alias("_c"), "_total", "_target", F.ceil(F.col("_n") / F.lit(float(LOT))).alias("_lots"))
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
    name = F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))
    rows = rows.withColumn("_h", F.md5(F.concat(F.lit(seed + ":"), F.col("_id"))))
    rows = rows.withColumn("_lot", F.conv(F.substring("_h", 9, 8), 16, 10).cast("long") % F.col("_lots"))
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_rate": rate, "_start": _unit(F.concat(F.lit(seed + ":"), name, F.lit(":"), F.col("_class"), F.lit(":"), F.col("_lot").cast("string")))})
    spot = F.row_number().over(Window.partitionBy("_source", "_class", "_lot").orderBy("_h", "_size"))
    part = F.col("_rate") - F.floor("_rate")
    drawn = F.floor(spot * part + F.col("_start")) - F.floor((spot - 1) * part + F.col("_start"))
    return rows.select("_row", "_size", "_total", "_target", (F.floor("_rate") + drawn).cast("int").alias("_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as its source's rate says, with the columns of docs."""
    counted = with_copies(docs, **options).where("_copies > 0")
    return counted.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


SQL = f"""WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'n')) AS h FROM documents),
 k AS (SELECT *, CAST(length(CAST(size AS VARCHAR)) AS VARCHAR) || '.' || substr(CAST(size AS VARCHAR), 1, 1) AS class FROM d),
 c AS (SELECT source, class, CAST(ceil(count(*) / {LOT}e0) AS BIGINT) AS lots FROM k GROUP BY ALL),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS r FROM d GROUP BY source),
 w AS (SELECT source, total, CASE (r - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w, r,
         total * 2e0 AS cap, CAST(sum(total) OVER () AS DOUBLE) * 15e-1 AS want FROM s),
 o AS (SELECT *, want - coalesce(sum(cap) OVER p, 0e0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER p, 0e0) AS lft
       FROM w WINDOW p AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT max(CASE WHEN cap / w > rest / lft THEN rest / lft END) AS level FROM o),
 t AS (SELECT source, total, coalesce(least(cap, w * level), cap) AS target FROM w, l),
 a AS (SELECT k.doc_id, k.source, k.size, k.h, k.class, t.total, t.target, CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0e0 END AS rate,
         CAST('0x' || substr(k.h, 9, 8) AS BIGINT) % c.lots AS lot
       FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.class = c.class
       JOIN t ON k.source IS NOT DISTINCT FROM t.source),
 b AS (SELECT *, CAST('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'n') || ':' || class || ':' || CAST(lot AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 AS u,
         row_number() OVER (PARTITION BY source, class, lot ORDER BY h, size) AS n, rate - floor(rate) AS part FROM a)
SELECT doc_id, size, total AS source_size, target,
 CAST(size * (floor(rate) + floor(n * part + u) - floor((n - 1) * part + u)) AS BIGINT) AS taken FROM b"""


@query("op3_mix_sources", SQL)
def op3_mix_sources(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return with_copies(sized, size="words").select(
        "_row.doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))
