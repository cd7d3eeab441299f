"""MinHash near-dedup with odd sketches.

A document's set is its distinct 5-word shingles. Documents with equal sets are one class, so any number of copies is one node
with a count. A class has SAMPLES MinHash samples; bands of ROWS samples name its buckets, and classes that share a bucket are
candidates. Candidates are compared by odd sketches: the samples folded into a bitmap of parities, so that the population count
of the XOR of two bitmaps estimates the similarity, precisely so when it is high. A second bitmap, folded from the whole set,
settles most of the rest. What both leave possible is confirmed on the full sets.

No bucket emits all its pairs. First every class is compared with its LEADERS most frequent bucket leaders, and confirmed links
give components. Then only pairs of different components in a bucket are left to compare, since a pair within a component can not
change the result: a bucket of any size is cut into blocks, and two blocks at a time are compared by their bitmaps as arrays in
a task. A first pass over some bands gives each class's most similar partner alone, which joins most components that belong together; a second
one gives all pairs that could still link, once each, in their first common bucket.

With 40 bands of 4 a pair at the bound is in no common bucket with a probability of 3e-7, and the filters leave five standard errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import WORD, binary_rows, keyed, map_batches, read
from loomspan.llm.components import components
from loomspan.llm.registry import query
from loomspan.llm.repeats import packed, unpacked
from loomspan.llm.windows import WordSymbols, names
from loomspan.llm.work import Work

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100  # least similarity
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
PARITY_BITS = 2048
LEADERS = 2
NEAREST_BANDS = 10  # bands whose buckets the pass for best partners looks at; the pass after it looks at all
BLOCK = 800
ERRORS = 5.0  # standard errors that an estimate may fall short of the bound

_rng = np.random.default_rng(20240917)
_XOR = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_TIMES = (_rng.integers(1, 1 << 31, SAMPLES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_SALT = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_WORDS = WordSymbols()
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct names of the 5-word shingles of a text with A-Z made small; of all its words if they are fewer."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(names(np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found)), min(SHINGLE, len(found))))


def samples(elements: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a set."""
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    folded = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    for begin in range(0, len(folded), 4096):
        h = folded[None, begin:begin + 4096] ^ _XOR[:, None]
        h *= _TIMES[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        least = np.minimum(least, h.min(axis=1))
    return least


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def odd_sketch(values: np.ndarray, bits: int) -> bytes:
    """Bitmap of the parities of how many values fall on each bit."""
    return np.packbits((np.bincount((mixed(values) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def describe(elements: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Class number of a set, its band names, the odd sketch of its samples and the parity bitmap of the whole set."""
    least = samples(elements).astype(np.uint64)
    bands = np.full(BANDS, 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        bands = mixed(bands ^ least[r::ROWS][:BANDS])
    number = np.int64(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())))
    return int(number), bands.tobytes(), odd_sketch(least ^ _SALT, SKETCH_BITS), odd_sketch(elements, PARITY_BITS)


def differences(xor_count: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated number of elements that two sets do not share, and its standard error; infinite where the bitmap is full."""
    share = 1.0 - 2.0 * xor_count / bits
    usable = share > 0.05
    safe = np.where(usable, share, 1.0)
    d = -bits / 2.0 * np.log(safe)
    # the count's variance when d balls fall on so many bits: that of independent bits, less what a fixed d takes away
    error = np.sqrt(np.maximum(1.0, bits / 4.0 * (1.0 - safe ** 2) - d * safe ** 2)) / safe
    return np.where(usable, d, 0.0), np.where(usable, error, np.inf)


def may_link(sketch_xor, parity_xor, n_a, n_b) -> np.ndarray:
    """Whether pairs may reach the bound, judged by the counts of the two XORs and the sizes of the sets."""
    bound = NUMERATOR / DENOMINATOR
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    possible = small * DENOMINATOR >= large * NUMERATOR
    d, error = differences(sketch_xor, SKETCH_BITS)  # 2 SAMPLES (1 - J) differing samples are expected
    spread = np.sqrt(bound * (1 - bound) / SAMPLES)
    possible &= 1.0 - (d - ERRORS * error) / (2.0 * SAMPLES) >= bound - ERRORS * spread
    d, error = differences(parity_xor, PARITY_BITS)  # (|A| + |B|) (1 - J) / (1 + J) differing elements
    return possible & (d - ERRORS * error <= (n_a + n_b) * (1.0 - bound) / (1.0 + bound))


def similarity(sketch_xor, parity_xor, n_a, n_b) -> np.ndarray:
    """Estimated similarity, from the whole sets' bitmaps or, where those are full, from the samples'."""
    d, error = differences(parity_xor, PARITY_BITS)
    rough, _ = differences(sketch_xor, SKETCH_BITS)
    return np.where(np.isfinite(error), (n_a + n_b - d) / (n_a + n_b + d), 1.0 - rough / (2.0 * SAMPLES))


def popcount(bitmaps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmaps).sum(axis=-1, dtype=np.int64)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets reach the bound."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and DENOMINATOR * shared >= NUMERATOR * (len(a) + len(b) - shared)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, _key, n and, unless the set is empty, class, bands, sketch and parity."""
    def step(batch):
        out = [[] for _ in range(5)]
        for raw in binary_rows(batch, "text"):
            elements = shingles(raw)
            values = (len(elements), *(describe(elements) if len(elements) else (None,) * 4))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        number = pa.array([None if x is None else x - (1 << 64) if x >= 1 << 63 else x for x in out[1]], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out[0], pa.int64()), number, *[pa.array(c, pa.binary()) for c in out[2:]]],
                                          names=["doc_id", "_key", "n", "class", "bands", "sketch", "parity"])
    return map_batches(keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), step, "doc_id long, _key long, n long, class long, bands binary, sketch binary, parity binary")


def _buckets(classes: DataFrame, *keep: str) -> DataFrame:
    """A row (bucket, band, keep) for each band of each class."""
    def step(batch):
        count = batch.num_rows
        bands = np.frombuffer(b"".join(binary_rows(batch, "bands")), np.int64)
        rows = pa.array(np.repeat(np.arange(count), BANDS))
        return pa.RecordBatch.from_arrays([pa.array(bands), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), count)), *[batch.column(i).take(rows) for i in range(1, batch.num_columns)]],
                                          names=["bucket", "band", *keep])
    kinds = "".join(f", {c} {classes.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(classes.select("bands", *keep), step, f"bucket long, band int{kinds}")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the bound."""
    left = texts.select(F.col("class").alias("a"), F.col("packed").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("packed").alias("text_b"))

    def step(batch):
        known, keep = (None, None), []
        for blob_a, blob_b in zip(binary_rows(batch, "text_a"), binary_rows(batch, "text_b"), strict=True):
            if known[0] != blob_a:
                known = (blob_a, shingles(unpacked(blob_a)))
            keep.append(links(known[1], shingles(unpacked(blob_b))))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b"), step, "a long, b long")


def _cross_pairs(classes: DataFrame, roots: DataFrame, members: DataFrame, work: Work, label: str, best_only: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may link, each once; members are the rows of shared buckets.

    best_only: of these, only the most similar partner of each class in the first NEAREST_BANDS bands.
    """
    members = members.where(F.col("band") < NEAREST_BANDS) if best_only else members
    placed = work.keep(members.join(roots.withColumnRenamed("node", "class"), "class", "left").select("bucket", "band", "class", F.coalesce("root", "class").alias("root")), f"{label}-placed")
    mixed_buckets = work.keep(placed.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_size"))
                              .where("_low < _high").select("bucket", F.ceil(F.col("_size") / float(BLOCK)).cast("int").alias("_blocks")), f"{label}-mixed")
    rows = placed.join(mixed_buckets, "bucket").join(classes.select("class", "n", "sketch", "parity", "bands"), "class")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class", F.lit("block")), F.col("_blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = (rows.withColumn("_p", F.explode(pairs)).select("bucket", "_p.i", "_p.j", "block", "band", "class", "root", "n", "sketch", "parity", "bands")
             .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))

    def run(batches):
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            ends = _group_ends(rows)
            rest = rows.slice(ends[-1])  # the last pair of blocks may go on in the next batch
            yield _compared(rows, ends, best_only)
        if rest is not None:
            yield _compared(rest, [*_group_ends(rest), rest.num_rows], best_only)

    found = dealt.mapInArrow(run, "a long, b long, likeness double")
    if not best_only:
        return found.select("a", "b")
    one_each = found.groupBy("a").agg(F.max_by("b", F.struct("likeness", "b")).alias("b"))
    return one_each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _group_ends(rows: pa.RecordBatch) -> list[int]:
    """Starts of the groups of equal (bucket, i, j)."""
    new = np.ones(rows.num_rows, bool)
    keys = [rows.column(c).to_numpy() for c in range(3)]
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new).tolist()


def _compared(rows: pa.RecordBatch, ends: list[int], best_only: bool) -> pa.RecordBatch:
    """Pairs that may link from the groups between ends; a group holds one or two blocks of a bucket.

    best_only: for each class of a group (as a) its most similar partner (as b), whatever bucket they share first.
    """
    first = rows.column(1).to_numpy() == rows.column(3).to_numpy()
    one_block = rows.column(1).to_numpy() == rows.column(2).to_numpy()
    band, ids, root, n = (rows.column(c).to_numpy() for c in range(4, 8))
    sketch, parity, bands = (np.frombuffer(b"".join(binary_rows(rows, c)), np.uint64).reshape(rows.num_rows, -1) for c in ("sketch", "parity", "bands"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin, end in zip(ends, ends[1:]):
        if (root[begin:end] == root[begin]).all():
            continue
        if one_block[begin]:
            x, y = np.triu_indices(end - begin, 1)
            blocks = [(x + begin, y + begin)]
        else:
            ones, twos = begin + np.flatnonzero(first[begin:end]), begin + np.flatnonzero(~first[begin:end])
            blocks = [(np.repeat(x, len(twos)), np.tile(twos, len(x))) for x in np.array_split(ones, max(1, len(ones) // 64))]
        for x, y in blocks:
            crossing = root[x] != root[y]
            x, y = x[crossing], y[crossing]
            for part in range(0, len(x), 1 << 16):
                p, q = x[part:part + (1 << 16)], y[part:part + (1 << 16)]
                counts = popcount(sketch[p] ^ sketch[q]), popcount(parity[p] ^ parity[q])
                fit = may_link(*counts, n[p], n[q])
                if not fit.any():
                    continue
                likeness = similarity(*(c[fit] for c in counts), n[p][fit], n[q][fit])
                p, q = p[fit], q[fit]
                if best_only:
                    x2, y2, like = np.concatenate([p, q]), np.concatenate([q, p]), np.tile(likeness, 2)
                    order = np.lexsort((ids[y2], like, x2))
                    top = order[np.append(x2[order][1:] != x2[order][:-1], True)]
                    out.append((ids[x2[top]], ids[y2[top]], like[top]))
                else:
                    here = (bands[p] == bands[q]).argmax(axis=1) == band[p]
                    out.append((np.minimum(ids[p], ids[q])[here], np.maximum(ids[p], ids[q])[here], likeness[here]))
    a, b, likeness = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(likeness, pa.float64())], names=["a", "b", "likeness"])


def near_documents(docs: DataFrame) -> DataFrame:
    """doc_id, _key, n_shingles and component_id of every row; _key names the pair of doc_id and text.

    Null, empty and blank texts have an empty set, link with nothing and are components of their own. Texts of fewer than five
    words are one shingle. Repeated rows have equal sets, so they are linked. component_id is the least id in the component; null
    ids count as none, so a component without any id has a null one.
    """
    work = Work(docs.sparkSession, "near-documents")
    rows = work.keep(described(docs), "described")
    classes = work.keep(rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("_key").alias("_key"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"), F.first("parity").alias("parity")), "classes")
    buckets = _buckets(classes, "class")
    shared = work.keep(buckets.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("class").alias("leader")).where("_n > 1").select("bucket", "leader"), "shared")
    members = work.keep(buckets.join(shared, "bucket"), "members")
    led = members.groupBy("class", "leader").agg(F.count("*").alias("times"))
    order = Window.partitionBy("class").orderBy(F.col("times").desc(), "leader")
    first = (led.where("class != leader").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= LEADERS)
             .select(F.col("class").alias("b"), F.col("leader").alias("a")))
    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select("class", "_key")
    texts = work.keep(packed(docs).join(wanted, "_key").groupBy("class").agg(F.first("packed").alias("packed")), "texts")

    brief = classes.select("class", "n", "sketch", "parity")
    looked = (first.join(brief.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"), F.col("parity").alias("parity_b")), "b")
              .join(brief.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"), F.col("parity").alias("parity_a")), "a")
              .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", "parity_a", "parity_b"))

    def estimate(batch):
        bits = {c: np.frombuffer(b"".join(binary_rows(batch, c)), np.uint64).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b", "parity_a", "parity_b")}
        keep = may_link(popcount(bits["sketch_a"] ^ bits["sketch_b"]), popcount(bits["parity_a"] ^ bits["parity_b"]),
                        batch.column(2).to_numpy(), batch.column(3).to_numpy())
        return batch.select(["a", "b"]).filter(pa.array(keep))

    found = work.keep(_confirmed(map_batches(looked, estimate, "a long, b long"), texts), "links-0")
    roots = components(found, work, "first")
    nearest = work.keep(_cross_pairs(classes, roots, members, work, "nearest", True), "nearest")
    found = found.union(work.keep(_confirmed(nearest, texts), "links-1"))
    roots = components(found, work, "second")
    crossing = work.keep(_cross_pairs(classes, roots, members, work, "crossing", False), "crossing")
    more = work.keep(_confirmed(crossing, texts), "links-2")
    ids = roots.select(F.col("node").alias("class"), "root")
    bridges = (more.join(ids.select(F.col("class").alias("a"), F.col("root").alias("root_a")), "a", "left")
               .join(ids.select(F.col("class").alias("b"), F.col("root").alias("root_b")), "b", "left")
               .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    final = components(bridges, work, "third").select(F.col("node").alias("root"), F.col("root").alias("top"))
    tops = (classes.select("class", "rep").join(ids, "class", "left").withColumn("root", F.coalesce("root", "class"))
            .join(final, "root", "left").select("class", "rep", F.coalesce("top", "root").alias("top")))
    least = tops.groupBy("top").agg(F.min("rep").alias("component_id"))
    answer = tops.join(least, "top").select("class", "component_id")
    rows = rows.select("doc_id", "_key", F.col("n").alias("n_shingles"), "class")
    found = rows.where("class IS NOT NULL").join(answer, "class").select("doc_id", "_key", "n_shingles", "component_id")
    return found.unionByName(rows.where("class IS NULL").select("doc_id", "_key", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose id is the least of their component; equal rows are kept once.

    Rows without an id stay if nothing with an id is linked to them, one for each text.
    """
    state = near_documents(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("_key").distinct()
    name = F.xxhash64(F.col("doc_id").cast("long"), F.lit(1), F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), name.alias("_key")).join(state, "_key", "left_semi")
    once = Window.partitionBy("_key").orderBy(F.lit(1))
    return rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_row.*")


SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS w FROM documents),
 g AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, 1))) AS i FROM d WHERE len(w) > 0),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h FROM g),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE {DENOMINATOR} * m >= {NUMERATOR} * (x.n + y.n - m)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op10_near_documents", SQL)
def op10_near_documents(spark, sf_dir):
    found = near_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
