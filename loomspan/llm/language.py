"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of its lower-cased byte 1-, 2- and 3-grams, hashed into BUCKETS places; what is
no letter counts as one blank. Each language has up to CLUSTERS centroids, found by spherical k-means over a bounded
sample of its labelled texts. A text gets the language of the centroid with the largest cosine; it is rejected when its
cosine is under SHARE of what nearly all sampled texts of that language and of about its length have with their own centroid.
Length counts in powers of two of distinct grams, as cosines grow with it.

Document frequencies are counted over all texts that may be learned from, as (bucket, count) rows with a part per batch.
The driver holds the BUCKETS frequencies and languages x CLUSTERS centroids, whatever the size of the corpus; the number of
languages is the number of distinct labels and checked against MAX_LANGUAGES.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import binary_rows, is_held_out, map_batches, may_learn, read
from loomspan.llm.registry import query

BUCKETS = 1 << 14
CLUSTERS = 4
SAMPLE = 1500  # labelled texts of a language that its centroids are fitted on, about
MAX_LANGUAGES = 1000
QUANTILE = 0.05  # of the cosines of sampled texts of one language and length
SHARE = 0.5  # of that quantile, which a text must reach
FEWEST = 10  # sampled texts that a quantile is taken of; with fewer those of all languages, then the next shorter length
FLOOR = 0.05  # least accepted cosine of texts shorter than any length with enough sampled texts
LENGTHS = BUCKETS.bit_length()
UNKNOWN = "und"

#: Bytes of letters as they are (capitals made small, all of non-ASCII text), everything else a blank.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers that occur, ascending, and how often."""
    raw = FOLD[np.frombuffer(text.lower().encode(), np.uint8)]
    one = raw * np.uint32(0x9E3779B1)
    parts = [one]
    if len(raw) > 1:
        two = (raw[:-1] << np.uint32(8) | raw[1:]) + np.uint32(1 << 16)
        parts.append(two * np.uint32(0x85EBCA6B))
    if len(raw) > 2:
        parts.append(((two[:-1] << np.uint32(8) | raw[2:]) + np.uint32(1 << 25)) * np.uint32(0xC2B2AE35))
    counts = np.bincount(np.concatenate(parts) >> np.uint32(18), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the unit TF-IDF vector."""
    at, counts = grams(text)
    values = np.log1p(counts) * idf[at]
    norm = float(np.sqrt((values * values).sum()))
    return at, values / norm if norm > 0 else values


class Rows:
    """Sparse vectors laid end to end: places, values and where each vector starts; none is empty."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray]):
        self.starts = np.cumsum([0, *map(len, places)])
        self.places, self.values = np.concatenate(places), np.concatenate(values).astype(np.float64)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def dots(self, centroids: np.ndarray) -> np.ndarray:
        """Products of every vector with every centroid."""
        return np.stack([np.add.reduceat(self.values * c[self.places], self.starts[:-1]) for c in centroids], axis=1)

    def total(self, chosen: np.ndarray) -> np.ndarray:
        """Dense sum of the vectors that are chosen."""
        use = np.repeat(chosen, np.diff(self.starts))
        return np.bincount(self.places[use], self.values[use], BUCKETS)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def cluster(vectors: Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by spherical k-means, and the cosine of each text with its own; starts at texts far apart."""
    numbers = np.arange(len(vectors))
    centroids = _unit(vectors.total(numbers >= 0)[None])
    while len(centroids) < k:
        near = vectors.dots(centroids).max(axis=1)
        far = int(np.argsort(near, kind="stable")[len(near) // 10])
        centroids = np.concatenate([centroids, _unit(vectors.total(numbers == far)[None])])
    for _ in range(8):
        mine = np.argmax(vectors.dots(centroids), axis=1)
        centroids = _unit(np.stack([vectors.total(mine == c) if (mine == c).any() else centroids[c] for c in range(k)]))
    return centroids, vectors.dots(centroids).max(axis=1)


def length(n_grams: int) -> int:
    """Class of length of a text with so many distinct grams."""
    return n_grams.bit_length() - 1


def least_accepted(lengths: dict[str, np.ndarray], scores: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For each language the least accepted cosine by class of length, from those of its sampled texts."""
    every, all_scores = np.concatenate(list(lengths.values())), np.concatenate(list(scores.values()))
    out = {}
    for lang in lengths:
        bars = np.full(LENGTHS, FLOOR)
        for k in range(LENGTHS):
            found = scores[lang][lengths[lang] == k]
            if len(found) < FEWEST:
                found = all_scores[every == k]
            if len(found) >= FEWEST:
                bars[k] = max(FLOOR, SHARE * float(np.quantile(found, QUANTILE)))
            elif k:
                bars[k] = bars[k - 1]
        out[lang] = bars
    return out


class Model:
    """Centroids as columns, with the language of each and its least accepted cosines by class of length."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, least: list[np.ndarray]):
        self.idf, self.languages, self.columns, self.least = idf, languages, np.ascontiguousarray(centroids.T), least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is rejected; und, 0 and rejected without a letter."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, values = vector(text, self.idf)
        scores = values @ self.columns[at]
        best = int(np.argmax(scores))
        score = min(1.0, max(0.0, float(scores[best])))
        return self.languages[best], score, score < self.least[best][length(len(at))]


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each bucket."""
    def count(batch):
        total, seen = np.zeros(BUCKETS, np.int64), 0
        for raw in binary_rows(batch, "text"):
            if raw:
                total[grams(raw.decode())[0]] += 1
                seen += 1
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], names=["bucket", "n"])

    rows = map_batches(texts.select("text"), count, "bucket long, n long", rows=1 << 30).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, seen = np.zeros(BUCKETS, np.int64), 0
    for bucket, n in rows:
        if bucket < 0:
            seen = n
        else:
            out[bucket] = n
    return seen, out


def fit(docs: DataFrame) -> Model:
    """Learns from text and non-null lang of the documents whose id is not held out."""
    train = docs.where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = train.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model(np.zeros(BUCKETS), [], np.zeros((0, BUCKETS)), [])
    seen, frequency = document_frequencies(train)
    idf = np.log((1.0 + seen) / (1.0 + frequency)) + 1.0

    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, SAMPLE / n)))])
    sample = train.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])

    def vectors(batch):
        """Texts become sparse vectors here, so that no text is moved or gathered."""
        columns = [[] for _ in range(4)]
        for lang, raw, order in zip(batch.column(2).to_pylist(), binary_rows(batch, "text"), batch.column(3).to_pylist(), strict=True):
            if raw and has_letter(text := raw.decode()):
                at, values = vector(text, idf)
                for column, value in zip(columns, (lang, order, at.astype("<u2").tobytes(), values.astype("<f4").tobytes()), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.binary(), pa.binary()), strict=True)],
                                          names=["lang", "draw", "places", "entries"])

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "places", "entries"], kind="stable")
        places = [np.frombuffer(p, "<u2").astype(np.int32) for p in rows["places"]]
        found, scores = cluster(Rows(places, [np.frombuffer(v, "<f4") for v in rows["entries"]]), min(CLUSTERS, len(places)))
        lengths = np.array([length(len(p)) for p in places], np.uint8)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "lengths": [lengths.tobytes()], "scores": [scores.astype("<f4").tobytes()],
                             "centroids": [found.astype("<f4").tobytes()]})

    # texts drawn together, as copies are, can be many: the first 2 * SAMPLE of a language in order of the draw are fitted on
    first = Window.partitionBy("lang").orderBy("draw", "places", "entries")
    sparse = map_batches(sample, vectors, "lang string, draw double, places binary, entries binary", rows=256)
    bounded = sparse.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 2 * SAMPLE).drop("_n")
    # a row per language: one byte and one float for each sampled text beside the centroids
    rows = sorted(bounded.groupBy("lang").applyInPandas(centroids, "lang string, lengths binary, scores binary, centroids binary").collect())
    if not rows:
        return Model(idf, [], np.zeros((0, BUCKETS)), [])
    stacked = [np.frombuffer(bytes(r["centroids"]), "<f4").reshape(-1, BUCKETS) for r in rows]
    stacked = [c[sorted(range(len(c)), key=lambda i: c[i].tobytes())] for c in stacked]
    least = least_accepted({r["lang"]: np.frombuffer(bytes(r["lengths"]), np.uint8) for r in rows}, {r["lang"]: np.frombuffer(bytes(r["scores"]), "<f4") for r in rows})
    names = [r["lang"] for r, c in zip(rows, stacked, strict=True) for _ in c]
    return Model(idf, names, np.concatenate(stacked), [least[name] for name in names])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row; works on the text alone.

    Null, empty and letterless texts get und with score 0 and count as rejected; so does everything when there was
    nothing to learn from. Equal cosines go to the first language in order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        out = [sent.value.predict(raw.decode() if raw else None) for raw in binary_rows(batch, "text")]
        names, scores, rejected = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, step, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        keep = [not sent.value.predict(raw.decode() if raw else None)[2] for raw in binary_rows(batch, "text")]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, step, docs.schema)


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, fit(docs))
