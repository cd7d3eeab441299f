"""Which windows of a fixed length start more than once in a corpus: the search shared by word and byte repeats.

Names of ever longer parts of the windows are compared over the whole corpus, level by level, and only windows whose part is
repeated go on to the next length; at the last level the part is the window itself, and the answer is exact.

* A level of length h looks at one part of length h of each window, its anchor (see windows.py). Runs of windows with one
  anchor are one row, so a level has about 2 / (window - h + 2) rows per symbol instead of one per position.
* A run whose anchor occurs once is unique and leaves. A run whose whole stretch of symbols occurs again is repeated
  at once and leaves as covered; one run of each such stretch stays as a witness if others share its anchor.
* The stretches of what is left after the first level are kept once; later levels cut their runs from them, so texts are read
  again only once, and what is counted and joined are a few numbers for each run.

Everything is keyed by names: counts have a map-side part and are written before they are joined, so that both sides of a join
come straight from an exchange and AQE can split a hot name; no group is gathered but the runs of one document. Each level is
written to the shared folder, so a lost executor costs a part of one level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import binary_rows, keyed, map_batches
from loomspan.llm.windows import BYTE_SYMBOLS, WordSymbols, anchored_runs
from loomspan.llm.work import Work

CHUNK = 1 << 17  # symbols handled at once in a task
RUN = "_key long, start int, count int, anchor long, stretch long"


@dataclass(frozen=True)
class Units:
    """How a text becomes symbols: units of UTF-8 bytes, or words between ASCII blanks."""

    words: bool

    def split(self, text: bytes | None):
        """Units of a text; of these a stretch is sliced, and joined() gives its bytes back."""
        return (text or b"").split() if self.words else (text or b"")

    def joined(self, units) -> bytes:
        return b" ".join(units) if self.words else bytes(units)

    def symbols(self, units) -> np.ndarray:
        """Symbols of units, or of several texts' units laid end to end."""
        return np.fromiter(map(_WORDS.__getitem__, units), np.uint64, len(units)) if self.words else BYTE_SYMBOLS[np.frombuffer(units, np.uint8)]


_WORDS = WordSymbols()


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, _key and the text compressed, so that joins move less."""
    def step(batch):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        texts = [None if t is None else squeeze(t) for t in binary_rows(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.binary())], names=["doc_id", "_key", "packed"])
    return map_batches(keyed(docs), step, "doc_id long, _key long, packed binary")


def unpacked(blob: bytes | None) -> bytes | None:
    return None if blob is None else zstandard.ZstdDecompressor().decompress(blob)


def _chunks(sequences):
    """Consecutive sequences (key, start, units) in chunks of about CHUNK symbols."""
    held, total = [], 0
    for item in sequences:
        held.append(item)
        total += len(item[2])
        if total >= CHUNK:
            yield held
            held, total = [], 0
    if held:
        yield held


def _runs(items, units: Units, window: int, length: int) -> list[pa.Array]:
    """Arrow arrays of the runs of some sequences (key, start, units)."""
    lengths = np.array([len(u) for _, _, u in items], np.int64)
    flat = [w for _, _, u in items for w in u] if units.words else b"".join(u for _, _, u in items)
    symbols = units.symbols(flat)
    sequence, at, count, anchor, place = anchored_runs(symbols, lengths, window, length)
    keys = np.array([k for k, _, _ in items], np.int64)
    starts = np.array([s for _, s, _ in items], np.int64)
    raw = memoryview(symbols).cast("B") if units.words else memoryview(flat)
    wide = 8 if units.words else 1
    digest = xxhash.xxh3_64_intdigest
    stretch = np.fromiter((digest(raw[p * wide:(p + n + window - 1) * wide]) for p, n in zip(place.tolist(), count.tolist(), strict=True)), np.uint64, len(place))
    return [pa.array(keys[sequence]), pa.array((starts[sequence] + at).astype(np.int32)), pa.array(count.astype(np.int32)),
            pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64))]


def _map_runs(df: DataFrame, read: Callable, units: Units, window: int, length: int) -> DataFrame:
    """Runs of the sequences (key, start, units) that read(batch) gives one after the other."""
    def run(batches):
        for batch in batches:
            for items in _chunks(read(batch)):
                arrays = _runs(items, units, window, length)
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, names=["_key", "start", "count", "anchor", "stretch"])
    return df.mapInArrow(run, RUN)


def _sort_out(rows: DataFrame, work: Work, label: str, last: bool, many_unique: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Covered runs (_key, start, count), and the runs that go on to the next level.

    many_unique drops rows with an anchor of their own first, which pays while most rows are such.
    """
    if many_unique:
        again = work.keep(rows.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor"), f"{label}-again")
        rows = work.keep(rows.join(again, "anchor", "left_semi"), f"{label}-shared")
    alike = rows.groupBy("anchor", "stretch").agg(F.count("*").alias("_n"), F.min(F.struct("_key", "start")).alias("_first"))
    if last:
        repeated = work.keep(alike.where("_n > 1").select("anchor", "stretch"), f"{label}-repeated")
        return rows.join(repeated, ["anchor", "stretch"], "left_semi").select("_key", "start", "count"), None
    alike = work.keep(alike, f"{label}-alike")
    anchors = work.keep(alike.groupBy("anchor").agg(F.sum("_n").alias("_all"), (F.min("_n") == 1).alias("_open")).where("_all > 1").select("anchor", "_open"), f"{label}-anchors")
    state = alike.join(anchors, "anchor").where("_open OR _n > 1")
    first = (F.col("_first._key") == F.col("_key")) & (F.col("_first.start") == F.col("start"))
    marked = work.keep(rows.join(state, ["anchor", "stretch"]).select(
        "_key", "start", "count", (F.col("_n") > 1).alias("_done"), ((F.col("_n") == 1) | (F.col("_open") & first)).alias("_on")), f"{label}-marked")
    return marked.where("_done").select("_key", "start", "count"), marked.where("_on").select("_key", "start", "count")


def repeated_windows(docs: DataFrame, units: Units, window: int, lengths: tuple[int, ...], work: Work) -> DataFrame:
    """Runs (_key, start, count) of the windows that start more than once in docs; lengths rise and end at window."""
    def texts(batch):
        for key, text in zip(batch.column(2).to_pylist(), binary_rows(batch, "text"), strict=True):
            yield key, 0, units.split(text)

    first = work.keep(_map_runs(keyed(docs), texts, units, window, lengths[0]), "level-0")
    found, rows = _sort_out(first, work, "level-0", lengths[0] == window, many_unique=True)
    if rows is None:
        return found

    def cut(batch):
        """Stretches of the runs that one text has left, each with a name of its own."""
        columns = [[] for _ in range(4)]
        for key, blob, runs in zip(batch.column(0).to_pylist(), binary_rows(batch, "packed"), batch.column(2).to_pylist(), strict=True):
            whole = units.split(unpacked(blob))
            for r in runs:
                at, stop = r["start"], r["start"] + r["count"] + window - 1
                name = xxhash.xxh3_64_intdigest(b"%d:%d" % (key, at)) >> 1
                for column, value in zip(columns, (name, key, at, units.joined(whole[at:stop])), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "text_key", "text_start", "body"])

    def whole_parts(batch):
        for key, body in zip(batch.column(0).to_pylist(), binary_rows(batch, "body"), strict=True):
            yield key, 0, units.split(body)

    def runs_of_parts(batch):
        for key, body, runs in zip(batch.column(0).to_pylist(), binary_rows(batch, "body"), batch.column(2).to_pylist(), strict=True):
            body = units.split(body)
            for r in runs:
                yield key, r["start"], body[r["start"]:r["start"] + r["count"] + window - 1]

    held = packed(docs).join(_lists(rows), "_key").select("_key", "packed", "runs")
    parts = work.keep(map_batches(held, cut, "part long, text_key long, text_start int, body binary"), "parts")
    source, read, later = parts.select("part", "body"), whole_parts, None
    for i, length in enumerate(lengths[1:], 1):
        last = length == window
        level = work.keep(_map_runs(source, read, units, window, length), f"level-{i}")
        done, rows = _sort_out(level, work, f"level-{i}", last)
        later = done if later is None else later.unionByName(done)
        if not last:
            source, read = parts.join(_lists(rows), F.col("part") == F.col("_key")).select("part", "body", "runs"), runs_of_parts
    placed = later.join(parts.select("part", "text_key", "text_start").distinct(), F.col("_key") == F.col("part")).select(
        F.col("text_key").alias("_key"), (F.col("text_start") + F.col("start")).alias("start"), "count")
    return found.unionByName(placed)


def _lists(runs: DataFrame) -> DataFrame:
    """The runs of each key in one row; a key is one text or a part of one. Equal rows share a key and have the same runs, each kept once."""
    return runs.groupBy("_key").agg(F.collect_set(F.struct("start", "count")).alias("runs"))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, packed text and the list of covered runs (null: none) of every row of docs."""
    return packed(docs).join(_lists(runs), "_key", "left").select("doc_id", "packed", "runs")


def run_arrays(runs) -> tuple[np.ndarray, np.ndarray]:
    runs = runs or []
    return np.array([r["start"] for r in runs], np.int64), np.array([r["count"] for r in runs], np.int64)
