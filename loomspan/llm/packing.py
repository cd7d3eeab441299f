"""Best-fit packing of token sequences: a configuration program over the histogram of lengths decides, Spark places.

Documents are encoded once, cut into pieces and written with a running number within their task and length. The histogram of
lengths (at most capacity numbers) goes to the driver, configurations.py solves it into groups of equal sequences, and a table of
places comes back: for each length which numbers go to which group, a few rows per group, bounded by the capacity alone. A
piece's number within its length is its number in its task behind those of the tasks before, from a prefix sum over
(task, length) counts; no piece is sorted or moved by its length, so a length with any share of the pieces is no hot key.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import read
from loomspan.llm.configurations import Bins, configurations
from loomspan.llm.registry import query
from loomspan.llm.tokens import BYTE_BPE, byte_bpe
from loomspan.llm.work import Work

CAPACITY, END = 2048, 0
ROWS = 4096  # pieces in a batch


def cuts(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document and its end; only the first piece may be shorter than the capacity."""
    first = length % capacity or capacity
    return [0, *range(first, length + 1, capacity)]


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("ids", pa.list_(pa.int32())), ("task", pa.int32()), ("number", pa.int64())]

    def run(batches):
        tokenizer, task, numbers, rows = byte_bpe(path, special=True), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokenizer.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at = cuts(len(ids), capacity)
                for piece, (begin, stop) in enumerate(zip(at, at[1:], strict=False)):
                    part = ids[begin:stop]
                    rows.append((doc_id, piece, begin, stop - begin, zlib.crc32(part.tobytes()), part if with_ids else None, task, int(numbers[stop - begin])))
                    numbers[stop - begin] += 1
                    if len(rows) == ROWS:
                        yield batch_of()
                        rows = []
        if rows:
            yield batch_of()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, number long")


class Places:
    """For each length, from which number on pieces go to which group of equal sequences, and where in them."""

    def __init__(self, bins: list[Bins]):
        rows, first = [], 0
        for b in bins:
            offset = 0
            for n, k in sorted(b.holds.items(), reverse=True):
                rows.append((n, k, b.count, first, offset))
                offset += n * k
            first += b.count
        rows.sort()
        self.sequences, self.by_length = first, {}
        for n, group in groupby(rows, key=lambda r: r[0]):
            table = np.array([r[1:] for r in group], np.int64)
            self.by_length[n] = np.concatenate([[0], np.cumsum(table[:, 0] * table[:, 1])[:-1]]), *table.T

    def of(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given as length and number within the length."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for begin, stop in zip(edges, edges[1:], strict=False):
            at = order[begin:stop]
            n = int(lengths[at[0]])
            starts, each, _, first, offsets = self.by_length[n]
            row = np.searchsorted(starts, numbers[at], side="right") - 1
            copy, slot = np.divmod(numbers[at] - starts[row], each[row])
            sequence[at], offset[at] = first[row] + copy, offsets[row] + slot * n
        return sequence, offset


def pack(docs: DataFrame, path: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null without with_ids), sequence_id and offset of every piece of every document.

    A document is the ids of its text as the library gives them without special tokens, and end_id; null and empty texts are end_id
    alone. A document longer than the capacity is cut into pieces of the capacity behind a first one with what is over.
    Every piece is in one sequence, sequences are filled without gaps from 0 and hold at most capacity ids. Equal rows and null
    ids are documents like others; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    work = Work(spark, "packing")
    pieces = work.keep(_pieces(docs, path, capacity, end_id, with_ids), "pieces")
    counts = pieces.groupBy("task", "length").count()
    histogram = dict(counts.groupBy("length").agg(F.sum("count")).collect())  # at most capacity rows
    sent = spark.sparkContext.broadcast(Places(configurations(histogram, capacity)))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("number")).alias("number"))

    def place(batches):
        for batch in batches:
            found = sent.value.of(*(np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "number")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, token ids and the lengths of the pieces in order, from the rows of pack; a group holds at most capacity ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), with_ids=False).drop("ids")
