"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the corpus.

Both tokenizers cut a text into the same bytes. Offsets where tokens of both end cut them into groups; every stretch between
neighbouring ends of either tokenizer is one link, the overlap of one token A with one token B.

Most groups are one token on either side with the same bytes. For them an array from id A to the id B of the same bytes is made
beforehand, and their links are counted in a vector as long as vocabulary A, one per task. Only links of irregular groups become
pairs, with one row per pair and block of texts (about BLOCK bytes, or one longer text), so a pair that occurs everywhere
is one row per block and is summed before the exchange. Blocks are written once; corpus counts come back to them in one row
per block. The driver holds two vectors, as long as the vocabularies.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import read
from loomspan.llm.registry import query
from loomspan.llm.tokens import BYTE_BPE, PIECE_BPE, byte_bpe, piece_bpe
from loomspan.llm.work import Work

BLOCK = 1 << 21  # bytes of the texts in a block, about
BLOCK_ROWS = 20_000

BLOCKS = "block long, doc_ids array<long>, sizes binary, digests array<string>, links binary, pairs array<struct<pair:long,n:long>>, same array<struct<a:int,n:long>>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pairing:
    """Two vocabularies: bytes in each token, the id B with the same bytes as an id A (-1: none), and ids as text with what follows them."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_bpe(path_a, special=False), piece_bpe(path_b)
        by_bytes = {}
        for i in range(len(self.b.table) - 1, -1, -1):
            by_bytes[self.b.table[i]] = i
        self.same = np.array([by_bytes.get(t, -1) for t in self.a.table], np.int64)
        self.width_a, self.width_b = (np.array(list(map(len, t.table)), np.int64) for t in (self.a, self.b))
        n_a, n_b = len(self.a.table), len(self.b.table)
        # one table for all that a written group is made of: ids A with , and |, ids B with , and ; and alone
        self.written = [b"%d," % i for i in range(n_a)] + [b"%d|" % i for i in range(n_a)] + \
            [b"%d," % i for i in range(n_b)] + [b"%d;" % i for i in range(n_b)] + [b"%d" % i for i in range(n_b)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text; None if the bytes of either are not a blank and the text."""
        a, b = self.a.encode(" " + text), self.b.encode(text)
        want = b" " + text.encode()
        for ids, table in ((a, self.a.table), (b, self.b.table)):
            if b"".join(map(table.__getitem__, ids.tolist())) != want:
                return None
        return a, b


@cache
def pairing(path_a: str, path_b: str) -> Pairing:
    """The vocabularies of this process."""
    return Pairing(path_a, path_b)


class Aligned:
    """The tokens of some texts laid end to end, their groups and their links."""

    def __init__(self, p: Pairing, encoded: list[tuple[np.ndarray, np.ndarray]]):
        a, b = (np.concatenate([np.empty(0, np.uint32), *side]).astype(np.int64) for side in zip(*encoded, strict=True)) if encoded else (np.empty(0, np.int64),) * 2
        end_a, end_b = np.cumsum(p.width_a[a]), np.cumsum(p.width_b[b])
        total = int(end_a[-1]) if len(a) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        both = is_a & is_b
        self.a, self.b = a, b
        # a link is a stretch between neighbouring ends: its tokens are the first that end at its end or behind it
        stops = np.flatnonzero(is_a | is_b)
        self.at_a, self.at_b = (np.cumsum(x)[stops] - x[stops] for x in (is_a, is_b))
        self.group_a, self.group_b, self.group_link = (np.cumsum(both)[e] - both[e] for e in (end_a, end_b, stops))
        self.n_groups = int(both.sum())
        self.last_a, self.last_b = both[end_a], both[end_b]
        # regular: one token on either side with the same bytes, and the id that the array names
        single = (np.bincount(self.group_a, minlength=self.n_groups) == 1) & (np.bincount(self.group_b, minlength=self.n_groups) == 1)
        self.regular = single[self.group_link] & (p.same[a[self.at_a]] == b[self.at_b])
        self.pairs = a[self.at_a] * len(p.b.table) + b[self.at_b]

    def written(self, p: Pairing, sizes: list[tuple[int, int]]) -> list[str]:
        """SHA-256 of the written groups of each text; '' for a text without tokens."""
        n_a, n_b = len(p.a.table), len(p.b.table)
        code_a = self.a + np.where(self.last_a, n_a, 0)
        code_b = self.b + np.where(self.last_b, 2 * n_a + n_b, 2 * n_a)
        ends = np.cumsum([y for _, y in sizes], dtype=np.int64)
        ends = ends[np.array([y > 0 for _, y in sizes], bool)] - 1 if sizes else ends
        code_b[ends] += n_b
        # tokens A of a group stand before its tokens B
        upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=self.n_groups)) for g in (self.group_a, self.group_b))
        codes = np.empty(len(code_a) + len(code_b), np.int64)
        codes[np.arange(len(code_a)) + np.concatenate([[0], upto_b])[self.group_a]] = code_a
        codes[np.arange(len(code_b)) + upto_a[self.group_b]] = code_b
        out, begin = [], 0
        for x, y in sizes:
            part = codes[begin:begin + x + y].tolist()
            begin += x + y
            out.append(hashlib.sha256(b"".join(map(p.written.__getitem__, part))).hexdigest() if part else "")
        return out


def _squeezed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a, "<u4").tobytes() for a in arrays))


def _unsqueezed(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4").astype(np.int64)


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligned blocks of texts, and a row per task with its counts of regular links by id A (block null)."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("digests", pa.list_(pa.string())), ("links", pa.binary()),
                        ("pairs", pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))), ("same", pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int64())])))])

    def run(batches):
        p = pairing(path_a, path_b)
        counts, number = np.zeros(len(p.a.table), np.int64), TaskContext.get().partitionId() << 32

        def aligned(ids, encoded):
            nonlocal counts, number
            found = Aligned(p, [e for e in encoded if e is not None])
            sizes = [(0, 0) if e is None else (len(e[0]), len(e[1])) for e in encoded]
            digests = found.written(p, sizes)
            regular = found.a[found.at_a][found.regular]
            counts += np.bincount(regular, minlength=len(counts))
            keys, index, times = np.unique(found.pairs[~found.regular], return_inverse=True, return_counts=True)
            # a link in one number: ids A of regular ones, then places in the block's list of pairs
            code = np.empty(len(found.pairs), np.int64)
            code[found.regular], code[~found.regular] = regular, len(counts) + index
            of_text = np.repeat(np.arange(len(sizes)), [x for x, _ in sizes])
            links = np.bincount(of_text[found.at_a], minlength=len(sizes))
            groups = np.bincount(of_text[np.flatnonzero(found.last_a)], minlength=len(sizes))
            table = np.array(sizes, np.int64).reshape(-1, 2)
            number += 1
            return pa.RecordBatch.from_pylist([{
                "block": number, "doc_ids": ids, "sizes": _squeezed(table[:, 0], table[:, 1], groups, links), "digests": digests, "links": _squeezed(code),
                "pairs": [{"pair": k, "n": n} for k, n in zip(keys.tolist(), times.tolist(), strict=True)], "same": []}], schema)

        ids, encoded, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id)
                encoded.append(p.encode(text) if text else None)
                size += len(text or "")
                if size >= BLOCK or len(ids) == BLOCK_ROWS:
                    yield aligned(ids, encoded)
                    ids, encoded, size = [], [], 0
        if ids:
            yield aligned(ids, encoded)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_pylist([{"block": None, "doc_ids": [], "sizes": b"", "digests": [], "links": b"", "pairs": [],
                                               "same": [{"a": a, "n": n} for a, n in zip(seen.tolist(), counts[seen].tolist(), strict=True)]}], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def align(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> tuple[DataFrame, DataFrame]:
    """One row per document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the pair counts (a, b, n).

    Strings of special tokens are plain text. Null and empty texts, and those whose tokens are not a blank and the text in either
    vocabulary, have zeros and the digest ''. Equal rows count as often as they occur; null ids stay null; other columns are not read.
    """
    spark = docs.sparkSession
    work, p = Work(spark, "alignment"), pairing(path_a, path_b)
    width, same = len(p.b.table), p.same
    blocks = work.keep(_blocks(docs, path_a, path_b), "blocks")

    irregular = blocks.select(F.inline("pairs"))
    spark_same = F.broadcast(spark.createDataFrame([(a, int(b)) for a, b in enumerate(same) if b >= 0], "a int, b long"))  # as long as the vocabulary
    regular = blocks.where("block IS NULL").select(F.inline("same")).groupBy("a").agg(F.sum("n").alias("n")).join(spark_same, "a")
    counts = work.keep(irregular.unionByName(regular.select((F.col("a").cast("long") * width + F.col("b")).alias("pair"), "n")).groupBy("pair").agg(F.sum("n").alias("n")), "counts")

    split = counts.select(F.floor(F.col("pair") / F.lit(width)).cast("int").alias("a"), F.pmod("pair", F.lit(width)).cast("int").alias("b"), "n", "pair")
    best, of_same = np.zeros(width, np.int64), np.zeros(len(same), np.int64)
    for b, n in split.groupBy("b").agg(F.max("n")).collect():  # one row per id B
        best[b] = n
    for a, n in split.join(spark_same.withColumnRenamed("b", "own"), "a").where("b = own").select("a", "n").collect():  # one row per id A
        of_same[a] = n
    sent = spark.sparkContext.broadcast((best, of_same, of_same == best[same]))

    wanted = blocks.where("block IS NOT NULL").select("block", F.explode("pairs.pair").alias("pair"))
    answers = wanted.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n")).alias("answers"))  # at most a block's links
    joined = blocks.where("block IS NOT NULL").select("block", "doc_ids", "sizes", "digests", "links").join(answers, "block", "left")

    def finish(batches):
        best, of_same, same_is_best = sent.value
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                answers = columns["answers"][i]
                flat = answers.values if answers.is_valid else None
                pair, n = (np.asarray(flat.field(k)) for k in ("pair", "n")) if flat is not None else (np.empty(0, np.int64),) * 2
                order = np.argsort(pair)
                pair, n = pair[order], n[order]
                value = np.concatenate([of_same, n])
                is_best = np.concatenate([same_is_best, n == best[pair % width]])
                n_a, n_b, groups, links = _unsqueezed(columns["sizes"][i].as_py()).reshape(4, -1)
                code = _unsqueezed(columns["links"][i].as_py())
                upto = np.concatenate([[0], np.cumsum(links)])
                sums, hits = (np.concatenate([[0], np.cumsum(x[code])])[upto] for x in (value, is_best.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [columns["doc_ids"][i].values, *map(pa.array, (n_a, n_b, groups, links, np.diff(hits), np.diff(sums))), columns["digests"][i].values],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(finish, RESULT), split.select("a", "b", "n")


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    return align(read(spark, sf_dir, "documents", "doc_id", "text"))[0]
