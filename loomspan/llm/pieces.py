"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A blank is the whitespace marker: pieces are kept with a blank in the marker's place, and one blank is put before a text.
No piece goes on behind a blank once it has seen other characters, so the best path of a text is the best paths of its
chunks (blanks and what follows up to the next blank); chunks recur, and a bounded cache in each task's process keeps their
results. A character that no piece covers is written as its UTF-8 bytes, also the marker character itself, so decoding
gives back every text exactly.

The vocabulary is read on the driver from a path given by the caller and broadcast; its size is that of the file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import binary_rows, map_batches, read
from loomspan.llm.registry import query

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0  # below the least score of any piece
CACHE = 100_000  # chunks in a generation of the cache; two generations are kept
LONG_CHUNK = 64  # longer ones are not kept
_CHUNK = re.compile(rb" +[^ ]*|[^ ]+")


@dataclass
class Vocabulary:
    """pieces[id]: what an id stands for; scores[id]; byte_ids[b]; base, check and value: the double-array trie."""

    pieces: list[bytes]
    scores: list[float]
    byte_ids: list[int]
    base: list[int]
    check: list[int]
    value: list[int]
    unknown: float


def double_array(keys: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Trie in two arrays: the child of node s by byte c is t = base[s] + c if check[t] == s; node 0 is the root."""
    trie: dict = {}
    for key, value in keys.items():
        node = trie
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    size = 1 << 18
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    check[0] = -2
    free_from, level = 257, [(0, trie)]

    def place(codes: np.ndarray) -> int:
        """A base at which the spots of all children are free."""
        begin, width = free_from, 1024
        while begin < size:
            spots = np.flatnonzero(check[begin:begin + width] == -1) + (begin - codes[0])
            spots = spots[spots + codes[-1] < size]
            fits = (check[spots[:, None] + codes[None, :]] == -1).all(axis=1)
            if fits.any():
                return int(spots[int(np.argmax(fits))])
            begin, width = begin + width, 2 * width
        raise ValueError("the trie does not fit")

    while level:
        below = []
        for at, node in sorted(level, key=lambda x: -len(x[1])):
            value[at] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            while check[free_from] != -1:
                free_from += 1
            base[at] = free_from - codes[0] if len(codes) == 1 else place(np.array(codes))
            for c in codes:
                check[base[at] + c] = at
                below.append((int(base[at]) + c, node[c]))
        level = below
    used = int(np.flatnonzero(check != -1)[-1]) + 257
    return base[:used].tolist(), check[:used].tolist(), value[:used].tolist()


def build(pieces: list[str], scores: list[float], plain: list[bool], byte_ids: list[int]) -> Vocabulary:
    """Vocabulary from pieces, log scores, which of them are ordinary pieces, and the ids of the 256 byte pieces."""
    keys = {p.replace(MARKER, " ").encode(): i for i, p in enumerate(pieces) if plain[i] and p}
    if any(re.search(rb"[^ ] ", k) for k in keys):
        raise ValueError("a piece holds a whitespace marker behind other characters")
    table = [p.replace(MARKER, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
    for b, i in enumerate(byte_ids):
        table[i] = bytes([b])
    least = min((scores[i] for i in keys.values()), default=0.0)
    return Vocabulary(table, list(scores), list(byte_ids), *double_array(keys), least - UNKNOWN_PENALTY)


def load(path: str = VOCABULARY) -> Vocabulary:
    """Vocabulary of a SentencePiece model file with byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte fallback")
    return build([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], [not s for s in special], byte_ids)


def best_path(chunk: bytes, v: Vocabulary) -> list[int]:
    """Ids of the path with the largest sum of scores; of equal paths into a place the first found stays."""
    n, base, check, value, scores = len(chunk), v.base, v.check, v.value, v.scores
    nothing = float("-inf")
    best, came, by = [nothing] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == nothing:
            continue
        lead = chunk[i]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        node, j, covered = 0, i, False
        while j < n:
            to = base[node] + chunk[j]
            if check[to] != node:
                break
            node = to
            j += 1
            piece = value[node]
            if piece >= 0:
                if j - i == width:
                    covered = True
                score = here + scores[piece]
                if score > best[j]:
                    best[j], came[j], by[j] = score, i, piece
        if not covered:
            j = min(n, i + width)
            if here + v.unknown > best[j]:
                best[j], came[j], by[j] = here + v.unknown, i, -1
    out, j = [], n
    while j > 0:
        if by[j] >= 0:
            out.append(by[j])
        else:
            out += [v.byte_ids[b] for b in reversed(chunk[came[j]:j])]
        j = came[j]
    out.reverse()
    return out


class Encoder(dict):
    """Chunk to its ids as packed 32-bit numbers; forgets chunks that were not met for a generation."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = np.array(best_path(chunk, self.vocabulary), np.int32).tobytes()
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, _CHUNK.findall(b" " + text))) if text else b"", np.int32)


def decode(ids, vocabulary: Vocabulary) -> bytes:
    """UTF-8 bytes of a text: pieces joined, the marker a blank, the blank before the text taken off."""
    joined = b"".join(map(vocabulary.pieces.__getitem__, ids))
    return joined[1:] if joined[:1] == b" " else joined


_ENCODERS: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One encoder for each broadcast vocabulary and worker process."""
    if sent.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[sent.id] = Encoder(sent.value)
    return _ENCODERS[sent.id]


class _Sent:
    """A broadcast value with an id that worker processes can tell it by."""

    def __init__(self, spark, value):
        self.held = spark.sparkContext.broadcast(value)
        self.id = self.held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, token_ids and exact (decoding gives the text back) of every row, over whole texts.

    A null text has no tokens: n_tokens 0, token_ids null, exact true. An empty one has n_tokens 0 and an empty list.
    """
    sent = _Sent(docs.sparkSession, vocabulary)

    def step(batch):
        encoder, parts, lengths, exact, empty = _encoder(sent), [], [], [], []
        for raw in binary_rows(batch, "text"):
            ids = encoder.encode(raw) if raw else np.empty(0, np.int32)
            parts.append(ids)
            lengths.append(len(ids))
            empty.append(raw is None)
            exact.append(not raw or decode(ids.tolist(), encoder.vocabulary) == raw)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)), mask=pa.array(empty))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int64()), ids, pa.array(exact)], names=["doc_id", "n_tokens", "token_ids", "exact"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, step, "doc_id long, n_tokens long, token_ids array<int>, exact boolean")


def decoded(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of rows with token_ids; a null list gives a null text. Bytes that are no UTF-8 become U+FFFD."""
    sent = _Sent(tokens.sparkSession, vocabulary)

    def step(batch):
        texts = [None if ids is None else decode(ids, sent.value).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids"), step, "doc_id long, text string")


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    return encode(read(spark, sf_dir, "documents", "doc_id", "text"), load())
