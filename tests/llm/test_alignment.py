"""Token alignment against nested loops over byte ranges, with odd rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm import alignment
from loomspan.llm.tokens import BYTE_BPE, PIECE_BPE, byte_bpe, piece_bpe


def library_ids(texts):
    """Ids A by the tokenizers library alone, ids B by sentencepiece."""
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    model = piece_bpe(PIECE_BPE).model
    return [(tokenizer.encode(" " + t, add_special_tokens=False).ids, model.encode(t)) if t else ([], []) for t in texts]


def brute(rows):
    table_a, table_b = byte_bpe(BYTE_BPE, False).table, piece_bpe(PIECE_BPE).table
    out, counts = [], Counter()
    for (doc_id, text), (a, b) in zip(rows, library_ids([t for _, t in rows])):
        if any(b"".join(t[i] for i in ids) != b" " + (text or "").encode() for ids, t in ((a, table_a), (b, table_b))):
            a, b = [], []
        ranges = []
        for ids, table in ((a, table_a), (b, table_b)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(table[i])))
                at += len(table[i])
            ranges.append(found)
        links = [(i, j) for i, (s, e) in zip(a, ranges[0]) for j, (u, v) in zip(b, ranges[1]) if s < v and u < e]
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, r) if begin < e <= cut) for ids, r in zip((a, b), ranges)))
            begin = cut
        counts.update(links)
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(str(d), x, y, g, len(l), sum(counts[k] == best[k[1]] for k in l), sum(counts[k] for k in l), h) for d, x, y, g, l, h in out], counts


def corpus():
    random.seed(11)
    words = "the Haus élan 東京 naïve x0 1234 foo_bar <|endoftext|> \t \n\n   ofanonnt, ᚠ 😀 a\xa0b don't".split(" ") + [" ", "  "]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(1, 25))) for _ in range(40)]
    texts += ["a", " ", "<s> </s> <unk>", "<0x41>", "▁marker ▁", "\x00\x01", "é" * 50, "word " * 300, texts[0], "antidisestablishmentarianism", " " * 6000 + "x"]
    return [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[3]), (900, None), (901, "")]


@pytest.mark.parametrize("block", [1 << 22, 60])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    got, counts = alignment.align(docs)
    want, want_counts = brute(rows)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(want_counts)
    marked = {r.doc_id: r for r in got.collect()}
    assert marked[44].n_a == 0 and marked[44].groups_sha256 == "" and marked[900].n_links == 0


def test_irregular_pairs_meet_regular_ones(spark):
    """A pair may occur in both kinds of groups; its count is one number."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aaaaaaaaaaa", "aa a aaa", "aaaaaaa bbbbbbb", "bbb bb b"] * 3)], "doc_id long, text string")
    got, counts = alignment.align(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, want_counts = brute(rows)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(want_counts)


def test_empty_table(spark):
    got, counts = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and counts.count() == 0
    got, _ = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert got.agg(F.sum("n_a"), F.max("groups_sha256")).first() == (0, "") and got.count() == 2


def test_query_on_the_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(25).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute([(d, t[:1500]) for d, t in rows])
    got, _ = alignment.align(docs.withColumn("text", F.substring("text", 1, 1500)))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)


def test_ids_are_those_of_the_tokenizers_library(spark, sf):
    """All documents, and random strings of all kinds of characters."""
    random.seed(5)
    odd = [" ", "\n", "\t", "\r", "\x85", "\xa0", "\x1c", "　", "​", "’", "'s", "٣", "²", "é", "中", "😀", "ẞ", "a", "B", "1", "_", "<|endoftext|>"]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    texts += ["".join(random.choice(odd) for _ in range(random.randint(1, 12))) for _ in range(5000)]
    texts += ["".join(chr(random.choice((random.randrange(1, 0xD800), random.randrange(0x10000, 0x1FBFF), 32))) for _ in range(8)) for _ in range(3000)]
    for special in (False, True):
        tokenizer = Tokenizer.from_file(BYTE_BPE)
        tokenizer.encode_special_tokens = not special
        ours = byte_bpe(BYTE_BPE, special)
        assert all(ours.encode(t).tolist() == e.ids for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)))
