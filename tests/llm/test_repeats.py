"""Word and byte repeats against brute force on small windows, with odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import byte_repeats, windows, word_repeats


def brute(sequences, window, join):
    seen = Counter(join(s[i:i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if seen[join(s[i:i + window])] > 1:
                gone[i:i + window] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((len(s), int(gone.sum()), spans, hashlib.sha256(join([s[i] for i in np.flatnonzero(~gone)])).hexdigest()))
    return out


def corpus():
    random.seed(8)
    words = [f"w{i}" for i in range(25)] + ["é", "the"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 60))) for _ in range(60)]
    passage = " ".join(random.choice(words) for _ in range(30))
    texts += [f"{texts[i]} {passage} {texts[i + 1]}" for i in range(15)]
    texts += [texts[3]] * 4 + ["of " * 50, "of the " * 30, "\t a\x0b b \r\n", " ".join(f"x{i}" for i in range(4000)), passage]
    return texts


@pytest.mark.parametrize("window,lengths", [(6, (2, 4, 6)), (7, (7,)), (12, (3, 6, 12))])
def test_words(spark, window, lengths):
    texts = corpus()
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(900, None, 0), (901, "", 0), (902, " ", 0), (3, texts[3], 0), (None, passage := texts[-1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = word_repeats.remove_word_repeats(docs, window, lengths).collect()
    want = brute([(t or "").encode().split() for _, t, _ in rows], window, b" ".join)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(d), n, x, h) for (d, _, _), (n, x, _, h) in zip(rows, want))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got) and passage


@pytest.mark.parametrize("window,lengths", [(20, (5, 10, 15, 20)), (33, (8, 16, 33))])
def test_bytes(spark, window, lengths):
    texts = corpus()
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(900, None, 0), (901, "", 0), (3, texts[3], 0), (None, texts[5], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = byte_repeats.remove_byte_repeats(docs, window, lengths).collect()
    want = brute([(t or "").encode() for _, t, _ in rows], window, bytes)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(d), n, x, s, h) for (d, _, _), (n, x, s, h) in zip(rows, want))


def test_characters_of_many_bytes_and_groups_of_copies(spark):
    """Passages that begin and end inside characters, passages just under and over the window, and groups of hundreds of copies."""
    random.seed(3)
    letters = "aé東😀 "

    def text(n):
        return "".join(random.choice(letters) for _ in range(n))

    passages = [text(n) for n in (6, 8, 9, 12, 40)]
    texts = [text(random.randint(0, 30)) + p + text(random.randint(0, 30)) for p in passages for _ in range(4)]
    texts += ["€" + "é東" * 9, "¢" + "é東" * 9, "©東" * 12, "ê東" * 12]  # equal last bytes of unequal characters
    texts += [texts[0]] * 300 + [texts[-1] + "x"] * 200
    docs = spark.createDataFrame([(i % 250, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = byte_repeats.remove_byte_repeats(docs, 24, (6, 12, 18, 24)).collect()
    want = Counter((i % 250, *w) for i, w in enumerate(brute([t.encode() for t in texts], 24, bytes)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_many_equal_rows(spark):
    """Rows equal in id and text share a name; the work grows with their number, not with its square."""
    line = " ".join(f"w{i}" for i in range(400))
    docs = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", f"'{line}' AS text").union(
        spark.createDataFrame([(1, line + " end"), (2, "other words")], "doc_id long, text string"))
    found = word_repeats.remove_word_repeats(docs, digest_only=True).groupBy("n_words", "n_removed").count().collect()
    assert sorted(tuple(r) for r in found) == [(2, 0, 1), (400, 400, 20_000), (401, 400, 1)]
    found = byte_repeats.remove_byte_repeats(docs, digest_only=True).groupBy("n_removed").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 1), (len(line), 20_001)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert word_repeats.remove_word_repeats(empty).count() == 0
    assert byte_repeats.remove_byte_repeats(empty).count() == 0


def test_names_and_anchors():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 3, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for length in (1, 2, 3, 5, 8, 13):
        found = windows.names(s, length)
        assert len(found) == len(s) - length + 1
        groups = {}
        for i in range(len(found)):
            groups.setdefault(s[i:i + length].tobytes(), set()).add(int(found[i]))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    values = rng.integers(0, 9, 300).astype(np.uint64)
    for width in (1, 2, 3, 7, 20):
        assert (windows.window_argmin(values, width) == [i + int(np.argmin(values[i:i + width])) for i in range(300 - width + 1)]).all()
    lengths = np.array([0, 5, 100, 3, 200, 192])
    sequence, at, count, _, _ = windows.anchored_runs(s, lengths, 6, 2)
    covered = Counter((int(q), int(a) + k) for q, a, n in zip(sequence, at, count) for k in range(n))
    assert covered == Counter((q, i) for q, n in enumerate(lengths) for i in range(max(0, n - 5)))
