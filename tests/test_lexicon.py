"""The lexicon automaton against a plain loop over tokens, and the status of a failing scorer."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.operators import sentiment

LEXICON = {"good": 1.9, "bad": -2.5, "fine": 0.8, "flat": 0.0}
RULES = [("not", "negation", -0.74), ("never", "negation", -0.74), ("very", "booster", 0.293), ("barely", "booster", -0.293), ("but", "contrast", 1.5), ("good", "booster", 0.1)]


def plain(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    of = {k: {t: w for t, kind, w in RULES if kind == k} for k in ("negation", "booster", "contrast")}
    turn = next(((i, of["contrast"][t]) for i, t in enumerate(words) if t in of["contrast"]), None)
    total = 0.0
    for i, t in enumerate(words):
        v = LEXICON.get(t, 0.0)
        if not v:
            continue
        before = [(words[i - d], r) for d, r in ((1, 1.0), (2, 0.95), (3, 0.9)) if i >= d]
        v += math.copysign(1, v) * sum(of["booster"].get(w, 0.0) * r for w, r in before)
        for w, _ in before:
            v *= of["negation"].get(w, 1.0)
        if turn:
            v *= 2 - turn[1] if i < turn[0] else turn[1] if i > turn[0] else 1.0
        total += v
    return total / math.sqrt(total * total + 15)


def test_against_a_plain_loop(spark):
    random.seed(3)
    words = [*LEXICON, *(t for t, _, _ in RULES), "x", "y", "Good!", "été"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 14))) for _ in range(300)]
    texts += [None, "", "not", "but good", "good but", "not very good, but barely bad", "good " * 5000]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "ArticleId long, Text string, valence double")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    rules = spark.createDataFrame(RULES, "token string, kind string, weight double")
    got = {r.ArticleId: r.Score for r in sentiment.lexicon_scored(docs, lexicon, rules).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t), abs=1e-12), t
    assert sentiment.lexicon_scored(docs.limit(0), lexicon, rules).count() == 0
    none = sentiment.lexicon_scored(docs, lexicon, rules.limit(0)).where("ArticleId = 303").head()
    assert none.Score == pytest.approx(1.9 / math.sqrt(1.9 ** 2 + 15))


def test_failures_are_marked(spark):
    def fragile(part):
        if "boom" in part:
            raise RuntimeError("no")
        return [1.0] * len(part)

    df = spark.createDataFrame([("a",), ("b",), ("boom",), ("c",), (None,)], "t string").coalesce(1)
    got = [tuple(r[0]) for r in df.select(sentiment.scored_batches(fragile, 2)(F.col("t"))).collect()]
    assert got == [(1.0, True), (1.0, True), (0.0, False), (0.0, False), (1.0, True)]


def test_tokens_meet_a_small_lexicon_without_a_shuffle(spark):
    """What is shuffled is a partial sum per text, not the tokens."""
    docs = spark.createDataFrame([(1, "good but bad")], "ArticleId long, Text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    rules = spark.createDataFrame(RULES, "token string, kind string, weight double")
    plan = sentiment.lexicon_scored(docs, lexicon, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ArticleId") == 1 and "SortMergeJoin" not in plan


def test_large_lexicons_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good but bad"), (2, "x"), (3, None)], "ArticleId long, Text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    rules = spark.createDataFrame(RULES, "token string, kind string, weight double")
    monkeypatch.setattr(sentiment, "BROADCAST_ROWS", 2)
    got = {r["ArticleId"]: r["Score"] for r in sentiment.lexicon_scored(docs, lexicon, rules).collect()}
    assert got == {1: pytest.approx(plain("good but bad")), 2: 0.0, 3: 0.0}
