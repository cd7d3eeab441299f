"""Toxicity: restoration of disguised words, held-out accuracy, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.log_model(toxicity.trigram_counts(docs))
    return docs, labels, model, toxicity.fit(docs, labels, model)


def test_trigram_counts(spark):
    docs = spark.createDataFrame([("ab",), ("AB",), (None,), ("",)], "text string")
    counts = toxicity.trigram_counts(docs)
    a, b = toxicity.SYMBOL_OF["a"], toxicity.SYMBOL_OF["b"]
    assert counts.sum() == 4 and counts[(0 * toxicity.SIZE + a) * toxicity.SIZE + b] == 2


def test_restores_disguises(learned):
    restorer = toxicity.Restorer(learned[2])
    for disguised, plain in {"1d10t": "idiot", "tr@sh": "trash", "i d i o t": "idiot", "s.t.u.p.i.d": "stupid", "$tup1d": "stupid",
                             "idiooooot": "idiot", "p@th3t1c": "pathetic", "l0$er": "loser"}.items():
        assert plain in restorer.restore(f"of the {disguised} and that").split(), disguised
    for text in ("173.33.203.46 +1 (980) 555-6268", "the and of that", ""):
        assert restorer.restore(text) == text


def test_restores_whatever_the_length_and_share_of_letters(learned):
    restorer = toxicity.Restorer(learned[2])
    for disguised, plain in {"57up1d": "stupid", "7r45h": "trash", "p47h371c": "pathetic", "l053r": "loser", "455h0l3": "asshole", "1 d 1 0 t": "idiot",
                             "st*p*d": "stupid", "i.d.i.0.t": "idiot", "idi" + "o" * 100 + "t": "idiot"}.items():
        assert plain in restorer.restore(f"of the {disguised} and that").split(), disguised
    assert "***" not in restorer.restore("of onor*** f*** and")
    spaced = "  ".join(" ".join(w) for w in "that pathetic loser said the other stupid idiot was here and that".split())
    assert len(spaced) > 72 and {"loser", "idiot", "pathetic", "stupid"} <= set(restorer.restore(spaced).split())
    long = restorer.restore("i" * 30 + "d" * 30 + "i" * 30 + "o" * 30 + "t" * 30)
    assert len(long) <= 10
    for text in ("12:30 $1,000.50 (2024-01-05) 1 2 3 4 *****", "a" + " a" * 5000):
        assert len(restorer.restore(text)) == len(text)


def test_array_steps_find_the_same_paths(learned, monkeypatch):
    for token in ("f***", "id**t", "*b*o1*0", "a**", "x$*.*-o", "****o", "s**t h*r*"):
        found = toxicity.decode(token, learned[2])
        with monkeypatch.context() as m:
            m.setattr(toxicity, "WIDE", 1 << 60)
            assert toxicity.decode(token, learned[2]) == found, token


def test_held_out_accuracy(learned):
    docs, labels, model, scorer = learned
    rows = toxicity.score(docs, model, scorer).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").toPandas()
    assert (rows.toxic == rows.predicted).mean() >= 0.97
    assert rows[rows.toxic == 1].predicted.mean() >= 0.85 and rows[rows.toxic == 0].predicted.mean() <= 0.01
    assert rows.score.between(0, 1).all()


def test_held_out_labels_are_not_used(learned):
    docs, labels, model, _ = learned
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scorer = toxicity.fit(docs, labels.where(held), model)
    assert scorer.weights == {}


def test_odd_rows(spark, learned):
    _, _, model, scorer = learned
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "", 2.0), (None, "idiot " * 30_000, None), (4, "*" * 5000 + " " + "a " * 4000, 0.0)],
                                 "doc_id long, text string, score double")
    rows = toxicity.score(docs, model, scorer).collect()
    assert len(rows) == 5 and {r.predicted for r in rows if r.doc_id in (1, 2, 4)} == {0}
    assert [r.predicted for r in rows if r.doc_id is None] == [1]
    assert toxicity.score(docs.limit(0), model, scorer).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), model)
    assert none.weights == {} and np.isclose(none.score("x"), 0.5, atol=0.5)
