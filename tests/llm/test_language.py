"""Language identification: held-out accuracy, odd texts, empty input."""

import random

from pyspark.sql import functions as F

from loomspan.llm import language
from loomspan.llm.common import is_held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    assert found.where("rejected").count() == 0
    for text in (None, "", "  \n", "123 !!", "...", "²"):
        assert model.predict(text) == ("und", 0.0, True)
    for text in ("北京是中华人民共和国的首都", "Привет как дела сегодня вечером"):
        assert model.predict(text)[2]
    assert 0 <= model.predict("the and of " * 50_000)[1] <= 1

    odd = spark.createDataFrame(
        [(1, None, "x", 1.0), (1, None, "x", 1.0), (None, "the and of that the", None, 2.0), (3, "", "en", None)],
        "doc_id long, text string, lang string, score double")
    rows = sorted(language.identify(odd, model).collect(), key=str)
    assert len(rows) == 4 and sum(r.lang_pred == "und" for r in rows) == 3
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [None]


def test_learns_only_from_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(is_held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert "zz" not in language.fit(spoiled).languages


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert language.identify(empty, model).count() == 0
    assert model.predict("some words") == ("und", 0.0, True)


def test_rejects_long_texts_of_other_languages_and_gibberish(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dutch = ("De snelle bruine vos springt over de luie hond en gaat daarna naar huis om te slapen. Het regende de hele dag, maar niemand "
             "wilde binnen blijven omdat het feest buiten was. Wij hebben gisteren een nieuw boek gekocht bij de winkel aan de overkant.")
    italian = ("La mattina presto il vecchio pescatore usciva con la sua barca e tornava soltanto quando il sole era alto. Nella piazza del "
               "paese i bambini giocavano a pallone mentre le nonne parlavano sedute davanti alle case.")
    random.seed(3)
    gibberish = [" ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(n)) for n in (20, 100, 2000)]
    # one text of two letters must not lower the bar of the others
    short = spark.createDataFrame([(i, "De.", "fr") for i in range(10**6, 10**6 + 5)], "doc_id long, text string, lang string")
    for model in (language.fit(docs), language.fit(docs.select("doc_id", "text", "lang").unionByName(short))):
        for text in (dutch, dutch * 5, italian, italian * 5, *gibberish):
            assert model.predict(text)[2], text[:60]
        found = language.identify(docs, model)
        assert found.where("rejected").count() <= 0.005 * found.count()
