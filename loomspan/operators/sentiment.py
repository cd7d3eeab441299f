"""News to sessions, text scores and their daily aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import SentimentConfig
from loomspan.functions.expr import div
from loomspan.functions.text import clean_text, concat_text, mood_label, tokens
from loomspan.session import materialise

# Sign of each classifier label; any other label counts 0.
LABEL_SIGN = {
    "positive": 1.0, "neutral": 0.0, "negative": -1.0,
    "LABEL_0": -1.0, "LABEL_1": 0.0, "LABEL_2": 1.0,
}
# Fixed value: normalisation constant of the lexicon score.
LEXICON_ALPHA = 15.0

BROADCAST_ROWS = 1_000_000


def day_map(calendar: DataFrame) -> DataFrame:
    """(Day, Here, Next) for each civil day of the calendar: the session on or after it and the one after that.

    One row per civil day between the first and last session, so it is safe to broadcast.
    """
    span = calendar.agg(F.min("Date").alias("lo"), F.max("Date").alias("hi"), F.count("*").alias("n"))
    checked = span.select(
        F.when(F.col("n") == 0, F.raise_error(F.lit("trading calendar is empty"))).otherwise(F.col("lo")).alias("lo"), "hi")
    days = checked.select(F.explode(F.sequence("lo", "hi")).alias("Day"))
    marked = days.join(calendar.select(F.col("Date").alias("Session")), F.col("Day") == F.col("Session"), "left")
    order = Window.partitionBy(F.lit(1)).orderBy("Day")
    here = F.first("Session", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    later = F.first("Session", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return marked.select("Day", here.alias("Here"), F.when(F.col("Session").isNotNull(), later).otherwise(here).alias("Next"))


def map_to_session(news: DataFrame, calendar: DataFrame, close_hour: int = 16) -> DataFrame:
    """Adds Date: the session an article can inform.

    Before the close of a session its own day, from the close on the next session; on any other day the
    next session; before the calendar the first and past its end the last session. An equi-join on the civil
    day with a broadcast day table replaces a search per article.
    """
    lo = calendar.agg(F.min("Date").alias("d")).scalar()
    hi = calendar.agg(F.max("Date").alias("d")).scalar()
    day = F.to_date("Timestamp")
    joined = news.withColumn("Day", day).join(F.broadcast(day_map(calendar)), "Day", "left")
    target = F.when(F.hour("Timestamp") >= close_hour, F.col("Next")).otherwise(F.col("Here"))
    return joined.withColumn(
        "Date", F.when(F.col("Day") < lo, lo).otherwise(F.coalesce(target, hi))).drop("Day", "Here", "Next")


def article_texts(news: DataFrame) -> DataFrame:
    """Adds Text (headline and summary joined, cleaned); articles without any text are dropped.

    A filter on a computed column is pushed below it, which would clean every text twice; as the output of a
    generator the text is computed once.
    """
    cleaned = clean_text(concat_text(F.col("Headline"), F.col("Summary")))
    kept = F.filter(F.array(cleaned), lambda t: F.length(t) > 0)
    return news.select("*", F.explode_outer(kept).alias("Text")).where(F.col("Text").isNotNull())


def lexicon_polarity(news: DataFrame, lexicon: DataFrame, key: str = "ArticleId", text: str = "Text") -> DataFrame:
    """(key, Sentiment_VADER): valence sum s over the tokens of the whole text -> s / sqrt(s^2 + 15).

    Tokens are exploded next to their key only, matched with the lexicon, and summed with a map-side part, so
    what is shuffled is one partial sum per text. The lexicon is broadcast behind a check of its size;
    a larger one is joined by shuffle on pre-counted (key, token) pairs.
    """
    small = lexicon.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = news.select(key, F.explode_outer(tokens(F.col(text))).alias("token"))
    if small:
        matched = words.join(F.broadcast(lexicon), "token", "left")
        total = F.sum(F.coalesce("valence", F.lit(0.0)))
    else:
        matched = words.groupBy(key, "token").agg(F.count("*").alias("_c")).join(lexicon, "token", "left")
        total = F.sum(F.coalesce("valence", F.lit(0.0)) * F.col("_c"))
    s = F.col("_s")
    return matched.groupBy(key).agg(total.alias("_s")).select(
        key, (s / F.sqrt(s * s + LEXICON_ALPHA)).alias("Sentiment_VADER"))


RULES_LIMIT = 10_000


def lexicon_scored(news: DataFrame, lexicon: DataFrame, rules: DataFrame, key: str = "ArticleId", text: str = "Text",
                   reach: tuple[float, ...] = (1.0, 0.95, 0.9)) -> DataFrame:
    """(key, Score): lexicon score with negation, boosters and contrast, as an automaton over the tokens of a text.

    `rules` has (token, kind, weight), kind one of negation, booster, contrast. A valence is raised by the weights of boosters
    among the len(reach) tokens before it, each times the reach of its distance and away from zero, then multiplied by the weight
    of every negation among them. Behind the first contrast token of a text valences count its weight times, before it
    2 - weight times. The sum s gives s / sqrt(s^2 + 15); no token of the lexicon gives 0.

    The rules are a small table (RULES_LIMIT rows at most, else an error) and become sets inside the expression. What a token's
    neighbours do to it is worked out on the arrays of a text, so tokens are exploded once, with two numbers, and matched with the
    lexicon. That is written once and broadcast behind a check of its size, so one partial sum per text is shuffled; for a larger
    one tokens are counted per key first, so a hot token is a row per text.
    """
    lexicon = materialise(lexicon.select("token", "valence"), "lexicon")
    small = lexicon.count() <= BROADCAST_ROWS
    known = rules.limit(RULES_LIMIT + 1).collect()
    if len(known) > RULES_LIMIT:
        raise ValueError(f"more than {RULES_LIMIT} rules")
    of = {kind: {r["token"]: float(r["weight"]) for r in known if r["kind"] == kind} for kind in ("negation", "booster", "contrast")}

    def weight(kind: str, t: Column, other: float) -> Column:
        by: dict[float, list[str]] = {}
        for token, w in of[kind].items():
            by.setdefault(w, []).append(token)
        out = F.lit(other)
        for w, some in sorted(by.items()):
            out = F.when(t.isin(some), w).otherwise(out)
        return out

    n = len(reach)
    words = news.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_t"))
    marked = words.withColumns({
        "_no": F.transform("_t", lambda t: weight("negation", t, 1.0)),
        "_up": F.transform("_t", lambda t: weight("booster", t, 0.0)),
        "_turn": F.transform("_t", lambda t: weight("contrast", t, 0.0)),
    })
    first = F.array_position(F.transform("_turn", lambda w: w > 0), True)  # 1-based, 0 without any
    turn = marked.withColumn("_at", first).withColumn("_w", F.when(F.col("_at") > 0, F.get("_turn", (F.col("_at") - 1).cast("int"))))

    def neighbours(t: Column, i: Column) -> Column:
        no, up = F.lit(1.0), F.lit(0.0)
        for d, r in enumerate(reach, 1):
            no = no * F.when(i >= d, F.get("_no", i - d)).otherwise(1.0)
            up = up + F.when(i >= d, F.get("_up", i - d) * r).otherwise(0.0)
        side = F.when(F.col("_w").isNull(), 1.0).when(i + 1 < F.col("_at"), 2.0 - F.col("_w")).when(i + 1 > F.col("_at"), F.col("_w")).otherwise(1.0)
        return F.struct(t.alias("token"), (no * side).alias("times"), up.alias("up"))

    rows = turn.select(key, F.explode_outer(F.transform("_t", neighbours)).alias("_x"))
    if small:
        matched = rows.select(key, "_x.*", F.lit(1).alias("_c")).join(F.broadcast(lexicon), "token", "left")
    else:
        matched = rows.groupBy(key, "_x").agg(F.count("*").alias("_c")).select(key, "_x.*", "_c").join(lexicon, "token", "left")
    value = F.when(F.col("valence") != 0, (F.col("valence") + F.signum("valence") * F.col("up")) * F.col("times") * F.col("_c"))
    s = F.col("_s")
    return matched.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_s")).select(key, (s / F.sqrt(s * s + LEXICON_ALPHA)).alias("Score"))


def label_polarity(label: Column, score: Column) -> Column:
    """Sign of the label times its score; unknown or missing labels count 0."""
    sign = F.create_map(*[F.lit(x) for kv in LABEL_SIGN.items() for x in kv])
    return F.coalesce(F.try_element_at(sign, F.coalesce(label, F.lit(""))), F.lit(0.0)) * F.coalesce(score, F.lit(0.0))


def scored_batches(score: Callable[[list[str]], list[float]], batch_size: int = 32):
    """Column function around a user's batch scorer: a struct of the score and whether it could be given.

    Texts go to the scorer in batches of at most batch_size; a batch on which it raises scores 0 and has scored = false, so failures
    can be counted (F.count_if(~column.scored)).
    """
    def attempt(part: list[str]) -> tuple[list[float], bool]:
        try:
            return [float(v) for v in score(part)], True
        except Exception:  # noqa: BLE001 - whatever the user's scorer raises; the rows say so
            return [0.0] * len(part), False

    @F.pandas_udf("score double, scored boolean")
    def scored(texts: pd.Series) -> pd.DataFrame:
        values = texts.fillna("").tolist()
        parts = [attempt(values[i:i + batch_size]) for i in range(0, len(values), batch_size)]
        return pd.DataFrame({"score": [v for given, _ in parts for v in given], "scored": [fine for given, fine in parts for _ in given]})

    return scored


def batch_scorer(score: Callable[[list[str]], list[float]], batch_size: int = 32) -> Callable[[Column], Column]:
    """The score alone of scored_batches; a failing batch scores 0."""
    scored = scored_batches(score, batch_size)
    return lambda text: scored(text)["score"]


def aggregate_daily(scored: DataFrame, cfg: SentimentConfig = SentimentConfig()) -> DataFrame:
    """(Date, Ticker): mean scores, volume, momentum over news days, average volume and spike.

    The group aggregate has a map-side part (a hot (Date, Ticker) collapses first); the windows run over
    news days of a series, bounded by the calendar.
    """
    daily = scored.groupBy("Date", "Ticker").agg(
        F.avg("Sentiment_FinBERT").alias("Sentiment_FinBERT"),
        F.avg("Sentiment_VADER").alias("Sentiment_VADER"),
        F.count("Text").alias("News_Volume"))
    order = Window.partitionBy("Ticker").orderBy("Date")
    vol_avg = F.avg("News_Volume").over(order.rowsBetween(-(cfg.volume_window - 1), 0))
    return daily.withColumns({
        "Sentiment_3d_Mom": F.avg("Sentiment_FinBERT").over(order.rowsBetween(-(cfg.momentum_window - 1), 0)),
        "Vol_Avg": vol_avg,
    }).withColumn("News_Spike", F.coalesce(div(F.col("News_Volume"), F.col("Vol_Avg")), F.lit(1.0)))


def market_mood(daily: DataFrame, cfg: SentimentConfig = SentimentConfig()) -> DataFrame:
    return daily.groupBy("Date").agg(
        F.avg("Sentiment_FinBERT").alias("Mean_Sentiment"), F.sum("News_Volume").alias("Article_Count"),
        F.countDistinct("Ticker").alias("Tickers_Covered"),
    ).withColumn("Market_Mood", mood_label(F.col("Mean_Sentiment"), cfg.bullish, cfg.bearish))


def coverage_stats(news: DataFrame) -> DataFrame:
    """Span and distinct news days, with min, median and max of distinct times per series."""
    per = news.groupBy("Ticker").agg(F.countDistinct("Timestamp").alias("k"))
    spread = per.agg(F.min("k").alias("min_times"), F.percentile("k", 0.5).alias("median_times"),
                     F.max("k").alias("max_times"))
    whole = news.agg(F.min("Timestamp").alias("first_time"), F.max("Timestamp").alias("last_time"),
                     F.countDistinct(F.to_date("Timestamp")).alias("news_days"))
    return whole.withColumns({c: spread.select(c).scalar() for c in spread.columns})


def coverage_gap(universe: DataFrame, news: DataFrame) -> DataFrame:
    """Universe names without any article."""
    return universe.join(news.select("Ticker"), "Ticker", "left_anti")
