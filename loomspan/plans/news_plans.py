"""Registered queries: text, sessions, daily sentiment and the streaming forms."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import ABBREVIATIONS, clean_text, concat_text
from loomspan.operators import sentiment
from loomspan.plans.cleaning_plans import KEYS, news_chunks
from loomspan.plans.registry import NEWS, NEWS_CAL, g, gcols, publish, query
from loomspan.session import run_dir
from loomspan.sources import fixtures as fx
from loomspan.sources.readers import table
from loomspan.sources.sinks import write_json
from loomspan.streaming import streams

# SQL side of the text cleaning: words are wrapped in two marker characters, so that a word boundary of
# any alphabet becomes a plain character of the pattern.
OPEN, SHUT = "\ue000", "\ue001"
WORD = r"[\p{L}\p{N}\p{M}_]"
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def _sub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"


def _clean_ctes(src: str, text: str) -> str:
    steps = [f"ct0 AS (SELECT *, {_sub(_sub(f'coalesce({text}, chr(32))', '<[^>]+>', ' '), f'https?://[^{BLANK[1:-1]}]+|www\\.[^{BLANK[1:-1]}]+', ' ')} AS t FROM {src})"]
    symbol = r"[$]([A-Z]{1,5})($|[^\p{L}\p{N}\p{M}_])"
    steps.append(f"ct1 AS (SELECT * EXCLUDE (t), {_sub(_sub('t', symbol, chr(92) + '1' + chr(92) + '2'), symbol, chr(92) + '1' + chr(92) + '2')} AS t FROM ct0)")
    steps.append(f"ct2 AS (SELECT * EXCLUDE (t), {_sub('lower(t)', f'({WORD}+)', OPEN + chr(92) + '1' + SHUT)} AS t FROM ct1)")
    n = 2
    for pattern, replacement in ABBREVIATIONS:
        body = pattern.removeprefix(r"\b").removesuffix(r"\b")
        dotted = body.endswith(r"\.?")
        body = body.removesuffix(r"\.?").replace(r"\d", r"\p{Nd}")
        expr = "t"
        if dotted:
            expr = _sub(expr, OPEN + body + SHUT + r"\." + OPEN, OPEN + replacement)
        marked = re.sub(r"([^ /]+)", OPEN + r"\1" + SHUT, body) if body in ("earnings y/y", "q/q", "y/y") else OPEN + body + SHUT
        expr = _sub(expr, marked, re.sub(r"([^ ]+)", lambda m: OPEN + m.group(1) + SHUT, replacement))
        n += 1
        steps.append(f"ct{n} AS (SELECT * EXCLUDE (t), {expr} AS t FROM ct{n - 1})")
    steps.append(f"cleaned AS (SELECT * EXCLUDE (t), trim({_sub(_sub('t', f'[{OPEN}{SHUT}]', ''), BLANK + '+', ' ')}) AS Text FROM ct{n})")
    return ", ".join(steps)


JOINED = "trim(concat(coalesce(Headline, ''), '. ', coalesce(Summary, '')))"
NEWS_TEXT = f"WITH {NEWS}, {_clean_ctes('fx_news', JOINED)}, articles AS (SELECT * FROM cleaned WHERE length(Text) > 0)"


@query("clean_text", NEWS_TEXT + " SELECT ArticleId, Text FROM cleaned")
def _(spark, sf):
    return fx.news(spark, sf).select("ArticleId", clean_text(concat_text(F.col("Headline"), F.col("Summary"))).alias("Text"))


@query("clean_pages", f"WITH {_clean_ctes('pages', 'html')} SELECT page_id, Text FROM cleaned")
def _(spark, sf):
    """The same cleaning over raw web pages, where the markup matters."""
    return table(spark, sf, "pages").select("page_id", clean_text(F.col("html")).alias("Text"))


LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', CAST('{v}' AS DOUBLE))" for t, v in fx.LEXICON) + ") l(token, valence))"
POLARITY = LEX + r""", tk AS (SELECT ArticleId, unnest(regexp_extract_all(lower(Text), '[\p{L}\p{N}]+')) AS token FROM articles),
 lx AS (SELECT a.ArticleId, coalesce(sum(valence), 0) AS s FROM articles a LEFT JOIN tk ON tk.ArticleId = a.ArticleId LEFT JOIN lex ON lex.token = tk.token GROUP BY a.ArticleId),
 vd AS (SELECT ArticleId, s / sqrt(s * s + 15) AS Sentiment_VADER FROM lx)"""
LABELLED = """lb AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS Label FROM labels),
 fb AS (SELECT ArticleId, CASE lb.Label WHEN 'positive' THEN 1e0 WHEN 'negative' THEN -1e0 ELSE 0e0 END * (n_chars / (n_chars + 5e2)) AS Sentiment_FinBERT
  FROM fx_news LEFT JOIN lb ON lb.doc_id = ArticleId)"""


def articles(spark, sf):
    return sentiment.article_texts(fx.labelled_news(spark, sf))


@query("lexicon_polarity", f"{NEWS_TEXT}, {POLARITY} SELECT ArticleId, {g('Sentiment_VADER')} AS Sentiment_VADER FROM vd")
def _(spark, sf):
    return publish(sentiment.lexicon_polarity(articles(spark, sf), fx.lexicon(spark)), ["ArticleId"], ["Sentiment_VADER"])


RULE_SQL = "ru AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}', CAST('{w}' AS DOUBLE))" for t, k, w in fx.RULES) + ") l(token, kind, weight))"
LEARNED = r"""le AS (SELECT token, 2 * ln((sum(quality) + 1e0) / (sum(toxic) + 1e0)) AS valence
 FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) JOIN labels USING (doc_id) GROUP BY token HAVING count(*) >= 3)"""


@query("lexicon_scored", NEWS_TEXT + f", {RULE_SQL}, {LEARNED}, " + r"""t0 AS (SELECT ArticleId, regexp_extract_all(lower(Text), '[\p{L}\p{N}]+') AS w FROM articles),
 t1 AS (SELECT ArticleId, unnest(w) AS token, unnest(generate_series(1, len(w))) AS i FROM t0),
 t2 AS (SELECT t1.*, coalesce(n.weight, 1) AS no, coalesce(b.weight, 0) AS up, c.weight AS turn FROM t1 LEFT JOIN ru n ON n.token = t1.token AND n.kind = 'negation'
  LEFT JOIN ru b ON b.token = t1.token AND b.kind = 'booster' LEFT JOIN ru c ON c.token = t1.token AND c.kind = 'contrast'),
 t3 AS (SELECT ArticleId, i, token, lag(no, 1, 1) OVER w * lag(no, 2, 1) OVER w * lag(no, 3, 1) OVER w AS no,
  lag(up, 1, 0) OVER w + 95e-2 * lag(up, 2, 0) OVER w + 9e-1 * lag(up, 3, 0) OVER w AS up FROM t2 WINDOW w AS (PARTITION BY ArticleId ORDER BY i)),
 ct AS (SELECT ArticleId, min(i) AS ta, arg_min(turn, i) AS tw FROM t2 WHERE turn IS NOT NULL GROUP BY ArticleId),
 sm AS (SELECT t3.ArticleId, sum((valence + sign(valence) * up) * no * CASE WHEN ta IS NULL OR i = ta THEN 1 WHEN i < ta THEN 2 - tw ELSE tw END) AS s
  FROM t3 JOIN le ON le.token = t3.token AND valence <> 0 LEFT JOIN ct ON ct.ArticleId = t3.ArticleId GROUP BY t3.ArticleId)""" + f"""
 SELECT a.ArticleId, {g('coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15)')} AS Score FROM (SELECT DISTINCT ArticleId FROM articles) a LEFT JOIN sm ON sm.ArticleId = a.ArticleId""")
def _(spark, sf):
    return publish(sentiment.lexicon_scored(articles(spark, sf), fx.learned_lexicon(spark, sf), fx.rules(spark)), ["ArticleId"], ["Score"])


def lexicon_scorer(texts: list[str]) -> list[float]:
    """Stand-in for a user's batch scorer: the lexicon score of each text."""
    valence = dict(fx.LEXICON)
    sums = [sum(valence.get(t, 0.0) for t in re.findall(r"[^\W_]+", x.lower())) for x in texts]
    return [s / (s * s + sentiment.LEXICON_ALPHA) ** 0.5 for s in sums]


@query("batch_scorer", f"{NEWS_TEXT}, {POLARITY} SELECT ArticleId, {g('Sentiment_VADER')} AS Score FROM vd")
def _(spark, sf):
    score = sentiment.batch_scorer(lexicon_scorer)
    return publish(articles(spark, sf).select("ArticleId", score(F.col("Text")).alias("Score")), ["ArticleId"], ["Score"])


@query("label_polarity", f"WITH {NEWS}, {LABELLED} SELECT ArticleId, {g('Sentiment_FinBERT')} AS Sentiment_FinBERT FROM fb")
def _(spark, sf):
    p = sentiment.label_polarity(F.col("Label"), F.col("Confidence"))
    return publish(fx.labelled_news(spark, sf).select("ArticleId", p.alias("Sentiment_FinBERT")), ["ArticleId"], ["Sentiment_FinBERT"])


EVENT_SESSIONS = f"""sess AS (SELECT event_id, event_type AS Ticker, value, ts, after, CASE WHEN after AND d = on_day THEN nxt ELSE on_day END AS raw_session
 FROM (SELECT e.*, CAST(ts AS DATE) AS d, hour(ts) >= 16 AS after, (SELECT min(Date) FROM fx_cal WHERE Date >= CAST(e.ts AS DATE)) AS on_day,
  (SELECT min(Date) FROM fx_cal WHERE Date > CAST(e.ts AS DATE)) AS nxt FROM events e) x),
 es AS (SELECT event_id, Ticker, value, ts, coalesce(raw_session, (SELECT max(Date) FROM fx_cal)) AS Date FROM sess)"""


@query("session_map", f"WITH {NEWS_CAL}, {EVENT_SESSIONS} SELECT event_id, Ticker, Date FROM es")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("Ticker"), F.col("ts").alias("Timestamp"))
    return sentiment.map_to_session(ev, fx.news_calendar(spark, sf)).select("event_id", "Ticker", "Date")


DAILY_SQL = f"""{NEWS_TEXT}, {NEWS_CAL}, {EVENT_SESSIONS}, {POLARITY}, {LABELLED},
 dy AS (SELECT es.Date, es.Ticker, avg(fb.Sentiment_FinBERT) AS Sentiment_FinBERT, avg(vd.Sentiment_VADER) AS Sentiment_VADER, count(*) AS News_Volume
  FROM articles a JOIN fx_news f ON f.ArticleId = a.ArticleId JOIN es ON es.event_id = f.EventId JOIN vd ON vd.ArticleId = a.ArticleId JOIN fb ON fb.ArticleId = a.ArticleId GROUP BY 1, 2),
 dm AS (SELECT *, avg(Sentiment_FinBERT) OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS Sentiment_3d_Mom,
  avg(News_Volume) OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS Vol_Avg FROM dy)"""


def daily(spark, sf):
    """Articles -> text -> both scores -> session -> daily aggregates."""
    rows = articles(spark, sf).withColumn(
        "Sentiment_FinBERT", sentiment.label_polarity(F.col("Label"), F.col("Confidence")))
    scored = rows.join(sentiment.lexicon_polarity(rows, fx.lexicon(spark)), "ArticleId")
    placed = sentiment.map_to_session(scored, fx.news_calendar(spark, sf))
    return sentiment.aggregate_daily(placed)


@query("daily_sentiment", DAILY_SQL + f" SELECT Date, Ticker, News_Volume, {gcols(['Sentiment_FinBERT', 'Sentiment_VADER'])} FROM dy")
def _(spark, sf):
    return publish(daily(spark, sf), [*KEYS, "News_Volume"], ["Sentiment_FinBERT", "Sentiment_VADER"])


@query("sentiment_momentum", DAILY_SQL + f" SELECT Date, Ticker, {gcols(['Sentiment_3d_Mom', 'Vol_Avg'])}, {g('coalesce(News_Volume / nullif(Vol_Avg, 0), 1)')} AS News_Spike FROM dm")
def _(spark, sf):
    return publish(daily(spark, sf), KEYS, ["Sentiment_3d_Mom", "Vol_Avg", "News_Spike"])


@query("market_mood", DAILY_SQL + f""", mo AS (SELECT Date, avg(Sentiment_FinBERT) AS m, CAST(sum(News_Volume) AS BIGINT) AS Article_Count, count(DISTINCT Ticker) AS Tickers_Covered FROM dy GROUP BY Date)
 SELECT Date, {g('m')} AS Mean_Sentiment, Article_Count, Tickers_Covered, CASE WHEN m > 15e-2 THEN 'Bullish' WHEN m < -15e-2 THEN 'Bearish' ELSE 'Neutral' END AS Market_Mood FROM mo""")
def _(spark, sf):
    return publish(sentiment.market_mood(daily(spark, sf)), ["Date", "Article_Count", "Tickers_Covered", "Market_Mood"], ["Mean_Sentiment"])


@query("sentiment_join", DAILY_SQL + f""", eb AS (SELECT CAST(ts AS DATE) AS Date, event_type AS Ticker, arg_max(value, ts) AS Close FROM events GROUP BY 1, 2)
 SELECT eb.Date, eb.Ticker, {g('Close')} AS Close, {g('Sentiment_FinBERT')} AS Sentiment_FinBERT, {g('News_Volume')} AS News_Volume FROM eb LEFT JOIN dy ON dy.Date = eb.Date AND dy.Ticker = eb.Ticker""")
def _(spark, sf):
    out = fx.event_bars(spark, sf).join(daily(spark, sf).select(*KEYS, "Sentiment_FinBERT", "News_Volume"), KEYS, "left")
    return publish(out, KEYS, ["Close", "Sentiment_FinBERT", "News_Volume"])


@query("coverage_stats", f"""WITH {NEWS}, p AS (SELECT Ticker, count(DISTINCT Timestamp) AS k FROM fx_news GROUP BY Ticker)
 SELECT strftime(min(Timestamp), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(Timestamp), '%Y-%m-%d %H:%M:%S') AS last_time, count(DISTINCT CAST(Timestamp AS DATE)) AS news_days,
 (SELECT min(k) FROM p) AS min_times, (SELECT quantile_cont(k, 5e-1) FROM p) AS median_times, (SELECT max(k) FROM p) AS max_times FROM fx_news""")
def _(spark, sf):
    out = sentiment.coverage_stats(fx.news(spark, sf))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_time", "last_time")})


# streaming ---------------------------------------------------------------------------------------------------

@query("stream_news_ingest", f"""WITH {NEWS} SELECT DISTINCT Ticker, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') AS seen, trim(Headline) AS Headline
 FROM fx_news WHERE length(trim(Headline)) > 0""")
def _(spark, sf):
    """Every chunk file arrives twice; each article must come out once."""
    path = run_dir(spark, "stream-news-in")
    chunks = news_chunks(spark, sf)
    write_json(chunks.unionByName(chunks), path)
    out = streams.drain(streams.stream_news_ingest(spark, path), "stream-news")
    return out.select("Ticker", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("seen"), "Headline")


PARTS = 4


def event_stream(spark, sf):
    """The events in the order of their times as a stream, and what lets the quarters of their time span arrive one by one.

    Events without a time come with the last quarter, as their session is the last one.
    """
    events = table(spark, sf, "events")
    path = run_dir(spark, "stream-events-in")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(micros), F.max(micros)).first()
    width = (last - first) // PARTS + 1 if first is not None else 1
    part = F.coalesce(F.floor((micros - F.lit(first or 0)) / F.lit(width)), F.lit(PARTS - 1))

    parts = run_dir(spark, "stream-events-parts")
    events.withColumn("_part", part).write.partitionBy("_part").parquet(parts)  # one scan; an arrival reads its own folder

    def arrival(number):
        mine = spark.read.schema(T.StructType([*events.schema.fields, T.StructField("_part", T.LongType())])).parquet(parts)
        return lambda: mine.where(F.col("_part") == number).drop("_part").write.mode("append").parquet(path)

    events.limit(0).write.parquet(path)
    stream = streams.read_file_stream(spark, path, events.schema, None).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream, [arrival(number) for number in range(PARTS)]


@query("stream_session_sentiment", f"""WITH {NEWS_CAL}, {EVENT_SESSIONS} SELECT Date, Ticker, {g('avg(value)')} AS Sentiment, count(*) AS News_Volume FROM es GROUP BY Date, Ticker""")
def _(spark, sf):
    events, arrivals = event_stream(spark, sf)
    scored = events.select(F.col("event_type").alias("Ticker"), F.col("ts").alias("Timestamp"), F.col("value").alias("Score"))
    out = streams.drain_updates(streams.stream_session_sentiment(scored, fx.news_calendar(spark, sf)), "stream-sentiment", KEYS, arrivals)
    return publish(out, ["Date", "Ticker", "News_Volume"], ["Sentiment"])


@query("stream_bars", f"""WITH w AS (SELECT *, date_trunc('hour', ts) AS Start FROM events),
 b AS (SELECT Start, event_type AS Ticker, arg_min(value, ts) AS Open, max(value) AS High, min(value) AS Low, arg_max(value, ts) AS Close, count(*) AS Volume FROM w GROUP BY 1, 2)
 SELECT strftime(Start, '%Y-%m-%d %H:%M:%S') AS Start, Ticker, Volume, {gcols(['Open', 'High', 'Low', 'Close'])} FROM b""")
def _(spark, sf):
    """Events without a time fall in no window; they are the bar without a start and with neither first nor last price."""
    events, arrivals = event_stream(spark, sf)
    ticks = events.select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("Ticker"), F.col("value").alias("price"))
    bars = streams.drain_updates(streams.stream_bars(ticks), "stream-bars", ["Start", "Ticker"], arrivals)
    timeless = table(spark, sf, "events").where("ts IS NULL").groupBy(F.col("event_type").alias("Ticker")).agg(
        F.max("value").alias("High"), F.min("value").alias("Low"), F.count("*").alias("Volume"))
    out = bars.unionByName(timeless, allowMissingColumns=True).withColumn("Start", F.date_format("Start", "yyyy-MM-dd HH:mm:ss"))
    return publish(out, ["Start", "Ticker", "Volume"], ["Open", "High", "Low", "Close"])
