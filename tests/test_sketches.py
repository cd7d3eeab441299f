"""Month sketches: moments against NumPy, quantiles within the stated rank error, one month replaced."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import sketches
from loomspan.session import run_dir


def test_merged_months(spark):
    rng = np.random.default_rng(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    # a series with many values a day, so that its sketches are far smaller than the data
    values = {"big": rng.standard_t(3, size=40_000) * 0.01 + 5, "small": rng.normal(size=400)}
    rows = [(days[i % 400], t, float(v)) for t, x in values.items() for i, v in enumerate(x)] + [(days[0], "small", None), (days[0], "none", None)]
    returns = spark.createDataFrame(rows, "Date date, Ticker string, r double").repartition(6)
    months = sketches.by_month(returns, 200)
    got = {r.Ticker: r for r in sketches.merged(months).select("*", sketches.quantile(0.05).alias("var"), sketches.tail_mean(0.05).alias("cvar"), sketches.quantile(0.5).alias("mid")).collect()}
    assert set(got) == set(values)
    for t, x in values.items():
        r = got[t]
        assert (r.n, r.low, r.high) == (len(x), x.min(), x.max())
        assert r.mean == pytest.approx(x.mean(), rel=1e-12) and r.variance == pytest.approx(x.var(), rel=1e-9)
        for p, v in ((0.05, r["var"]), (0.5, r.mid)):
            assert abs((x <= v).mean() - p) <= sketches.rank_error(200) + 1 / len(x)
        exact = x[x <= np.quantile(x, 0.05)].mean()
        assert abs(r.cvar - exact) <= 0.1 * abs(exact - x.mean())


def test_a_corrected_day_touches_its_month(spark):
    rows = [(dt.date(2020, m, d), "a", float(10 * m + d)) for m in (1, 2, 3) for d in (1, 2)]
    schema = "Date date, Ticker string, r double"
    path = run_dir(spark, "test-sketches")
    sketches.write(sketches.by_month(spark.createDataFrame(rows, schema)), path)
    before = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).collect()}
    sketches.write(sketches.by_month(spark.createDataFrame([(dt.date(2020, 2, 1), "a", 100.0)], schema)), path)
    table = spark.read.parquet(path)
    after = {r[0] for r in table.select(F.input_file_name()).collect()}
    assert len(before & after) == 2 and len(after) == 3
    whole = sketches.merged(table).head()
    assert (whole.n, whole.high, whole.mean) == (5, 100.0, pytest.approx((11 + 12 + 100 + 31 + 32) / 5))
    assert sketches.merged(table.limit(0)).count() == 0
