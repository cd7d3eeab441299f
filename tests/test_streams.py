"""Streams over events that cross a month border, some without a time, against SQL."""

import datetime as dt

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_module
from tests.test_queries import canonical


@pytest.mark.parametrize("name", ["stream_bars", "stream_session_sentiment"])
@pytest.mark.parametrize("timeless", [False, True])
def test_events_across_months(spark, sf, tmp_path, name, timeless):
    given = pq.read_table(f"{sf}/events.parquet")
    ts = [t + dt.timedelta(days=14) if t is not None else None for t in given.column("ts").to_pylist()]
    assert min(ts).month != max(ts).month
    if timeless:
        ts[::50] = [None] * len(ts[::50])
    at = given.schema.get_field_index("ts")
    pq.write_table(given.set_column(at, given.schema.field("ts"), pa.array(ts, given.schema.field("ts").type)), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = canonical(entry_module.queries()[name](spark, str(tmp_path)).toPandas())
    want = canonical(con.execute(entry_module.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=0)
