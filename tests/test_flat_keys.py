"""Users whose feature never changes have no line, in the queries as in their SQL."""

import datetime

import duckdb
import pytest

from brinkline.plans import catalogue, fields  # noqa: F401 - registers the queries

START = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", ["regression_threshold_by_user", "regression_threshold_covariate"])
def test_no_line_from_one_time(spark, tmp_path, name):
    days = [(1, 0, 5.0), (2, 1, 3.0), (2, 1, 8.0), (3, 0, 1.0), (3, 1, 7.0), (3, 2, 2.0), (3, 3, 9.0)]
    rows = [(i, u, START + datetime.timedelta(days=d), v) for i, (u, d, v) in enumerate(days)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    columns = "event_id, threshold, exceeds" if name.endswith("user") else "event_id, covariate, threshold"
    got = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(*columns.split(", ")).collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
    assert [r[0] for r in got] == [r[0] for r in want] == list(range(7))
    assert [r[1:] for r in got[:3]] == [r[1:] for r in want[:3]]  # the users of one time
    assert got[0][1 if name.endswith("user") else 2] is None and got == want
