"""Queries against DuckDB where events share their moments: the smallest table thrice over, ids shifted, and k in the last."""

import duckdb
import pytest

from chronoweave.plans import registry
from test_oracles import SF, rows

NAMES = ["clipped_anchors", "co_occurrences", "co_occurrences_in_two_runs", "other_places", "located_intervals", "wifi_log", "wifi_log_files"]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    at = tmp_path_factory.mktemp("repeated")
    moved = """CASE WHEN c = 2 THEN '{"k": ' || (CAST(json_extract_string(props, '$.k') AS BIGINT) + 2) || '}' ELSE props END"""
    duckdb.sql(f"COPY (SELECT event_id + 1000000 * c AS event_id, ts, user_id, event_type, value, {moved} AS props FROM '{SF}/events.parquet', range(3) t(c)) TO '{at}/events.parquet'")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_of_equal_moments(spark, repeated, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{repeated}/events.parquet'")
    ours, theirs = registry.QUERIES[name](spark, repeated).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


@pytest.mark.parametrize("name", ["wifi_log", "wifi_log_files"])
def test_same_rows_of_several_years(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT event_id + 1000000 * c AS event_id, ts + to_days(CAST(300 * c AS INTEGER)) AS ts, user_id, event_type, value, props FROM '{SF}/events.parquet', range(-1, 3) t(c)) TO '{tmp_path}/events.parquet'")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ours, theirs = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_what_a_lost_task_left_is_not_read(spark, tmp_path):
    from chronoweave.plans import file_queries
    from chronoweave.sources import logs

    def write(path, pdf):
        import os

        partial = os.path.join(os.path.dirname(path), os.path.basename(path).replace(".new", "lost.new"))
        for at, text in ((path, "".join(f"{x}\n" for x in pdf["value"])), (partial, "Mon Jan  1 00:00:01.000  IP Address: 1.2.3.4 up\n  IP subnet mask: 255.255.255.0\n")):
            with open(at, "w") as f:
                f.write(text)

    lines = ["Tue Jan  2 00:00:01.000  IP Address: 5.6.7.8 up", "  IP subnet mask: 255.255.255.0"]
    df = spark.createDataFrame([("0", i, x) for i, x in enumerate(lines)], "entity string, seq long, value string")
    file_queries.write_files(df, str(tmp_path), "wifi.log", write)
    assert [r.ip for r in logs.read_wifi_logs(spark, [f"{tmp_path}/*"], 2024).collect()] == ["5.6.7.8"]
