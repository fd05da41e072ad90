"""Result tables to files, logs and provenance."""

import json
from datetime import datetime

from voltlake.sinks import writers


def rows(spark):
    data = [("spectral", "channel", 1, 'Ch "1", left', None, None, "Alpha", "absolute", 1.5), ("connectivity", "pair", None, None, "0", "1", "Alpha", "plv", 0.25), ("spectral", "summary", None, None, None, None, "Beta", "relative", None)]
    return spark.createDataFrame(data, "row_type string, scope string, channel_index int, channel_name string, node_a string, node_b string, band string, metric string, value double")


def test_rows_as_csv_and_json(spark, tmp_path):
    df = rows(spark)
    writers.write_rows_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').schema(df.schema).csv(str(tmp_path / "csv"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    writers.write_rows_csv(df.limit(1), str(tmp_path / "csv"))  # replaces
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    writers.write_rows_json(df, str(tmp_path / "json"))
    assert sorted(map(str, spark.read.schema(df.schema).json(str(tmp_path / "json")).collect())) == sorted(map(str, df.collect()))
    lines = [json.loads(line) for p in (tmp_path / "json").glob("part-*") for line in p.read_text().splitlines()]
    assert all(set(line) == set(df.columns) for line in lines)  # null fields are kept


def test_pruned_rows(spark):
    df = rows(spark)
    scopes = lambda **o: sorted(r.scope for r in writers.pruned(df, **o).collect())
    assert scopes() == ["channel", "pair", "summary"] and scopes(channels=False) == ["pair", "summary"]
    assert scopes(pairs=False) == ["channel", "summary"] and scopes(channels=False, pairs=False) == ["summary"]


def test_log_and_provenance():
    assert writers.log_lines([(datetime(2024, 1, 2, 3, 4, 5), "filtered"), (datetime(2024, 1, 2), "ünïcode")]) == "[2024-01-02 03:04:05] filtered\n[2024-01-02 00:00:00] ünïcode\n"
    assert writers.log_lines([]) == "" and writers.provenance_lines([]) == []
    assert writers.provenance_lines([{"name": "a", "trials": 12, "weight": 0.75}, {"name": "b", "trials": 4, "weight": 1 / 4}]) == ["1. a: 12 trials, weight 0.750", "2. b: 4 trials, weight 0.250"]
