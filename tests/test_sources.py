import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import SMALL
from fixtures import frame, rows_of
from gaugeworks.functions import text
from gaugeworks.operators import evaluation
from gaugeworks.queries import suite
from gaugeworks.schema import ALL_COLUMNS, EXPORTER_METRICS, METRICS
from gaugeworks.sources import files, metrics_json, rows


def lines(path, *records):
    path.write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


def test_csv_round_trip_in_any_column_order(spark, tmp_path):
    df = frame(spark, rows_of("a", [1.5, float("nan"), None]))
    shuffled = df.select(*reversed(ALL_COLUMNS), F.lit("x").alias("extra"))
    path = str(tmp_path / "t.csv")
    files.write_csv(shuffled, path)
    back = files.load_telemetry(spark, path)
    assert back.columns == list(ALL_COLUMNS)
    assert [r["gpu_util"] for r in back.orderBy("timestamp").collect()] == [1.5, None, None]
    assert back.schema["timestamp"].dataType.simpleString() == "timestamp_ntz"


@pytest.mark.parametrize("suffix", [".parquet", ".pq"])
def test_parquet_round_trip_prunes_columns(spark, tmp_path, suffix):
    df = frame(spark, rows_of("a", [1.0, float("nan")]))
    path = str(tmp_path / f"t{suffix}")
    files.write_parquet(df, path, partition_by=("node_id",))
    back = files.load_telemetry(spark, path)
    assert [r["gpu_util"] for r in back.orderBy("timestamp").collect()] == [1.0, None]
    plan = back.where("gpu_id = 'a'").select("gpu_temp")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<gpu_id:string,gpu_temp:double>" in plan
    assert "EqualTo(gpu_id,a)" in plan


def test_rejects_other_suffixes_missing_columns_and_absent_paths(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported"):
        files.load_telemetry(spark, "t.xlsx")
    path = str(tmp_path / "t.parquet")
    frame(spark, rows_of("a", [1.0])).drop("gpu_temp", "cpu_util").write.parquet(path)
    with pytest.raises(ValueError, match=r"\['cpu_util', 'gpu_temp'\]"):
        files.load_telemetry(spark, path)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.load_telemetry(spark, str(tmp_path / "none.parquet"))


def test_document_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 'ok' AS status, array(named_struct('a', 1, 'b', CAST(NULL AS string))) AS items")
    path = str(tmp_path / "doc")
    files.write_document(df, path)
    text_file = next((tmp_path / "doc").glob("part-*"))
    assert json.loads(text_file.read_text()) == {"status": "ok", "items": [{"a": 1, "b": None}]}
    assert files.read_document(spark, path).first()["status"] == "ok"


def test_union_of_frames_with_different_columns(spark):
    a, b = spark.sql("SELECT 1 AS x, 2 AS y"), spark.sql("SELECT 3 AS x")
    assert sorted(map(tuple, files.union_all([a, b]).collect()), key=lambda r: r[0]) == [(1, 2), (3, None)]


def response(*series):
    return {"status": "success", "data": {"result": list(series)}}


def test_range_query_labels_values_and_assembly(spark, tmp_path):
    util = lines(
        tmp_path / "util.json",
        response(
            {"metric": {"gpu": "0", "instance": "h1"}, "values": [[1704067200, "12.5"], [1704067260.25, "NaN"]]},
            {"metric": {"gpu_id": "1", "node": "h2"}, "values": [[1704067200, "7"]]},
            {"metric": {}, "values": [[1704067200, "1"]]},
        ),
    )
    temp = lines(
        tmp_path / "temp.json",
        response({"metric": {"gpu": "0", "instance": "h1"}, "values": [[1704067200, "55"]]}),
    )
    none = lines(tmp_path / "none.json", response())
    long = metrics_json.read_responses(spark, {"gpu_util": util, "gpu_temp": temp, "mem_util": none})
    found = {(r["metric"], r["gpu_id"], r["node_id"], r["timestamp"]): r["value"] for r in long.collect()}
    start = datetime(2024, 1, 1)
    assert found == {
        ("gpu_util", "0", "h1", start): 12.5,
        ("gpu_util", "0", "h1", datetime(2024, 1, 1, 0, 1, 0, 250000)): None,
        ("gpu_util", "1", "h2", start): 7.0,
        ("gpu_util", "unknown", "unknown", start): 1.0,
        ("gpu_temp", "0", "h1", start): 55.0,
    }
    wide = metrics_json.assemble_wide(long)
    assert wide.columns == list(ALL_COLUMNS)
    row = wide.where("gpu_id = '0' AND gpu_util IS NOT NULL").first()
    assert (row["gpu_util"], row["gpu_temp"], row["mem_util"]) == (12.5, 55.0, None)
    assert wide.count() == 4


def test_no_series_gives_an_empty_typed_table(spark):
    wide = metrics_json.assemble_wide(metrics_json.read_responses(spark, {}))
    assert wide.count() == 0 and wide.schema["gpu_util"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        metrics_json.read_responses(spark, {"nope": "x"})


def test_repeated_samples_take_the_first_and_subsets_leave_the_rest_empty(spark):
    long = spark.createDataFrame(
        [("gpu_util", 1, 5.0), ("gpu_util", 0, 9.0), ("gpu_temp", 2, 40.0)], "metric string, seq int, value double"
    ).selectExpr("*", "timestamp_ntz'2024-01-01' AS timestamp", "'a' AS gpu_id", "'n' AS node_id")
    row = metrics_json.assemble_wide(long, metrics=("gpu_util",), seq="seq").first()
    assert (row["gpu_util"], row["gpu_temp"]) == (9.0, None)


def test_outer_join_multiplies_repeated_keys_like_a_merge(spark):
    def table(name, *pairs):
        df = spark.createDataFrame(list(pairs), f"gpu_id string, {name} double")
        return df.selectExpr("timestamp_ntz'2024-01-01' AS timestamp", "gpu_id", "'n' AS node_id", name)

    joined = metrics_json.outer_join_metrics(
        table("x", ("a", 1.0), ("a", 2.0), ("b", 3.0)), table("y", ("a", 7.0), ("a", 8.0), ("c", 9.0))
    )
    found = sorted(((r["gpu_id"], r["x"], r["y"]) for r in joined.collect()), key=str)
    assert found == [
        ("a", 1.0, 7.0), ("a", 1.0, 8.0), ("a", 2.0, 7.0), ("a", 2.0, 8.0), ("b", 3.0, None), ("c", None, 9.0)
    ]


def test_metric_names(spark):
    df = spark.createDataFrame([(m,) for m in (*METRICS, "other")], "m string")
    found = df.select("m", metrics_json.exporter_name(F.col("m")).alias("e")).select(
        "m", "e", metrics_json.column_name(F.col("e")).alias("back")
    )
    for r in found.collect():
        assert r["e"] == EXPORTER_METRICS.get(r["m"])
        assert r["back"] == (r["m"] if r["m"] in EXPORTER_METRICS else None)


def record(**changes):
    base = {"timestamp": "2024-01-01T00:00:00", "gpu_id": "a", "node_id": "n", **{m: 1.0 for m in METRICS}}
    return {k: v for k, v in {**base, **changes}.items() if v is not None}


def test_submitted_rows(spark, tmp_path):
    path = lines(tmp_path / "rows.json", record(), record(timestamp="2024-01-01 00:01:00.5", gpu_util=3))
    found = rows.read_rows(spark, path)
    assert found.columns == list(ALL_COLUMNS)
    assert [(r["timestamp"], r["gpu_util"]) for r in found.orderBy("timestamp").collect()] == [
        (datetime(2024, 1, 1), 1.0),
        (datetime(2024, 1, 1, 0, 1, 0, 500000), 3.0),
    ]


@pytest.mark.parametrize("bad", [{"gpu_util": None}, {"gpu_id": None}, {"cpu_util": "much"}, {"timestamp": "soon"}])
def test_submitted_rows_must_be_complete_and_typed(spark, tmp_path, bad):
    path = lines(tmp_path / "rows.json", record(), record(**bad))
    with pytest.raises(Exception):
        rows.read_rows(spark, path).collect()


def test_id_lists(spark):
    df = spark.createDataFrame([("gpu-1;gpu-11",), ("",), (None,), ("1; 2",)], "t string")
    assert [r[0] for r in df.select(text.id_list(F.col("t"))).collect()] == [["gpu-1", "gpu-11"], [], [], ["1", "2"]]


def test_id_formats(spark):
    df = spark.createDataFrame([(7,), (1234,)], "n bigint")
    found = df.select(text.device_id(F.col("n")), text.host_id(F.col("n"))).collect()
    assert [tuple(r) for r in found] == [("gpu-007", "node-07"), ("gpu-1234", "node-1234")]


def test_device_keys_of_several_columns_never_clash(spark):
    rows = [("a/b", "c"), ("a", "b/c"), ("a%2Fb", "c"), (None, "c"), ("a", None)]
    df = spark.createDataFrame(rows, "node_id string, gpu_id string")
    keys = [r["gpu_id"] for r in files.with_device_key(df).collect()]
    assert keys == ["a%2Fb/c", "a/b%2Fc", "a%252Fb/c", "unknown/c", None]


def test_landed_responses_are_bounded(spark):
    long = spark.range(25_000).selectExpr(
        "'gpu_temp' AS metric", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 600) AS timestamp",
        "'one' AS gpu_id", "'host' AS node_id", "CAST(id AS double) AS value", "id AS seq",
    )
    bodies = suite.landed(long)
    sizes = [len(json.loads(r.body)["data"]["result"][0]["values"]) for r in bodies.collect()]
    assert sum(sizes) == 25_000 and max(sizes) <= suite.RESPONSE_SPAN
    assert suite.read_back(bodies).select("value").distinct().count() == 25_000


def test_all_metrics_come_back_from_responses(spark):
    assert {r.metric for r in suite.QUERIES["src_07_range_query_all"](spark, SMALL).select("metric").distinct().collect()} == set(METRICS)


def test_lists_of_trials_are_bounded(spark):
    outcomes = spark.range(20_000).selectExpr("DATE '2024-01-01' AS timestamp", "CAST(id AS string) AS gpu_id", "true AS failing", "id % 2 = 0 AS flagged")
    lists = suite.listed_trials(outcomes, 20_000)
    assert max(len(r.actual.split(";")) for r in lists.collect()) < 1.3 * suite.LISTED
    counts = evaluation.trial_counts(lists, "actual", "predicted").groupBy().sum().first()
    assert tuple(counts) == (10_000, 0, 10_000)
