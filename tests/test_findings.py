import json

import pytest
from pyspark.sql import functions as F

from tablelab.functions import columns as C
from tablelab.operators import findings, ols, runlog
from tablelab.session import small_table

METRICS = "max_vif double, shapiro_p double, breusch_pagan_p double, cooks_threshold double, influential_points bigint"


def test_flags_and_recommendations(spark):
    bad = small_table(spark, [(11.0, 0.01, None, 0.1, 3)], METRICS)
    assert [r["problem"] for r in findings.diagnostic_flags(bad).collect()] == [True, True, False, True]
    assert [r["rule"] for r in ols.diagnostic_recommendations(bad).orderBy("ord").collect()] == ["vif", "shapiro", "influential"]
    good = small_table(spark, [(10.0, 0.05, 0.5, 0.1, 0)], METRICS)
    assert [r["rule"] for r in ols.diagnostic_recommendations(good).collect()] == ["none"]


def test_overfit_note(spark):
    rows = [("a", 30, 0.9, 0.9), ("b", 10, 0.9, 0.8), ("c", 20, 0.9, 0.89), ("d", 1, None, None)]
    df = small_table(spark, rows, "model string, parameters int, r2 double, adjusted_r2 double")
    got = {r["model"]: r["overfit"] for r in findings.overfit_note(df, F.lit(100)).collect()}
    assert got == {"a": "many parameters", "b": "adjusted R2 far below R2", "c": "none", "d": "none"}


def test_lines_and_names(spark):
    df = small_table(spark, [(i, f"c{i}", "x") for i in range(1, 16)], "ord int, c string, d string")
    lines = findings.finding_lines(df, "c", "d").orderBy("ord").collect()
    assert len(lines) == 13 and (lines[-1]["item"], lines[-1]["detail"]) == ("more", "3")
    assert findings.finding_lines(df.filter("ord <= 12"), "c", "d").count() == 12
    names = spark.range(1).select(
        C.limited_names(F.array(*[F.lit(f"n{i}") for i in range(14)])),
        C.limited_names(F.array(F.lit("a"), F.lit("b"))),
        C.limited_names(F.array().cast("array<string>")),
    ).first()
    assert names[0].endswith("`n11`，另有 2 项未展开") and names[1] == "`a`, `b`" and names[2] == "无"


def test_preview_and_names_of_files(spark):
    body = "# x\n## 1. 数据集概况\nrows  \n## 5. 回归诊断结果\nrest"
    df = spark.createDataFrame([(body,), ("y" * 4100,), ("\n## 5. 回归诊断结果 z",)], "t string")
    got = [r[0] for r in df.select(C.text_preview(F.col("t"))).collect()]
    assert got == ["# x\n## 1. 数据集概况\nrows", "y" * 4000, "\n## 5. 回归诊断结果 z"]
    files = {"../a b/数据 表(1).CSV": "数据_表_1_.CSV", "a//": "a", "": "uploaded_data.csv", "x|y.json": "x_y.json"}
    df = spark.createDataFrame([(k,) for k in files], "f string")
    assert [r[0] for r in df.select(C.safe_filename(F.col("f"))).collect()] == list(files.values())
    assert [r[0] for r in df.select(C.file_suffix(F.col("f"))).collect()] == ["csv", "", "", "json"]
    assert spark.range(1).select(C.escape_cell(F.lit("a|b\nc"))).first()[0] == "a\\|b c"


def test_insight_summary(spark):
    best = small_table(spark, [("Ridge", 1.0)], "model string, rmse double")
    metrics = small_table(spark, [(1.0, None, 0.2, 0.1, 0)], METRICS)
    stats = small_table(spark, [(f"c{i}", i) for i in range(9)], "column string, count bigint")
    got = json.loads(findings.insight_summary(20, 3, "y", best, metrics, stats).first()["summary"])
    assert got["best_model"]["model"] == "Ridge" and len(got["numeric_stats"]) == 6 and got["rows"] == 20
    assert got["numeric_columns_left_out"] == 3


def test_previews_count_what_they_leave_out(spark):
    df = small_table(spark, [(f"c{i}", 20 - i) for i in range(14)], "column string, position int")
    lines = [tuple(r) for r in findings.preview_lines(df, F.col("column"), F.col("position"), ["position"]).orderBy("ord").collect()]
    assert lines[0] == (1, "c13", "7") and lines[9] == (10, "c4", "16") and lines[10] == (11, "more", "4") and len(lines) == 11
    assert findings.preview_lines(df.limit(0), F.col("column"), F.col("position"), ["position"]).count() == 0


def test_run_log(spark, tmp_path):
    log = runlog.RunLog(spark, str(tmp_path / "log"))
    log.append("a", "queued", 8, "queued")
    log.append("b", "awaiting_confirmation", 6, "uploaded")
    log.append("a", "running", 12, "cleaning")
    log.append("a", "completed", 100, "done")
    states = {r["id"]: r["status"] for r in log.states().collect()}
    assert states == {"a": "completed", "b": "awaiting_confirmation"}
    counts = runlog.status_counts(log.states(), "status").first()
    assert tuple(counts) == (2, 0, 1)
    recent = runlog.recent_runs(log.read(), "id", ["updated_at"], 1).collect()
    assert [r["id"] for r in recent] == ["b"]
    at = ["updated_at"]
    assert runlog.invalid_transitions(log.read(), "id", at, "status").count() == 0
    gone = small_table(spark, [("a",)], "id string")
    assert {r["id"] for r in runlog.drop_runs(log.read(), gone, "id", "status", at).collect()} == {"b"}
    with pytest.raises(KeyError):
        runlog.drop_runs(log.read(), small_table(spark, [("zz",)], "id string"), "id")
    log.append("b", "queued", 8, "queued")
    with pytest.raises(ValueError):
        runlog.drop_runs(log.read(), small_table(spark, [("b",)], "id string"), "id", "status", at)
    with pytest.raises(ValueError):
        log.delete("b")
    log.delete("a")
    assert [(r["id"], r["created_at"] <= r["updated_at"]) for r in log.states().collect()] == [("b", True)]
    with pytest.raises(KeyError):
        log.delete("a")


def test_transitions_across_cuts(spark):
    rows = [("h", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", ["queued", "running", "queued"][i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, t string, status string").selectExpr("id", "cast(t as timestamp_ntz) ts", "status")
    found = runlog.invalid_transitions(df, "id", ["ts"], "status")
    # running -> queued happens once in every three steps
    assert found.count() == 200 and {(r["from_status"], r["to_status"]) for r in found.collect()} == {("running", "queued")}


def test_a_busy_id_is_cut_into_even_stretches(spark):
    # 95 % of the rows belong to one id, nearly all of them within one hour of ten years.
    when = F.when(F.col("i") < 200, F.col("i") * 1_500_000).otherwise(F.col("i") * 0.05 + 100_000_000).cast("decimal(20,6)")
    rows = spark.range(20_000).select(
        F.col("id").alias("i"),
        F.when(F.col("id") % 20 > 0, F.lit("busy")).otherwise(F.when(F.col("id") % 40 > 0, F.concat(F.lit("u"), F.col("id") % 7))).alias("id"),
    ).withColumn("ts", when.cast("timestamp").cast("timestamp_ntz"))
    rows = rows.withColumn("status", F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "failed")]), (F.col("i") % 3 + 1).cast("int")))
    log = rows.select("id", F.col("i").alias("micros"), F.struct("ts").alias("at"), "status")
    parts = runlog._stretches(log).groupBy("id", "part").count().collect()
    largest = max(r["count"] for r in parts)
    assert largest <= 4 * 20_000 / runlog.PARTS and len({r["part"] for r in parts if r["id"] == "busy"}) > runlog.PARTS // 2
    found = runlog.invalid_transitions(rows, "id", ["ts", "i"], "status")
    want, last = set(), {}
    for r in sorted(rows.collect(), key=lambda r: (r["ts"], r["i"])):
        if r["id"] in last and (last[r["id"]], r["status"]) not in runlog.ALLOWED:
            want.add((r["id"], r["i"], last[r["id"]], r["status"]))
        last[r["id"]] = r["status"]
    assert {(r["id"], r["i"], r["from_status"], r["to_status"]) for r in found.collect()} == want and len(want) > 500
    nothing = runlog.invalid_transitions(rows.limit(0), "id", ["ts", "i"], "status")
    assert nothing.count() == 0
    one = rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("ts", F.when(F.col("i") % 5 > 0, F.col("ts")))
    assert runlog.invalid_transitions(one, "id", ["ts", "i"], "status").count() > 500  # one instant, and no time at all
