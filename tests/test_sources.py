import datetime
import os

import pytest

from tablelab.operators import runlog
from tablelab.plans.analysis import OUTPUTS, SECTIONS, run_analysis
from tablelab.sources.readers import csv_encoding, read_table
from tablelab.sources.writers import read_summary, write_summary, write_table


def test_csv_encodings(spark, tmp_path):
    text = "名称,值\n甲,1\n乙,2.5\n"
    for name, encoding in (("bom", "utf-8-sig"), ("plain", "utf-8"), ("gbk", "gbk")):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode(encoding))
        df = read_table(spark, str(path))
        assert df.columns == ["名称", "值"] and [tuple(r) for r in df.collect()] == [("甲", 1.0), ("乙", 2.5)], name
    late = tmp_path / "late.csv"
    late.write_bytes(b"a,b\n" + b"1,2\n" * 200000 + "甲,2\n".encode("gbk"))
    assert csv_encoding(spark, str(late)) == "GBK"
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError):
        csv_encoding(spark, str(bad))


def test_json_layouts(spark, tmp_path):
    files = {
        "one.json": '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]',
        "indented.json": '\n [\n  {\n   "a": 1,\n   "b": "x"\n  },\n  {"a": 2, "b": "y"}\n]',
        "lines.json": '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        assert sorted(tuple(r) for r in read_table(spark, str(tmp_path / name)).collect()) == [(1, "x"), (2, "y")], name
    (tmp_path / "nested.json").write_text('{"a": {"b": 1, "c": {"d": 2}}}\n')
    assert read_table(spark, str(tmp_path / "nested.json")).columns == ["a.b", "a.c.d"]


def test_missing_texts_and_types(spark, tmp_path):
    path = tmp_path / "gaps.csv"
    path.write_text("n,w,t,b,d,a,a,A\n1,NA,x,true,2024-01-02,1,2,3\nN/A,2.5,null,,nan,4,5,6\n3,nan,z,False,2024-02-03,7,8,9\n")
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {"n": "int", "w": "double", "t": "string", "b": "boolean", "d": "date", "a": "int", "a.1": "int", "A.2": "int"}
    rows = [tuple(r)[:5] for r in df.collect()]
    assert rows[1] == (None, 2.5, None, None, None) and rows[0][1] is None and rows[2][:3] == (3, None, "z")


def test_broken_records_are_errors(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, str(tmp_path / "long.csv")).collect()
    (tmp_path / "broken.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "broken.json"))


def test_json_keeps_the_order_of_its_columns(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"z": 1, "a": 2, "m": 3}\n{"b": 4}\n')
    (tmp_path / "array.json").write_text('[{"z": 1, "a": 2, "m": 3},\n {"b": 4}]')
    for name in ("lines", "array"):
        assert read_table(spark, str(tmp_path / f"{name}.json")).columns == ["z", "a", "m", "b"]


def test_formats(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        read_table(spark, str(tmp_path / "x.xlsx"))
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"r', 1.5)], "k int, s string, v double")
    for fmt in ("csv", "parquet", "json"):
        out = str(tmp_path / f"out.{fmt}")
        write_table(df, out, fmt)
        back = read_table(spark, out)
        assert sorted((r["k"], r["s"], r["v"]) for r in back.collect()) == [(1, "a,b", None), (2, 'q"r', 1.5)], fmt
    part = next((tmp_path / "out.csv").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfk,s,v")
    write_summary({"x": df, "y": df.limit(1)}, str(tmp_path / "sum"))
    row = spark.read.json(str(tmp_path / "sum")).first()
    assert len(row["x"]) == 2 and len(row["y"]) == 1
    parts = {"x": df, "none": df.limit(0), "odd name": spark.createDataFrame([(float("inf"), None, [1, 2])], "`a b` double, n string, l array<int>")}
    write_summary(parts, str(tmp_path / "typed"))
    back = read_summary(spark, str(tmp_path / "typed"))
    assert list(sorted(back)) == sorted(parts)
    for name, part in parts.items():
        assert back[name].collect() == part.collect() and back[name].dtypes == part.dtypes, name
    with pytest.raises(ValueError):
        write_summary({"schemas": df}, str(tmp_path / "bad"))


def test_whole_analysis(spark, tmp_path):
    lines = ["Row Id, Sales Value ,Region,Price-Text,When"]
    for i in range(120):
        value = "" if i % 11 == 0 else str(10 + (i * 7) % 23)
        region = "" if i % 13 == 0 else ["East", "West", "North"][i % 3]
        lines.append(f'{i},{value},{region},"{1000 + i * 37:,}",2024-01-{1 + i % 28:02d}')
    lines.append(lines[-1])
    (tmp_path / "in.csv").write_bytes("\n".join(lines).encode("utf-8-sig"))
    log = runlog.RunLog(spark, str(tmp_path / "log"))
    accepted = ["normalize_columns", "drop_duplicates", "convert_numeric::Price-Text", "fill_missing:: Sales Value ", "fill_missing::Region"]
    out = tmp_path / "out"
    run = run_analysis(
        spark, str(tmp_path / "in.csv"), str(out), ["Row Id"], accepted, "Price-Text", [" Sales Value ", "Region"], log
    )
    assert sorted(p.name for p in out.iterdir()) == sorted(OUTPUTS)
    cleaned = read_table(spark, str(out / "cleaned_data"), fmt="csv")
    assert cleaned.count() == 120 and cleaned.columns == ["row_id", "sales_value", "region", "price_text", "when"]
    assert cleaned.filter("sales_value is null or region is null").count() == 0
    report = read_table(spark, str(out / "report"), fmt="csv").collect()
    assert {r["section"] for r in report} == set(SECTIONS)
    facts = {(r["section"][0], r["item"]): r["value"] for r in report}
    assert facts["1", "target"] == "price_text" and facts["2", "original rows"] == "121" and facts["2", "cleaned rows"] == "120"
    assert facts["1", "file"] == "in.csv" and len(facts["1", "created"]) == 19
    assert "Sales Value  -> sales_value" in facts["2", "列名规范化"]
    assert facts["2", "缺失值填补 sales_value"].startswith("median: ") and facts["2", "缺失值填补 region"] in ("East", "West", "North")
    assert {"缺失值  Sales Value", "缺失值 Region", "类型转换 Price-Text"} <= {r["item"].strip() for r in report}
    order = [r["item"] for r in report if r["section"].startswith("3.") and int(r["ord"]) < 100]
    assert order == ["row_id", "sales_value", "price_text"]
    assert read_table(spark, str(out / "model_comparison"), fmt="csv").count() == 6
    charts = read_summary(spark, str(out / "chart_data"))
    assert set(charts) == {
        "histogram", "density", "top_categories", "correlation", "residuals", "residual_quantiles", "model_errors", "predictions", "scatter",
    }
    assert charts["histogram"].agg({"n": "sum"}).first()[0] == 360 and charts["density"].count() == 600
    assert charts["residuals"].count() == 120 and charts["residual_quantiles"].count() == 120 and charts["model_errors"].count() == 6
    assert {r["feature"] for r in charts["scatter"].collect()} == {"sales_value"}
    summary = read_summary(spark, str(out / "analysis_summary"))
    assert summary["roles"].first()["target"] == "price_text" and summary["numeric_stats"].count() == 3
    assert [r["status"] for r in log.states().filter(f"id = '{run}'").collect()] == ["completed"]
    with pytest.raises(ValueError):
        run_analysis(spark, str(tmp_path / "in.csv"), str(tmp_path / "o2"), ["Row Id"], target="nope", log=log, run="r2")
    assert log.states().filter("id = 'r2'").first()["status"] == "failed"
    assert datetime.date(2024, 1, 1) in {r["when"] for r in cleaned.collect()}


def test_release_deletes_intermediate_tables(spark, monkeypatch, tmp_path):
    from tablelab import session

    monkeypatch.setattr(session, "_written", {})
    df = session.materialise(spark.range(3), "kept")
    folder = session._written[spark.sparkContext.applicationId][0]
    assert df.count() == 3 and os.path.isdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)
