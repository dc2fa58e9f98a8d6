import os

import pytest

from helpers import rows

from sheetwise.sources import files as FS
from sheetwise.sources import sinks as SK


def test_gbk_and_utf8_csv(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "u.csv").write_bytes("区域,销售额\n郑州,1\n".encode("utf-8-sig"))
    (tmp_path / "a" / "g.csv").write_bytes("区域,销售额\n洛阳,NA\n".encode("gbk"))
    cs = {os.path.basename(r["file"]): r["charset"] for r in rows(FS.file_charsets(spark, str(tmp_path / "a")))}
    assert cs == {"u.csv": "UTF-8", "g.csv": "GBK"}
    df = FS.read_csv_folder(spark, str(tmp_path / "a"))
    got = {(r["区域"], r["销售额"]) for r in df.collect()}
    assert got == {("郑州", "1"), ("洛阳", None)}


def test_workbook_round_trip_and_manifest(spark, tmp_path):
    src = spark.createDataFrame([("1", "a"), ("2", None)], "id string, name string")
    SK.export_workbooks(src.repartition(1), str(tmp_path / "wb"))
    wide = FS.workbook_frame(FS.read_workbooks(spark, str(tmp_path / "wb")), ["id", "name"])
    assert {(r["id"], r["name"]) for r in wide.collect()} == {("1", "a"), ("2", None)}
    (tmp_path / "wb" / "notes.txt").write_text("x")
    (tmp_path / "wb" / "header_only.csv").write_text("a,b\n")
    man = {os.path.basename(r["path"]): r["reject_reason"] for r in rows(FS.landing_manifest(spark, str(tmp_path / "wb")))}
    assert man["notes.txt"] == "unsupported_extension" and man["header_only.csv"] == "no_data_rows"


def test_runs_latest_wins_and_overrides(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([("1",)], "v string")
    for run in (1, 2):
        path = SK.clean_sink(df.selectExpr(f"'{run}' as v"), root, 5, run)
        SK.run_append(spark, root, {"dataset_id": 5, "run_id": run,
                                    "cleaned_storage_path": path})
    assert SK.read_latest(spark, root, 5).collect()[0]["v"] == "2"
    SK.override_replace(spark, root, 5, {"memo": "phone"}, ["memo", "x"])
    SK.override_replace(spark, root, 6, {"x": "email"}, ["memo", "x"])
    SK.override_replace(spark, root, 5, {"x": "email"}, ["memo", "x"])   # full replace of dataset 5 only
    assert SK.read_overrides(spark, root, 5) == {"x": "email"}
    assert SK.read_overrides(spark, root, 6) == {"x": "email"}
    SK.override_replace(spark, root, 5, {}, ["memo", "x"])
    assert SK.read_overrides(spark, root, 5) == {}
    import pytest
    with pytest.raises(ValueError):
        SK.clean_sink(df, root, 5, 2)   # committed runs stay
    SK.run_append(spark, root, {"dataset_id": 5, "run_id": 2, "cleaned_storage_path": path})
    assert spark.read.parquet(f"{root}/runs").count() == 2


def test_csv_of_other_headers_quotes_and_newlines(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "a.csv").write_text('region,sales,note\nN,1,"say ""hi"", ok"\nM,3,"two\nlines"\n')
    (folder / "b.csv").write_text("sales,region\n2,S\n")
    got = {(r["region"], r["sales"], r["note"]) for r in FS.read_csv_folder(spark, str(folder)).collect()}
    assert got == {("N", "1", 'say "hi", ok'), ("M", "3", "two\nlines"), ("S", "2", None)}


def test_repeated_workbook_headers():
    assert FS.unique_headers(["a", "a", None, "a.1", "a"]) == ["a", "a.1", "Unnamed: 2", "a.1.1", "a.2"]


def test_preview_and_audit_keep_everything(spark, tmp_path):
    df = spark.createDataFrame([(None, 2), ("a", 1)], "v string, n int")
    assert [r["record"] for r in SK.preview(df).collect()] == ['{"n":2}', '{"v":"a","n":1}']
    SK.audit_append(spark, str(tmp_path), spark.createDataFrame([(1, "x" * 900)], "id int, detail string"))
    log = spark.read.parquet(f"{tmp_path}/audit")
    assert len(log.first()["detail"]) == 900 and len(SK.audit_shown(log).first()["detail"]) == 500


def test_csv_headers_and_charsets(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes('﻿a,a,,"b\nc"\n1,2,3,"4\n5"\n6,7\n'.encode())
    (folder / "b.csv").write_bytes('a,a,,"b\nd"\n1,2,3,4\n'.encode())
    (folder / "g 表+1.csv").write_bytes("名,值\r\n甲,1\r\n".encode("gbk"))
    groups = FS.csv_groups(spark, str(folder))
    assert [(g.charset, g.header) for g in groups] == [("GBK", ("名", "值")), ("UTF-8", ("a", "a.1", "Unnamed: 2", "b\nc")),
                                                       ("UTF-8", ("a", "a.1", "Unnamed: 2", "b\nd"))]
    got = rows(FS.read_csv_folder(spark, str(folder)).drop("_file", "_pos"))
    assert len(got) == 4 and {r["b\nc"] for r in got} == {"4\n5", None} and {r["值"] for r in got} == {"1", None}
    (folder / "x.csv").write_bytes(b"h\n\xff\xfe\x80\n")
    assert {os.path.basename(r["file"]): r["charset"] for r in rows(FS.file_charsets(spark, str(folder)))}["x.csv"] is None
    with pytest.raises(ValueError, match="x.csv"):
        FS.read_csv_folder(spark, str(folder))
    reasons = {os.path.basename(r["path"]): r["reject_reason"] for r in rows(FS.landing_manifest(spark, str(folder)))}
    assert reasons == {"a.csv": None, "b.csv": None, "g 表+1.csv": None, "x.csv": "undecodable"}


def test_appends_are_idempotent(spark, tmp_path):
    root = str(tmp_path)
    profile = spark.createDataFrame([("c", 1)], "name string, unique_count long")
    events = spark.createDataFrame([(1, "x"), (2, None)], "id int, detail string")
    for _ in range(2):
        SK.catalog_append(spark, root, {"dataset_id": 1, "file_name": "f"}, profile)
        SK.audit_append(spark, root, events)
    SK.catalog_append(spark, root, {"dataset_id": 2, "file_name": "g"}, profile)
    SK.audit_append(spark, root, spark.createDataFrame([(3, "y")], events.schema))
    assert spark.read.parquet(f"{root}/datasets").count() == 2 and spark.read.parquet(f"{root}/dataset_columns").count() == 2
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/audit").collect()) == [1, 2, 3]


def test_typed_cells_and_header_union(spark, tmp_path):
    df = spark.sql("select 'x' as name, date'2024-01-05' as day, timestamp_ntz'1999-12-31 23:59:30' as at union all select null, null, null")
    SK.export_workbooks(df.repartition(1), f"file:{tmp_path}/wb", 1)
    SK.export_workbooks(spark.sql("select 'y' as name, 'z' as more"), f"{tmp_path}/wc")
    read = FS.read_workbooks(spark, f"{tmp_path}/wb").unionByName(FS.read_workbooks(spark, f"{tmp_path}/wc"))
    got = FS.workbook_frame(read).drop("_pos")
    assert got.columns == ["name", "day", "at", "more"]
    assert sorted(map(tuple, got.collect()), key=repr) == [("x", "2024-01-05 00:00:00", "1999-12-31 23:59:30", None), ("y", None, None, "z"), (None,) * 4]
    assert FS.date_text("0.75", False) == "18:00:00" and FS.date_text("59", False) == "1900-02-28 00:00:00" and FS.date_text("1", True) == "1904-01-02 00:00:00"
    assert [FS._is_date_format(f) for f in ("yyyy/m/d", "[h]:mm", "0.00", "General", '"day" 0', "[Red]0", "#,##0\\ d")] == [True, True, False, False, False, False, True]
