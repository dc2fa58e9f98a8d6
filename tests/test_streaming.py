from sheetwise.sources.sinks import latest_runs, read_latest
from sheetwise.streaming.incremental import checkpoint_name, start_ingest


def _ingest(spark, landing, root, **options):
    q = start_ingest(spark, str(landing), str(root), **options)
    q.awaitTermination(120)
    return spark.read.parquet(str(root / "runs")), spark.read.parquet(str(root / "manifest"))


def test_incremental_ingest(spark, tmp_path):
    landing, root = tmp_path / "landing", tmp_path / "root"
    landing.mkdir()
    (landing / "a.csv").write_text("日期,销售额\n2026-01-01,\"1,200\"\n2026-01-01,\"1,200\"\n,\n")
    (landing / "b.csv").write_text("date,sales\n2026-01-02,5\n")
    (landing / "empty.csv").write_text("")
    (landing / "book.xlsx").write_bytes(b"PK")
    (landing / "notes.txt").write_text("x")
    runs, manifest = _ingest(spark, landing, root)
    assert sorted((r["original_row_count"], r["cleaned_row_count"]) for r in runs.collect()) == [(1, 1), (3, 1)]
    decisions = {r["path"].rsplit("/", 1)[1]: r["decision"] for r in manifest.collect()}
    assert decisions == {"a.csv": "ingested", "b.csv": "ingested", "empty.csv": "empty_file",
                         "book.xlsx": "workbook_needs_batch_scan", "notes.txt": "unsupported_extension"}
    # a restart takes up new files only, and the catalogue's readers follow the run rows
    (landing / "c.csv").write_text("date,sales\n2026-01-03,7\n2026-01-04,8\n")
    runs, manifest = _ingest(spark, landing, root, max_bytes=10**6)
    assert runs.count() == 3 and manifest.count() == 6
    latest = latest_runs(spark, str(root)).collect()
    assert sorted(read_latest(spark, str(root), r["dataset_id"]).count() for r in latest) == [1, 1, 2]


def test_checkpoint_name_is_the_same_in_every_process():
    assert checkpoint_name("/landing", "/root") == "ingest-" + "%s" % checkpoint_name("/landing", "/root")[7:]
    import hashlib
    assert checkpoint_name("/a", "/b") == "ingest-" + hashlib.sha256(b"/a\n/b").hexdigest()[:24]
