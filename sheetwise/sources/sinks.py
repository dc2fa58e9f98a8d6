"""Sinks and catalogue tables (SNK-1 .. SNK-6, SRC-5) plus test-file exporters.

Layout under a shared root folder (never a machine-local temp folder):

* ``cleaned/dataset_id=<d>/run_id=<r>/`` - cleaned data of one run (Parquet)
* ``runs/``       - one row per finished cleaning run (the commit marker)
* ``datasets/``, ``dataset_columns/`` - catalogue rows
* ``overrides/dataset_id=<d>/`` - the current override set of a dataset
* ``audit/``      - audit events

Data is written before its run row, and readers only follow run rows, so a
failed or repeated write can never become visible half-way; re-running a job
after a lost executor rewrites the same run folder.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Length of an audit detail where it is shown, and preview size.
AUDIT_DETAIL_CHARS = 500
PREVIEW_ROWS = 20


def clean_path(root: str, dataset_id: int, run_id: int) -> str:
    return f"{root}/cleaned/dataset_id={dataset_id}/run_id={run_id}"


def clean_sink(df: DataFrame, root: str, dataset_id: int, run_id: int) -> str:
    """SNK-1: write the cleaned rows of one run to a new folder; the source is untouched.

    A run that has been committed (it has a run row) is never written again; a folder that
    a failed attempt left behind is."""
    path = clean_path(root, dataset_id, run_id)
    if _committed(df.sparkSession, root, dataset_id, run_id):
        raise ValueError(f"run {run_id} of dataset {dataset_id} is committed")
    df.write.mode("overwrite").parquet(path)
    return path


def _committed(spark: SparkSession, root: str, dataset_id: int, run_id: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    rows = spark.read.parquet(f"{root}/runs").where((F.col("dataset_id") == dataset_id) & (F.col("run_id") == run_id))
    return not rows.isEmpty()


def run_append(spark: SparkSession, root: str, run: dict) -> None:
    """SNK-3: write the run row (after the data is written): the commit marker.  A repeated
    call replaces the row of its (dataset, run)."""
    write_runs(spark.createDataFrame([run]), root)


def write_runs(runs: DataFrame, root: str) -> None:
    """Run rows in one folder per (dataset, run), so a retried write never doubles a row."""
    write_parts(runs, f"{root}/runs", "dataset_id", "run_id")


def latest_runs(spark: SparkSession, root: str) -> DataFrame:
    """SRC-5: the latest run (highest run id) of every dataset."""
    runs = spark.read.parquet(f"{root}/runs")
    return runs.groupBy("dataset_id").agg(F.max("run_id").alias("run_id"),
                                          F.max_by("cleaned_storage_path", "run_id").alias("cleaned_storage_path"))


def read_latest(spark: SparkSession, root: str, dataset_id: int) -> DataFrame:
    """SRC-5: the cleaned rows of a dataset's latest run (error when never cleaned)."""
    row = latest_runs(spark, root).where(F.col("dataset_id") == dataset_id).select("cleaned_storage_path").first()
    if row is None:
        raise ValueError("dataset has no cleaning run")
    path = row[0]
    return spark.read.parquet(path if "/" in path[:1] or ":" in path or path.startswith(root) else f"{root}/{path}")


def write_parts(df: DataFrame, path: str, *by: str) -> None:
    """Rows in one folder per value of ``by``.  A folder is replaced as a whole, so writing the same
    rows again changes nothing, and other folders stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def catalog_append(spark: SparkSession, root: str, dataset: dict, profile: DataFrame) -> None:
    """SNK-2: the dataset row and one row per column profile; a repeated call replaces them."""
    write_parts(spark.createDataFrame([dataset]), f"{root}/datasets", "dataset_id")
    write_parts(profile.withColumn("dataset_id", F.lit(dataset["dataset_id"])), f"{root}/dataset_columns", "dataset_id")


def override_replace(spark: SparkSession, root: str, dataset_id: int, overrides: dict[str, str],
                     columns: list[str]) -> None:
    """SNK-4: validate, then replace the whole override set of one dataset.

    Only that dataset's partition is overwritten (dynamic partition overwrite);
    ``{}`` clears it.  An invalid set raises before anything is written.
    """
    from sheetwise.plans.mapping import check_overrides
    check_overrides(spark, columns, overrides)
    rows = [(dataset_id, s, t) for s, t in sorted(overrides.items())]
    df = spark.createDataFrame(rows, "dataset_id long, source string, target string")
    if not rows:  # clearing: write an empty marker partition
        df = spark.createDataFrame([(dataset_id, None, None)], "dataset_id long, source string, target string")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id") \
        .parquet(f"{root}/overrides")


def read_overrides(spark: SparkSession, root: str, dataset_id: int) -> dict[str, str]:
    """CAT-3: the override map of a dataset, ordered by source column."""
    df = spark.read.parquet(f"{root}/overrides").where(
        (F.col("dataset_id") == dataset_id) & F.col("source").isNotNull())
    row = df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "target"))))).first()
    return dict(row[0] or {})


def audit_append(spark: SparkSession, root: str, events: DataFrame, batch: str | None = None) -> None:
    """SNK-5: append a batch of audit events with their whole free-text detail.  ``batch`` names
    the call (by default a checksum of the events): a repeated one, as in a retried job,
    replaces its own events only."""
    if batch is None:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in events.columns]).cast("decimal(38,0)")
        batch = "events-" + "-".join(map(str, events.agg(F.count(F.lit(1)), F.sum(row)).first()))
    write_parts(events.withColumn("batch", F.lit(batch)), f"{root}/audit", "batch")


def audit_shown(events: DataFrame, chars: int = AUDIT_DETAIL_CHARS) -> DataFrame:
    """Audit events as shown in a list: the detail is cut to ``chars`` characters."""
    return events.withColumn("detail", F.substring("detail", 1, chars))


def preview(df: DataFrame, order_by: str = "_pos", n: int = PREVIEW_ROWS) -> DataFrame:
    """SNK-6: the first rows as JSON records (ISO dates).  Rows are ordered by position
    where the table has one, and by their whole record beyond that, so the result is
    determined."""
    data = [c for c in df.columns if not c.startswith("_")]
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in data]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    place = [F.col(order_by)] if order_by in df.columns else []
    return df.select(*place, record.alias("record")).orderBy(*place, "record").limit(n).select("record")


# ---------------------------------------------------------------------------
# Test-file exporters (derive upload files from the driver tables)


def export_csv(df: DataFrame, path: str, charset: str = "UTF-8") -> None:
    """Write a frame as CSV files with a header row in the given charset."""
    df.write.mode("overwrite").option("header", True).option("encoding", charset).csv(path)


def _xlsx_bytes(header: list[str], rows: list[list], dates: set[int] = frozenset()) -> bytes:
    """A workbook of text cells; columns in ``dates`` hold serial numbers with a date format."""
    def ref(i: int, r: int) -> str:
        letters = ""
        i += 1
        while i:
            i, rem = divmod(i - 1, 26)
            letters = chr(65 + rem) + letters
        return f"{letters}{r}"

    def cell(v, i: int, r: int) -> str:
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return ""
        if i in dates and r > 1:
            return f'<c r="{ref(i, r)}" s="1"><v>{v}</v></c>'
        return f'<c r="{ref(i, r)}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    body = "".join(f'<row r="{n}">{"".join(cell(v, i, n) for i, v in enumerate(r))}</row>'
                   for n, r in enumerate([header, *rows], start=1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel_ns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/'
                   'content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.'
                   'relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName='
                   '"/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.'
                   'sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/'
                   'vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/'
                   'package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/'
                   'officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/>'
                                    '<xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook {ns} {rel_ns}><sheets>'
                                      '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/'
                   'package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/'
                   'officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><worksheet {ns}><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()


def export_lines(lines: DataFrame, folder: str, header: str) -> None:
    """Write text lines (column ``value``) as .csv files that each begin with ``header``."""
    def with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [header]})
        yield from batches

    staged = f"{folder}.txt"
    lines.mapInPandas(with_header, "value string").write.mode("overwrite").text(staged)
    jvm, conf = lines.sparkSession._jvm, lines.sparkSession._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, folder))
    fs = source.getFileSystem(conf)
    fs.delete(target, True)
    fs.rename(source, target)
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(target, name.removesuffix(".txt") + ".csv"))


def export_workbooks(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Write .xlsx workbooks of at most ``rows_per_file`` rows into a shared folder (replaced as a
    whole), a path or URI of any file system that Arrow knows.  Dates are date cells, all else is text."""
    header = df.columns
    dates = {i for i, (_, kind) in enumerate(df.dtypes) if kind in ("date", "timestamp", "timestamp_ntz")}

    def serial(c: str) -> Column:
        moment = F.col(f"`{c}`").cast("timestamp_ntz")
        seconds = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
        return (F.datediff(moment, F.lit("1899-12-30").cast("date")) + seconds / 86400).cast("string")

    cols = [(serial(c) if i in dates else F.col(f"`{c}`").cast("string")).alias(c) for i, c in enumerate(header)]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        from pyarrow import fs
        from pyspark import TaskContext
        uri = re.sub("^file:/+", "file:///", path)
        system, folder = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), path)
        system.create_dir(folder, recursive=True)
        held: list[list] = []
        done = 0

        def flush() -> pd.DataFrame:
            nonlocal held, done
            # named by partition and number: a retried task overwrites its files, never doubles them
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{done:05d}.xlsx"
            with system.open_output_stream(name) as out:
                out.write(_xlsx_bytes(header, held, dates))
            written, held, done = len(held), [], done + 1
            return pd.DataFrame({"file": [name], "rows": [written]})

        for pdf in batches:
            for r in pdf[header].itertuples(index=False):
                held.append([None if pd.isna(v) else v for v in r])
                if len(held) >= rows_per_file:
                    yield flush()
        if held:
            yield flush()

    # files of an earlier export go, as in any overwrite
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    df.select(*cols).mapInPandas(write, "file string, rows long").agg(F.sum("rows")).collect()
