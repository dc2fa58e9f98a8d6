"""Uploaded files as DataFrames (SRC-1 .. SRC-4).

* CSV folders: charset and header line of every file are decided on Spark
  (``read.text`` + ``is_valid_utf8``), then one CSV scan per charset and header reads
  every column as text (``inferSchema`` off: ids keep their leading zeros).  Quoted
  newlines and doubled quotes are part of a value or of a column's name; repeated and blank
  names are numbered.  A file that no charset decodes is an error.
* Workbooks (.xlsx): ``binaryFile`` + ``mapInPandas``; each task opens its own
  workbooks with the standard library (zip + XML) and hands rows on as they are parsed;
  workbooks are read in parallel and never pass through the driver.
* Landing manifest: ``binaryFile`` metadata (path, length) plus a line count,
  with the reference's acceptance rules as predicates.

Bronze rows carry ``_file`` and ``_pos`` (position inside the file) so that
"first appearance" semantics survive a distributed read.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.operators.cleaning import MISSING_TOKENS

# Accepted extensions and the upload size limit (20 MB).
ALLOWED_EXTENSIONS = (".csv", ".xlsx")
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
# Charsets tried in order; the first that decodes the whole file wins.
CHARSETS = ("UTF-8", "GBK")


@dataclass(frozen=True)
class CsvGroup:
    """Files that one scan may read together: the same charset and the same header record."""

    charset: str
    header: tuple[str, ...]
    files: tuple[str, ...]


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, charset, head): the first of ``CHARSETS`` that decodes every line of the file, NULL if
    none does; ``head`` is the raw header record in hexadecimal.

    A header record goes on over further lines while a quote is open: up to the next line with
    an odd number of quotes.  (An unclosed quote leaves the first line.)
    """
    text = F.decode("line", "ISO-8859-1")  # a character for each byte
    lines = (spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.[cC][sS][vV]").text(path)
             .select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").cast("binary").alias("line"),
                     F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"))
             .withColumn("odd", (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1))
    per_file = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(F.col("line"))).alias("utf8"),
        # a byte that GBK doesn't have comes back as another one
        F.bool_and(F.encode(F.decode("line", CHARSETS[1]), CHARSETS[1]) == F.col("line")).alias("gbk"),
        F.min(F.struct("place", "line", "odd")).alias("first"))
    opened = per_file.where("first.odd").select("file", F.col("first.place").alias("start"))
    closed = (lines.where("odd").join(opened, "file").where(F.col("place") > F.col("start"))
              .groupBy("file").agg(F.min("place").alias("end")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.hex("line").alias("hex")))), lambda x: x["hex"]), "0A")
    records = lines.join(closed, "file").where(F.col("place") <= F.col("end")).groupBy("file").agg(joined.alias("record"))
    charset = F.when(F.col("utf8"), CHARSETS[0]).when(F.col("gbk"), CHARSETS[1])
    return per_file.join(records, "file", "left").select("file", charset.alias("charset"), F.coalesce("record", F.hex("first.line")).alias("head"))


def file_charsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, charset) of every file; NULL where no charset decodes it."""
    return file_heads(spark, path).select("file", "charset")


def header_names(head: str, charset: str) -> tuple[str, ...]:
    """Column names of a raw header record: blanks and repeats as in ``unique_headers``."""
    record = bytes.fromhex(head).decode(charset).removeprefix("\ufeff").rstrip("\r")
    cells = next(csv.reader(io.StringIO(record, newline="")), [])
    return tuple(unique_headers([cell or None for cell in cells]))


def csv_groups(spark: SparkSession, path: str) -> list[CsvGroup]:
    """The groups of files that are read together, with their header names.  File names and
    header records are all that reaches the driver.  A file that no charset decodes is an error."""
    groups = file_heads(spark, path).groupBy("charset", "head").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    unknown = sorted(f for row in groups if row["charset"] is None for f in row["files"])
    if unknown:
        raise ValueError(f"no charset of {', '.join(CHARSETS)} decodes {', '.join(unknown)}")
    return sorted((CsvGroup(row["charset"], header_names(row["head"], row["charset"]), tuple(row["files"])) for row in groups),
                  key=lambda g: (g.charset, g.files))


def read_csv_group(spark: SparkSession, group: CsvGroup) -> DataFrame:
    """SRC-1 + SRC-3 for files of one charset and header; an empty tail of a file is no row."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in group.header])
    df = (spark.read.schema(schema).option("header", True).option("encoding", group.charset)
          .option("multiLine", True).option("quote", '"').option("escape", '"').csv(list(group.files)))
    return tokens_to_null(df.withColumns({
        "_file": F.col("_metadata.file_path"),
        "_pos": F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())}))


def read_csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 + SRC-3: every CSV file of a folder as text columns, tokens -> NULL.

    Files with other headers are read apart and brought together by column name.
    """
    out = None
    for group in csv_groups(spark, path):
        part = read_csv_group(spark, group)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], "_file string") if out is None else out


def tokens_to_null(df: DataFrame) -> DataFrame:
    """SRC-3 on the text columns of a bronze frame (``_file`` / ``_pos`` untouched)."""
    meta = [c for c in ("_file", "_pos") if c in df.columns]
    return df.select(*meta, *[
        F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`")
        for c, kind in df.dtypes if c not in meta])


# ---------------------------------------------------------------------------
# Workbooks

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


# Built-in number formats that show dates or times; others say so by their letters.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _is_date_format(code: str) -> bool:
    """Whether a format code has a date or time part outside of quotes, brackets and escapes."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code)
    elapsed = re.search(r"\[[hms]+\]", plain, re.I)
    return bool(elapsed or re.search("[ymdhs]", re.sub(r"\[[^\]]*\]", "", plain), re.I)) and plain.lower() != "general"


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    """For each cell style of a workbook: does it show dates?"""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): _is_date_format(f.get("formatCode") or "") for f in root.iter(f"{{{_NS['m']}}}numFmt")}
    formats = [int(xf.get("numFmtId") or 0) for xf in root.findall("m:cellXfs/m:xf", _NS)]
    return [own.get(n, n in _DATE_FORMATS) for n in formats]


def date_text(serial: str, epoch_1904: bool) -> str:
    """A date cell's serial number as text; a number below one is a time of day."""
    days = float(serial)
    start = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30 if days >= 60 else 31)
    moment = start + timedelta(seconds=round(days * 86400))
    return moment.strftime("%H:%M:%S") if 0 <= days < 1 else moment.strftime("%Y-%m-%d %H:%M:%S")


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first worksheet of an .xlsx file as text, row by row.  Cells with a date
    format are dates (ISO text), booleans True or False; other numbers are as stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        dates = _date_styles(z)
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        properties = book.find("m:workbookPr", _NS)
        epoch_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        first = book.find("m:sheets/m:sheet", _NS)
        target = "xl/worksheets/sheet1.xml"
        if first is not None and "xl/_rels/workbook.xml.rels" in z.namelist():
            rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            rid = first.get(_REL)
            for rel in rels:
                if rel.get("Id") == rid:
                    t = rel.get("Target").lstrip("/")
                    target = t if t.startswith("xl/") else f"xl/{t}"
        for _, row in ElementTree.iterparse(z.open(target)):
            if row.tag != f"{{{_NS['m']}}}row":
                continue
            cells: dict[int, str | None] = {}
            last = -1
            for c in row.findall("m:c", _NS):
                kind = c.get("t")
                if kind == "inlineStr":
                    node = c.find("m:is", _NS)
                    value = "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t")) if node is not None else None
                else:
                    v = c.find("m:v", _NS)
                    value = v.text if v is not None else None
                    style = int(c.get("s") or 0)
                    if value is None:
                        pass
                    elif kind == "s":
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "True" if value == "1" else "False"
                    elif kind in (None, "n") and style < len(dates) and dates[style]:
                        value = date_text(value, epoch_1904)
                ref = c.get("r")
                last = _col_index(ref) if ref else last + 1  # the reference is optional
                cells[last] = value
            width = max(cells) + 1 if cells else 0
            row.clear()
            yield [cells.get(i) for i in range(width)]


def parse_first_sheet(content: bytes) -> list[list[str | None]]:
    """All rows of ``sheet_rows``."""
    return list(sheet_rows(content))


def unique_headers(cells: list[str | None]) -> list[str]:
    """Header names: blanks are numbered by column, a repeated name gets .1, .2, ... (the
    first such name that is free)."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = base = cell if cell is not None else f"Unnamed: {i}"
        n = 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


_SHEET_ROWS = 5_000  # rows handed on at a time


def _workbook_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "pos", "header", "cells"]
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"]):
            rows = sheet_rows(bytes(content))
            first = next(rows, None)
            if first is None:
                continue
            header = unique_headers(first)
            for pos, r in enumerate(rows):
                out.append((path, pos, header, [r[i] if i < len(r) else None for i in range(len(header))]))
                if len(out) >= _SHEET_ROWS:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: rows of the first sheet of every workbook, long form
    ``(file, pos, header array, cells array)``; one task parses its own files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(
        _workbook_rows, "file string, pos long, header array<string>, cells array<string>")


def workbook_header(rows: DataFrame) -> list[str]:
    """The header names of all workbooks, in the order of columns where they first appear (by file
    and column).  Header-sized: one row for each different header reaches the driver."""
    first = rows.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").collect()
    return list(dict.fromkeys(name for row in first for name in row["header"]))


def workbook_frame(rows: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Long workbook rows -> a wide text frame with the given header, or with all names of the
    workbooks' own headers (tokens -> NULL)."""
    header = workbook_header(rows) if header is None else header
    cells = [F.element_at("cells", F.array_position("header", F.lit(h)).cast("int")) for h in header]
    wide = rows.select(F.struct("file", "pos").alias("_pos"),
                       *[F.when(F.array_contains("header", F.lit(h)), c).alias(h) for h, c in zip(header, cells)])
    return tokens_to_null(wide)


# ---------------------------------------------------------------------------
# Landing manifest


def plain_path(path: Column, encoded: bool = True) -> Column:
    """A path in one form: scan metadata has URL-encoded paths, ``binaryFile`` plain ones, and they
    may differ in the slashes behind the scheme."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(plain, "^([A-Za-z0-9]+):/+", "$1:/")


def landing_manifest(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """SRC-4: one row per landed file with the acceptance decision.

    Rules (first failing wins): extension, empty file, size limit, charset, no data row.
    The charset and data-row checks (non-blank text lines: header + 1) are for CSV files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", plain_path(F.col("path"), encoded=False).alias("_plain"), "length")
    lines = (spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text(path).select(plain_path(F.col("_metadata.file_path")).alias("_plain"), "value")
             .where(F.length(F.trim("value")) > 0).groupBy("_plain").agg(F.count(F.lit(1)).alias("lines")))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    charsets = file_charsets(spark, path).select(F.col("file").alias("_plain"), "charset")
    m = files.join(lines, "_plain", "left").join(charsets, "_plain", "left")
    has_rows = F.when(ext == ".csv", F.coalesce(F.col("lines"), F.lit(0)) >= 2).otherwise(F.lit(True))
    reason = (F.when(~ext.isin(*ALLOWED_EXTENSIONS), "unsupported_extension")
              .when(F.col("length") == 0, "empty_file")
              .when(F.col("length") > max_bytes, "too_large")
              .when((ext == ".csv") & F.col("charset").isNull(), "undecodable")
              .when(~has_rows, "no_data_rows"))
    return m.select("path", "length", ext.alias("extension"), reason.isNull().alias("valid"),
                    reason.alias("reject_reason"))
