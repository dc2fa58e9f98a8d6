"""Document fingerprints: a quartile bucket digest.

Byte triplets - the newest byte of a window of twelve and two earlier ones, in three
spacings - are hashed into 512 buckets and counted over the whole text (padded with zero
bytes on both sides, so that short texts have windows too).  Spaced triplets vary more
than adjacent ones, so texts of one language differ more.  The digest holds two bits per bucket - which quartile
of all bucket counts its count lies in -, the logarithm of the length and the ratios of the
quartiles.  Two digests differ by the bucket steps (the widest step counts double), the
length and the ratios; every part is bounded, and so is the score: 0 differences give
likeness 1, as many as unrelated digests have on average, or more, give 0.

Defined cases: a null text is an empty one; its digest is that of no bytes; equal texts
have equal digests; repeated rows keep one row each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sheetwise.llm.common import parallelism, tidy

BUCKETS = 512
WINDOW = 11
_CHUNK = 1 << 20
# Distances of the two earlier bytes from the newest.
TRIPLETS = ((3, 7), (4, 9), (5, 11))
# Mean step difference per bucket of independent digests: quartile steps 0..3, 3 counted as 6.
_UNRELATED = 26 / 16
_STEPS = np.array([0, 1, 2, 6])


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed byte triplets of a whole text."""
    padded = np.frombuffer(b"\0" * WINDOW + data + b"\0" * WINDOW if data else b"", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(padded) - WINDOW), _CHUNK):
        part = padded[at:at + _CHUNK + WINDOW].astype(np.uint32)
        n = len(part) - WINDOW
        newest = part[WINDOW:] * np.uint32(0x9E3779B1)
        for salt, (i, j) in enumerate(TRIPLETS):
            h = newest + part[WINDOW - i:WINDOW - i + n] * np.uint32(0x85EBCA77) + part[WINDOW - j:WINDOW - j + n] * np.uint32(0xC2B2AE3D)
            h += np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(23), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """Hex digest: length byte, ratio byte, two bits per bucket."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    steps = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(8 * math.log2(1 + len(data))))
    ratios = (int(16 * q1 // q3) % 16 << 4 | int(16 * q2 // q3) % 16) if q3 else 0
    pairs = steps.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return bytes([length, ratios]).hex() + pairs.sum(axis=1).astype(np.uint8).tobytes().hex()


def _steps(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8)
    return (raw[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).astype(np.int64).ravel()


def likeness(a: str, b: str) -> float:
    """Bounded likeness of two digests, 0 to 1; 1 for equal digests."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    buckets = int(_STEPS[np.abs(_steps(x[2:]) - _steps(y[2:]))].sum())
    length = min(32, abs(x[0] - y[0]))

    def around(p: int, q: int) -> int:  # ratios are kept modulo 16
        return min((p - q) % 16, (q - p) % 16)

    ratios = around(x[1] >> 4, y[1] >> 4) + around(x[1] & 15, y[1] & 15)
    return max(0.0, 1.0 - (buckets + length + ratios) / (_UNRELATED * BUCKETS))


def fingerprint(text: Column) -> Column:
    """Digest of a text column."""

    @F.pandas_udf("string")
    @tidy
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: digest((t or "").encode())).astype(object)

    return of(text)


def score(a: Column, b: Column) -> Column:
    """Likeness of two digest columns; null if either is null."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else likeness(u, v) for u, v in zip(x, y)], dtype="float64")

    return of(a, b)


# --- a text against its neighbour's ------------------------------------------------------------

def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``other``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + other[:cut]


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digest against those of its edited text and of the next document, in
    descending order of the id (null ids last; equal ids by the SHA-256 of the text; after
    the last comes the first): ``(doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)``.

    Id ranges of about equal size are found from the ids alone.  Texts then move once,
    compressed, to the task of their range and are read in order there, two at a time in
    memory.  The first document of a range goes to the end of the range before as well, so no
    task needs another's rows.
    """
    import bisect

    spark = docs.sparkSession
    n = parallelism(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    # four ranges for each task even out the hash of range numbers
    cuts = ids.agg(F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 40 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    last = len(cuts) + 1

    def range_of(doc_id: int | None) -> int:
        return last if doc_id is None else len(cuts) - bisect.bisect_right(cuts, doc_id)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int | None] = {}
        for batch in batches:
            for doc_id in batch.column(0).to_pylist():
                r = range_of(doc_id)
                best[r] = doc_id if best.get(r) is None else max(best[r], doc_id)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["r", "top"])

    # one row for each range: as many as tasks, whatever the size of the input
    top = {r.r: r.top for r in ids.mapInArrow(tops, "r long, top long").groupBy("r").agg(F.max("top").alias("top")).collect()}
    order = sorted(top)
    before = {r: order[i - 1] for i, r in enumerate(order)}

    @tidy
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (value.as_py() or "").encode()
                r = range_of(doc_id)
                row = (doc_id, hashlib.sha256(data).digest(), digest(data), zip_.compress(data))
                out.append((r, False, *row))
                if doc_id == top[r]:
                    out.append((before[r], True, *row))
            yield _rows(out, (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.binary()),
                        ["r", "guest", "doc_id", "sha", "fp", "packed"])

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        held = None  # the document that waits for its next one
        for batch in batches:
            out = []
            for r, guest, doc_id, fp, packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if guest and held is None:
                    continue
                text_ = unzip.decompress(packed).decode()
                if held is not None:
                    own_id, own, own_fp = held
                    data = edited(own, text_).encode()
                    edited_fp = digest(data)
                    out.append((own_id, len(own), hashlib.sha256(data).hexdigest(), own_fp, edited_fp,
                                likeness(own_fp, edited_fp), likeness(own_fp, fp)))
                held = None if guest else (doc_id, text_, fp)
            if out:
                yield _rows(out, (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2),
                            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ranged = (docs.select(F.col(id_col).cast(LongType()).alias("doc_id"), F.col(text).alias("text"))
              .mapInArrow(prepare, "r long, guest boolean, doc_id long, sha binary, fp string, packed binary")
              .repartition(n, "r")
              .sortWithinPartitions("r", "guest", F.col("doc_id").desc_nulls_last(), "sha"))
    return ranged.select("r", "guest", "doc_id", "fp", "packed").mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")


def _rows(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
