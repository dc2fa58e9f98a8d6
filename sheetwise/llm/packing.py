"""Packing by power-of-two decomposition.

A document of n tokens is cut into full sequences of ``max_len`` (itself a power of
two) and one piece for every binary digit of the rest, longest first.  A piece is a
sequence of its own: no sequence crosses documents, and as every length is a power of
two nothing is padded.  Sequences of one length form a bucket, from which batches of
equal length are drawn.

The work is one narrow pass: no shuffle, and one document in memory at a time beside
the Arrow batch (whose size Spark bounds in bytes).

Defined cases: a null text is an empty one and yields the end token alone; repeated
rows yield their pieces again, with sequence ids of their own; an empty table yields no
piece; a null ``doc_id`` stays null; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import tidy
from sheetwise.llm.encoding import encoder

_FLUSH_BYTES = 8 << 20


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: full sequences, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, max_len: int = 1024, end_id: int = 0,
         id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Sequences ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket)``.

    ``ids`` are little-endian unsigned 32-bit token ids, ``start`` the number of the
    document's ids before the piece, ``doc_tokens`` all ids of the document with the end
    token.  ``sequence_id`` is unique and stays the same when a task is run again, since
    it depends on the input split and the position in it only.
    """
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long"

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            id_type = batch.schema.field(0).type
            out: list[tuple] = []
            size = 0
            for doc_id, doc in zip(batch.column(0), batch.column(1)):
                body = doc.as_py()
                ids = np.append(encode(body) if body else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                start = 0
                for length in piece_lengths(len(ids), max_len):
                    out.append((doc_id.as_py(), start, length, ids[start:start + length].tobytes(), len(ids)))
                    start += length
                    size += 4 * length + 64
                    if size > _FLUSH_BYTES:
                        yield _batch(out, id_type)
                        out, size = [], 0
            if out:
                yield _batch(out, id_type)

    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)
    return (pieces.withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long"))
            .withColumn("bucket", F.col("length")))


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      ["doc_id", "start", "length", "ids", "doc_tokens"])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences with one folder per length (a bucket), ready for batches of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)
