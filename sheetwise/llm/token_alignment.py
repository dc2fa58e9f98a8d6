"""Alignment of two tokenizers by diagonal run skipping.

Each text is encoded by a byte-level BPE file (A) and a SentencePiece model (B); both token
sequences cover the same bytes, a space and the text.  Byte offsets at which tokens of both
end cut them into *groups*; tokens of both that share a byte are *linked*.

*Diagonal run skipping.*  With the arrays of token ends, a stretch of one-to-one groups is a
run of equal ends along a diagonal: A's token i with B's token i + shift.  From the current
places the run is probed in slices of 1, 2, 4, ... ends until one differs, and its end is
found by halving within the last slice.  What stops the run is an irregular group: its few
tokens are merged until ends are equal again, the links are noted on the way, and the shift is
updated.  Work is one slice comparison for each doubling along regular stretches and one step
a token in irregular groups.

*Counts.*  A link pair's count is the number of documents that hold it.  Documents are packed
into blocks of bounded text size, in the task that reads them.  A block is one row of a written
table: its documents' figures, its distinct pairs with the number of its documents that
hold them, and each document's links as indexes into them.  Pairs are summed over blocks, marked
if no pair of the same A id has more documents, and go back to the blocks that hold them, so
what is shuffled is a row for each block and distinct pair, not one for each document and pair.

Defined cases: null and empty texts, and those that either tokenizer does not reproduce, have no
tokens (zeros and an empty digest); strings of special tokens are ordinary text; repeated rows are documents
of their own; null ids stay null; an empty table gives an empty result; further columns are not
read.  A text is aligned whole, in the memory of one worker.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import save, tidy
from sheetwise.llm.encoding import encoder

BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 20_000
_CHECKED = 1 << 20  # ids checked at a time

Groups = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


# --- token bytes ---------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 letters
    stand for themselves, the other bytes for U+0100 onwards in ascending order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def byte_level_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level `tokenizers` file; an entry with other letters is its UTF-8."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    letters = _byte_letters()
    vocabulary = found["model"]["vocab"] | {t["content"]: t["id"] for t in found.get("added_tokens", [])}
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return out


@functools.lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=4)
def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a SentencePiece model."""
    model = _pieces(path)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())]


# --- alignment -----------------------------------------------------------------------

def run_length(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from ``a[i]`` on equal those from ``b[j]`` on, by doubling slices and halving."""
    start, step = i, 1
    stop = i + min(len(a) - i, len(b) - j)
    while i + step <= stop and a[i:i + step] == b[j:j + step]:
        i += step
        j += step
        step *= 2
    while step > 1:
        step //= 2
        if i + step <= stop and a[i:i + step] == b[j:j + step]:
            i += step
            j += step
    return i - start


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Groups:
    """For ascending ends over the same bytes: which tokens of A and of B are the last of their
    group, and the linked tokens as two arrays of places (grouped by kind, not in order)."""
    a, b = ends_a.tolist(), ends_b.tolist()
    n = len(a)
    run_a, run_b, run_n = [], [], []
    first_a, last_a, first_b, last_b = [], [], [], []
    link_a, link_b = [], []
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            m = run_length(a, b, i, j)
            run_a.append(i)
            run_b.append(j)
            run_n.append(m)
            i += m
            j += m
            if i == n:
                break
            x, y = a[i], b[j]
        first_a.append(i)
        first_b.append(j)
        while x != y:
            link_a.append(i)
            link_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        link_a.append(i)
        link_b.append(j)
        last_a.append(i)
        last_b.append(j)
        i += 1
        j += 1

    def ends_group(size: int, first: list[int], last: list[int]) -> np.ndarray:
        first, last = np.array(first, np.int64), np.array(last, np.int64)
        return np.cumsum(np.bincount(first, minlength=size) - np.bincount(last, minlength=size)) == 0

    at_a, at_b, size = (np.array(x, np.int64) for x in (run_a, run_b, run_n))
    along = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return (ends_group(n, first_a, last_a), ends_group(len(b), first_b, last_b),
            np.concatenate([np.repeat(at_a, size) + along, np.array(link_a, np.int64)]),
            np.concatenate([np.repeat(at_b, size) + along, np.array(link_b, np.int64)]))


class _Table:
    """Bytes of all ids in one array."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(t) for t in entries])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def spells(self, ids: np.ndarray, wanted: np.ndarray) -> bool:
        """Whether the joined bytes of the ids are ``wanted``."""
        done = 0
        for at in range(0, len(ids), _CHECKED):
            some = ids[at:at + _CHECKED]
            sizes = self.sizes[some]
            n = int(sizes.sum())
            place = np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)
            if done + n > len(wanted) or not np.array_equal(self.flat[place], wanted[done:done + n]):
                return False
            done += n
        return done == len(wanted)


class Aligner:
    """Both tokenizers, and the alignment of a whole text."""

    def __init__(self, a_path: str, a_ranks: str | None, b_path: str):
        self.encode_a, self.encode_b = encoder(a_path, a_ranks), _pieces(b_path).encode
        self.bytes_a, self.bytes_b = byte_level_bytes(a_path), piece_bytes(b_path)
        self.table_a, self.table_b = _Table(self.bytes_a), _Table(self.bytes_b)
        # each id with what follows it in the written groups, inside a group and at its end, filled up with NUL
        self.written = np.array([b"%d%s" % (i, sep) for table, seps in ((self.bytes_a, (b",", b"|")), (self.bytes_b, (b",", b";")))
                                 for i in range(len(table)) for sep in seps])

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None if there are none or one doesn't reproduce the text."""
        if not text:
            return None
        data = b" " + text.encode()
        a, b = self.encode_a(" " + text).astype(np.int64), np.array(self.encode_b(text), np.int64)
        wanted = np.frombuffer(data, np.uint8)
        return (a, b) if self.table_a.spells(a, wanted) and self.table_b.spells(b, wanted) else None

    def groups(self, a: np.ndarray, b: np.ndarray) -> Groups:
        return align(np.cumsum(self.table_a.sizes[a]), np.cumsum(self.table_b.sizes[b]))

    def digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """SHA-256 of the groups, written as ``a1,a2|b1;a3|b2,b3``."""
        behind_a, behind_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, behind_b)[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + behind_a[group_b]] = 2 * (len(self.bytes_a) + b) + last_b
        return hashlib.sha256(self.written[order].tobytes().translate(None, b"\0")[:-1]).hexdigest()


# --- over a corpus ---------------------------------------------------------------------

_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.astype("<i4").tobytes() for a in arrays))


def _block(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """One row from ``(doc_id, figures, digest, pairs, times)`` of documents."""
    sizes = np.array([len(r[3]) for r in rows])
    joined = np.concatenate([r[3] for r in rows])
    pairs, at, docs = np.unique(joined, return_inverse=True, return_counts=True)
    cells = [pa.array([[r[0] for r in rows]], pa.list_(id_type)), *(pa.array([[r[1][i] for r in rows]], pa.list_(pa.int64())) for i in range(4)),
             pa.array([[r[2] for r in rows]], pa.list_(pa.string())), pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64())),
             pa.array([_pack(sizes, at, np.concatenate([r[4] for r in rows]))], pa.binary())]
    return pa.RecordBatch.from_arrays(cells, ["doc_id", *_FIGURES, "groups_sha256", "pairs", "docs", "links"])


def blocks(docs: DataFrame, a_path: str, a_ranks: str | None, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in blocks, one row each (see the module's text)."""
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, a_ranks, b_path)
        wide = len(aligner.bytes_b)
        rows: list[tuple] = []
        size = 0
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, cell in zip(batch.column(0), batch.column(1)):
                body = cell.as_py()
                found = aligner.tokens(body)
                if found is None:
                    rows.append((doc_id.as_py(), (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                else:
                    a, b = found
                    last_a, last_b, at_a, at_b = aligner.groups(a, b)
                    pairs, times = np.unique(a[at_a] * wide + b[at_b], return_counts=True)
                    rows.append((doc_id.as_py(), (len(a), len(b), int(last_a.sum()), len(at_a)), aligner.digest(a, b, last_a, last_b), pairs, times))
                size += len(body or "")
                if size > BLOCK_BYTES or len(rows) >= BLOCK_DOCS:
                    yield _block(rows, id_type)
                    rows, size = [], 0
        if rows:
            yield _block(rows, id_type)

    longs = ", ".join(f"{c} array<long>" for c in _FIGURES)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        pack, f"doc_id array<{kind}>, {longs}, groups_sha256 array<string>, pairs array<long>, docs array<long>, links binary")


def pair_counts(packed: DataFrame, wide: int) -> DataFrame:
    """Rows ``(pair, docs, best)``: a linked pair (``A id * wide + B id``), the number of documents
    that hold it, and whether no pair of that A id has more."""
    counts = (packed.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair"))
              .agg(F.sum("p.docs").alias("docs")).withColumn("a", F.expr(f"pair div {wide}")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, a_ranks: str | None, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    wide = len(piece_bytes(b_path))
    packed = save(blocks(docs, a_path, a_ranks, b_path, id_col, text).withColumn("block", F.monotonically_increasing_id()))
    counts = save(pair_counts(packed, wide))
    back = (packed.select("block", F.explode("pairs").alias("pair")).join(counts, "pair")
            .groupBy("block").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("c"))
            .select("block", "c.pair", F.col("c.docs").alias("count"), "c.best"))

    @tidy
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name: batch.column(name)[r].values  # noqa: B023, E731
                links = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("links")[r].as_py()), "<i4").astype(np.int64)
                ids = cell("doc_id")
                n = len(ids)
                sizes, rest = links[:n], links[n:]
                at, times = rest[:len(rest) // 2], rest[len(rest) // 2:]
                if len(at):
                    order = np.argsort(cell("pair").to_numpy())
                    count, best = cell("count").to_numpy()[order][at], cell("best").to_numpy(zero_copy_only=False)[order][at]
                else:
                    count, best = at, at
                ends = np.cumsum(sizes)
                sums = []
                for values in (times * best, times * count):
                    running = np.append(0, np.cumsum(values))
                    sums.append(pa.array(running[ends] - running[ends - sizes], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(cell(c) for c in _FIGURES), *sums, cell("groups_sha256")],
                                                 ["doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256"])

    longs = ", ".join(f"{c} long" for c in (*_FIGURES, "n_best", "count_sum"))
    return packed.drop("pairs", "docs").join(back, "block", "left").mapInArrow(unpack, f"doc_id {kind}, {longs}, groups_sha256 string")
