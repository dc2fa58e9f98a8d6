"""SimHash near-duplicates by anchor-point covering.

*Fingerprint.*  A-Z is lower-cased, words are runs of non-white-space, shingles are
``shingle`` consecutive words joined by one space (repeats count; fewer words: the whole
sequence).  Bit b is set if more than half of the XXH64 values (seed 42) of the shingles
have it.  No words: fingerprint zero, linked like any other.

*Covering code.*  Fingerprint bits are split into blocks; each block has a perfect
binary code (Golay of 23 bits with radius 3, Hamming of 2^m - 1 bits with radius 1,
repetition of odd length), bits beyond the blocks are left out of the anchors.  The
anchors are the words of the product code.  Every fingerprint has one home anchor (the
nearest codeword in each block, within the covering radius) and visits every anchor
within covering radius plus threshold: block i may be off by its radius plus e_i with
e_1 + e_2 + ... <= ``max_bits``.  If x and y differ in at most ``max_bits`` bits, y
visits the home of x, so comparing the home with its visitors at each anchor misses no
link.  With two Golay blocks a fingerprint visits about 61 of 2^24 anchors.

*Components.*  Fingerprints are compared once each, however many documents share one
(copies never become pairs); links are between different fingerprints.  Alternating
star rounds, each a written table, shrink the links to stars around the smallest
fingerprint of a component, whose smallest document id is the component id.

Defined cases: null and empty texts have fingerprint zero; repeated rows keep one
row each; a null id does not count for the smallest id, and a component of null ids
only has a null component id; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import discard, parallelism, save, tidy

BITS = 64
SEED = 42
CODE = ("golay23", "golay23")
_HASHES = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate(([0], np.cumsum(size)))
    ends = (start[min(shingle, len(words)):] - 1).tolist()
    hashes = xxhash.xxh64_intdigest
    set_bits = np.zeros(BITS, np.int64)
    starts = start[:n].tolist()
    for at in range(0, n, _HASHES):
        part = np.array([hashes(joined[s:e], SEED) for s, e in zip(starts[at:at + _HASHES], ends[at:at + _HASHES])], "<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def simhash(text: Column, shingle: int) -> Column:
    """The fingerprint's 64 bits as a (signed) long."""

    @F.pandas_udf("long")
    @tidy
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return of(text)


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(doc_id, fp)``."""
    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text), shingle).alias("fp"))


# --- covering code -------------------------------------------------------------------

def _shape(name: str) -> tuple[int, int]:
    """(bits, covering radius) of a perfect code named golay23, hammingN or repetitionN."""
    if name == "golay23":
        return 23, 3
    kind, n = ("hamming", int(name[7:])) if name.startswith("hamming") else ("repetition", int(name[10:]))
    return n, 1 if kind == "hamming" else n // 2


def _columns(name: str) -> list[int]:
    """Syndrome of each single bit: the columns of the parity check matrix."""
    n, _ = _shape(name)
    if name == "golay23":  # powers of x modulo the generator polynomial x^11+x^9+x^7+x^6+x^5+x+1
        out, v = [], 1
        for _ in range(n):
            out.append(v)
            v <<= 1
            if v >> 11:
                v ^= 0b101011100011
        return out
    if name.startswith("hamming"):
        return list(range(1, n + 1))
    return [1 << i for i in range(n - 1)] + [(1 << (n - 1)) - 1]


@functools.lru_cache(maxsize=16)
def _patterns(name: str, extra: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For a block code: the columns, and per cost c <= ``extra`` a table from syndrome to
    the error patterns that lead to a codeword at distance radius + c (for c = 0: at most
    the radius).  Rows are padded with -1."""
    n, radius = _shape(name)
    cols = _columns(name)
    found: list[list[list[int]]] = [[[] for _ in range(1 << max(cols).bit_length())] for _ in range(extra + 1)]
    for weight in range(min(n, radius + extra) + 1):
        for bits in itertools.combinations(range(n), weight):
            syndrome = functools.reduce(lambda a, b: a ^ cols[b], bits, 0)
            found[max(0, weight - radius)][syndrome].append(sum(1 << b for b in bits))
    tables = []
    for of_cost in found:
        width = max(map(len, of_cost))
        tables.append(np.array([p + [-1] * (width - len(p)) for p in of_cost], np.int64).reshape(len(of_cost), width))
    return np.array(cols, np.int64), tables


def visits(fps: np.ndarray, max_bits: int, code: tuple[str, ...] = CODE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, cost) of every anchor that the fingerprints visit; cost 0 is the home."""
    value = fps.view(np.uint64)
    row = np.arange(len(fps))
    anchor = np.zeros(len(fps), np.int64)
    spent = np.zeros(len(fps), np.int64)
    shift = 0
    for name in code:
        n, _ = _shape(name)
        cols, tables = _patterns(name, max_bits)
        word = ((value >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64)
        syndrome = np.zeros(len(fps), np.int64)
        for b in range(n):
            syndrome ^= np.where(word >> b & 1, cols[b], 0)
        parts = []
        for cost, table in enumerate(tables):
            may = np.flatnonzero(spent + cost <= max_bits)
            errors = table[syndrome[row[may]]]
            i, j = np.nonzero(errors >= 0)
            at = may[i]
            parts.append((row[at], anchor[at] | ((word[row[at]] ^ errors[i, j]) << shift), spent[at] + cost))
        row, anchor, spent = (np.concatenate(x) for x in zip(*parts))
        shift += n
    return row, anchor, spent


def near_links(fps: DataFrame, max_bits: int, code: tuple[str, ...] = CODE) -> DataFrame:
    """Links ``(a, b)``, a < b, of all pairs of the distinct values ``fp`` that differ in at
    most ``max_bits`` bits."""
    if sum(_shape(name)[0] for name in code) > 63:
        raise ValueError("the blocks of the code must leave an anchor of at most 63 bits")

    spread = fps.select("fp").repartition(parallelism(fps.sparkSession), "fp")

    def at_anchors(extra: int, name: str) -> DataFrame:
        @tidy
        def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every = batch.column(0).to_numpy()
                for at in range(0, len(every), 4096):
                    part = np.ascontiguousarray(every[at:at + 4096])
                    row, anchor, _ = visits(part, extra, code)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], ["anchor", name])

        return spread.mapInArrow(replicate, f"anchor long, {name} long")

    # a pair meets once at the home of a: b visits an anchor at most once.  Spark takes the visits for as
    # many as the fingerprints and would broadcast either side by that, so the join is told to shuffle.
    return (at_anchors(0, "a").hint("merge").join(at_anchors(max_bits, "b").hint("merge"), "anchor")
            .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
            .select("a", "b"))


# --- components ------------------------------------------------------------------------

def stars(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` of every node of ``links`` ``(a, b)`` that is not the smallest
    of its component, by alternating large-star and small-star rounds."""
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u <> v").distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = save(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least_below = save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least_below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = save(small.unionByName(least_below.select("u", F.col("m").alias("v")))
                     .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                     .filter("u <> v").distinct())
        for old in (edges, least, large, least_below):
            discard(old)
        edges, before, state = after, state, _state(after)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of the links: equal states mean a settled round."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.bit_xor(F.hash("v", "u")).alias("y")).first()
    return row.n, row.x, row.y


def components(docs: DataFrame, shingle: int, max_bits: int, code: tuple[str, ...] = CODE,
               id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``(doc_id, fp, root, component_id)``; ``root`` is the smallest
    fingerprint of the component."""
    fps = save(fingerprints(docs, shingle, id_col, text))
    nodes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    root_of = stars(near_links(nodes, max_bits, code))
    of_root = save(nodes.join(root_of, nodes.fp == root_of.node, "left")
                   .select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    least = save(of_root.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = save(of_root.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int, max_bits: int, code: tuple[str, ...] = CODE,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``(doc_id, fp, component_id)``."""
    return components(docs, shingle, max_bits, code, id_col, text).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component left: the row with the smallest id.

    Only ids are grouped; texts move once, in the semi-join with the winners.  Where the
    smallest id is null or repeated it doesn't name one row; the rows with such ids are
    fingerprinted again and one row of each component is taken.
    """
    found = save(components(docs, shingle, max_bits, id_col=id_col, text=text))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    winners = save(found.filter("doc_id <=> component_id").select("doc_id", "root").distinct()
                   .join(ids.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")))
                   .select(F.col("doc_id").alias("_winner"), "root", ((F.col("n") == 1) & F.col("doc_id").isNotNull()).alias("named")))
    kept = docs.join(winners.filter("named").select("_winner"), F.col(id_col) == F.col("_winner"), "left_semi")
    if winners.filter("not named").limit(1).count() == 0:
        return kept
    odd = docs.join(winners.filter("not named").select("_winner").distinct(),
                    F.col(id_col).eqNullSafe(F.col("_winner")), "left_semi")
    roots = (found.filter("doc_id <=> component_id").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"),
                                                           F.col("component_id").alias("_winner")).distinct())
    one = (odd.withColumn("_fp", simhash(F.col(text), shingle)).join(roots, "_fp")
           .filter(F.col(id_col).eqNullSafe(F.col("_winner"))).dropDuplicates(["_root"]))
    return kept.unionByName(one.drop("_fp", "_root", "_winner"))
