"""Removal of repeated byte strings with suffix arrays.

Every byte of a document (UTF-8) that lies in a string of ``length`` bytes which also starts
anywhere else, in the same document or in another, is removed.  Matches never cross documents.

*Suffix arrays.*  A shard is a bounded set of pieces of text.  Its suffixes are sorted by
Larsson-Sadakane refinement: after a first sort by eight bytes, only groups of equal suffixes
are sorted again, by the rank of the suffix that follows after 8, 16, 32, ... bytes.  Common
prefixes come by Kasai's rule in its vector form: a suffix that is preceded by the same byte as
its neighbour has the prefix of the suffix before it less one; only the others are compared.
Strings of ``length`` bytes are equal if no shorter common prefix lies between them.

*What goes into shards.*  The string at a place has an anchor, its leftmost ``GRAM`` bytes of
smallest hash, so equal strings have equal anchors at equal distances.  Neighbouring places
mostly share an anchor and form a *piece*: the bytes of all strings that start there.
Anchors that occur in one piece only can't be in a repeated string; they are counted over the
corpus and left out.  Texts that are equal count once (all of a text that occurs twice is repeated),
and so do equal pieces (all strings of a piece that occurs twice are repeated).  The pieces of an
anchor lie in one shard, side by side.

*Merging shards.*  An anchor with more than ``WIDE`` pieces is dealt over many shards.  Each of
these hands on the sorted 128-bit hashes of its different strings of such anchors, cut
into ranges by binary search.  The sorted runs of a range are merged by binary search of one in the other;
strings found in two shards are repeated, and each shard's places are looked up among
them.  No task gets more than its range of hashes, however many pieces an anchor has.

Texts move twice: when they are grouped (compressed) into a table with as many buckets as
shuffle partitions, which later joins by text read without moving it, and as pieces of repeated
anchors.  Hashes that stand for equality (text, piece, string) have 128 bits.

Defined cases: null texts are empty; texts shorter than ``length`` stay whole; repeated rows are
places of their own; null ids stay null; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import parallelism, save, tidy
from sheetwise.session import checkpoint_dir

GRAM = 128
WIDE = 1_000
SHARD_BYTES = 1 << 19
RANGE_STRINGS = 1 << 17
SENTINEL = 0xFF  # no byte of UTF-8

_CHUNK = 1 << 22
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


# --- anchors ---------------------------------------------------------------------------

def gram_hashes(data: np.ndarray, length: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """Hashes of all strings of ``length`` bytes, put together from those of its binary parts."""
    power, span = data.astype(np.uint64) + np.uint64(1), 1
    out: np.ndarray | None = None
    done = 0
    while True:
        if length & span:  # the part of `span` bytes in front of the `done` last ones
            if out is None:
                out = power
            else:
                n = len(data) - done - span + 1
                out = power[:n] * _power(base, done) + out[span:span + n]
            done += span
        if span * 2 > length:
            break
        power = power[:-span] * _power(base, span) + power[span:]
        span *= 2
    out = out[:len(data) - length + 1].copy()
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    return out


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a text: hash of the anchor, first and last place of the strings that have it."""
    found: list[tuple[np.ndarray, ...]] = []
    places = len(data) - length + 1
    for at in range(0, places, _CHUNK):
        n = min(_CHUNK, places - at)
        hashes = gram_hashes(data[at:at + n - 1 + length], gram)
        low = np.uint64((1 << 24) - 1)
        anchor = (_least((hashes | low) ^ low | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        found.append((hashes[anchor[first]], at + first, at + np.append(first[1:], n) - 1))
    return tuple(np.concatenate(c) for c in zip(*found))


# --- suffix arrays -----------------------------------------------------------------------

def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes; ``ends`` has, for each place, that of the sentinel which ends its
    piece.  Suffixes that are equal up to the sentinel stay in order of place."""
    n = len(text)
    place = np.arange(n)
    room = ends - place + 1
    key = np.zeros(n, np.uint64)
    padded = np.append(text, np.zeros(8, np.uint8))
    for b in range(8):
        key = key << np.uint64(8) | np.where(b < room, padded[b:b + n], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    head = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    h = 8
    while True:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone & (room[order] > h))  # within a group either all go on or none
        if not len(slots):
            return order
        at = order[slots]
        pair = rank[at] * n + rank[at + h]
        again = np.argsort(pair, kind="stable")
        at, pair = at[again], pair[again]
        order[slots] = at
        new = np.append(True, pair[1:] != pair[:-1])
        head[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order the bytes that the suffix shares with the one before it, up to
    the end of the shorter one."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    # Kasai: if both are preceded by the same byte of the same pieces, the prefix is one shorter than there
    starts = np.append(True, text[:-1] == SENTINEL)
    follows = (before > 0) & ~starts & ~starts[before]
    follows[follows] = text[place[follows] - 1] == text[before[follows] - 1]
    own = np.flatnonzero(~follows & (before >= 0))
    x, y = own, before[own]
    limit = np.minimum(ends[x] - x, ends[y] - y)
    padded = np.append(text, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    shared = np.zeros(len(own), np.int64)
    active = np.flatnonzero(limit > 0)
    while len(active):
        differ = words[x[active] + shared[active]] != words[y[active] + shared[active]]
        some = differ.any(axis=1)
        shared[active] += np.where(some, differ.argmax(axis=1), 8)
        active = active[~some & (shared[active] < limit[active])]
    prefix = np.zeros(n, np.int64)
    prefix[own] = np.minimum(shared, limit)
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return (prefix[last] - (place - last))[order]


def repeated_in(pieces: list[tuple[bytes, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces ``(body, number of places)``: first place of each piece in the shard's text, which
    places hold a string that another place holds too, and a number for each different string
    (-1 where no string starts)."""
    text = np.frombuffer(b"".join(body + b"\xff" for body, _ in pieces), np.uint8)
    sizes = np.array([len(body) + 1 for body, _ in pieces])
    first = np.cumsum(sizes) - sizes
    ends = np.repeat(first + sizes - 1, sizes)
    counts = np.array([n for _, n in pieces])
    starts = np.arange(len(text)) - np.repeat(first, sizes) < np.repeat(counts, sizes)
    order = suffix_array(text, ends)
    prefix = common_prefixes(text, ends, order)
    number = np.empty(len(text), np.int64)
    number[order] = np.cumsum(prefix < length)
    number[~starts] = -1
    held = np.bincount(number[starts], minlength=1)
    return first, starts & (held[number] > 1), number


# --- merging -----------------------------------------------------------------------------

def string_hashes(body: bytes, length: int) -> np.ndarray:
    """128-bit hashes of all strings of a piece, as sortable 16-byte keys."""
    data = np.frombuffer(body, np.uint8)
    two = np.stack([gram_hashes(data, length, base) for base in _BASES], axis=1)
    return np.ascontiguousarray(two.astype(">u8")).view("V16").reshape(-1).view("S16")


def merge_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of different keys, each with marks; a key of both is marked."""
    (ka, ma), (kb, mb) = a, b
    at = np.searchsorted(ka, kb)
    both = np.zeros(len(kb), bool)
    inside = at < len(ka)
    both[inside] = ka[at[inside]] == kb[inside]
    ma = ma.copy()
    ma[at[both]] = True
    return np.insert(ka, at[~both], kb[~both]), np.insert(ma, at[~both], mb[~both])


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of ascending places."""
    edge = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)]


# --- over a corpus -----------------------------------------------------------------------

def _texts(docs: DataFrame, length: int, text: str) -> DataFrame:
    """Different texts of at least ``length`` bytes, ``(key, copies, body)``, in a bucketed table."""
    spark = docs.sparkSession

    @tidy
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zip_.compress(b.as_buffer()) for b in batch.column(1)], pa.binary())], ["key", "body"])

    body = F.col(text).cast("binary")
    long = docs.select(_key(body).alias("key"), body.alias("body")).filter(F.octet_length("body") >= length)
    grouped = long.mapInArrow(squeeze, "key binary, body binary").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("body").alias("body"))
    name = f"texts_{uuid.uuid4().hex}"
    (grouped.write.bucketBy(parallelism(spark), "key").option("path", f"{checkpoint_dir(spark)}/llm/{name}").option("compression", "none")
     .saveAsTable(name))
    return spark.read.table(name)


def _key(body):
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def repeated(texts: DataFrame, length: int, gram: int = GRAM, wide: int = WIDE, shard_bytes: int = SHARD_BYTES,
             range_strings: int = RANGE_STRINGS) -> DataFrame:
    """``(key, spans)``: for each text that has any, the places of strings that start anywhere else
    too: for each of its pieces the first place and, counted from it, stretches with first and last one."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1)):
                hashes, first, last = anchors(np.frombuffer(unzip.decompress(body.as_py()), np.uint8), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(first), pa.binary()), pa.array(hashes.view(np.int64)),
                                                  pa.array(first), pa.array(last)], ["key", "anchor", "first", "last"])

    marks = save(texts.select("key", "body").mapInArrow(cut, "key binary, anchor long, first long, last long"))
    # written, so that the join below has the marks of a frequent anchor split by size
    held = save(marks.groupBy("anchor").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    wanted = (marks.join(held, "anchor").groupBy("key")
              .agg(F.collect_list(F.struct("anchor", "held", "first", "last")).alias("m")))

    @tidy
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        unzip, zip_ = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        sent: set[bytes] = set()  # a body goes once from each part of a task
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for key, body, found in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = unzip.decompress(body.as_py())
                fields = found.values
                for anchor, held_, first, last in zip(*(fields.field(i).to_pylist() for i in range(4))):
                    piece = text[first:last + length]
                    digest = xxhash.xxh3_128_digest(piece)
                    new = digest not in sent
                    sent.add(digest)
                    rows.append((key.as_py(), first, last - first + 1, anchor, held_, digest, zip_.compress(piece) if new else None))
                    size += 400
                    if size > 4 << 20:
                        yield _pieces(rows)
                        rows, size = [], 0
            if len(sent) > 100_000:
                sent.clear()
        if rows:
            yield _pieces(rows)

    pieces = save(texts.select("key", "body").join(wanted, "key").select("key", "body", "m")
                  .mapInArrow(take, "key binary, first long, places int, anchor long, held long, piece binary, body binary"))
    at_piece = _repeated_pieces(pieces, length, wide, shard_bytes, range_strings)
    # a place of a piece is one row, however many stretches the piece has
    return (pieces.select("key", "first", "piece").join(at_piece, "piece")
            .groupBy("key").agg(F.collect_list(F.struct("first", "starts", "stops")).alias("spans")))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["key", "first", "places", "anchor", "held", "piece", "body"])


def _repeated_pieces(pieces: DataFrame, length: int, wide: int, shard_bytes: int, range_strings: int) -> DataFrame:
    """``(piece, starts, stops)``: stretches of places of a piece whose strings are repeated, one row a piece."""
    spark = pieces.sparkSession
    # a piece that occurs twice is repeated whole
    twice = (pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.max("places").alias("places")).filter("n > 1")
             .select("piece", F.array(F.lit(0)).alias("starts"), F.array(F.col("places") - 1).alias("stops")))

    @tidy
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        shard: dict[bytes, tuple[bytes, int, bool]] = {}
        run: dict[bytes, tuple[bytes, int, bool]] = {}  # the different pieces of the anchor being read
        size, anchor = 0, None

        def finished() -> pa.RecordBatch | None:
            nonlocal shard, size
            whole, shard, size = shard, {}, 0
            return _shard_rows(whole, length)

        for batch in batches:
            for name, held, piece, places, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if name != anchor:
                    if len(run) > 1 or any(open_ for _, _, open_ in run.values()):
                        shard |= run
                    else:
                        size -= sum(len(b) for b, _, _ in run.values())
                    run, anchor = {}, name
                    if size > shard_bytes:
                        yield finished()
                if piece not in run:
                    run[piece] = (unzip.decompress(body), places, held > wide)
                    size += len(run[piece][0])
                    if held > wide and size > 2 * shard_bytes:  # such an anchor may be cut: shards are merged
                        shard |= run
                        run = {}
                        yield finished()
        if len(run) > 1 or any(open_ for _, _, open_ in run.values()):
            shard |= run
        if shard:
            yield finished()

    n = parallelism(spark)
    dealt = F.when(F.col("held") > wide, F.xxhash64("anchor", "piece")).otherwise(F.xxhash64("anchor"))
    bodies = (pieces.filter("body is not null").withColumn("dealt", dealt).repartition(n, "dealt")
              .sortWithinPartitions("anchor", "piece").select("anchor", "held", "piece", "places", "body"))
    found = save(bodies.mapInArrow(shards, "piece binary, starts array<int>, stops array<int>, keys binary, owners binary, places binary, names binary"))
    inside = found.filter("piece is not null").select("piece", "starts", "stops")
    every = twice.unionByName(inside).unionByName(_merged(found.filter("keys is not null"), range_strings))
    # the ranges deal a piece's strings by hash, so what they find is mostly single places
    together = every.groupBy("piece").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))).alias("found"))
    return together.mapInArrow(_united, "piece binary, starts array<int>, stops array<int>")


@tidy
def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each piece put together, so that none touches another."""
    for batch in batches:
        found = batch.column(1)
        n = len(found)
        start, stop = (found.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
        apart = int(stop.max(initial=0)) + 2  # pieces side by side, with a gap
        shift = np.repeat(np.arange(n), found.value_lengths().to_numpy()) * apart
        order = np.argsort(start + shift, kind="stable")
        start, reach = (start + shift)[order], np.maximum.accumulate((stop + shift)[order])
        gap = start[1:] > reach[:-1] + 1
        first, last = start[np.append(True, gap)], reach[np.append(gap, True)]
        ends = pa.array(np.searchsorted(first // apart, np.arange(n + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(ends, pa.array((x % apart).astype(np.int32))) for x in (first, last))],
                                         ["piece", "starts", "stops"])


def _shard_rows(shard: dict[bytes, tuple[bytes, int, bool]], length: int) -> pa.RecordBatch:
    """What is repeated within a shard, one row a piece, and one row with the sorted keys of the
    different strings of anchors that other shards have pieces of."""
    names = list(shard)
    first, again, number = repeated_in([(body, places) for body, places, _ in shard.values()], length)
    rows: list[tuple] = []
    keys, owners, places = [], [], []
    for i, (name, at) in enumerate(zip(names, first.tolist())):
        body, n, open_ = shard[name]
        own = np.flatnonzero(again[at:at + n])
        if len(own):
            starts, stops = _spans(own)
            rows.append((name, starts.tolist(), stops.tolist(), None, None, None, None))
        if open_:
            keys.append(string_hashes(body, length))
            owners.append(np.full(n, i, np.int32))
            places.append(np.arange(n, dtype=np.int32))
    if keys:
        joined, owner, place = (np.concatenate(c) for c in (keys, owners, places))
        order = np.argsort(joined, kind="stable")
        rows.append((None, None, None, joined[order].tobytes(), owner[order].tobytes(), place[order].tobytes(), b"".join(names)))
    types = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4)
    cells = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)],
                                      ["piece", "starts", "stops", "keys", "owners", "places", "names"])


def _merged(runs: DataFrame, range_strings: int) -> DataFrame:
    """``(piece, starts, stops)`` of strings that several shards hold."""
    strings = runs.agg(F.sum(F.octet_length("keys") / 16)).first()[0] or 0
    ranges = max(1, int(strings // range_strings))
    bounds = np.array([int((r << 64) // ranges).to_bytes(8, "big").ljust(16, b"\0") for r in range(1, ranges)], "S16")

    @tidy
    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, owners, places, names in zip(*(batch.column(i).to_pylist() for i in range(4))):
                key, owner, place = np.frombuffer(keys, "S16"), np.frombuffer(owners, np.int32), np.frombuffer(places, np.int32)
                cuts = [0, *np.searchsorted(key, bounds).tolist(), len(key)]
                name = np.frombuffer(names, "V16")
                rows = [(r, key[a:b].tobytes(), place[a:b].tobytes(), name[owner[a:b]].tobytes())
                        for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                                                 ["range", "keys", "places", "names"])

    def merge(table: pa.Table) -> pa.Table:
        cells = [tuple(np.frombuffer(x, t) for x, t in zip(row, ("S16", np.int32, "V16")))
                 for row in zip(*(table.column(c).to_pylist() for c in ("keys", "places", "names")))]
        merged = []
        for key, _, _ in cells:
            different = np.append(True, key[1:] != key[:-1])
            merged.append((key[different], np.zeros(int(different.sum()), bool)))
        while len(merged) > 1:  # neighbours in pairs, so that each string moves log(runs) times
            merged = [merge_runs(*merged[i:i + 2]) if i + 1 < len(merged) else merged[i] for i in range(0, len(merged), 2)]
        key, mark = merged[0]
        shared = key[mark]
        out: list[tuple] = []
        for key, place, name in cells:
            at = np.searchsorted(shared, key)
            hit = np.flatnonzero(at < len(shared))
            hit = hit[shared[at[hit]] == key[hit]]
            order = np.lexsort((place[hit], name[hit].view("S16")))
            hit = hit[order]
            edges = np.flatnonzero(np.append(True, name[hit][1:] != name[hit][:-1])) if len(hit) else np.zeros(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(hit)]):
                starts, stops = _spans(place[hit[a:b]])
                out.append((name[hit[a]].tobytes(), starts.tolist(), stops.tolist()))
        cols = list(zip(*out)) if out else [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())))],
                        names=["piece", "starts", "stops"])

    divided = runs.select("keys", "owners", "places", "names").mapInArrow(divide, "range int, keys binary, places binary, names binary")
    return divided.groupBy("range").applyInArrow(merge, "piece binary, starts array<int>, stops array<int>")


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each document; ``sizes`` are the
    bounds of ``repeated``, which don't change the result."""
    texts = _texts(docs, length, text)
    spans = repeated(texts, length, **sizes)

    @tidy
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for key, body, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = np.frombuffer(unzip.decompress(body.as_py()), np.uint8)
                first, starts, stops = (found.values.field(i) for i in range(3))
                at = np.repeat(first.to_numpy(), starts.value_lengths().to_numpy())
                start, stop = at + starts.flatten().to_numpy(), at + stops.flatten().to_numpy()
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, stop + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                rows.append((key, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()),
                             hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                                             ["key", "n_removed", "n_spans", "kept_sha256"])

    partly = (texts.filter("copies = 1").select("key", "body").join(spans, "key").select("key", "body", "spans")
              .mapInArrow(remove, "key binary, n_removed long, n_spans long, kept_sha256 string"))
    wholly = texts.filter("copies > 1").select("key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                                               F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    changed = save(partly.unionByName(wholly))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    every = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    out = every.withColumn("key", F.substring(F.unhex("sha"), 1, 16)).join(changed, "key", "left")
    return out.select("doc_id", "n_bytes", F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long").alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
