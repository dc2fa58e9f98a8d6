"""Spelling variants by pivotal grams.

*Words* are runs of Latin letters, counted over all documents.  Two words are near if one
inserted, deleted or replaced code point turns one into the other.

*Pivotal grams.*  The bigrams of a word are ordered by their number in the vocabulary,
rarest first.  A word's *gram prefix* holds its three rarest bigrams (with every further
occurrence of the third); its *pivots* are two disjoint bigrams of the prefix with the least
total frequency, found by dynamic programming over positions.  One edit touches at most one
of two disjoint bigrams, so one pivot of a word survives in any near word.  Of two near words
let s be the one whose prefix ends with the rarer bigram (or an equally rare one): the
surviving pivot of s is no more frequent than that bigram, so it lies in the prefix of the
other one.  Pivots indexed against the gram prefixes of other words miss no pair.

*Position limits.*  An edit behind the left pivot leaves the word up to and with that pivot
as it is, at the same place from the start; any other edit leaves the word from the right
pivot on as it is, at the same place from the end.  So the left pivot is looked up among the
prefix bigrams at the same place with the same text before it, the right pivot among those
at the same place from the end with the same text behind it, at lengths that differ by at
most one.  Where that text is shorter than ``HEAD`` code points, one edit either spares the
first (last) ``HEAD`` code points as well or spares all that lies beyond them, so one of these
joins the key.  Keys are 64-bit hashes, which can only add candidates; candidates are verified
by their edit distance.

*Forms.*  A word's form is its near word of largest count (ties: the smallest word in
code-point order) if that count is at least ``ratio`` times its own.  Counts grow along
forms, so following them ends; ``root`` is found by pointer doubling over written tables.

Bigrams are numbered by the low bytes of their two code points (65,536 numbers whatever the
alphabet; equal numbers only add candidates), so their frequencies are a table of bounded
size, the only data that reaches the driver.

Defined cases: null and empty texts have no runs; a null id counts as an empty text; repeated
rows count each; very long runs are words like any other (they travel as their SHA-256 until
they are verified); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import discard, save, tidy

LETTERS = "A-Za-zÀ-ÿ"
GRAMS = 1 << 16
PREFIX = 3  # bigrams that one edit can't all touch, and one more
HEAD = 6
SHORT = 32  # longer words travel as their hash

_LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
_CAPITALS = "".join(map(chr, range(65, 91)))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SIDE = np.uint64(0xC2B2AE3D27D4EB4F)


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(word, _CAPITALS, _CAPITALS.translate(_LOWER))


def runs(docs: DataFrame, min_length: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(doc_id, run)``: every maximal run of at least ``min_length`` letters, lower-cased."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))


def counted(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """Rows ``(word, n)`` of the column ``word``: the vocabulary."""
    return (words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def gram_ids(word: str) -> np.ndarray:
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64) & 255
    return codes[:-1] << 8 | codes[1:]


def gram_counts(vocabulary: DataFrame) -> np.ndarray:
    """How often each bigram number occurs in the vocabulary."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                total += np.bincount(gram_ids(word), minlength=GRAMS) if len(word) > 2000 else 0
            # short words together; a bigram that spans two words is left out
            short = [w for w in batch.column(0).to_pylist() if len(w) <= 2000]
            if short:
                grams = gram_ids("".join(short))
                inside = np.ones(len(grams) + 1, bool)
                inside[np.cumsum([len(w) for w in short]) - 1] = False
                total += np.bincount(grams[inside[:-1]], minlength=GRAMS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["gram", "n"])

    out = np.zeros(GRAMS, np.int64)
    for row in vocabulary.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row.gram] = row.n
    return out


def pivots(weights: np.ndarray) -> np.ndarray:
    """For each row the places of two bigrams, at least two apart, of least total weight."""
    rows, places = weights.shape
    at = np.arange(rows)
    first = np.zeros(rows, np.int64)  # the lightest place up to p - 2
    best = np.full(rows, np.iinfo(np.int64).max)
    chosen = np.zeros((rows, 2), np.int64)
    for p in range(2, places):
        lighter = weights[:, p - 2] < weights[at, first]
        first = np.where(lighter, p - 2, first)
        total = weights[at, first] + weights[:, p]
        better = total < best
        best = np.where(better, total, best)
        chosen[better] = np.stack([first, np.full(rows, p)], axis=1)[better]
    return chosen


def _mix(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    x = (x ^ np.asarray(y).astype(np.uint64)) * _BASE
    return (x ^ x >> np.uint64(29)) * _SIDE


def keys_of_places(codes: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Keys of the bigrams at ``place`` (from the start) of rows of code points: those under which
    they are posted, those under which they are looked up, and which of them have an intact text
    shorter than ``HEAD``.  The first posted and the first three looked up are for all, the
    others for the last kind only."""
    rows, length = codes.shape
    head, tail = np.zeros((length + 1, rows), np.uint64), np.zeros((length + 2, rows), np.uint64)
    for i in range(length):
        head[i + 1] = (head[i] + codes[:, i] + np.uint64(1)) * _BASE
        tail[length - 1 - i] = (tail[length - i] + codes[:, length - 1 - i] + np.uint64(1)) * _BASE
    spared = _mix(head[np.minimum(np.maximum(place + 2, HEAD), length), row], place)
    brief = place + 2 < HEAD
    upto = _mix(head[place + 2, row], place + (1 << 40))
    beyond, next_ = (_mix(upto, tail[min(HEAD + i, length), row]) for i in (0, 1))
    same, longer = 1 << 41, 1 << 42
    return ([_mix(spared, length), _mix(beyond, same), _mix(next_, longer)],
            [_mix(spared, length + d) for d in (-1, 0, 1)] + [_mix(beyond, same), _mix(beyond, longer), _mix(next_, same)], brief)


def signatures(words: list[str], rank: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram prefixes of words as rows ``(word index, last rank, looked up or posted, key)``."""
    parts: list[tuple[np.ndarray, ...]] = []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        index = np.flatnonzero(lengths == length)
        joined = "".join(words[i] for i in index)
        grams = np.append(gram_ids(joined), 0).reshape(len(index), length)[:, :-1]
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(index), length).astype(np.uint64)
        ranks = rank[grams]
        last = np.partition(ranks, PREFIX - 1, axis=1)[:, PREFIX - 1]
        inside = ranks <= last[:, None]
        # beyond the prefix a weight above any sum within it
        two = pivots(np.where(inside, counts[grams], np.int64(1) << 60))
        row, place = np.nonzero(inside)
        # the right side is the left side of the reversed word
        for side, (matrix, at) in enumerate(((codes, place), (codes[:, ::-1], length - 2 - place))):
            posted, looked, brief = keys_of_places(matrix, row, at)
            chosen = place == two[row, side]
            for probe, keys, least in ((False, posted, 1), (True, looked, 3)):
                for i, key in enumerate(keys):
                    use = (chosen if probe else np.ones(len(row), bool)) & (brief | (i < least))
                    n = int(use.sum())
                    parts.append((index[row[use]], last[row[use]], np.full(n, probe), key[use] ^ np.uint64(side)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def prefixes(vocabulary: DataFrame) -> DataFrame:
    """Rows ``(key, n, last, probe, point)``: the keys under which the bigrams of a word's
    prefix are posted, and (probe) those under which its pivots are looked up."""
    counts = gram_counts(vocabulary)
    rank = np.empty(GRAMS, np.int64)
    rank[np.lexsort((np.arange(GRAMS), counts))] = np.arange(GRAMS)

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            index, last, probe, point = signatures(batch.column(0).to_pylist(), rank, counts)
            take = pa.array(index)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(take), batch.column(2).take(take), pa.array(last.astype(np.int32)), pa.array(probe),
                 pa.array(point.view(np.int64))], ["key", "n", "last", "probe", "point"])

    return vocabulary.select("word", "key", "n").mapInArrow(
        sign, "key string, n long, last int, probe boolean, point long")


def near_pairs(vocabulary: DataFrame, signed: DataFrame) -> DataFrame:
    """Every pair of near words once, as ``(a, b)`` keys with a < b and their counts."""
    probing = signed.filter("probe").select(F.col("key").alias("s"), F.col("n").alias("sn"), F.col("last").alias("s_last"), "point")
    posted = signed.filter("not probe").select(F.col("key").alias("r"), F.col("n").alias("rn"), F.col("last").alias("r_last"), "point")
    met = probing.join(posted, "point").filter((F.col("s_last") <= F.col("r_last")) & (F.col("s") != F.col("r")))
    ordered = met.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b"), F.when(F.col("s") < F.col("r"), F.col("sn")).otherwise(F.col("rn")).alias("an"),
                         F.when(F.col("s") < F.col("r"), F.col("rn")).otherwise(F.col("sn")).alias("bn"))
    # Words up to SHORT are their own keys; longer ones (and the short ones beside them) are
    # fetched.  A hash is longer than SHORT, so the two kinds don't mix.
    short = ordered.filter((F.length("a") <= SHORT) & (F.length("b") <= SHORT)).filter(F.levenshtein("a", "b", 1) == 1)
    texts = vocabulary.filter(F.length("word") >= SHORT).select("key", "word")
    long = (ordered.filter((F.length("a") > SHORT) | (F.length("b") > SHORT)).distinct()
            .join(texts.select(F.col("key").alias("a"), F.col("word").alias("a_word")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("word").alias("b_word")), "b")
            .filter(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b", "an", "bn"))
    return short.unionByName(long).distinct()


def follow(links: DataFrame) -> DataFrame:
    """``(key, root)`` of ``(key, form)`` links without cycles, by pointer doubling."""
    at = save(links.select("key", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("key").alias("root"), F.col("root").alias("next"))
        moved = save(at.join(ahead, "root", "left").select("key", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(at)
        if moved.filter("moved").isEmpty():
            return moved.select("key", "root")
        at = moved


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a vocabulary ``(word, n)`` of distinct words
    of at least four code points."""
    key = F.when(F.length("word") <= SHORT, F.col("word")).otherwise(F.sha2(F.col("word").cast("binary"), 256))
    vocabulary = save(words.select("word", key.alias("key"), "n"))
    signed = save(prefixes(vocabulary))
    pairs = near_pairs(vocabulary, signed)
    sides = F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
                    F.struct(F.col("b").alias("key"), F.col("a").alias("near"), F.col("an").alias("near_n")))
    # The smallest near word in code-point order: a hash says nothing about it, so ties between
    # long words are settled by their text.
    near = pairs.select(F.explode(sides).alias("p")).select("p.*")
    top = near.groupBy("key").agg(F.count(F.lit(1)).alias("n_near"), F.max("near_n").alias("form_n"),
                                  F.min(F.struct(-F.col("near_n"), "near"))["near"].alias("form"),
                                  F.max(F.length("near") > SHORT).alias("hashed"))
    tied = near.join(top.filter("hashed").select("key", "form_n"), "key").filter(F.col("near_n") == F.col("form_n"))
    by_text = (tied.join(vocabulary.select(F.col("key").alias("near"), "word"), "near").groupBy("key")
               .agg(F.min(F.struct("word", "near"))["near"].alias("form")))
    chosen = top.filter("not hashed").select("key", "n_near", "form_n", "form").unionByName(
        top.filter("hashed").drop("form").join(by_text, "key").select("key", "n_near", "form_n", "form"))
    kept = F.coalesce(F.col("form_n") >= F.lit(ratio) * F.col("n"), F.lit(False))
    found = save(vocabulary.select("key", "n").join(chosen, "key", "left")
                 .select("key", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")))
    discard(signed)
    roots = follow(found.filter("form is not null"))
    out = found.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # keys become words again: only hashes need their text
    texts = vocabulary.filter(F.length("word") > SHORT).select("key", "word")
    for col in ("key", "form", "root"):
        out = (out.join(texts.select(F.col("key").alias(col), F.col("word").alias("_long")), col, "left")
               .withColumn(col, F.coalesce("_long", col)).drop("_long"))
    return out.select(F.col("key").alias("word"), "form", "root", "n", "n_near", "form_n")
