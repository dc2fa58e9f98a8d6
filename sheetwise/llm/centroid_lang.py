"""Language identification by nearest centroids.

*Features.*  Runs of letters (anything else is a space), lower-cased; character 1- to
3-grams hashed into 4096 counts; log(1 + count) times the inverse document frequency,
scaled to length 1.

*Fit.*  From at most ``per_lang`` labelled documents for each language (documented bound;
those with the smallest hash of the id, so any rerun takes the same).  Their vectors are
computed in tasks; each language's bounded group is clustered there by spherical k-means
into up to ``clusters`` centroids.  Only centroids and document frequencies, a few KB for
each language, go to the driver.

*Prediction.*  The language of the centroid with the largest cosine; the score is that
cosine.  A language also has floors by richness, the number of different n-grams times the
characters (blanks apart) per letter: short texts and texts of few words reach small cosines
only, while digits and signs around a few letters don't make them a short text.  The floor of
a class (powers of two, the last one open) is ``reject`` times the ``LOW`` quantile of the
cosines of training documents and of pieces cut from their heads, so odd documents don't set
it and every class has cases.  A text below the floor of the predicted language is rejected.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected;
a model without any training document predicts ``und`` for all; ties go to the language
that sorts first; repeated rows get equal predictions; null languages are never learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import save, tidy, tidy_group

DIMS = 4096
UNKNOWN = "und"
# Richness classes; from 2 ** (CLASSES - 1) on all texts are one class.
CLASSES = 9
LOW = 0.02
_HEAD = 4096
_CHUNK = 1 << 20
# Texts whose counts are in memory at once, 32 KB each and as much for every step.
_ROWS = 32
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of the letter 1- to 3-grams of a whole text; None if it has no letter."""
    found = measured(text)
    return found and found[0]


def measured(text: str) -> tuple[np.ndarray, int] | None:
    """The counts and the richness class of a whole text; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[points]
    letters = int(letter.sum())
    if not letters:
        return None
    signs = max(int((points > 32).sum()), letters)
    points = np.concatenate(([32, 32], np.where(letter, points, 32), [32])).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    for at in range(2, len(points), _CHUNK):
        c = points[at:at + _CHUNK]
        b, a = points[at - 1:at - 1 + len(c)], points[at - 2:at - 2 + len(c)]
        for grams in (c, c + b * np.uint32(0x1F123BB5), c + b * np.uint32(0x1F123BB5) + a * np.uint32(0x05491333)):
            h = (grams ^ (grams >> np.uint32(13))) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            counts += np.bincount(h * np.uint32(0x85EBCA77) >> shift, minlength=DIMS)
    return counts, min((int(np.count_nonzero(counts)) * signs // letters).bit_length(), CLASSES) - 1


def pieces(head: str) -> Iterator[str]:
    """Pieces of 4, 8, 16, ... characters one after another, cut at words if there are blanks."""
    at, size = 0, 4
    while at + size < len(head):
        words = head[at:at + size].split()
        yield " ".join(words[1:-1] or words)
        at, size = at + size, 2 * size


def floors(cases: list[tuple[int, float]], reject: float) -> np.ndarray:
    """Floor of each class from the classes and cosines of a language's cases.  A class without
    a case has the floor of the next poorer one, or less than that of the first with cases."""
    group, cosine = (np.array(x) for x in zip(*cases))
    out = [reject * np.quantile(cosine[group == c], LOW) if (group == c).any() else None for c in range(CLASSES)]
    first = next(c for c in range(CLASSES) if out[c] is not None)
    for c in range(CLASSES):
        if out[c] is None:
            out[c] = out[c - 1] if c > first else out[first] * 0.5 ** ((first - c) / 2)
    return np.maximum(np.array(out, float), 0)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """Centroids (rows, length 1), their languages and those languages' floors (a column for
    each richness class), and the inverse document frequencies."""

    langs: tuple[str, ...]
    floors: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections."""
        lang = [UNKNOWN] * len(texts)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        if not len(self.langs):
            return lang, score, rejected
        columns = self.centroids.T.astype(float)
        for at in range(0, len(texts), _ROWS):
            found = [(i, *m) for i, t in enumerate(texts[at:at + _ROWS], at) if t and (m := measured(t))]
            if not found:
                continue
            rows = np.array([i for i, _, _ in found])
            cosines = _unit(np.log1p(np.array([c for _, c, _ in found])) * self.idf) @ columns
            best = cosines.argmax(axis=1)
            score[rows] = np.clip(cosines[np.arange(len(rows)), best], 0, 1)
            rejected[rows] = score[rows] < self.floors[best, [r for _, _, r in found]]
            for i, b in zip(rows, best):
                lang[i] = self.langs[b]
        return lang, score, rejected


def cluster(vectors: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit vectors: (centroids, cosine of each vector to its nearest
    centroid).  It starts from the means of equal slices by closeness to the common
    mean, so single odd documents don't become centroids."""
    close = np.argsort(vectors @ _unit(vectors.mean(axis=0)), kind="stable")
    centroids = np.vstack([_unit(vectors[part].mean(axis=0)) for part in np.array_split(close, min(clusters, len(vectors)))])
    for _ in range(rounds):
        member = (vectors @ centroids.T).argmax(axis=1)
        centroids = np.vstack([_unit(vectors[member == k].mean(axis=0)) for k in np.unique(member)])
    return centroids, (vectors @ centroids.T).max(axis=1)


def profiles(texts: pd.Series) -> Iterator[pd.DataFrame]:
    """Rows ``(v, rich)`` in parts: log(1 + count) as float32 and the richness class, null and 0 without a letter."""
    for at in range(0, len(texts), _ROWS):
        found = [measured(t) if t else None for t in texts[at:at + _ROWS]]
        yield pd.DataFrame({"v": pd.Series([np.log1p(m[0]).astype("<f4").tobytes() if m else None for m in found], dtype=object),
                            "rich": pd.Series([m[1] if m else 0 for m in found], dtype="int32")})


def profile(text: Column) -> Column:
    """Struct ``(v, rich)`` of a text column.  Called nondeterministic, so that a filter on it
    isn't pushed down to compute it a second time in a further Python worker."""

    @F.pandas_udf("v binary, rich int")
    @tidy
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from profiles(batch)

    return of.asNondeterministic()(text)


def fit(docs: DataFrame, per_lang: int = 512, clusters: int = 4, reject: float = 0.45, id_col: str = "doc_id",
        text: str = "text", lang: str = "lang") -> Model:
    """Model of the labelled rows of ``docs``: at most ``per_lang`` documents for each language."""
    ids = docs.filter(F.col(lang).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"))
    # a share of each language by hash, twice the bound on average, so that no task ranks all of one
    share = save(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", (2.0 * per_lang / F.col("n")).alias("share")))
    ids = ids.join(share, "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # written first, so that Spark knows its size and need not shuffle the texts to meet it
    chosen = save(ids.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang).select("id", "lang").distinct())

    texts = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    again = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "v")  # rows that share an id
    sample = save(texts.join(chosen, (texts["id"].eqNullSafe(chosen["id"])) & (texts["lang"] == chosen["lang"]), "left_semi")
                  .select("id", "lang", F.substring("text", 1, _HEAD).alias("head"), profile(F.col("text")).alias("m"))
                  .select("id", "lang", "head", "m.*").filter("v is not null")
                  .withColumn("r", F.row_number().over(again)).filter(F.col("r") <= per_lang).select("lang", "v", "rich", "head"))

    @tidy_group
    def frequencies(group: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(DIMS, "<i8")
        for v in group["v"]:
            found += np.frombuffer(v, "<f4") > 0
        return pd.DataFrame({"n": [len(group)], "df": [found.tobytes()]})

    per_group = sample.select("lang", "v").groupBy("lang").applyInPandas(frequencies, "n long, df binary").collect()
    n = sum(r.n for r in per_group)
    df = sum((np.frombuffer(r.df, "<i8") for r in per_group), np.zeros(DIMS, np.int64))
    idf = np.log((1 + n) / (1 + df)) + 1

    @tidy_group
    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v")
        vectors = np.empty((len(group), DIMS))
        for at in range(0, len(group), _ROWS):
            vectors[at:at + _ROWS] = _unit(np.array([np.frombuffer(v, "<f4") for v in group["v"][at:at + _ROWS]]) * idf)
        found, cosines = cluster(vectors, clusters)
        cases = list(zip(group["rich"], cosines))
        for head in group["head"]:
            for m in filter(None, map(measured, pieces(head))):
                cases.append((m[1], (found @ _unit(np.log1p(m[0]) * idf)).max()))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "floors": [floors(cases, reject).tolist()] * len(found),
                             "centroid": [c.astype("<f4").tobytes() for c in found]})

    rows = sample.groupBy("lang").applyInPandas(centroids, "lang string, floors array<double>, centroid binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, bytes(r.centroid)))
    return Model(tuple(r.lang for r in rows), np.array([r.floors for r in rows]).reshape(len(rows), CLASSES),
                 np.array([np.frombuffer(r.centroid, "<f4") for r in rows], dtype=np.float32).reshape(len(rows), DIMS),
                 idf.astype(np.float32))


def predicted(text: Column, model: Model) -> Column:
    """Struct ``(lang_pred, score, rejected)`` of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    @tidy
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score, rejected = model.predict(list(batch))
            yield pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": score, "rejected": rejected})

    return of(text)
