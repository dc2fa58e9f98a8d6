"""Mixing sources to target weights by entropy balancing.

*Targets.*  Sources in code-point order, null last, get the weights in turn, repeating, and
share all words; a source stops at ``most`` times its words, and what is over goes to the
others by weight until none is above: the target is min(most * words, level * weight) for
one level, found from sums over the sources.

*Rates.*  Among all rates that give a source its target words, the ones of largest entropy
relative to taking each document once, with no rate above ``most``, are
rate = most / (1 + (most - 1) * exp(-lambda * size / scale)): an exponential tilt with one dual
variable for each source's word constraint (scale: mean size of the source).  The dual is
convex; its Newton steps need sums over (source, size, documents), a distributed aggregate
per round, with a bracket that halves the interval where a step would leave it.

*Copies.*  A document takes the whole part of its rate, and one copy more if its key - hash /
(hash + fraction) - is below the source's threshold.  The threshold is found by histograms of that
key, finer in each level.  What is missing then, less than one document, is filled up in
two rounds with further copies of much smaller documents.  Hashes come from id and text: reruns agree.

All steps are DataFrame functions; the driver sees sums over sources only.

Defined cases: a null text has size 0 and takes part with copies but no words; the null
source is a source of its own; a source without words has target 0; repeated rows with one
id and text share one decision; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import discard, parallelism, save, source_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
FILLS = 2
_BINS = 1024
_HASHES = float(1 << 52)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(id_: Column, text: Column) -> Column:
    """A number in (0, 1) that depends on id and text only."""
    return (F.pmod(F.xxhash64(id_.cast("string"), text), F.lit(1 << 52)) + 0.5) / _HASHES


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows ``(doc_id, source, src, size, u)``; ``src`` is the never-null key of the source."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), source_key(source).alias("src"),
                       word_count(F.col(text)).alias("size"), unit_hash(F.col(id_col), F.col(text)).alias("u"))


def place(frame: DataFrame, by: str) -> DataFrame:
    """``frame`` with ``place``, the rank from 0 in the order of the distinct values of ``by``:
    ranges are sorted apart, and only the ranges' counts are summed up in one place."""
    spark = frame.sparkSession
    ranged = save(frame.repartitionByRange(parallelism(spark), by).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return ranged.withColumn("within", within).join(before, "part").withColumn("place", F.col("before") + F.col("within")) \
        .drop("part", "within", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Per source ``(src, source, source_size, n_docs, target)``."""
    sources = sizes.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"),
                                       F.count(F.lit(1)).alias("n_docs"))
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    weighed = save(place(sources, "src").withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    level, capped = 0.0, -1
    while True:  # the level rises until no further source stops; each round is one sum over sources
        row = weighed.agg(F.sum(F.when(F.col("weight") * level >= F.col("cap"), F.col("cap"))).alias("stopped"),
                          F.count_if(F.col("weight") * level >= F.col("cap")).alias("n"),
                          F.sum(F.when(F.col("weight") * level < F.col("cap"), F.col("weight"))).alias("open")).first()
        if row.n == capped or not row.open:
            break
        capped, level = row.n, (total - (row.stopped or 0.0)) / row.open
    return weighed.withColumn("target", F.least("cap", F.lit(float(level)) * F.col("weight")).cast("double")) \
        .select("src", "source", "source_size", "n_docs", "target")


def rate(size: Column, lam: Column, scale: Column, most: float) -> Column:
    """The tilted rate of a document; with ``lam`` infinite the largest."""
    t = F.least(F.greatest(-lam * size / scale, F.lit(-700.0)), F.lit(700.0))
    return F.when(lam == float("inf"), F.lit(most)).otherwise(F.lit(most) / (1 + (most - 1) * F.exp(t)))


def balance(sizes: DataFrame, goals: DataFrame, most: float = 3.0, tolerance: float = 1e-6, rounds: int = 80) -> DataFrame:
    """``goals`` with the dual variable ``lam`` and the ``scale`` of each source."""
    scale = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0))
    at_top = F.col("target") >= F.col("source_size") * F.lit(most) * (1 - 1e-12)
    start = goals.withColumns({"scale": scale, "lam": F.when(at_top, F.lit(float("inf"))).otherwise(F.lit(0.0)),
                               "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "settled": at_top | (F.col("source_size") == 0)})
    state = save(start)
    # documents of one source and size have one rate: the rounds run on their counts
    counts = save(sizes.filter("size > 0").groupBy("src", "size").agg(F.count(F.lit(1)).alias("docs")))
    for _ in range(rounds):
        open_ = state.filter("not settled").select("src", "lam", "scale")
        r = rate(F.col("size"), F.col("lam"), F.col("scale"), most)
        words = (counts.join(open_, "src").withColumn("r", r)
                 .groupBy("src").agg(F.sum(F.col("docs") * F.col("size") * F.col("r")).alias("got"),
                                     F.sum(F.col("docs") * F.col("size") * F.col("size") / F.col("scale")
                                           * F.col("r") * (1 - F.col("r") / most)).alias("slope")))
        gap = F.col("got") - F.col("target")
        near = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        # beyond the known side the step at most doubles; between both sides it stays inside
        reach = 1 + F.abs(F.col("lam"))
        step = F.when(F.col("slope") > 0, -gap / F.col("slope")).otherwise(-F.signum(gap) * reach)
        newton = F.col("lam") + F.greatest(F.least(step, reach), -reach)
        inside = (newton > low) & (newton < high)
        new = F.when(inside, newton).when((low > float("-inf")) & (high < float("inf")), (low + high) / 2).otherwise(newton)
        # a side may be fixed to machine precision without a rate that meets the target
        stuck = (low > float("-inf")) & (high < float("inf")) & (high - low <= 1e-12 * (1 + F.abs(F.col("lam"))))
        moved = save(state.join(words, "src", "left").withColumns({
            "new_low": F.when(F.col("settled"), F.col("low")).otherwise(low),
            "new_high": F.when(F.col("settled"), F.col("high")).otherwise(high),
            "new_lam": F.when(F.col("settled") | near, F.col("lam")).otherwise(new),
            "now": F.col("settled") | near | stuck})
            .select("src", "source", "source_size", "n_docs", "target", "scale", F.col("new_lam").alias("lam"),
                    F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("now").alias("settled")))
        discard(state)
        state = moved
        if state.filter("not settled").limit(1).count() == 0:
            break
    return state.select("src", "source", "source_size", "n_docs", "target", "scale", "lam")


def _key(u: Column, r: Column) -> Column:
    """In (0, 1]; smaller for a larger fraction.  At an expected threshold of 1/2 a document
    takes its fraction's copy with the probability of the fraction."""
    return u / (u + r - F.floor(r))


def _again(u: Column, fill: int) -> Column:
    """A further hash in (0, 1), one for each filling round."""
    return (F.pmod(F.xxhash64(u, F.lit(fill)), F.lit(1 << 52)) + 0.5) / _HASHES


def _prefix(pool: DataFrame, needs: DataFrame, levels: int, nearest: bool = False) -> DataFrame:
    """Per source the ``threshold`` of ``key`` below which the pool's documents together have at
    most the ``need``ed words (or come nearest to it), and the words still needed.

    Each level is a histogram over one bin of the level before, 1024 times finer.
    """
    state = save(needs.select("src", "need", F.lit(0.0).alias("low"), F.lit(1.0 / _BINS).alias("width")))
    for _ in range(levels):
        bin_ = F.floor((F.col("key") - F.col("low")) / F.col("width")).cast("long")
        # written, so that rows meet by source and bin, and by source only when bins are summed up
        binned = save(pool.join(state, "src").withColumn("bin", bin_).filter((F.col("bin") >= 0) & (F.col("bin") < _BINS))
                      .groupBy("src", "bin").agg(F.sum("size").alias("words")))
        upto = F.sum("words").over(Window.partitionBy("src").orderBy("bin"))
        sums = binned.withColumn("before", upto - F.col("words")).join(state.select("src", "need"), "src")
        # the bin in which the need is met; the last one if the bins fall short
        hit = (sums.filter("before <= need").groupBy("src")
               .agg(F.max(F.struct("bin", "before", "words")).alias("h")).select("src", "h.*"))
        after = save(state.select("src", "need", "low", "width").join(hit, "src", "left").select(
            "src", (F.col("need") - F.coalesce("before", F.lit(0))).alias("need"),
            (F.col("low") + F.coalesce("bin", F.lit(0)) * F.col("width")).alias("low"),
            (F.col("width") / _BINS).alias("width"), F.coalesce("words", F.lit(0)).alias("words")))
        discard(state)
        discard(binned)
        state = after
    with_bin = (F.col("words") - F.col("need") < F.col("need")) if nearest else (F.col("words") <= F.col("need"))
    return state.select("src", F.when(with_bin, F.col("low") + F.col("width") * _BINS).otherwise(F.col("low")).alias("threshold"),
                        (F.col("need") - F.when(with_bin, F.col("words")).otherwise(0)).alias("need"))


def thresholds(sizes: DataFrame, rates: DataFrame, most: float = 3.0, fills: int = FILLS) -> DataFrame:
    """``rates`` with ``threshold`` and, for each filling round i, ``limit_i`` and ``threshold_i``.

    The first threshold leaves less than one document of the need.  Each filling round
    gives one copy more to documents of at most a quarter of what is missing.
    """
    decided = rates
    tilted = save(sizes.filter("size > 0").join(rates.select("src", "lam", "scale"), "src")
                  .withColumn("r", rate(F.col("size"), F.col("lam"), F.col("scale"), most)).select("src", "size", "u", "r"))
    whole = tilted.groupBy("src").agg(F.sum(F.floor("r") * F.col("size")).alias("whole"))
    needs = rates.join(whole, "src", "left").select("src", (F.col("target") - F.coalesce("whole", F.lit(0))).alias("need"))
    found = save(_prefix(tilted.select("src", "size", _key(F.col("u"), F.col("r")).alias("key")), needs, 3))
    decided = decided.join(found.select("src", "threshold"), "src")
    for fill in range(1, fills + 1):
        # a need below zero (rounding of whole rates) fills nothing
        limits = save(found.select("src", "need", (F.col("need") / 4).alias(f"limit_{fill}")))
        # written: its small size is then known, and documents need not be shuffled to meet it
        state = save(decided.join(limits.drop("need"), "src"))
        pool = (sizes.filter("size > 0").join(state.drop("source", "source_size", "n_docs", "target"), "src")
                .filter(F.col("size") <= F.col(f"limit_{fill}")).filter(_copies(fill - 1, most) < most)
                .select("src", "size", _again(F.col("u"), fill).alias("key")))
        found = save(_prefix(pool, limits, 2, nearest=fill == fills))
        decided = state.join(found.select("src", F.col("threshold").alias(f"threshold_{fill}")), "src")
    return decided


def _copies(fills: int, most: float) -> Column:
    """Copies after the given number of filling rounds, from the columns of ``thresholds``."""
    size, u = F.col("size"), F.col("u")
    r = rate(size, F.col("lam"), F.col("scale"), most)
    more = (r > F.floor(r)) & (_key(u, r) < F.col("threshold"))
    out = (F.floor(r) + F.when(more, 1).otherwise(0)).cast("long")
    for fill in range(1, fills + 1):
        more = (size <= F.col(f"limit_{fill}")) & (_again(u, fill) < F.col(f"threshold_{fill}")) & (out < most)
        out = out + F.when(more, 1).otherwise(0)
    return out


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Per source all that decides its documents' copies."""
    return save(thresholds(sizes, balance(sizes, targets(sizes, weights, most), most), most))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, id_col: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """Per document ``(doc_id, size, source_size, target, copies, taken)``."""
    sizes = save(measured(docs, id_col, text, source))
    return (sizes.join(plan(sizes, weights, most).drop("source"), "src").withColumn("copies", _copies(FILLS, most))
            .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, id_col: str = "doc_id",
          text: str = "text", source: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it.  Sizes are counted again
    beside the text, so that texts aren't shuffled to meet their copies."""
    sizes = save(measured(docs, id_col, text, source))
    decided = plan(sizes, weights, most).drop("source", "source_size", "n_docs", "target")
    mine = docs.select(F.struct(*docs.columns).alias("doc"), source_key(source).alias("src"), word_count(F.col(text)).alias("size"),
                       unit_hash(F.col(id_col), F.col(text)).alias("u"))
    return (mine.join(decided, "src").withColumn("copies", _copies(FILLS, most).cast("int"))
            .select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*"))
