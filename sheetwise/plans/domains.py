"""Domain scoring, domain choice and capability planning (DOM-1, DOM-2, PLN-1, EXT-1).

All three run over a mapped catalogue ``(dataset_id, pos, name, non_null)``.
Signals and capabilities are small constant tables (tens of rows) and are
broadcast; the catalogue itself is only ever grouped or joined by
``dataset_id``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.plans.vocab import CAPABILITIES, DOMAINS, GENERIC, MINIMUM_DOMAIN_SCORE, MISSING_REASON


@dataclass(frozen=True)
class Domain:
    """EXT-1: a domain plug-in is data: signals, score rule and capabilities."""
    id: str
    name: str
    base: str
    step: str
    signals: tuple[tuple[str, ...], ...]
    capabilities: tuple = field(default=())


def registry() -> list[Domain]:
    """Domains in registration order (ties in score go to the earlier one)."""
    return [Domain(d, n, b, s, sig, CAPABILITIES[d]) for d, n, b, s, sig in DOMAINS]


def signal_frame(spark: SparkSession, domains: list[Domain] | None = None) -> DataFrame:
    rows = []
    for order, d in enumerate(domains or registry()):
        for sid, sig in enumerate(d.signals):
            for f in sig:
                rows.append((d.id, d.name, order, d.base, d.step, sid, len(sig), f))
    return spark.createDataFrame(rows, "domain string, domain_name string, reg_order int, base string, step string, "
                                       "signal int, signal_size int, field string")


def capability_frame(spark: SparkSession, domains: list[Domain] | None = None) -> DataFrame:
    rows = []
    offered = CAPABILITIES | {d.id: d.capabilities for d in domains or []}
    for domain, caps in offered.items():
        for order, (cid, name, all_of, any_of) in enumerate(caps):
            rows.append((domain, order, cid, name, list(all_of), [list(a) for a in any_of]))
    return spark.createDataFrame(rows, "domain string, cap_order int, capability_id string, capability_name string, "
                                       "all_of array<string>, any_of array<array<string>>")


def domain_score(mapped: DataFrame, domains: list[Domain] | None = None) -> DataFrame:
    """DOM-1: score of every domain with at least one complete signal, per table.

    Uses *all* mapped column names (not only filled ones), like the reference.
    """
    sig = signal_frame(mapped.sparkSession, domains)
    names = mapped.select("dataset_id", F.col("name").alias("field")).distinct()
    hits = names.join(F.broadcast(sig), "field")
    complete = hits.groupBy("dataset_id", "domain", "domain_name", "reg_order", "base", "step", "signal", "signal_size") \
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("signal_size"))
    per_domain = complete.groupBy("dataset_id", "domain", "domain_name", "reg_order", "base", "step").agg(
        F.count(F.lit(1)).alias("matched_signals"))
    dec = "decimal(6,2)"
    raw = F.col("base").cast(dec) + F.col("step").cast(dec) * (F.col("matched_signals") - 1)
    score = F.least(F.lit(1).cast(dec), raw)
    return per_domain.select("dataset_id", "domain", "reg_order", "matched_signals",
                             score.cast("double").alias("score"))


def domain_choice(mapped: DataFrame, domains: list[Domain] | None = None) -> DataFrame:
    """DOM-2: highest score strictly above 0.5 (ties: registration order), else generic."""
    s = domain_score(mapped, domains).where(F.col("score") > float(MINIMUM_DOMAIN_SCORE))
    best = s.groupBy("dataset_id").agg(
        F.max_by(F.struct("domain", "score"), F.struct(F.col("score"), -F.col("reg_order"))).alias("b"))
    tables = mapped.select("dataset_id").distinct()
    names = {d.id: d.name for d in (domains or registry())}
    name_map = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    j = tables.join(best, "dataset_id", "left")
    domain = F.coalesce(F.col("b.domain"), F.lit(GENERIC[0]))
    return j.select("dataset_id", domain.alias("domain"),
                    F.coalesce(name_map[domain], F.lit(GENERIC[1])).alias("domain_name"),
                    F.coalesce(F.col("b.score"), F.lit(0.0)).alias("score"))


def capability_plan(mapped: DataFrame, choice: DataFrame | None = None, domains: list[Domain] | None = None) -> DataFrame:
    """PLN-1: per table and capability of its domain: supported, missing and matched fields.

    Availability uses only columns with at least one filled value.  ``all_of``
    must be complete and the first complete ``any_of`` alternative is matched;
    if none is complete, the alternative with the fewest missing fields
    (earliest on ties) is reported.
    """
    spark = mapped.sparkSession
    choice = choice if choice is not None else domain_choice(mapped, domains)
    avail = mapped.groupBy("dataset_id").agg(
        F.collect_set(F.when(F.col("non_null") > 0, F.col("name"))).alias("avail"))
    caps = F.broadcast(capability_frame(spark, domains))
    j = choice.select("dataset_id", "domain").join(caps, "domain").join(avail, "dataset_id")
    av = F.col("avail")
    missing_of = lambda arr: F.filter(arr, lambda f: ~F.array_contains(av, f))
    all_missing = missing_of(F.col("all_of"))
    alt_missing = F.transform(F.col("any_of"), lambda alt: missing_of(alt))
    first_ok = F.array_position(F.transform(alt_missing, lambda m: F.size(m) == 0), True)
    fewest = F.array_min(F.transform(alt_missing, lambda m, i: F.struct(F.size(m).alias("n"), i.alias("i"))))
    has_any = F.size("any_of") > 0
    chosen_missing = (F.when(~has_any | (first_ok > 0), F.array().cast("array<string>"))
                      .otherwise(F.element_at(alt_missing, fewest["i"] + 1)))
    missing = F.array_distinct(F.concat(all_missing, chosen_missing))
    matched_alt = F.when(has_any & (first_ok > 0), F.element_at(F.col("any_of"), first_ok.cast("int"))) \
        .otherwise(F.array().cast("array<string>"))
    supported = F.size(missing) == 0
    matched = F.when(supported, F.array_join(F.array_distinct(F.concat(F.col("all_of"), matched_alt)), ","))
    return j.select("dataset_id", "domain", "cap_order", "capability_id", "capability_name", supported.alias("supported"),
                    F.array_join(missing, ",").alias("missing_fields"), matched.alias("matched_fields"),
                    F.when(~supported, F.lit(MISSING_REASON)).alias("reason"))
