"""Distributed ranks, first appearance and medians against plain versions."""
import random
import statistics

import pytest
from helpers import one, rows
from pyspark.sql import functions as F

from sheetwise.operators import scores as S
from sheetwise.operators.ranking import median, ranked
from sheetwise.plans.results import in_order


def test_ranks_follow_the_keys_over_many_ranges(spark):
    rng = random.Random(3)
    data = [(rng.choice("abcde"), round(rng.uniform(-5, 5), 2), i) for i in range(3000)] + [("z", None, 3000), (None, 1.0, 3001)]
    df = spark.createDataFrame(data, "g string, v double, id long").repartition(7)
    got = {r["id"]: r["rank"] for r in ranked(df, [-F.coalesce("v", F.lit(0.0)), F.col("id")]).collect()}
    want = sorted(data, key=lambda r: (-(r[1] or 0), r[2]))
    assert got == {r[2]: i + 1 for i, r in enumerate(want)}
    within = {r["id"]: r["rank"] for r in ranked(df, [F.col("v"), F.col("id")], within=["g"]).collect()}
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [within[r[2]] for r in own] == list(range(1, len(own) + 1))
    assert ranked(df.where("false"), [F.col("v")]).collect() == []


@pytest.mark.parametrize("values", [[], [None], [4.0], [1.0, 2.0], [3.0, 3.0, 1.0], [0.5, -2.0, 7.25, None, 7.25, 7.25],
                                    [float(i % 37) for i in range(1001)], [1.0] * 500 + [2.0] * 500])
def test_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    known = [v for v in values if v is not None]
    assert one(median(df, F.col("v")))["median"] == (statistics.median(known) if known else None)


def test_median_has_no_single_task_over_values(spark, capsys):
    median(spark.range(1000).select((F.col("id") % 97).cast("double").alias("v")), F.col("v")).explain()
    tree = capsys.readouterr().out
    assert "percentile" not in tree and "median(" not in tree


def test_exam_names_keep_their_order_of_appearance(spark):
    df = spark.createDataFrame([(0, "s", "Exam 10", "50"), (1, "s", "Exam 2", "70"), (2, "t", "Exam 10", "60"), (3, "t", " ", "1")],
                               "_pos long, student_id string, exam_name string, score string")
    got = [(r["rank"], r["name"], r["average"]) for r in sorted(in_order("exam_trend", S.exam_trend(df)).collect())]
    assert got == [(1, "Exam 10", 55.0), (2, "Exam 2", 70.0)]
    from sheetwise.operators import findings as FD
    trend = [r for r in rows(FD.score_findings(df)) if r["code"].startswith("exam_trend")]
    assert trend[0]["code"] == "exam_trend_up" and trend[0]["subject"] == "Exam 10"
    dated = df.withColumn("exam_date", F.when(F.col("_pos") < 2, "2024/1/5"))
    assert [r["name"] for r in in_order("exam_trend", S.exam_trend(dated)).collect()] == ["2024-01-05"]
