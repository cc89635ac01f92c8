"""Statistical operators against formulas and brute force."""

from __future__ import annotations

import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from agoralytics.functions.ranking import magnitude
from agoralytics.functions.tails import (
    _chi_square_upper,
    _normal_upper,
    _rank_sum_upper,
    _student_two_sided,
)
from agoralytics.operators import hypothesis as h

LATE = [1, 1, 1, 2, 2, 3, 5, 1, 4]
PUNCTUAL = [5, 5, 4, 4, 3, 5, 5, 2, 5, 4, 1, 5]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(h.DELAYED, True, s, 1 + i) for i, s in enumerate(LATE)]
    rows += [(h.PUNCTUAL, False, s, -3) for s in PUNCTUAL]
    return spark.createDataFrame(
        rows, "delivery_status string, is_delayed boolean, review_score int, delay_days int"
    )


# Known values of the distributions, from printed tables to more digits.
@pytest.mark.parametrize(
    ("t", "df", "p"),
    [
        (2.0, 10, 0.07338803477074042),
        (1.0, 1, 0.5),
        (2.228138851964939, 10, 0.05),
        (1.959963984540054, 1e9, 0.05),
        (0.0, 7, 1.0),
    ],
)
def test_student_tail(t, df, p):
    assert _student_two_sided(t, df) == pytest.approx(p, rel=1e-6)
    assert _student_two_sided(-t, df) == pytest.approx(p, rel=1e-6)


def test_normal_tail():
    assert _normal_upper(0) == 0.5
    assert _normal_upper(1.959963984540054) == pytest.approx(0.025)
    assert _normal_upper(-1.0) == pytest.approx(0.8413447460685429)


@pytest.mark.parametrize(
    ("x", "df", "p"),
    [
        (3.841458820694124, 1, 0.05),
        (5.991464547107979, 2, 0.05),
        (7.814727903251179, 3, 0.05),
        (9.487729036781154, 4, 0.05),
        (11.070497693516351, 5, 0.05),
        (16.918977604620448, 9, 0.05),
    ],
)
def test_chi_square_tail(x, df, p):
    assert _chi_square_upper(x, df) == pytest.approx(p, rel=1e-9)


def test_extreme_statistics_underflow_to_zero():
    assert _chi_square_upper(14252.21, 4) == 0.0
    assert _student_two_sided(-89.55, 8486.0) < 1e-300 or _student_two_sided(-89.55, 8486.0) == 0.0


def test_welch_and_effect_size(frame):
    row = h.welch_t_test(frame).first()
    m1, m2 = statistics.mean(LATE), statistics.mean(PUNCTUAL)
    v1, v2 = statistics.variance(LATE), statistics.variance(PUNCTUAL)
    n1, n2 = len(LATE), len(PUNCTUAL)
    assert row.t_statistic == pytest.approx((m1 - m2) / math.sqrt(v1 / n1 + v2 / n2))
    df = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    assert row.degrees_of_freedom == pytest.approx(df)
    pooled = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    assert row.cohens_d == pytest.approx((m1 - m2) / pooled)
    assert row.p_value == pytest.approx(_student_two_sided(row.t_statistic, df))
    assert h.cohens_d(frame).first().cohens_d == pytest.approx(row.cohens_d)
    assert h.mean_difference(frame).first().mean_difference == pytest.approx(m1 - m2)
    decision = h.significance_decision(h.welch_t_test(frame)).first()
    assert decision.decision == h.REJECT and decision.effect_size == pytest.approx(-row.cohens_d)
    assert h.significance_decision(h.welch_t_test(frame), alpha=1e-9).first().decision == h.KEEP


@pytest.mark.parametrize("alternative", ["less", "greater", "two-sided"])
def test_mann_whitney_counts_every_pair(frame, alternative):
    wins = sum(
        1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(LATE, PUNCTUAL)
    )
    n1, n2 = len(LATE), len(PUNCTUAL)
    n = n1 + n2
    every = LATE + PUNCTUAL
    tied = sum(every.count(v) ** 3 - every.count(v) for v in set(every))
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - tied / (n * (n - 1))))
    u = {"less": n1 * n2 - wins, "greater": wins, "two-sided": max(wins, n1 * n2 - wins)}[alternative]
    p = _normal_upper((u - n1 * n2 / 2 - 0.5) / spread) * (2 if alternative == "two-sided" else 1)
    row = h.mann_whitney_u(frame, alternative=alternative).first()
    assert (row.n1, row.n2, row.u_statistic) == (n1, n2, wins)
    assert row.p_value == pytest.approx(min(p, 1.0))


def test_chi_square_counts_unseen_cells(frame):
    total = len(LATE) + len(PUNCTUAL)
    expected = 0.0
    for sample in (LATE, PUNCTUAL):
        for score in h.SCORES:
            e = len(sample) * (LATE + PUNCTUAL).count(score) / total
            expected += (sample.count(score) - e) ** 2 / e
    row = h.chi_square_test(frame).first()
    assert (row.n, row.degrees_of_freedom) == (total, 4)
    assert row.chi_square == pytest.approx(expected)
    assert row.p_value == pytest.approx(_chi_square_upper(expected, 4))


@pytest.mark.parametrize("cells", [(12, 5, 3, 9), (10, 0, 4, 8), (3, 3, 3, 3)])
def test_two_by_two_table_is_corrected(spark, cells):
    a, b, c, d = cells
    rows = [("x", 1)] * a + [("x", 2)] * b + [("y", 1)] * c + [("y", 2)] * d
    frame = spark.createDataFrame(rows, "delivery_status string, review_score int")
    n = a + b + c + d
    expected = 0.0
    for seen, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        e = r * k / n
        gap = abs(seen - e)
        expected += (gap - min(0.5, gap)) ** 2 / e
    row = h.chi_square_test(frame).first()
    assert row.degrees_of_freedom == 1
    assert row.chi_square == pytest.approx(expected, abs=1e-12)


def test_descriptives_and_risk_ratio(frame):
    rows = {r.cohort: r for r in h.cohort_descriptives(frame).collect()}
    late = rows["Delayed Orders"]
    assert late.sample_size == 9 and late.median_score == statistics.median(LATE)
    assert late.mean_score == round(statistics.mean(LATE), 3)
    assert late.std_deviation == round(statistics.stdev(LATE), 3)
    assert late.one_star_pct == pytest.approx(44.444)
    ratio = h.one_star_risk_ratio(h.cohort_descriptives(frame)).first()
    assert ratio.risk_ratio == pytest.approx(5.33)


def test_box_statistics(frame):
    rows = {r.delivery_status: r for r in h.review_box_stats(frame).collect()}
    on_time = rows[h.PUNCTUAL]
    # quartiles 3.75 and 5: one and a half ranges below is 1.875
    assert (on_time.q1, on_time.median, on_time.q3) == (3.75, 4.5, 5.0)
    assert (on_time.whisker_low, on_time.min_score, on_time.whisker_high) == (2.0, 1.0, 5.0)


def test_tables_keep_an_absent_status(spark, frame):
    only = frame.filter("is_delayed")
    rows = h.contingency_table(only).collect()
    assert [r.delivery_status for r in rows] == [h.PUNCTUAL, h.DELAYED]
    assert rows[0].score_1 is None and rows[1].score_1 == 4 and rows[1].score_5 == 1
    shares = h.review_share_by_status(only).collect()
    assert shares[0].score_1_pct is None and shares[1].score_1_pct == pytest.approx(400 / 9)


def test_severity_keeps_empty_bins(frame):
    rows = h.delay_severity(frame).collect()
    assert [(r.delay_bucket, r["count"]) for r in rows] == [
        ("On-Time (0)", 12),
        ("1-3 Days", 3),
        ("4-7 Days", 4),
        ("8-14 Days", 2),
        ("15-30 Days", 0),
        ("30+ Days", 0),
    ]
    assert rows[4]["mean"] is None and rows[1]["mean"] == 1.0


def test_one_group_only(frame):
    row = h.welch_t_test(frame.filter("is_delayed")).first()
    assert row.t_statistic is None
    assert row.p_value is None or math.isnan(row.p_value)


def test_scores_outside_the_scale_are_counted(spark):
    frame = spark.createDataFrame(
        [("Late", 0), ("Late", 6), ("Late", 1), ("Late", None), ("On Time", 5)],
        "delivery_status string, review_score int",
    )
    counts = h.contingency_table(frame, row_order=("Late", "On Time")).collect()
    assert [(r.score_1, r.score_other) for r in counts] == [(1, 2), (0, 0)]
    shares = [r for r in h.review_share_by_status(frame).collect() if r.delivery_status == "Late"]
    assert all(abs(sum(v for k, v in r.asDict().items() if k != "delivery_status") - 100) < 1e-9 for r in shares)


def _enumerated_upper(u: int, small: int, large: int) -> float:
    """P(U >= u) from every choice of ranks for the first group."""
    wins = [sum(r - k for k, r in enumerate(chosen)) for chosen in itertools.combinations(range(small + large), small)]
    return sum(w >= u for w in wins) / len(wins)


@pytest.mark.parametrize(("small", "large"), [(1, 1), (1, 6), (2, 5), (3, 3), (4, 7), (6, 6), (8, 9)])
def test_rank_sum_counts_all_arrangements(small, large):
    for u in range(small * large + 2):
        assert _rank_sum_upper(u, small, large) == pytest.approx(_enumerated_upper(u, small, large), abs=1e-15)


def test_rank_sum_of_a_few_against_a_billion():
    assert _rank_sum_upper(10**9 // 4, 1, 10**9) == pytest.approx(0.75)
    # the largest of eight uniform shares: P(all eight above t) tends to the sum's tail at its centre
    assert _rank_sum_upper(4 * 10**9, 8, 10**9) == pytest.approx(0.5, abs=1e-8)


@pytest.mark.parametrize("alternative", ["less", "greater", "two-sided"])
def test_small_untied_samples_use_the_exact_distribution(spark, alternative):
    mine, theirs = [1.5, 2.25, 9.0, -4.0], [3.0, 8.0, 2.0, 11.0, 7.5]
    rows = [(h.DELAYED, v) for v in mine] + [(h.PUNCTUAL, v) for v in theirs]
    rows += [(h.DELAYED, None), (h.PUNCTUAL, math.nan), (None, 1.0), ("other", 2.0)]
    frame = spark.createDataFrame(rows, "delivery_status string, review_score double")
    row = h.mann_whitney_u(frame, alternative=alternative).first()
    u = sum(a > b for a in mine for b in theirs)
    other = 20 - u
    larger = {"less": other, "greater": u, "two-sided": max(u, other)}[alternative]
    p = _enumerated_upper(larger, 4, 5) * (2 if alternative == "two-sided" else 1)
    assert (row.n1, row.n2, row.u_statistic) == (4, 5, u)
    assert row.p_value == pytest.approx(min(p, 1.0))
    limit = h.mann_whitney_u(frame, alternative=alternative, method="asymptotic").first()
    deviation = math.sqrt(20 * 10 / 12)
    sides = 2 if alternative == "two-sided" else 1
    assert limit.p_value == pytest.approx(min(1.0, sides * _normal_upper((larger - 10 - 0.5) / deviation)))
    with pytest.raises(ValueError):
        h.mann_whitney_u(frame, method="guess")


def test_a_tie_brings_back_the_normal_limit(spark):
    rows = [(h.DELAYED, v) for v in (1.0, 2.0)] + [(h.PUNCTUAL, v) for v in (2.0, 3.0, 4.0)]
    frame = spark.createDataFrame(rows, "delivery_status string, review_score double")
    both = [h.mann_whitney_u(frame, method=m).first() for m in ("auto", "asymptotic")]
    assert both[0] == both[1] and both[0].u_statistic == 0.5


def test_u_without_values_or_without_a_group(spark):
    schema = "delivery_status string, review_score double"
    assert h.mann_whitney_u(spark.createDataFrame([], schema)).first().p_value is None
    one_sided = spark.createDataFrame([(h.DELAYED, 1.0), (h.DELAYED, 2.0)], schema)
    row = h.mann_whitney_u(one_sided).first()
    assert (row.n1, row.n2, row.p_value) == (2, 0, None)


def test_u_of_many_distinct_values_sees_no_window_over_all(spark):
    n = 200_000
    # values spread over both signs; every third repeats across the groups
    value = F.when(F.col("id") % 3 == 0, F.col("id") % 1000).otherwise(F.sin(F.col("id").cast("double")) * F.col("id"))
    status = F.when(F.hash("id") % 2 == 0, h.DELAYED).otherwise(h.PUNCTUAL)
    frame = spark.range(n).select(status.alias("delivery_status"), value.alias("review_score"))
    got = h.mann_whitney_u(frame).first()
    counts = {}
    for r in frame.collect():
        counts.setdefault(r.review_score, [0, 0])[r.delivery_status == h.PUNCTUAL] += 1
    u = below = 0.0
    for v in sorted(counts):
        u += counts[v][0] * (below + counts[v][1] / 2)
        below += counts[v][1]
    assert got.u_statistic == u and len(counts) > 100_000
    # values are ordered inside a magnitude; the largest is a small part of them
    numbers = frame.select("review_score").distinct()
    largest = numbers.groupBy(magnitude(F.col("review_score")).alias("m")).count().agg(F.max("count")).first()[0]
    assert largest < len(counts) / 50


def test_chi_square_with_many_categories(spark):
    n, kinds = 60_000, 9_000
    frame = spark.range(n).select(
        (F.hash("id") % 7).cast("string").alias("delivery_status"), (F.xxhash64("id") % kinds).alias("review_score")
    )
    got = h.chi_square_test(frame).first()
    seen, r, c = {}, {}, {}
    for row in frame.collect():
        a, b = row
        seen[a, b] = seen.get((a, b), 0) + 1
        r[a] = r.get(a, 0) + 1
        c[b] = c.get(b, 0) + 1
    plain = n * (sum(x * x / (r[a] * c[b]) for (a, b), x in seen.items()) - 1)
    assert (got.n, got.degrees_of_freedom) == (n, (len(r) - 1) * (len(c) - 1))
    assert got.chi_square == pytest.approx(plain)
    plan = h.chi_square_test(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_chi_square_ignores_clashing_names_and_missing_categories(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "y", 4), ("b", "y", 5), (None, "x", 6), ("a", None, 7)]
    frame = spark.createDataFrame(rows, "seen string, r string, c int")
    got = h.chi_square_test(frame, "seen", "r").first()
    assert (got.n, got.degrees_of_freedom) == (5, 1)
