"""Ranking, binning and metrics against plain Python on small inputs full of ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duewatch.config import StudyConfig
from duewatch.operators import calibration, metrics, ranking

SCHEMA = "complaint_id long, target int, score float"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def tied_rows(n=4_000, seed=1):
    """A third of all rows share one score; the rest sit on a coarse grid."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        score = 0.25 if i % 3 == 0 else rng.randrange(1, 200) / 200
        rows.append((i, int(rng.random() < 0.05 + 0.3 * score), score))
    rng.shuffle(rows)
    return rows


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_global_rank_is_the_sorted_position(spark):
    rows = tied_rows()
    ranked = ranking.global_rank(frame(spark, rows), F.desc("score"), F.asc("complaint_id")).collect()
    expected = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert {r.complaint_id: r["rank"] for r in ranked} == expected
    assert {r.rank_rows for r in ranked} == {len(rows)}


def test_tied_scores_are_split_over_tasks(spark):
    """One score for all rows: the range split falls inside the tie, by id."""
    same = spark.range(20_000).select(F.col("id").alias("complaint_id"), F.lit(0.5).alias("score"))
    split = same.repartitionByRange(8, F.desc("score"), F.asc("complaint_id"))
    sizes = [r["count"] for r in split.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000


def brute_metrics(rows):
    """Average precision and ROC area from the definitions."""
    pos = [f32(s) for _, y, s in rows if y]
    neg = [f32(s) for _, y, s in rows if not y]
    ap, seen, caught, last = 0.0, 0, 0, 0.0
    for score in sorted({f32(s) for _, _, s in rows}, reverse=True):
        here = [y for _, y, s in rows if f32(s) == score]
        seen, caught = seen + len(here), caught + sum(here)
        recall = caught / len(pos)
        ap += (recall - last) * caught / seen
        last = recall
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return ap, wins / (len(pos) * len(neg))


def test_ranking_metrics_match_their_definitions(spark):
    rows = tied_rows(1_500)
    got = metrics.ranking_metrics(frame(spark, rows)).first()
    ap, auc = brute_metrics(rows)
    assert got.pr_auc == pytest.approx(ap, abs=1e-12)
    assert got.roc_auc == pytest.approx(auc, abs=1e-12)
    assert (got.n, got.n_positive) == (len(rows), sum(r[1] for r in rows))


@pytest.mark.parametrize("label", [0, 1])
def test_single_class_has_no_area(spark, label):
    got = metrics.ranking_metrics(frame(spark, [(i, label, i / 10) for i in range(5)])).first()
    assert got.roc_auc is None
    assert (got.pr_auc is None) == (label == 0)


def test_all_scores_equal(spark):
    rows = [(i, int(i % 4 == 0), 0.5) for i in range(40)]
    got = metrics.ranking_metrics(frame(spark, rows)).first()
    assert got.pr_auc == pytest.approx(0.25) and got.roc_auc == pytest.approx(0.5)


def test_no_rows(spark):
    empty = frame(spark, [])
    assert ranking.decile_lift(empty).count() == 0
    got = metrics.ranking_metrics(empty).first()
    assert got.pr_auc is None and got.n is None
    assert ranking.global_rank(empty, F.asc("score")).count() == 0


def test_order_is_kept_under_a_constant_logit_shift(spark):
    rows = tied_rows(1_000)
    doubles = spark.createDataFrame(rows, "complaint_id long, target int, score double")
    logit = F.ln(F.col("score") / (1 - F.col("score"))) - 1.7
    shifted = doubles.where("score < 1").withColumn("score", 1 / (1 + F.exp(-logit)))
    a = metrics.ranking_metrics(doubles.where("score < 1")).first()
    b = metrics.ranking_metrics(shifted).first()
    assert a.pr_auc == pytest.approx(b.pr_auc, abs=1e-12)
    assert a.roc_auc == pytest.approx(b.roc_auc, abs=1e-12)


def test_ladder_running_counts_with_extreme_scores(spark):
    scores = [0.0, 1e-38, 1e-20, 1e-3, 0.5, math.nextafter(0.5, 1), 1.0, -2.5, -0.001, 7.0]
    rows = [(i, i % 2, s) for i, s in enumerate(scores * 3)]
    doubles = spark.createDataFrame(rows, "complaint_id long, target int, score double")
    ladder = {r.score: r for r in ranking.score_ladder(doubles).collect()}
    assert len(ladder) == len(scores)
    for score, row in ladder.items():
        assert row.n_above == sum(s > score for _, _, s in rows)
        assert row.pos_above == sum(y for _, y, s in rows if s > score)
        assert (row.n_total, row.pos_total) == (len(rows), sum(y for _, y, _ in rows))


def test_float_scores_meet_float_thresholds(spark):
    """0.70 stored as float is below 0.70 as double, and still counts as flagged."""
    rows = [(i, 1, t) for i, t in enumerate([0.35, 0.45, 0.65, 0.70, 0.90])]
    table = metrics.metrics_at_thresholds(frame(spark, rows), [0.35, 0.45, 0.65, 0.70, 0.90])
    assert {r.threshold: r.flagged for r in table.collect()} == {
        0.35: 5, 0.45: 4, 0.65: 3, 0.70: 2, 0.90: 1,
    }


def test_evaluate_agrees_with_the_separate_metrics(spark):
    scored = frame(spark, tied_rows())
    whole = metrics.evaluate(scored, 0.6).first().asDict()
    cut = metrics.metrics_at_threshold(scored, 0.6).first().asDict()
    ranked = metrics.ranking_metrics(scored).first().asDict()
    for part in (cut, ranked):
        assert {k: whole[k] for k in part} == part


# Published threshold sweep (threshold, precision, recall, f1, accuracy, tp, fp, tn, fn, reviews).
SWEEP = [
    (0.3, 0.07629288274449565, 0.8472473507366245, 0.13998078360200705, 0.9705376464422484, 6556, 79376, 2647155, 1182, 13.10738255033557),
    (0.35, 0.08183969355871933, 0.8089945722408891, 0.14864239157534817, 0.9737739776152237, 6260, 70231, 2656300, 1478, 12.219009584664537),
    (0.4, 0.08727025388516761, 0.7627293874386146, 0.156620271471599, 0.9767532016784011, 5902, 61727, 2664804, 1836, 11.4586580820061),
    (0.45, 0.09518166768319247, 0.7058671491341432, 0.1677441149824179, 0.9801778830100477, 5462, 51923, 2674608, 2276, 10.506224826071037),
    (0.5, 0.11033681765389082, 0.6138537089687258, 0.18705205954162402, 0.9848998032015138, 4750, 38300, 2688231, 2988, 9.063157894736841),
    (0.55, 0.14390104797889783, 0.5217110364435255, 0.2255811354492624, 0.9898627384503865, 4037, 24017, 2702514, 3701, 6.949219717612088),
    (0.6, 0.17624941250195833, 0.4361592142672525, 0.25105069364376836, 0.9926353259317207, 3375, 15774, 2710757, 4363, 5.673777777777778),
    (0.65, 0.2075208913649025, 0.3851124321530111, 0.2697076658521133, 0.9940978740570149, 2980, 11380, 2715151, 4758, 4.818791946308725),
    (0.7, 0.2491682070240296, 0.34841044197467047, 0.29054855049035455, 0.9951848190503568, 2696, 8124, 2718407, 5042, 4.013353115727003),
    (0.75, 0.3155397390272835, 0.30938226932023777, 0.31243066884176185, 0.996146319180739, 2394, 5193, 2721338, 5344, 3.169172932330827),
    (0.8, 0.37733667373289653, 0.25303696045489793, 0.3029318480699312, 0.9967044208159476, 1958, 3231, 2723300, 5780, 2.6501532175689477),
    (0.85, 0.4311668372569089, 0.21775652623416902, 0.28936974068349647, 0.9969732312365754, 1685, 2223, 2724308, 6053, 2.319287833827893),
    (0.9, 0.5048584706379383, 0.1544326699405531, 0.23651657595249875, 0.997178404904565, 1195, 1172, 2725359, 6543, 1.9807531380753138),
]

# Published deciles (decile, records, untimely, rate, lift, cumulative share in percent).
PUBLISHED_DECILES = [
    (1, 544297, 23716, 0.043571799954804084, 9.657538554676867, 96.57531457425581),
    (2, 544297, 603, 0.0011078510445583936, 0.2455513471272622, 99.03082624099035),
    (3, 544297, 63, 0.0001157456315210262, 0.025654618356579634, 99.28737223602232),
    (4, 544297, 27, 4.960527065186837e-05, 0.01099483643853413, 99.39732051960745),
    (5, 544297, 35, 6.430312862279233e-05, 0.014252565753655352, 99.53984607240298),
    (6, 544297, 25, 4.593080615913738e-05, 0.010180404109753823, 99.64165003868551),
    (7, 544297, 25, 4.593080615913738e-05, 0.010180404109753823, 99.74345400496803),
    (8, 544297, 17, 3.123294818821342e-05, 0.0069226747946325995, 99.81268070204015),
    (9, 544297, 8, 1.4697857970923963e-05, 0.003257729315121224, 99.84525797125056),
    (10, 544301, 38, 6.981431230146555e-05, 0.015474100528759912, 100.0),
]


def test_rates_reproduce_the_published_sweep(spark):
    counts = spark.createDataFrame(
        [(r[0], *r[5:9]) for r in SWEEP], "threshold double, tp long, fp long, tn long, fn long"
    )
    for row, want in zip(metrics._with_rates(counts, []).orderBy("threshold").collect(), SWEEP):
        assert (row.precision, row.recall, row.f1, row.accuracy, row.reviews_per_catch) == pytest.approx(
            (*want[1:5], want[9]), rel=1e-12
        )


def test_nothing_flagged_gives_zero_precision_and_no_reviews(spark):
    row = metrics.metrics_at_threshold(frame(spark, [(1, 1, 0.1), (2, 0, 0.2)]), 0.6).first()
    assert (row.precision, row.recall, row.f1) == (0, 0, 0)
    assert row.reviews_per_catch is None


def test_lift_deciles_put_the_remainder_last(spark):
    rows = [(i, int(i < 30), 1 - i / 1000) for i in range(107)]
    lift = ranking.decile_lift(frame(spark, rows)).orderBy("decile").collect()
    assert [r.records for r in lift] == [10] * 9 + [17]
    assert [r.untimely for r in lift] == [10, 10, 10] + [0] * 7
    assert lift[-1].cumulative_untimely_pct == 100
    assert lift[0].lift == pytest.approx(107 / 30)


def test_fewer_rows_than_deciles(spark):
    lift = ranking.decile_lift(frame(spark, [(i, 0, i / 10) for i in range(4)])).orderBy("decile")
    got = lift.collect()
    assert [r.decile for r in got] == [1, 2, 3, 4]
    assert all(r.lift is None for r in got)


def test_ascending_decile_merges_equal_edges(spark):
    rows = [(0.5,)] * 50 + [(0.1,)] * 5 + [(0.9,)] * 5
    df = spark.createDataFrame(rows, "pred_proba double")
    got = {r.pred_proba: r.decile for r in ranking.add_decile(df).distinct().collect()}
    assert got == {0.1: 1, 0.5: 1, 0.9: 2}  # edges 0.1, 0.5, 0.9
    single = spark.createDataFrame([(0.4,)] * 7, "pred_proba double")
    assert {r.decile for r in ranking.add_decile(single).collect()} == {1}


def test_triage_queue_is_the_head_of_the_full_ranking(spark):
    scored = frame(spark, tied_rows())
    full = {r.complaint_id: (r["rank"], r.percentile, r.decile) for r in ranking.triage_rank(scored).collect()}
    for k in (1, 700, 3_000, 10_000):
        queue = ranking.triage_queue(scored, k, 0.6).collect()
        assert len(queue) == min(k, len(full))
        assert {r["rank"] for r in queue} == set(range(1, len(queue) + 1))
        assert all(full[r.complaint_id] == (r["rank"], r.percentile, r.decile) for r in queue)


def test_histogram_edges(spark):
    """A value on an edge belongs to the bin on its right; 1 belongs to the last bin."""
    doubles = spark.createDataFrame(
        [(i, 0, i * 0.02) for i in range(51)] + [(99, 0, 1.5)],
        "complaint_id long, target int, score double",
    )
    bins = {r.bin: r.n for r in ranking.score_histogram(doubles).collect()}
    assert bins == {**{i: 1 for i in range(49)}, 49: 2}


def test_chi_square_tail(spark):
    row = spark.range(1).select(
        calibration.chi_square_tail(F.lit(15.5), 8).alias("p8"),
        calibration.chi_square_tail(F.lit(5.991464547107979), 2).alias("p2"),
    ).first()
    assert row.p8 == pytest.approx(0.050122, abs=1e-6)
    assert row.p2 == pytest.approx(0.05, abs=1e-12)
    odd = spark.range(1).select(
        calibration.chi_square_tail(F.lit(3.841458820694124), 1).alias("p1"),
        calibration.chi_square_tail(F.lit(14.067140449340169), 7).alias("p7"),
    ).first()
    assert odd.p1 == pytest.approx(0.05, abs=1e-12)
    assert odd.p7 == pytest.approx(0.05, abs=1e-12)
    with pytest.raises(ValueError):
        calibration.chi_square_tail(F.lit(1.0), 0)


def test_lift_reproduces_the_published_deciles(spark):
    counts = spark.createDataFrame([row[:3] for row in PUBLISHED_DECILES], "decile int, records long, untimely long")
    for got, want in zip(ranking.with_lift(counts).orderBy("decile").collect(), PUBLISHED_DECILES, strict=True):
        assert tuple(got) == pytest.approx(want, rel=1e-12)


def test_sweep_follows_the_config(spark):
    cfg = StudyConfig(sweep=(0.2, 0.8))
    got = metrics.threshold_sweep(frame(spark, tied_rows(300)), cfg).collect()
    assert [r.threshold for r in got] == [0.2, 0.8]


def test_crowded_double_scores(spark):
    """Many distinct doubles in a sliver of the range: the second band level separates them."""
    rng = random.Random(9)
    rows = [(i, i % 3 == 0, 0.16 + 1e-4 * rng.random()) for i in range(3_000)]
    rows = [(i, int(y), s) for i, y, s in rows]
    doubles = spark.createDataFrame(rows, "complaint_id long, target int, score double")
    order = sorted(rows, key=lambda r: -r[2])
    ladder = {r.score: r for r in ranking.score_ladder(doubles).collect()}
    assert [ladder[s].n_above for _, _, s in order] == list(range(3_000))
    caught = 0
    for _, y, s in order:
        assert ladder[s].pos_above == caught
        caught += y


def test_missing_scores_fall_back_to_rank_bins(spark):
    rows = [(i, 0.5 if i < 12 else i / 100) for i in range(20)] + [(98, None), (99, None)]
    df = spark.createDataFrame(rows, "complaint_id int, pred_proba double")
    got = {r.complaint_id: r.decile for r in ranking.add_decile(df).collect()}
    assert got[98] is None and got[99] is None
    order = sorted((p, i) for i, p in rows if p is not None)
    assert [got[i] for _, i in order] == [k // 2 + 1 for k in range(20)]
    assert sum(r.records for r in ranking.decile_summary(ranking.add_decile(df)).collect()) == 20


def test_roc_corners_are_the_points_where_the_curve_turns(spark):
    """Against second differences of the running counts; floats and doubles, also with bands of one score."""
    rng = np.random.default_rng(5)
    for kind, size, values in (("float", 400, 60), ("double", 300, 10**6), ("double", 1, 1), ("double", 2, 1), ("float", 2, 9)):
        score = rng.integers(1, values + 1, size) / (values * 3.0)
        score = score.astype(np.float32 if kind == "float" else np.float64)
        target = (rng.random(size) < 0.3).astype(int)
        df = spark.createDataFrame(list(zip(score.tolist(), target.tolist())), f"score {kind}, target int")
        found = {r.threshold: (r.fpr, r.tpr) for r in metrics.roc_corners(ranking.score_ladder(df)).collect()}
        levels = np.unique(score)[::-1]
        tp = np.array([target[score >= x].sum() for x in levels])
        fp = np.array([(1 - target)[score >= x].sum() for x in levels])
        bend = np.ones(len(levels), bool)
        if len(levels) > 2:
            bend[1:-1] = (np.diff(tp, 2) != 0) | (np.diff(fp, 2) != 0)
        assert found.pop(None) == (0.0, 0.0)
        assert sorted(found) == sorted(float(x) for x in levels[bend])
        for x, t, f in zip(levels[bend], tp[bend], fp[bend]):
            ratio = (f / fp[-1] if fp[-1] else None, t / tp[-1] if tp[-1] else None)
            assert found[float(x)] == pytest.approx(ratio) if None not in ratio else found[float(x)] == ratio
    full = metrics.roc_curve(ranking.score_ladder(df))
    assert metrics.roc_corners(ranking.score_ladder(df.limit(0))).count() == full.limit(1).count()
