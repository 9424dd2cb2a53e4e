"""Encoders and models against independent solutions."""

import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duewatch.config import StudyConfig
from duewatch.operators import checks, encoding, models, text_model
from duewatch.operators.forest import NODES, Forest
from duewatch.session import fit_tasks

CFG = StudyConfig(categorical=("product", "company"), logistic_iterations=500, tree_count=5, text_min_df=2)


def sample_rows(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        product = rng.choice(["a", "b", None])
        company = rng.choice(["big"] * 6 + ["mid"] * 2 + [f"tiny{i % 40}"])
        month = rng.randrange(1, 13)
        logit = -1 + (product == "a") + 1.5 * (company == "mid") + 0.05 * month
        rows.append((i, product, company, 2020 + i % 4, month, (month + 2) // 3,
                     int(rng.random() < 1 / (1 + math.exp(-logit)))))
    return rows


@pytest.fixture(scope="module")
def train(spark):
    schema = "complaint_id long, product string, company string, year int, month int, quarter int, target int"
    return spark.createDataFrame(sample_rows(), schema)


@pytest.fixture(scope="module")
def logistic(train):
    return models.train_logreg(train, CFG)


def dense(train):
    """The same design matrix built in pandas."""
    df = train.toPandas()
    blocks = []
    for c in CFG.categorical:
        filled = df[c].fillna("MISSING")
        counts = filled.value_counts()
        merged = filled.where(filled.map(counts) >= 10, "infrequent_sklearn")
        blocks.append(pd.get_dummies(merged).astype(float).to_numpy())
    numbers = df[list(CFG.numeric)].to_numpy(dtype=float)
    blocks.append((numbers - numbers.mean(0)) / numbers.std(0))
    return np.hstack(blocks), df.target.to_numpy()


def newton(x, y, c=1.0):
    """Minimise C * sum(log loss) + |w|^2 / 2 with a free intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.solve(c * (x1.T * (p * (1 - p))) @ x1 + penalty, c * x1.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return w


def test_logistic_scores_match_newton(train, logistic):
    x, y = dense(train)
    w = newton(x, y)
    want = 1 / (1 + np.exp(-(np.hstack([x, np.ones((len(x), 1))]) @ w)))
    got = {r.complaint_id: r.score for r in logistic.score(train, "complaint_id").collect()}
    ids = [r.complaint_id for r in train.collect()]
    assert max(abs(got[i] - p) for i, p in zip(ids, want)) < 1e-4


def test_relational_scoring_equals_vector_scoring(train):
    """Joins and arithmetic give what MLlib gives on the encoded vectors."""
    encoder = encoding.Encoder.fit(train, CFG)
    vectors = encoder.transform(train, encoder.scaling)
    fitted = models.fit_logistic(vectors, train.count(), CFG)
    p = vector_to_array(F.col("probability"))[1]
    mllib = fitted.transform(vectors).select("complaint_id", p.alias("p"))
    ours = models.train_logreg(train, CFG, encoder).score(train, "complaint_id")
    gap = mllib.join(ours, "complaint_id").agg(F.max(F.abs(F.col("p") - F.col("score")))).first()[0]
    assert gap < 1e-6


def test_unseen_levels_score_without_a_weight(spark, train, logistic):
    """Unknown means an empty block, not the infrequent one; the row is still scored."""
    rare = train.where(F.col("company").startswith("tiny")).first().company
    rows = spark.createDataFrame(
        [(1, "never seen", "never seen", 2021, 6, 2), (2, "a", rare, 2021, 6, 2)],
        "complaint_id long, product string, company string, year int, month int, quarter int",
    )
    margins = {r.complaint_id: r.margin for r in logistic.margin(rows).collect()}
    plain = logistic.intercept + sum(
        w * (v - mean) / std
        for (mean, std, w), v in zip(logistic.numbers.values(), (2021, 6, 2))
    )
    assert margins[1] == pytest.approx(plain, abs=1e-12)
    named = {r.feature: r.coefficient for r in logistic.coefficients.collect()}
    assert margins[2] == pytest.approx(
        plain + named["cat__product_a"] + named["cat__company_infrequent_sklearn"], abs=1e-12
    )


def test_encoded_names_and_count(train, logistic):
    names = [r.feature for r in logistic.coefficients.collect()]
    assert set(names) == {
        "cat__product_MISSING", "cat__product_a", "cat__product_b", "cat__company_big",
        "cat__company_mid", "cat__company_infrequent_sklearn", "num__year", "num__month", "num__quarter",
    }
    levels = encoding.category_levels(train, CFG.categorical)
    assert encoding.encoded_feature_count(levels, CFG.numeric).first().total == len(names)
    table = models.logreg_coefficients(logistic).collect()
    assert [r.abs_coef for r in table] == sorted((r.abs_coef for r in table), reverse=True)
    assert all((r.direction == models.DIRECTIONS[0]) == (r.coefficient > 0) for r in table)


def test_stored_logistic_scores_the_same(spark, train, logistic, tmp_path):
    path = str(tmp_path / "model")
    assert not models.model_exists(spark, path)
    logistic.save(path)
    assert models.model_exists(spark, path)
    loaded = models.LinearModel.load(spark, path, CFG)
    a = {r.complaint_id: r.score for r in logistic.score(train, "complaint_id").collect()}
    b = {r.complaint_id: r.score for r in loaded.score(train, "complaint_id").collect()}
    assert a == b


def test_constant_feature_keeps_unit_scale(spark, train):
    stats = encoding.fit_scaling(train.withColumn("month", F.lit(4)), ["month"])
    assert stats == {"month": (4.0, 0.0)}
    got = train.withColumn("month", F.lit(4)).select(encoding.scaled("month", 4.0, 0.0).alias("v")).first().v
    assert got == 0


def test_target_rates_leave_out_the_own_fold(train):
    rates = models.target_encoding(train, ["company"]).where("level = 'mid'").collect()
    rows = train.where("company = 'mid'").withColumn("fold", models._fold()).collect()
    prior = train.agg(F.avg("target")).first()[0]
    for r in rates:
        others = [x.target for x in rows if x.fold != r.fold]
        assert r.rate == pytest.approx((sum(others) + prior) / (len(others) + 1))
    assert {r.fold for r in rates} == set(range(-1, models.FOLDS))


def test_trees_score_rank_and_reload(spark, train, tmp_path):
    trees = models.train_gbt(train, CFG)
    importance = trees.importance().collect()
    assert sum(r.importance for r in importance) == pytest.approx(100)
    assert {r.feature for r in importance} == {"product", "company", "year", "month", "quarter"}
    path = str(tmp_path / "trees")
    trees.save(path)
    again = models.TreeModel.load(spark, path, CFG)
    unseen = train.withColumn("company", F.lit("never seen"))
    a = sorted(r.score for r in trees.score(unseen).collect())
    assert a == sorted(r.score for r in again.score(unseen).collect()) and len(a) == train.count()


def test_stored_trees_as_a_table_of_nodes(spark, train, tmp_path):
    """The node table of a fitted and stored ensemble, written and read again, scores as the ensemble does."""
    trees = models.train_gbt(train, CFG)
    path = str(tmp_path / "trees")
    trees.save(path)
    features = [f"{c}_rate" for c in trees.columns] + [f"{n}_num" for n in trees.numeric]
    Forest.of_stored_trees(spark, f"{path}/trees", features).save(f"{path}/table")
    forest = Forest.load(spark, f"{path}/table")
    rows = models._tree_features(train.withColumn("fold", F.lit(-1)), trees.rates, trees.prior, trees.columns, trees.numeric)
    scored = forest.score(rows, "complaint_id", scale=2.0)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    got = dict(map(tuple, scored.collect()))
    expected = dict(map(tuple, trees.score(train, "complaint_id").collect()))
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-6 for k in got)


def test_missing_features_go_to_the_lower_child_and_a_tree_may_be_a_leaf(spark):
    nodes = [(0, 0, "x", 1.5, 1, 2, None), (0, 1, None, None, None, None, -1.0), (0, 2, None, None, None, None, 2.0),
             (7, 0, None, None, None, None, 0.25)]
    forest = Forest(spark.createDataFrame(nodes, NODES), 0.5)
    rows = spark.createDataFrame([(1, 1.5), (2, 1.6), (3, None)], "id int, x double")
    got = dict(map(tuple, rows.select("id", forest.margin().alias("margin")).collect()))
    assert got == {1: -0.25, 2: 2.75, 3: -0.25}
    assert Forest(spark.createDataFrame([], NODES), 0.5).score(rows, "id").where("score > 0.6").count() == 3


def test_ablation_covers_variants_and_periods(spark, train):
    evaluated = train.withColumn("year", F.when(F.col("complaint_id") % 2 == 0, 2024).otherwise(2025))
    table = models.year_ablation(train, evaluated, CFG)
    rows = {(r.variant, r.period): r for r in table.collect()}
    assert set(rows) == {(v, p) for v in models.VARIANTS for p in (2024, 2025)}
    # Within one period capping shifts every score by the same logit, so the order is unchanged.
    for p in (2024, 2025):
        assert rows["baseline", p].roc_auc == pytest.approx(rows["capped", p].roc_auc, abs=2e-3)
    shift = {r.variant: r for r in models.ablation_shift(table, CFG).collect()}
    assert shift["dropped"].recall_fall == pytest.approx(
        rows["dropped", 2024].recall - rows["dropped", 2025].recall
    )


def test_gate_passes_within_tolerance_and_stops_outside(spark):
    expected = checks.expected_metrics(spark, [(2024, 0.40, 0.20)])
    near = checks.expected_metrics(spark, [(2024, 0.41, 0.199)])
    far = checks.expected_metrics(spark, [(2024, 0.43, 0.20)])
    checks.require(checks.baseline_gate(near, expected), "gate")
    with pytest.raises(RuntimeError, match="2024 recall"):
        checks.require(checks.baseline_gate(far, expected), "gate")
    missing = checks.baseline_gate(near.where("metric = 'recall'"), expected).collect()
    assert sorted(r.passed for r in missing) == [False, True]


# --------------------------------------------------------------------------- text

TEXTS = [
    "The bank's café refused XXXX my dispute, XX/XX/2020!",
    "the BANK's cafe refused my dispute a second time",
    "naïve Ünïcode ﬁnance dispute xxxxxxxx resolved",
    "x y z",
    "payment_id 42 payment_id 42 payment_id",
    "",
]


def brute_terms(text):
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    words = [w for w in re.findall(r"\b\w\w+\b", plain) if w not in {"xxxx", "xx", "xxxxxxxx", "xxxxxxxxxxxx"}]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, int("dispute" in t), t) for i, t in enumerate(TEXTS)] + [(99, 0, None)]
    return spark.createDataFrame(rows, "complaint_id int, target int, narrative string")


def test_term_statistics_match_plain_python(docs):
    found = [brute_terms(t) for t in TEXTS]
    want = {
        term: (sum(f.count(term) for f in found), sum(term in f for f in found))
        for term in {t for f in found for t in f}
    }
    stats = {r.term: r for r in text_model.term_statistics(docs).collect()}
    assert {t: (r["count"], r.df) for t, r in stats.items()} == want
    assert stats["dispute"].idf == pytest.approx(math.log((1 + len(TEXTS)) / (1 + 3)) + 1)


def test_vocabulary_is_cut_by_count_then_name(docs):
    cfg = StudyConfig(text_min_df=1, text_max_terms=3)
    terms = [r.term for r in text_model.vocabulary(text_model.term_statistics(docs), cfg).collect()]
    assert terms == ["dispute", "payment_id", "42"]


def test_tfidf_weights_match_plain_python(docs):
    stats = {r.term: r.idf for r in text_model.vocabulary(text_model.term_statistics(docs), CFG).collect()}
    got = {}
    for r in text_model.tfidf_weights(docs.where("narrative is not null"), CFG).collect():
        got.setdefault(r.complaint_id, {})[r.term] = r.weight
    for i, text in enumerate(TEXTS):
        terms = [t for t in brute_terms(text) if t in stats]
        raw = {t: (1 + math.log(terms.count(t))) * stats[t] for t in set(terms)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert got.get(i, {}) == pytest.approx({t: v / norm for t, v in raw.items()})


def test_text_model_matches_newton_and_reloads(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "late", "never"]
    rows = []
    for i in range(150):
        late = i % 3 == 0
        picked = [rng.choice(words[4:] if late and rng.random() < 0.5 else words) for _ in range(12)]
        rows.append((i, int(late), " ".join(picked)))
    docs = spark.createDataFrame(rows, "complaint_id int, target int, narrative string")
    model = text_model.train_text(docs, CFG)

    index = {t: k for k, t in enumerate(model.index.terms)}
    x = np.zeros((len(rows), len(index)))
    for r in text_model.tfidf_weights(docs, CFG).collect():
        x[r.complaint_id, index[r.term]] = r.weight
    w = newton(x, np.array([r[1] for r in rows]))
    want = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    got = {r.complaint_id: r.score for r in model.score(docs, "complaint_id").collect()}
    assert max(abs(got[i] - p) for i, p in enumerate(want)) < 1e-3
    assert text_model.top_terms(model.term_coefficients(), 2).count() == 4

    model.save(str(tmp_path / "text"))
    again = text_model.TextModel.load(spark, str(tmp_path / "text"))
    assert got == pytest.approx({r.complaint_id: r.score for r in again.score(docs, "complaint_id").collect()})


def test_text_fit_is_cut_by_entries_and_stays_in_the_jvm(spark, monkeypatch):
    """Few rows with many entries spread over tasks, and no vector passes Python."""
    rows = [(i, i % 2, " ".join(f"w{(i + k) % 40:02d}" for k in range(30))) for i in range(150)]
    docs = spark.createDataFrame(rows, "complaint_id int, target int, narrative string")
    seen = []

    def fit(estimator, vectors, *rest, **more):
        raised = models.fit_tasks(spark, rest[0], rest[2])
        seen.append((raised, vectors._jdf.queryExecution().toString()))
        return estimator.fit(vectors)

    monkeypatch.setattr(models, "fit_on", fit)
    assert text_model.train_text(docs, replace(CFG, fit_entries_per_task=3000)) is not None
    ((tasks, plan),) = seen
    assert tasks > 1 and "Python" not in plan and "wrap(" not in plan


def test_too_little_text_gives_no_model(docs):
    assert text_model.train_text(docs, CFG) is None


def test_text_without_known_terms_scores_the_intercept(spark):
    index = text_model.TermIndex(spark, ("late",), (1.0,))
    model = text_model.TextModel(index, (2.0,), -1.0)
    docs = spark.createDataFrame([(1, "nothing known"), (2, "late")], "complaint_id int, narrative string")
    got = {r.complaint_id: r.score for r in model.score(docs, "complaint_id").collect()}
    assert got == pytest.approx({1: 1 / (1 + math.e), 2: 1 / (1 + math.exp(-1.0))})


def test_exact_fits_equal_newton_side_by_side(train):
    """Each variant against its own dense solution; capping changes nothing where no year exceeds the cap."""
    cfg = replace(CFG, train_years=(2020, 2021), fit_rows_per_task=97)
    fitted = models.train_exact(train, cfg, models.VARIANTS)
    for variant, model in fitted.items():
        own = train.withColumn("year", F.least("year", F.lit(2021))) if variant == "capped" else train
        x, y = dense(own)
        if variant == "dropped":
            x = np.delete(x, x.shape[1] - len(CFG.numeric) + CFG.numeric.index("year"), axis=1)
        w = newton(x, y)
        named = {r.feature: r.coefficient for r in model.coefficients.collect()}
        assert len(named) == x.shape[1] and ("num__year" in named) == (variant != "dropped")
        assert model.intercept == pytest.approx(w[-1], abs=1e-7)
        margin = {r.complaint_id: r.margin for r in model.margin(own).collect()}
        want = np.hstack([x, np.ones((len(x), 1))]) @ w
        assert max(abs(margin[r.complaint_id] - m) for r, m in zip(train.collect(), want)) < 1e-7
        assert sorted(named.values()) == pytest.approx(sorted(w[:-1]), abs=1e-7)


def test_exact_fit_on_one_class_and_unseen_levels(train):
    """A constant label drives the intercept out until no slope is left; levels without a column count nothing."""
    encoder = encoding.Encoder.fit(train.where("company <> 'mid'"), CFG)
    model = models.train_exact(train, CFG, encoder=encoder)["baseline"]
    assert all(math.isfinite(r.margin) for r in model.margin(train).collect())
    late = models.train_exact(train.where("target = 1"), CFG)["baseline"]
    assert min(r.score for r in late.score(train).collect()) > 0.999


def test_exact_fit_in_one_task_equals_the_fit_by_jobs(spark, train):
    """Rows of one task need no job for each scan."""
    spark.sparkContext.setJobGroup("exact-fit", "")
    try:
        one = models.train_exact(train, CFG, models.VARIANTS)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("exact-fit")) < 60
    many = models.train_exact(train, replace(CFG, fit_rows_per_task=50), models.VARIANTS)
    for variant, model in one.items():
        assert many[variant].intercept == pytest.approx(model.intercept, abs=1e-6)
        weights = dict(map(tuple, many[variant].coefficients.collect()))
        assert weights == pytest.approx(dict(map(tuple, model.coefficients.collect())), abs=1e-6)


def test_a_fit_has_no_more_tasks_than_run_at_once(spark):
    assert [fit_tasks(spark, rows, 50) for rows in (0, 50, 51)] == [1, 1, 2]
    assert fit_tasks(spark, 10**9, 50) == spark.sparkContext.defaultParallelism
