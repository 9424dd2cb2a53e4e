"""Reading, cleaning, sampling and joining on small inputs."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

from duewatch.config import NA_TOKENS, StudyConfig
from duewatch.operators import audit, linking, population as pop, sampling
from duewatch.sources import Workspace, read_complaints, read_scored_file, source_row_count, split_text

CFG = StudyConfig()
HEADER = (
    "Complaint ID,Date received,Timely response?,Consumer complaint narrative,Product,Sub-product,"
    "Issue,Sub-issue,Company,State,Submitted via,Company response to consumer"
)


@pytest.fixture
def csv_file(tmp_path):
    lines = [
        HEADER,
        '1,2021-03-04,No,"He said ""no"",\nthen left",Loan,N/A,Late,,"A, Inc.",TX,Web,Closed',
        "2,2024-12-31, no ,,Loan,None,Late,x,B,TX,Web,Closed",
        "3,not a date,No,text,Loan,g,Late,x,B,TX,Web,Closed",
        "4,2019-12-31,No,text,Loan,g,Late,x,B,TX,Web,Closed",
        "5,2025-01-01,,NA,Loan, ,Late,x,B,,Web,Closed",
        "6,2020-02-30,Yes,text,Loan,g,Late,x,B,TX,Web,Closed",
    ]
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_to_population(spark, csv_file):
    raw = read_complaints(spark, csv_file)
    assert "Company response to consumer" not in raw.columns and raw.count() == 6
    rows = {r.complaint_id: r for r in pop.derive_population(raw, CFG).collect()}
    assert set(rows) == {"1", "2", "5"}  # bad dates and out-of-period rows are gone
    assert rows["1"].narrative == 'He said "no",\nthen left'
    assert rows["1"].company == "A, Inc." and rows["1"].sub_product is None
    assert (rows["2"].target, rows["2"].has_narrative, rows["2"].sub_product) == (1, False, None)
    assert (rows["5"].target, rows["5"].has_narrative) == (0, False)  # null answer, NA text
    assert rows["5"].sub_product == " " and rows["5"].state is None
    assert (rows["2"].year, rows["2"].month, rows["2"].quarter) == (2024, 12, 4)


def test_stores_are_pruned_by_year(spark, csv_file, tmp_path):
    space = Workspace(spark, str(tmp_path / "space"))
    structured, texts = split_text(pop.derive_population(read_complaints(spark, csv_file), CFG))
    space.write_population(structured)
    space.write_narratives(texts)
    assert "narrative" not in space.population().columns
    assert space.population(2024, 2025).count() == 2
    assert space.narratives(2021).count() == 1 and space.narratives(2023).count() == 0
    plan = space.population(2024)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert space.result("nothing") is None and space.scores("nothing", 2024) is None


def test_every_missing_token(spark):
    from duewatch.functions import as_missing

    values = [*NA_TOKENS, " ", "none", "N/a", "0"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    kept = {r.v for r in df.select(as_missing(F.col("v")).alias("v")).collect() if r.v is not None}
    assert kept == {" ", "none", "N/a", "0"}


def test_label_ignores_case_and_padding(spark):
    from duewatch.functions import is_late

    answers = {"No": 1, " no": 1, "NO\t": 1, "\nnO ": 1, "Yes": 0, "no way": 0, "": 0, None: 0}
    df = spark.createDataFrame([(k,) for k in answers], "a string")
    assert {r.a: r.y for r in df.select("a", is_late(F.col("a")).alias("y")).collect()} == answers


def test_leakage_is_dropped_and_refused(spark):
    df = spark.createDataFrame([(1, "x")], ["complaint_id", "Consumer disputed?"])
    assert pop.drop_leakage(df, CFG).columns == ["complaint_id"]
    leaky = StudyConfig(categorical=("product", "Consumer disputed?"))
    with pytest.raises(ValueError, match="Consumer disputed"):
        pop.drop_leakage(df, leaky)


def test_year_variants(spark):
    df = spark.createDataFrame([(2022, 1), (2025, 2)], ["year", "month"])
    assert [r.year for r in pop.year_variant(df, "capped", CFG).orderBy("month").collect()] == [2022, 2023]
    assert pop.year_variant(df, "dropped", CFG).columns == ["month"]
    with pytest.raises(ValueError):
        pop.year_variant(df, "other", CFG)


def test_null_levels_are_counted_but_get_no_rate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "k string, target int")
    counts = {r.k: (r["count"], r.share_pct) for r in audit.value_counts(df, "k").collect()}
    assert counts == {"a": (2, pytest.approx(200 / 3)), None: (1, pytest.approx(100 / 3))}
    assert [r.k for r in audit.rate_table(df, "k").collect()] == ["a"]


def test_null_ids_count_as_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,)], "complaint_id string")
    row = audit.duplicate_ids(df).first()
    assert (row.records, row.duplicates) == (5, 3)


def test_chunk_count(spark):
    row = source_row_count(spark.range(1_000_001)).first()
    assert (row.source_rows, row.chunks) == (1_000_001, 3)


# --------------------------------------------------------------------------- sampling


def pool(spark, positives, negatives):
    rows = spark.range(positives + negatives)
    return rows.select(F.col("id").alias("complaint_id"), (F.col("id") < positives).cast("int").alias("target"))


def drawn(df):
    return sorted((r.complaint_id, r.target) for r in df.collect())


def test_sample_is_exact_and_reproducible(spark):
    df = pool(spark, 100, 20_000)
    first = drawn(sampling.undersample_negatives(df, CFG))
    assert [r for r in first if r[1]] == [(i, 1) for i in range(100)]
    assert len([r for r in first if not r[1]]) == 500
    assert first == drawn(sampling.undersample_negatives(df.repartition(7), CFG))
    other = drawn(sampling.undersample_negatives(df, StudyConfig(seed=43)))
    assert other != first and len(other) == len(first)


def test_sample_with_too_few_negatives_keeps_all(spark):
    with pytest.warns(UserWarning, match="only 40 available"):
        assert len(drawn(sampling.undersample_negatives(pool(spark, 10, 40), CFG))) == 50


def test_sample_that_needs_exactly_all_negatives(spark):
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="wanted")
        assert len(drawn(sampling.undersample_negatives(pool(spark, 10, 50), CFG))) == 60


def test_sample_without_positives_is_empty(spark):
    assert drawn(sampling.undersample_negatives(pool(spark, 0, 30), CFG)) == []


def test_copies_that_straddle_the_cut_are_taken_in_part(spark):
    """A third of all negatives are copies of one id; the total is still exact."""
    base = pool(spark, 30, 600).withColumn("part", F.lit(0))
    copies = spark.range(300).select(
        F.lit(1_000_000).alias("complaint_id"), F.lit(0).alias("target"), F.col("id").cast("int").alias("part")
    )
    for ratio in (3, 5, 10, 20, 29):
        cfg = StudyConfig(negatives_per_positive=ratio)
        sample = sampling.undersample_negatives(base.unionByName(copies), cfg).collect()
        assert sum(r.target for r in sample) == 30
        assert len(sample) == 30 + 30 * ratio
        assert len({(r.complaint_id, r.part) for r in sample}) == len(sample)


# --------------------------------------------------------------------------- joins and files


def test_texts_join_only_sampled_rows(spark):
    sample = spark.createDataFrame(
        [(1, True), (2, True), (3, False)], "complaint_id int, has_narrative boolean"
    )
    texts = spark.createDataFrame(
        [(1, 2020, "a"), (3, 2020, "c"), (4, 2020, "d")], "complaint_id int, year int, narrative string"
    )
    got = {r.complaint_id: r.narrative for r in linking.attach_narratives(sample, texts).collect()}
    assert got == {1: "a", 2: None, 3: None}
    assert [r.complaint_id for r in linking.wanted_narratives(sample, texts).collect()] == [1]


def test_alignment_report_sees_both_sides(spark):
    labels = spark.createDataFrame([(1,), (2,), (3,), (None,)], "complaint_id int")
    scores = spark.createDataFrame([(2,), (3,), (4,)], "complaint_id int")
    row = linking.alignment_report(labels, scores).first()
    assert (row.matched, row.labels_only, row.scores_only, row.complete) == (2, 2, 1, False)
    assert linking.alignment_report(scores, scores).first().complete


def test_scored_file_needs_its_column(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("id,pred_proba,actually_untimely\n1,0.5,1\n2,0.25,\n")
    bad = tmp_path / "bad.csv"
    bad.write_text("id,score\n1,0.5\n")
    rows = read_scored_file(spark, str(tmp_path / "absent.csv"), str(good)).collect()
    assert [(r.pred_proba, r.actually_untimely) for r in rows] == [(0.5, 1), (0.25, None)]
    with pytest.raises(ValueError, match="pred_proba"):
        read_scored_file(spark, str(bad))
    with pytest.raises(FileNotFoundError):
        read_scored_file(spark, str(tmp_path / "absent.csv"))


def test_totals_row(spark):
    df = spark.createDataFrame([(2020, 1), (2020, 0), (2021, 0), (2021, 0)], "year int, target int")
    rows = {r.year: r for r in audit.study_population_by_year(df).collect()}
    assert rows["Total"].complaints == 4 and rows["Total"].share_pct == 100
    assert rows["2020"].untimely_rate_pct == 50 and math.isclose(rows["2021"].share_pct, 50)
    assert [r.year for r in audit.yearly_rates(audit.study_population_by_year(df)).orderBy("year").collect()] == [2020, 2021]


def test_draw_refines_prefixes_that_many_keys_share(spark, monkeypatch):
    """Keys that agree in their first digits need more rounds; the draw stays the smallest keys."""
    keys = sorted([f"00000000{k:024x}" for k in range(40)] + [f"0000000{k % 7}{k:024x}" for k in range(41, 90)])
    rows = [(k, key, 0) for k, key in enumerate(keys)] + [(1000 + k, "", 1) for k in range(11)]
    df = spark.createDataFrame(rows, "complaint_id long, key string, target int")
    monkeypatch.setattr(sampling, "draw_key", lambda cfg, key="key": F.col("key"))
    for ratio in (1, 2, 3, 5, 7):
        cfg = StudyConfig(negatives_per_positive=ratio)
        found = sampling.undersample_negatives(df, cfg)
        assert {r.complaint_id for r in found.where("target = 0").collect()} == set(range(11 * ratio))
        assert "Window" not in found._jdf.queryExecution().toString()
