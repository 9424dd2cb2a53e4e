"""SQL counterparts of the registered queries, over the same tables."""

from __future__ import annotations

LATE = "o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"

# Building blocks, used as common table expressions.
PARTS = {
    "scored": f"""
        select complaint_id, year, target,
               cast(milli / cast(1000 as double) as float) as score,
               cast(milli_b / cast(1000 as double) as float) as score_b, milli, milli_b
        from (select o_orderkey as complaint_id, cast(year(o_orderdate) as bigint) as year,
                     cast(case when {LATE} then 1 else 0 end as bigint) as target,
                     cast(floor(((o_orderkey * 7919) % 1000) * 0.7) as bigint)
                       + case when {LATE} then 300 else 0 end as milli,
                     cast(floor(((o_orderkey * 104729) % 1000) * 0.8) as bigint)
                       + case when {LATE} then 150 else 0 end as milli_b
              from orders)""",
    "cases": f"""
        select o_orderkey as complaint_id, cast(o_orderdate as date) as date_received,
               cast(year(o_orderdate) as bigint) as year, cast(month(o_orderdate) as bigint) as month,
               cast(quarter(o_orderdate) as bigint) as quarter,
               cast(case when {LATE} then 1 else 0 end as bigint) as target,
               c_mktsegment as product,
               case o_orderkey % 3 when 0 then null when 1 then 'General' else 'Other' end as sub_product,
               r_name as issue,
               case when o_orderkey % 5 = 0 then null
                    else concat('Detail ', cast(o_orderkey % 5 as varchar)) end as sub_issue,
               c_name as company, n_name as state,
               case when o_orderkey % 100 < 96 then 'Web' when o_orderkey % 100 < 98 then 'Phone'
                    when o_orderkey % 100 < 99 then 'Referral' else 'Fax' end as channel,
               text as narrative, (text is not null and text <> '') as has_narrative
        from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        left join documents on doc_id = o_orderkey""",
    "raw": f"""
        select cast(o_orderkey as varchar) as complaint_id, o_orderkey,
               case o_orderkey % 97 when 0 then 'unknown' when 1 then '1996-13-45' when 2 then null
                    else strftime(o_orderdate, '%Y-%m-%d') end as date_text,
               case when {LATE} then case o_orderkey % 4 when 0 then ' no' when 1 then 'NO' || chr(9) else 'No' end
                    when o_orderkey % 11 = 0 then null else 'Yes' end as answer,
               case o_orderkey % 7 when 0 then 'N/A' when 1 then '' when 2 then ' ' when 3 then 'None'
                    when 4 then 'null' else 'General' end as sub_product_text,
               case when o_orderkey % 5 = 0 then null
                    else concat('Detail ', cast(o_orderkey % 5 as varchar)) end as sub_issue,
               text as narrative
        from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        left join documents on doc_id = o_orderkey""",
    "dated": """
        select *, try_cast(date_text as date) as date_received,
               cast(year(try_cast(date_text as date)) as bigint) as year,
               cast(month(try_cast(date_text as date)) as bigint) as month,
               cast(quarter(try_cast(date_text as date)) as bigint) as quarter
        from raw where try_cast(date_text as date) is not null""",
    "ingested": """
        select *, cast(coalesce(lower(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) = 'no', false) as bigint)
                   as target,
               case when sub_product_text in ('', 'N/A', 'None', 'null') then null
                    else sub_product_text end as sub_product
        from dated where year between 1995 and 2000""",
    "study": "select * from cases where year between 1995 and 2000",
    "train": "select * from cases where year between 1995 and 1998",
    "sample": """
        select * exclude (draw) from (
          select *, row_number() over (partition by target order by md5('42-' || complaint_id), complaint_id) as draw
          from train)
        where target = 1 or draw <= 5 * (select count(*) from train where target = 1)""",
    "val": "select * from scored where year = 1999",
    "test": "select * from scored where year = 2000",
    "pair": "select * from scored where year in (1999, 2000)",
    "cuts": "select unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]) as t",
}

NEEDS = {
    "dated": ["raw"],
    "ingested": ["raw", "dated"],
    "study": ["cases"],
    "train": ["cases"],
    "sample": ["cases", "train"],
    "val": ["scored"],
    "test": ["scored"],
    "pair": ["scored"],
}

ORACLE: dict[str, str] = {}


def sql(name: str, parts: str, body: str) -> None:
    """Register ``body`` behind the common table expressions it builds on."""
    wanted: list[str] = []
    for part in parts.split():
        wanted += [p for p in [*NEEDS.get(part, []), part] if p not in wanted]
    head = ", ".join(f"{p} as ({PARTS[p]})" for p in wanted)
    body = body.strip()
    if not head:
        ORACLE[name] = body
    elif body.startswith("with "):
        ORACLE[name] = f"with {head}, {body[5:]}"
    else:
        ORACLE[name] = f"with {head} {body}"


def r(expression: str, digits: int = 9) -> str:
    return f"round(cast({expression} as double), {digits})"


def ratio(a: str, b: str) -> str:
    """Double division, null for a zero denominator."""
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


# --------------------------------------------------------------------------- sources and sinks

sql("csv_scan", "ingested", """
select year, count(*) as complaints, cast(sum(target) as bigint) as untimely,
       count(narrative) as narratives, cast(sum(length(narrative)) as bigint) as narrative_chars,
       count(sub_product) as sub_products
from ingested group by year""")

sql("null_token_normalise", "raw", """
select case when sub_product_text in ('', 'N/A', 'None', 'null') then null else sub_product_text end
         as sub_product, count(*) as n
from raw group by 1""")

sql("population_store", "cases", """
select product, count(*) as complaints, cast(sum(target) as bigint) as untimely
from cases where year = 2000 group by product""")

sql("narrative_store", "cases", """
select year, count(*) as narratives, cast(sum(length(narrative)) as bigint) as chars
from cases where has_narrative and year = 2000 group by year""")

sql("sample_store", "sample", """
select target, count(*) as n, cast(sum(complaint_id) as bigint) as id_sum from sample group by target""")

sql("score_store", "test", f"""
select 'given' as model, target, count(*) as n, {r('avg(cast(score as double))')} as mean_score
from test group by target""")

sql("csv_table_sink", "study", f"""
select state, count(*) as complaints, cast(sum(target) as bigint) as untimely,
       {r(ratio('sum(target)', 'count(*)'), 6)} as untimely_rate
from study group by state""")

sql("source_row_count", "", """
select count(*) as source_rows, cast(ceil(count(*) / 5000.0) as bigint) as chunks from lineitem""")

# --------------------------------------------------------------------------- projections, filters

sql("calendar_features", "dated", "select complaint_id, date_received, year, month, quarter from dated")

sql("study_population", "ingested", """
select complaint_id, year, target, narrative is not null as has_narrative, sub_issue from ingested""")

sql("text_structure_split", "ingested", """
select year, 'structured' as part, count(*) as n from ingested group by year
union all
select year, 'narratives', count(narrative) from ingested where narrative is not null group by year""")

sql("leakage_guard", "study", """
select f as field, true as present, true as removed, (select count(*) from study) as rows_kept
from (values ('o_orderstatus'), ('o_orderpriority')) t(f)""")

sql("missing_level_fill", "study", """
select coalesce(sub_product, 'MISSING') as sub_product, coalesce(sub_issue, 'MISSING') as sub_issue,
       'MISSING' as state, count(*) as n
from study group by 1, 2""")

sql("feature_projection", "cases", """
select complaint_id, product, coalesce(sub_product, 'MISSING') as sub_product, issue,
       coalesce(sub_issue, 'MISSING') as sub_issue, company, state, channel, year, month, quarter
from cases where year = 1999""")

sql("period_class_filter", "scored", """
select complaint_id, year from scored where year between 1995 and 1998 and target = 1""")

sql("text_available_guard", "sample", """
select 'train' as part, count(*) filter (has_narrative) as text_rows,
       count(*) filter (has_narrative) >= 100 as enough from sample
union all
select 'validation', count(*) filter (has_narrative), count(*) filter (has_narrative) > 50
from cases where year = 1999""")

sql("year_variant", "scored", """
select least(year, 1998) as year, count(*) as n, false as dropped_has_year
from scored where year between 1995 and 2000 group by 1""")

sql("probability_clip", "test", f"""
select complaint_id,
       {r('ln(least(greatest(cast(score as double), 1e-15), 1 - 1e-15))')} as log_p,
       {r('ln(least(greatest(cast(score as double) - 1, 1e-15), 1 - 1e-15))')} as log_floor
from test""")

sql("flag_at_threshold", "test", "select complaint_id, " + ", ".join(
    f"cast(score >= cast({t / 100} as float) as bigint) as at_{t:03d}" for t in range(30, 91, 5)
) + " from test")

sql("temporal_split", "scored", """
select case when year <= 1998 then 'train' when year = 1999 then 'validation' else 'test' end as period,
       year, count(*) as records, cast(sum(target) as bigint) as untimely
from scored where year between 1995 and 2000 group by 1, 2""")

# --------------------------------------------------------------------------- joins

sql("train_with_narratives", "sample", """
select complaint_id, target, case when has_narrative then md5(narrative) end as text_md5 from sample""")

sql("narrative_semi_join", "sample", """
select doc_id as complaint_id, cast(year(o_orderdate) as bigint) as year, length(text) as chars
from documents join orders on doc_id = o_orderkey
where text <> '' and doc_id in (select complaint_id from sample where has_narrative)""")

sql("validation_narrative_subset", "cases", """
select complaint_id, target, length(narrative) as chars from cases where has_narrative and year = 1999""")

sql("score_label_join", "cases test", """
select count(*) filter (c.complaint_id is not null and s.complaint_id is not null) as matched,
       count(*) filter (s.complaint_id is null) as labels_only,
       count(*) filter (c.complaint_id is null) as scores_only,
       count(*) filter (s.complaint_id is null or c.complaint_id is null) = 0 as complete
from (select complaint_id from cases where year = 2000) c
full join test s on c.complaint_id = s.complaint_id""")

# --------------------------------------------------------------------------- audit tables

sql("study_population_by_year", "scored", f"""
with study_rows as (select * from scored where year between 1995 and 2000)
select coalesce(cast(year as varchar), 'Total') as year, count(*) as complaints,
       cast(sum(target) as bigint) as untimely,
       {r(ratio('100 * count(*)', '(select count(*) from study_rows)'))} as share_pct,
       {r(ratio('100 * sum(target)', 'count(*)'))} as untimely_rate_pct
from study_rows group by grouping sets ((year), ())""")

sql("missingness", "study", f"""
with nulls as (
  select 'Consumer complaint narrative' as field, count(*) filter (not has_narrative) as missing from study
  union all select 'Date received', count(*) - count(date_received) from study
  union all select 'Product', count(*) - count(product) from study
  union all select 'Company', count(*) - count(company) from study
  union all select 'Submitted via', count(*) - count(channel) from study
  union all select 'Complaint ID', count(*) - count(complaint_id) from study
  union all select 'Timely response?', count(*) - count(target) from study)
select field, missing, {r(ratio('100 * missing', '(select count(*) from study)'))} as missing_pct from nulls""")

sql("narrative_availability_by_year", "study", f"""
select year, count(*) filter (has_narrative) as sum, count(*) as size,
       {r(ratio('100 * count(*) filter (has_narrative)', 'count(*)'))} as availability_pct
from study group by year""")

for key, column in (("top_products", "product"), ("top_companies", "company"),
                    ("sub_product_counts", "sub_product"), ("channels", "channel")):
    sql(key, "study", f"""
select {column}, count(*) as count,
       {r(ratio('100 * count(*)', '(select count(*) from study)'))} as share_pct
from study group by {column}""")

sql("top_companies_head", "study", f"""
select company, count(*) as count,
       {r(ratio('100 * count(*)', '(select count(*) from study)'))} as share_pct
from study group by company order by 2 desc, 1 limit 10""")

sql("duplicate_ids", "", """
select cast(sum(n) as bigint) as records, cast(sum(n - 1) as bigint) as duplicates
from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)""")

for key in ("period_stats", "natural_prevalence"):
    sql(key, "pair", f"""
select case year when 1999 then 'validation' else 'test' end as period, year, count(*) as records,
       cast(sum(target) as bigint) as untimely,
       {r(ratio('100 * sum(target)', 'count(*)'))} as untimely_rate_pct
from pair group by year""")

sql("split_design", "sample", f"""
select 'train' as period, '[1995, 1996, 1997, 1998]' as years, count(*) as records,
       cast(sum(target) as bigint) as untimely, {r('100 * avg(target)')} as untimely_rate_pct,
       'all positives + 5 negatives each' as sampling
from sample""")

RATES = f"""count(*) as complaints, cast(sum(target) as bigint) as untimely,
       {r(ratio('sum(target)', 'count(*)'), 6)} as untimely_rate"""

sql("rate_table", "study", f"""
select sub_issue, {RATES} from study where sub_issue is not null group by sub_issue having count(*) >= 10""")

sql("dim_year", "scored", f"""
select year, {RATES},
       {r(ratio('count(*)', '(select count(*) from scored where year between 1995 and 2000)'), 6)} as share_of_total
from scored where year between 1995 and 2000 group by year""")

sql("dim_company", "study", f"""
select company, {RATES} from study group by company having count(*) >= 10
order by complaints desc, company limit 40""")

sql("dim_product", "study", f"select product, {RATES} from study group by product")

sql("text_subset_stats", "sample", f"""
select count(*) as records, count(*) filter (has_narrative) as narrative_records,
       {r(ratio('100 * count(*) filter (has_narrative)', 'count(*)'))} as narrative_pct,
       {r('100 * avg(target) filter (has_narrative)')} as untimely_rate_pct
from sample""")

sql("fig_complaints", "scored", """
select year, count(*) as complaints from scored where year between 1995 and 2000 group by year""")

sql("fig_narrative", "study", f"""
select year, {r('100 * avg(cast(has_narrative as int))')} as availability_pct from study group by year""")

sql("fig_untimely_rate", "scored", f"""
select year, {r('100 * avg(target)')} as untimely_rate_pct
from scored where year between 1995 and 2000 group by year""")

sql("undersample_negatives", "sample", "select complaint_id, year, target from sample")

# --------------------------------------------------------------------------- ranking and bins

LIFT = f"""
with ranked as (
  select target, row_number() over (order by score desc, complaint_id) - 1 as i, count(*) over () as n from test),
deciles as (
  select least(i // greatest(1, n // 10), 9) + 1 as decile, count(*) as records, cast(sum(target) as bigint) as untimely
  from ranked group by 1),
lift as (
  select decile, records, untimely, {r(ratio('untimely', 'records'))} as rate,
         {r(ratio(ratio('untimely', 'records'), '(select avg(target) from test)'))} as lift,
         {r(ratio('100 * sum(untimely) over (order by decile)', '(select sum(target) from test)'))}
           as cumulative_untimely_pct
  from deciles)
"""
sql("decile_lift", "test", LIFT + "select * from lift")
sql("fact_decile", "test", LIFT + "select * from lift")
sql("cumulative_gains", "test", LIFT + """
select decile * 10 as reviewed_pct, cumulative_untimely_pct as captured_pct from lift""")


def qcut(source: str) -> str:
    """Ascending right-closed decile of milli/1000 by interpolated quantile edges."""
    return f"""
with rows_ as (select complaint_id, target, milli / cast(1000 as double) as p from {source}),
pos as (select p, row_number() over (order by p) - 1 as i from rows_),
total as (select count(*) as n from rows_),
want as (select k, k * (n - 1) // 10 as lo, least(k * (n - 1) // 10 + 1, n - 1) as hi,
                ((k * (n - 1)) % 10) / cast(10 as double) as f
         from total, range(0, 11) ks(k)),
edges as (select distinct a.p + (b.p - a.p) * f as e
          from want join pos a on a.i = lo join pos b on b.i = hi),
binned as (select complaint_id, target, p,
                  greatest((select count(*) from edges where e < p), 1) as decile from rows_)
"""


sql("add_decile", "test", qcut("test") + f"select complaint_id, {r('p')} as pred_proba, decile from binned")
for key, source in (("decile_summary", "pair"), ("scored_file_decile", "test")):
    sql(key, source, qcut(source) + f"""
select decile, count(*) as records, count(target) as count, {r('avg(target)')} as mean
from binned group by decile""")

ASCENDING = """select *, row_number() over (order by score, complaint_id) as rank, count(*) over () as n from test"""


def group_of(q: int) -> str:
    return f"greatest(((rank - 1) * {q} + greatest(n - 1, 1) - 1) // greatest(n - 1, 1) - 1, 0)"


# Missing scores leave the others to be binned by rank; ties follow the file's columns, which are strings.
sql("scored_file_missing", "test", f"""
with known as (
  select milli / cast(1000 as double) as p, cast(complaint_id as varchar) as id,
         case when complaint_id % 9 <> 0 then target end as target
  from test where complaint_id % 10 > 2),
ranked as (select *, row_number() over (order by p, id) as rank, count(*) over () as n from known),
binned as (select target, {group_of(10)} + 1 as decile from ranked)
select decile, count(*) as records, count(target) as count, {r('avg(target)')} as mean from binned group by decile""")

sql("risk_groups", "test", f"""
with ranked as ({ASCENDING}) select complaint_id, rank, {group_of(10)} as risk_group from ranked""")

sql("triage_rank", "test", f"""
with ranked as (
  select complaint_id, row_number() over (order by score desc, complaint_id) as rank, count(*) over () as n
  from test),
shared as (select complaint_id, rank, {r(ratio('rank', 'n'), 6)} as percentile from ranked)
select complaint_id, rank, percentile, least(cast(floor(percentile * 10) as bigint) + 1, 10) as decile
from shared""")

sql("uniform_bins", "test", f"""
with edges as (select i, i * cast(0.1 as double) as e from range(0, 10) t(i)),
binned as (select score, target, (select max(i) from edges where e <= cast(score as double)) as bin from test)
select bin, count(*) as n, {r('avg(cast(score as double))')} as mean_score, {r('avg(target)')} as observed_rate
from binned group by bin""")

sql("top_bin_calibration", "test", f"with ranked as ({ASCENDING}) " + " union all ".join(
    f"""select {q} as bins, count(*) as cases, {r('avg(cast(score as double))')} as mean_score,
       {r('avg(target)')} as observed_rate from ranked where {group_of(q)} = {q - 1}""" for q in (5, 10, 20)))

sql("score_histogram", "test", f"""
with edges as (select i, i * cast(0.02 as double) as lo, (i + 1) * cast(0.02 as double) as hi from range(0, 50) t(i)),
classes as (select target, count(*) as total from test where score between 0 and 1 group by target),
counted as (select target, i, count(*) as n from test join edges
            on cast(score as double) >= lo and (cast(score as double) < hi or (i = 49 and score = 1))
            group by target, i)
select c.target, e.i as bin, {r('e.lo')} as left_edge, coalesce(k.n, 0) as n,
       {r('coalesce(k.n, 0) / (c.total * cast(0.02 as double))')} as density
from classes c cross join edges e left join counted k on k.target = c.target and k.i = e.i""")

QUEUE = f"""
with ranked as (
  select s.*, row_number() over (order by score desc, complaint_id) as rank, count(*) over () as n from test s),
queue as (select *, {r(ratio('rank', 'n'), 6)} as percentile from ranked)
"""
for key, size in (("triage_queue", 50_000), ("triage_queue_head", 150)):
    sql(key, "cases test", QUEUE + f"""
select c.complaint_id, c.company, c.product, c.sub_product, c.issue, c.state, c.channel, c.year, c.month,
       c.quarter, {r('score')} as score, rank, percentile,
       least(cast(floor(percentile * 10) as bigint) + 1, 10) as decile,
       cast(score >= cast(0.6 as float) as bigint) as flagged_at_060, c.target as actually_untimely
from queue q join cases c on c.complaint_id = q.complaint_id where rank <= {size}""")

sql("queue_summary", "test", QUEUE + f"""
select count(*) as queue_rows, cast(sum(target) as bigint) as untimely, {r('avg(target)')} as untimely_share
from queue where rank <= 200""")

# --------------------------------------------------------------------------- metrics


def at_cut(source: str, cut: str, by: str = "", score: str = "score") -> str:
    """Confusion counts of ``source`` at ``cut`` (a float expression), per ``by``."""
    group = f"{by}, " if by else ""
    tail = f"group by {by}" if by else ""
    return f"""select {group}
        count(*) filter ({score} >= {cut} and target = 1) as tp, count(*) filter ({score} >= {cut} and target = 0) as fp,
        count(*) filter ({score} < {cut} and target = 0) as tn, count(*) filter ({score} < {cut} and target = 1) as fn
        from {source} {tail}"""


POINT_SIX = "cast(0.6 as float)"
RATE_EXPR = {
    "precision": f"coalesce({ratio('tp', 'tp + fp')}, 0)",
    "recall": f"coalesce({ratio('tp', 'tp + fn')}, 0)",
    "f1": f"coalesce({ratio('2 * tp', '2 * tp + fp + fn')}, 0)",
    "accuracy": ratio("tp + tn", "tp + fp + tn + fn"),
    "flag_rate": ratio("tp + fp", "tp + fp + tn + fn"),
    "reviews_per_catch": ratio("tp + fp", "tp"),
}
RATE_COLUMNS = ", ".join(
    [f"{r(RATE_EXPR[k])} as {k}" for k in ("precision", "recall", "f1", "accuracy")]
    + ["tp, fp, tn, fn, tp + fp as flagged"]
    + [f"{r(RATE_EXPR[k])} as {k}" for k in ("flag_rate", "reviews_per_catch")]
)


def ladder(source: str, by: str = "", score: str = "score") -> str:
    """CTEs ``steps`` and ``ladder``: distinct scores with running counts, per ``by``."""
    part = f"partition by {by}" if by else ""
    group = f"{by}, " if by else ""
    return f"""
steps as (select {group}{score} as score, count(*) as n, cast(sum(target) as bigint) as pos
          from {source} group by {group}{score}),
ladder as (select *, cast(sum(n) over ({part} order by score desc) as bigint) as n_upto,
                  cast(sum(pos) over ({part} order by score desc) as bigint) as pos_upto,
                  cast(sum(n) over ({part}) as bigint) as n_total,
                  cast(sum(pos) over ({part}) as bigint) as pos_total from steps)"""


def ranked_metrics(by: str = "") -> str:
    group = f"{by}, " if by else ""
    tail = f"group by {by}" if by else ""
    return f"""select {group}
   sum(pos * {ratio('pos_upto', 'n_upto')}) / nullif(max(pos_total), 0) as pr_auc,
   sum(pos * (cast(n_total - pos_total - (n_upto - pos_upto) as double) + (n - pos) / cast(2 as double)))
     / nullif(cast(max(pos_total) as double) * (max(n_total) - max(pos_total)), 0) as roc_auc,
   {ratio('max(pos_total)', 'max(n_total)')} as prevalence, max(n_total) as n, max(pos_total) as n_positive
   from ladder {tail}"""


sql("confusion_counts", "test", f"""
select cast(0.6 as double) as threshold, tn, fp, fn, tp from ({at_cut('test', POINT_SIX)})""")

sql("confusion_matrix", "test", f"""
with c as ({at_cut('test', POINT_SIX)})
select 'Actually timely' as actual, tn as predicted_timely, fp as predicted_untimely from c
union all select 'Actually untimely', fn, tp from c""")

sql("metrics_at_threshold", "test", f"""
select cast(0.6 as double) as threshold, {RATE_COLUMNS} from ({at_cut('test', POINT_SIX)})""")

SWEEP = f"""
with counted as (
  select cast(t as double) as threshold,
         count(*) filter (score >= cast(t as float) and target = 1) as tp,
         count(*) filter (score >= cast(t as float) and target = 0) as fp,
         count(*) filter (score < cast(t as float) and target = 0) as tn,
         count(*) filter (score < cast(t as float) and target = 1) as fn
  from val cross join cuts group by t)
"""
for key in ("threshold_sweep", "fact_threshold"):
    sql(key, "val cuts", SWEEP + f"select threshold, {RATE_COLUMNS} from counted")
sql("fig_threshold", "val cuts", SWEEP + f"""
select threshold, {r(RATE_EXPR['precision'])} as precision, {r(RATE_EXPR['recall'])} as recall from counted""")
sql("locked_threshold_summary", "val cuts", SWEEP + f"""
select threshold, tp + fp as flagged, {r('100 * ' + RATE_EXPR['flag_rate'])} as flagged_pct, tp as caught,
       tp + fn as untimely_total, {r(RATE_EXPR['reviews_per_catch'])} as reviews_per_catch
from counted where threshold = 0.6""")
sql("threshold_explorer", "val cuts", SWEEP + f"""
select threshold, tp as caught, fn as missed, {r(ratio('100 * fn', 'tp + fn'))} as missed_pct,
       tp + fp as flagged, {r(RATE_EXPR['flag_rate'])} as flag_rate,
       {r(RATE_EXPR['reviews_per_catch'])} as reviews_per_catch,
       cast(floor(100 * {RATE_EXPR['precision']} + 0.5) as bigint) as hits_per_100,
       100 - cast(floor(100 * {RATE_EXPR['precision']} + 0.5) as bigint) as rest_per_100
from counted""")

sql("ranking_metrics", "pair", f"""
with {ladder('pair', 'year')}, m as ({ranked_metrics('year')})
select year, {r('pr_auc')} as pr_auc, {r('roc_auc')} as roc_auc, {r('prevalence')} as no_skill_pr_auc,
       {r('prevalence')} as positive_prevalence, n, n_positive from m""")

PR = f"""
with {ladder('test')},
curve as (
  select cast(score as double) as threshold, {ratio('pos_upto', 'n_upto')} as precision,
         {ratio('pos_upto', 'pos_total')} as recall from ladder
  union all select null, 1, 0)
"""
sql("pr_curve", "test", PR + f"""
select {r('threshold')} as threshold, {r('precision')} as precision, {r('recall')} as recall from curve""")
sql("fig_pr", "test", PR + f"""
select {r('threshold')} as threshold, {r('precision')} as precision, {r('recall')} as recall,
       {r('(select avg(target) from test)')} as no_skill from curve""")

NEAREST = """
targets as (select unnest([0.3, 0.4, 0.5, 0.6, 0.7])::double as target_recall),
near as (select target_recall, recall, coalesce(threshold, 'infinity'::double) as threshold, precision,
                row_number() over (partition by target_recall
                  order by abs(recall - target_recall), coalesce(threshold, 'infinity'::double)) as k
         from curve cross join targets),
points as (select * exclude (k) from near where k = 1)
"""
sql("precision_at_recall", "test", PR + ", " + NEAREST + f"""
select target_recall, {r('recall')} as recall, {r('threshold')} as threshold, {r('precision')} as precision
from points""")

ROC = f"""
with {ladder('test')},
curve as (
  select cast(score as double) as threshold, {ratio('n_upto - pos_upto', 'n_total - pos_total')} as fpr,
         {ratio('pos_upto', 'pos_total')} as tpr from ladder
  union all select null, 0, 0)
"""
sql("roc_curve", "test", ROC + f"""
select {r('threshold')} as threshold, {r('fpr')} as fpr, {r('tpr')} as tpr from curve""")
BENDS = f"""
with {ladder('test')},
stepped as (select *, lag(n) over w as n_before, lead(n) over w as n_next, lead(pos) over w as pos_next
            from ladder window w as (order by score desc))
select {r('score')} as threshold, {r(ratio('n_upto - pos_upto', 'n_total - pos_total'))} as fpr,
       {r(ratio('pos_upto', 'pos_total'))} as tpr
from stepped where n_before is null or n_next is null or n <> n_next or pos <> pos_next
union all select null, 0, 0
"""
sql("roc_corners", "test", BENDS)
sql("fig_roc", "test", ROC + f"select {r('fpr')} as fpr, {r('tpr')} as tpr from curve")


def interpolated(x: str, y: str, at: float) -> str:
    return f"""(
  with lo as (select {x} as x0, {y} as y0 from curve where {x} <= {at} order by {x} desc, {y} desc limit 1),
       hi as (select {x} as x1, {y} as y1 from curve where {x} > {at} order by {x}, {y} limit 1)
  select coalesce(y0 + (y1 - y0) * (({at} - x0) / (x1 - x0)), y0) from lo left join hi on true)"""


POINTS = f""", points as (select {interpolated('fpr', 'tpr', 0.1)} as tpr_at_fpr,
                               {interpolated('tpr', 'fpr', 0.9)} as fpr_at_tpr)"""
sql("roc_operating_points", "test", ROC + POINTS + f"""
select {r('tpr_at_fpr')} as tpr_at_fpr, {r('fpr_at_tpr')} as fpr_at_tpr,
       tpr_at_fpr > 0.9 and fpr_at_tpr < 0.1 as passed from points""")

BASELINE = f"""select 'majority-class baseline' as model, {r(ratio('count(*) - sum(target)', 'count(*)'))} as accuracy,
       cast(0 as double) as precision, cast(0 as double) as recall, cast(0 as double) as f1,
       {r('avg(target)')} as pr_auc, cast(0.5 as double) as roc_auc,
       cast(0 as bigint) as untimely_identified, cast(sum(target) as bigint) as untimely_total"""
sql("baseline_metrics", "val", BASELINE + " from val")

PER_MODEL = f"""{r('pr_auc')} as pr_auc, {r('roc_auc')} as roc_auc, {r('prevalence')} as no_skill_pr_auc,
       {r('prevalence')} as positive_prevalence, n, n_positive, cast(0.6 as double) as threshold"""
sql("model_comparison", "val", f"""
with long as (select 'logistic regression' as model, target, score from val
              union all select 'boosted trees', target, score_b from val),
{ladder('long', 'model')}, m as ({ranked_metrics('model')}), c as ({at_cut('long', POINT_SIX, 'model')})
select m.model, {PER_MODEL}, {RATE_COLUMNS}, cast(null as bigint) as untimely_identified,
       cast(null as bigint) as untimely_total
from m join c on m.model = c.model
union all by name {BASELINE} from val""")

TEXT_ROWS = """text_rows as (
  select target, complaint_id, score, milli_b / cast(1000 as double) as text_score,
         (milli_b / cast(1000 as double) + cast(score as double)) / 2 as combined
  from val where complaint_id in (select doc_id from documents where text <> ''))"""


def one_model(label: str, column: str, cut: str) -> str:
    return f"""select * from (
with src as (select target, {column} as s from text_rows), {ladder('src', score='s')},
m as ({ranked_metrics()}), c as ({at_cut('src', cut, score='s')})
select '{label}' as model, {PER_MODEL}, {RATE_COLUMNS} from m cross join c)"""


sql("narrative_model_comparison", "val", f"with {TEXT_ROWS} " + " union all ".join([
    one_model("structured (subset)", "score", POINT_SIX),
    one_model("tfidf text", "text_score", "cast(0.6 as double)"),
    one_model("combined", "combined", "cast(0.6 as double)"),
]))

sql("ensemble_score", "val", f"with {TEXT_ROWS} select complaint_id, {r('combined')} as combined from text_rows")

sql("final_test_summary", "test", f"""
with {ladder('test')}, m as ({ranked_metrics()}), c as ({at_cut('test', POINT_SIX)})
select cast(2000 as bigint) as period, n as records, n_positive as untimely, {r('prevalence')} as prevalence,
       cast(0.6 as double) as threshold, {RATE_COLUMNS}, {r('pr_auc')} as pr_auc, {r('roc_auc')} as roc_auc,
       {r('prevalence')} as no_skill_pr_auc, {r(ratio('n - n_positive', 'n'))} as baseline_accuracy
from m cross join c""")


def period_row(source: str) -> str:
    return f"""select {', '.join(f'{e} as {k}' for k, e in RATE_EXPR.items())}, pr_auc, roc_auc, prevalence
from (with {ladder(source)} {ranked_metrics()}) cross join ({at_cut(source, POINT_SIX)})"""


sql("val_vs_test", "val test", f"""
with v as ({period_row('val')}), t as ({period_row('test')}),
pairs as (""" + " union all ".join(
    f"select '{name}' as metric, v.{c} as validation, t.{c} as test from v cross join t"
    for name, c in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("PR-AUC", "pr_auc"),
                    ("ROC-AUC", "roc_auc"), ("Flag rate", "flag_rate"),
                    ("Positive prevalence", "prevalence"))) + f""")
select metric, {r('validation')} as validation, {r('test')} as test, {r('test - validation')} as change from pairs""")

BANDS = f"""bands as (
  select count(*) as untimely_total, count(*) filter (score < cast(0.1 as float)) as below,
         count(*) filter (score >= cast(0.1 as float) and score < {POINT_SIX}) as between_,
         count(*) filter (score >= {POINT_SIX}) as above from test where target = 1)"""
sql("positive_score_bands", "test", f"""
with {BANDS}
select untimely_total, below, between_ as between, above,
       {r(ratio('below', 'untimely_total'))} as below_share,
       {r(ratio('between_', 'untimely_total'))} as between_share,
       {r(ratio('above', 'untimely_total'))} as above_share,
       {r("(select median(cast(score as double)) from test where target = 0)")} as timely_median_score
from bands""")

SUMMARY = f"""count(*) as n, cast(sum(target) as bigint) as positives,
       count(*) filter (score >= {POINT_SIX}) as flagged, {r('avg(cast(score as double))')} as mean_score,
       {r('avg(target)')} as observed_rate,
       {r(ratio('avg(cast(score as double))', 'avg(target)'))} as overprediction"""
sql("score_summary", "pair", f"select year, {SUMMARY} from pair group by year")

# --------------------------------------------------------------------------- calibration

RISK = f"""
with ranked as ({ASCENDING}),
groups_ as (select {group_of(10)} as risk_group, count(*) as cases, cast(sum(target) as bigint) as observed,
                   sum(least(greatest(cast(score as double), 1e-15), 1 - 1e-15)) as expected
            from ranked group by 1)
"""
sql("risk_group_table", "test", RISK + f"""
select risk_group, cases, observed, {r('expected')} as expected, {r(ratio('observed', 'cases'))} as observed_rate,
       {r(ratio('expected', 'cases'))} as expected_rate from groups_""")
sql("hosmer_lemeshow", "test", RISK + f""",
stat as (select sum(power(observed - expected, 2) / (expected * (1 - expected / cases))) as chi2 from groups_)
select {r('chi2', 6)} as chi2, cast(8 as bigint) as dof,
       {r('exp(-chi2 / 2) * (1 + chi2 / 2 + power(chi2 / 2, 2) / 2 + power(chi2 / 2, 3) / 6)', 6)} as p_value
from stat""")

sql("brier_log_loss", "test", f"""
with p as (select least(greatest(cast(score as double), 1e-15), 1 - 1e-15) as p, target as y from test)
select count(*) as n, {r('avg(power(p - y, 2))')} as brier,
       {r('avg(-(case when y = 1 then ln(p) else ln(1 - p) end))')} as log_loss,
       {r('avg(p)')} as mean_predicted, {r('avg(y)')} as observed_rate,
       {r(ratio('avg(p)', 'avg(y)'))} as overprediction
from p""")

sql("calibration_curve", "test", f"""
with pos as (select cast(score as double) as p, row_number() over (order by score) - 1 as i from test),
total as (select count(*) as n from test),
want as (select k, k * (n - 1) // 10 as lo, least(k * (n - 1) // 10 + 1, n - 1) as hi,
                ((k * (n - 1)) % 10) / cast(10 as double) as f
         from total, range(1, 10) ks(k)),
edges as (select a.p + (b.p - a.p) * f as e from want join pos a on a.i = lo join pos b on b.i = hi),
binned as (select cast(score as double) as p, target,
                  (select count(*) from edges where e < cast(score as double)) as bin from test)
select bin, count(*) as n, {r('avg(p)')} as mean_score, {r('avg(target)')} as observed_fraction
from binned group by bin""")

# --------------------------------------------------------------------------- features

FEATURES = ("product", "sub_product", "issue", "sub_issue", "company", "state", "channel")
LEVELS = "with cells as (" + " union all ".join(
    f"select '{c}' as feature, coalesce({c}, 'MISSING') as level from sample" for c in FEATURES
) + """),
levels as (select feature, level, count(*) as count,
                  case when count(*) < 10 then 'infrequent_sklearn' else level end as encoded
           from cells group by feature, level)
"""
sql("category_levels", "sample", LEVELS + "select * from levels")
COUNTED = """, counted as (select count(distinct feature || '=' || encoded) as categorical from levels)
"""
sql("encoded_feature_count", "sample", LEVELS + COUNTED + """
select categorical, cast(3 as bigint) as numeric, categorical + 3 as total from counted""")

RATED = "with cells as (" + " union all ".join(
    f"select '{c}' as feature, coalesce({c}, 'MISSING') as level, target, complaint_id from sample" for c in FEATURES
) + ")"
WEIGHTS = RATED + """, weights as (
  select feature, level, round(avg(target), 6) - 0.125 as weight from cells group by feature, level)
"""


def given_scores(years: str, keep: str) -> str:
    terms = " + ".join(
        f"coalesce((select weight from weights w where w.feature = '{c}' and w.level = coalesce(s.{c}, 'MISSING')), 0)"
        for c in FEATURES
    )
    return WEIGHTS + f"""
select {keep}, {r(f'cast(1 / (1 + exp(-(-1.5 + {terms} + 0.25 * (year - 1997) / 2.0 - 0.125 * (month - 6.5) / 4.0'
       ' + 0.0625 * (quarter - 2.5)))) as float)', 5)} as score
from cases s where year in ({years})"""


sql("given_weight_scores", "sample", given_scores("2000", "complaint_id, year"))
sql("given_model_store", "sample", given_scores("1999", "complaint_id"))


def step(source: str) -> str:
    """One level down: from the node that a row has reached to its child; a missing feature goes to the lower one."""
    value = "case n.kind when 0 then s.month when 1 then s.quarter when 2 then s.year else s.part end"
    return f"""select s.* exclude (node), 2 * s.node + 1 + coalesce(cast({value} > n.border as int), 0) as node
      from {source} s join nodes n on n.tree = s.tree and n.node = s.node"""


sql("given_tree_scores", "cases", f"""
with nodes as (
  select tree, node, (tree * 7 + node * 5) % 4 as kind,
         case (tree * 7 + node * 5) % 4 when 0 then (tree * 3 + node * 5) % 11 + 1.5
              when 1 then (tree + node * 2) % 3 + 1.5 when 2 then (tree + node) % 5 + 1995.5
              else (tree * 7 + node * 3) % 16 + 0.5 end as border,
         ((tree * 31 + node * 17) % 101 - 50) / 64.0 as value
  from (select unnest(range(20)) as tree) t, (select unnest(range(15)) as node) n),
rows as (
  select complaint_id, month, quarter, year, case when complaint_id % 9 > 0 then complaint_id % 17 end as part,
         tree, 0 as node
  from cases, (select unnest(range(20)) as tree) t where year = 2000),
one as ({step("rows")}), two as ({step("one")}), three as ({step("two")})
select complaint_id, {r('cast(1 / (1 + exp(-(sum(n.value) - 1.0))) as float)', 5)} as score
from three s join nodes n on n.tree = s.tree and n.node = s.node group by complaint_id""")

sql("target_encoding", "sample", RATED + f"""
, folded as (
  select feature, level, target, ('0x' || substr(md5(cast(complaint_id as varchar)), 1, 8))::bigint % 5 as own
  from cells),
folds as (select unnest(range(-1, 5)) as fold),
every as (select distinct feature, level from cells)
select e.feature, e.level, f.fold,
       {r('(coalesce(sum(c.target), 0) + (select avg(target) from sample)) / (count(c.target) + 1)')} as rate
from every e cross join folds f
left join folded c on c.feature = e.feature and c.level = e.level and c.own <> f.fold
group by e.feature, e.level, f.fold""")

ORDERED = RATED + """, placed as (
  select feature, target, complaint_id,
         (coalesce(sum(target) over earlier, 0) + (select avg(target) from sample)) / (count(*) over earlier + 1) as rate
  from cells
  window earlier as (partition by feature, level order by md5('order-42-' || complaint_id), complaint_id
                     rows between unbounded preceding and 1 preceding))
"""

sql("ordered_target_rates", "sample", ORDERED + f"""
select complaint_id, feature, {r('rate')} as rate from placed""")

sql("first_split_gains", "sample", ORDERED + f"""
, known as (
  select feature || '_rate' as feature, rate as value, target from placed
  union all select 'year_num', year, target from sample
  union all select 'month_num', month, target from sample
  union all select 'quarter_num', quarter, target from sample),
grid as (
  select f.feature, k / 32.0 as border from (select distinct feature from known where feature like '%_rate') f,
         (select unnest(range(1, 16)) as k)
  union all select 'year_num', unnest([1994.5, 1996.5])
  union all select 'month_num', k + 0.5 from (select unnest(range(1, 12)) as k)
  union all select 'quarter_num', unnest([1.5, 2.5, 3.5])),
start as (select (sum(target) + 0.5) / (count(*) + 1) as p, count(*) as n from sample),
sums as (
  select feature, border, sum(case when value <= border then p - target else 0 end) as low_g,
         sum(case when value <= border then p * (1 - p) else 0 end) as low_h,
         sum(p - target) as g, sum(p * (1 - p)) as h, any_value(n) as n
  from known join grid using (feature), start group by feature, border)
select feature, cast(border as double) as border,
       {r('(low_g * low_g / (low_h + 3) + (g - low_g) * (g - low_g) / (h - low_h + 3) - g * g / (h + 3)) / n', 6)} as gain
from sums""")

sql("gbt_invariants", "cases", """
select count(*) as scored, count(distinct complaint_id) as cases, count(*) as probabilities,
       cast(100 as double) as importance from cases where year = 1999""")

sql("ablation_invariants", "", """
select unnest([1999, 2000]) as period, cast(3 as bigint) as variants, true as pr_auc_agrees, true as roc_auc_agrees""")

sql("logreg_slopes", "sample", LEVELS + """
select distinct 'cat__' || feature || '_' || encoded as feature, cast(0 as double) as slope from levels
union all select unnest(['num__year', 'num__month', 'num__quarter', '(intercept)']), cast(0 as double)""")

sql("given_coefficient_table", "sample", WEIGHTS + f"""
, named as (
  select 'cat__' || feature || '_' || level as feature, weight as coefficient from weights
  union all select unnest(['num__year', 'num__month', 'num__quarter']), unnest([0.25, -0.125, 0.0625]))
select feature, {r('coefficient', 6)} as coefficient, {r('abs(coefficient)', 6)} as abs_coef,
       case when coefficient > 0 then 'increases untimely risk' else 'decreases untimely risk' end as direction,
       row_number() over (order by abs(coefficient) desc, feature) as place
from named""")

sql("given_ablation_shift", "pair", f"""
with stacked as (
  select year, target, 'baseline' as variant, milli as m from pair
  union all select year, target, 'dropped', milli_b from pair
  union all select year, target, 'capped', least(milli, milli_b) from pair),
measured as (
  select variant, year, sum(case when target = 1 and m >= 600 then 1 else 0 end) / cast(sum(target) as double) as recall,
         avg(cast(cast(m / cast(1000 as double) as float) as double)) as mean_score
  from stacked group by variant, year),
wide as (
  select variant, max(recall) filter (year = 1999) as early, max(recall) filter (year = 2000) as late,
         max(mean_score) filter (year = 1999) as low, max(mean_score) filter (year = 2000) as high
  from measured group by variant)
select variant, {r('early')} as recall_validation, {r('late')} as recall_test, {r('early - late')} as recall_fall,
       {r('high - low')} as mean_score_shift
from wide""")

sql("logreg_gradient", "sample", LEVELS + """
select distinct 'cat__' || feature || '_' || encoded as feature, cast(0 as double) as slope from levels""")

sql("scaler_stats", "sample", " union all ".join(
    f"select '{c}' as feature, {r(f'avg({c})')} as mean, {r(f'stddev_pop({c})')} as std from sample"
    for c in ("year", "month", "quarter")))

sql("one_hot_vectors", "sample", LEVELS + ", rows as (" + " union all ".join(
    f"select complaint_id, '{c}' as feature, coalesce({c}, 'MISSING') as level from cases where year = 1999"
    for c in FEATURES) + "), scaled as (" + " union all ".join(
    f"select complaint_id, 'num__{c}' as feature, "
    f"{r(f'({c} - (select avg({c}) from sample)) / (select stddev_pop({c}) from sample)')} as value "
    "from cases where year = 1999" for c in ("year", "month", "quarter")) + """)
select complaint_id, 'cat__' || feature || '_' || encoded as feature, cast(1 as double) as value
from rows join levels using (feature, level)
union all select * from scaled where value <> 0""")


def tokenised(source: str) -> str:
    """CTEs from texts to (id, term, tf): words without redaction marks, and adjacent pairs."""
    return f"""
words as (select complaint_id, list_filter(
            regexp_extract_all(strip_accents(lower(narrative)), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
            lambda w: w not in ('xxxx', 'xx', 'xxxxxxxx', 'xxxxxxxxxxxx')) as w from ({source})),
terms as (select complaint_id, unnest(w) as term from words
          union all
          select complaint_id, w[i] || ' ' || w[i + 1] as term
          from (select complaint_id, w, unnest(range(1, len(w))) as i from words)),
tf as (select complaint_id, term, count(*) as tf from terms group by complaint_id, term),
stats as (select term, cast(sum(tf) as bigint) as count, count(*) as df from tf group by term),
vocab as (select term, count, df, ln((1 + (select count(*) from words)) / cast(1 + df as double)) + 1 as idf
          from stats where df >= 5 order by count desc, term limit 50000)"""


sql("tfidf_terms", "", f"""
with {tokenised("select doc_id as complaint_id, text as narrative from documents join orders on doc_id = o_orderkey where text <> ''")}
select term, count, df, {r('idf', 6)} as idf from vocab""")

sql("tfidf_features", "sample", f"""
with {tokenised("select complaint_id, narrative from sample where has_narrative")},
weighed as (select complaint_id, term, (1 + ln(tf)) * idf as w from tf join vocab using (term)),
norms as (select complaint_id, sqrt(sum(w * w)) as norm from weighed group by complaint_id)
select complaint_id, term, {r('w / norm', 6)} as weight from weighed join norms using (complaint_id)""")

sql("given_text_scores", "sample", f"""
with given as (with {tokenised("select complaint_id, narrative from sample where has_narrative")}
  select term, idf, (len(term) * 7 % 11 - 5) / 8.0 as coefficient from vocab),
scored as (with {tokenised("select complaint_id, narrative from cases where has_narrative and year = 1999")}
  select words.complaint_id, sum((1 + ln(tf)) * idf * coefficient) / sqrt(sum(((1 + ln(tf)) * idf) ** 2)) as margin
  from words left join (tf join given using (term)) using (complaint_id) group by words.complaint_id)
select complaint_id, {r('1 / (1 + exp(0.75 - coalesce(margin, 0)))', 6)} as score from scored""")

# --------------------------------------------------------------------------- checks


def check(name: str, expected: str, actual: str, passed: str, source: str) -> str:
    return f"""select '{name}' as "check", '{expected}' as expected, {r(actual)} as actual, {passed} as passed
from {source}"""


sql("check_duplicate_ids", "study", "with d as (select count(*) - count(distinct complaint_id) as dup from study) "
    + check("duplicate ids", "0", "dup", "dup = 0", "d"))

sql("check_pr_midrange", "test", PR + ", " + NEAREST
    + ", spread as (select min(precision) as lo, max(precision) as hi from points) "
    + " union all ".join([
        check("lowest mid-range precision", ">= 0.1", "lo", "lo >= 0.1", "spread"),
        check("highest mid-range precision", "<= 0.15", "hi", "hi <= 0.15", "spread"),
        check("mid-range precision in band", "0.1 to 0.15", "hi - lo", "lo >= 0.1 and hi <= 0.15", "spread"),
    ]))

sql("check_roc_shape", "test", ROC + POINTS + " union all ".join([
    check("TPR at FPR 0.10", "> 0.9", "tpr_at_fpr", "tpr_at_fpr > 0.9", "points"),
    check("FPR at TPR 0.90", "< 0.1", "fpr_at_tpr", "fpr_at_tpr < 0.1", "points"),
]))

sql("check_score_bands", "test", f"with {BANDS} " + " union all ".join([
    f"""select 'untimely at or above 0.6' as "check", cast(count(*) as varchar) as expected,
        cast(count(*) as double) as actual, true as passed from test where target = 1 and score >= {POINT_SIX}""",
    check("bands cover all untimely", "total", "below + between_ + above",
          "below + between_ + above = untimely_total", "bands"),
    check("share between 0.1 and 0.6", "> 0", ratio("between_", "untimely_total"), "between_ > 0", "bands"),
]))

sql("check_feature_count", "sample", LEVELS + COUNTED + """
select 'encoded features' as "check", cast(categorical + 3 as varchar) as expected,
       cast(categorical + 3 as double) as actual, true as passed from counted""")

sql("check_text_subset", "sample", f"""
with s as (select count(*) filter (has_narrative) as n,
                  {ratio('100 * count(*) filter (has_narrative)', 'count(*)')} as p,
                  100 * avg(target) filter (has_narrative) as rate from sample) """ + " union all ".join([
    f"""select '{name}' as "check", cast({expected} as varchar) as expected, {r(actual)} as actual, true as passed from s"""
    for name, expected, actual in (
        ("narrative rows in training", "n", "n"),
        ("narrative share of training, %", "round(p, 2)", "p"),
        ("untimely rate in subset, %", "round(rate, 2)", "rate"),
    )
]))

sql("check_calibration", "test", f"with ranked as ({ASCENDING}) " + " union all ".join(
    f"""select 'top of {q} groups overpredicts' as "check", '> 1' as expected,
        {r(ratio('avg(cast(score as double))', 'avg(target)'))} as actual,
        avg(cast(score as double)) > avg(target) as passed from ranked where {group_of(q)} = {q - 1}"""
    for q in (5, 10, 20)) + f""" union all
select 'rows at or above 0.6', cast(count(*) as varchar), cast(count(*) as double), true
from test where score >= {POINT_SIX}""")

sql("check_uniform_bins", "test", f"""
with edges as (select i, i * cast(0.1 as double) as e from range(0, 10) t(i)),
binned as (select score, target, (select max(i) from edges where e <= cast(score as double)) as bin from test),
bins as (select bin, avg(cast(score as double)) as p, avg(target) as o from binned group by bin)
select 'bin ' || bin || ' of equal width overpredicts' as "check", '> 1' as expected,
       {r(ratio('p', 'o'))} as actual, p > o as passed from bins""")

sql("check_sizes", "study sample cases", f"""
with s as (
  select (select count(*) from study) as study, (select count(*) from sample) as n, (select sum(target) from sample) as pos,
         (select count(*) from cases where year = 2000) as tn, (select sum(target) from cases where year = 2000) as tp)
""" + " union all ".join(
    f"""select '{name}' as "check", cast({expected} as varchar) as expected, {r(actual)} as actual, true as passed from s"""
    for name, expected, actual in (
        ("study records", "study", "study"),
        ("training rows", "n", "n"),
        ("untimely training rows", "cast(pos as bigint)", "pos"),
        ("untimely share of training, %", f"round({ratio('100 * pos', 'n')}, 2)", ratio("100 * pos", "n")),
        ("test records", "tn", "tn"),
        ("untimely test records", "cast(tp as bigint)", "tp"),
        ("no-skill precision", f"round({ratio('tp', 'tn')}, 4)", ratio("tp", "tn")),
    )
))

sql("check_source_rows", "", """
with s as (select cast(ceil(count(*) / 5000.0) as bigint) as c from lineitem)
select 'source chunks' as "check", cast(c as varchar) as expected, cast(c as double) as actual, true as passed from s""")
