"""Queries on detectors' quality, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import evaluate
from ..sources.tables import table

#: A detector of junk: marks that stand in for words.
MARKS = "!!|%%%|[$][$][$]|&&&|###"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: bad (quality 0), toxic, and two detectors' flags."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.col("text").rlike(MARKS).alias("marks"))
    return docs.join(labels, "doc_id").select("*", (F.col("quality") == 0).alias("bad"), (F.col("n_chars") > 2500).alias("long"))


JUDGED = f"""judged as (select d.doc_id, lang, source, n_chars, regexp_matches(text, '{MARKS}') as marks, quality, toxic, quality = 0 as bad, n_chars > 2500 as "long"
 from documents d join labels l on d.doc_id = l.doc_id)"""
COUNTS = "count(*) filter (where marks and bad) as tp, count(*) filter (where marks and not bad) as fp, count(*) filter (where not marks and bad) as fn, count(*) filter (where not marks and not bad) as tn"


def wilson_sql(k: str, n: str, end: str) -> str:
    z = "1.96"
    k, n = f"(({k})::double)", f"(({n})::double)"
    centre = f"(({k}/{n} + {z}*{z}/(2*{n})) / (1 + {z}*{z}/{n}))"
    half = f"({z} * sqrt({k}/{n}*(1-{k}/{n})/{n} + {z}*{z}/(4*{n}*{n})) / (1 + {z}*{z}/{n}))"
    value = f"greatest(0, {centre} - {half})" if end == "lo" else f"least(1, {centre} + {half})"
    return f"case when {n} <> 0 then round({value}, 6) end"


def rates_sql(source: str, keys: str) -> str:
    parts = [keys, "tp", "fp", "fn", "tn", "(tp + fp) = 0 as flags_nothing"]
    for name, k, n in (("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("fpr", "fp", "fp + tn")):
        value = f"round(case when ({n}) <> 0 then ({k})::double / ({n}) end, 6)"
        parts += [f"{f'coalesce({value}, 0)' if name == 'precision' else value} as {name}", f"{wilson_sql(k, n, 'lo')} as {name}_lo", f"{wilson_sql(k, n, 'hi')} as {name}_hi"]
    return f"select {', '.join(p for p in parts if p)} from {source}"


SLICES = f"""with {JUDGED}, sets as (select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'all' end as slice_dim,
 case when grouping(lang) = 0 then lang when grouping(source) = 0 then source else 'all' end as slice_value, {COUNTS} from judged group by grouping sets ((), (lang), (source))),
 rated as ({rates_sql('sets', 'slice_dim, slice_value')})"""


def at_sql(recall: str, fpr: str, p: str = "prevalence") -> str:
    return f"round(case when {recall}*{p} + {fpr}*(1-{p}) = 0 then 0 else {recall}*{p} / ({recall}*{p} + {fpr}*(1-{p})) end, 6)"


def eval_slices(spark, sf_dir):
    return evaluate.slices(judged(spark, sf_dir), F.col("marks"), F.col("bad"), ["lang", "source"])


def eval_report(spark, sf_dir):
    """The flagship: a detector's report over all rows and by language, at four prevalences."""
    return evaluate.at_prevalences(evaluate.slices(judged(spark, sf_dir), F.col("marks"), F.col("bad"), ["lang"])).orderBy("slice_dim", "slice_value", "prevalence")


def eval_prevalence(spark, sf_dir):
    rated = stats.rates(stats.confusion(judged(spark, sf_dir), F.col("long"), F.col("toxic") == 1))
    return evaluate.at_prevalences(rated).select("prevalence", "point", "conservative", "recall", "fpr")


def wilson_by_lang(spark, sf_dir):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    counts = judged(spark, sf_dir).groupBy("lang").agg(F.count_if("bad").alias("k"), F.count("*").alias("n"))
    return counts.select("lang", "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("value"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def auc_length(spark, sf_dir):
    return stats.auc(judged(spark, sf_dir), F.col("n_chars"), F.col("bad"), ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


def threshold_pick(spark, sf_dir):
    return evaluate.pick_threshold(judged(spark, sf_dir), F.col("n_chars"), F.col("quality") == 1, 0.75)


def shortcut_check(spark, sf_dir):
    """Length alone against the detector, and the upper median length of either class."""
    j = judged(spark, sf_dir)
    length = stats.auc(j, F.col("n_chars"), F.col("bad")).select(F.round("auc", 6).alias("length_auc"))
    model = stats.auc(j, F.col("marks").cast("int"), F.col("bad")).select(F.round("auc", 6).alias("model_auc"))
    mid = stats.floor_rank(j, "n_chars", 0.5, ["bad"])
    wide = mid.agg(F.max(F.when(F.col("bad"), F.col("n_chars"))).alias("median_bad"), F.max(F.when(~F.col("bad"), F.col("n_chars"))).alias("median_good"))
    return length.crossJoin(model).crossJoin(wide)


def mcnemar_detectors(spark, sf_dir):
    return evaluate.compare(judged(spark, sf_dir), F.col("marks"), F.col("long"), F.col("bad"))


def psi_event_mix(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.dayofmonth("ts") <= 15).alias("e"), F.count_if(F.dayofmonth("ts") > 15).alias("a"))
    return stats.psi(e, "e", "a").select(F.round("psi", 6).alias("psi"))


def drift_halves(spark, sf_dir):
    return evaluate.drift(table(spark, sf_dir, "events").select("event_type", "ts", "event_id"), "event_type", ["ts", "event_id"])


def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    a = stats.ceil_rank(e, "value", 0.5, ["event_type"]).withColumnRenamed("value", "p50")
    b = stats.ceil_rank(e, "value", 0.95, ["event_type"]).withColumnRenamed("value", "p95")
    c = stats.floor_rank(e, "value", 0.95, ["event_type"]).withColumnRenamed("value", "p95_floor")
    return a.join(b, "event_type").join(c, "event_type")


def adjusted_verdicts(spark, sf_dir):
    rated = evaluate.slices(judged(spark, sf_dir), F.col("marks"), F.col("bad"), ["lang"])
    return evaluate.adjusted(rated).select("slice_dim", "slice_value", "point", "conservative", "verdict")


def gate_status(spark, sf_dir):
    """The gate for each language's slice: at least 100 rows are evidence; latency and comparison as measured elsewhere."""
    rated = evaluate.slices(judged(spark, sf_dir), F.col("marks"), F.col("bad"), ["lang"])
    rows = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return evaluate.gate(rated, rows >= 100, F.lit(3.0), F.lit(0), F.col("tp") - F.col("fp"), F.lit(1.0)).select("slice_dim", "slice_value", "status", "verdict", "flags_nothing")


def negatives_needed(spark, sf_dir):
    rated = evaluate.slices(judged(spark, sf_dir), F.col("marks"), F.col("bad"), ["lang"])
    return rated.select("slice_dim", "slice_value", stats.negatives_needed(F.col("recall_lo"), 0.9, 0.01).cast("long").alias("negatives"))


VERDICT = "case when recall is null or fpr is null or point < 0.9 then 'failed' when conservative >= 0.9 then 'met' else 'unproven' end"
LANGS = SLICES.replace("when grouping(source) = 0 then 'source' ", "").replace("when grouping(source) = 0 then source ", "").replace(", (source))", ")")
AT = f"at1 as (select *, {at_sql('recall', 'fpr', '0.01')} as point, {at_sql('recall_lo', 'fpr_hi', '0.01')} as conservative from rated)"
SLICED = "slice_dim, slice_value, tp, fp, fn, tn, precision, precision_lo, precision_hi, recall, recall_lo, recall_hi, fpr, fpr_lo, fpr_hi, flags_nothing, (tp + fp + fn + tn) < 30 as underpowered"
PREV = "(values (0.01::double), (0.05::double), (0.2::double), (0.5::double)) p(prevalence)"


def auc_sql(score: str, positive: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""(select {key}round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::double * sum(neg), 0), 6) as auc from (select *, coalesce(sum(neg) over ({f'partition by {by}' if by else ''} order by s rows between unbounded preceding and 1 preceding), 0) as below
 from (select {key}{score} as s, count(*) filter (where {positive}) as pos, count(*) filter (where not ({positive})) as neg from judged group by all)) {f'group by {by}' if by else ''})"""


SQL = {
    "eval_slices": f"{SLICES} select {SLICED} from rated",
    "eval_report": f"{LANGS} select {SLICED}, prevalence, {at_sql('recall', 'fpr')} as point, {at_sql('recall_lo', 'fpr_hi')} as conservative from rated cross join {PREV}",
    "eval_prevalence": f"with {JUDGED}, c as (select count(*) filter (where \"long\" and toxic = 1) as tp, count(*) filter (where \"long\" and toxic <> 1) as fp, count(*) filter (where not \"long\" and toxic = 1) as fn, count(*) filter (where not \"long\" and toxic <> 1) as tn from judged), rated as ({rates_sql('c', '')}) select prevalence, {at_sql('recall', 'fpr')} as point, {at_sql('recall_lo', 'fpr_hi')} as conservative, recall, fpr from rated cross join {PREV}",
    "wilson_by_lang": f"with {JUDGED}, c as (select lang, count(*) filter (where bad) as k, count(*) as n from judged group by lang) select lang, k, n, round(k::double / n, 6) as value, {wilson_sql('k', 'n', 'lo')} as lo, {wilson_sql('k', 'n', 'hi')} as hi from c",
    "auc_length": f"with {JUDGED} select * from {auc_sql('n_chars', 'bad', 'lang')}",
    "threshold_pick": f"""with {JUDGED}, c as (select n_chars as threshold, count(*) filter (where quality = 1) as p, count(*) filter (where quality <> 1) as n from judged group by n_chars),
 r as (select threshold, sum(p) over w as tp, sum(n) over w as fp, (select sum(p) from c) as positives from c window w as (order by threshold desc rows between unbounded preceding and current row)),
 l as (select *, {wilson_sql('tp', 'tp + fp', 'lo').replace('round(', '(').replace(', 6)', ')')} as lo from r)
 select threshold, tp::bigint as tp, fp::bigint as fp, round(tp::double / positives, 6) as recall, round(lo, 6) as precision_lo from l where lo >= 0.75 order by tp desc, threshold desc limit 1""",
    "shortcut_check": f"""with {JUDGED}, a as (select auc as length_auc from {auc_sql('n_chars', 'bad')}), b as (select auc as model_auc from {auc_sql('marks::int', 'bad')}),
 m as (select bad, list_sort(list(n_chars))[(count(*) // 2 + 1)::int] as mid from judged group by bad)
 select length_auc, model_auc, (select mid from m where bad) as median_bad, (select mid from m where not bad) as median_good from a, b""",
    "mcnemar_detectors": f"""with {JUDGED}, c as (select count(*) filter (where (marks = bad) and ("long" <> bad)) as b, count(*) filter (where ("long" = bad) and (marks <> bad)) as c from judged)
 select b as candidate_only, c as baseline_only, b - c as better, case when b + c = 0 then 1.0 else round(least(1.0, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) from range(0, least(b, c) + 1) t(i))), 6) end as p from c""",
    "psi_event_mix": """with c as (select event_type, count(*) filter (where day(ts) <= 15) as e, count(*) filter (where day(ts) > 15) as a from events group by 1),
 s as (select greatest(e::double / sum(e) over (), 1e-4) as pe, greatest(a::double / sum(a) over (), 1e-4) as pa from c) select round(sum((pa - pe) * ln(pa / pe)), 6) as psi from s""",
    "drift_halves": """with r as (select event_type, row_number() over (order by ts, event_id) as rk, count(*) over () as n from events),
 c as (select event_type, count(*) filter (where rk <= n // 2) as e, count(*) filter (where rk > n // 2) as a, max(n) as n from r group by 1),
 s as (select greatest(e::double / sum(e) over (), 1e-4) as pe, greatest(a::double / sum(a) over (), 1e-4) as pa, n from c)
 select max(n) as total, case when max(n) >= 40 then round(sum((pa - pe) * ln(pa / pe)), 6) end as psi, max(n) >= 40 as measured from s""",
    "latency_percentiles": """select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, list_sort(list(value))[least(count(value), floor(0.95 * count(value)) + 1)::int] as p95_floor from events group by event_type""",
    "adjusted_verdicts": f"{LANGS}, {AT} select slice_dim, slice_value, point, conservative, {VERDICT} as verdict from at1",
    "gate_status": f"{LANGS}, {AT}, v as (select *, {VERDICT} as verdict from at1) select slice_dim, slice_value, case when tp + fp + fn + tn < 100 then 'NO_EVIDENCE' when flags_nothing or tp = 0 or verdict = 'failed' then 'FAIL' when verdict = 'unproven' then 'INCONCLUSIVE' else 'PASS' end as status, verdict, flags_nothing from v",
    "negatives_needed": f"{LANGS} select slice_dim, slice_value, case when recall_lo > 0 then ceil(1.96 * 1.96 * (1 / (recall_lo * (0.01 * (1 - 0.9) / (0.9 * (1 - 0.01)))) - 1))::bigint end as negatives from rated",
}
QUERIES = {f.__name__: f for f in (eval_slices, eval_report, eval_prevalence, wilson_by_lang, auc_length, threshold_pick, shortcut_check, mcnemar_detectors, psi_event_mix, drift_halves, latency_percentiles, adjusted_verdicts, gate_status, negatives_needed)}
