"""Queries on events, the survey, published figures, pictures and trained models, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, speech, stats
from ..operators import activity, facts, pictures, selection, survey, training
from ..operators.textmodel import split
from ..sources.tables import table
from ..streaming import activity as stream

SQL: dict[str, str] = {}

#: Events of the tool made from the events table. (Fixed values, in both engines.)
KIND = "case event_type when 'view' then 'message' when 'click' then 'link' when 'purchase' then 'qr' when 'signup' then 'faq' else 'error' end"
LEVEL = "case event_id % 6 when 0 then 'scam' when 1 then 'suspicious' when 2 then 'unverified' when 3 then 'official' when 4 then 'nothing' else 'safe' end"
FAMILY = "case event_id % 4 when 0 then 'otp' when 1 then 'kyc' when 2 then 'a person wrote this' else 'unlisted' end"
RULE = "case event_id % 5 when 0 then 'urgency' when 1 then 'threat' when 2 then 'kyc' when 3 then 'Free Text!' else 'unlisted' end"
FAMILIES, RULES = ["otp", "kyc"], ["urgency", "threat", "kyc", "click-link"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "ts", f"{KIND} as kind", f"{LEVEL} as level", f"{FAMILY} as family", f"array({RULE}, 'click-link') as rules", "value as ms", "cast(null as string) as code")
    return activity.clean(e, FAMILIES, RULES)


CLEAN = f"""raw as (select event_id, ts, {KIND} as kind, {LEVEL} as level, {FAMILY} as family, {RULE} as rule, value as ms from events),
 clean as (select event_id, date_trunc('minute', ts) as ts, kind, case when level <> 'safe' then level end as level,
 case when family in ('otp', 'kyc') then family when family = 'unlisted' then 'other' end as family,
 case when rule in ('urgency', 'threat', 'kyc') then rule when rule = 'unlisted' then 'other' end as rule,
 case when ms >= 0 then least(floor(ms * 100 + 0.5) / 100, 600000) end as ms from raw)"""
SUMMARY = """sums as (select 'kind' as section, kind as key from clean union all select 'level', level from clean where kind in ('message', 'link', 'qr')
 union all select 'family', family from clean where kind in ('message', 'link', 'qr') union all select 'rule', rule from clean where kind in ('message', 'link', 'qr')
 union all select 'rule', 'click-link' from clean where kind in ('message', 'link', 'qr') union all select 'error', 'unknown' from clean where kind = 'error'),
 summary as (select section, key, count(*) as n from sums where key is not null group by all)"""


def ops_summary(spark, sf_dir):
    return activity.summary(events(spark, sf_dir))


SQL["ops_summary"] = f"with {CLEAN}, {SUMMARY} select * from summary"


def top_rules(spark, sf_dir):
    return activity.top_rules(events(spark, sf_dir))


SQL["top_rules"] = f"with {CLEAN}, {SUMMARY} select key as rule, n from summary where section = 'rule' order by n desc, key limit 10"


def flagged_share(spark, sf_dir):
    return activity.flagged_share(events(spark, sf_dir))


SQL["flagged_share"] = f"with {CLEAN} select count(*) as verdicts, floor(1000.0 * count(*) filter (where level in ('scam', 'suspicious')) / count(*) + 0.5) / 1000 as flagged_share from clean where kind in ('message', 'link', 'qr')"


def ring_buffer(spark, sf_dir):
    return activity.latest(events(spark, sf_dir)).select("event_id", "ts", "kind", "level", "family", "ms")


SQL["ring_buffer"] = f"with {CLEAN} select event_id, ts, kind, level, family, ms from clean order by ts desc, event_id desc limit 300"


def ops_latency(spark, sf_dir):
    return activity.latency(events(spark, sf_dir))


SQL["ops_latency"] = f"""with {CLEAN}, v as (select ms, row_number() over (order by ms) as r, count(*) over () as n from clean where kind in ('message', 'link') and ms is not null),
 a as (select count(*) as samples, {', '.join(f"max(ms) filter (where r = least(n, floor({q} * n)::bigint + 1)) as {p}" for q, p in ((0.5, 'p50'), (0.95, 'p95'), (0.99, 'p99')))}, max(ms) as most from v)
 select *, case when samples < 5 then 'not-enough-data' when p95 <= 50 then 'met' else 'breached' end as status from a"""


def verdict_sessions(spark, sf_dir):
    return activity.sessions(table(spark, sf_dir, "events"), "user_id", "ts")


SQL["verdict_sessions"] = """with g as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 3600000000 then 0 else 1 end as o from events),
 s as (select user_id, ts, sum(o) over (partition by user_id order by ts rows unbounded preceding) as k from g)
 select user_id, min(ts) as began, max(ts) as ended, count(*) as events from s group by user_id, k"""


def stream_ops_windows(spark, sf_dir):
    """Ten-minute counts from the events as a stream: the windows that the watermark, an hour behind the newest event, has closed."""
    return stream.run_available(stream.windowed(stream.read_events(spark, f"{sf_dir}/events.parquet*")))


SQL["stream_ops_windows"] = """with w as (select time_bucket(interval '10 minutes', ts, timestamp '2000-01-01') as began, event_type, count(*) as n, max(value) as most from events group by 1, 2)
 select * from w where epoch_ms(began + interval '10 minutes') <= (select epoch_ms(max(ts)) - 3600000 from events)"""
VERDICT = "case event_type when 'error' then 'scam' when 'click' then 'suspicious' end"


def stream_followup_state(spark, sf_dir):
    """The verdict each event's user had in the hour before, kept as state."""
    e = stream.read_events(spark, f"{sf_dir}/events.parquet*").selectExpr("user_id", "event_id", "ts", f"{VERDICT} as verdict")
    return stream.run_available(stream.remembered(e, "user_id"))


SQL["stream_followup_state"] = f"""with v as (select user_id, ts, {VERDICT} as verdict from events where {VERDICT} is not null)
 select e.user_id, e.event_id, e.ts, case when epoch_us(e.ts) - epoch_us(v.ts) <= 3600000000 then v.verdict end as remembered
 from events e asof left join v on e.user_id = v.user_id and e.ts > v.ts"""

#: Survey rows made from customers, some broken. (Fixed values, in both engines.)
_K = "c_custkey"
SURVEY = {
    "id": f"case when {_K} % 50 = 7 then 'S-001' when {_K} % 50 = 8 then 'X1' else concat('S-', lpad(cast({_K} as string), 9, '0')) end",
    "line": f"{_K} + 2",
    "date": f"case when {_K} % 41 = 3 then '2024-02-30' when {_K} % 41 = 4 then '2031-01-01' else concat('2024-03-', lpad(cast(1 + {_K} % 28 as string), 2, '0')) end",
    "surveyor": f"case when {_K} % 43 = 1 then 'A' else 'AB' end",
    "area": f"case when {_K} % 37 = 5 then '12 Main Road' else 'Ward East' end",
    "respondent_type": f"case when {_K} % 3 = 0 then 'shop' else 'household' end",
    "age_band": f"case {_K} % 5 when 0 then '18-29' when 1 then '30-44' when 2 then '45-59' else '60+' end",
    "gender": f"case {_K} % 4 when 0 then 'f' when 1 then 'm' when 2 then 'o' else 'na' end",
    "education": f"case when {_K} % 61 = 2 then 'phd' when {_K} % 2 = 0 then 'none' else 'primary' end",
    "occupation": f"case {_K} % 3 when 0 then 'farm' when 1 then 'shop' else 'other' end",
    "language": f"case {_K} % 500 when 0 then 'ur' when 1 then 'hi' else case when c_acctbal > 4000 then 'te' else 'en' end end",
    "phone": f"case {_K} % 4 when 0 then 'keypad' when 1 then 'none' else 'smartphone' end",
    "uses_upi": "case when c_acctbal > 2000 then 'y' else 'n' end",
    "suspicious_contact": f"case when {_K} % 9 < 4 then 'y' else 'n' end",
    "lost_money": f"case when {_K} % 7 = 0 then 'y' else 'n' end",
    "amount_band": f"case when {_K} % 7 = 0 and {_K} % 11 > 0 then '1k_10k' else 'none' end",
    "reported_to": f"case when {_K} % 7 > 0 then 'na' when {_K} % 2 = 0 then 'bank' else 'none' end",
    "reported_when": f"case when {_K} % 7 > 0 then case when {_K} % 53 = 1 then 'later' else 'na' end when {_K} % 2 = 0 then 'later' when {_K} % 5 = 0 then 'same_day' else 'never' end",
    "family_victim": f"case when {_K} % 8 = 0 then 'y' else 'n' end",
    "channel": "case c_mktsegment when 'BUILDING' then 'poster' when 'AUTOMOBILE' then 'video' when 'MACHINERY' then 'school' else 'other' end",
    "consent_verbal": f"case when {_K} % 71 = 6 then 'n' else 'y' end",
    "talk_given": f"case when {_K} % 3 = 1 then 'n' else 'y' end",
    **{f"pre_q{i}": f"case when {_K} % 97 = {i} then '' when ({_K} * {2 * i + 3}) % 10 < {3 + i} then '1' else '0' end" for i in range(1, 6)},
    **{f"post_q{i}": f"case when {_K} % 3 = 1 then '' when {_K} % 101 = {i} then '2' when ({_K} * {2 * i + 5}) % 10 < {5 + i % 3} then '1' else '0' end" for i in range(1, 6)},
}
ROWS = "rows_ as (select " + ", ".join(f"{e} as {c}" for c, e in SURVEY.items()) + " from customer)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {c}" for c, e in SURVEY.items()])


TODAY = "2030-12-31"


def survey_validate(spark, sf_dir):
    return survey.row_errors(answers(spark, sf_dir), TODAY).select("line", "id", "errors")


def _rules_sql() -> str:
    rules = ["case when not regexp_full_match(id, 'S-[0-9]{3,}') then 'id' end", "case when regexp_full_match(id, 'S-[0-9]{3,}') and line > min(line) over (partition by id) then 'repeat' end"]
    rules += [f"case when try_strptime(date, '%Y-%m-%d') is null or date > '{TODAY}' then 'date' end", "case when not regexp_full_match(surveyor, '[A-Za-z]{2,4}') then 'surveyor' end"]
    rules += ["case when not regexp_full_match(area, '[A-Za-z][A-Za-z .-]{1,38}') then 'area' end"]
    rules += [f"case when {c} not in ({', '.join(repr(v) for v in vs)}) then '{c}' end" for c, vs in survey.ALLOWED.items()]
    rules += ["case when consent_verbal <> 'y' then 'consent' end", *[f"case when pre_q{i} not in ('0', '1') then 'pre_q{i}' end" for i in range(1, 6)]]
    rules += [f"case when (talk_given = 'y' and post_q{i} not in ('0', '1')) or (talk_given <> 'y' and post_q{i} <> '') then 'post_q{i}' end" for i in range(1, 6)]
    rules += ["case when lost_money = 'y' and (amount_band = 'none' or reported_to = 'na' or reported_when = 'na') then 'loss_unfilled' end"]
    rules += ["case when lost_money = 'n' and (amount_band <> 'none' or reported_to <> 'na' or reported_when <> 'na') then 'loss_filled' end"]
    rules += ["case when reported_to = 'none' and reported_when <> 'never' then 'never_reported' end"]
    return ", ".join(rules)


SQL["survey_validate"] = f"with {ROWS} select line, id, concat_ws(';', {_rules_sql()}) as errors from rows_"


def survey_summary(spark, sf_dir):
    return survey.summary(answers(spark, sf_dir))


MEASURES = {"smartphone": "phone = 'smartphone'", "uses_upi": "uses_upi = 'y'", "suspicious_contact": "suspicious_contact = 'y'", "lost_money": "lost_money = 'y'", "family_victim": "family_victim = 'y'", "knows_helpline": "pre_q4 = '1'"}
_Z = 1.96
SQL["survey_summary"] = f"""with {ROWS}, m as ({' union all '.join(f"select '{m}' as measure, count(*) filter (where {c})::double as k, count(*)::double as n from rows_" for m, c in MEASURES.items())})
 select measure, k::bigint as k, n::bigint as n, round(k / n, 6) as value, {', '.join(f"round(greatest(0, least(1, (k / n + {_Z} * {_Z} / (2 * n) {s} {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n))), 6) as {e}" for s, e in (('-', 'lo'), ('+', 'hi')))} from m"""
COUNTED = ["respondent_type", "language", "channel", "amount_band", "reported_to", "reported_when"]


def survey_distributions(spark, sf_dir):
    return survey.distributions(answers(spark, sf_dir), COUNTED)


SQL["survey_distributions"] = f"""with {ROWS}, d as ({' union all '.join(f"select '{c}' as measure, {c} as value, count(*) as n from rows_ group by {c}" for c in COUNTED)})
 select *, case when n between 1 and 4 then '<5' else n::varchar end as shown from d"""


def awareness_gain(spark, sf_dir):
    return survey.gain(answers(spark, sf_dir))


SQL["awareness_gain"] = f"""with {ROWS}, g as ({' union all '.join(f"select 'q{i}' as question, count(*) as n, count(*) filter (where pre_q{i} = '1') as right_before, count(*) filter (where post_q{i} = '1') as right_after, count(*) filter (where pre_q{i} <> '1' and post_q{i} = '1') as learned, count(*) filter (where pre_q{i} = '1' and post_q{i} <> '1') as slipped from rows_ where talk_given = 'y'" for i in range(1, 6))})
 select *, round(case when learned + slipped = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(learned, slipped) + 1), lambda i: exp(lgamma(learned + slipped + 1.0::double) - lgamma(i + 1.0::double) - lgamma(learned + slipped - i + 1.0::double) - (learned + slipped) * ln(2.0::double))))) end, 6) as p from g"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed")).withColumns(
        {"open": F.col("orders") - F.col("closed") + F.when(F.col("o_orderpriority").startswith("3"), 1).otherwise(0), "share": F.col("closed") / F.col("orders")}
    )


def derived_stats(spark, sf_dir):
    """Figures of each order priority beside their formulas; one is stored wrong on purpose."""
    return facts.check_derived(figures(spark, sf_dir), ["o_orderpriority"], {"open": "orders - closed", "share": "closed / orders"}).select("o_orderpriority", "figure", F.round("stored", 6).alias("stored"), F.round("computed", 6).alias("computed"), "agrees")


SQL["derived_stats"] = """with f as (select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus = 'F') as c from orders group by 1)
 select o_orderpriority, 'open' as figure, (n - c + case when o_orderpriority[1:1] = '3' then 1 else 0 end)::double as stored, (n - c)::double as computed, o_orderpriority[1:1] <> '3' as agrees from f
 union all select o_orderpriority, 'share', round(c::double / n, 6), round(c::double / n, 6), true from f"""


def contiguous_days(spark, sf_dir):
    """Months of orders as periods: each must begin on the day after the last one's end."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.to_date(F.min("o_orderdate")).alias("begin"), F.to_date(F.max("o_orderdate")).alias("end"), F.dayofmonth(F.last_day(F.max("o_orderdate"))).cast("long").alias("days"))
    numbered = months.select(((F.year("m") - 1990) * 12 + F.month("m")).cast("long").alias("n"), "begin", "end", "days")
    return facts.check_periods(numbered, "n", "begin", "end", "days").select("n", F.date_format("begin", "yyyy-MM-dd").alias("begin"), F.date_format("end", "yyyy-MM-dd").alias("ended"), "days", "problems")


SQL["contiguous_days"] = """with m as (select (year(o_orderdate) - 1990) * 12 + month(o_orderdate) as n, min(o_orderdate)::date as b, max(o_orderdate)::date as e, day(last_day(max(o_orderdate))) as days from orders group by 1)
 select n, strftime(b, '%Y-%m-%d') as begin, strftime(e, '%Y-%m-%d') as ended, days, concat_ws(';', case when n <> row_number() over (order by n) then 'number' end,
 case when date_diff('day', b, e) + 1 <> days then 'days' end, case when date_diff('day', lag(e) over (order by n), b) <> 1 then 'gap' end) as problems from m"""


def indian_format(spark, sf_dir):
    n = (F.floor(F.col("c_acctbal")) * F.pow(F.lit(10), F.col("c_custkey") % 6)).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", n.alias("n")).select("c_custkey", formats.indian(F.col("n")).alias("grouped"), formats.rupees_compact(F.abs("n")).alias("compact"), formats.counter(F.abs("n")).alias("counter"))


def _grouped_sql(n: str) -> str:
    s = f"(abs({n})::varchar)"
    return f"case when length({s}) > 3 then regexp_replace(reverse(regexp_replace(reverse({s}[:-4]), '([0-9]{{2}})', '\\1,', 'g')), '^,', '') || ',' || {s}[-3:] else {s} end"


def _hundredths_sql(n: str, unit: int) -> str:
    h = f"((2 * {n} * 100 + {unit}) // (2 * {unit}))"
    return f"printf('%d.%02d', {h} // 100, {h} % 100)"


_COUNTER = f"case when a >= 10000000 then {_hundredths_sql('a', 10000000)} || ' Cr' when a >= 100000 then {_hundredths_sql('a', 100000)} || ' Lakh' else {_grouped_sql('a')} end"
SQL["indian_format"] = f"""with v as (select c_custkey, (floor(c_acctbal) * pow(10, c_custkey % 6))::bigint as n, abs((floor(c_acctbal) * pow(10, c_custkey % 6))::bigint) as a from customer)
 select c_custkey, case when n < 0 then '-' else '' end || {_grouped_sql('n')} as grouped, '₹' || {_COUNTER} as compact, {_COUNTER} as counter from v"""


def order_dates(spark, sf_dir):
    """Days written out, and clock times."""
    o = table(spark, sf_dir, "orders")
    hhmm = F.format_string("%02d:%02d", F.col("o_orderkey") % 25, F.col("o_orderkey") % 60)
    return o.select("o_orderkey", formats.long_date(F.col("o_orderdate")).alias("long_date"), formats.weekday(F.col("o_orderdate")).alias("weekday"), formats.clock(hhmm).alias("clock"))


SQL["order_dates"] = """select o_orderkey, strftime(o_orderdate, '%-d %B %Y') as long_date, strftime(o_orderdate, '%A') as weekday,
 case when o_orderkey % 25 < 24 then printf('%d:%02d %s', case when o_orderkey % 25 % 12 = 0 then 12 else o_orderkey % 25 % 12 end, o_orderkey % 60, case when o_orderkey % 25 < 12 then 'am' else 'pm' end) end as clock from orders"""


def image_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * (1 + F.col("p_partkey") % 400)).alias("w"), (F.col("p_size") * (1 + F.col("p_partkey") % 311)).alias("h"))
    return p.select("p_partkey", pictures.plan(F.col("w"), F.col("h")).alias("x")).select("p_partkey", "x.refused", F.round("x.scale", 9).alias("scale"), "x.width", "x.height", "x.shrunk")


SQL["image_plan"] = """with p as (select p_partkey, (p_size * (1 + p_partkey % 400))::double as w, (p_size * (1 + p_partkey % 311))::double as h from part),
 s as (select *, least(1.0::double, 2600 / greatest(w, h), sqrt(2800000 / (w * h))) as s, w * h > 150000000 as refused from p)
 select p_partkey, refused, case when refused then 0 else round(s, 9) end as scale, (case when refused then w else greatest(1, floor(w * s + 0.5)) end)::bigint as width,
 (case when refused then h else greatest(1, floor(h * s + 0.5)) end)::bigint as height, not refused and s < 1 as shrunk from s"""
RUNS = ["p_size", "p_size + p_partkey % 3", "p_size * 3 - p_partkey % 5", "p_size", "p_size + p_partkey % 2"]


def finder_ratio(spark, sf_dir):
    runs = [F.expr(r).cast("double") for r in RUNS]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(pictures.finder_module(runs), 6).alias("module"), F.round(pictures.finder_module(runs, True), 6).alias("strict"))


def _finder_sql(thin: float, middle: float) -> str:
    near = " and ".join(f"abs(r{i} - m * {3 if i == 2 else 1}) < m * {middle if i == 2 else thin}" for i in range(5))
    return f"case when 7 * m >= 7 and {near} then round(m, 6) else 0 end"


SQL["finder_ratio"] = f"""with r as (select p_partkey, {', '.join(f'({e})::double as r{i}' for i, e in enumerate(RUNS))} from part), t as (select *, (r0 + r1 + r2 + r3 + r4) / 7 as m from r)
 select p_partkey, {_finder_sql(0.55, 1.25)} as module, {_finder_sql(0.5, 0.8)} as strict from t"""


def speech_chunks(spark, sf_dir):
    return speech.chunks(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", F.size("chunks").alias("n"), F.array_join("chunks", "|").alias("chunks"))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of the test side with a trained model's score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rows = training.hashed(docs, F.col("text")).withColumn("side", split(F.col("doc_id").cast("string"), "ml"))
    model = training.fit(rows.where("side = 'train'"), F.col("quality"))
    return training.scored(rows.where("side = 'test'"), model)


def ml_text_lr(spark, sf_dir):
    """A logistic model's AUC on documents it did not learn from."""
    return stats.auc(held_out(spark, sf_dir), F.col("score"), F.col("quality") == 1)


def bootstrap_auc(spark, sf_dir):
    """How the length's AUC spreads over 200 resamples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    each = training.bootstrap_auc(docs, F.col("doc_id"), F.col("n_chars"), F.col("quality") == 0)
    return each.agg(F.count("auc").alias("reps"), F.percentile("auc", F.lit(0.025)).alias("lo"), F.avg("auc").alias("mean"), F.percentile("auc", F.lit(0.975)).alias("hi"))


def cross_validation(spark, sf_dir):
    """A naive Bayes model of quality at two margins, over five folds; rows nearly equal to another fold's are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    base = selection.prepared(docs, "doc_id", F.col("text"), F.col("quality") == 1, "cv")
    return selection.cross_validate(base, [0.8, 0.9], near=selection.leaked_digests(base))


def series_points(spark, sf_dir):
    """Figures that the points of a series refer to: customers by nation, of which some do not exist."""
    points = table(spark, sf_dir, "customer").selectExpr("c_custkey as point", "c_custkey % 40 as key")
    figures = table(spark, sf_dir, "nation").selectExpr("n_nationkey as key", "n_name as value")
    return facts.resolve_points(points, figures, "key", "value")


SQL["series_points"] = "select c_custkey as point, c_custkey % 40 as key, n_name as value, n_nationkey is null as missing from customer left join nation on n_nationkey = c_custkey % 40"


QUERIES = {f.__name__: f for f in (
    ops_summary, top_rules, flagged_share, ring_buffer, ops_latency, verdict_sessions, stream_ops_windows, stream_followup_state, survey_validate, survey_summary, survey_distributions, awareness_gain,
    derived_stats, contiguous_days, indian_format, order_dates, image_plan, finder_ratio, speech_chunks, ml_text_lr, bootstrap_auc, cross_validation, series_points,
)}
