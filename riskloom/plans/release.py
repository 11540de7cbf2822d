"""Queries on detectors, benchmark runs, lineage, policy, the label store in SQL, dialogue graphs and damaged events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import registry
from ..functions.text import dedup_key
from ..operators import assistant, benchmark, detectors, evaluate, lineage, selection
from ..session import shared_folder, written
from ..sources.tables import table
from ..streaming import activity as stream
from . import datasets, evaluation, links, messages

#: Which of the planted utterances are frauds, by place (from 0).
FRAUDS = [1, 2, 4, 5, 6, 7, 8, 9, 10, 15, 16, 17, 20, 21, 22, 23, 24, 26, 27, 28, 29, 30, 31, 33, 34]


def flagged_turns(spark, sf_dir):
    """All turns with every detector's flag, by their texts' beginnings, and whether they are frauds: planted ones of FRAUDS."""
    t = messages.turns(spark, sf_dir).withColumn("begins", messages.beginning(F.col("text")))
    n = messages.PLANTED
    place = (F.col("conv_id") * 7 + (F.col("turn") - n) * 3) % len(messages.OPENINGS)
    return detectors.flags(t, "text", "begins").withColumn("fraud", (F.col("turn") >= n) & place.isin(*FRAUDS))


def detector_flags(spark, sf_dir):
    return detectors.flags(messages.turns(spark, sf_dir), "text").select("conv_id", "turn", *detectors.NAMES)


def detector_rates(spark, sf_dir):
    return detectors.rated(flagged_turns(spark, sf_dir), "fraud")


def detector_comparison(spark, sf_dir):
    """Each detector against the router of keywords."""
    return detectors.against(flagged_turns(spark, sf_dir), "fraud", "router")


def release_report(spark, sf_dir):
    """One call from a detector to the gate's decision, with the exit status that it means."""
    got = detectors.released(flagged_turns(spark, sf_dir), "fraud", "message_flagged", "router", 3.0)
    return got.select("detector", "tp", "fp", "fn", "tn", "recall", "fpr", "point", "conservative", "better", "p", "status", lineage.exit_status(F.col("status")).alias("exit"), lineage.exit_status(F.col("status"), report=True, strict=True).alias("exit_strict_report"))


FRAUD = f"turn >= {messages.PLANTED} and (conv_id * 7 + (turn - {messages.PLANTED}) * 3) % {len(messages.OPENINGS)} in ({', '.join(map(str, FRAUDS))})"
FLAGGED = f"""a as (select * from ({messages.BEGUN_VERDICT})), b as (select * from ({messages.SQL['intent_top1']})), c as (select conv_id, turn, link_level from ({messages.SQL['message_link_verdict']})),
 fl as (select conv_id, turn, {FRAUD} as fraud, true as "always", false as never, intent is not null as router, level <> 'nothing' as message_flagged, level = 'scam' as message_scam, coalesce(link_level in ('scam', 'suspicious'), false) as link_lenient, coalesce(link_level = 'scam', false) as link_strict,
  level <> 'nothing' or coalesce(link_level in ('scam', 'suspicious'), false) as either, level <> 'nothing' and coalesce(link_level in ('scam', 'suspicious'), false) as "both" from a join b using (conv_id, turn) join c using (conv_id, turn))"""
NAMED = ", ".join(f"{{'detector': '{n}', 'flagged': \"{n}\"}}" for n in detectors.NAMES)
RATED = f"{FLAGGED}, ro as (select fraud, unnest([{NAMED}]) as r from fl), cn as (select r.detector as detector, count(*) filter (where r.flagged and fraud) as tp, count(*) filter (where r.flagged and not fraud) as fp, count(*) filter (where not r.flagged and fraud) as fn, count(*) filter (where not r.flagged and not fraud) as tn from ro group by 1)"
MCNEMAR = "case when candidate_only + baseline_only = 0 then 1.0 else round(least(1.0, 2 * (select sum(exp(lgamma(candidate_only + baseline_only + 1) - lgamma(i + 1) - lgamma(candidate_only + baseline_only - i + 1) - (candidate_only + baseline_only) * ln(2))) from range(0, least(candidate_only, baseline_only) + 1) t(i))), 6) end"
AGAINST = f"ag as (select r.detector as detector, count(*) filter (where r.flagged = fraud and router <> fraud) as candidate_only, count(*) filter (where r.flagged <> fraud and router = fraud) as baseline_only from (select fraud, router, unnest([{NAMED}]) as r from fl) where r.detector <> 'router' group by 1)"


def table_lineage(spark, sf_dir):
    """Fingerprints of tables by their rows, whatever their order."""
    own = {k: table(spark, sf_dir, k) for k in ("nation", "region", "conversations", "labels", "benchmark", "pages")}
    return lineage.record(own, {"policy": evaluate.POLICY}).where("rows is not null")


def digest_sql(name: str, columns: list[str]) -> str:
    text = " || chr(31) || ".join(f"'{c}=' || coalesce({c}::varchar, chr(0))" for c in sorted(columns))
    part = lambda i: f"sum(('0x' || substr(d, {1 + 12 * i}, 12))::hugeint)::varchar"
    return f"select '{name}' as name, count(*) as rows, sha256(concat_ws(':', count(*)::varchar, {', '.join(part(i) for i in range(4))})) as digest from (select sha256({text}) as d from {name})"


#: A policy for each supplier: numbers from its row, of which some are no good. (Fixed values, in both engines.)
POLICIES = {
    "least_precision": "case when s_suppkey % 7 = 0 then '0.9' else cast(s_suppkey % 5 as string) end", "prevalence": "case when s_suppkey % 3 = 0 then 'one in ten' else '0.01' end", "regression_alpha": "case when s_suppkey % 11 <> 0 then '0.05' end",
    "near_jaccard": "'0.85'", "most_p95_ms": "cast(s_suppkey % 4 * 10 as string)", "most_model_bytes": "'250000'", "colour": "case when s_suppkey % 13 = 0 then '1' end",
}


def policy_violations(spark, sf_dir):
    """Every field of each supplier's policy that the gate could not work with."""
    rows = F.array(*[F.struct(F.lit(k).alias("field"), F.expr(v).alias("value")) for k, v in POLICIES.items()])
    given = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(rows).alias("p")).select("s_suppkey", "p.*").where("value is not null")
    return lineage.policy_problems(given, ["s_suppkey"])


def gate_exit(spark, sf_dir):
    """Exit statuses of each slice's decision: plain, as a report, and strict."""
    g = evaluation.gate_status(spark, sf_dir)
    return g.select("slice_dim", "slice_value", "status", *[lineage.exit_status(F.col("status"), report, strict).alias(name) for name, report, strict in (("plain", False, False), ("report", True, False), ("strict", False, True))])


def kappa_in_sql(spark, sf_dir):
    """Cohen's kappa of each pair of annotators by the SQL function."""
    registry.register_label_store(spark, *datasets.store(spark, sf_dir), prefix="rl_")
    pairs = " union all ".join(f"select '{a}' as a, '{b}' as b, round(rl_cohen_kappa('{a}', '{b}'), 6) as kappa" for a, b in (("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("a1", "nobody")))
    return spark.sql(pairs)


def export_rows_in_sql(spark, sf_dir):
    """The settled rows of the stage by the SQL table function."""
    registry.register_label_store(spark, *datasets.store(spark, sf_dir), prefix="rl_")
    return spark.sql("select * from rl_export_rows('s1')")


def pii_check_in_sql(spark, sf_dir):
    """What masked texts must not hold, by the SQL function."""
    registry.register_functions(spark)
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "array_join(pii_check(text), ',') as problems")


#: A dialogue graph of the conversations: a flow for each remainder of conversation ids; from a turn's node to the next turn's.
NODE = "concat('n', cast((conv_id * 31 + turn * turn * 7) % 23 as string))"


def dialogue_reach(spark, sf_dir):
    """Nodes that each flow's start leads to, and in how many steps; other nodes are unreachable, and circles end."""
    t = table(spark, sf_dir, "conversations").selectExpr("conv_id", "conv_id % 29 as flow", "turn", f"{NODE} as node")
    nxt = t.selectExpr("conv_id", "turn - 1 as turn", "node as next")
    return assistant.reachable(t.join(nxt, ["conv_id", "turn"], "left").select("flow", "node", "next"), "n0")


#: Lines of JSON made from events, some of them damaged. (Fixed values, in both engines.)
WHOLE = """concat('{"event_id": ', cast(event_id as string), ', "ts": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '", "event_type": "', event_type, '", "value": 1.5}')"""
DAMAGE = f"case event_id % 19 when 3 then substring({WHOLE}, 1, 30) when 5 then 'no json' when 7 then replace({WHOLE}, concat('\"event_id\": ', cast(event_id as string), ', '), '') when 9 then replace({WHOLE}, '1.5', '\"x\"') when 11 then '' else {WHOLE} end"


def lines_of(spark, sf_dir):
    return stream.read_events(spark, f"{sf_dir}/events.parquet*").selectExpr(f"{DAMAGE} as line")


def stream_good_events(spark, sf_dir):
    """Events that a stream of lines gives although others are damaged."""
    events, _ = stream.run_with_dead_letters(lines_of(spark, sf_dir))
    return events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", "value")


def stream_damaged_events(spark, sf_dir):
    """The damaged lines, counted as they came."""
    _, damaged = stream.run_with_dead_letters(lines_of(spark, sf_dir))
    return damaged.groupBy("line").agg(F.count("*").alias("n"))


def benchmark_run(spark, sf_dir):
    """Candidates by margins over the labelled documents, cross-validated together, and the winner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    base = selection.prepared(docs, "doc_id", F.col("text"), F.col("quality") == 0, "bench")
    told, _ = benchmark.run(base, written(selection.leaked_digests(base)), f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}", margins=MARGINS, policy={"least_precision": 0.5})
    return told


BROKEN = "event_id % 19 in (3, 5, 7, 9, 11)"
DUCK_LINE = """'{"event_id": ' || event_id || ', "ts": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '", "event_type": "' || event_type || '", "value": 1.5}'"""
SHARE = datasets.SHARE
CANDIDATES = {
    "words": "list_distinct(regexp_extract_all(lower(t), '[a-z]{2,}'))", "words_flags": datasets.FEATURES.replace("text", "t"),
    "trigrams": "list_distinct(list_transform(range(1, greatest(1, length(t) - 1)), lambda i: substr(lower(t), i, 3)))",
    "words_trigrams": "list_concat(list_distinct(regexp_extract_all(lower(t), '[a-z]{2,}')), list_distinct(list_transform(range(1, greatest(1, length(t) - 1)), lambda i: '~' || substr(lower(t), i, 3))))",
}
def validated(seed: str, positive: str, candidates: dict[str, str], margins: tuple[float, ...]) -> str:
    """Steps from the labelled documents to each candidate's confusion by margin and fold (pe): keys, folds, near-equal keys of other
    folds, features, weights of the models that have not seen a fold, scores as counts, thresholds."""
    return f"""ba as materialized (select d.doc_id as id, {datasets.KEY.format('text')} as key, text as t, {positive} as y from documents d join labels l on d.doc_id = l.doc_id where text is not null),
 bs as materialized (select *, floor({SHARE.format(salt=f'{seed}|cv', key='key')} * 5)::int as fold, {SHARE.format(salt=f'{seed}|inner', key='key')} < 0.25 as inn from ba),
 ks as (select distinct key, fold, {datasets.TOKENS.format('key')} as tk from bs), ke as materialized (select key, fold, len(tk) as n, unnest(tk) as w from ks where len(tk) >= 4),
 pr as (select a.key as x, b.key as z, any_value(a.fold) as fx, any_value(b.fold) as fz, any_value(a.n) as na, any_value(b.n) as nb, count(*) as same from ke a join ke b on a.w = b.w and a.key < b.key group by 1, 2),
 nr as (select unnest([x, z]) as key from pr where fx <> fz and same / (na + nb - same)::double >= 0.85),
 fe as materialized (select id, y, fold, inn, candidate, unnest(f) as feature from ({' union all '.join(f"select id, y, fold, inn, '{k}' as candidate, {v} as f from bs" for k, v in candidates.items())})),
 tt as (select f, count(*) filter (where y) as p, count(*) filter (where not y) as n from bs, range(5) r(f) where fold <> f and not inn group by 1),
 wt as (select candidate, f, feature, round(ln((count(*) filter (where y) + 1) / (any_value(p) + 2)::double) - ln((count(*) filter (where not y) + 1) / (any_value(n) + 2)::double), 3) as w from fe join tt on tt.f <> fe.fold where not inn group by 1, 2, 3 having count(*) >= 5),
 asked as (select id, y, fold as f, true as held from bs where key not in (select key from nr) union all select id, y, f, false from bs, range(5) r(f) where inn and f <> fold),
 sm as (select fe.id, fe.candidate, wt.f, sum(w) as s from fe join wt on wt.candidate = fe.candidate and wt.feature = fe.feature and (fe.inn or wt.f = fe.fold) group by 1, 2, 3),
 sc as (select a.id, a.y, a.f, a.held, c.candidate, round(coalesce(s, 0), 3) as s from asked a cross join (select unnest([{', '.join(repr(k) for k in candidates)}]) as candidate) c left join sm on sm.id = a.id and sm.candidate = c.candidate and sm.f = a.f),
 at1 as (select candidate, f, held, s, count(*) filter (where y) as p, count(*) filter (where not y) as n from sc group by 1, 2, 3, 4),
 rn as (select candidate, f, s, sum(p) over o as tp, sum(n) over o as fp from at1 where not held window o as (partition by candidate, f order by s desc rows between unbounded preceding and current row)),
 pk as (select candidate, margin, f, arg_max(s, tp * 1000000 + s) as threshold from (select *, {evaluation.wilson_sql('tp', 'tp + fp', 'lo').replace('round(', '(').replace(', 6)', ')')} as lo from rn), (values {', '.join(f'({m}::double)' for m in margins)}) m(margin) where lo >= margin group by 1, 2, 3),
 pe as (select a.candidate, margin, a.f, sum(case when s >= threshold then p else 0 end) as tp, sum(case when s >= threshold then n else 0 end) as fp, sum(case when s < threshold then p else 0 end) as fn, sum(case when s < threshold then n else 0 end) as tn from at1 a join pk on pk.candidate = a.candidate and pk.f = a.f where held group by 1, 2, 3)"""


MARGINS = (0.6, 0.8)
BENCHMARK = f"""with {validated('bench', 'quality = 0', CANDIDATES, MARGINS)}, sz as (select candidate, sum(strlen(feature) + 4)::bigint as bytes from (select candidate, feature from fe group by 1, 2 having count(*) >= 5) group by 1),
 po as (select candidate, margin, coalesce(sum(tp), 0)::bigint as tp, coalesce(sum(fp), 0)::bigint as fp, coalesce(sum(fn), 0)::bigint as fn, coalesce(sum(tn), 0)::bigint as tn, round(min(case when tp + fp > 0 then tp / (tp + fp)::double end), 6) as least_precision, round(max(case when tp + fp > 0 then tp / (tp + fp)::double end), 6) as most_precision, 5 - count(f) as without_threshold from (select distinct candidate from at1) cross join (values {', '.join(f'({m}::double)' for m in MARGINS)}) m(margin) left join pe using (candidate, margin) group by 1, 2),
 ra as ({evaluation.rates_sql('po', 'candidate, margin, least_precision, most_precision, without_threshold')}), rk as (select ra.*, bytes, bytes > 250000 as over_budget from ra join sz using (candidate))
 select *, coalesce(candidate || '@' || margin = (select candidate || '@' || margin from rk where not over_budget and tp + fp > 0 and precision_lo >= 0.5 order by recall desc, bytes, candidate || '@' || margin limit 1), false) as winner from rk"""

SQL = {
    "detector_flags": messages.whole(f"with {FLAGGED} select conv_id, turn, \"always\", never, router, message_flagged, message_scam, link_lenient, link_strict, either, \"both\" from fl"),
    "detector_rates": f"with {RATED} {evaluation.rates_sql('cn', 'detector')}",
    "detector_comparison": f"with {FLAGGED}, {AGAINST} select detector, candidate_only, baseline_only, candidate_only - baseline_only as better, {MCNEMAR} as p from ag",
    "release_report": f"""with {RATED}, {AGAINST}, rt as ({evaluation.rates_sql('cn', 'detector')}), at1 as (select *, {evaluation.at_sql('recall', 'fpr', '0.01')} as point, {evaluation.at_sql('recall_lo', 'fpr_hi', '0.01')} as conservative from rt where detector = 'message_flagged'),
 v as (select *, {evaluation.VERDICT} as verdict from at1), s as (select v.*, candidate_only - baseline_only as better, {MCNEMAR} as p from v join ag using (detector)),
 d as (select *, case when tp + fp + fn + tn < 100 then 'NO_EVIDENCE' when flags_nothing or tp = 0 or verdict = 'failed' or (better < 0 and p < 0.05) then 'FAIL' when verdict = 'unproven' then 'INCONCLUSIVE' else 'PASS' end as status from s)
 select detector, tp, fp, fn, tn, recall, fpr, point, conservative, better, p, status, case status when 'PASS' then 0 when 'INCONCLUSIVE' then 0 else 1 end as "exit", case status when 'PASS' then 0 when 'NO_EVIDENCE' then 0 else 1 end as exit_strict_report from d""",
    "policy_violations": f"""with g as (select s_suppkey, unnest([{', '.join(f"{{'field': '{k}', 'value': {v.replace('as string', 'as varchar')}}}" for k, v in POLICIES.items())}]) as p from supplier), v as (select s_suppkey, p.field as field, p.value as value from g where p.value is not null),
 b as (select * from (values ('least_precision', 1.0), ('prevalence', 1.0), ('regression_alpha', 1.0), ('near_jaccard', 1.0), ('most_p95_ms', null), ('most_model_bytes', null)) x(field, high)),
 t as (select s.s_suppkey, b.field, b.high, v.value, try_cast(v.value as double) as n from (select distinct s_suppkey from v) s cross join b left join v on v.s_suppkey = s.s_suppkey and v.field = b.field)
 select s_suppkey, field, case when value is null then 'missing' when n is null then 'not a number' else 'out of bounds' end as problem from t where value is null or n is null or n <= 0 or n >= high union all select s_suppkey, field, 'unknown' from v where field not in (select field from b)""",
    "gate_exit": f"select slice_dim, slice_value, status, case when status in ('PASS', 'INCONCLUSIVE') then 0 else 1 end as plain, case when status = 'FAIL' then 1 else 0 end as report, case when status = 'PASS' then 0 else 1 end as strict from ({evaluation.SQL['gate_status']})",
    "kappa_in_sql": f"""with {datasets.STORE}, w as (select * from (values ('a1', 'a2'), ('a1', 'a3'), ('a2', 'a3'), ('a1', 'nobody')) v(a, b)), p as (select w.a, w.b, x.is_scam as x, y.is_scam as y from w left join lab x on x.annotator_id = w.a left join lab y on y.annotator_id = w.b and y.message_id = x.message_id),
 c as (select a, b, count(y) as n, count(*) filter (where x = y)::double / nullif(count(y), 0) as po, (count(*) filter (where x and y is not null) * count(*) filter (where y) + count(*) filter (where not x and y is not null) * count(*) filter (where not y))::double / nullif(count(y) * count(y), 0) as pe from p group by 1, 2) select a, b, case when pe < 1 then round((po - pe) / (1 - pe), 6) end as kappa from c""",
    "export_rows_in_sql": datasets.SQL["export_rows"],
    "pii_check_in_sql": f"select doc_id, array_to_string(list_filter([{', '.join(f'''case when {v} then '{k}' end''' for k, v in datasets.flag_sql('text').items())}], lambda x: x is not null), ',') as problems from documents",
    "dialogue_reach": f"""with recursive t as (select conv_id, conv_id % 29 as flow, turn, {NODE.replace('as string', 'as varchar')} as node from conversations), e as (select distinct a.flow, a.node, b.node as next from t a join t b on b.conv_id = a.conv_id and b.turn = a.turn + 1),
 w as (select distinct flow, node, 0 as steps from t where node = 'n0' union select w.flow, e.next, w.steps + 1 from w join e on e.flow = w.flow and e.node = w.node where w.steps < 23) select flow, node, min(steps) as steps from w group by 1, 2""",
    "stream_good_events": f"select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, event_type, 1.5::double as value from events where not ({BROKEN})",
    "stream_damaged_events": f"""with l as (select case event_id % 19 when 3 then substr({DUCK_LINE}, 1, 30) when 5 then 'no json' when 7 then replace({DUCK_LINE}, '"event_id": ' || event_id || ', ', '') when 9 then replace({DUCK_LINE}, '1.5', '"x"') else '' end as line from events where {BROKEN}) select line, count(*) as n from l group by 1""",
    "benchmark_run": BENCHMARK,
}
SQL["cross_validation"] = f"""with {validated('cv', 'quality = 1', {'words_flags': CANDIDATES['words_flags']}, (0.8, 0.9))}, po as (select margin, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tn)::bigint as tn, round(min(case when tp + fp > 0 then tp / (tp + fp)::double end), 6) as least_precision, round(max(case when tp + fp > 0 then tp / (tp + fp)::double end), 6) as most_precision, 5 - count(*) as without_threshold from pe group by 1)
 {evaluation.rates_sql('po', 'margin, least_precision, most_precision, without_threshold')}"""
SQL["link_share"] = f"with {datasets.OUTSIDE}, c as (select label, count(*) filter (where {messages.LINK('text')} <> '') as k, count(*) as n from o group by 1) select label, k, n, round(k::double / n, 6) as share, {evaluation.wilson_sql('k', 'n', 'lo')} as lo, {evaluation.wilson_sql('k', 'n', 'hi')} as hi from c"
QUERIES = {f.__name__: f for f in (
    detector_flags, detector_rates, detector_comparison, release_report, table_lineage, policy_violations, gate_exit, kappa_in_sql, export_rows_in_sql, pii_check_in_sql, dialogue_reach, stream_good_events, stream_damaged_events, benchmark_run,
)}
SQL["table_lineage"] = " union all ".join(digest_sql(k, cols) for k, cols in {
    "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "conversations": ["conv_id", "turn", "role", "text"], "labels": ["doc_id", "quality", "toxic"], "benchmark": ["item_id", "text"], "pages": ["page_id", "url", "html"],
}.items())
