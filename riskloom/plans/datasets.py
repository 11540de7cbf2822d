"""Queries on datasets: keys, privacy, validation, labels, leakage, splits, text model, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import dataset, labels, leakage, privacy, textmodel
from ..sources.tables import table

KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\[[^\]]*\]', '', 'g'), '[0-9]+', '#', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
TOKENS = "list_distinct(list_filter(string_split({}, ' '), lambda t: t <> ''))"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def dedup_key_groups(spark, sf_dir):
    keyed = leakage.keyed(docs(spark, sf_dir), "doc_id", "text")
    return keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first_id")).groupBy("size").agg(F.count("*").alias("groups"), F.sum("first_id").alias("ids"))


def dedup_first_line(spark, sf_dir):
    return dataset.dedup_groups(docs(spark, sf_dir), "doc_id", "text")


def conflict_groups(spark, sf_dir):
    """Keys whose labelled documents differ in quality, and the groups kept otherwise."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", text.dedup_key(F.col("text")).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("quality").alias("labels"), F.min("doc_id").alias("kept_id"))
    return groups.groupBy((F.col("labels") > 1).alias("conflict")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum("kept_id").alias("ids"))


def pii_flags(spark, sf_dir):
    flags = privacy.pii_flags(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in flags.items()])


def pii_in_conversations(spark, sf_dir):
    flags = privacy.pii_flags(F.col("text"))
    t = table(spark, sf_dir, "conversations").select("role", *[v.alias(k) for k, v in flags.items()])
    return t.groupBy("role").agg(*[F.count_if(k).alias(k) for k in flags])


def scrub_placeholders(spark, sf_dir):
    """Whole documents masked; what is left must hold no personal data that the flags know."""
    got = privacy.scrub(docs(spark, sf_dir).select("doc_id", "text"), "text")
    left = privacy.pii_flags(F.col("masked"))
    return got.select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.coalesce(F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n"), (left["digits"] | left["address"] | left["pan"]).alias("residual"))


def small_cells(spark, sf_dir):
    counts = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.select("lang", "source", privacy.small_cells(F.col("n")).alias("shown"))


ROMAN = ["aap", "aapka", "kripya", "turant", "jaldi", "paise", "khata", "hai", "hain", "karo", "namaste", "ji", "de", "la", "que", "en"]


def lang_suggest(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.suggest_language(F.col("text"), ROMAN).alias("suggested"))


def obfuscation_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.suggest_obfuscation(F.col("text")).alias("obfuscated"))


def text_features(spark, sf_dir):
    f = textmodel.features(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(f).alias("n"), F.array_join(F.array_sort(F.filter(f, lambda x: x.startswith("#"))), ",").alias("flags"))


def token_sets(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(text.token_set(text.dedup_key(F.col("text")))).alias("n_tokens"))


def holdout(spark, sf_dir):
    """Documents as rows of the labelled-message table, some of them broken in known ways."""
    i = F.col("doc_id")
    return docs(spark, sf_dir).select(
        i.alias("line"), F.when(i % 53 == 0, "bad id").when(i % 59 == 1, "m1").otherwise(F.concat(F.lit("m"), i.cast("string"))).alias("id"), F.col("text").alias("raw_text_scrubbed"),
        F.when(F.col("lang") == "en", "en").when(F.col("lang") == "fr", "hi").when(F.col("lang") == "de", "hinglish").otherwise(F.col("lang")).alias("language_tag"),
        (i % 3 % 2).cast("string").alias("is_scam"), F.when(i % 3 == 1, F.when(i % 41 == 1, "safe").otherwise("kyc_pan_block")).when(i % 43 == 0, "sim_swap").otherwise("safe").alias("attack_category"),
        F.when(F.col("source") == "src0", "sms").when(F.col("source") == "src1", "fax").otherwise("email").alias("source_platform"),
        F.concat(F.lit("2024-02-"), F.lpad((i % 31 + 1).cast("string"), 2, "0")).alias("date_received"), F.when(i % 5 == 0, "true").when(i % 61 == 1, "yes").otherwise("false").alias("contains_obfuscation"),
    )


def holdout_validate(spark, sf_dir):
    return dataset.row_errors(holdout(spark, sf_dir), "2024-02-20")


def stage_checks(spark, sf_dir):
    rows = holdout(spark, sf_dir)
    count = lambda c: rows.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(c, "n"))).alias("m"))
    one = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("attack_category") == "safe").alias("safe"), F.count_if(F.col("contains_obfuscation") == "true").alias("obfuscated"))
    stats = one.crossJoin(count("language_tag").withColumnRenamed("m", "language")).crossJoin(count("attack_category").withColumnRenamed("m", "category"))
    return dataset.stage_problems(stats, "s0").withColumn("stage", F.lit("s0")).unionByName(dataset.stage_problems(stats, "s1").withColumn("stage", F.lit("s1")))


def source_share(spark, sf_dir):
    return dataset.dominant_sources(holdout(spark, sf_dir), "source_platform").select("source_platform", "n", "rows")


def holdout_statistics(spark, sf_dir):
    return dataset.statistics(holdout(spark, sf_dir))


def outside(spark, sf_dir):
    """The labelled documents as an outside corpus of three classes."""
    d = docs(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    return d.withColumn("label", F.when(F.col("toxic") == 1, "smishing").when(F.col("quality") == 0, "spam").otherwise("ham"))


def external_rows(spark, sf_dir):
    return dataset.external(outside(spark, sf_dir), "doc_id", "text", "label", "smishing", ["spam"])[0]


def external_counts(spark, sf_dir):
    return dataset.external(outside(spark, sf_dir), "doc_id", "text", "label", "smishing", ["spam"])[1]


def link_share(spark, sf_dir):
    """How many texts of each class have a link: a class that links tell apart is told by style alone."""
    has = F.coalesce(text.link_in(F.col("text")) != "", F.lit(False))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return outside(spark, sf_dir).groupBy("label").agg(F.count_if(has).alias("k"), F.count("*").alias("n")).select("label", "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


OUTSIDE = "o as (select d.doc_id, text, case when toxic = 1 then 'smishing' when quality = 0 then 'spam' else 'ham' end as label from documents d join labels l on d.doc_id = l.doc_id)"
HOLDOUT = """h as (select doc_id as line, case when doc_id % 53 = 0 then 'bad id' when doc_id % 59 = 1 then 'm1' else 'm' || doc_id end as id, text as raw_text_scrubbed,
 case lang when 'en' then 'en' when 'fr' then 'hi' when 'de' then 'hinglish' else lang end as language_tag, (doc_id % 3 % 2)::varchar as is_scam,
 case when doc_id % 3 = 1 then case when doc_id % 41 = 1 then 'safe' else 'kyc_pan_block' end when doc_id % 43 = 0 then 'sim_swap' else 'safe' end as attack_category,
 case source when 'src0' then 'sms' when 'src1' then 'fax' else 'email' end as source_platform, '2024-02-' || lpad((doc_id % 31 + 1)::varchar, 2, '0') as date_received,
 case when doc_id % 5 = 0 then 'true' when doc_id % 61 = 1 then 'yes' else 'false' end as contains_obfuscation from documents)"""
SUFFIXES = ", ".join(f"'{s}'" for s in privacy.SUFFIXES)
KNOWN = ", ".join(f"'{s}'" for s in privacy.PLACEHOLDERS)
FLAGS = {
    "digits": "regexp_matches({t}, '[0-9]([ -]?[0-9]){{8,}}')", "handle": "regexp_matches({t}, '(^|[^A-Za-z0-9._-])@[A-Za-z0-9.-]')",
    "address": f"len(list_filter(list_zip(regexp_extract_all({{t}}, '{privacy.ADDRESS}', 1), regexp_extract_all({{t}}, '{privacy.ADDRESS}', 2)), lambda x: x[1] <> '' and (lower(x[2]) in ({SUFFIXES}) or regexp_matches(x[1], '[0-9._-]') or contains(x[2], '.')))) > 0",
    "pan": "regexp_matches({t}, '(^|[^A-Za-z0-9_])[A-Z]{{5}}[0-9]{{4}}[A-Z]($|[^A-Za-z0-9_])')",
    "unknown_placeholder": f"len(list_filter(regexp_extract_all({{t}}, '\\[([^\\]]*)\\]', 1), lambda x: x not in ({KNOWN}))) > 0",
    "glued": "regexp_matches({t}, '\\[[A-Z_]+\\][A-Za-z0-9_]')",
}


def flag_sql(t: str) -> dict[str, str]:
    return {k: v.format(t=t) for k, v in FLAGS.items()}


def errors_sql() -> str:
    shape = "regexp_matches(id, '^[A-Za-z0-9_-]+$')"
    cats = ", ".join(f"'{c}'" for c in dataset.CATEGORIES)
    rules = {
        "bad_id": f"not {shape}", "duplicate_id": f"{shape} and row_number() over (partition by id order by line) > 1", "short_text": "length(trim(raw_text_scrubbed, ' ')) < 10",
        **{f"pii_{k}": v for k, v in flag_sql("raw_text_scrubbed").items()},
        "bad_language": "language_tag not in ('en', 'hi', 'hinglish')", "bad_is_scam": "is_scam not in ('0', '1')", "bad_category": f"attack_category not in ({cats})",
        "scam_safe": "is_scam = '1' and attack_category = 'safe'", "safe_scam": f"is_scam = '0' and attack_category in ({cats}) and attack_category <> 'safe'",
        "bad_platform": f"source_platform not in ({', '.join(repr(p) for p in dataset.PLATFORMS)})",
        "bad_date": "not (try_strptime(date_received, '%Y-%m-%d') is not null and date_received <= '2024-02-20')", "bad_obfuscation": "contains_obfuscation not in ('true', 'false')",
        "at_not_marked": "contains(raw_text_scrubbed, '@') and contains_obfuscation <> 'true'",
        "duplicate_text": f"row_number() over (partition by {KEY.format('raw_text_scrubbed')} order by line) > 1 and length({KEY.format('raw_text_scrubbed')}) >= 10",
    }
    return f"with {HOLDOUT}, c as (select line, unnest([{', '.join(f'case when {v} then {k!r} end' for k, v in rules.items())}]) as code from h) select line, code from c where code is not null"


def stage_sql() -> str:
    out = []
    for stage, cfg in dataset.STAGES.items():
        parts = [f"case when n < {cfg['rows']} then 'rows' end"]
        for lang, target in dataset.TARGET_MIX.items():
            pct = f"100.0 * (select count(*) from h where language_tag = '{lang}') / n"
            parts.append(f"case when {f'{pct} < {cfg['language']}' if cfg['language'] is not None else f'abs({pct} - {target}) > {dataset.TOLERANCE}'} then 'language:{lang}' end")
        if cfg["category"]:
            parts += [f"case when (select count(*) from h where attack_category = '{k}') < {cfg['category']} then 'category:{k}' end" for k in dataset.CATEGORIES[:-1]]
        parts += [f"case when 100.0 * safe / n < {cfg['safe']} then 'safe' end", f"case when 100.0 * obf / n < {cfg['obfuscated']} then 'obfuscated' end"]
        out.append(f"select unnest([{', '.join(parts)}]) as problem, '{stage}' as stage from s")
    return f"with {HOLDOUT}, s as (select count(*) as n, count(*) filter (where attack_category = 'safe') as safe, count(*) filter (where contains_obfuscation = 'true') as obf from h), u as ({' union all '.join(out)}) select * from u where problem is not null"


def store(spark, sf_dir):
    """Three annotators' blind labels of the labelled documents, adjudications of some, and stages."""
    got = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    i, toxic = F.col("doc_id"), F.col("toxic") == 1
    row = lambda who, scam: got.select(i.alias("message_id"), F.lit(who).alias("annotator_id"), scam.alias("is_scam"))
    marks = row("a1", toxic).unionByName(row("a2", toxic != (i % 7 == 0))).unionByName(row("a3", F.col("quality") == 0).where("message_id % 5 = 0"))
    adjudications = got.where("doc_id % 14 = 0").select(i.alias("message_id"), (i % 4 == 0).alias("is_scam"))
    return got.select(i.alias("message_id")), marks, adjudications, got.select(i.alias("message_id"), F.when(i % 10 < 2, "s0").otherwise("s1").alias("stage"))


STORE = """lab as (select doc_id as message_id, 'a1' as annotator_id, toxic = 1 as is_scam from labels union all select doc_id, 'a2', (toxic = 1) <> (doc_id % 7 = 0) from labels
 union all select doc_id, 'a3', quality = 0 from labels where doc_id % 5 = 0), adj as (select doc_id as message_id, doc_id % 4 = 0 as is_scam from labels where doc_id % 14 = 0),
 una as (select message_id, bool_and(is_scam) as is_scam from lab group by message_id having count(*) >= 2 and count(distinct is_scam) = 1),
 fin as (select l.doc_id as message_id, coalesce(a.is_scam, u.is_scam) as is_scam, case when a.is_scam is not null then 'adjudicated' when u.is_scam is not null then 'unanimous' else 'pending' end as status
 from labels l left join adj a on a.message_id = l.doc_id left join una u on u.message_id = l.doc_id)"""


def kappa(spark, sf_dir):
    return labels.kappa(store(spark, sf_dir)[1], "a1", "a2")


def final_labels(spark, sf_dir):
    return labels.final_labels(*store(spark, sf_dir)[:3])


def needs_adjudication(spark, sf_dir):
    _, marks, adjudications, _ = store(spark, sf_dir)
    return labels.needs_adjudication(marks, adjudications)


def export_rows(spark, sf_dir):
    messages, marks, adjudications, splits = store(spark, sf_dir)
    return labels.export_rows(messages, splits, labels.final_labels(messages, marks, adjudications), "s1")


def visible_labels(spark, sf_dir):
    return labels.visible_labels(store(spark, sf_dir)[1], "labeler", "a3")


def label_disagreements(spark, sf_dir):
    """Documents at which two writings of one personal-data rule differ."""
    a = docs(spark, sf_dir).select("doc_id", privacy.pii_flags(F.col("text"))["digits"].alias("f"))
    b = docs(spark, sf_dir).select("doc_id", (F.length(F.regexp_extract("text", "(?:[0-9][ -]?){9,}", 0)) > 0).alias("f"))
    return labels.disagreements(a, b, "doc_id", ["f"])


def leak_exact(spark, sf_dir):
    """Documents in whose key another, later document shares (dev and sealed set are the same table)."""
    keyed = leakage.keyed(docs(spark, sf_dir), "doc_id", "text")
    return leakage.exact(keyed, keyed).where("dev_id <> sealed_id")


def leak_near(spark, sf_dir):
    """Pairs of different keys' first documents with Jaccard likeness of 0.85 or more; membership is dedup_first_line's."""
    keyed = leakage.keyed(docs(spark, sf_dir), "doc_id", "text")
    x, y = F.col("ca.id"), F.col("cb.id")
    return leakage.similar_keys(keyed, 0.85, ("id",)).select(F.least(x, y).alias("first_id"), F.greatest(x, y).alias("second_id"), F.round("jaccard", 6).alias("jaccard"))


def leak_benchmark(spark, sf_dir):
    dev = leakage.keyed(docs(spark, sf_dir), "doc_id", "text")
    return leakage.find(dev, leakage.keyed(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def independent_slice(spark, sf_dir):
    """Benchmark items that no document equals or nearly equals."""
    rows = leakage.keyed(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return leakage.independent(rows, leakage.keyed(docs(spark, sf_dir), "doc_id", "text")).select(F.col("id").alias("item_id"))


def hash_split(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", textmodel.split(text.dedup_key(F.col("text")), "v1").alias("side"))
    return rows.groupBy("lang", "side").agg(F.count("*").alias("n"))


def naive_overlap(spark, sf_dir):
    """Test rows whose key is also among the training rows when rows, not keys, are dealt out."""
    rows = docs(spark, sf_dir).select(text.dedup_key(F.col("text")).alias("key"), (textmodel.hash_share(F.col("doc_id").cast("string"), "naive") < 0.8).alias("train"))
    test, train = rows.where(~F.col("train")), rows.where("train").select("key").distinct()
    return test.agg(F.count("*").alias("test_rows")).crossJoin(test.join(train, "key", "left_semi").agg(F.count("*").alias("overlap")))


def labelled(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def nb_weights(spark, sf_dir):
    return textmodel.weights(labelled(spark, sf_dir), F.col("text"), F.col("quality") == 0)


def nb_scores(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return textmodel.scores(docs(spark, sf_dir), "doc_id", F.col("text"), textmodel.weights(rows, F.col("text"), F.col("quality") == 0))


def vocab_df(spark, sf_dir):
    return textmodel.vocabulary(docs(spark, sf_dir), F.col("text"))


FEATURES = "list_distinct(list_concat(list_concat(regexp_extract_all(lower(text), '[a-z]{2,}'), list_filter([case when regexp_matches(text, '(?i)https?://|www[.]') then '#link' end, case when regexp_matches(text, '[0-9]{5,}') then '#digits' end, case when regexp_matches(text, '[£$₹]') then '#money' end, case when contains(text, '!') then '#shout' end], lambda x: x is not null)), ['#len' || least(9, length(text) // 200)]))"
NB = f"""f as (select d.doc_id, quality = 0 as y, unnest({FEATURES}) as feature from documents d join labels l on d.doc_id = l.doc_id),
 t as (select count(*) filter (where quality = 0) as p, count(*) filter (where quality <> 0) as n from documents d join labels l on d.doc_id = l.doc_id),
 w as (select feature, count(*) filter (where y) as pos, count(*) filter (where not y) as neg from f group by feature having count(*) >= 5),
 m as (select feature, pos, neg, round(ln((pos + 1.0) / (p + 2)) - ln((neg + 1.0) / (n + 2)), 3) as weight from w, t)"""
SHARE = "(('0x' || substr(sha256('{salt}|' || {key}), 1, 8))::bigint / 4294967296.0)"
SETS = f"k as (select {KEY.format('text')} as key, min(doc_id) as id from documents group by 1), s as (select id, {TOKENS.format('key')} as tk from k), e as (select id, len(tk) as n, unnest(tk) as t from s where len(tk) >= 4)"

SQL = {
    "dedup_key_groups": f"with k as (select {KEY.format('text')} as key, count(*) as size, min(doc_id) as first_id from documents group by 1) select size, count(*) as groups, sum(first_id)::bigint as ids from k group by size",
    "dedup_first_line": f"with k as (select doc_id, {KEY.format('text')} as key from documents) select doc_id, min(doc_id) over (partition by key) as first_id, count(*) over (partition by key) as size from k where length(key) >= 10",
    "conflict_groups": f"with k as (select {KEY.format('text')} as key, count(*) as n, count(distinct quality) as labels, min(d.doc_id) as kept_id from documents d join labels l on d.doc_id = l.doc_id group by 1) select labels > 1 as conflict, count(*) as groups, sum(n)::bigint as rows, sum(kept_id)::bigint as ids from k group by 1",
    "pii_flags": f"select doc_id, {', '.join(f'{v} as {k}' for k, v in flag_sql('text').items())} from documents",
    "pii_in_conversations": f"select role, {', '.join(f'count(*) filter (where {v}) as {k}' for k, v in flag_sql('text').items())} from conversations group by role",
    "small_cells": "with c as (select lang, source, count(*) as n from documents d join labels l on d.doc_id = l.doc_id where toxic = 1 group by 1, 2) select lang, source, case when n between 1 and 4 then '<5' else n::varchar end as shown from c",
    "lang_suggest": f"""with c as (select conv_id, turn, len(regexp_extract_all(text, '\\p{{L}}')) as letters, len(list_filter(regexp_extract_all(text, '\\p{{Devanagari}}'), lambda x: regexp_matches(x, '\\p{{L}}'))) as deva,
 len(list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'), lambda w: w in ({', '.join(repr(w) for w in ROMAN)}))) as hits from conversations)
 select conv_id, turn, case when letters > 0 and deva > 0.3 * letters then 'hi' when deva > 0 then 'hinglish' when hits >= 2 then 'hinglish' else 'en' end as suggested from c""",
    "obfuscation_flag": "select doc_id, regexp_matches(text, '[A-Za-z][@$][A-Za-z]') or regexp_matches(text, '[\\x{200B}-\\x{200D}\\x{FEFF}]') or regexp_matches(text, '(^|[^A-Za-z0-9_])([A-Za-z][ ._-]){2,}[A-Za-z]($|[^A-Za-z0-9_])') or (regexp_matches(text, '[A-Za-z]') and regexp_matches(text, '[\\x{0370}-\\x{03FF}\\x{0400}-\\x{04FF}]')) as obfuscated from documents",
    "text_features": f"with f as (select doc_id, {FEATURES} as f from documents) select doc_id, len(f) as n, array_to_string(list_sort(list_filter(f, lambda x: starts_with(x, '#'))), ',') as flags from f",
    "token_sets": f"with k as (select doc_id, {KEY.format('text')} as key from documents) select doc_id, len({TOKENS.format('key')}) as n_tokens from k",
    "holdout_validate": errors_sql(),
    "stage_checks": stage_sql(),
    "holdout_statistics": f"""with {HOLDOUT}, d as (select *, try_strptime(date_received, '%Y-%m-%d')::date as day from h), u as (select 'all' as dim, 'all' as value, day from d {' '.join(f"union all select '{c}', {c}, day from d" for c in ('language_tag', 'attack_category', 'source_platform', 'contains_obfuscation'))})
 select dim, value, count(*) as n, strftime(min(day), '%Y-%m-%d') as first, strftime(max(day), '%Y-%m-%d') as last from u group by 1, 2""",
    "external_rows": f"with {OUTSIDE}, k as (select {KEY.format('text')} as key, min(doc_id) as id, count(distinct label) as labels, min(label) as label from o group by 1) select id, label = 'smishing' as y from k where labels = 1 and label <> 'spam'",
    "external_counts": f"""with {OUTSIDE}, k as (select {KEY.format('text')} as key, count(*) as n, count(distinct label) as labels, min(label) as label from o group by 1)
 select unnest(['input', 'conflicting_groups', 'after_conflicts_and_repeats', 'excluded', 'positive', 'negative']) as what, unnest([sum(n), count(*) filter (where labels > 1), count(*) filter (where labels = 1), count(*) filter (where labels = 1 and label = 'spam'), count(*) filter (where labels = 1 and label = 'smishing'), count(*) filter (where labels = 1 and label = 'ham')])::bigint as n from k""",
    "source_share": f"with {HOLDOUT}, c as (select source_platform, count(*) as n, (select count(*) from h) as rows from h group by 1) select * from c where rows >= 50 and n > 0.4 * rows",
    "kappa": f"with {STORE}, p as (select x.is_scam as x, y.is_scam as y from lab x join lab y on x.message_id = y.message_id and x.annotator_id = 'a1' and y.annotator_id = 'a2'), c as (select count(*) as n, count(*) filter (where x = y)::double / count(*) as po, (count(*) filter (where x) * count(*) filter (where y) + count(*) filter (where not x) * count(*) filter (where not y))::double / (count(*) * count(*)) as pe from p) select n, round(po, 6) as po, round(pe, 6) as pe, case when pe < 1 then round((po - pe) / (1 - pe), 6) end as kappa from c",
    "final_labels": f"with {STORE} select * from fin",
    "needs_adjudication": f"with {STORE} select message_id, count(*) as n from lab where message_id not in (select message_id from adj) group by message_id having count(*) >= 2 and count(distinct is_scam) > 1",
    "export_rows": f"with {STORE} select * from fin where message_id % 10 >= 2 and status <> 'pending'",
    "visible_labels": f"with {STORE} select * from lab where annotator_id = 'a3'",
    "label_disagreements": "select doc_id from documents where regexp_matches(text, '[0-9]([ -]?[0-9]){8,}') <> regexp_matches(text, '([0-9][ -]?){9,}')",
    "leak_exact": f"with k as (select doc_id as sealed_id, max(doc_id) over (partition by {KEY.format('text')}) as dev_id from documents) select * from k where dev_id <> sealed_id",
    "leak_near": f"with {SETS}, p as (select a.id as x, b.id as y, any_value(a.n) as na, any_value(b.n) as nb, count(*) as same from e a join e b on a.t = b.t and a.id < b.id group by 1, 2) select x as first_id, y as second_id, round(same / (na + nb - same)::double, 6) as jaccard from p where same / (na + nb - same)::double >= 0.85",
    "leak_benchmark": f"""with d as (select doc_id as id, {KEY.format('text')} as key from documents), b as (select item_id as id, {KEY.format('text')} as key from benchmark), x as (select b.id as sealed_id, max(d.id) as dev_id, 'exact' as kind from b join d on b.key = d.key group by b.id),
 de as (select id, len(tk) as n, unnest(tk) as t from (select id, {TOKENS.format('key')} as tk from d) where len(tk) >= 4), be as (select id, len(tk) as n, unnest(tk) as t from (select id, {TOKENS.format('key')} as tk from b where id not in (select sealed_id from x)) where len(tk) >= 4),
 p as (select be.id as b, de.id as d, count(*) as same, any_value(be.n) as nb, any_value(de.n) as nd from be join de on be.t = de.t group by 1, 2)
 select * from x union all select b, min(d), 'near' from p where same / (nb + nd - same)::double >= 0.85 group by b""",
    "hash_split": f"with h as (select lang, {SHARE.format(salt='v1', key=KEY.format('text'))} as h from documents) select lang, case when h < 0.6 then 'train' when h < 0.8 then 'validation' else 'test' end as side, count(*) as n from h group by 1, 2",
    "naive_overlap": f"with h as (select {KEY.format('text')} as key, {SHARE.format(salt='naive', key='doc_id')} < 0.8 as train from documents) select count(*) as test_rows, count(*) filter (where key in (select key from h where train)) as overlap from h where not train",
    "nb_weights": f"with {NB} select * from m",
    "nb_scores": f"with {NB}, a as (select doc_id, unnest({FEATURES}) as feature from documents) select doc_id, round(coalesce(sum(weight), 0), 3) as score from a left join m using (feature) group by doc_id",
    "vocab_df": f"with a as (select unnest({FEATURES}) as feature from documents) select feature, count(*) as df from a group by feature having count(*) >= 2",
}
SQL["independent_slice"] = f"with lk as ({SQL['leak_benchmark']}) select item_id from benchmark where item_id not in (select sealed_id from lk)"
QUERIES = {f.__name__: f for f in (
    dedup_key_groups, dedup_first_line, conflict_groups, pii_flags, pii_in_conversations, scrub_placeholders, small_cells, lang_suggest, obfuscation_flag, text_features, token_sets,
    holdout_validate, holdout_statistics, external_rows, external_counts, link_share, stage_checks, source_share, kappa, final_labels, needs_adjudication, export_rows, visible_labels, label_disagreements, leak_exact, leak_near, leak_benchmark,
    independent_slice, hash_split, naive_overlap, nb_weights, nb_scores, vocab_df,
)}
