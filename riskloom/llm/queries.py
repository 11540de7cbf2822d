"""One query for each operator over its whole table, and the SQL of those that DuckDB can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, fim, fingerprint, langid, lm, mixing, pii, quality, secret_scan, simhash, token_counts
from .common import checkpoint_folder, crc_mod, table


def digest(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def spans_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda x: x["base"] & (x["kind"] == kind))).cast("long")


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.bpe_encode(docs, keep=["doc_id"]).withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = bpe.bpe_decode(encoded, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", digest(F.col("decoded")).alias("decoded_sha256"))


def op2_fingerprint_lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, ~held, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 10) == 0
    scored = lm.score_text(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit_field(docs, "text", "doc_id"), keep=["doc_id"])
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda x: x["base"])
    return found.select(
        "doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in pii.KINDS],
        digest(spans_text(base)).alias("base_sha256"), spans_text(spans).alias("spans"),
    )


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 0
    machine = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~held)
    scored = quality.score_quality(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda x: x["base"])
    return found.select(
        "doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        digest(spans_text(base)).alias("base_sha256"), spans_text(spans).alias("spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.fim_transform(docs.withColumn("n", F.length(F.coalesce("text", F.lit(""))).cast("long")), keep=["doc_id", "n"])
    return fim.fim_restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("fim")).alias("output_sha256"), digest(F.col("restored")).alias("restored_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache that the setting `riskloom.tokenCounts` names; without one, a new and empty one in the shared folder."""
    cache = spark.conf.get("riskloom.tokenCounts", None) or f"{checkpoint_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, cache, keep=["doc_id"]).select("doc_id", "n_bytes", "n_tokens", "over_limit")


#: Phrases, their parts and the phrases that hold them, counted from all n-grams; huge integers keep products exact.
COLLOCATIONS = r"""with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
]')) as piece from documents),
 worded as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from pieces),
 totals as (select lang, sum(len(w))::bigint as n from worded group by lang having sum(len(w)) > 0),
 grams as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) as phrase from worded, range(1, 5) r(m) where len(w) >= m),
 f as (select lang, phrase, m, count(*)::hugeint as f from grams group by all),
 c as (select lang, phrase, m, f as a, string_split(phrase, ' ') as t from f where m >= 2 and f >= 30),
 cuts as (select lang, phrase, a, k, array_to_string(t[1 : k], ' ') as lp, array_to_string(t[k + 1 : m], ' ') as rp from c, range(1, 4) r(k) where k < m),
 scores as (select x.lang, x.phrase, x.a, x.k, l.f as l, r.f as r, (2000000::hugeint * x.a) // (l.f + r.f) as score from cuts x join f l on l.lang = x.lang and l.phrase = x.lp join f r on r.lang = x.lang and r.phrase = x.rp),
 weakest as (select lang, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, score * 8 + k) as b from scores group by lang, phrase, a),
 inside as (select distinct lang, a, array_to_string(t[i : i + n - 1], ' ') as phrase from c, range(1, 4) p(i), range(2, 4) q(n) where n < m and i + n - 1 <= m),
 dropped as (select distinct c.lang, c.phrase from c join inside i on i.lang = c.lang and i.phrase = c.phrase where 100 * i.a >= 80 * c.a),
 ranked as (select w.lang, row_number() over (partition by w.lang order by b.score desc, w.a desc, encode(w.phrase)) as rank, w.phrase, w.a, b.l as l, b.r as r, b.score as score from weakest w left join dropped d on d.lang = w.lang and d.phrase = w.phrase where d.phrase is null)
 select lang, rank::int as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000"""

FILL_IN_MIDDLE = """with h as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
 u as (select *, ('0x' || s[1 : 8])::bigint % (n + 1) as x, ('0x' || s[9 : 16])::bigint % (n + 1) as y, ('0x' || s[17 : 24])::bigint % 100 as c, ('0x' || s[25 : 32])::bigint % 100 as d from h),
 g as (select doc_id, t, n, least(x, y) as p, greatest(x, y) as q, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 90 then 'plain' when d < 20 then 'spm' else 'psm' end as form from u),
 b as (select *, substring(t, 1, p) as pre, substring(t, p + 1, q - p) as mid, substring(t, q + 1, n - q) as suf from g)
 select doc_id, n::bigint as n, form, case when form <> 'plain' then p end::bigint as prefix_chars, case when form <> 'plain' then q - p end::bigint as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from b"""

QUERIES = {f.__name__: f for f in (
    op1_bpe_tree, op2_fingerprint_lcp, op3_language_id, op4_maxent_lm, op5_mixing, op6_simhash_pigeonring, op7_prefix_forest, op8_pii_semicrf, op9_quality_fm, op10_secret_scan,
    op11_collocations, op12_fill_in_middle, op13_token_counts,
)}  # fmt: skip
ORACLE_SQL = {"op11_collocations": COLLOCATIONS, "op12_fill_in_middle": FILL_IN_MIDDLE}
