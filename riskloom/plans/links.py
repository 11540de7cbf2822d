"""Queries on links, payment codes, names and pages, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text, urls
from ..operators import domain_model, links, names, training
from ..session import written
from ..sources.tables import table

#: Forms that pages' own addresses don't have; one is planted beside each page, by its number.
FORMS = [
    "https://sub.example.net/{n}", "http://sbi-kyc-verify{n}.xyz/login", "https://onlinesbi.sbi/personal/{n}", "https://sbi.co.in.account{n}.top/verify", "https://hdfcbank.com@198.51.100.7/x{n}",
    "http://203.0.113.9/kyc/{n}.apk", "https://bit.ly/a{n}", "https://www.google.com/url?q=http://icici-reward{n}.click/claim", "<https://blog.example.org/{n}>.",
    "https://incometax.gov.in/refund/{n}", "https://phonepee.in/{n}", "https://shop{n}.example.com/paytm/login.php", "https://a.b.c.d{n}.example.org/path", "https://free-gift-for-you{n}.tk/claim?site=icicibank.com",
    "javascript:alert({n})", "upi://pay?pa=shop{n}@okaxis&pn=SBI%20Support&am=500", "mailto:a{n}@example.com", "ftp://files.example.org/{n}", "not a link {n}", "https://netflix-login{n}.example.net/account/verify",
    "https://accounts.example{n}.bank.in/", "https://paypa1.com/{n}", "https://evil{n}.com\\@sbi.co.in/", "https://docs.example.com/{n}?next=https://amazon-offers{n}.shop/login", "+91 98765 4321{n}", "HTTPS://WWW.Example.COM:8443/A?b=c#d",
]


#: Numbers of planted addresses begin here.
PLANTED = 1_000_000_000


def cases(spark, sf_dir):
    """The addresses of all pages, and the planted ones."""
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("page_id") % len(FORMS) + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("long"))
    planted = pages.select((F.col("page_id") + PLANTED).alias("page_id"), F.replace(form, F.lit("{n}"), F.col("page_id").cast("string")).alias("link"))
    return pages.select("page_id", F.col("url").alias("link")).unionByName(planted)


CASES = f"cases as (select page_id, url as link from pages union all select page_id + {PLANTED}, replace([{', '.join(chr(39) + f + chr(39) for f in FORMS)}][page_id % {len(FORMS)} + 1], '{{n}}', page_id::varchar) from pages)"
DOUBLE = ", ".join(f"'{s}'" for s in urls.DOUBLE_SUFFIXES)


def registrable_sql(h: str) -> str:
    parts = f"string_split({h}, '.')"
    return f"case when len({parts}) <= 2 then {h} when array_to_string({parts}[-2:], '.') in ({DOUBLE}) then array_to_string({parts}[-3:], '.') else array_to_string({parts}[-2:], '.') end"


def parts_sql(source: str, pre: str = "") -> str:
    """Steps from a table (page_id, link) to its links' parts, in a table named by the prefix."""
    return f"""{pre}p1 as (select *, regexp_replace(regexp_replace(link, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '^[<"''(\\[]+|[>"'')\\].,;!]+$', '', 'g') as input from {source}),
 {pre}p2 as (select *, case when regexp_matches(input, '^[A-Za-z0-9.-]+:[0-9]+') then '' else lower(regexp_extract(input, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) end as scheme from {pre}p1),
 {pre}p3 as (select *, replace(case when scheme = '' then 'http://' || input else input end, '\\', '/') as whole from {pre}p2),
 {pre}p4 as (select *, regexp_extract(whole, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as authority from {pre}p3),
 {pre}p5 as (select page_id, link, input, scheme, regexp_extract(authority, '^(.*)@', 1) as userinfo, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')), '[.]$', ''), '^www[.]', '') as host,
  regexp_extract(whole, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(whole, '^[^?#]*[?]([^#]*)', 1) as query from {pre}p4),
 {pre}parts as (select *, scheme in ('', 'http', 'https') and regexp_matches(host, '[.:]') and not regexp_matches(input, '[ \\t\\r\\n]') as web, {registrable_sql('host')} as registrable from {pre}p5)"""


PARTS = f"{CASES}, {parts_sql('cases')}"


def target_sql(source: str, pre: str, out: str) -> str:
    """Steps from (page_id, link) to the addresses (page_id, link) that the links forward to: each parameter's address becomes a row
    with its own parts, and the first of another domain counts."""
    return f"""{parts_sql(source, pre)},
 {pre}v as (select page_id, registrable as own, unnest(regexp_extract_all('&' || query, '(?i)&[^=&]+=(https?(:|%3a)(/|%2f){{2}}[^&]+)', 1)) as raw, generate_subscripts(regexp_extract_all('&' || query, '(?i)&[^=&]+=(https?(:|%3a)(/|%2f){{2}}[^&]+)', 1), 1) as n from {pre}parts where scheme in ('', 'http', 'https') and not regexp_matches(lower(path), '^/(search|s|results)(/|$)')),
 {pre}w as (select page_id, n, own, url_decode(replace(raw, '+', '%2B')) as link from {pre}v), {parts_sql(f'{pre}w', pre + 'x')},
 {out} as (select page_id, arg_min(link, n) as link from (select w.page_id, w.n, w.link from {pre}w w join (select distinct link, registrable from {pre}xparts) x using (link) where x.registrable <> w.own) group by 1)"""


def url_parts(spark, sf_dir):
    return links.parts(cases(spark, sf_dir), "link").select("page_id", "scheme", "userinfo", "host", "path", "query", "web", "registrable")


def registrable_domain(spark, sf_dir):
    h = urls.host(urls.cleaned(F.col("url")))
    return table(spark, sf_dir, "pages").select(h.alias("host"), urls.registrable(h).alias("registrable")).groupBy("registrable").agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"))


def payload_kind(spark, sf_dir):
    return cases(spark, sf_dir).select("page_id", links.payload_kind(F.col("link")).alias("kind"))


def url_flags(spark, sf_dir):
    return links.flagged(cases(spark, sf_dir), "link").select("page_id", F.array_join("codes", ",").alias("codes"), "weak", "shortener", F.coalesce("brand", F.lit("")).alias("brand"))


def url_verdict(spark, sf_dir):
    return links.flagged(cases(spark, sf_dir), "link").select("page_id", links.level().alias("level"))


def legacy_verdict(spark, sf_dir):
    d = links.judged(cases(spark, sf_dir), "link")
    return d.select("page_id", links.legacy_verdict(links.payload_kind(F.col("link")), F.col("level")).alias("verdict"))


def redirect_verdict(spark, sf_dir):
    return links.verdicts(cases(spark, sf_dir), "page_id", "link")


def level_counts(spark, sf_dir):
    return links.flagged(cases(spark, sf_dir), "link").groupBy(links.level().alias("level")).agg(F.count("*").alias("n"), F.sum("weak").alias("weak"))


def lookalike_hosts(spark, sf_dir):
    """Names of the pages' hosts within one edit of another host's name of five letters or more."""
    h = table(spark, sf_dir, "pages").select(names.name_of(urls.registrable(urls.host(F.col("url")))).alias("name")).union(cases(spark, sf_dir).select(names.name_of(urls.registrable(urls.host(urls.cleaned(F.col("link")))))))
    own = F.array(*[F.lit(t) for _, tokens, _ in links.BRANDS for t in tokens if len(t) >= 5])
    rows = h.where(F.length("name") >= 5).distinct().select("name", F.explode(own).alias("token"))
    return rows.where((F.col("name") != F.col("token")) & urls.one_edit(F.col("name"), F.col("token")))


def flags_sql(source: str = CASES, more: str = "") -> str:
    """Steps from `cases` (page_id, link), which `source` makes, to their codes and levels."""
    m = lambda c, p: f"regexp_matches({c}, '{p}')"
    any_of = lambda xs: "(" + " or ".join(xs) + ")"
    dom = lambda ds: any_of(f"(host = '{d}' or ends_with(host, '.{d}'))" for d in ds)
    some = lambda c, cond: f"len(list_filter({c}, lambda x: {cond})) > 0"
    edit = lambda t: f"(length(x) >= 6 and damerau_levenshtein(x, '{t}') <= 1)"
    exact = {n: any_of(some("bothbits", m("x", "^" + links.affix_pattern(t) + "$")) for t in ts) for n, ts, _ in links.BRANDS}
    loose = {n: any_of([some("bothbits", f"contains(x, '{t}')") for t in ts if len(t) > 4] or ["false"]) for n, ts, _ in links.BRANDS}
    fuzzy = {n: any_of([some("bothbits", edit(t)) for t in ts if len(t) >= 6] or ["false"]) for n, ts, _ in links.BRANDS}
    case = "case " + " ".join(f"when registrable not in ({', '.join(repr(d) for d in own)}) and ({exact[n]} or {loose[n]} or {fuzzy[n]}) then '{n}|' || case when {exact[n]} then 'exact' when {loose[n]} then 'loose' else 'fuzzy' end" for n, _, own in links.BRANDS) + " end"
    act = any_of(m("full_path", f"(^|[^a-z]){w}([^a-z]|$)") for w in links.ACTIONS)
    act_host = any_of(f"list_contains(bits, '{w}')" for w in links.ACTIONS)
    in_path = any_of(f"({m('path_words', '(^| )' + links.affix_pattern(t) + '( |$)')} and registrable not in ({', '.join(repr(d) for d in own)}))" for _, ts, own in links.BRANDS for t in ts)
    path_act = any_of([m("full_path", f"(^|[^a-z0-9]){w}([^a-z0-9]|$)") for w in links.ACTIONS] + [m("lower(path)", "[.](php|aspx?|jsp)$")])
    mimic = any_of(f"({some('folded', f'contains(x, {t!r})')} and not {some('bits', f'contains(x, {t!r})')})" for _, ts, _ in links.BRANDS for t in ts)
    search = m("lower(path)", "^/(search|s|results)(/|$)")
    ending = "string_split(host, '.')[-1]"
    isin = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    checks = {
        "hidden-characters": "web and " + m("link", "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]"), "backslash": "web and " + m("input", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*\\\\"),
        "userinfo": "web and userinfo <> ''", "raw-ip": f"web and ({m('host', '^[0-9]{1,3}([.][0-9]{1,3}){3}$')} or contains(host, ':'))",
        "embedded-official": "outer_host and " + any_of(f"((contains(host, '{d}.') or contains(host, '{d}-')) and registrable <> '{d}')" for d in links.DOMAINS),
        "homoglyph": "how is not null and mimic", "typosquat": "how = 'fuzzy' and not mimic", "impersonation": "how in ('exact', 'loose') and not mimic",
        "mixed-script": "outer_host and foreign_script and " + m("host", "[A-Za-z]") + " and " + m("host", "[\\x{0370}-\\x{03FF}\\x{0400}-\\x{04FF}]"),
        "free-tld": f"outer_host and {ending} in {isin(links.FREE_ENDINGS)}", "cheap-tld": f"outer_host and {ending} in {isin(links.CHEAP_ENDINGS)}", "action-words": f"outer_host and ({act} or {act_host})",
        "brand-in-path": f"outer_host and not {m('full_path', links.BENIGN_PATH)} and {path_act} and {in_path}", "official-in-query": f"outer_host and not {search} and " + any_of(m("full_path", f"[?&][^=&]*=[^&]*{d.replace('.', '[.]')}") for d in links.DOMAINS),
        "hyphens": "outer_host and len(regexp_extract_all(string_split(registrable, '.')[1], '-')) >= 3", "deep-subdomain": "outer_host and len(string_split(host, '.')) - len(string_split(registrable, '.')) >= 3", "apk": "outer_host and " + m("lower(path)", "[.]apk$"),
    }
    weak = " + ".join(f"case when coalesce({q}, false) then {links.WEIGHTS[k]} else 0 end" for k, q in ((k, f'"f_{k}"') for k in checks if k in links.WEIGHTS))
    return f"""with {source}, {parts_sql('cases')}{more}, a as (select *, web and ({dom(links.DOMAINS)} or {dom(urls.GOVERNMENT)}) as official, web and {dom(urls.FINANCE)} as restricted,
 lower(replace(url_decode(replace(path || case when query <> '' then '?' || query else '' end, '+', '%2B')), '+', '+')) as full_path, string_split(regexp_replace(host, '[.]?[^.]*$', ''), '.') as own, regexp_matches(host, '[^\\x{{20}}-\\x{{7e}}]') as foreign_script from parts),
 b as (select *, web and not official and not restricted as outer_host, list_distinct(flatten(list_transform(own, lambda x: list_concat([x, replace(x, '-', '')], regexp_extract_all(x, '[a-z]+|[0-9]+'))))) as bits,
  array_to_string(list_filter(list_transform(string_split(lower(url_decode(replace(path, '+', '%2B'))), '/'), lambda s: regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), lambda s: trim(s, ' ') <> '' and len(string_split(trim(s, ' '), ' ')) <= 3), ' ') as path_words from a),
 c as (select *, list_transform(bits, lambda x: translate(x, '01', 'ol')) as folded from b), d as (select *, list_distinct(list_concat(bits, folded)) as bothbits from c),
 e as (select *, case when outer_host then {case} end as match, foreign_script and {mimic} as mimic from d), f as (select *, string_split(match, '|')[1] as brand, string_split(match, '|')[2] as how from e),
 g as (select *, {', '.join(f'coalesce({v}, false) as "f_{k}"' for k, v in checks.items())} from f), h as (select *, {weak} as weak0 from g),
 i as (select *, outer_host and scheme in ('http', '') and ({act} or weak0 >= 2) as "f_no-tls", web and host = registrable and length(string_split(registrable, '.')[1]) <= 5 and regexp_matches(path, '^/[A-Za-z0-9_-]{{1,10}}$') and regexp_matches(path, '[0-9A-Z]') and query = '' as shortener from h),
 flagged as (select *, list_filter([{', '.join(f"case when \"f_{k}\" then '{k}' end" for k in links.ORDER)}], lambda x: x is not null) as codes, weak0 + case when "f_no-tls" then 1 else 0 end as weak, {' or '.join(f'"f_{k}"' for k in links.STRONG)} as strong from i),
 leveled as (select *, case when scheme in ('javascript', 'data', 'vbscript') then 'scam' when not web then 'unverified' when official and not ("f_hidden-characters" or "f_backslash") then 'official' when restricted and not strong then 'official'
  when strong or (("f_impersonation" or "f_typosquat") and ((how = 'exact' and weak >= 4) or weak >= 5)) or weak >= 6 then 'scam' when "f_impersonation" or "f_typosquat" or weak >= 2 or "f_mixed-script" then 'suspicious' else 'unverified' end as level from flagged)"""


#: One of these stands for each customer, by number.
CODES = [
    "upi://pay?pa={n}.shop@okaxis&pn={name}&am={amt}&cu=INR", "upi://pay?pa=help@upi&pn=SBI%20Customer%20Support&am={amt}", "upi://mandate?pa=x{n}@ybl&pn={name}", "upi://pay?pa=a{n}@ybl&pa=b{n}@ybl&pn={name}",
    "upi://pay?pa=win{n}@paytm&pn={name}&tn=lottery%20prize", "upi://pay?pn={name}", "upi://collect?pa=x{n}@upi&am=1&AM=2", "upi://send?pa=friend{n}@okicici&pn={name}", "UPI://PAY?PA=shop.{n}@icici&PN={name}&tn=%E0%A4%A",
]


def codes(spark, sf_dir):
    form = F.element_at(F.array(*[F.lit(f) for f in CODES]), (F.col("c_custkey") % len(CODES) + 1).cast("int"))
    put = lambda c, k, v: F.replace(c, F.lit(k), v)
    return table(spark, sf_dir, "customer").select("c_custkey", put(put(put(form, "{n}", F.col("c_custkey").cast("string")), "{name}", F.replace("c_name", F.lit("#"), F.lit("%23"))), "{amt}", F.floor(F.abs("c_acctbal")).cast("string")).alias("code"))


def payment_code_verdict(spark, sf_dir):
    return links.payments(codes(spark, sf_dir), "code").select("c_custkey", "payee", "payee_name", "amount", "action", "score", "level", F.array_join("codes", ",").alias("codes"))


def payments_sql() -> str:
    get = lambda k: f"list_filter(pairs, lambda x: x.k = '{k}')[1].v"
    many = lambda k: f"len(list_distinct(list_transform(list_filter(pairs, lambda x: x.k = '{k}'), lambda x: x.v))) > 1"
    name = "lower(coalesce(payee_name, ''))"
    words = "lower(concat_ws(' ', payee_name, note, regexp_replace(payee, '@.*$', '')))"
    checks = {
        "bad-payee": ("coalesce(not regexp_matches(payee, '^[A-Za-z0-9._-]{2,}@[A-Za-z][A-Za-z0-9]+$'), true)", 2), "duplicate-parameter": (f"({many('pa')} or {many('am')})", 3),
        "bank-support": (f"(regexp_matches({name}, 'bank|sbi|hdfc|icici|paytm|phonepe') and regexp_matches({name}, 'support|care|help|service|officer'))", 3), "mandate": ("action = 'mandate'", 3),
        "unknown-action": ("action not in ('pay', 'mandate', 'collect', '')", 1), "amount-filled": ("coalesce(amount, '') <> ''", 1), "pretext": (f"regexp_matches({words}, '(^|[^a-z])({'|'.join(links.PRETEXTS)})([^a-z]|$)')", 0),
    }
    return f"""with c as (select c_custkey, replace(replace(replace([{', '.join(f"'{f}'" for f in CODES)}][c_custkey % {len(CODES)} + 1], '{{n}}', c_custkey::varchar), '{{name}}', replace(c_name, '#', '%23')), '{{amt}}', floor(abs(c_acctbal))::bigint::varchar) as code from customer),
 q as (select *, list_transform(list_filter(string_split(regexp_extract(code, '[?](.*)$', 1), '&'), lambda x: contains(x, '=')), lambda x: {{'k': lower(string_split(x, '=')[1]), 'v': case when contains(x, '%E0%A4%A') then regexp_replace(x, '^[^=]*=', '') else url_decode(replace(regexp_replace(x, '^[^=]*=', ''), '+', '%2B')) end}}) as pairs, lower(regexp_extract(code, '(?i)^[a-z]+:/{{0,2}}([a-z]*)', 1)) as action from c),
 g as (select c_custkey, action, pairs, {get('pa')} as payee, {get('pn')} as payee_name, {get('am')} as amount, {get('tn')} as note from q),
 s as (select *, {' + '.join(f'case when {v} then {w} else 0 end' for v, w in checks.values())} as score, list_filter([{', '.join(f"case when {v} then '{k}' end" for k, (v, _) in checks.items())}], lambda x: x is not null) as cl from g)
 select c_custkey, payee, payee_name, amount, action, score, case when score >= 4 or list_contains(cl, 'pretext') then 'scam' when score >= 2 then 'suspicious' else 'unverified' end as level, array_to_string(cl, ',') as codes from s"""


REDIRECTED = f"""{CASES.replace('cases as', 'own as', 1)}, {target_sql('own', 'a', 'one')}, {target_sql('one', 'b', 'two')},
 cases as (select page_id * 4 as page_id, link from own union all select page_id * 4 + 1, link from one union all select page_id * 4 + 2, link from two)"""
RANK = "case level when 'scam' then 3 when 'suspicious' then 2 when 'official' then 0 else 1 end"


def page_names(spark, sf_dir):
    h = urls.host(F.col("url"))
    d = table(spark, sf_dir, "pages").select("page_id", h.alias("host"), urls.registrable(h).alias("registrable"), "url")
    return d.select("*", F.regexp_extract("host", "([a-z0-9-]+)[.][a-z0-9-]+[.][a-z]+$", 1).alias("name"))


NAMES = f"""n as (select page_id, url, regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':[0-9]*$', '')), '^www[.]', '') as host from pages),
 names as (select *, {registrable_sql('host')} as registrable, regexp_extract(host, '([a-z0-9-]+)[.][a-z0-9-]+[.][a-z]+$', 1) as name from n)"""


def platforms(spark, sf_dir):
    return names.platforms(page_names(spark, sf_dir), 5)


def domain_conflicts(spark, sf_dir):
    d = page_names(spark, sf_dir).select(F.col("name").alias("registrable"), F.col("url").startswith("https").alias("y"), F.lit("pages").alias("source"))
    return names.without_conflicts(d).select("registrable", "y")


def artifact_shares(spark, sf_dir):
    """How often a trait of the address occurs, by scheme: traits that tell labels apart by accident show here."""
    d = page_names(spark, sf_dir).select(F.col("url").startswith("https").alias("y"), F.col("url").contains("?").cast("int").alias("query"), F.col("url").contains("#").cast("int").alias("fragment"), F.col("url").endswith("/").cast("int").alias("slash"), F.col("host").startswith("m.").cast("int").alias("mobile"))
    return d.unpivot(["y"], ["query", "fragment", "slash", "mobile"], "trait", "has").groupBy("trait", "y").agg(F.round(F.avg("has"), 6).alias("share"))


def domain_features(spark, sf_dir):
    d = page_names(spark, sf_dir).select("name", "registrable").distinct()
    return d.select("name", "registrable", *[(F.round(v, 6) if k in ("digit_share", "entropy", "vowel_share") else v).alias(k) for k, v in names.numbers(F.col("name"), F.col("registrable")).items()])


def fnv_buckets(spark, sf_dir):
    d = page_names(spark, sf_dir).select("name").distinct()
    return d.select("name", F.explode(names.buckets(F.col("name"))).alias("bucket"))


def bin_edges(spark, sf_dir):
    return names.edges(table(spark, sf_dir, "documents").select("n_chars"), "n_chars", 8)


def domain_scores(spark, sf_dir):
    d = page_names(spark, sf_dir).select("name", F.col("url").startswith("https").alias("y"))
    return names.scores(d, names.weights(d)).select("name", F.round("z", 6).alias("z"))


#: Bins, least support of an ending, least hosts of a platform, and the false positive rates that thresholds are set for.
BINS, SUPPORT, TENANTS, RATES = 4, 5, 50, (0.01, 0.05, 0.2)


def labelled_names(spark, sf_dir):
    """registrable, name and y of the names in scope: whether the rules hold an address of the name for a scam. Names whose planted
    addresses disagree are left out, and a page's name counts where no planted address has it."""
    d = links.judged(cases(spark, sf_dir), "link").select("page_id", "host", "registrable", "web", (F.col("level") == "scam").alias("y"))
    d = written(d).where("web")  # read several times below
    scoped = names.in_scope(d, names.platforms(d, TENANTS)).withColumn("source", F.when(F.col("page_id") >= PLANTED, "planted").otherwise("pages"))
    both = names.without_conflicts(scoped.where("source = 'planted'"), scoped.where("source = 'pages'"))
    return written(domain_model.spread(both.select("registrable", names.name_of(F.col("registrable")).alias("name"), "y"), "registrable"))


def named(spark, sf_dir):
    """The labelled names with their scores (to six digits) by weights that follow from counts."""
    rows = labelled_names(spark, sf_dir)
    model = domain_model.layout(rows, BINS, SUPPORT)
    z = domain_model.scores(rows, model, domain_model.counted(rows, model)).select("registrable", F.round("z", 6).alias("z"))
    return written(rows.join(z, "registrable"))


def domain_model_scores(spark, sf_dir):
    return named(spark, sf_dir)


def threshold_rates(spark, sf_dir):
    """For each false positive rate asked for: the threshold, recall, the rate had, and the precision at three prevalences."""
    scored, out = named(spark, sf_dir), None
    for rate in RATES:
        at = training.threshold_at(scored, F.col("z"), F.col("y"), rate).first()["threshold"]  # one number
        row = domain_model.at_threshold(scored, at).select(F.lit(rate).alias("asked"), F.round(F.lit(at), 6).alias("threshold"), *[F.round(k, 6).alias(k) for k in ("recall", "fpr", "precision_1", "precision_10", "precision_30")])
        out = row if out is None else out.unionByName(row)
    return out


def level_matrix(spark, sf_dir):
    """Addresses by their level without and with the name model at its strict threshold."""
    scored = named(spark, sf_dir)
    at = training.threshold_at(scored, F.col("z"), F.col("y"), RATES[-1]).first()["threshold"]
    return domain_model.level_matrix(cases(spark, sf_dir), "link", domain_model.high_names(scored, at))


def domain_model_trained(spark, sf_dir):
    """AUC of the trained model on names that it has not seen, beside models that look at one thing only."""
    rows = labelled_names(spark, sf_dir).withColumn("side", names.side(F.col("name")))
    train, test = rows.where("side = 'train'"), rows.where("side <> 'train'")
    best = domain_model.grid(train, test, (BINS,), (0.003,), SUPPORT)
    made = spark.createDataFrame([(f"trained without {x['without']}" if x["without"] else "trained", x["auc"]) for x in best], "what string, auc double")
    return made.unionByName(domain_model.baselines(test)).select("what", F.round("auc", 6).alias("auc"))


def rank_sample(spark, sf_dir):
    """Hosts drawn from bands of their rank by pages."""
    hosts = page_names(spark, sf_dir).groupBy("host").agg(F.count("*").alias("pages"))
    return names.rank_bands(names.ranked(hosts, "host", "pages"), "host", [(1, 10, 5), (11, 100, 20), (101, 1_000_000, 30)])


def name_split(spark, sf_dir):
    return page_names(spark, sf_dir).select("name").distinct().groupBy(names.side(F.col("name")).alias("side")).agg(F.count("*").alias("n"))


GRAMS = "list_distinct(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, greatest(1, length('^' || name || '$') - k + 2)), lambda i: substr('^' || name || '$', i, k)))))"
FNV = "list_reduce(list_concat([2166136261::bigint], list_transform(string_split({g}, ''), lambda y: ord(y)::bigint)), lambda h, v: (xor(h, v) * 16777619) & 4294967295)"
BUCKET = f"list_distinct(list_transform({GRAMS}, lambda g: {FNV.format(g='g')} % 16384))"


def visible_text_claims(spark, sf_dir):
    t = text.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).alias("visible"), F.size(F.regexp_extract_all(t, F.lit("[0-9][0-9,.]*%?"), F.lit(0))).alias("claims"))


def local_references(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.local_references(F.col("html"))).alias("local"))


VISIBLE = "trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
TOKENS = [t for _, tokens, _ in links.BRANDS for t in tokens if len(t) >= 5]
NUMBERS = f"""length(name) as length, len(regexp_extract_all(name, '[0-9]')) as digits, round(len(regexp_extract_all(name, '[0-9]')) / nullif(length(name), 0)::double, 6) as digit_share, len(regexp_extract_all(name, '-')) as hyphens,
 round(list_sum(list_transform(list_distinct(string_split(name, '')), lambda c: -(len(list_filter(string_split(name, ''), lambda y: y = c)) / length(name)::double) * log2(len(list_filter(string_split(name, ''), lambda y: y = c)) / length(name)::double))), 6) as entropy,
 round(coalesce(len(regexp_extract_all(name, '[aeiou]')) / nullif(len(regexp_extract_all(name, '[a-z]')), 0)::double, 0), 6) as vowel_share, coalesce(list_max(list_transform(regexp_extract_all(name, '[a-z]+'), lambda x: length(x))), 0) as letter_run,
 coalesce(list_max(list_transform(regexp_extract_all(name, '[0-9]+'), lambda x: length(x))), 0) as digit_run, coalesce(list_max(list_transform(regexp_extract_all(name, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0) as consonant_run,
 len(list_distinct(string_split(name, ''))) as "distinct", len(regexp_extract_all(name, '[^-]+')) as parts, {' + '.join(f"case when contains(name, '{k}') then 1 else 0 end" for k in names.KEYWORDS)} as keywords, regexp_matches(name, '^[0-9]')::int as starts_digit,
 len(string_split(registrable, '.')) - 1 as suffix_labels, length(array_to_string(string_split(registrable, '.')[2:], '.')) as suffix_length"""
KIND = """case when input = '' then 'empty' when scheme = 'upi' then 'payment' when scheme in ('tez', 'phonepe', 'paytmmp') and regexp_matches(input, '(?i)[?&]pa=') then 'payment' when regexp_matches(input, '^[A-Za-z0-9._-]{2,}@[A-Za-z]{2,}$') then 'payment'
 when regexp_matches(input, '^[+]?[0-9][0-9 -]{7,14}[0-9]$') then 'phone' when regexp_matches(input, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$') then 'email' when scheme in ('http', 'https', 'javascript', 'data', 'vbscript') then 'link'
 when scheme in ('tel', 'sms', 'smsto', 'mailto', 'geo', 'wifi') then scheme when regexp_matches(input, '(?i)^begin:vcard') then 'contact' when not regexp_matches(input, '[ \\t\\r\\n]') and regexp_matches(input, '[.][A-Za-z]{2,}') then 'link' else 'text' end"""

MEASURED = ["length", "digits", "digit_share", "hyphens", "entropy", "vowel_share", "letter_run", "digit_run", "consonant_run", "distinct", "parts", "keywords", "starts_digit", "suffix_labels", "suffix_length"]
#: Labels of names, bins, endings and n-grams, one row a feature; weights by counts; scores.
NAMED = f"""{flags_sql()}, wb as (select page_id, host, registrable, level = 'scam' as y, page_id >= {PLANTED} as planted from leveled where web),
 pf as (select registrable from wb group by 1 having count(distinct host) >= {TENANTS}),
 sc as (select * from wb where regexp_matches(host, '^[a-z0-9.-]+$') and regexp_matches(host, '[a-z]') and contains(host, '.') and not regexp_matches(host, '^(0x[0-9a-f]+|[0-9]+)([.](0x[0-9a-f]+|[0-9]+))*$') and registrable not in (select registrable from pf)),
 nm as (select registrable, string_split(registrable, '.')[1] as name, y from (select registrable, bool_and(y) as y from sc where planted group by 1 having count(distinct y) = 1 union all select registrable, bool_and(y) from sc where not planted and registrable not in (select registrable from sc where planted) group by 1)),
 nu as (select registrable, y, array_to_string(string_split(registrable, '.')[2:], '.') as ending, {NUMBERS} from nm),
 lg as (select registrable, y, unnest([{', '.join(f"{{'k': '{k}', 'v': round(\"{k}\"::double, 6)}}" for k in MEASURED)}]) as f from nu),
 eg as (select distinct f.k as k, f.v as e from (select f, row_number() over (partition by f.k order by f.v) - 1 as place, count(*) over (partition by f.k) as n from lg) join range(1, {BINS}) t(i) on place = i * n // {BINS}),
 kn as (select ending from nu group by 1 having count(*) >= {SUPPORT}),
 fe as (select l.registrable, l.y, l.f.k || ':' || count(e) filter (where l.f.v > e) as feature, 1.0::double as x, false as gram from lg l left join eg on eg.k = l.f.k group by l.registrable, l.y, l.f.k
  union all select registrable, y, 'ending:' || coalesce(kn.ending, ''), 1.0, false from nu left join kn using (ending)
  union all select registrable, y, 'gram:' || unnest({BUCKET}), 1 / sqrt(len({BUCKET})), true from nm),
 tt as (select count(*) filter (where y) as p, count(*) filter (where not y) as n from nm),
 wt as (select feature, floor((ln((count(*) filter (where y) + 1.0::double) / (any_value(p) + 2)) - ln((count(*) filter (where not y) + 1.0::double) / (any_value(n) + 2))) * 20 + 0.5)::int as q, any_value(gram) as gram, ln((count(*) filter (where y) + 1.0::double) / (any_value(p) + 2)) - ln((count(*) filter (where not y) + 1.0::double) / (any_value(n) + 2)) as w from fe, tt group by feature having count(*) >= 2),
 zs as (select registrable, any_value(nm.name) as name, any_value(nm.y) as y, round(coalesce(sum(case when gram is null or (wt.gram and abs(w) < 0.1) then 0 else q * x end), 0) / 20, 6) as z from nm join (select registrable, feature, x from fe) f using (registrable) left join wt using (feature) group by registrable),
 ng as (select z, row_number() over (order by z) as place, count(*) over () as n from zs where not y),
 th as (select r as asked, min(z) + 1e-9 as threshold from ng, unnest([{', '.join(f'{r}::double' for r in RATES)}]) t(r) where place >= least(n, ceil(n * (1 - r)) + 1) group by r)"""

SQL = {
    "url_parts": f"with {PARTS} select page_id, scheme, userinfo, host, path, query, web, registrable from parts",
    "registrable_domain": f"with {NAMES} select registrable, count(*) as pages, count(distinct host) as hosts from names group by 1",
    "payload_kind": f"with {PARTS} select page_id, {KIND} as kind from parts",
    "url_flags": f"{flags_sql()} select page_id, array_to_string(codes, ',') as codes, weak, shortener, coalesce(brand, '') as brand from leveled",
    "url_verdict": f"{flags_sql()} select page_id, level from leveled",
    "legacy_verdict": f"{flags_sql()} select page_id, case when {KIND} = 'text' then 'caution' when level = 'official' then 'safe' when level = 'scam' then 'danger' else 'caution' end as verdict from leveled",
    "redirect_verdict": f"{flags_sql(REDIRECTED)} select page_id // 4 as page_id, arg_max(level, {RANK} * 4 - page_id % 4) as level, arg_max(host, page_id % 4) as final_host from leveled where page_id % 4 = 0 or web group by 1",
    "level_counts": f"{flags_sql()} select level, count(*) as n, sum(weak)::bigint as weak from leveled group by level",
    "lookalike_hosts": f"with {PARTS}, {NAMES}, u as (select string_split(registrable, '.')[1] as name from names union select string_split(registrable, '.')[1] from parts), t as (select unnest([{', '.join(repr(t) for t in TOKENS)}]) as token) select name, token from u, t where length(name) >= 5 and name <> token and damerau_levenshtein(name, token) <= 1",
    "payment_code_verdict": payments_sql(),
    "platforms": f"with {NAMES} select registrable, count(distinct host) as hosts from names group by 1 having count(distinct host) >= 5",
    "domain_conflicts": f"with {NAMES} select name as registrable, any_value(starts_with(url, 'https')) as y from names group by 1 having count(distinct starts_with(url, 'https')) = 1",
    "artifact_shares": f"with {NAMES}, t as (select starts_with(url, 'https') as y, unnest(['query', 'fragment', 'slash', 'mobile']) as trait, unnest([contains(url, '?')::int, contains(url, '#')::int, ends_with(url, '/')::int, starts_with(host, 'm.')::int]) as has from names) select trait, y, round(avg(has), 6) as share from t group by 1, 2",
    "domain_features": f"with {NAMES}, d as (select distinct name, registrable from names) select name, registrable, {NUMBERS} from d",
    "fnv_buckets": f"with {NAMES}, d as (select distinct name from names) select name, unnest({BUCKET}) as bucket from d",
    "bin_edges": "with s as (select n_chars, row_number() over (order by n_chars) - 1 as place, count(*) over () as n from documents) select i, n_chars as edge from s join range(1, 8) t(i) on place = i * n // 8",
    "domain_scores": f"""with {NAMES}, e as (select name, starts_with(url, 'https') as y, unnest({BUCKET}) as bucket from names), t as (select count(*) filter (where starts_with(url, 'https')) as p, count(*) filter (where not starts_with(url, 'https')) as n from names),
 w as (select bucket, ln((count(*) filter (where y) + 1.0) / (any_value(p) + 2)) - ln((count(*) filter (where not y) + 1.0) / (any_value(n) + 2)) as w from e, t group by bucket having count(*) >= 2), m as (select bucket, floor(w * 20 + 0.5)::int as q from w where abs(w) >= 0.1),
 b as (select name, len({BUCKET}) as n, unnest({BUCKET}) as bucket from (select distinct name from names)) select name, round(coalesce(sum(q), 0) / 20.0 / sqrt(max(n)), 6) as z from b left join m using (bucket) group by name""",
    "domain_model_scores": f"{NAMED} select registrable, name, y, z from zs",
    "threshold_rates": f"""{NAMED}, ra as (select asked, threshold, count(*) filter (where y and z >= threshold) / nullif(count(*) filter (where y), 0)::double as recall, count(*) filter (where not y and z >= threshold) / nullif(count(*) filter (where not y), 0)::double as fpr from zs, th group by 1, 2)
 select asked, round(threshold, 6) as threshold, round(recall, 6) as recall, round(fpr, 6) as fpr, {', '.join(f"round(case when recall * {p} + fpr * (1 - {p}) = 0 then 0 else recall * {p} / (recall * {p} + fpr * (1 - {p})) end, 6) as precision_{round(p * 100)}" for p in (0.01, 0.1, 0.3))} from ra""",
    "level_matrix": f"""{NAMED}, hi as (select registrable from zs where z >= (select threshold from th where asked = {RATES[-1]})), bo as (select level as without, case when level = 'unverified' and web and not shortener and scheme not in ('javascript', 'data', 'vbscript') and registrable in (select registrable from hi) then 'suspicious' else level end as "with" from leveled) select without, "with", count(*) as n from bo group by 1, 2""",
    "rank_sample": f"""with {NAMES}, h as (select host, count(*) as pages from names group by 1), r as (select host, row_number() over (order by pages desc, substr(sha256('rank|' || host), 1, 12) desc) as rank from h),
 b as (select *, case when rank <= 10 then 0 when rank <= 100 then 1 else 2 end as band from r), d as (select *, row_number() over (partition by band order by sha256('draw|' || host), host) as n from b) select host, rank, band from d where n <= [5, 20, 30][band + 1]""",
    "name_split": f"with {NAMES}, h as (select {FNV.format(g='name')} % 100 as h from (select distinct name from names)) select case when h < 70 then 'train' when h < 85 then 'validation' else 'test' end as side, count(*) as n from h group by 1",
    "visible_text_claims": f"select page_id, length({VISIBLE}) as visible, len(regexp_extract_all({VISIBLE}, '[0-9][0-9,.]*%?')) as claims from pages",
    "local_references": "select page_id, len(list_distinct(list_filter(regexp_extract_all(html, '(?i)(href|src)=\"([^\"]+)\"', 2), lambda a: not regexp_matches(a, '(?i)^([a-z][a-z0-9+.-]*:|//|#)')))) as local from pages",
}
QUERIES = {f.__name__: f for f in (
    url_parts, registrable_domain, payload_kind, url_flags, url_verdict, legacy_verdict, redirect_verdict, level_counts, lookalike_hosts, payment_code_verdict, platforms, domain_conflicts, artifact_shares, domain_features,
    fnv_buckets, bin_edges, domain_scores, domain_model_scores, threshold_rates, level_matrix, domain_model_trained, rank_sample, name_split, visible_text_claims, local_references,
)}
