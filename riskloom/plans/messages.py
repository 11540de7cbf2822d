"""Queries on messages and conversations, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assistant, knowledge, lexicon, links, messages
from ..sources.tables import table
from . import links as plan_links

#: Utterances that stand beside the turns, one for each turn by its numbers.
OPENINGS = [
    "Good morning, the minutes of the meeting are attached.", "Urgent! Your KYC will expire today, click the link https://sbi-kyc-verify.xyz/login immediately.", "You have won a lucky draw. Claim your prize, pay a processing fee to receive it.", "Do not share your OTP with anyone.",
    "Please share the OTP and call us back.", "CBI officer here: stay on the video call and do not tell anyone.", "I transferred 5,000 rupees by mistake, please return the money.", "Scan this QR code to receive Rs 2000 cashback.",
    "Your electricity connection will be disconnected, call 9876543210 now.", "Part time job: like videos and earn, income daily guaranteed returns.", "Parcel is held by customs department.", "I lost a lot of money, where can I report this fraud?",
    "hello", "what should i do", "is it safe?", "Enter your UPI PIN to receive money.", "We have your private video. Pay now or we post it.", "My card points will expire, redeem points within 2 hours.", "why", "is digital arrest real?",
    "please forward the o t p now", "p@ssword bhejo, warna khata band hoga", "ｓｈａｒｅ your ＯＴＰ with us", "u​rgent: cl@im your pr1ze and c@ll us b4ck", "kisi ko mat batana. call mat kato, police se bol raha hu", "Your OTP is 4. kisi ko mat batana.", "OTP bejo abhi. kisi ko mat batana.", "खाता बंद हो जाएगा, तुरंत केवाईसी अपडेट करें",
    "మీరు గెలిచారు, డబ్బులు పొందడానికి పిన్ ఎంటర్ చేయండి", "घर बैठे कमाएं, इस नंबर पर कॉल करें", "sim card blo¢k nahi, parcel ruk gaya customs me", "pay 500 to release the parcel within 10 minutes", "n e v e r share your p.i.n. or O-T-P, acc0unt bl0cked", "уоu wоn а lucky draw", "download our app update.apk and pay first for the loan", "is it the 1930 helpline number?",
    "what is digital arrest", "how do i report a fraud online", "can u tell me is the link fake", "I shared the O.T.P. code by mistake, who sees my data?", "who made this tool", "money recoverd kab? wapas", "otp otp", "mera card block how", "parcel stuck at the customs desk of the airport is what the caller who rang me twice said to my wife this morning before lunch time ok",
    "loan app harassing my contacts", "guaranted returns real?", "part-time job: earn or scam", "పార్సెల్ ఎక్కడ ఉంది", "मेरा ओटीपी क्या है",
]
LEXICON = {"pay": ["pay a processing fee", "pay now"], "call": ["stay on the video call", "call us back", "call"], "won": messages.expand("you [have ]won"), "secret": messages.expand("do not (tell|inform) anyone"), "share": ["share the otp", "share your otp"], "number": ["within # hours", "within # minutes"], "other": ["खाता बंद", "మీరు గెలిచారు", "mat batana", "mat batana call"]}


#: Turn numbers of planted utterances begin here.
PLANTED = 1_000_000


def turns(spark, sf_dir):
    """All turns as they are, and beside each a planted utterance (turn numbers from PLANTED on)."""
    form = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), ((F.col("conv_id") * 7 + F.col("turn") * 3) % len(OPENINGS) + 1).cast("int"))
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", "text").unionByName(t.select("conv_id", (F.col("turn") + PLANTED).cast(t.schema["turn"].dataType).alias("turn"), "role", form.alias("text")))


#: Characters of a message that queries read by their SQL, all but `rules_fired`, `rule_weights`, `message_verdict` and `detector_flags`:
#: the library's operators read whole texts, and these queries give them a text's beginning.
BEGINNING = 4000
FIRST = f"substr(text, 1, {BEGINNING})"


def beginning(c):
    return F.substring(c, 1, BEGINNING)


def begun(spark, sf_dir):
    """turns with the beginnings of their texts."""
    return turns(spark, sf_dir).withColumn("text", beginning(F.col("text")))


def whole(sql: str) -> str:
    """SQL that reads whole messages."""
    return sql.replace(FIRST, "text")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OPEN = f"[{', '.join(map(quoted, OPENINGS))}][(conv_id * 7 + turn * 3) % {len(OPENINGS)} + 1]"
TURNS = f"turns as (select conv_id, turn, role, text from conversations union all select conv_id, turn + {PLANTED}, role, {OPEN} from conversations)"
#: Fullwidth letters and digits and what compatibility composition makes of them: all that the planted rows hold of its cases.
WIDE = "".join(chr(0xFEE0 + c) for c in [*range(48, 58), *range(65, 91), *range(97, 123)])
NARROW = "".join(chr(c) for c in [*range(48, 58), *range(65, 91), *range(97, 123)])
#: A text normalised step by step: composition, invisible signs, look-alikes, blanks; letters set apart singly; signs within words.
#: Written with lists, as DuckDB's patterns know no lookaround.
def normal(source: str, out: str, pre: str = "n") -> str:
    """Steps from a table with `text` to one with t, the text normalised, and p, the prepared one."""
    letter = lambda x: f"(({x} >= 'A' and {x} <= 'Z') or ({x} >= 'a' and {x} <= 'z'))"
    apart = lambda x: f"{x} in (' ', '.', '_', '-')"
    one = f"{letter('c[i - 1]')} and {apart('c[i - 2]')} and {letter('c[i - 3]')} and not {letter('c[i - 4]')} and {letter('c[i + 1]')} and not {letter('c[i + 2]')}"
    two = f"{letter('c[i - 1]')} and not {letter('c[i - 2]')} and {letter('c[i + 1]')} and {apart('c[i + 2]')} and {letter('c[i + 3]')} and not {letter('c[i + 4]')}"
    return rf"""{pre}1 as (select *, trim(regexp_replace(translate(regexp_replace(translate(nfc_normalize({FIRST}), '{WIDE}', '{NARROW}'), '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'), 'асеорхуіјѕһνοαρτικАВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧ', 'aceopxyijshvoaptikABCEHIJKMOPSTXYABEZHIKMNOPTYX'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as t from {source}),
 {pre}2 as (select *, string_split(repeat(chr(10), 4) || t || repeat(chr(10), 4), '') as c from {pre}1),
 {pre}3 as (select *, array_to_string(list_transform(list_filter(range(5, len(c) - 3), lambda i: not ({apart('c[i]')} and (({one}) or ({two})))), lambda i: c[i]), '') as j from {pre}2),
 {pre}4 as (select *, list_transform(string_split(j, ' '), lambda x: case when len(regexp_extract_all(x, '[A-Za-z]')) >= 2 and len(regexp_extract_all(x, '[013457@$]')) between 1 and 2 then regexp_replace(x, '[013457@$]', chr(57344), 'g') else x end) as x from {pre}3),
 {out} as (select conv_id, turn, role, text, array_to_string(x, ' ') as t, regexp_replace(lower(array_to_string(x, ' ')), '([0-9]),([0-9])', '\1\2', 'g') as p from {pre}4)"""


NORMAL = normal("turns", "m")
READ_P = f"with {TURNS}, {NORMAL}"


def edge(pattern: str) -> str:
    """A pattern at word edges without lookaround: what stands beside it is matched, too."""
    p = pattern.replace("(?<![0-9])", "").replace("(?![0-9])", "").replace("(?![a-z])", "($|[^a-z])").replace("'", "''")
    return f"(^|[^a-z0-9])({p})($|[^a-z0-9])"


def has(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, '{edge(pattern)}')"


def phrase_hits(spark, sf_dir):
    lex = spark.createDataFrame([(k, i, p) for k, ps in LEXICON.items() for i, p in enumerate(ps)], "id string, ord int, phrase string")
    return messages.phrase_hits(begun(spark, sf_dir), ["conv_id", "turn"], "text", lex)


def rules_fired(spark, sf_dir):
    e = messages.evidence(turns(spark, sf_dir), "text")
    return e.select("conv_id", "turn", F.array_join(F.array_sort(F.transform("evidence", lambda x: x["rule"])), ",").alias("rules"))


def rule_weights(spark, sf_dir):
    """Evidence with quotes; each quote must be part of its message."""
    e = messages.evidence(turns(spark, sf_dir), "text")
    # explode would have a filter on the evidence's size pushed below the rules, which would run twice.
    return e.select("conv_id", "turn", messages.quotes_hold(e).alias("quoted"), F.explode_outer("evidence").alias("e")).where("e is not null").select("conv_id", "turn", "quoted", "e.*")


def message_verdict(spark, sf_dir):
    return messages.verdict(turns(spark, sf_dir), "text").select("conv_id", "turn", "score", "level", "family")


def verdict_by_role(spark, sf_dir):
    return messages.verdict(begun(spark, sf_dir), "text").groupBy("role", "level").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def intent_top1(spark, sf_dir):
    return begun(spark, sf_dir).select("conv_id", "turn", messages.intent(F.col("text")).alias("intent"))


def money_loss(spark, sf_dir):
    return begun(spark, sf_dir).select("conv_id", "turn", messages.money_loss(F.col("text")).alias("loss"))


def small_talk(spark, sf_dir):
    return begun(spark, sf_dir).select("conv_id", "turn", messages.small_talk(F.col("text")).alias("kind"))


def ask_window(spark, sf_dir):
    """Which kinds of secrets a message asks for."""
    p = begun(spark, sf_dir).select("conv_id", "turn", messages.prepared(F.col("text")).alias("p"))
    return p.select("conv_id", "turn", (F.size(messages.asks_for(F.col("p"), messages.CREDENTIALS)) > 0).alias("credential"), (F.size(messages.asks_for(F.col("p"), messages.CODES)) > 0).alias("code"))


def secrecy_guard(spark, sf_dir):
    """Messages whose demand for secrecy counts."""
    e = messages.evidence(begun(spark, sf_dir), "text")
    return e.select("conv_id", "turn", F.exists("evidence", lambda x: x["rule"] == "secrecy").alias("stands"))


def message_link_verdict(spark, sf_dir):
    """Verdicts on messages to which the verdict on their link adds, with the family's intent and advice."""
    d = turns(spark, sf_dir).select("conv_id", "turn", text.link_in(F.col("text")).alias("link"), beginning(F.col("text")).alias("text"))
    of = F.transform("evidence", lambda e: F.struct(e["weight"].alias("weight"), e["family"].alias("family")))
    found = lambda rows: messages.evidence(rows, "text").select("conv_id", "turn", "link", of.alias("evidence"))
    d = links.with_levels(d, "link", "link_level", found)
    return messages.told(messages.scored(d, F.col("link_level"))).select("conv_id", "turn", "link_level", "score", "level", "family", "intent", "advice")


def family_advice(spark, sf_dir):
    return messages.told(messages.verdict(begun(spark, sf_dir), "text")).select("conv_id", "turn", "level", "family", "name", "intent", "advice")


def report_text(spark, sf_dir):
    """The report that a turn's verdict makes, line by line."""
    d = messages.told(messages.verdict(turns(spark, sf_dir).withColumns({"link": text.link_in(F.col("text")), "begins": beginning(F.col("text"))}), "begins"))
    quotes = F.transform("evidence", lambda e: e["quote"])
    return d.select("conv_id", "turn", assistant.report_text(F.col("level"), F.col("name"), F.col("score"), quotes, F.col("link"), F.col("advice")).alias("report"))


def normalised(spark, sf_dir):
    """Turns after normalisation, and whether a second pass changes nothing."""
    once = turns(spark, sf_dir).select("conv_id", "turn", text.normalise(F.col("text")).alias("t"))
    return once.select("conv_id", "turn", F.sha2("t", 256).alias("sha256"), (text.normalise(F.col("t")) == F.col("t")).alias("stable"))


def link_in_text(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", text.link_in(F.col("text")).alias("link")).where("link <> ''")


def followup_topic(spark, sf_dir):
    return begun(spark, sf_dir).select("conv_id", "turn", assistant.followup_topic(F.col("text")).alias("topic"))


def timed(spark, sf_dir):
    """Turns with a verdict and a time: some minutes apart, by conversation. A text that several turns have is judged once."""
    t = turns(spark, sf_dir).withColumn("said", F.sha2("text", 256))
    # Of an aggregate's value each reading would be a column of its own for Python; a key is one.
    judged = messages.verdict(t.select("text").distinct().withColumn("begins", beginning(F.col("text"))), "begins").select(F.sha2("text", 256).alias("said"), F.when(F.col("level") != "nothing", F.col("level")).alias("verdict"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * (600 + F.col("conv_id") % 7 * 900))
    return t.join(judged, "said").select("conv_id", "turn", "text", at.alias("ts"), "verdict")


def followup_asof(spark, sf_dir):
    return assistant.last_verdict(timed(spark, sf_dir), "conv_id", "ts", "verdict").select("conv_id", "turn", "remembered")


def followup_replies(spark, sf_dir):
    d = assistant.last_verdict(timed(spark, sf_dir), "conv_id", "ts", "verdict")
    return d.select("conv_id", "turn", assistant.followup_reply(assistant.followup_topic(beginning(F.col("text"))), F.coalesce("remembered", F.lit("none"))).alias("reply"))


def route_case(spark, sf_dir):
    b = messages.verdict(turns(spark, sf_dir).withColumn("begins", beginning(F.col("text"))), "begins").select("conv_id", "turn", "text", "level", text.link_in(F.col("text")).alias("link"))
    b = b.join(knowledge_rank(spark, sf_dir).where("rank = 1").select("conv_id", "turn", "entry"), ["conv_id", "turn"], "left")
    return b.select("conv_id", "turn", assistant.route(F.col("text"), F.col("link"), F.col("level"), F.when(F.col("turn") > 1, "scam"), F.lit(False), F.col("entry"), beginning(F.col("text"))).alias("route"))


def incomplete_utterance(spark, sf_dir):
    return begun(spark, sf_dir).select("conv_id", "turn", assistant.incomplete(F.col("text")).alias("incomplete"))


def questions(spark, sf_dir):
    return begun(spark, sf_dir).select("conv_id", "turn", assistant.is_question(F.col("text")).alias("question"))


def knowledge_idf(spark, sf_dir):
    """Word weights over the turns of each conversation as entries."""
    each = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("entry"), F.explode(text.words(F.col("text"), "[a-z]+")).alias("word"))
    return assistant.idf(each)


def known(spark, sf_dir):
    """Patterns that the turns which may be questions meet."""
    t = begun(spark, sf_dir).select("conv_id", "turn", assistant.is_question(F.col("text")).alias("q"), knowledge.tokens(F.col("text")).alias("t"))
    # Tokens of other turns become null in place: a filter would be pushed below them, and they would be made twice.
    asked = t.select("conv_id", "turn", F.when(knowledge.askable(F.col("t"), F.col("q")), F.col("t")).alias("t"))
    return knowledge.met_patterns(asked, ["conv_id", "turn"], "t")


def knowledge_rank(spark, sf_dir):
    """Every entry that a turn asks for, best first, with the margin to the next."""
    return knowledge.rank(known(spark, sf_dir), ["conv_id", "turn"])


def knowledge_route(spark, sf_dir):
    """The entry that answers each turn, if any."""
    best = knowledge_rank(spark, sf_dir).where("rank = 1").drop("rank")
    return turns(spark, sf_dir).select("conv_id", "turn").join(best, ["conv_id", "turn"], "left")


def knowledge_reach(spark, sf_dir):
    """How many turns met each pattern; 0 for those that nothing reached."""
    return knowledge.reach(spark, known(spark, sf_dir), ["conv_id", "turn"])


def knowledge_unreached(spark, sf_dir):
    """Entries that no turn asks for."""
    return knowledge.unreached(spark, known(spark, sf_dir))


def sql_list(ws) -> str:
    return "[" + ", ".join(map(quoted, dict.fromkeys(ws))) + "]"


def sql_fold(t: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({t}, 'wzq', 'vjk'), 'aa+', 'a', 'g'), 'ee+|ii+', 'i', 'g'), 'oo+|uu+', 'u', 'g'), '([bcdgjkpt])h', '\1', 'g')"


def found(t: str, pattern: str) -> str:
    return f"regexp_extract_all({t}, '{edge(pattern)}', 2)"


def asked(secrets) -> str:
    """Whether a verb among the tokens w asks for one of the secrets."""
    fold = lambda ws: sql_list(messages.folded(x) for x in ws)
    undone = lambda i: f"coalesce(list_contains({sql_list(messages.AFTER)}, w[{i}]) and list_contains({fold(messages.AFTER_VERBS)}, w[{i} + 1]), false)"
    verb = f"(list_contains({fold(messages.ASKS)}, w[i]) or coalesce(list_contains({fold(messages.STEMS)}, w[i]) and list_contains({fold(messages.HELPERS)}, w[i + 1]), false))"
    near = f"(list_has_any(w[i + 1 : i + 6], {fold(secrets)}) or list_has_any(w[greatest(1, i - 3) : i - 1], {fold(secrets)}))"
    return f"list_filter(range(1, len(w) + 1), lambda i: {verb} and not list_has_any(w[greatest(1, i - 5) : i - 1], {fold(messages.NEGATORS)}) and not {undone('i + 1')} and not {undone('i + 2')} and {near})[1]"


def demands(t: str, pattern: str) -> str:
    about = lambda x: f"coalesce(regexp_matches({x}, '{edge(messages.ABOUT)}'), false)"
    return f"list_transform(list_filter(range(1, len({t}) + 1), lambda i: regexp_matches({t}[i], '{edge(pattern)}') and (ac or ao or not ({about(f'{t}[i]')} or {about(f'{t}[i - 1]')}))), lambda i: regexp_extract({t}[i], '{edge(pattern)}', 2))"


def rule_found(rule: str) -> str:
    """The different things that a rule finds, in order: matches of its pattern, then quotes of its phrases."""
    _, _, patterns, lists = messages.RULES[rule]
    if rule in ("ask-credential", "ask-secret"):
        return f"case when {'ac' if rule == 'ask-credential' else 'ao'} then [w[{'ic' if rule == 'ask-credential' else 'io'}]] else [] end"
    if rule == "secrecy":
        return f"list_concat({demands('ps', patterns[0])}, list_transform(list_filter(coalesce(\"secrecy\", []), lambda h: ac or ao or not h.about), lambda h: h.q))"
    where = " and ".join([*(has("p", x) for x in patterns), *([has("regexp_replace(p, '(will|would|shall|they|he|she) (return|refund|send)', '', 'g')", patterns[2])] if rule == "wrong-transfer" else [])])
    own = f"case when {where} then {found('p', patterns[0])} else [] end" if patterns else "[]"
    fed = f"case when {' and '.join(f'\"{x}\" is not null' for x in lists)} then list_transform(\"{lists[0]}\", lambda h: h.q) else [] end" if lists else "[]"
    return f"list_concat({own}, {fed})"


ASKING = edge("|".join(w for w in messages.ASKS if w.isascii()))
AT_DOOR = f"array_to_string(list_transform(string_split_regex(p, '{messages.SENTENCE_END}'), lambda s: case when {has('s', messages.DOOR)} and {has('s', 'otp')} then regexp_replace(s, '{ASKING}', '\\1x\\3', 'g') else s end), ' ')"
PAIRED = f"regexp_replace(case when p like '%delivery%' then {AT_DOOR} else p end, '(card|bank|account|security|verification) (number|details|code)', '\\1\\2', 'g')"
SQL_TOKEN = quoted(lexicon.TOKEN)
SQL_BETWEEN = quoted(lexicon.BETWEEN)
CLEARED = f"list_transform(regexp_extract_all({sql_fold(PAIRED)}, {SQL_TOKEN}), lambda x: case when contains(x, chr(57344)) then coalesce(list_filter({sql_list(messages.ASKING)}, lambda v: v like replace(x, chr(57344), '_'))[1], x) else x end)"
PHRASES = ", ".join(f"('{k}', {i}, {quoted(p)})" for k, i, p in lexicon.phrases())
ABOUT = lambda x: f"coalesce(regexp_matches({x}, '{edge(messages.ABOUT)}'), false)"
#: Hits of phrases as a join of all windows of up to nine tokens with all phrases: equal ones, and those that a window with ANY is like.
HITS = f"""lex as materialized (select id, ord, len(string_split(phrase, ' ')) as n, {sql_fold('phrase')} as f from (values {PHRASES}) v(id, ord, phrase)),
 k as materialized (select *, regexp_extract_all(p, {SQL_TOKEN}) as tk, string_split_regex(p, '{messages.SENTENCE_END}') as ps, {CLEARED} as w from m),
 fd as materialized (select conv_id, turn, p, tk, ps, list_transform(tk, lambda x: case when regexp_matches(x, '^[0-9]+$') then '#' else {sql_fold('x')} end) as fk from k),
 spots as (select conv_id, turn, unnest(range(0, len(tk))) as pos from fd),
 wins as materialized (select conv_id, turn, pos, n, array_to_string(fk[pos + 1 : pos + n], ' ') as s, array_to_string(tk[pos + 1 : pos + n], ' ') as q from spots join fd using (conv_id, turn), range(1, 10) r(n) where pos + n <= len(tk)),
 met as (select conv_id, turn, pos, q, id, ord from wins x join lex l on x.s = l.f and x.n = l.n union all select conv_id, turn, pos, q, id, ord from wins x join lex l on x.n = l.n and contains(x.s, chr(57344)) and l.f like replace(x.s, chr(57344), '_')),
 best as (select conv_id, turn, pos, id, arg_min(q, ord) as q from met group by 1, 2, 3, 4),
 placed as (select b.*, ps, regexp_extract(p, array_to_string(list_transform(string_split(q, ' '), lambda x: regexp_escape(x)), {SQL_BETWEEN})) as said, case when id = 'secrecy' then len(list_filter(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1 : i], lambda x: len(regexp_extract_all(x, {SQL_TOKEN})))) <= pos)) end as sn from best b join fd using (conv_id, turn)),
 lead as (select conv_id, turn, pos, id, {{'q': said, 'about': {ABOUT('ps[sn + 1]')} or {ABOUT('ps[sn]')}}} as h from placed),
 hits as (select conv_id, turn, {', '.join(f"list(h order by pos) filter (where id = '{x}') as \"{x}\"" for x in lexicon.PATTERNS)} from lead group by 1, 2)"""
READ = f"""{READ_P}, {HITS}, q as (select k.*, {asked(messages.CREDENTIALS)} as ic, {asked(messages.CODES)} as io from k), g as (select *, ic is not null as ac, io is not null as ao from q),
 c as (select conv_id, turn, p, ac, ao, {', '.join(f"list_distinct({rule_found(r)}) as l{i}, ({rule_found(r)})[1] as q{i}, len(l{i}) as n{i}" for i, r in enumerate(messages.RULES))} from g left join hits using (conv_id, turn))"""
FIRED = READ_P
KEY = lambda w: "(^|[^a-z0-9])" + "".join(f"[{c}]" if c.isalnum() else c for c in w) + "($|[^a-z0-9])"
INTENT = ", ".join(f"{{'n': {' + '.join(f"regexp_matches(p, '{KEY(w)}')::int" for w in words)}, 'i': {-i}, 'k': '{k}'}}" for i, (k, words) in enumerate(messages.INTENTS))
TOPIC = f"case when len(list_filter(string_split(p, ' '), lambda w: w <> '')) <= 14 then case {' '.join(f"when regexp_matches(p, '{pat}') then '{k}'" for k, pat in assistant.TOPICS)} end end"
DANGLING = ", ".join(f"'{w}'" for w in assistant.DANGLING)

QUESTION = "len(list_filter(string_split(p, ' '), lambda w: w <> '')) <= 24 and (regexp_matches(p, '[?]$') or regexp_matches(p, '^(who|what|when|where|why|how|can|should|is|are|do|does|will|kya|kaise|kab)($|[^a-z])'))"
FORMS = " ".join(f"when '{k}' then '{v}'" for k, v in knowledge.TEXTING.items())
ALTERNATIVES = ", ".join(f"('{e}', {place}, {p}, {n}, {g}, {a}, '{w}')" for e, place, p, n, g, a, w in knowledge.alternatives(knowledge.ENTRIES))
#: Alternatives with their weights; all places where each is met; then group by group the weightiest that is free, as a chain of steps.
KNOWN = f"""{READ_P}, al as materialized (select *, string_split(words, ' ') as ws from (values {ALTERNATIVES}) v(entry, place, pattern, groups, g, alt, words)),
 used as (select rtrim(unnest(ws), '~') as word, entry from al), df as (select word, case when list_contains({sql_list(sorted(knowledge.STOP))}, word) then 0 else ln((select count(distinct entry) from used) / count(distinct entry)::double) end as idf from used group by word),
 worth as (select pattern, g, alt, max(idf) as b from (select pattern, g, alt, rtrim(unnest(ws), '~') as word from al) join df using (word) group by 1, 2, 3),
 alts as materialized (select al.*, len(ws) as n, case when len(ws) > 1 then greatest(2.2, b + 0.4 * (len(ws) - 1)) when b = 0 then 0.25 else b end as w from al join worth using (pattern, g, alt)),
 said as (select conv_id, turn, {QUESTION} as q, list_transform(regexp_extract_all(regexp_replace(lower(translate(nfc_normalize({FIRST}), '{WIDE}', '{NARROW}')), '[''’]', '', 'g'), '{knowledge.TOKEN}'), lambda x: case replace(x, '-', '') {FORMS} else replace(x, '-', '') end) as t from m),
 asked as materialized (select * from said where len(t) between 1 and 24 and (len(t) <= 4 or q or list_has_any(t, {sql_list(knowledge.FIRST_PERSON)}) or list_contains({sql_list(knowledge.ORDERS)}, t[1]))),
 spots as materialized (select conv_id, turn, t, unnest(range(0, len(t))) as pos from asked),
 hits as materialized (select conv_id, turn, entry, place, pattern, groups, g, alt, w, pos, n from spots, alts where pos + n <= len(t) and len(list_filter(range(1, n + 1), lambda j: t[pos + j] = ws[j] or (ws[j][-1] = '~' and starts_with(t[pos + j], rtrim(ws[j], '~'))) or (ws[j][-1] <> '~' and length(ws[j]) >= 5 and length(t[pos + j]) >= 5 and {sql_fold('t[pos + j]')} = {sql_fold('ws[j]')}))) = n),
 s0 as (select conv_id, turn, entry, place, pattern, groups, range(pos, pos + n) as taken, w * w as score, w >= 1.6 as rare from hits where g = 0 qualify row_number() over (partition by conv_id, turn, pattern order by w desc, alt, pos) = 1),
 s1 as (select s.conv_id, s.turn, s.entry, s.place, s.pattern, s.groups, list_concat(s.taken, range(h.pos, h.pos + h.n)) as taken, s.score + h.w * h.w as score, s.rare or h.w >= 1.6 as rare from s0 s join hits h on h.conv_id = s.conv_id and h.turn = s.turn and h.pattern = s.pattern and h.g = 1 where not list_has_any(s.taken, range(h.pos, h.pos + h.n)) qualify row_number() over (partition by s.conv_id, s.turn, s.pattern order by h.w desc, h.alt, h.pos) = 1),
 s2 as (select s.conv_id, s.turn, s.entry, s.place, s.pattern, s.groups, s.score + h.w * h.w as score, s.rare or h.w >= 1.6 as rare from s1 s join hits h on h.conv_id = s.conv_id and h.turn = s.turn and h.pattern = s.pattern and h.g = 2 where not list_has_any(s.taken, range(h.pos, h.pos + h.n)) qualify row_number() over (partition by s.conv_id, s.turn, s.pattern order by h.w desc, h.alt, h.pos) = 1),
 met as (select conv_id, turn, entry, place, pattern, round(score, 6) as score from (select conv_id, turn, entry, place, pattern, score, rare from s0 where groups = 1 union all select conv_id, turn, entry, place, pattern, score, rare from s1 where groups = 2 union all select conv_id, turn, entry, place, pattern, score, rare from s2 where groups = 3) where rare),
 best as (select conv_id, turn, entry, place, max(score) as score from met group by 1, 2, 3, 4),
 ranks as (select conv_id, turn, row_number() over o as rank, entry, score, round(score - lead(score) over o, 6) as margin from best window o as (partition by conv_id, turn order by score desc, place))"""

SQL = {
    "rules_fired": whole(f"{READ} select conv_id, turn, array_to_string(list_sort(list_filter([{', '.join(f"case when n{i} > 0 then '{r}' end" for i, r in enumerate(messages.RULES))}], lambda x: x is not null)), ',') as rules from c"),
    "ask_window": f"{READ} select conv_id, turn, ac as credential, ao as code from c",
    "secrecy_guard": f"{READ} select conv_id, turn, n{list(messages.RULES).index('secrecy')} > 0 as stands from c",
    "intent_top1": f"{FIRED}, i as (select conv_id, turn, list_sort([{INTENT}], 'desc')[1] as b from m) select conv_id, turn, case when b.n > 0 then b.k end as intent from i",
    "money_loss": f"{FIRED} select conv_id, turn, {has('p', messages.LOSS)} as loss from m",
    "small_talk": f"{READ_P} select conv_id, turn, case {' '.join(f"when regexp_matches(p, '{p.replace('(?![a-z])', '($|[^a-z])')}') then '{k}'" for k, p in messages.SMALL_TALK)} end as kind from m",
    "followup_topic": f"{READ_P} select conv_id, turn, {TOPIC} as topic from m",
    "incomplete_utterance": f"{READ_P} select conv_id, turn, p = '' or string_split(regexp_replace(p, '[^a-z0-9'' ]+', '', 'g'), ' ')[-1] in ({DANGLING}) or regexp_matches(p, '([.]{{3}}|…|,|-)$') as incomplete from m",
    "questions": f"{READ_P} select conv_id, turn, len(list_filter(string_split(p, ' '), lambda w: w <> '')) <= 24 and (regexp_matches(p, '[?]$') or regexp_matches(p, '^(who|what|when|where|why|how|can|should|is|are|do|does|will|kya|kaise|kab)($|[^a-z])')) as question from m",
    "knowledge_idf": "with w as (select distinct conv_id as entry, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from conversations) select word, count(*) as df, round(ln((select count(distinct entry) from w) / count(*)::double), 6) as idf from w group by word",
    "knowledge_rank": f"{KNOWN} select conv_id, turn, rank::int as rank, entry, score, margin from ranks",
    "knowledge_route": f"{KNOWN} select conv_id, turn, entry, score, margin from turns left join (select * from ranks where rank = 1) using (conv_id, turn)",
    "knowledge_reach": f"{KNOWN} select entry, a.pattern, count(distinct (m.conv_id, m.turn)) filter (where m.pattern is not null) as questions from (select distinct entry, pattern from al) a left join (select conv_id, turn, pattern from met) m on m.pattern = a.pattern group by 1, 2",
    "knowledge_unreached": f"{KNOWN} select distinct entry from al where entry not in (select entry from met)",
    "phrase_hits": f"""{READ_P}, k as (select conv_id, turn, regexp_extract_all(p, {SQL_TOKEN}) as tk from m), l as (select id, ord, phrase, len(string_split(phrase, ' ')) as n, {sql_fold('phrase')} as f from (values {', '.join(f"('{k}', {i}, '{p}')" for k, ps in LEXICON.items() for i, p in enumerate(ps))}) v(id, ord, phrase)),
 p as (select conv_id, turn, list_transform(tk, lambda x: case when regexp_matches(x, '^[0-9]+$') then '#' else {sql_fold('x')} end) as fk, unnest(range(0, len(tk))) as pos from k),
 h as (select conv_id, turn, pos, id, ord, phrase from p, l where len(fk) >= pos + n and f like replace(array_to_string(fk[pos + 1 : pos + n], ' '), chr(57344), '_'))
 select conv_id, turn, pos::int as pos, id, arg_min(phrase, ord) as phrase from h group by 1, 2, 3, 4""",
}
SCORE = " + ".join(f"case when n{i} > 0 then {w}{f' + least(2, n{i} - 1)' if w >= 2 else ''} else 0 end" for i, (w, _, _, _) in enumerate(messages.RULES.values()))
FAMILY = "case " + " ".join(f"when {' or '.join(f'n{i} > 0' for i, (_, g, _, _) in enumerate(messages.RULES.values()) if g == f)} then '{f}'" for f in messages.FAMILIES) + " end"
VERDICTS = f"{READ}, v as (select conv_id, turn, {SCORE} as score, {FAMILY} as family from c), lv as (select *, case when score >= 5 then 'scam' when score >= 3 then 'suspicious' else 'nothing' end as level from v)"
BEGUN_VERDICT = f"{VERDICTS} select conv_id, turn, score, level, family from lv"
SQL["message_verdict"] = whole(BEGUN_VERDICT)
ADVICE = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (k, *v)) + ")" for k, v in messages.ABOUT_FAMILIES.items())
SQL["family_advice"] = f"{VERDICTS} select conv_id, turn, level, family, a.name, case when level <> 'nothing' then a.intent end as intent, case when level <> 'nothing' then a.advice else 'Nothing known was found; that does not make it genuine.' end as advice from lv left join (values {ADVICE}) a(fam, name, intent, advice) on fam = family"
SQL["verdict_by_role"] = f"{VERDICTS} select role, level, count(*) as n, sum(score)::bigint as score from lv join turns c using (conv_id, turn) group by 1, 2"
SQL["followup_asof"] = f"""{VERDICTS}, t as (select conv_id, turn, turn * (600 + conv_id % 7 * 900) as s, case when level <> 'nothing' then level end as v from lv)
 select a.conv_id, a.turn, (select arg_max(b.v, b.s) from t b where b.conv_id = a.conv_id and b.v is not null and b.s < a.s and b.s >= a.s - 3600) as remembered from t a"""
EACH = ", ".join(f"{{'rule': '{r}', 'family': '{f}', 'weight': {w}{f' + least(2, n{i} - 1)' if w >= 2 else ''}, 'quote': q{i}, 'count': n{i}}}" for i, (r, (w, f, _, _)) in enumerate(messages.RULES.items()))
SQL["rule_weights"] = whole(f"{READ}, r as (select conv_id, turn, unnest(list_filter([{EACH}], lambda x: x['count'] > 0)) as e from c) select conv_id, turn, true as quoted, e['rule'] as rule, e['family'] as family, e['weight'] as weight, e['quote'] as quote, e['count'] as \"count\" from r")
SQL["normalised"] = f"{READ_P}, again as (select conv_id, turn, role, t as text from m), {normal('again', 'twice', 'o')} select conv_id, turn, sha256(m.t) as sha256, m.t = o.t as stable from m join twice o using (conv_id, turn)"
LINK = lambda t: rf"""regexp_replace(list_first(list_filter([regexp_extract({t}, '(?i)((https?://|upi://|www[.])[^\s<>"]+)|(^|[^A-Za-z0-9@.-])(([a-z0-9-]+[.])+(com|net|org|in|info|xyz|top|io|co|app|link)(/[^\s<>"]*)?)($|[^A-Za-z0-9])', 1), regexp_extract({t}, '(?i)((https?://|upi://|www[.])[^\s<>"]+)|(^|[^A-Za-z0-9@.-])(([a-z0-9-]+[.])+(com|net|org|in|info|xyz|top|io|co|app|link)(/[^\s<>"]*)?)($|[^A-Za-z0-9])', 4), ''], lambda x: x <> '')), '[)\]}}>.,;:!?''"]+$', '')"""
SQL["link_in_text"] = f"with {TURNS} select conv_id, turn, {LINK('text')} as link from turns where {LINK('text')} <> ''"
LINKED = plan_links.flags_sql(f"{TURNS}, told as (select distinct {LINK('text')} as link from turns), cases as (select row_number() over (order by link) as page_id, link from told where link <> '')")
SQL["message_link_verdict"] = f"""{VERDICTS}, t as (select conv_id, turn, {LINK('text')} as link from turns), u as (select * from ({LINKED} select link, level as link_level from leveled)),
 b as (select conv_id, turn, link_level, score + case link_level when 'scam' then 5 when 'suspicious' then 3 when 'unverified' then 1 else 0 end as score, coalesce(family, case when link_level = 'scam' then 'kyc' when link_level in ('suspicious', 'unverified') then 'contact' end) as family from lv join t using (conv_id, turn) left join u using (link)),
 l as (select *, case when score >= 5 then 'scam' when score >= 3 then 'suspicious' else 'nothing' end as level from b)
 select conv_id, turn, link_level, score, level, family, case when level <> 'nothing' then a.intent end as intent, case when level <> 'nothing' then a.advice else 'Nothing known was found; that does not make it genuine.' end as advice from l left join (values {ADVICE}) a(fam, name, intent, advice) on fam = family"""
SQL["followup_replies"] = f"""with r as (select * from ({SQL['followup_asof']})), k as (select * from ({SQL['followup_topic']}))
 select conv_id, turn, case when topic is null then null when topic = 'safe' then case when remembered in ('scam', 'suspicious') then 'no' else 'cannot-confirm' end else topic || case when remembered in ('scam', 'suspicious') then '-flagged' else '-open' end end as reply from r join k using (conv_id, turn)"""
SQL["route_case"] = f"""{READ_P}, v as (select * from ({BEGUN_VERDICT})), k as (select * from ({SQL['knowledge_route']})), f as (select * from ({SQL['followup_topic']})), i as (select * from ({SQL['intent_top1']})), o as (select * from ({SQL['money_loss']})), s as (select * from ({SQL['small_talk']})),
 j as (select conv_id, turn, text, p, coalesce({LINK('text')}, '') as link, level, entry, topic, intent, loss, kind from m join v using (conv_id, turn) join k using (conv_id, turn) join f using (conv_id, turn) join i using (conv_id, turn) join o using (conv_id, turn) join s using (conv_id, turn))
 select conv_id, turn, case when link <> '' and length(link) >= 0.8 * length(text) then 'link' when level in ('scam', 'suspicious') and not regexp_matches(p, '^(i|my|me|we|mera|maine)($|[^a-z])') then 'message' when link <> '' then 'contains-link'
  when turn > 1 and topic is not null then 'follow-up' when entry is not null then 'knowledge' when intent is not null then 'intent' when loss then 'money-loss' when regexp_matches(p, 'my name is [a-z]{{2,20}}') then 'name' when kind is not null then 'small-talk' when length(text) >= 60 then 'late-analysis' else 'unanswered' end as route from j"""
SAID = f"list_transform(list_filter([{', '.join(f'case when n{i} > 0 then q{i} end' for i in range(len(messages.RULES)))}], lambda x: x is not null)[1 : 4], lambda x: '\"' || x || '\"')"
SQL["report_text"] = f"""{READ}, s as (select conv_id, turn, {SAID} as said from c), v as (select * from ({SQL['family_advice']})), w as (select * from ({BEGUN_VERDICT})), t as (select conv_id, turn, {LINK('text')} as link from turns)
 select conv_id, turn, concat_ws(chr(10), case when v.level = 'nothing' then 'No known pattern was found.' else 'Looks like ' || coalesce(name, 'a fraud') || ' (' || v.level || ', score ' || score || ').' end, case when len(said) > 0 then 'Words: ' || array_to_string(said, ', ') || '.' end, case when link <> '' then 'Link: ' || link end, advice,
  case when v.level <> 'nothing' then 'Report it: call 1930 or go to cybercrime.gov.in.' end) as report from s join v using (conv_id, turn) join w using (conv_id, turn) join t using (conv_id, turn)"""
QUERIES = {f.__name__: f for f in (
    phrase_hits, rules_fired, rule_weights, message_verdict, verdict_by_role, intent_top1, money_loss, small_talk, ask_window, secrecy_guard, message_link_verdict, family_advice, report_text, normalised, link_in_text, followup_topic, followup_asof, followup_replies,
    route_case, incomplete_utterance, questions, knowledge_idf, knowledge_route, knowledge_rank, knowledge_reach, knowledge_unreached,
)}
