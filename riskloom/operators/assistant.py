"""Routing of what a user says: follow-ups, questions with known answers, unfinished utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import messages

#: Follow-up topics in order; the first that fits counts, in utterances of at most 14 words.
TOPICS = [
    ("why", "^why|how do you know|what makes"), ("sure", "are you sure|really|certain"), ("safe", "is it (?:safe|real|genuine|ok)"), ("next", "what (?:should|do|can) i do|what now|next"),
    ("paid", "i (?:already )?(?:paid|sent|transferred)"), ("clicked", "i (?:already )?(?:clicked|opened|tapped)"), ("shared", "i (?:already )?(?:shared|gave|told)"), ("report", "(?:where|how) (?:do|can|to) (?:i )?report|complain"), ("block", "block (?:it|them|him|her|this)"),
]
DANGLING = ["a", "an", "and", "but", "for", "if", "in", "is", "my", "of", "or", "the", "to", "with"]


def followup_topic(c: Column) -> Column:
    t = messages.prepared(c)
    short = F.size(F.filter(F.split(t, " "), lambda w: w != "")) <= 14
    return F.when(short, F.coalesce(*[F.when(t.rlike(p), k) for k, p in TOPICS]))


def followup_reply(topic: Column, level: Column) -> Column:
    """What a reply is about. Asked whether something is safe, the answer is never yes."""
    flagged = level.isin("scam", "suspicious")
    return F.when(topic.isNull(), None).when(topic == "safe", F.when(flagged, "no").otherwise("cannot-confirm")).otherwise(F.concat(topic, F.when(flagged, "-flagged").otherwise("-open")))


def last_verdict(df: DataFrame, key: str, ts: str, verdict: str) -> DataFrame:
    """df with the session's latest verdict of the hour before each row."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-3_600_000_000, -1)
    return df.withColumn("remembered", F.last(verdict, ignorenulls=True).over(w))


def incomplete(c: Column) -> Column:
    """Whether an utterance breaks off: nothing, an open word at the end, or trailing dots."""
    t = messages.prepared(c)
    last = F.element_at(F.split(F.regexp_replace(t, "[^a-z0-9' ]+", ""), " "), -1)
    return (t == "") | last.isin(*DANGLING) | t.rlike("(?:[.]{3}|…|,|-)$")


def is_question(c: Column) -> Column:
    t = messages.prepared(c)
    words = F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    return (words <= 24) & (t.rlike("[?]$") | t.rlike("^(?:who|what|when|where|why|how|can|should|is|are|do|does|will|kya|kaise|kab)(?![a-z])"))


def route(c: Column, link: Column, level: Column, remembered: Column, awaiting: Column, known: Column, said: Column | None = None) -> Column:
    """What answers a user's text: the first of these that holds. known: the entry that a question met (operators/knowledge.py).
    said: what the rules read, if not the text."""
    share = F.length(link) >= 0.8 * F.length(c)
    r = c if said is None else said
    first_person = messages.prepared(r).rlike("^(?:i|my|me|we|mera|maine)(?![a-z])")
    return (
        F.when(awaiting & (link != ""), "awaited-link").when((link != "") & share, "link").when(level.isin("scam", "suspicious") & ~first_person, "message").when(link != "", "contains-link")
        .when(remembered.isNotNull() & followup_topic(r).isNotNull(), "follow-up").when(known.isNotNull(), "knowledge").when(messages.intent(r).isNotNull(), "intent").when(messages.money_loss(r), "money-loss")
        .when(messages.prepared(r).rlike("my name is [a-z]{2,20}"), "name").when(messages.small_talk(r).isNotNull(), "small-talk").when(F.length(c) >= 60, "late-analysis").otherwise("unanswered")
    )


def idf(entries: DataFrame) -> DataFrame:
    """word, df, idf = ln(entries / df). entries: entry, word."""
    n = entries.agg(F.count_distinct("entry").alias("n"))
    return entries.groupBy("word").agg(F.count_distinct("entry").alias("df")).crossJoin(F.broadcast(n)).select("word", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))  # one row


def speech_provider(agent: Column) -> Column:
    """Which speech service a browser's name stands for; the first that fits."""
    return F.when(agent.rlike("Edg/"), "edge").when(agent.rlike("OPR/|SamsungBrowser"), "none").when(agent.rlike("Chrome/"), "google").when(agent.rlike("Safari/"), "apple").otherwise("none")


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """flow, node and steps (the fewest) of a dialogue graph (flow, node, next) that lead from each flow's start to a node; circles end.

    Each round takes the nodes that the round before was the first to meet one step on and drops those known already. Spark's
    recursive queries have no form that drops known rows, so circles would not end there. Only counts reach the driver, and each
    round is written to the shared checkpoint folder.
    """
    from ..session import written

    steps = edges.where("next is not null").select("flow", "node", "next").distinct()
    new = written(edges.where(F.col("node") == start).select("flow", "node").distinct().withColumn("steps", F.lit(0)))
    known, n = new, 0
    while new.limit(1).count():
        n += 1
        met = new.join(steps, ["flow", "node"]).select("flow", F.col("next").alias("node")).distinct()
        new = written(met.join(known, ["flow", "node"], "left_anti").withColumn("steps", F.lit(n)))
        known = known.unionByName(new)
    return known


def quiz_scores(answers: DataFrame, key: DataFrame, messages_by_score: dict[int, str]) -> DataFrame:
    """person, score and message; answers: person, question, option; key: question, correct."""
    scored = answers.join(F.broadcast(key), "question").groupBy("person").agg(F.count_if(F.col("option") == F.col("correct")).alias("score"))  # a quiz's key is a few rows
    told = F.create_map(*[F.lit(x) for kv in messages_by_score.items() for x in kv])
    return scored.withColumn("message", F.coalesce(F.element_at(told, F.col("score").cast("int")), F.lit(messages_by_score[0])))


def suggestions(questions: DataFrame, entries: DataFrame, weights: DataFrame, starters: list[str], n: int = 3) -> DataFrame:
    """key, rank, entry: the n entries whose words shared with a question weigh most, filled up with the starters in order.

    questions: key, word; entries: entry, ord, word; weights: word, idf. Words meet by an equal join, weighed before questions are ranked.
    """
    known = entries.join(weights, "word").select("entry", "ord", "word", "idf").distinct()
    worth = questions.distinct().join(F.broadcast(known), "word").groupBy("key", "entry", "ord").agg(F.sum("idf").alias("worth")).where("worth > 0")  # entries: a written list
    order = lambda worth, ord: F.struct((-worth).alias("w"), ord.alias("o"))
    near = worth.select("key", "entry", order(F.col("worth"), F.col("ord")).alias("at"))
    filler = F.array(*[F.struct(F.lit(e).alias("entry"), order(F.lit(-1e9 - i), F.lit(i).cast(entries.schema["ord"].dataType)).alias("at")) for i, e in enumerate(starters)])
    more = questions.select("key").distinct().select("key", F.explode(filler).alias("x")).select("key", "x.entry", "x.at")
    best = near.unionByName(more).groupBy("key", "entry").agg(F.min("at").alias("at"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where(F.col("rank") <= n).select("key", "rank", "entry")


def segments(df: DataFrame, key: str, text_col: str, flags: list[tuple[str, str]]) -> DataFrame:
    """key and `segments` (text, label): the text cut at each phrase's first place, unlabelled between; null if a phrase is missing or two overlap."""
    t = F.col(text_col)
    hits = F.array_sort(F.array(*[F.struct(F.locate(p, t).alias("at"), (F.locate(p, t) + len(p)).alias("end"), F.lit(label).alias("label")) for p, label in flags]))
    ok = F.forall("_h", lambda h: h["at"] > 0) & F.forall(F.transform("_h", lambda h, i: (i == 0) | (h["at"] >= F.coalesce(F.try_element_at("_h", i)["end"], F.lit(1)))), lambda x: x)
    piece = lambda a, b, label: F.struct(F.substr(t, a, b - a).alias("text"), label.alias("label"))
    before = lambda i: F.when(i == 0, 1).otherwise(F.try_element_at("_h", F.greatest(i, F.lit(1)))["end"])
    cut = F.flatten(F.transform("_h", lambda h, i: F.array(piece(before(i), h["at"], F.lit(None).cast("string")), piece(h["at"], h["end"], h["label"]))))
    last = F.element_at("_h", -1)["end"]
    whole = F.filter(F.concat(cut, F.array(piece(last, F.length(t) + 1, F.lit(None).cast("string")))), lambda s: s["text"] != "")
    return df.withColumn("_h", hits).select(key, F.when(ok, whole).alias("segments"))


#: Where to go with what was lost. (Fixed values: the national helpline and portal.)
ROUTES = "Report it: call 1930 or go to cybercrime.gov.in."


def report_text(level: Column, name: Column, score: Column, quotes: Column, link: Column, advice: Column) -> Column:
    """A report's text, line by line: what it looks like, the words that gave it away, the link, what to do; lines without content
    are left out, and where to report stands last if the level is not `nothing`."""
    said = F.array_join(F.transform(F.slice(quotes, 1, 4), lambda q: F.concat(F.lit('"'), q, F.lit('"'))), ", ")
    lines = [
        F.when(level == "nothing", "No known pattern was found.").otherwise(F.concat(F.lit("Looks like "), F.coalesce(name, F.lit("a fraud")), F.lit(" ("), level, F.lit(", score "), score.cast("string"), F.lit(")."))),
        F.when(F.size(quotes) > 0, F.concat(F.lit("Words: "), said, F.lit("."))), F.when(link != "", F.concat(F.lit("Link: "), link)), advice, F.when(level != "nothing", ROUTES),
    ]
    return F.concat_ws("\n", *lines)


def cards(families: DataFrame, kind: str | None = None) -> DataFrame:
    """Cards (family, name, intent) of one kind of help page, or all, with the form's text filled in beforehand."""
    own = families if kind is None or kind == "All" else families.where(F.col("intent") == kind)
    return own.withColumn("prefill", F.concat(F.lit("I want to report "), F.col("name"), F.lit(".")))
