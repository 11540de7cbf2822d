"""Rules that read a message for signs of fraud and quote what they found. Scores add up; no level says that a message is safe."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import lexicon
from .lexicon import expand, fold, folded

#: Families by priority: the first of a message's families names it. (Fixed values.)
FAMILIES = ["sextortion", "arrest", "otp", "upi", "misdirected", "fee", "app", "job", "invest", "prize", "refund", "kyc", "utility", "parcel", "card", "threat", "urgency", "contact"]
MONEY = "(?:rs[.]? ?[0-9]+|₹ ?[0-9]+|[0-9]+ ?(?:rupees|lakh|crore)|money|amount|payment)"
#: Rules: weight, family, patterns of which every one must hold, and phrase lists (operators/lexicon.py) that feed the rule, too:
#: matches of the first pattern and hits of the first list are quoted, further lists must be met. Own wording throughout.
RULES = {
    "ask-credential": (5, "otp", [], []),
    "ask-secret": (3, "otp", [], []),
    "pay-to-receive": (3, "fee", [], ["pay-to-receive", "pay-to-receive/what"]),
    "upi-receive": (3, "upi", [], ["upi-receive"]),
    "stay-on-call": (3, "arrest", [], ["stay-on-call"]),
    "secrecy": (3, "arrest", ["(?:do not|don't) tell (?:anyone|anybody|your family)|keep (?:this|it) (?:secret|confidential)"], ["secrecy"]),
    "install-app": (3, "app", ["[a-z0-9_-]+[.]apk"], ["install-app"]),
    "task-job": (3, "job", [], ["task-job"]),
    "investment": (3, "invest", ["[0-9]+ ?% (?:daily|weekly|monthly) (?:returns?|profit)"], ["investment"]),
    "prize": (3, "prize", [], ["prize"]),
    "sextortion": (5, "sextortion", ["(?:your )?(?:private|intimate) (?:video|photos|pictures)", "(?:share|send|post|leak|upload) (?:it|them|this)", "(?:pay|transfer|send money)"], []),
    "wrong-transfer": (3, "misdirected", ["(?:by mistake|wrongly|accidentally) (?:sent|transferred|credited)|(?:sent|transferred|credited) (?:[a-z0-9.₹]+ ){0,5}by mistake", MONEY, "(?:return|refund|send) (?:it|the money|the amount|back)", "you|your|ur|aap|tum|tera|teri"], []),
    "qr-receive": (3, "upi", ["scan (?:this |the )?(?:qr|code)(?: code)? (?:to|and) (?:receive|get)", MONEY], []),
    "utility-cutoff": (2, "utility", ["(?:electricity|power|gas|water|connection)(?: [a-z]+){0,4} (?:disconnected|cut|stopped)", "(?:call|pay|update|contact)"], ["utility-cutoff", "utility-cutoff/act"]),
    "pay-first": (3, "fee", [], ["pay-first", "pay-first/for"]),
    "authority": (2, "arrest", [], ["authority"]),
    "kyc": (2, "kyc", [], ["kyc", "kyc/act"]),
    "parcel": (2, "parcel", ["(?:parcel|package|courier|shipment)(?: [a-z]+){0,4} (?:held|seized|pending|undelivered|returned)"], ["parcel"]),
    "refund-claim": (2, "refund", [], ["refund-claim"]),
    "card-points": (2, "card", [], ["card-points"]),
    "click-link": (2, "contact", [], ["click-link"]),
    "threat": (1, "threat", [], ["threat"]),
    "urgency": (1, "urgency", [], ["urgency"]),
    "phone-number": (1, "contact", ["(?<![0-9])[6-9][0-9]{9}(?![0-9])"], []),
    "callback": (1, "contact", [], ["callback"]),
}
INTENTS = [
    ("lost-money", ["lost money", "paid", "debited", "transferred", "cheated"]), ("otp", ["otp", "pin", "code"]), ("upi", ["upi", "qr", "collect"]), ("kyc", ["kyc", "pan", "aadhaar"]), ("job", ["job", "task", "salary"]),
    ("loan", ["loan", "emi", "instalment"]), ("parcel", ["parcel", "courier", "customs"]), ("arrest", ["police", "cbi", "arrest"]), ("report", ["report", "complaint", "helpline"]),
]
LOSS = "(?:lost|cheated|stolen|deducted|debited)(?: [a-z0-9₹.,]+){0,5} (?:money|rupees|amount|account|rs)|money (?:is |was )?(?:gone|lost|deducted)"
SMALL_TALK = [("greeting", "^(?:hi|hello|hey|namaste)(?![a-z])"), ("thanks", "thank(?:s| you)|dhanyawad"), ("bye", "^(?:bye|goodbye|see you)"), ("who", "who are you|your name"), ("how", "how are you"), ("help", "^help(?![a-z])|what can you do")]
#: What a prepared text must hold for a rule's patterns to fit: a word of each of these groups. Patterns run only there, as they are
#: tried from each character of a text.
NEEDS = {
    "secrecy": [["tell", "keep"]], "install-app": [[".apk"]], "investment": [["%"]], "sextortion": [["video", "photos", "pictures"], ["private", "intimate"]],
    "wrong-transfer": [["by mistake", "wrongly", "accidentally"], ["sent", "transferred", "credited"]], "qr-receive": [["scan "]],
    "utility-cutoff": [["disconnected", "cut", "stopped"], ["electricity", "power", "gas", "water", "connection"]],
    "parcel": [["held", "seized", "pending", "undelivered", "returned"], ["parcel", "package", "courier", "shipment"]],
}
LINK_WEIGHT = {"scam": 5, "suspicious": 3, "unverified": 1, "official": 0}
SCAM, SUSPICIOUS = 5, 3
#: Words of the two asking rules. Own lists.
ASKS = ["share", "send", "tell", "give", "provide", "forward", "reply", "bhejo", "bhejiye", "batao", "bataiye", "batayen", "dijiye", "dedo", "cheppandi", "pampandi", "ivvandi", "भेजें", "भेजो", "बताएं", "बताओ"]
STEMS, HELPERS = ["bhej", "bata", "de", "dal"], ["do", "dijiye", "dena"]
NEGATORS = ["not", "never", "don't", "dont", "no", "cannot", "can't", "without", "avoid", "mat", "na", "nahi", "nahin", "न", "मत", "नहीं"]
AFTER, AFTER_VERBS = ["na", "mat", "nahi", "nahin", "न", "मत", "नहीं"], ["karo", "karen", "kare", "karna", "dena", "do", "batana", "batao", "batayen", "bhejna", "bhejo", "kijiye", "करें", "बताएं", "भेजें"]
PAIRS = ["card number", "card details", "bank details", "account number", "security code"]
CREDENTIALS = ["pin", "mpin", "cvv", "password", "passcode", "पिन", "पासवर्ड", *[p.replace(" ", "") for p in PAIRS]]
CODES = ["otp", "aadhaar", "aadhar", "ओटीपी", "verificationcode"]
DOOR = "delivery (?:agent|partner|executive|person|boy)"
ABOUT = "otp|pin|mpin|cvv|password|passcode|card|aadhaar|aadhar|upi|code|ओटीपी|पिन|पासवर्ड"
SENTENCE_END = "[.!?।]+"
#: Words that an asking rule looks at, folded; a token with ANY is the first of these that it fits.
ASKING = list(dict.fromkeys(folded(w) for w in [*CREDENTIALS, *CODES, *ASKS, *STEMS, *HELPERS, *NEGATORS, *AFTER, *AFTER_VERBS]))


def prepared(c: Column) -> Column:
    """The whole message normalised, in lower case, blanks collapsed, commas within numbers dropped."""
    return F.regexp_replace(F.lower(tx.normalise(c)), "(?<=[0-9]),(?=[0-9])", "")


def none() -> Column:
    return F.array().cast("array<string>")


def bounded(pattern: str) -> str:
    """The pattern at word edges."""
    return f"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])"


def words_of(t: Column) -> Column:
    """Folded tokens; pairs such as `card number` are one, and an ask in a sentence on handing a code to a delivery agent is none."""
    asks = bounded("|".join(w for w in ASKS if w.isascii()))
    at_door = lambda s: F.when(s.rlike(bounded(DOOR)) & s.rlike(bounded("otp")), F.regexp_replace(s, asks, "x")).otherwise(s)
    t = F.when(t.contains("delivery"), F.array_join(F.transform(F.split(t, SENTENCE_END), at_door), " ")).otherwise(t)
    t = F.regexp_replace(t, "(card|bank|account|security|verification) (number|details|code)", "$1$2")
    return F.transform(lexicon.tokens(fold(t)), lambda w: F.when(w.contains(tx.ANY), cleared(w)).otherwise(w))


def cleared(w: Column) -> Column:
    """A token with ANY as the first word of ASKING that it may be; as it is if there is none."""
    fits = F.filter(F.array(*[F.lit(x) for x in ASKING]), lambda x: F.like(x, F.translate(w, tx.ANY, "_")))
    return F.coalesce(F.get(fits, 0), w)


#: What a text must hold to be cut into tokens for the asking rules: a secret's name, or a wildcard that may hide one.
SECRET = "|".join(dict.fromkeys([*[folded(s) for s in [*CREDENTIALS, *CODES]], "card", "bank", "account", "security", "verification"]))


def asking_words(t: Column) -> Column:
    """words_of a prepared text that may ask for a secret; no words of others, which are most."""
    return F.when(t.contains(tx.ANY) | fold(t).rlike(SECRET), words_of(t)).otherwise(none())


def asks(words: Column, secrets: list[str]) -> Column:
    """The first verb among asking_words that asks for one of the secrets, as an array of one; empty if there is none.

    The verb (or a stem with its helper) has no negator among the five tokens before it nor a negated verb right after it; a
    secret is among the six tokens after it, or among the three before.
    """
    of = lambda ws: F.array(*[F.lit(folded(w)) for w in dict.fromkeys(ws)])
    any_of = lambda part, ws: F.arrays_overlap(part, of(ws))

    def each(w: Column) -> Column:
        back = lambda i, n: F.slice(w, F.greatest(F.lit(1), i - n), i - F.greatest(F.lit(1), i - n))
        at = lambda i: F.get(w, i - F.lit(1))
        verb = lambda i: at(i).isin(*{folded(a) for a in ASKS}) | (at(i).isin(*map(folded, STEMS)) & F.coalesce(at(i + 1).isin(*map(folded, HELPERS)), F.lit(False)))
        undone = lambda i: F.coalesce(at(i).isin(*AFTER) & at(i + 1).isin(*map(folded, AFTER_VERBS)), F.lit(False))
        asked = lambda i: verb(i) & ~any_of(back(i, 5), NEGATORS) & ~undone(i + 1) & ~undone(i + 2) & (any_of(F.slice(w, i + 1, F.lit(6)), secrets) | any_of(back(i, 3), secrets))
        return F.slice(F.transform(F.filter(F.sequence(F.lit(1), F.size(w)), asked), at), 1, 1)

    return tx.let(words, lambda w: F.when((F.size(w) > 0) & any_of(w, secrets), each(w)).otherwise(none()))


def asks_for(t: Column, secrets: list[str]) -> Column:
    """asks of a prepared text's words."""
    return asks(asking_words(t), secrets)


def may_fit(t: Column, rule: str) -> Column:
    """Whether a prepared text holds what a rule's patterns need."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [t.contains(w) for w in group]) for group in NEEDS.get(rule, [])], F.lit(True))


def matches(t: Column, rule: str) -> Column:
    """Different matches of a rule's first pattern, if the others occur, too."""
    patterns = RULES[rule][2]
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(bounded(patterns[0])), F.lit(0)))
    fits = reduce(lambda a, b: a & b, [t.rlike(bounded(p)) for p in patterns[1:]], may_fit(t, rule))
    return F.when(fits, found).otherwise(none())


def quote(words: Column) -> Column:
    """The words of a hit as the prepared text has them first, with what stands between them."""
    return F.regexp_substr("prepared", F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), lexicon.BETWEEN))


def phrase_quotes(lists: list[str], keep: Callable[[Column], Column] | None = None) -> Column:
    """Different quotes of the first list's hits, if the other lists have hits, too."""
    own = F.filter("hits", lambda h: (h["id"] == lists[0]) & (keep(h) if keep else F.lit(True)))
    met = lambda name: F.exists("hits", lambda h: h["id"] == name)
    # A text is searched once for each of the different wordings, not for each hit.
    said = F.array_distinct(F.transform(own, lambda h: F.slice("tokens", h["start"] + 1, h["words"])))
    return F.when(reduce(lambda a, b: a & b, map(met, lists)), F.array_distinct(F.transform(said, quote))).otherwise(none())


def secrecy_quotes(asking: Column) -> Column:
    """Demands of secrecy, less those in a sentence (or after one) that is about a code, unless the message asks for one."""
    demand = bounded(RULES["secrecy"][2][0])
    about = lambda x: F.coalesce(x.rlike(bounded(ABOUT)), F.lit(False))
    # Sentences are cut once, and whether they are about a code is asked once each: work grows with the text, not with its square.
    found = F.split("prepared", SENTENCE_END)
    apart = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("x"), about(x).alias("about"), F.size(lexicon.tokens(x)).alias("n")))
    stands = lambda s, i: asking | ~(F.get(s, i)["about"] | F.coalesce(F.get(s, i - 1)["about"], F.lit(False)))
    kept = lambda s: F.filter(s, lambda x, i: x["x"].rlike(demand) & stands(s, i))
    said = lambda s: F.array_distinct(F.transform(kept(s), lambda x: F.regexp_extract(x["x"], demand, 0)))
    own = F.when(may_fit(F.col("prepared"), "secrecy") & F.col("prepared").rlike(demand), tx.let(tx.let(found, apart), said)).otherwise(none())
    # For each token whether its sentence lets a demand stand.
    each = lambda s: F.flatten(F.transform(s, lambda x, i: F.array_repeat(stands(s, i), x["n"])))
    holds = F.when(F.exists("hits", lambda h: h["id"] == "secrecy"), tx.let(tx.let(found, apart), each))
    fed = tx.let(holds, lambda ok: phrase_quotes(["secrecy"], lambda h: F.get(ok, h["start"])))
    return F.array_union(own, fed)


def third_party(t: Column) -> Column:
    """The text without what others will give back."""
    return F.regexp_replace(t, "(?:will|would|shall|they|he|she) (?:return|refund|send)", "")


def rule_hits(rule: str) -> Column:
    """What a rule finds in `prepared`, `tokens` and `hits`, given `asks_credential` and `asks_code`."""
    t, (_, _, patterns, lists) = F.col("prepared"), RULES[rule]
    if rule in ("ask-credential", "ask-secret"):
        return F.col("asks_credential" if rule == "ask-credential" else "asks_code")
    if rule == "secrecy":
        return secrecy_quotes((F.size("asks_credential") > 0) | (F.size("asks_code") > 0))
    if rule == "wrong-transfer":
        return F.when(may_fit(t, rule) & third_party(t).rlike(bounded(patterns[2])), matches(t, rule)).otherwise(none())
    parts = [*([matches(t, rule)] if patterns else []), *([phrase_quotes(lists)] if lists else [])]
    return reduce(F.array_union, parts)


def weight(w: Column, n: Column) -> Column:
    """A rule's weight: more by one for each further hit, by two at most, from weight two on."""
    return w + F.when(w >= 2, F.least(F.lit(2), n - 1)).otherwise(0)


def evidence(df: DataFrame, text_col: str) -> DataFrame:
    """df with the prepared text, its tokens and evidence: rule, family, weight, quote, count of each rule that fired.

    Each rule's hits are found once; weights and quotes are then read from them.
    """
    d = df.withColumn("prepared", prepared(F.col(text_col)))
    d = d.withColumn("tokens", lexicon.tokens(F.col("prepared")))
    d = d.withColumns({"hits": lexicon.finder(df.sparkSession)(F.col("tokens")), "words": asking_words(F.col("prepared"))})
    d = d.withColumns({"asks_credential": asks(F.col("words"), CREDENTIALS), "asks_code": asks(F.col("words"), CODES)}).drop("words")
    d = d.withColumn("found", F.array(*[rule_hits(rule) for rule in RULES]))
    rules = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(family).alias("family"), F.lit(w).alias("w")) for rule, (w, family, _, _) in RULES.items()])
    each = F.zip_with("found", rules, lambda h, r: F.struct(r["rule"].alias("rule"), r["family"].alias("family"), weight(r["w"], F.size(h)).alias("weight"), F.get(h, 0).alias("quote"), F.size(h).alias("count")))
    return d.withColumn("evidence", F.filter(each, lambda e: e["count"] > 0)).drop("found", "hits", "asks_credential", "asks_code")


def verdict(df: DataFrame, text_col: str, link_level: Column | None = None) -> DataFrame:
    """df with score, level (scam, suspicious or nothing) and family. link_level: the verdict on the message's link, which adds to the score."""
    return scored(evidence(df, text_col), link_level)


def scored(d: DataFrame, link_level: Column | None = None) -> DataFrame:
    """d with score, level and family of its evidence (weight and family of each rule)."""
    link = F.lit(0) if link_level is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LINK_WEIGHT.items() for x in kv]), link_level), F.lit(0))
    d = d.withColumn("score", F.aggregate("evidence", F.lit(0), lambda a, e: a + e["weight"]) + link)
    place = F.array_min(F.transform("evidence", lambda e: F.array_position(F.array(*[F.lit(x) for x in FAMILIES]), e["family"])))
    family = F.try_element_at(F.array(*[F.lit(x) for x in FAMILIES]), place.cast("int"))
    if link_level is not None:
        family = F.coalesce(family, F.when(link_level == "scam", "kyc").when(link_level.isin("suspicious", "unverified"), "contact"))
    return d.withColumns({"level": F.when(F.col("score") >= SCAM, "scam").when(F.col("score") >= SUSPICIOUS, "suspicious").otherwise("nothing"), "family": family})


#: Families: what a message of the family is called, the intent that its help page has, and what to do. Own wording.
ABOUT_FAMILIES = {
    "sextortion": ("blackmail over private pictures", "Sextortion", "Do not pay or answer; keep the messages and report them."), "arrest": ("a caller who poses as an officer", "Digital Arrest", "Hang up and tell someone you trust."),
    "otp": ("a theft of a code or PIN", "OTP Scam", "Keep codes to yourself; if one is gone, call your bank."), "upi": ("a payment dressed as a receipt", "UPI Fraud", "A PIN is for paying only; decline the request."),
    "misdirected": ("a made-up wrong transfer", "UPI Fraud", "Look at your own statement and let the bank reverse it."), "fee": ("a fee before a payout", "Phishing", "Pay nothing in advance."), "app": ("a harmful app", "Phishing", "Do not install it."),
    "job": ("a job that costs money", "Job Fraud", "Deposit nothing to earn."), "invest": ("a promise of sure profit", "Investment Scam", "Look the firm up with the regulator."), "prize": ("a prize never entered for", "Phishing", "Do not answer."),
    "refund": ("a refund to be claimed", "Phishing", "Real refunds arrive by themselves."), "kyc": ("a made-up account check", "Phishing", "Use the bank's own app."), "utility": ("a made-up cut-off notice", "Phishing", "Look the bill up with the provider."),
    "parcel": ("a made-up parcel notice", "Digital Arrest", "Follow the parcel on the courier's own site."), "card": ("a card or points notice", "Phishing", "Call the number on the card."), "threat": ("a threat", "Phishing", "Check the claim by a way you know."),
    "urgency": ("pressure of time", "Phishing", "Take your time."), "contact": ("a call for contact", "Phishing", "Look the number up yourself."),
}


def told(verdicts: DataFrame) -> DataFrame:
    """verdicts with the family's name and, where the level is not `nothing`, its intent and advice."""
    rows = [(k, *v) for k, v in ABOUT_FAMILIES.items()]
    families = F.broadcast(verdicts.sparkSession.createDataFrame(rows, "family string, name string, intent string, advice string"))  # 18 rows
    flagged = F.col("level") != "nothing"
    return verdicts.join(families, "family", "left").withColumns({"intent": F.when(flagged, F.col("intent")), "advice": F.when(flagged, F.col("advice")).otherwise("Nothing known was found; that does not make it genuine.")})


def intent_of(t: Column) -> Column:
    """The intent of a prepared text with most keyword hits, the first of equals; null without hits."""
    def best(t: Column) -> Column:
        n = {k: sum((F.when(tx.has_keyword(t, w), 1).otherwise(0) for w in words), F.lit(0)) for k, words in INTENTS}
        return F.array_max(F.array(*[F.struct(v.alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("intent")) for i, (k, v) in enumerate(n.items())]))

    return tx.let(tx.let(t, best), lambda x: F.when(x["n"] > 0, x["intent"]))


def intent(c: Column) -> Column:
    """intent_of a message as it came."""
    return intent_of(prepared(c))


def money_loss(c: Column) -> Column:
    return prepared(c).rlike(bounded(LOSS))


def small_talk(c: Column) -> Column:
    """The first small-talk kind that fits."""
    return tx.let(prepared(c), lambda t: F.coalesce(*[F.when(t.rlike(p), k) for k, p in SMALL_TALK]))


def phrase_hits(df: DataFrame, key: list[str], text_col: str, phrases: DataFrame) -> DataFrame:
    """key, pos, id and phrase of each phrase of a lexicon (id, ord, phrase) in the prepared texts' tokens."""
    return lexicon.phrase_hits(df.select(*key, lexicon.tokens(prepared(F.col(text_col))).alias("tokens")), key, "tokens", phrases)


def quotes_hold(df: DataFrame) -> Column:
    """Every quote is a part of the prepared text, but for the verbs that ask, which are folded."""
    return F.forall("evidence", lambda e: F.contains(F.col("prepared"), e["quote"]) | e["rule"].startswith("ask-"))
