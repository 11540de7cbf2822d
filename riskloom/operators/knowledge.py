"""Questions with known answers: which entry a text asks for, how clearly, and which entries and patterns nothing reaches.

An entry has patterns, a pattern has groups, and a group has alternatives: words, phrases, or words by how they begin. A pattern
is met if each of its groups, in order, finds an alternative in tokens that no group before it has taken; of the alternatives found the
weightiest is taken. A word weighs ln(entries / entries that use it), so rare words say more; a pattern's score is the sum of its
squared weights, and a pattern without one distinctive word scores nothing. All wording is this library's own.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import lexicon

#: Entries: groups are parted by +, alternatives by /, a word that ends in ~ stands for all that begin so.
ENTRIES: dict[str, list[str]] = {
    "tool-purpose": ["purpose/aim/goal/uddeshya/मकसद + tool/app/site/this/you", "why + built/made/exist + tool/app/site/this"], "tool-use": ["how + use/start/begin + tool/app/site/this/you", "paste/upload/enter + message/link/picture + where/how"],
    "tool-offline": ["offline/without internet/no network + work/use/tool/app"], "tool-price": ["free/cost/price/charge + tool/app/site/use this"], "tool-maker": ["who + made/built/created/behind + tool/app/site/this/you"],
    "tool-accuracy": ["accurate/accuracy/error rate/mistaken + how/often/tool/app/you"], "tool-languages": ["language~/hindi/telugu/bhasha/भाषा + support/understand/speak/which/read"], "tool-privacy": ["private/privacy/stored/tracked + data/messages/text/my/tool", "who + sees/reads + messages/text/data"],
    "tool-wrong": ["flagged/marked + wrong~/mistake/genuine message"], "tool-voice": ["voice/read aloud/spoken + answer/tool/app/how/mode"], "tool-picture": ["screenshot/picture/photo + read/check/scan/upload"], "tool-install": ["install/home screen + this tool/this app/this site"],
    "otp-what": ["otp/one time password/ओटीपी + what/meaning/kya/explain"], "otp-shared": ["otp/code/ओटीपी + shared/gave/told/disclosed"], "otp-asked": ["otp/verification code + ask~/wants/maang~ + caller/bank/officer/someone/call"], "pin-receive": ["upi pin/pin + receive/get money/collect + need/enter/do/why"],
    "cvv-safe": ["cvv/card number/expiry + share/safe/give/asks"], "password-leak": ["password/passcode + leaked/stolen/hacked/exposed"], "upi-collect": ["collect request/payment request + what/unknown/accept/from"], "upi-wrong": ["wrong upi/wrong number/wrong account + sent/paid/transferred"],
    "upi-limit": ["upi limit/daily limit + what/how much/change"], "qr-receive": ["qr/qr code/scan + receive/get + money/cash/payment"], "qr-sticker": ["qr + sticker/pasted/shop + fake/changed/swapped"], "refund-call": ["refund + call/caller/agent/form + real/genuine/got/claim"],
    "refund-time": ["refund/money back/reversal + how long/when/days"], "kyc-message": ["kyc/केवाईसी + expire~/update/message/sms/suspend~"], "kyc-where": ["kyc + where/branch/official/how + do/complete/update"], "pan-misuse": ["pan card/pan number + misuse~/loan/stolen/shared"],
    "aadhaar-share": ["aadhaar/aadhar + share/copy/give/safe"], "aadhaar-lock": ["aadhaar/aadhar/biometric~ + lock/unlock"], "sim-swap": ["sim swap/sim lost/no signal + what/suddenly/bank/sign"], "sim-block": ["sim + block~/deactivat~ + message/call/threat/trai"],
    "arrest-video": ["digital arrest/डिजिटल अरेस्ट", "arrest~ + video call/skype/whatsapp call"], "police-call": ["police/cbi/customs officer + call~/phone + real/fake/money/demand"], "court-notice": ["court notice/summons/warrant + email/whatsapp/message/real"], "parcel-drugs": ["parcel/courier/package + drugs/illegal/seized/customs"],
    "parcel-fee": ["parcel/delivery/courier + fee/charge/pay + small/link/address/failed"], "job-task": ["task/part time job/parttime job/like videos + pay/earn/money/genuine"], "job-deposit": ["job/naukri + deposit/registration fee/training fee"], "job-abroad": ["abroad/overseas/visa + job/work + agent/offer/fee"],
    "invest-group": ["trading group/telegram group/whatsapp group + invest~/stock~/profit/tips"], "invest-double": ["double/guaranteed + money/returns/profit + real/days/sure/scheme"], "crypto-stuck": ["crypto/bitcoin/wallet + withdraw~/stuck/locked/frozen"], "loan-app": ["loan app/instant loan + harass~/contacts/threat~/photos"],
    "loan-fee": ["loan + advance/processing fee/upfront"], "lottery-win": ["lottery/lucky draw/jackpot/kbc + won/win/message/real"], "gift-abroad": ["gift + abroad/friend/parcel/customs + pay/stuck/fee"], "romance": ["dating/matrimonial/online friend + money/help/gift/emergency"],
    "blackmail-video": ["nude/private video/morphed/intimate + threat~/blackmail~/leak~/send"], "blackmail-pay": ["blackmail~/extort~ + pay/stop/again"], "electricity-cut": ["electricity/bijli/power + cut/disconnect~ + message/tonight/number/bill"], "gas-bill": ["gas/water + bill + unpaid/disconnect~/message"],
    "card-points": ["reward points/card points + expire/redeem/link"], "card-block": ["block/freeze + card/atm card/debit card + how/lost/stolen/number"], "remote-app": ["anydesk/teamviewer/screen share/remote + install/safe/asked/caller"], "apk-file": ["apk/unknown file/attachment + install~/opened/whatsapp/received"],
    "link-check": ["link/url/website + fake/genuine/safe/check/real"], "link-clicked": ["clicked/opened/tapped + link/attachment/it"], "short-link": ["short link/bitly/shortened + safe/why/open"], "domain-look": ["domain/spelling/address + fake/lookalike/official/tell"],
    "number-search": ["customer care number/helpline number + google/search/found/fake"], "spoofed-call": ["spoof~/caller id + bank/number/same/real"], "deepfake-voice": ["voice clone/deepfake/ai voice + relative/call/money/family"], "wrong-credit": ["credited/received + by mistake/wrongly + return/send back/someone"],
    "report-online": ["report/complaint/shikayat/शिकायत + online/cyber/portal/website", "where/how/kahan + report/complain + fraud/scam/cheating"], "helpline-1930": ["1930/cyber helpline + what/call/number/when/work"], "report-police": ["police station/fir + file/lodge/go/register"], "report-bank": ["tell bank/inform bank/bank complaint + when/how/fraud/days"],
    "evidence-keep": ["evidence/proof/saboot/सबूत + keep/need/what/save"], "money-recover": ["money/paise/amount + recover~/get back/wapas/refund possible"], "freeze-account": ["account + frozen/freeze/lien/hold + why/police/remove"], "sanchar-block": ["report number/block number/spam number + how/where/trai"],
    "child-safety": ["child/kids/son/daughter + game/online/chat/stranger"], "elder-safety": ["parents/grandmother/elder~ + protect/teach/warn/scam"], "emergency-112": ["danger/emergency/112 + call/now/help/someone"],
}
#: Words that carry no topic. Own list.
STOP = set("a an and are as at be but by can do does for from had has have he her his how i if in is it its me my no not of on or our she so some someone that the their them then there they this to us was we were what when where which who why will with you your kya hai ka ki ke ko se me mein aur yes again now need".split())
#: Texting forms and the words they stand for. Own list.
TEXTING = {"u": "you", "ur": "your", "r": "are", "y": "why", "pls": "please", "plz": "please", "msg": "message", "abt": "about", "acc": "account", "whats": "what", "wats": "what", "thx": "thanks"}
FIRST_PERSON = ["i", "im", "ive", "me", "my", "we", "us", "our", "mera", "meri", "mere", "mujhe", "maine", "hum", "मेरा", "मुझे", "मैंने", "నా", "నాకు"]
ORDERS = ["tell", "explain", "show", "list", "describe", "give", "help", "got", "someone", "somebody"]
#: Longer texts are messages to be checked, not questions.
MOST_TOKENS = 24
#: From this weight on a word is distinctive: about a fifth of the entries use it at most.
DISTINCTIVE = 1.6
#: Spellings are evened out in words of this length and more; shorter ones must be equal.
FOLDED_FROM = 5
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*|[ऀ-ॣ०-ॿ]+|[ఀ-౿]+"


def tokens(c: Column) -> Column:
    """Tokens of a question: composed, lower case, without apostrophes and hyphens, texting forms written out."""
    t = F.regexp_replace(F.lower(tx.nfkc(F.substring(c, 1, 4000))), "['’]", "")
    forms = F.create_map(*[F.lit(x) for kv in TEXTING.items() for x in kv])
    return F.transform(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), lambda w: F.coalesce(F.try_element_at(forms, F.regexp_replace(w, "-", "")), F.regexp_replace(w, "-", "")))


def askable(t: Column, question: Column) -> Column:
    """Whether tokens may be a question to this library: few words, a question's shape, a person speaking of themself, or an order."""
    n = F.size(t)
    return n.between(1, MOST_TOKENS) & ((n <= 4) | question | F.arrays_overlap(t, F.array(*[F.lit(w) for w in FIRST_PERSON])) | F.get(t, 0).isin(*ORDERS))


def alternatives(entries: dict[str, list[str]]) -> list[tuple[str, int, int, int, int, int, str]]:
    """entry, its place, pattern (counted over all entries), groups of the pattern, group, alternative, words."""
    out, pattern = [], 0
    for place, (entry, patterns) in enumerate(entries.items()):
        for p in patterns:
            groups = p.split(" + ")
            out += [(entry, place, pattern, len(groups), g, a, words) for g, group in enumerate(groups) for a, words in enumerate(group.split("/"))]
            pattern += 1
    return out


def weights(entries: dict[str, list[str]]) -> list[float]:
    """The weight of each alternative: that of its rarest word, more for each further word; a phrase is worth 2.2 at least."""
    rows, used = alternatives(entries), defaultdict(set)
    for entry, *_, words in rows:
        for w in words.split():
            used[w.rstrip("~")].add(entry)
    idf = lambda w: 0.0 if w in STOP else math.log(len(entries) / len(used[w]))
    out = []
    for *_, words in rows:
        parts = [w.rstrip("~") for w in words.split()]
        best = max(map(idf, parts))
        out.append(max(2.2, best + 0.4 * (len(parts) - 1)) if len(parts) > 1 else best or 0.25)
    return out


class Words(lexicon.Automaton):
    """Phrases of whole words, of evened-out spellings of long words, and of words by how they begin."""

    def __init__(self, rows):
        super().__init__(rows)
        self.alike = defaultdict(list)
        for w, i in self.words.items():
            if not w.endswith("~") and len(w) >= FOLDED_FROM:
                self.alike[lexicon.folded(w)].append(i)
        self.begins = [(w[:-1], i) for w, i in self.words.items() if w.endswith("~")]

    @staticmethod
    def key(word: str) -> str:
        return word

    def stands_for(self, token: str) -> list[int]:
        own = [self.words[token]] if token in self.words else []
        alike = [i for i in self.alike.get(lexicon.folded(token), ()) if i not in own] if len(token) >= FOLDED_FROM else []
        return own + alike + [i for w, i in self.begins if token.startswith(w)]


@functools.lru_cache(maxsize=1)
def own_words() -> Words:
    return words_of(ENTRIES)


def words_of(entries: dict[str, list[str]]) -> Words:
    return Words([(str(i), 0, words) for i, (*_, words) in enumerate(alternatives(entries))])


def met_patterns(df: DataFrame, key: list[str], tokens_col: str, entries: dict[str, list[str]] | None = None) -> DataFrame:
    """key, entry, place, pattern and score of the patterns that each list of tokens meets with a distinctive word. key: one row each."""
    spark, own = df.sparkSession, entries or ENTRIES
    rows = [(str(i), *r[:6], w) for i, (r, w) in enumerate(zip(alternatives(own), weights(own)))]
    table = spark.createDataFrame(rows, "id string, entry string, place int, pattern int, groups int, g int, alt int, w double")
    find = lexicon.finder(spark, words_of(entries) if entries else None, own_words)
    hits = df.select(*key, F.explode(find(F.col(tokens_col))).alias("h")).select(*key, "h.id", "h.start", "h.words")
    found = hits.join(F.broadcast(table), "id")  # the entries are written by hand: some hundred alternatives
    each = F.struct("g", (-F.col("w")).alias("nw"), "alt", "start", "words")
    # A question has at most MOST_TOKENS tokens, so a pattern's hits in one are few.
    by = found.groupBy(*key, "entry", "place", "pattern", "groups").agg(F.collect_list(each).alias("h"), F.count_distinct("g").alias("n")).where(F.col("n") == F.col("groups"))

    def step(acc: Column, g: Column) -> Column:
        free = lambda x: F.forall(F.sequence(x["start"], x["start"] + x["words"] - 1), lambda i: ~F.array_contains(acc["used"], i))
        best = F.array_min(F.transform(F.filter("h", lambda x: (x["g"] == g) & free(x)), lambda x: F.struct(x["nw"].alias("nw"), x["alt"].alias("alt"), x["start"].alias("start"), x["words"].alias("words"))))
        taken = lambda b: F.struct(F.concat(acc["used"], F.sequence(b["start"], b["start"] + b["words"] - 1)).alias("used"), (acc["score"] + b["nw"] * b["nw"]).alias("score"), (acc["rare"] | (b["nw"] <= -DISTINCTIVE)).alias("rare"))
        return F.get(F.transform(F.array(best), lambda b: F.when(b.isNotNull() & acc.isNotNull(), taken(b))), 0)

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("score"), F.lit(False).alias("rare"))
    start = F.when(F.col("groups") > 0, start)
    scored = by.withColumn("r", F.aggregate(F.sequence(F.lit(0), F.col("groups") - 1), start, step))
    return scored.where("r is not null and r.rare").select(*key, "entry", "place", "pattern", F.round("r.score", 6).alias("score"))


def rank(met: DataFrame, key: list[str]) -> DataFrame:
    """key, rank, entry, score and margin (to the next entry, null for the last) of all entries that a question meets, best first."""
    best = met.groupBy(*key, "entry", "place").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "place")  # a question's entries: as many as there are at most
    return best.select(*key, F.row_number().over(w).alias("rank"), "entry", "score", F.round(F.col("score") - F.lead("score").over(w), 6).alias("margin"))


def reach(spark: SparkSession, met: DataFrame, key: list[str], entries: dict[str, list[str]] | None = None) -> DataFrame:
    """entry, pattern (counted over all entries) and `questions`: how many met it; 0 for those that nothing reached."""
    rows = sorted({(e, p) for e, _, p, *_ in alternatives(entries or ENTRIES)})
    every = spark.createDataFrame(rows, "entry string, pattern int")
    used = met.groupBy("pattern").agg(F.count_distinct(*key).alias("questions"))
    return every.join(used, "pattern", "left").select("entry", "pattern", F.coalesce("questions", F.lit(0).cast("long")).alias("questions"))


def unreached(spark: SparkSession, met: DataFrame, entries: dict[str, list[str]] | None = None) -> DataFrame:
    """Entries that no question met."""
    every = spark.createDataFrame([(e,) for e in (entries or ENTRIES)], "entry string")
    return every.join(met.select("entry").distinct(), "entry", "left_anti")


def dead_patterns(spark: SparkSession, entries: dict[str, list[str]] | None = None) -> DataFrame:
    """entry, pattern and filled of the patterns that not even a question made of their own weightiest words meets."""
    own, filled = entries or ENTRIES, {}
    for (entry, _, pattern, _, g, _, words), w in zip(alternatives(own), weights(own)):
        worth = (not words.endswith("~"), w)  # what a word begins with serves where a group has nothing else
        if worth > filled.setdefault((entry, pattern), {}).get(g, ((False, -1.0), ""))[0]:
            filled[entry, pattern][g] = (worth, words.replace("~", ""))
    rows = [(p, e, " ".join(words for _, (_, words) in sorted(groups.items()))) for (e, p), groups in filled.items()]
    made = spark.createDataFrame(rows, "made int, own string, filled string").withColumn("t", F.split("filled", " "))
    met = met_patterns(made, ["made"], "t", entries).where(F.col("made") == F.col("pattern")).select("made")
    return made.join(met, "made", "left_anti").select(F.col("own").alias("entry"), F.col("made").alias("pattern"), "filled")
