"""Phrases in the tokens of texts: lists of patterns, a token automaton that finds them, and an equal join beyond its bound.

Tokens and phrases are compared after `fold`, which evens out the spellings of romanised words. A token's ANY stands for any
letter, so it may be several words at once; `#` in a phrase is any number. At one place and for one list the first phrase in the
order of declaration counts. All wording is this library's own.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ANY
from ..session import give_back, ship

#: Tokens of a prepared text: Latin letters and digits (with what follows an apostrophe), Devanagari, Telugu.
TOKEN = f"[a-z0-9{ANY}₹]+(?:'[a-z]+)?|[ऀ-ॣ०-ॿ]+|[ఀ-౿]+"
#: What stands between tokens.
BETWEEN = f"[^a-z0-9{ANY}₹ऀ-ॣ०-ॿఀ-౿]*"
NUMBER = "#"
#: Phrases of a table up to this number are made an automaton and sent to every task (some 10 MB); more are joined.
MOST_PHRASES = 50_000
#: Tokens whose hits are looked for at once: a batch's rows may be many and long, and each of its tokens takes some hundred bytes.
SLICE = 1 << 17
HIT = "struct<id:string,ord:int,start:int,words:int>"

#: Spellings that romanised words differ in, and what they become; applied in turn, and once is enough.
FOLDS = [("aa+", "a"), ("ee+|ii+", "i"), ("oo+|uu+", "u"), ("([bcdgjkpt])h", "$1")]

#: Lists of phrase patterns: (a|b) for alternatives, [x] for what may be absent. Without joiners, which preparing removes.
PATTERNS = {
    "pay-to-receive": [
        "pay (a|the|our) [small] (processing|registration|handling|release|delivery|activation|file) (fee|fees|charge|charges)", "(processing|registration|handling|release|activation) (fee|fees|charge|charges) of (rs|rupees|₹|#)",
        "pay # (to|and) (get|receive|release|claim|unlock)", "pay rs # (to|and) (get|receive|release|claim|unlock)", "deposit # first", "first (pay|deposit|transfer) (a|the) (fee|charge|amount|deposit)",
    ],
    "pay-to-receive/what": ["(receive|release|get|claim|unlock|deliver|credited|delivered)"],
    "upi-receive": [
        "(enter|use|type|put) [your] upi pin to (receive|get|accept|collect)", "(accept|approve|confirm) (the|this) [collect|payment] request to (receive|get|collect)", "(accept|approve) the collect request", "your pin to (receive|get|collect) (money|the money|cashback|the refund)",
        "paise (pane|lene) ke liye [apna] [upi] pin", "pin (dalo|dalen|daliye) [aur] (paise|paisa)", "(dabbulu|money) ravadaniki pin", "पैसे पाने के लिए पिन", "पिन डालें और पैसे", "డబ్బులు పొందడానికి పిన్",
    ],
    "stay-on-call": [
        "stay on (the|this) [video] (call|line)", "(do not|don't|dont|never) (hang up|disconnect|cut the call|end the call)", "remain on (the|this) [video] call", "keep (the|your) (camera|video) on",
        "(call|phone|fon) [ko] (mat|na) (kato|katna|katiye|rakho|rakhna)", "(call|phone) (cut|band) (mat|na) (karo|karna|kariye)", "(line|call|video call) (par|pe) (rahiye|raho|bane rahiye)", "(call|phone) (cut|pettakandi) [cheyakandi]", "line lo (undandi|unde undandi)",
        "(फोन|कॉल) (मत|न) (काटना|काटिए|काटें|रखना)", "कॉल पर (बने रहें|बने रहिए|रहिए)", "కాల్ (కట్|కట్టు) చేయకండి", "లైన్ లో ఉండండి",
    ],
    "install-app": ["(install|download|open) (the|this|our|my) [support] (app|apk|application)", "(install|download) (anydesk|teamviewer|rustdesk|quick support)", "(app|apk) (install|download) (karo|karen|kariye|cheyandi|cheskondi)", "screen share (karo|karen|cheyandi)", "(ऐप|एप) (इंस्टॉल|डाउनलोड) (करें|करो)", "యాప్ (ఇన్స్టాల్|డౌన్లోడ్) చేయండి"],
    "task-job": [
        "(earn|income) (daily|per day|from home|every day|weekly)", "(like|rate|review|watch) (videos|hotels|products|reels|posts) (and|to) earn", "part time (job|work|income)", "paid (daily|per task|for each task)", "simple (online|phone) (task|tasks|job)",
        "ghar baithe (kamao|kamaiye|paise|paisa|kam)", "(roz|rozana|har din) [#] (kamao|kamaiye)", "intlo (nunchi|undi) (sampadinchandi|pani)", "घर बैठे (कमाएं|कमाओ|पैसे)", "(रोज|रोज़) कमाएं", "ఇంట్లో (నుంచి|ఉండి) సంపాదించండి",
    ],
    "investment": ["(guaranteed|assured|fixed|sure) (return|returns|profit|profits|income)", "(double|triple) your (money|investment|deposit)", "# percent (daily|weekly|monthly)", "(paisa|paise) (double|dugna|duguna)", "(pakka|pakki) (munafa|kamai)", "(పెట్టుబడి|డబ్బు) రెట్టింపు", "(पैसा|पैसे) (डबल|दोगुना|दुगना)", "पक्का मुनाफा"],
    "prize": [
        "(you have|you've|you) won", "(lucky|mega) (draw|winner|customer)", "claim your (prize|gift|reward|voucher|lottery)", "(selected|chosen) as (a|the) winner", "(lottery|jackpot) (winner|ticket|amount)",
        "(aap|ap|tum) (jeet|jit) (gaye|gaya|chuke)", "(inam|inaam|lottery) (jeeta|lagi|nikla|mila)", "miru (gelicharu|gelupondaru)", "(lottery|bahumati) (gelicharu|vachindi)", "(लॉटरी|इनाम) (लगी|निकली|जीता|मिला)", "आप जीत (गए|चुके)", "మీరు గెలిచారు", "(లాటరీ|బహుమతి) (గెలిచారు|వచ్చింది)",
    ],
    "pay-first": ["(pehle|pahle|abhi|first|mundu) (pay|bhejo|transfer|jama) [karo|cheyandi]", "(fee|charge|deposit) (jama|bhejo|bhejiye|kattandi|pampandi)", "(फीस|शुल्क) (भेजें|जमा करें|भरें)", "ముందు (డబ్బు|ఫీజు) (కట్టండి|పంపండి)"],
    "pay-first/for": ["(loan|job|parcel|prize|refund|lottery|inam|visa|naukri|udyogam)", "(लोन|नौकरी|पार्सल|इनाम|रिफंड)", "(లోన్|ఉద్యోగం|పార్సెల్|బహుమతి)"],
    "authority": [
        "(cbi|police|customs|narcotics|court|trai|enforcement|cyber cell|crime branch) (officer|department|notice|case|official|inspector)", "digital arrest", "(warrant|fir) (in|against) your name", "(police|thane|cbi|crime branch|customs) se (bol|baat)", "apke (naam|nam) (par|pe) (case|warrant|fir|parcel)",
        "(police|cbi) nunchi (matladutunnam|call)", "(पुलिस|थाने|सीबीआई) से बोल", "गिरफ्तारी वारंट", "डिजिटल अरेस्ट", "(పోలీస్|సీబీఐ) నుంచి", "అరెస్ట్ వారెంట్",
    ],
    "kyc": ["kyc", "pan card", "(केवाईसी|पैन कार्ड)", "కేవైసీ"],
    "kyc/act": ["(update|updated|verify|verified|verification|complete|expire|expired|expires|suspend|suspended|block|blocked|pending)", "(karo|karen|kariye|cheyandi|zaruri|baki)", "(अपडेट|वेरीफाई|पूरा|बंद|जरूरी)", "(అప్డేట్|పూర్తి|బ్లాక్)"],
    "parcel": ["(parcel|package|courier|shipment) [is|was|has been|could not be] (held|seized|pending|undelivered|returned|stopped|delivered)", "(parcel|courier|saman) (ruka|ruk gaya|pakda|pakda gaya|atak gaya)", "(parcel|courier) (agipoyindi|pattukunnaru)", "पार्सल (रुका|पकड़ा|अटक)", "పార్సెల్ (ఆగిపోయింది|పట్టుకున్నారు)"],
    "refund-claim": ["(claim|get|process|collect) [your] refund", "refund [is|has been] (approved|pending|due|ready)", "refund (le lo|lijiye|tisukondi)", "(paisa|paise) (wapas|vapas) (pane|lene|milenge)", "रिफंड (पाएं|लें|मिलेगा)", "రీఫండ్ (తీసుకోండి|వచ్చింది)"],
    "card-points": ["(reward|card|bonus) points [will|are going to] expire", "redeem [your|all] points", "(points|card) (khatam|band) [ho] (jayenge|jayega|ho rahe)", "card (block|band) avutundi", "पॉइंट्स (खत्म|समाप्त)", "కార్డ్ బ్లాక్ అవుతుంది"],
    "click-link": ["(click|tap|open|press) [on] (the|this|below) [given] link", "(click|tap) (here|below)", "link (par|pe|ko) (click|dabao|kholo|tap)", "link (kholo|kholiye|dabaye)", "link (ni|nu|pai|nokki) (click|nokkandi|open)", "link nokkandi", "लिंक (पर|को) (क्लिक|दबाएं|खोलें)", "లింక్ (పై|ని) (క్లిక్|నొక్కండి)"],
    "threat": [
        "legal (action|notice|proceedings)", "(account|sim|number|card|service) [will be|is being|has been|is] (blocked|suspended|closed|frozen|deactivated|terminated)", "arrest warrant", "(khata|account|sim|card|number) (band|block|freeze) (ho|hoga|kar|hone)", "(block|band) ho (jayega|jayegi|gaya|jayenge)", "giraftar (kar|ho|kiya)",
        "(account|khata|sim|card) (block|band) (avutundi|chestam|ayindi)", "(खाता|सिम|कार्ड|नंबर) (बंद|ब्लॉक) [हो]", "गिरफ्तार (कर|हो|किया)", "(ఖాతా|అకౌంట్|సిమ్|కార్డ్) (బ్లాక్|మూసివేయ|బంద్)", "కానూని చర్య",
    ],
    "urgency": [
        "(immediately|urgent|urgently)", "within # (minutes|hours|mins|hrs)", "(last|final) (chance|reminder|warning)", "(today|tonight) only", "act (now|fast|today)", "(turant|fauran|jaldi|jaldi se|abhi ke abhi)", "aaj (hi|raat|sham)", "(aakhri|akhiri) (mauka|din)", "der (mat|na) (karo|karen)", "# (ghante|minat|minute) (me|mein|ke andar)",
        "(ventane|ippude|tvaraga)", "(तुरंत|जल्दी|फौरन)", "आज (ही|रात)", "अभी (अपडेट|करें|भेजें)", "(వెంటనే|ఇప్పుడే|త్వరగా)",
    ],
    "callback": ["call (us|back|now|me) [back|now]", "call this number", "contact (us|customer care|our team|support)", "(is|neeche diye|niche diye) number (par|pe) (call|phone|sampark)", "(ee|i) number ki call", "इस नंबर पर (कॉल|फोन|संपर्क)", "ఈ నంబర్ కి కాల్"],
    "utility-cutoff": ["(electricity|power|gas|water|connection|supply) [will be|is being|line will be|connection will be] (disconnected|cut|stopped)", "(bijli|current|gas|pani) [ka connection] (kat|band) (jayegi|jayega|jaegi|hogi)", "(current|karentu) (cut|kat) (avutundi|chestam)", "बिजली (कट|काट|बंद)", "కరెంట్ (కట్|బంద్)"],
    "utility-cutoff/act": ["(call|pay|update|contact|bharo|kattandi)", "(संपर्क|भुगतान|कॉल)", "(కాల్|చెల్లించండి)"],
    "secrecy": ["kisi ko [bhi] (mat|na) (batana|batao|bataiye|batayen|bolna|kehna)", "ghar (walon|valo|me) (ko|kisi ko) (mat|na) (batana|batao)", "evariki (cheppakandi|cheppavaddu|cheppoddu)", "किसी को (मत|न|नहीं) (बताना|बताएं|बताइए|बताओ)", "ఎవరికీ చెప్పకండి"],
}


def expand(pattern: str, most: int = 2000) -> list[str]:
    """Phrases of a pattern: (a|b) for alternatives, [x] or [x|y] for what may be absent."""
    out = [""]
    for alt, opt, plain in re.findall(r"\(([^)]*)\)|\[([^\]]*)\]|([^(\[]+)", pattern):
        choices = alt.split("|") if alt else ["", *opt.split("|")] if opt else [plain]
        out = [f"{o} {c}" for o in out for c in choices]
        if len(out) > most:
            raise ValueError("too many phrases")
    return list(dict.fromkeys(" ".join(o.split()) for o in out))


def phrases(patterns: dict[str, list[str]] = PATTERNS) -> list[tuple[str, int, str]]:
    """id, place in the list and phrase of all phrases."""
    return [(k, i, p) for k, ps in patterns.items() for i, p in enumerate(dict.fromkeys(unicodedata.normalize("NFKC", x) for p in ps for x in expand(p)))]


def fold(t: Column) -> Column:
    """Lower-case text with the spellings of romanised words evened out."""
    t = F.translate(t, "wzq", "vjk")
    for pattern, to in FOLDS:
        t = F.regexp_replace(t, pattern, to)
    return t


def folded(s: str) -> str:
    """fold of a word or phrase in Python."""
    s = s.translate(str.maketrans("wzq", "vjk"))
    for pattern, to in FOLDS:
        s = re.sub(pattern, to.replace("$1", r"\1"), s)
    return s


def tokens(prepared: Column) -> Column:
    return F.regexp_extract_all(prepared, F.lit(TOKEN), F.lit(0))


class Automaton:
    """A trie of folded words as sorted edges; all places of a batch step along it together."""

    def __init__(self, rows: Iterable[tuple[str, int, str]]):
        self.ids: list[str] = []
        self.words: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for name, order, phrase in rows:
            if name not in self.ids:
                self.ids.append(name)
            state, parts = 0, phrase.split()
            for w in parts:
                word = self.words.setdefault(self.key(w), len(self.words))
                state = edges.setdefault((state, word), len(edges) + 1)
            if parts:
                ends[state].append((self.ids.index(name), order, len(parts)))
        self.width = len(self.words) + 1
        at = sorted((s * self.width + w, to) for (s, w), to in edges.items())
        self.keys, self.to = np.array([k for k, _ in at], np.int64), np.array([t for _, t in at], np.int64)
        n = len(edges) + 1
        self.end_from = np.concatenate([[0], np.cumsum([len(ends[s]) for s in range(n)])])
        self.ends = np.array([e for s in range(n) for e in ends[s]], np.int64).reshape(-1, 3)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in self.words:
            self.by_length[len(w)].append(w)

    @staticmethod
    def key(word: str) -> str:
        """What words of phrases are compared by."""
        return folded(word)

    def stands_for(self, token: str) -> list[int]:
        """The words that a token may be."""
        w = folded(token)
        if ANY in w:
            fits = re.compile("".join("." if c == ANY else re.escape(c) for c in w)).fullmatch
            return [self.words[x] for x in self.by_length.get(len(w), ()) if x != NUMBER and fits(x)]
        own = [self.words[w]] if w in self.words and w != NUMBER else []
        return own + ([self.words[NUMBER]] if NUMBER in self.words and w.isascii() and w.isdigit() else [])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have an edge by the word, and where it leads."""
        if not len(self.keys):
            return np.zeros(len(state), bool), state
        key = state * self.width + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.to[at]

    def find(self, lists: pa.Array, most: int = SLICE) -> pa.Array:
        """For each list of tokens its hits: id, ord, start (from 0) and number of words, by start and then id's place. Lists are
        taken in slices of about `most` tokens, so that memory does not grow with a batch."""
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(lists)]
        made = [self.find_slice(lists.slice(i, j - i)) for i, j in zip(cuts, cuts[1:])]
        return made[0] if len(made) == 1 else pa.concat_arrays(made)

    def find_slice(self, lists: pa.Array) -> pa.Array:
        """find of one slice."""
        size = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
        values = lists.flatten().dictionary_encode()
        row_end = np.repeat(np.cumsum(size), size)
        row_start = row_end - np.repeat(size, size)
        fits = [self.stands_for(t) for t in values.dictionary.to_pylist()]
        many = np.array([len(f) for f in fits] or [0], np.int64)
        first = np.concatenate([[0], np.cumsum(many)])
        flat = np.array([w for f in fits for w in f], np.int64)
        token = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)

        def onward(start, state, depth):
            """All steps from states that began at `start` by the token `depth` places on."""
            inside = start + depth < row_end[start]
            start, state = start[inside], state[inside]
            t = token[start + depth]
            n = many[t]
            own = np.repeat(np.arange(len(start)), n)
            word = flat[np.repeat(first[t] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(len(own))] if len(own) else own
            ok, to = self.step(state[own], word)
            return start[own][ok], to[ok]

        start = np.arange(len(token))
        start, state = onward(start, np.zeros(len(start), np.int64), 0)
        found, depth = [], 1
        while len(start):
            n = self.end_from[state + 1] - self.end_from[state]
            own = np.repeat(np.arange(len(start)), n)
            if len(own):
                at = np.repeat(self.end_from[state] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(own))
                found.append(np.column_stack([start[own], self.ends[at]]))
            start, state = onward(start, state, depth)
            depth += 1
        hits = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        hits = hits[np.lexsort([hits[:, 2], hits[:, 1], hits[:, 0]])]
        keep = np.ones(len(hits), bool)
        keep[1:] = (hits[1:, :2] != hits[:-1, :2]).any(axis=1)  # the first declared at a place
        hits = hits[keep]
        ends = np.concatenate([[0], np.cumsum(size)])
        offsets = np.searchsorted(hits[:, 0], ends, "left").astype(np.int32)
        names = pa.array(self.ids, pa.string()).take(pa.array(hits[:, 1])) if self.ids else pa.array([], pa.string())
        parts = [names, *[pa.array(x.astype(np.int32)) for x in (hits[:, 2], hits[:, 0] - row_start[hits[:, 0]] if len(hits) else hits[:, 0], hits[:, 3])]]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["id", "ord", "start", "words"]))


@functools.lru_cache(maxsize=1)
def own_automaton() -> Automaton:
    return Automaton(phrases())


def finder(spark, automaton: Automaton | None = None, make: Callable[[], Automaton] = own_automaton):
    """A function of a tokens column that gives its hits by an automaton, or by the one that `make` builds in each task's process."""
    ship(spark)

    @F.arrow_udf(f"array<{HIT}>")
    def find(lists: pa.Array) -> pa.Array:
        try:
            return (automaton or make()).find(lists)
        finally:
            give_back()

    return find


def phrase_hits(df: DataFrame, key: list[str], tokens_col: str, lexicon: DataFrame, most: int = MOST_PHRASES) -> DataFrame:
    """key, pos, id and phrase of the phrases of a lexicon (id, ord, phrase) in lists of tokens; of a list's phrases that begin at
    one place the first by ord. Up to `most` phrases are an automaton, which every task gets; more meet the tokens by a join."""
    rows = lexicon.select("id", "ord", "phrase").limit(most + 1).collect()  # bounded; beyond the bound nothing of it is used
    if len(rows) > most:
        return joined_hits(df, key, tokens_col, lexicon)
    ordered = sorted(map(tuple, rows), key=lambda r: (r[0], r[1]))
    text = {(r[0], r[1]): r[2] for r in ordered}
    names = df.sparkSession.createDataFrame([(i, o, p) for (i, o), p in text.items()], "id string, ord int, phrase string")
    found = df.select(*key, F.explode(finder(df.sparkSession, Automaton(ordered))(F.col(tokens_col))).alias("h"))
    return found.select(*key, F.col("h.start").alias("pos"), "h.id", "h.ord").join(F.broadcast(names), ["id", "ord"]).select(*key, "pos", "id", "phrase")  # at most `most` rows


def joined_hits(df: DataFrame, key: list[str], tokens_col: str, lexicon: DataFrame) -> DataFrame:
    """phrase_hits by shuffles, for lexicons of any size: each word of a phrase meets its tokens, and a phrase is found where all of
    its words meet one place. Tokens with ANY meet words by length and their first plain letter or none."""
    words = lexicon.select("id", "ord", "phrase", F.size(F.split("phrase", " ")).alias("n"), F.posexplode(F.split("phrase", " ")).alias("k", "w")).withColumn("w", fold(F.col("w")))
    spots = df.select(*key, F.posexplode(tokens_col).alias("at", "token")).withColumn("token", fold(F.col("token")))
    distinct = spots.select("token").distinct()
    have = words.select("w").distinct()
    plain = distinct.where(~F.contains("token", F.lit(ANY))).join(have, F.col("token") == F.col("w")).where(F.col("w") != NUMBER)
    odd = distinct.where(F.contains("token", F.lit(ANY)))
    masked = odd.join(have.where(F.col("w") != NUMBER), (F.length("token") == F.length("w")) & F.like("w", F.translate("token", ANY, "_")))
    number = distinct.where(F.col("token").rlike("^[0-9]+$")).withColumn("w", F.lit(NUMBER))
    means = plain.unionByName(masked).unionByName(number)
    met = spots.join(means, "token").join(words, "w").withColumn("pos", F.col("at") - F.col("k")).groupBy(*key, "pos", "id", "ord", "phrase", "n").agg(F.count_distinct("k").alias("met"))
    return met.where(F.col("met") == F.col("n")).groupBy(*key, F.col("pos").cast("int").alias("pos"), "id").agg(F.min_by("phrase", "ord").alias("phrase"))
