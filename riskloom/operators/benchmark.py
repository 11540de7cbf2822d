"""One benchmark run: several candidates at several margins cross-validated together, their sizes, the winner, and its test.

Rows of all candidates go through one pass with the candidate as a key. A text's features are made where it is read, once to be
counted and once to be weighed; only counts are written. Stages are written to a store under the digest of what they were made of,
so a run that stopped goes on where it was, and another input makes other stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..session import exists
from . import lineage, textmodel
from .selection import FOLDS, fold_counts, fold_scores

Candidates = dict[str, dict[str, str] | Callable[[Column], Column]]

#: What features are made of: parts of a text. Candidates: the parts that a text's features are, and what stands before their names;
#: a function of the text gives features that are no part of another candidate.
PARTS: dict[str, Callable[[Column], Column]] = {"words": textmodel.words, "marks": textmodel.marks, "trigrams": lambda t: textmodel.ngrams(t, 3, 3)}
CANDIDATES: Candidates = {"words": {"words": ""}, "words_flags": {"words": "", "marks": ""}, "trigrams": {"trigrams": ""}, "words_trigrams": {"words": "", "trigrams": "~"}}
MARGINS = (0.90, 0.95)
#: Bytes of a stored weight besides its feature's name.
WEIGHT_BYTES = 4


class Stages:
    """A folder of finished stages, each under its name and the key of its run."""

    def __init__(self, folder: str, key: str):
        self.folder, self.key, self.made = folder, key, []

    def stage(self, name: str, df: Callable[[], DataFrame]) -> DataFrame:
        """The stage as it was written, made now if it is not there whole."""
        out = f"{self.folder}/{self.key}/{name}"
        built = df()
        if not exists(built.sparkSession, f"{out}/_SUCCESS"):
            built.write.mode("overwrite").parquet(out)
            self.made.append(name)
        return built.sparkSession.read.schema(built.schema).parquet(out)


def parted(candidates: Candidates) -> tuple[list[Callable[[Column], Column]], list[tuple[str, int, int]]]:
    """The different parts of all candidates, and candidate, part's place and bytes before its names."""
    given = {k: c if isinstance(c, dict) else {k: ""} for k, c in candidates.items()}
    own = {k: c for k, c in candidates.items() if not isinstance(c, dict)}
    names = list(dict.fromkeys((p, k in own) for k, c in given.items() for p in c))
    return [own[p] if alone else PARTS[p] for p, alone in names], [(k, names.index((p, k in own)), len(before.encode())) for k, c in given.items() for p, before in c.items()]


def sizes(counts: DataFrame, least: int, members: list[tuple[str, int, int]]) -> DataFrame:
    """candidate and bytes of a model of all rows. counts: fold_counts' rows. members: see parted."""
    each = counts.where(F.col("n") >= least).groupBy("part").agg(F.sum(F.col("size") + WEIGHT_BYTES).alias("own"), F.count("*").alias("kinds"))
    made = counts.sparkSession.createDataFrame(members, "candidate string, part int, before int")
    return each.join(F.broadcast(made), "part").groupBy("candidate").agg(F.sum(F.col("own") + F.col("before") * F.col("kinds")).cast("long").alias("bytes"))  # a row for each part of a candidate


def compared(at: DataFrame, margins: tuple[float, ...], folds: int = FOLDS) -> DataFrame:
    """candidate, margin, pooled confusion of the held-out rows, rates, the folds' least and greatest precision and the folds without a
    threshold: the one of best recall whose precision's lower bound reaches the margin. at: score_counts' rows."""
    w = Window.partitionBy("candidate", "f").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)  # different scores, not rows
    run = at.where(~F.col("held")).select("candidate", "f", "s", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"))
    low, _ = stats.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    asked = run.withColumn("lo", low).withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    picked = asked.where(F.col("lo") >= F.col("margin")).groupBy("candidate", "margin", "f").agg(F.max_by("s", F.struct("tp", "s")).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    per = at.where("held").join(F.broadcast(picked), ["candidate", "f"]).groupBy("candidate", "margin", "f").agg(*[F.sum(F.when(c, F.col(k)).otherwise(0)).alias(name) for name, c, k in (("tp", hit, "p"), ("fp", hit, "n"), ("fn", ~hit, "p"), ("tn", ~hit, "n"))])  # a row a candidate, margin and fold
    precision = stats.ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    asked_for = at.select("candidate").distinct().withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    each = asked_for.join(per, ["candidate", "margin"], "left")
    pooled = each.groupBy("candidate", "margin").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")], F.round(F.min(precision), 6).alias("least_precision"), F.round(F.max(precision), 6).alias("most_precision"), (folds - F.count("f")).alias("without_threshold"))
    return stats.rates(pooled)


def run(base: DataFrame, near: DataFrame, folder: str, candidates: Candidates = CANDIDATES, margins: tuple[float, ...] = MARGINS, least: int = 5, policy: dict | None = None) -> tuple[DataFrame, Stages]:
    """A row for each candidate and margin: its rates over the folds that have a threshold, size, whether that is over budget, and which
    one wins: best recall among those within budget whose precision's lower bound reaches the policy's, then the smaller, then by name.

    base: id, key, y, t, fold, inner (see selection.prepared). near: keys that are not held out, or their digests; it is read twice.
    folder: the store of stages.
    """
    from .evaluate import POLICY

    rules = POLICY | (policy or {})
    inputs = lineage.record({"base": base, "near": near}, {"candidates": sorted(candidates), "margins": margins, "least": least, "policy": rules})
    stages = Stages(folder, lineage.run_key(inputs).first()["key"])
    parts, members = parted(candidates)
    kept = stages.stage("features", lambda: fold_counts(base, parts))
    small = stages.stage("sizes", lambda: sizes(kept, least, members))
    at = stages.stage("scores", lambda: fold_scores(base, kept, near, least, parts, [(k, p) for k, p, _ in members]))
    ranked = stages.stage("ranked", lambda: compared(at, margins).join(F.broadcast(small), "candidate").withColumn("over_budget", F.col("bytes") > rules["most_model_bytes"]))
    named = ranked.select("*", F.concat_ws("@", "candidate", F.col("margin").cast("string")).alias("name"))
    winner = textmodel.select_winner(named, rules["most_model_bytes"], rules["least_precision"]).select("name", F.lit(True).alias("wins"))
    told = named.join(F.broadcast(winner), "name", "left").withColumn("winner", F.coalesce("wins", F.lit(False))).drop("name", "wins")  # one row
    return told, stages
