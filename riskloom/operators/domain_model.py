"""The trained model of domain names: layout of its features, training, weights as a table, scores, bands, checks, fingerprint.

Features are the name's hashed n-grams (each 1 over the root of their number), one bin for each counted number, and the ending
(one more place for endings that the model does not know). Their numbers follow one after the other; a table of whole weights
(feature, q) is the model, which scores meet by a join.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..session import written
from . import links, names, training

#: Whole weights for each unit, and the least weight of an n-gram that is kept.
SCALE, LEAST_WEIGHT = 20, 0.1


@dataclass
class Model:
    """What is needed besides the table of weights. bins: ascending edges for each number; endings: the known ones."""

    bins: dict[str, list[float]]
    endings: list[str]
    bias: float = 0.0
    calibration: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=lambda: {"elevated": 0.0, "high": 0.0})
    buckets: int = names.BUCKETS

    def places(self) -> dict[str, int]:
        """The first feature of each number's block and of the endings' block."""
        out, at = {}, self.buckets
        for k, cuts in self.bins.items():
            out[k], at = at, at + len(cuts) + 1
        return out | {"ending": at}

    def size(self) -> int:
        return self.places()["ending"] + len(self.endings) + 1


def endings(df: DataFrame, least: int = 30) -> DataFrame:
    """Endings (df: registrable) with at least `least` names, and their support."""
    return df.groupBy(names.ending_of(F.col("registrable")).alias("ending")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def layout(df: DataFrame, bins: int = 4, least: int = 30) -> Model:
    """A model without weights: edges and endings of df (name, registrable). They are few: bins - 1 a number, and one row an ending."""
    values = df.select(*[measured(v).alias(k) for k, v in names.numbers(F.col("name"), F.col("registrable")).items()])
    cuts = {k: sorted({float(r["edge"]) for r in names.edges(values.select(k), k, bins).collect()}) for k in values.columns}
    return Model(cuts, sorted(r["ending"] for r in endings(df, least).collect()))


def measured(number: Column) -> Column:
    """A number as it is compared with edges: to six digits, so that equal names fall into one bin on any machine."""
    return F.round(number.cast("double"), 6)


def bins_of(model: Model) -> dict[str, Column]:
    """The bin of each number of name and registrable; a number equal to an edge is below it."""
    return {k: names.bin_of(measured(v), model.bins[k]) for k, v in names.numbers(F.col("name"), F.col("registrable")).items()}


def ending_place(model: Model) -> Column:
    """The ending's place among the known ones (from 0), or the one after the last."""
    known = F.array(*[F.lit(e) for e in model.endings]).cast("array<string>")
    place = F.array_position(known, names.ending_of(F.col("registrable")))
    return F.when(place > 0, place - 1).otherwise(len(model.endings)).cast("int")


def featured(df: DataFrame, model: Model) -> DataFrame:
    """df with `grams` (buckets) and `others` (numbers of the features that are 1)."""
    at = model.places()
    others = [F.lit(at[k]) + b for k, b in bins_of(model).items()] + [F.lit(at["ending"]) + ending_place(model)]
    return df.withColumns({"grams": F.transform(names.buckets(F.col("name"), model.buckets), lambda b: b.cast("int")), "others": F.array(*[x.cast("int") for x in others])})


def vectors(df: DataFrame, model: Model) -> DataFrame:
    """featured rows with a sparse vector `features`."""
    texts = lambda c: F.transform(c, lambda x: x.cast("string"))
    d = featured(df, model).withColumns({"_g": texts(F.col("grams")), "_o": texts(F.col("others"))})
    first = CountVectorizerModel.from_vocabulary([str(i) for i in range(model.buckets)], inputCol="_g", outputCol="_gv").setBinary(True)
    rest = CountVectorizerModel.from_vocabulary([str(i) for i in range(model.buckets, model.size())], inputCol="_o", outputCol="_ov").setBinary(True)
    d = Normalizer(p=2.0, inputCol="_gv", outputCol="_gn").transform(first.transform(d))
    return VectorAssembler(inputCols=["_gn", "_ov"], outputCol="features").transform(rest.transform(d)).drop("_g", "_o", "_gv", "_ov", "_gn", "grams", "others")


def train(df: DataFrame, model: Model, penalty: float = 0.001, rounds: int = 40) -> tuple[Model, DataFrame]:
    """The model with its bias, and its weights (feature, q); df: name, registrable, y. Rows stay spread over the tasks."""
    rows = vectors(df, model).select("features", F.col("y").cast("double").alias("label"))
    fitted = LogisticRegression(regParam=penalty, maxIter=rounds, standardization=False).fit(rows)
    model.bias = round(float(fitted.intercept) * SCALE) / SCALE
    kept = [(i, int(w * SCALE + 0.5 // 1) if w >= 0 else -int(-w * SCALE + 0.5)) for i, w in enumerate(fitted.coefficients.toArray().tolist()) if abs(w) >= LEAST_WEIGHT or i >= model.buckets]
    return model, df.sparkSession.createDataFrame([k for k in kept if k[1]], "feature int, q int")


def counted(df: DataFrame, model: Model, least: int = 2) -> DataFrame:
    """Weights (feature, q) without training: smoothed log ratios of the labels of the names that have a feature, of which there are
    `least` at least. df: name, registrable, y; one row a name."""
    rows = featured(df, model).select("y", F.explode(F.concat("grams", "others")).alias("feature"))
    totals = df.agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    each = rows.groupBy("feature").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")).where(F.col("pos") + F.col("neg") >= least)
    w = F.log((F.col("pos") + 1) / (F.col("p") + 2)) - F.log((F.col("neg") + 1) / (F.col("n") + 2))
    kept = each.crossJoin(F.broadcast(totals)).select("feature", w.alias("w")).where((F.col("feature") >= model.buckets) | (F.abs("w") >= LEAST_WEIGHT))  # one row of totals
    return kept.select("feature", F.floor(F.col("w") * SCALE + 0.5).cast("int").alias("q"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as the session shuffles to: names are short and their features costly, so that a number made from
    bytes would leave them to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def scores(df: DataFrame, model: Model, weights: DataFrame, without: tuple[str, ...] = ("",)) -> DataFrame:
    """name, registrable and z of each different pair; z_grams or z_others, if asked for, leaves that block of features out. Only
    features with a weight are summed."""
    d = featured(spread(df.select("name", "registrable"), "name", "registrable").distinct(), model)
    share = 1 / F.sqrt(F.greatest(F.size("grams"), F.lit(1)))
    each = F.concat(F.transform("grams", lambda g: F.struct(g.alias("feature"), share.alias("x"))), F.transform("others", lambda o: F.struct(o.alias("feature"), F.lit(1.0).alias("x"))))
    rows = d.select("name", "registrable", F.explode(each).alias("f")).select("name", "registrable", "f.*")
    worth, gram = F.coalesce("q", F.lit(0)) * F.col("x"), F.col("feature") < model.buckets
    kept = {"": worth, "grams": F.when(gram, 0.0).otherwise(worth), "others": F.when(gram, worth).otherwise(0.0)}
    z = [(F.sum(kept[w]) / SCALE + F.lit(model.bias)).alias(f"z_{w}" if w else "z") for w in without]
    return rows.join(F.broadcast(weights), "feature", "left").groupBy("name", "registrable").agg(*z)  # a row a feature, of which the model has a fixed number


def calibrate(scored: DataFrame, model: Model, high_fpr: float = 0.001, elevated_fpr: float = 0.01) -> Model:
    """The model with slope and offset of the chance, and thresholds by the share of negatives above them. scored: z, y."""
    model.calibration = training.platt(scored, F.col("z"), F.col("y").cast("int"))
    at = lambda fpr: float(training.threshold_at(scored, F.col("z"), F.col("y"), fpr).first()["threshold"] or 0.0)
    model.thresholds = {"elevated": at(elevated_fpr), "high": at(high_fpr)}
    return model


def banded(scored: DataFrame, model: Model) -> DataFrame:
    """scored with the chance and the band: high, elevated or none."""
    z, (a, b) = F.col("z"), model.calibration
    band = F.when(z >= model.thresholds["high"], "high").when(z >= model.thresholds["elevated"], "elevated").otherwise("none")
    return scored.withColumns({"probability": names.calibrated(z, a, b), "band": band})


def at_threshold(scored: DataFrame, threshold: float, prevalences: tuple[float, ...] = (0.01, 0.1, 0.3)) -> DataFrame:
    """Recall and false positive rate at a threshold, and the precision that they mean at each prevalence."""
    hit = F.col("z") >= threshold
    rates = scored.agg((F.count_if(hit & F.col("y")) / F.nullif(F.count_if("y"), F.lit(0))).alias("recall"), (F.count_if(hit & ~F.col("y")) / F.nullif(F.count_if(~F.col("y")), F.lit(0))).alias("fpr"))
    return rates.select("*", *[stats.precision_at(F.col("recall"), F.col("fpr"), F.lit(p)).alias(f"precision_{round(p * 100)}") for p in prevalences])


def grid(rows: DataFrame, validation: DataFrame, bins: tuple[int, ...] = (4,), penalties: tuple[float, ...] = (0.0003, 0.003), least: int = 30) -> list[dict]:
    """Each setting's AUC on the validation names, best first; `without` leaves a block of features out (an ablation)."""
    out = []
    for b in bins:
        for p in penalties:
            model, weights = train(rows, layout(rows, b, least), p)
            blocks = ("", "grams", "others")
            z = written(scores(validation, model, weights, blocks).join(validation.select("name", "registrable", "y").distinct(), ["name", "registrable"]))
            for without in blocks:
                out.append({"bins": b, "penalty": p, "without": without, "auc": stats.auc(z, F.col(f"z_{without}" if without else "z"), F.col("y")).first()["auc"]})
    return sorted(out, key=lambda x: -(x["auc"] or 0.0))


def problems(model: Model, weights: DataFrame) -> list[str]:
    """What makes a model unusable; none for a good one."""
    found = []
    if set(model.bins) != set(names.numbers(F.lit(""), F.lit(""))):
        found.append("bins do not match the numbers")
    if any(b < a for cuts in model.bins.values() for a, b in zip(cuts, cuts[1:])):
        found.append("edges are not ascending")
    if len(set(model.endings)) != len(model.endings):
        found.append("an ending occurs twice")
    if model.thresholds["elevated"] > model.thresholds["high"]:
        found.append("thresholds are not in order")
    n = weights.agg(F.count("*").alias("n"), F.count_if((F.col("feature") < 0) | (F.col("feature") >= model.size()) | F.col("q").isNull()).alias("bad"), F.count_distinct("feature").alias("features")).first()
    if not n["n"]:
        found.append("weights are missing")
    if n["bad"]:
        found.append("weights are out of range")
    if n["features"] != n["n"]:
        found.append("a feature has two weights")
    return found


def fingerprint(model: Model, weights: DataFrame) -> str:
    """SHA-256 of the layout and of the weights in order; equal models have equal ones, whatever the order of rows."""
    rows = weights.groupBy(F.floor(F.col("feature") / 1024).alias("part")).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("feature", "q")))), 256).alias("digest"))
    digests = [r["digest"] for r in rows.orderBy("part").collect()]  # one for each 1024 features
    whole = json.dumps([{k: v for k, v in asdict(model).items()}, digests], sort_keys=True)
    return str(weights.sparkSession.range(1).select(F.sha2(F.lit(whole), 256)).first()[0])


def publish(model: Model, weights: DataFrame, folder: str) -> str:
    """Adds a model to a store of versions and returns its version, the fingerprint; a version that is there stays as it is."""
    version, spark = fingerprint(model, weights), weights.sparkSession
    weights.withColumn("version", F.lit(version)).write.mode("ignore").parquet(f"{folder}/weights/{version}")
    layout_row = spark.createDataFrame([(version, json.dumps(asdict(model)))], "version string, layout string")
    layout_row.write.mode("ignore").parquet(f"{folder}/layouts/{version}")  # last: a version without a layout is not there
    return version


def read(spark: SparkSession, folder: str, version: str) -> tuple[Model, DataFrame]:
    """A published model; fails if it is not what its version says."""
    held = json.loads(spark.read.parquet(f"{folder}/layouts/{version}").first()["layout"])
    model = Model(**held | {"calibration": tuple(held["calibration"])})
    weights = spark.read.parquet(f"{folder}/weights/{version}").select("feature", "q")
    if fingerprint(model, weights) != version:
        raise ValueError(f"the stored model is not version {version}")
    return model, weights


def high_names(scored: DataFrame, threshold: float) -> DataFrame:
    """Registrable domains whose name scores the threshold or more."""
    return scored.where(F.col("z") >= threshold).select("registrable").distinct()


def level_matrix(df: DataFrame, link: str, high: DataFrame) -> DataFrame:
    """How many addresses have each level by the rules alone (without) and with the name model's word (with)."""
    alone = links.level().alias("without")
    both = links.judged(df, link, high).select(alone, F.col("level").alias("with"))
    return both.groupBy("without", "with").agg(F.count("*").alias("n"))


def baselines(df: DataFrame) -> DataFrame:
    """what and auc of models that look at one thing of a name only; df: name, y."""
    looks = {"length": F.length("name"), "digits": F.regexp_count("name", F.lit("[0-9]")), "hyphens": F.regexp_count("name", F.lit("-"))}
    out = [stats.auc(df, x, F.col("y")).select(F.lit(k).alias("what"), "auc") for k, x in looks.items()]
    return reduce(DataFrame.unionByName, out)
