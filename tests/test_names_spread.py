"""Names are dealt out before their features are made, and blocks of features are left out of scores in one pass."""

from pyspark.sql import functions as F

from riskloom.operators import domain_model


def test_scores_are_spread_and_leave_out_blocks(spark):
    df = spark.createDataFrame([(f"shop-{i}", f"shop-{i}.in", i % 2 == 0) for i in range(40)], "name string, registrable string, y boolean")
    assert domain_model.spread(df.distinct(), "registrable").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = domain_model.layout(df, 2, 1)
    weights = domain_model.counted(df, model).cache()
    got = {r["name"]: r for r in domain_model.scores(df, model, weights, ("", "grams", "others")).collect()}
    for k, own in (("z", weights), ("z_grams", weights.where(F.col("feature") >= model.buckets)), ("z_others", weights.where(F.col("feature") < model.buckets))):
        for r in domain_model.scores(df, model, own).collect():
            assert abs(r["z"] - got[r["name"]][k]) < 1e-9
    assert len(got) == 40 and len({round(r["z_others"], 6) for r in got.values()}) > 1
