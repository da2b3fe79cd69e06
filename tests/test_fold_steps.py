"""Newton steps read the folds that were dealt once."""

from pyspark.sql import functions as F

from lodestrand.operators import learn


def test_folds_are_dealt_once(spark, monkeypatch):
    read = []
    plain = learn.logistic_folds
    monkeypatch.setattr(learn, "logistic_folds", lambda df, *a: (read.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, *a))[1])
    df = spark.range(400).select("id", (F.col("id") % 3 % 2).cast("int").alias("label"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("a"))
    got = learn.cross_validated_auc(df, ["a"], "label", "id").collect()
    assert sum(r["n"] for r in got) == 400 and len(read) == 1
    assert "Window" not in read[0] and "Join" not in read[0]
