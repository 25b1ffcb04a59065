"""Walk-forward classifiers on the stacked panel, with Spark's own learners."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .resample import walk_forward_folds


def stack(panel: DataFrame, features: list[str], label: str) -> DataFrame:
    """session, symbol, features, label: complete rows only."""
    return panel.select("session", "symbol", *features, label).na.drop()


def estimator(model: str, features: list[str], label: str) -> Pipeline:
    v = VectorAssembler(inputCols=features, outputCol="_raw")
    if model == "gbt":
        return Pipeline(stages=[v, GBTClassifier(featuresCol="_raw", labelCol=label, maxIter=20, seed=0)])
    return Pipeline(stages=[v, StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.1)])


def walk_forward(rows: DataFrame, features: list[str], label: str, model: str = "logistic", train: int = 756, test: int = 252, purge: int = 5) -> DataFrame:
    """session, symbol, label, prob, fold of expanding training windows; stops at a training window of one class.

    Folds are a handful of date ranges from the driver; each fit and prediction is a Spark job over its rows.
    """
    out = []
    for f in walk_forward_folds(rows.select("session").distinct(), train, test, purge).orderBy("fold").collect():
        past = rows.where(F.col("session").between(f["train_from"], f["train_to"]))
        if past.select(label).distinct().limit(2).count() < 2:
            break
        fitted = estimator(model, features, label).fit(past)
        now = fitted.transform(rows.where(F.col("session").between(f["test_from"], f["test_to"])))
        out.append(now.select("session", "symbol", label, vector_to_array("probability")[1].alias("prob"), F.lit(f["fold"]).alias("fold")))
    if not out:
        return rows.select("session", "symbol", label).limit(0).withColumns({"prob": F.lit(0.0), "fold": F.lit(0)})
    return reduce(DataFrame.unionByName, out)


#: Rows that explanations are computed on, in hash order.
SAMPLE, REPEATS, GRID = 5000, 5, 10


def _sampled(rows: DataFrame, features: list[str], label: str, size: int, seed: int) -> DataFrame:
    """no (from 0), features and label of at most `size` rows in hash order: a bounded sample, of whole rows."""
    few = rows.select("session", "symbol", *features, label).orderBy(F.xxhash64(F.lit(seed), "session", "symbol"), "session", "symbol").limit(size)
    return few.withColumn("no", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "session", "symbol"), "session", "symbol")) - 1)


def explain(fitted, rows: DataFrame, features: list[str], label: str, seed: int = 0, size: int = SAMPLE, repeats: int = REPEATS, grid: int = GRID) -> DataFrame:
    """kind, feature, at, value, sd: permutation importance (kind `importance`: mean and sd of the log loss that
    dealing a feature's values anew adds, at NULL) and partial dependence (kind `dependence`: mean probability with the feature set to `at`).

    All changed copies of the sample are rows of one table, scored by one pass of the model. Values are dealt by hashed order, once for each repeat; the
    grid goes in equal steps from the 5th to the 95th percentile.
    """
    base = written(_sampled(rows, features, label, size, seed), "explained")
    spread = base.agg(*[F.expr(f"percentile(`{f}`, array(0.05, 0.95))").alias(f) for f in features])
    places = spread.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f)[0].alias("low"), F.col(f)[1].alias("high")) for f in features])).alias("s")).select("s.*")
    steps = places.select("feature", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"), "low", "high").select("feature", F.lit(-1).alias("repeat"), (F.col("low") + F.col("i") / (grid - 1) * (F.col("high") - F.col("low"))).alias("at"))
    deals = base.sparkSession.createDataFrame([(f, r) for f in features for r in range(repeats)] + [(None, -1)], "feature string, repeat int")
    # values of each feature in the order of each repeat's hash; the sample is bounded, and so is each of these windows
    dealt = base.select("no", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("no", "x.*")
    dealt = dealt.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.row_number().over(Window.partitionBy("feature", "repeat").orderBy(F.xxhash64(F.lit(seed), "feature", "repeat", "no"), "no")) - 1
    dealt = dealt.select("feature", "repeat", order.alias("no"), F.col("v").alias("at"))
    copies = base.join(F.broadcast(deals.where("feature IS NOT NULL"))).join(dealt, ["feature", "repeat", "no"]).unionByName(base.join(F.broadcast(steps))).unionByName(base.withColumns({"feature": F.lit(None).cast("string"), "repeat": F.lit(-2), "at": F.lit(None).cast("double")}))
    changed = copies.withColumns({f: F.when(F.col("feature").eqNullSafe(f), F.col("at")).otherwise(F.col(f).cast("double")) for f in features})
    p = F.least(F.greatest(F.col("_p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    scored = fitted.transform(changed).withColumn("_p", vector_to_array("probability")[1])
    means = written(scored.groupBy("feature", "repeat", F.when(F.col("repeat") == -1, F.col("at")).alias("at")).agg(F.avg(loss).alias("loss"), F.avg("_p").alias("p")), "explained")
    plain = means.where("repeat = -2").select(F.col("loss").alias("plain"))
    importance = means.where("repeat >= 0").join(F.broadcast(plain)).groupBy("feature").agg(F.avg(F.col("loss") - F.col("plain")).alias("value"), F.stddev_pop(F.col("loss") - F.col("plain")).alias("sd"))
    dependence = means.where("repeat = -1").select(F.lit("dependence").alias("kind"), "feature", "at", F.col("p").alias("value"), F.lit(None).cast("double").alias("sd"))
    return importance.select(F.lit("importance").alias("kind"), "feature", F.lit(None).cast("double").alias("at"), "value", "sd").unionByName(dependence)
