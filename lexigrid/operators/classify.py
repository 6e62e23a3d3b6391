"""A classifier of texts over hashed character features, learned and measured on parts of the labelled rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.corpus import hold_out


def features(df: DataFrame, text: str, size: int = 1024) -> DataFrame:
    """``df`` with ``features``: counts of hashed characters; rows without a text are left out."""
    return HashingTF(inputCol="__chars", outputCol="features", numFeatures=size).transform(df.where(F.col(text).isNotNull()).withColumn("__chars", F.split(text, ""))).drop("__chars")


def predicted(df: DataFrame, text: str, label: str, key: str, kind: str = "logistic", held_out: int = 10, rounds: int = 20) -> DataFrame:
    """``df`` with ``part`` ("train" or "test", by a hash of the key) and ``predicted``. Learned from the labelled rows of "train"; kind "boosted" is an ensemble of boosted trees for each label against the rest."""
    x = features(hold_out(df, key, held_out), text)
    train = x.where(F.col(label).isNotNull() & (F.col("part") == "train"))
    index = StringIndexer(inputCol=label, outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    one = LogisticRegression(maxIter=rounds, labelCol="__y") if kind == "logistic" else OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=4), labelCol="__y")
    model = one.fit(index.transform(train))
    names = F.array(*(F.lit(n) for n in index.labels))
    return model.transform(x).select(*df.columns, "part", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


def accuracy(told: DataFrame, label: str) -> DataFrame:
    """(part, n, right, share) over labelled rows."""
    t = told.where(F.col(label).isNotNull()).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(label) == F.col("predicted"), 1)).alias("right"))
    return t.withColumn("share", F.col("right") / F.col("n"))
