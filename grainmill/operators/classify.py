"""Text classifiers of Spark ML over hashed bags of words."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentValueError
from . import text as text_ops

MODELS = {
    "bayes": lambda: NaiveBayes(featuresCol="f", labelCol="y", modelType="multinomial"),
    "bernoulli": lambda: NaiveBayes(featuresCol="f", labelCol="y", modelType="bernoulli"),
    "tree": lambda: DecisionTreeClassifier(featuresCol="f", labelCol="y", maxDepth=5, seed=0),
    "maxent": lambda: LogisticRegression(featuresCol="f", labelCol="y", maxIter=30, regParam=0.01),
}


def bag(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_t", text_ops.tokens(F.col(text)))


def train(df: DataFrame, text: str, label: str, kind: str = "bayes", features: int = 1 << 12) -> PipelineModel:
    if kind not in MODELS:
        raise ArgumentValueError(f"one of {sorted(MODELS)}")
    rows = bag(df, text).withColumn("y", F.col(label).cast("double"))
    return Pipeline(stages=[HashingTF(inputCol="_t", outputCol="f", numFeatures=features, binary=kind == "bernoulli"), MODELS[kind]()]).fit(rows)


def classify(df: DataFrame, rows: DataFrame, key: str, text: str, label: str, kind: str = "bayes") -> DataFrame:
    """(key, predicted, score) of rows, learned from df; score is the probability of the second class."""
    out = train(df, text, label, kind).transform(bag(rows, text))
    return out.select(key, F.col("prediction").cast("int").alias("predicted"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def naive_bayes(train: DataFrame, rows: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, predicted, score) of rows by multinomial naive Bayes learned from train; score is the probability of class 1.

    Term counts of the two classes are one aggregate, weights one row a term (Laplace's rule), and a
    text's log odds one sum over its terms. Terms that train lacks say nothing.
    """
    terms = train.select(F.col(label).cast("int").alias("_y"), F.explode(text_ops.tokens(F.col(text))).alias("_w"))
    counts = terms.groupBy("_w").agg(F.count(F.when(F.col("_y") == 1, 1)).alias("_a"), F.count(F.when(F.col("_y") == 0, 1)).alias("_b"))
    sums = counts.agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"), F.count("*").alias("_v"))
    weights = counts.crossJoin(F.broadcast(sums)).select("_w", (F.log((F.col("_a") + 1) / (F.col("_sa") + F.col("_v"))) - F.log((F.col("_b") + 1) / (F.col("_sb") + F.col("_v")))).alias("_s"))
    prior = train.agg(F.log(F.count(F.when(F.col(label) == 1, 1)) / F.count(F.when(F.col(label) == 0, 1))).alias("_p"))
    found = rows.select(key, F.explode(text_ops.tokens(F.col(text))).alias("_w")).groupBy(key, "_w").agg(F.count("*").alias("_n"))
    odds = found.join(weights, "_w").groupBy(key).agg(F.sum(F.col("_n") * F.col("_s")).alias("_o"))
    out = rows.select(key).join(odds, key, "left").crossJoin(F.broadcast(prior))
    margin = F.coalesce("_o", F.lit(0.0)) + F.col("_p")
    return out.select(key, (margin > 0).cast("int").alias("predicted"), (1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(500.0)), F.lit(-500.0))))).alias("score"))


def accuracy(df: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def positive_bayes(positive: DataFrame, unlabelled: DataFrame, text: str, prior: float = 0.5) -> DataFrame:
    """(term, weight): log odds of a term's presence, learned from positive and unlabelled texts only."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        terms = df.select(F.explode(F.array_distinct(text_ops.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("_n"))
        return terms.crossJoin(F.broadcast(df.agg(F.count("*").alias("_d")))).select("term", ((F.col("_n") + 0.5) / (F.col("_d") + 1)).alias(name))

    both = shares(positive, "p").join(shares(unlabelled, "u"), "term", "full").fillna(1e-6)
    negative = F.greatest((F.col("u") - prior * F.col("p")) / (1 - prior), F.lit(1e-6))
    return both.select("term", F.log(F.col("p") / negative).alias("weight"))
