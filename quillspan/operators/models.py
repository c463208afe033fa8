"""Modelling jobs on Spark ML: preprocessing, models, nested cross-validation, stacking, probes.

The driver only loops over the declared grid; every fit and every score is a Spark job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.clean import logit
from quillspan.operators.metrics import auroc, select_threshold


def preprocess(numeric: Sequence[str], categorical: Sequence[str] = (), embedding: Sequence[str] = (), components: int = 0) -> list:
    """Stages that impute and scale numbers, index and encode categories (unknown ones kept apart), and reduce embedding columns; fitted on training rows only."""
    stages: list = []
    inputs = []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages += [Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_numbers", handleInvalid="keep"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
        inputs.append("_scaled")
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__index"], outputCols=[f"{c}__hot"], handleInvalid="keep")]
        inputs.append(f"{c}__hot")
    if embedding:
        stages += [VectorAssembler(inputCols=list(embedding), outputCol="_vector"), PCA(k=min(components or len(embedding), len(embedding)), inputCol="_vector", outputCol="_components")]
        inputs.append("_components")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def estimator(name: str, seed: int = 0, **params):
    """logistic, forest or boosting with class weights in column ``weight``."""
    made = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosting": GBTClassifier}[name]
    fixed = {"logistic": {"maxIter": 20, "regParam": 0.01}, "forest": {"numTrees": 20, "maxDepth": 4, "seed": seed}, "boosting": {"maxIter": 8, "maxDepth": 3, "seed": seed}}[name]
    return made(featuresCol="features", labelCol="label", weightCol="weight", **(fixed | params))


def balanced(train: DataFrame) -> DataFrame:
    """``weight`` so that the classes weigh the same; one pass counts the classes, and no stage that follows counts or joins again."""
    # a row a class
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = float(sum(sizes.values()))
    weight = reduce(lambda c, kv: c.when(F.col("label") == kv[0], total / (2 * kv[1])), ((k, n) for k, n in sizes.items() if k is not None), F.when(F.lit(False), F.lit(None).cast("double")))
    return train.filter("label IS NOT NULL").withColumn("weight", weight)


def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], model: str, embedding: Sequence[str] = (), components: int = 0, **params) -> PipelineModel:
    return Pipeline(stages=[*preprocess(numeric, categorical, embedding, components), estimator(model, **params)]).fit(balanced(train))


def score(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("probability"))


def prior(train: DataFrame, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The share of positives in training as everyone's score."""
    share = train.agg(F.avg("label").alias("probability"))
    return rows.select(*keep).crossJoin(F.broadcast(share))


def stratified_random(train: DataFrame, rows: DataFrame, keep: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """A score of 1 for as large a share of the rows, picked by hash, as is positive in training, and 0 for the others."""
    share = train.agg(F.avg("label").alias("_share"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) / 1_000_003.0
    return rows.crossJoin(F.broadcast(share)).select(*keep, (drawn < F.col("_share")).cast("double").alias("probability"))


GRID = tuple(i / 20 for i in range(1, 20))


def nested_cv(df: DataFrame, key: str, fold: str, numeric: Sequence[str], categorical: Sequence[str] = (), model: str = "logistic", grid: Sequence[dict] = ({},), inner: int = 2, folds: Sequence[int] | None = None) -> DataFrame:
    """Out-of-fold predictions: for each outer fold, parameters and threshold are chosen by inner folds of its training rows only.

    Without inner folds the first parameters are taken, and 0.5.
    """
    folds = folds if folds is not None else sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)
    keep = [key, fold, "label"]
    out = []
    for f in folds:
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        chosen, threshold = dict(grid[0]), 0.5
        best = None
        for params in grid if inner else ():
            parts = []
            for i in range(inner):
                held = F.pmod(F.xxhash64(F.col(key), F.lit(f)), F.lit(inner)) == i
                parts.append(score(fit(train.filter(~held), numeric, categorical, model, **params), train.filter(held), keep))
            scores = reduce(DataFrame.unionByName, parts)
            value = auroc(scores, []).first()[0] or 0.0
            if best is None or value > best:
                best, chosen = value, dict(params)
                threshold = select_threshold(scores.withColumn("_g", F.lit(1)), ["_g"], GRID).first()["threshold"]
        out.append(score(fit(train, numeric, categorical, model, **chosen), test, keep).withColumn("fold_threshold", F.lit(float(threshold))))
    return reduce(DataFrame.unionByName, out)


def visual_pca(df: DataFrame, key: str, fold: str, embedding: Sequence[str], dimensions: Sequence[int], inner: int = 2) -> DataFrame:
    """Out-of-fold scores with principal components of the embedding columns; their number is chosen by inner folds from the grid.

    No dimension may exceed the smallest inner training set less one, nor the number of columns; ``dimension`` is the one chosen.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)
    keep, out = [key, fold, "label"], []
    for f in folds:
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        part = F.pmod(F.xxhash64(F.col(key), F.lit(f)), F.lit(inner))
        sizes = train.agg(*[F.count_if(part != i).alias(f"n_{i}") for i in range(inner)]).first()
        most = max(1, min(*sizes, len(embedding) + 1) - 1)
        best = None
        for k in sorted({min(d, most) for d in dimensions}):
            parts = [score(fit(train.filter(part != i), [], [], "logistic", embedding, k), train.filter(part == i), keep) for i in range(inner)]
            value = auroc(reduce(DataFrame.unionByName, parts), []).first()[0] or 0.0
            if best is None or value > best[0]:
                best = value, k
        out.append(score(fit(train, [], [], "logistic", embedding, best[1]), test, keep).withColumn("dimension", F.lit(best[1])))
    return reduce(DataFrame.unionByName, out)


def crossfit(train: DataFrame, test: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], families: Sequence[str] = ("logistic", "forest", "boosting"), inner: int = 2, stop: float = 0.2) -> DataFrame:
    """Scores by cross-fitting: each inner fold picks a family on a stopping subset of its own training rows, then scores its held-out rows.

    Rows of ``train`` come back with their inner score (part inner), rows of ``test`` with the mean of the inner models (part outer).
    """
    keep = [key, "label"]
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(inner))
    stopping = F.pmod(F.xxhash64(F.col(key), F.lit("stop")), F.lit(1000)) < F.lit(1000 * stop)
    held, outer = [], []
    for i in range(inner):
        own = train.filter(fold != i)
        best = None
        for family in families:
            model = fit(own.filter(~stopping), numeric, categorical, family)
            value = auroc(score(model, own.filter(stopping), keep), []).first()[0] or 0.0
            if best is None or value > best[0]:
                best = value, family, model
        held.append(score(best[2], train.filter(fold == i), keep).withColumns({"part": F.lit("inner"), "family": F.lit(best[1])}))
        outer.append(score(best[2], test, keep).withColumn("family", F.lit(best[1])))
    mean = reduce(DataFrame.unionByName, outer).groupBy(*keep).agg(F.avg("probability").alias("probability"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("family"))
    return reduce(DataFrame.unionByName, held).unionByName(mean.withColumn("part", F.lit("outer")), allowMissingColumns=True)


def stack(train: DataFrame, test: DataFrame, components: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Logistic regression on the log-odds of component scores."""
    odds = [f"{c}__logit" for c in components]
    add = lambda t: t.withColumns({o: logit(F.col(c)) for o, c in zip(odds, components)})
    return score(fit(add(train), odds, (), "logistic"), add(test), keep)


def noise_dilution(df: DataFrame, key: str, fold: str, numeric: Sequence[str], columns: int, seed: int = 0, folds: Sequence[int] | None = None) -> DataFrame:
    """AUROC without and with ``columns`` columns of noise, and the drop; noise is a hash of the id, so it does not depend on partitions."""
    noise = [f"noise_{i}" for i in range(columns)]
    uniform = lambda i: (F.xxhash64(F.lit(seed), F.lit(i), F.col(key)).cast("double") / 9.223372036854775807e18)
    wide = df.withColumns({n: uniform(i) for i, n in enumerate(noise)})
    plain = auroc(nested_cv(df, key, fold, numeric, inner=0, folds=folds), []).withColumnRenamed("auroc", "plain")
    diluted = auroc(nested_cv(wide, key, fold, [*numeric, *noise], inner=0, folds=folds), []).withColumnRenamed("auroc", "diluted")
    return plain.crossJoin(diluted).withColumn("drop", F.col("plain") - F.col("diluted"))


def group_probe(df: DataFrame, key: str, group: str, numeric: Sequence[str], least: int = 30) -> DataFrame:
    """Balanced accuracy of predicting the group from features on held-out rows, against chance."""
    big = df.groupBy(group).count().filter(F.col("count") >= least).select(group)
    rows = df.join(F.broadcast(big), group, "left_semi").withColumn("_held", F.pmod(F.xxhash64(key), F.lit(4)) == 0)
    stages = [StringIndexer(inputCol=group, outputCol="_y", handleInvalid="skip"), *preprocess(numeric), LogisticRegression(featuresCol="features", labelCol="_y", maxIter=20, regParam=0.01)]
    found = Pipeline(stages=stages).fit(rows.filter("NOT _held")).transform(rows.filter("_held"))
    recall = found.groupBy("_y").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"), (1.0 / F.count("*")).alias("chance"), F.count("*").alias("n_groups"))


def holdout_eval(df: DataFrame, key: str, locked: str, numeric: Sequence[str], categorical: Sequence[str], model: str) -> DataFrame:
    """Scores of the locked rows by a model of all others."""
    return score(fit(df.filter(F.col(locked) == 0), numeric, categorical, model), df.filter(F.col(locked) == 1), [key, "label"])
