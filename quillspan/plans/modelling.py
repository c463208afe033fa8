"""Queries of the decision tables and of the Spark ML jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.clean import clean_category, clean_range
from quillspan.operators import bootstrap, decide, metrics, models, resample
from quillspan.plans.base import Book
from quillspan.plans.evaluation import B, DRAWS, F4, FOLDS_UP, G, GROUP, P, PAIRED, auroc_sql, draws_of, folds_up, predictions
from quillspan.sources.shared import written
from quillspan.sources.tables import role, table

book = Book()
QUERIES, SQL = book.queries, book.sql
CI = f"{PAIRED}, ci AS (SELECT cv_protocol, seed, quantile_cont(auroc_diff, 0.025) AS lo, quantile_cont(auroc_diff, 0.975) AS hi, least(1.0, greatest(2 * least(avg(CAST(auroc_diff <= 0 AS DOUBLE)), avg(CAST(auroc_diff >= 0 AS DOUBLE))), 1.0 / count(*))) AS p FROM diffs GROUP BY ALL)"


def increments(spark, d):
    draws = resample.paired_draws(draws_of(spark, d), ["cv_protocol", "seed"], "signal", "signal_qc")
    ci = resample.interval(draws, ["cv_protocol", "seed"], ["auroc_diff"])
    return ci.join(resample.paired_p(draws, ["cv_protocol", "seed"]), ["cv_protocol", "seed"])


@book.query("e15_required_increments", f"{CI} SELECT cv_protocol, seed, CAST(lo > 0 AS INTEGER) AS significant_positive, CAST(hi < 0 AS INTEGER) AS significant_negative FROM ci")
def e15(spark, d):
    declared = spark.createDataFrame([(0,), (1,), (2,)], "seed int")
    return decide.required_increments(increments(spark, d), declared, ["seed"]).select("cv_protocol", "seed", "significant_positive", "significant_negative")


CREDIT = f"{CI}, base AS (SELECT cv_protocol, seed, auroc FROM {auroc_sql(G)} WHERE feature_set = 'signal'), cr AS (SELECT cv_protocol, seed, p, CAST(lo > 0 AS INTEGER) AS sp, CAST(coalesce(auroc > 0.5, false) AS INTEGER) AS ac FROM ci LEFT JOIN base USING (cv_protocol, seed))"


def credited(spark, d):
    base = metrics.auroc(predictions(spark, d), GROUP).filter("feature_set = 'signal'").select("cv_protocol", "seed", F.col("auroc").alias("comparator_auroc"))
    declared = spark.createDataFrame([(0,), (1,), (2,)], "seed int")
    return decide.credit_increments(decide.required_increments(increments(spark, d), declared, ["seed"]), base, ["cv_protocol", "seed"])


@book.query("e16_credit_increments", f"{CREDIT} SELECT cv_protocol, seed, sp AS significant_positive, ac AS above_chance, sp * ac AS credited FROM cr")
def e16(spark, d):
    return credited(spark, d).select("cv_protocol", "seed", "significant_positive", "above_chance", "credited")


@book.query("e17_build_decision", f"{CREDIT}, {FOLDS_UP}, rk AS (SELECT *, row_number() OVER (PARTITION BY cv_protocol ORDER BY p, seed) AS k, count(*) OVER (PARTITION BY cv_protocol) AS m FROM cr JOIN f USING (cv_protocol, seed)), bh AS (SELECT *, coalesce(k <= max(CASE WHEN p <= k / m * 0.05 THEN k END) OVER (PARTITION BY cv_protocol), false) AS rejected FROM rk), g AS (SELECT seed, count(DISTINCT CASE WHEN sp = 1 AND ac = 1 AND folds_up >= 4 AND rejected THEN cv_protocol END) AS n_protocols FROM bh GROUP BY seed) SELECT seed, n_protocols, CASE WHEN n_protocols = 2 THEN 'confirmed' WHEN n_protocols > 0 THEN 'exploratory' ELSE 'none' END AS decision FROM g")
def e17(spark, d):
    return decide.build_decision(credited(spark, d).join(folds_up(predictions(spark, d)), ["cv_protocol", "seed"]), ["seed"], ["standard", "group"])


def dataset(spark, d):
    """Cleaned rows, written once: a job of several fits reads them some dozens of times."""
    s = role(spark, d, "subjects").filter("label <> ''")
    age = clean_range(F.col("age"))
    y = ((F.col("balance") + 900 * F.coalesce(age, F.lit(14.0)) + 4000 * F.col("has_eeg")) % 9000 > 4500).cast("int")
    rows = s.select("subject", y.alias("label"), (F.col("subject") % 3).cast("int").alias("fold"), "balance", age.alias("age"), F.col("has_eeg").cast("double").alias("has_eeg"), F.coalesce(clean_category(F.col("sex")), F.lit("none")).alias("sex"), "site")
    return written(rows.repartition(4 * spark.sparkContext.defaultParallelism, "subject"), "dataset")


NUMBERS = ["balance", "age", "has_eeg"]


def checked(scores):
    return scores.withColumn("probability", F.round("probability", 4))


@book.query("k02_preprocess")
def k02(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = dataset(spark, d)
    fitted = Pipeline(stages=models.preprocess(NUMBERS, ["sex"])).fit(rows.filter("fold > 0"))
    vector = F.transform(vector_to_array("features"), lambda v: F.round(v, 6))
    return fitted.transform(rows.filter("fold = 0")).select("subject", F.size(vector).alias("n_features"), F.array_join(F.transform(vector, lambda v: v.cast("string")), " ").alias("features"))


@book.query("k03_models")
def k03(spark, d):
    rows = dataset(spark, d)
    train, test = rows.filter("fold > 0"), rows.filter("fold = 0")
    keep = ["subject", "label"]
    found = [models.score(models.fit(train, NUMBERS, ["sex"], m), test, keep).withColumn("model", F.lit(m)) for m in ("logistic", "forest", "boosting")]
    found.append(models.prior(train, test, keep).withColumn("model", F.lit("prior")))
    found.append(models.stratified_random(train, test, keep, "subject").withColumn("model", F.lit("random")))
    return checked(reduce(DataFrame.unionByName, found))


@book.query("k04_nested_cv")
def k04(spark, d):
    return checked(models.nested_cv(dataset(spark, d), "subject", "fold", NUMBERS, ["sex"], grid=({"regParam": 0.01}, {"regParam": 0.1}), inner=3))


@book.query("k05_visual_pca")
def k05(spark, d):
    e = table(spark, d, "embeddings")
    names = [f"emb_{i}" for i in range(64)]
    rows = e.select(F.col("vec_id").alias("subject"), (F.col("label") < 5).cast("int").alias("label"), (F.col("vec_id") % 2).cast("int").alias("fold"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return checked(models.visual_pca(written(rows.repartition(4 * spark.sparkContext.defaultParallelism, "subject"), "embeddings"), "subject", "fold", names, (4, 16)))


@book.query("k06_crossfit")
def k06(spark, d):
    rows = dataset(spark, d)
    return checked(models.crossfit(rows.filter("fold > 0"), rows.filter("fold = 0"), "subject", NUMBERS, ["sex"]))


@book.query("k07_stack")
def k07(spark, d):
    rows = predictions(spark, d).filter("cv_protocol = 'standard' AND seed = 0").groupBy("subject", "label", "outer_fold").pivot("feature_set", ["signal", "signal_qc"]).agg(F.max("probability"))
    return checked(models.stack(rows.filter("outer_fold > 0"), rows.filter("outer_fold = 0"), ["signal", "signal_qc"], ["subject", "label"]))


@book.query("k08_noise_dilution")
def k08(spark, d):
    found = models.noise_dilution(dataset(spark, d), "subject", "fold", NUMBERS, 5)
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


@book.query("k09_reference_baseline")
def k09(spark, d):
    rows = dataset(spark, d)
    found = [metrics.auroc(models.nested_cv(rows, "subject", "fold", n, c, inner=0), []).withColumn("predictors", F.lit(k)) for k, n, c in (("age", ["age"], []), ("demographics", ["age"], ["sex"]), ("all", NUMBERS, ["sex"]))]
    return reduce(DataFrame.unionByName, found).withColumn("auroc", F.round("auroc", 4))


@book.query("k10_group_probe")
def k10(spark, d):
    found = models.group_probe(dataset(spark, d), "subject", "site", NUMBERS)
    return found.select(*[F.round(c, 4).alias(c) if c != "n_groups" else F.col(c) for c in found.columns])


@book.query("k11_holdout_eval")
def k11(spark, d):
    rows = dataset(spark, d).withColumn("is_locked_test", (F.col("subject") % 5 == 0).cast("int"))
    return checked(models.holdout_eval(rows, "subject", "is_locked_test", NUMBERS, ["sex"], "logistic"))


@book.query("k11_holdout_interval")
def k11_interval(spark, d):
    """AUROC and average precision of the locked set, scored once, with bootstrap intervals."""
    scores = written(k11(spark, d).withColumns({"k": F.lit("holdout"), "feature_set": F.lit("all")}), "scores")
    point = metrics.auroc(scores, ["k"]).join(metrics.average_precision(scores, ["k"]), "k")
    draws = bootstrap.bootstrap_metrics(scores, ["k"], ["feature_set"], "subject", B)
    found = point.join(resample.interval(draws, ["k"], ["auroc", "auprc"]), "k").drop("k")
    return found.select(*[F.round(c, 4).alias(c) if c != "n_replicates" else F.col(c) for c in found.columns])
