"""Queries of the evaluation layer over out-of-fold predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import metrics
from quillspan.plans.base import Book
from quillspan.sources.shared import written
from quillspan.sources.tables import PREDICTIONS_SQL, predictions

book = Book()
QUERIES, SQL = book.queries, book.sql
FOLD = ("cv_protocol", "feature_set", "seed", "outer_fold")


@book.query(
    "e01_auroc",
    f"""
    WITH {PREDICTIONS_SQL}, b AS (
        SELECT cv_protocol, feature_set, seed, outer_fold, probability,
               sum(label) AS pos, sum(1 - label) AS neg
        FROM predictions GROUP BY ALL
    ), r AS (
        SELECT *, coalesce(sum(neg) OVER (PARTITION BY cv_protocol, feature_set, seed, outer_fold ORDER BY probability
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b
    )
    SELECT cv_protocol, feature_set, seed, outer_fold,
           round(sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc
    FROM r GROUP BY ALL
    """,
)
def e01_auroc(spark, sf_dir):
    return metrics.auroc(predictions(spark, sf_dir), FOLD).withColumn("auroc", F.round("auroc", 6))


from quillspan.operators import bootstrap, resample  # noqa: E402

P = f"WITH {PREDICTIONS_SQL}"
GROUP = ("cv_protocol", "feature_set", "seed")
G = "cv_protocol, feature_set, seed"
F4 = G + ", outer_fold"
CONF = "CAST(sum(CASE WHEN probability >= {t} AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN probability >= {t} AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN probability < {t} AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN probability < {t} AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn"
METRIC = {
    "accuracy": "coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0)",
    "balanced_accuracy": "(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2",
    "sensitivity": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "specificity": "coalesce(tn / nullif(tn + fp, 0), 0)",
    "ppv": "coalesce(tp / nullif(tp + fp, 0), 0)",
    "npv": "coalesce(tn / nullif(tn + fn, 0), 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    "macro_f1": "(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2",
    "positive_rate": "coalesce((tp + fp) / nullif(tp + fp + tn + fn, 0), 0)",
}


def metric_list(names=tuple(METRIC)):
    return ", ".join(f"round({METRIC[m]}, 6) AS {m}" for m in names)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def auroc_sql(keys, source="predictions", weight="1", out="auroc"):
    return f"""(SELECT {keys}, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS {out} FROM (
        SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {keys}, probability, sum(label * {weight}) AS pos, sum((1 - label) * {weight}) AS neg FROM {source} GROUP BY {keys}, probability)) GROUP BY {keys})"""


def auprc_sql(keys, source="predictions", weight="1"):
    return f"""(SELECT {keys}, sum(pos * tp / nullif(tp + fp, 0)) / nullif(sum(pos), 0) AS auprc FROM (
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
        FROM (SELECT {keys}, probability, sum(label * {weight}) AS pos, sum((1 - label) * {weight}) AS neg FROM {source} GROUP BY {keys}, probability)
        WINDOW w AS (PARTITION BY {keys} ORDER BY probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY {keys})"""


def calibration_sql(keys, source="predictions"):
    return f"""(SELECT {keys}, sum(abs(m - s) * n) / sum(n) AS ece, max(abs(m - s)) AS mce FROM (
        SELECT {keys}, list_sum([CAST(probability >= i * 0.1::DOUBLE AS INT) FOR i IN range(1, 10)]) AS bin, count(*) AS n, avg(probability) AS m, avg(label) AS s
        FROM {source} GROUP BY ALL) GROUP BY {keys})"""


@book.query("e02_average_precision", f"{P} SELECT {F4}, round(auprc, 6) AS auprc FROM {auprc_sql(F4)}")
def e02(spark, sf_dir):
    return rounded(metrics.average_precision(predictions(spark, sf_dir), FOLD), "auprc")


@book.query("e03_confusion", f"{P} SELECT {F4}, {CONF.format(t='fold_threshold')} FROM predictions GROUP BY ALL")
def e03(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), FOLD, F.col("fold_threshold"))


@book.query("e04_threshold_metrics", f"{P}, c AS (SELECT {F4}, {CONF.format(t='0.5')} FROM predictions GROUP BY ALL) SELECT *, {metric_list()} FROM c")
def e04(spark, sf_dir):
    return rounded(metrics.threshold_metrics(metrics.confusion(predictions(spark, sf_dir), FOLD, F.lit(0.5))), *metrics.THRESHOLD_METRICS)


@book.query("e05_brier", f"{P} SELECT {F4}, round(avg(power(probability - label, 2)), 6) AS brier FROM predictions GROUP BY ALL")
def e05(spark, sf_dir):
    return rounded(metrics.brier(predictions(spark, sf_dir), FOLD), "brier")


@book.query("e06_calibration", f"{P} SELECT {G}, round(ece, 6) AS ece, round(mce, 6) AS mce FROM {calibration_sql(G)}")
def e06(spark, sf_dir):
    return rounded(metrics.calibration(predictions(spark, sf_dir), GROUP), "ece", "mce")


POOLED = ("auroc", "auprc", "brier", "ece", "mce", *metrics.THRESHOLD_METRICS)


def all_sql(keys, t):
    return f"""(SELECT s.*, a.auroc, p.auprc, {', '.join(f'm.{x}' for x in METRIC)}, m.tp, m.fp, m.tn, m.fn, c.ece, c.mce
        FROM (SELECT {keys}, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive, avg(power(probability - label, 2)) AS brier FROM predictions GROUP BY ALL) s
        JOIN {auroc_sql(keys)} a USING ({keys}) JOIN {auprc_sql(keys)} p USING ({keys}) JOIN {calibration_sql(keys)} c USING ({keys})
        JOIN (SELECT *, {', '.join(f'{v} AS {k}' for k, v in METRIC.items())} FROM (SELECT {keys}, {CONF.format(t=t)} FROM predictions GROUP BY ALL)) m USING ({keys}))"""


ROUND_ALL = ", ".join(f"round({m}, 6) AS {m}" for m in POOLED)


@book.query(
    "e07_pooled_metrics",
    f"""{P}, f AS (SELECT {G}, avg(auroc) AS auroc_mean, stddev_samp(auroc) AS auroc_std, count(*) AS n_folds FROM {auroc_sql(F4)} GROUP BY ALL)
    SELECT threshold_type, {G}, n, n_positive, {ROUND_ALL}, tp, fp, tn, fn, n_folds, round(auroc_mean, 6) AS auroc_mean, round(auroc_std, 6) AS auroc_std
    FROM (SELECT 'fixed' AS threshold_type, * FROM {all_sql(G, '0.5')} UNION ALL BY NAME SELECT 'fold' AS threshold_type, * FROM {all_sql(G, 'fold_threshold')}) JOIN f USING ({G})""",
)
def e07(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    folds = metrics.fold_spread(metrics.auroc(rows, FOLD), GROUP, ["auroc"])
    fixed = metrics.all_metrics(rows, GROUP, F.lit(0.5)).withColumn("threshold_type", F.lit("fixed"))
    own = metrics.all_metrics(rows, GROUP, F.col("fold_threshold")).withColumn("threshold_type", F.lit("fold"))
    return rounded(fixed.unionByName(own).join(folds, list(GROUP)), *POOLED, "auroc_mean", "auroc_std")


@book.query("e08_fold_metrics", f"{P} SELECT {F4}, n, n_positive, {ROUND_ALL}, tp, fp, tn, fn FROM {all_sql(F4, '0.5')}")
def e08(spark, sf_dir):
    return rounded(metrics.all_metrics(predictions(spark, sf_dir), FOLD, F.lit(0.5)), *POOLED)


GRID = [i / 20 for i in range(1, 20)]


@book.query(
    "e09_select_threshold",
    f"""{P}, c AS (SELECT {F4}, threshold, {CONF.format(t='threshold')} FROM predictions CROSS JOIN (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) r(i)) GROUP BY ALL),
    m AS (SELECT *, {METRIC['balanced_accuracy']} AS b FROM c)
    SELECT {F4}, threshold, round(b, 6) AS balanced_accuracy FROM m QUALIFY row_number() OVER (PARTITION BY {F4} ORDER BY round(b, 12) DESC, threshold) = 1""",
)
def e09(spark, sf_dir):
    return rounded(metrics.select_threshold(predictions(spark, sf_dir), FOLD, GRID), "balanced_accuracy")


@book.query(
    "e10_select_threshold_f1",
    f"""{P}, s AS (SELECT {G}, probability, sum(label) AS pos, count(*) AS n FROM predictions GROUP BY ALL),
    r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS called, sum(pos) OVER (PARTITION BY {G}) AS positives FROM s
        WINDOW w AS (PARTITION BY {G} ORDER BY probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT {G}, probability AS threshold, round(2 * tp / (called + positives), 6) AS f1 FROM r
    QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY round(2 * tp / (called + positives), 12) DESC, probability) = 1""",
)
def e10(spark, sf_dir):
    return rounded(metrics.select_threshold_f1(predictions(spark, sf_dir), GROUP), "f1")


#: Replicates of the bootstrap, as in the reference's configurations.
B = 1000
PRIME = bootstrap.PRIME
#: A draw's number from the group's number g, the node, the replicate b and its place i among the node's draws.
DRAW = f"""(SELECT *, (z * z + i) % {PRIME} AS x FROM (SELECT *, (y * y + b) % {PRIME} AS z FROM (SELECT *, (v * v + 12345 + a) % {PRIME} AS y FROM (
        SELECT *, (a + b * 1640531527) % {PRIME} AS v FROM (SELECT *, (g + 16807 * node + i) % {PRIME} AS a FROM {{}})))))"""


def draws_sql(by):
    """The rows of every replicate, equal rows summed; by names the columns that stay.  A group's draws go to the 16 ranges of the hash, and in each to its subjects."""
    number = lambda *parts: f"CAST(('0x' || substr(sha1({' || '.join(parts)}), 1, 8)) AS BIGINT)"
    return f"""subjects AS (SELECT *, row_number() OVER (PARTITION BY cv_protocol, seed ORDER BY h, subject) - 1 AS place, h >> 28 AS child FROM (
        SELECT DISTINCT cv_protocol, seed, subject, {number("'0|'", "cv_protocol", "'|'", "seed", "'|'", "subject")} AS h FROM predictions)),
    nodes AS (SELECT cv_protocol, seed, child, count(*) AS m, min(place) AS first FROM subjects GROUP BY ALL),
    groups AS (SELECT cv_protocol, seed, sum(m) AS n, {number("'0|'", "cv_protocol", "'|'", "seed")} % {PRIME} AS g, 0 AS node FROM nodes GROUP BY ALL),
    top AS (SELECT cv_protocol, seed, b, g, CAST(x * n // {PRIME} AS BIGINT) AS r FROM {DRAW.format(f"(SELECT * FROM groups, range(1, {B + 1}) q(b), LATERAL (SELECT unnest(range(CAST(n AS BIGINT))) AS i))")}),
    dealt AS (SELECT cv_protocol, seed, child, 1 + child AS node, m, first, b, g, count(*) AS c FROM top JOIN nodes USING (cv_protocol, seed) WHERE r >= first AND r < first + m GROUP BY ALL),
    drawn AS (SELECT cv_protocol, seed, b, first + x * m // {PRIME} AS place, count(*) AS weight FROM {DRAW.format("(SELECT *, unnest(range(c)) AS i FROM dealt)")} GROUP BY ALL),
    weights AS (SELECT cv_protocol, seed, subject, b AS replicate, weight FROM drawn JOIN subjects USING (cv_protocol, seed, place)),
    weighted AS MATERIALIZED (SELECT {by}, replicate, CAST(sum(weight) AS BIGINT) AS weight FROM predictions JOIN weights USING (cv_protocol, seed, subject) GROUP BY ALL)"""


R = G + ", replicate"
DRAWS = f"""{draws_sql(G + ', label, probability')},
    draws AS MATERIALIZED (SELECT * FROM {auroc_sql(R, 'weighted', 'weight')} JOIN {auprc_sql(R, 'weighted', 'weight')} USING ({R}))"""
#: The metrics that get an interval.
WITH_INTERVAL = ("auroc", "auprc", "balanced_accuracy", "macro_f1", "sensitivity", "specificity", "ppv", "npv", "brier", "ece", "mce", "accuracy", "positive_rate")


def draws_of(spark, sf_dir):
    return bootstrap.bootstrap_metrics(predictions(spark, sf_dir), ["cv_protocol", "seed"], ["feature_set"], "subject", B)


def boot_sql(kind, threshold):
    """Every metric of each replicate at one kind of threshold."""
    conf = ", ".join(f"CAST(sum(CASE WHEN probability {op} {threshold} AND label = {y} THEN weight ELSE 0 END) AS BIGINT) AS {c}" for c, op, y in (("tp", ">=", 1), ("fp", ">=", 0), ("tn", "<", 0), ("fn", "<", 1)))
    cal = f"""(SELECT {R}, sum(abs(m - s) * n) / sum(n) AS ece, max(abs(m - s)) AS mce FROM (
        SELECT {R}, list_sum([CAST(probability >= i * 0.1::DOUBLE AS INT) FOR i IN range(1, 10)]) AS bin, sum(weight) AS n, sum(weight * probability) / sum(weight) AS m, sum(weight * label) / sum(weight) AS s
        FROM weighted GROUP BY ALL) GROUP BY {R})"""
    return f"""SELECT '{kind}' AS threshold_type, * FROM (SELECT {R}, sum(weight * power(probability - label, 2)) / sum(weight) AS brier FROM weighted GROUP BY ALL)
        JOIN {auroc_sql(R, 'weighted', 'weight')} USING ({R}) JOIN {auprc_sql(R, 'weighted', 'weight')} USING ({R}) JOIN {cal} USING ({R})
        JOIN (SELECT {R}, {', '.join(f'{v} AS {k}' for k, v in METRIC.items())} FROM (SELECT {R}, {conf} FROM weighted GROUP BY ALL)) USING ({R})"""


@book.query(
    "e11_bootstrap_ci",
    f"""{P}, {draws_sql(G + ', label, probability, fold_threshold')}, every AS ({boot_sql('fixed', '0.5')} UNION ALL BY NAME {boot_sql('fold', 'fold_threshold')})
    SELECT threshold_type, {G}, {', '.join(f"round(quantile_cont({m}, 0.025), 6) AS {m}_low, round(quantile_cont({m}, 0.975), 6) AS {m}_high" for m in WITH_INTERVAL)}, count(*) AS n_replicates
    FROM every GROUP BY ALL""",
)
def e11(spark, sf_dir):
    draws = bootstrap.bootstrap_all(predictions(spark, sf_dir), ["cv_protocol", "seed"], ["feature_set"], "subject", B, {"fixed": F.lit(0.5), "fold": F.col("fold_threshold")})
    found = resample.interval(draws, ("threshold_type", *GROUP), WITH_INTERVAL)
    names = [f"{m}_{s}" for m in WITH_INTERVAL for s in ("low", "high")]
    return rounded(found.select("threshold_type", *GROUP, *names, "n_replicates"), *names)


PAIRED = f"""{P}, {DRAWS}, diffs AS (SELECT a.cv_protocol, a.seed, a.replicate, b.auroc - a.auroc AS auroc_diff, b.auprc - a.auprc AS auprc_diff
        FROM draws a JOIN draws b ON a.cv_protocol = b.cv_protocol AND a.seed = b.seed AND a.replicate = b.replicate AND a.feature_set = 'signal' AND b.feature_set = 'signal_qc')"""
FOLDS_UP = f"""folds AS (SELECT cv_protocol, seed, outer_fold, max(auroc) FILTER (feature_set = 'signal_qc') - max(auroc) FILTER (feature_set = 'signal') AS d FROM {auroc_sql(F4)} GROUP BY ALL),
    f AS (SELECT cv_protocol, seed, count(d) AS folds_compared, count(*) FILTER (d > 0) AS folds_up FROM folds GROUP BY ALL)"""


@book.query(
    "e12_paired_increments",
    f"""{PAIRED}, ci AS (SELECT cv_protocol, seed, quantile_cont(auroc_diff, 0.025) AS low, quantile_cont(auroc_diff, 0.975) AS high, quantile_cont(auprc_diff, 0.025) AS pr_low, quantile_cont(auprc_diff, 0.975) AS pr_high FROM diffs GROUP BY ALL),
    pooled AS (SELECT cv_protocol, seed, max(auroc) FILTER (feature_set = 'signal_qc') - max(auroc) FILTER (feature_set = 'signal') AS auroc_diff,
        max(auprc) FILTER (feature_set = 'signal_qc') - max(auprc) FILTER (feature_set = 'signal') AS auprc_diff FROM {auroc_sql(G)} JOIN {auprc_sql(G)} USING ({G}) GROUP BY ALL),
    {FOLDS_UP},
    s AS (SELECT seed, min(sign(auroc_diff)) = max(sign(auroc_diff)) AS same_direction FROM pooled GROUP BY seed)
    SELECT cv_protocol, seed, round(auroc_diff, 6) AS auroc_diff, round(low, 6) AS auroc_diff_low, round(high, 6) AS auroc_diff_high,
        round(auprc_diff, 6) AS auprc_diff, round(pr_low, 6) AS auprc_diff_low, round(pr_high, 6) AS auprc_diff_high, folds_compared, folds_up, same_direction
    FROM pooled JOIN ci USING (cv_protocol, seed) JOIN f USING (cv_protocol, seed) JOIN s USING (seed)""",
)
def e12(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    keys = ["cv_protocol", "seed"]
    both = metrics.auroc(rows, GROUP).join(metrics.average_precision(rows, GROUP), list(GROUP))
    pooled = difference(both, keys, "auroc").join(difference(both, keys, "auprc"), keys)
    diffs = ["auroc_diff", "auprc_diff"]
    ci = resample.interval(resample.paired_draws(draws_of(spark, sf_dir), keys, "signal", "signal_qc"), keys, diffs)
    same = pooled.groupBy("seed").agg((F.min(F.signum("auroc_diff")) == F.max(F.signum("auroc_diff"))).alias("same_direction"))
    limits = [f"{d}_{s}" for d in diffs for s in ("low", "high")]
    out = pooled.join(ci.select(*keys, *limits), keys).join(folds_up(rows), keys).join(same, "seed")
    return rounded(out, *diffs, *limits)


def difference(found, by, metric):
    """signal_qc minus signal of a metric."""
    value = lambda name: F.max(F.when(F.col("feature_set") == name, F.col(metric)))
    return found.groupBy(*by).agg((value("signal_qc") - value("signal")).alias(f"{metric}_diff"))


def folds_up(rows):
    """For each protocol and seed the folds with both feature sets, and those in which signal_qc is ahead."""
    folds = difference(metrics.auroc(rows, FOLD), ["cv_protocol", "seed", "outer_fold"], "auroc")
    return folds.groupBy("cv_protocol", "seed").agg(F.count("auroc_diff").alias("folds_compared"), F.count_if(F.col("auroc_diff") > 0).alias("folds_up"))


@book.query(
    "e13_paired_p",
    f"""{PAIRED} SELECT cv_protocol, seed, round(median(auroc_diff), 6) AS median_diff,
        round(least(1.0, greatest(2 * least(avg(CAST(auroc_diff <= 0 AS DOUBLE)), avg(CAST(auroc_diff >= 0 AS DOUBLE))), 1.0 / count(*))), 6) AS p FROM diffs GROUP BY ALL""",
)
def e13(spark, sf_dir):
    keys = ["cv_protocol", "seed"]
    return rounded(resample.paired_p(resample.paired_draws(draws_of(spark, sf_dir), keys, "signal", "signal_qc"), keys), "median_diff", "p")


@book.query(
    "e14_benjamini_hochberg",
    f"""{P}, t AS (SELECT {F4}, power(abs(auroc - 0.5) * 2 , 2) AS p FROM {auroc_sql(F4)} WHERE auroc IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cv_protocol ORDER BY p, {F4}) AS k, count(*) OVER (PARTITION BY cv_protocol) AS m FROM t)
    SELECT {F4}, round(p, 6) AS p, coalesce(k <= max(CASE WHEN p <= k / m * 0.05 THEN k END) OVER (PARTITION BY cv_protocol), false) AS rejected FROM r""",
)
def e14(spark, sf_dir):
    tested = metrics.auroc(predictions(spark, sf_dir), FOLD).filter("auroc IS NOT NULL").withColumn("p", F.pow(F.abs(F.col("auroc") - 0.5) * 2, 2)).drop("auroc")
    return rounded(resample.benjamini_hochberg(tested, ["cv_protocol"], order=FOLD), "p")


@book.query("e18_standard_vs_group", f"{P} SELECT feature_set, seed, round(s, 6) AS standard, round(g, 6) AS \"group\", round(g - s, 6) AS delta FROM (SELECT feature_set, seed, max(auroc) FILTER (cv_protocol = 'standard') AS s, max(auroc) FILTER (cv_protocol = 'group') AS g FROM {auroc_sql(G)} GROUP BY ALL)")
def e18(spark, sf_dir):
    wide = metrics.auroc(predictions(spark, sf_dir), GROUP).groupBy("feature_set", "seed").pivot("cv_protocol", ["standard", "group"]).agg(F.max("auroc"))
    return rounded(wide.withColumn("delta", F.col("group") - F.col("standard")), "standard", "group", "delta")


@book.query("e19_threshold_diagnostics", f"{P} SELECT {F4}, count(*) AS n, max(fold_threshold) AS threshold, round(avg(CAST(probability >= fold_threshold AS DOUBLE)), 6) AS positive_rate FROM predictions GROUP BY ALL")
def e19(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy(*FOLD).agg(F.count("*").alias("n"), F.max("fold_threshold").alias("threshold"), F.round(F.avg((F.col("probability") >= F.col("fold_threshold")).cast("double")), 6).alias("positive_rate"))


@book.query("e20_summaries", f"{P} SELECT cv_protocol, feature_set, seed, round(auroc, 6) AS auroc FROM {auroc_sql(G)} QUALIFY row_number() OVER (PARTITION BY cv_protocol ORDER BY round(auroc, 9) DESC, feature_set, seed) <= 2")
def e20(spark, sf_dir):
    from quillspan.operators.windows import top_k

    return rounded(top_k(metrics.auroc(predictions(spark, sf_dir), GROUP), ["cv_protocol"], [F.desc(F.round("auroc", 9)), "feature_set", "seed"], 2), "auroc")


@book.query(
    "e21_transfer_check",
    f"""{P}, t AS (SELECT * FROM predictions WHERE subject IN (SELECT subject FROM predictions WHERE feature_set = 'signal' AND seed = 0 AND cv_protocol = 'group' AND outer_fold = 0)),
    f AS (SELECT {G}, avg(auroc) AS fold_mean FROM (SELECT * FROM {auroc_sql(F4, 't')} JOIN (SELECT {F4}, count(*) AS n FROM t GROUP BY ALL) USING ({F4}) WHERE n >= 10) GROUP BY ALL)
    SELECT {G}, round(auroc, 6) AS auroc, round(fold_mean, 6) AS fold_mean FROM {auroc_sql(G, 't')} LEFT JOIN f USING ({G})""",
)
def e21(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    same = rows.filter("feature_set = 'signal' AND seed = 0 AND cv_protocol = 'group' AND outer_fold = 0").select("subject").distinct()
    rows = rows.join(same, "subject", "left_semi")
    big = rows.groupBy(*FOLD).agg(F.count("*").alias("n")).filter("n >= 10")
    folds = metrics.auroc(rows, FOLD).join(big, list(FOLD)).groupBy(*GROUP).agg(F.avg("auroc").alias("fold_mean"))
    return rounded(metrics.auroc(rows, GROUP).join(folds, list(GROUP), "left"), "auroc", "fold_mean")


@book.query(
    "e22_pooling_check",
    f"""{P}, f AS (SELECT {F4}, count(*) AS n, avg(label) AS prevalence FROM predictions GROUP BY ALL),
    c AS (SELECT p.cv_protocol, p.feature_set, p.seed, p.outer_fold, p.label, round(f.prevalence, 9) AS probability FROM predictions p JOIN f USING ({F4}))
    SELECT {G}, round(auroc, 6) AS pooled_auroc, n_folds, round(least_prevalence, 6) AS least_prevalence, round(most_prevalence, 6) AS most_prevalence
    FROM {auroc_sql(G, 'c')} JOIN (SELECT {G}, count(*) AS n_folds, min(prevalence) AS least_prevalence, max(prevalence) AS most_prevalence FROM f GROUP BY ALL) USING ({G})""",
)
def e22(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    folds = rows.groupBy(*FOLD).agg(F.avg("label").alias("prevalence"))
    constant = rows.drop("probability").join(folds, list(FOLD)).withColumn("probability", F.round("prevalence", 9))
    shape = folds.groupBy(*GROUP).agg(F.count("*").alias("n_folds"), F.min("prevalence").alias("least_prevalence"), F.max("prevalence").alias("most_prevalence"))
    return rounded(metrics.auroc(constant, GROUP).withColumnRenamed("auroc", "pooled_auroc").join(shape, list(GROUP)), "pooled_auroc", "least_prevalence", "most_prevalence")


#: Permutations of a null distribution, as in the reference.
PERMUTATIONS = 100
def _noise(x, turn):
    v = f"(({x} + {turn} * 48271 + replicate * 1640531527) % {PRIME})"
    v = f"(({v} * {v} + 12345 + {x}) % {PRIME})"
    return f"(({v} * {v} + {turn}) % {PRIME})"


#: A place among n that the rounds of the replicate move; all values are below 2**62.
PARTNER = f"(({_noise('0', 'turn')} % n - place + n) % n)"
NULLS = f"""one AS (SELECT outer_fold, subject, label, probability FROM predictions WHERE cv_protocol = 'standard' AND feature_set = 'signal' AND seed = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY sha1('0|' || subject), subject) - 1 AS place, count(*) OVER (PARTITION BY outer_fold) AS n, sum(label) OVER (PARTITION BY outer_fold) AS positives FROM one),
    moved AS (SELECT outer_fold, subject, probability, n, positives, replicate, place, CAST(1 AS BIGINT) AS turn FROM k, range(1, 101) r(replicate)
        UNION ALL SELECT outer_fold, subject, probability, n, positives, replicate, CASE WHEN {_noise('greatest(place, partner)', 'turn')} // 1024 % 2 = 1 THEN partner ELSE place END, turn + 1
        FROM (SELECT *, {PARTNER} AS partner FROM moved WHERE turn <= {resample.ROUNDS})),
    permuted AS (SELECT outer_fold, replicate, subject, probability, CAST(place < positives AS INTEGER) AS label FROM moved WHERE turn = {resample.ROUNDS + 1})"""
PR = P.replace("WITH ", "WITH RECURSIVE ", 1)


def one_model(spark, sf_dir):
    return predictions(spark, sf_dir).filter("cv_protocol = 'standard' AND feature_set = 'signal' AND seed = 0").select("outer_fold", "subject", "label", "probability")


@book.query("e23_permute_labels", f"{PR}, {NULLS} SELECT * FROM permuted")
def e23(spark, sf_dir):
    return resample.permute_labels(one_model(spark, sf_dir), ["outer_fold"], "subject", PERMUTATIONS).select("outer_fold", "replicate", "subject", "probability", "label")


@book.query(
    "e24_permutation_null",
    f"""{PR}, {NULLS}, n AS (SELECT * FROM {auroc_sql('replicate', 'permuted')}), o AS (SELECT max(auroc) AS observed FROM {auroc_sql('k', '(SELECT 1 AS k, * FROM one)')})
    SELECT round(max(observed), 6) AS observed, round(avg(auroc), 6) AS null_mean, round(stddev_samp(auroc), 6) AS null_std, round(max(auroc), 6) AS null_max,
        round(avg(CAST(auroc >= observed AS DOUBLE)), 6) AS exceedance FROM n, o""",
)
def e24(spark, sf_dir):
    rows = written(one_model(spark, sf_dir), "model")
    # the counts are read twice, and cost as much again when they are not kept
    counts = written(resample.permuted_counts(rows, ["outer_fold"], "subject", PERMUTATIONS, ["probability"]), "permuted")
    null = metrics.auroc(counts, ["replicate"], weight=F.col("weight"))
    return rounded(resample.permutation_null(null, metrics.auroc(rows, []), []), "observed", "null_mean", "null_std", "null_max", "exceedance")


@book.query("e28_overall_at_median_threshold", f"{P}, m AS (SELECT {G}, median(fold_threshold) AS threshold FROM (SELECT DISTINCT {F4}, fold_threshold FROM predictions) GROUP BY ALL), c AS (SELECT {G}, max(threshold) AS threshold, {CONF.format(t='threshold')} FROM predictions JOIN m USING ({G}) GROUP BY {G}) SELECT {G}, round(threshold, 6) AS threshold, tp, fp, tn, fn, {metric_list(('balanced_accuracy', 'f1'))} FROM c")
def e28(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    middle = rows.select(*FOLD, "fold_threshold").distinct().groupBy(*GROUP).agg(F.median("fold_threshold").alias("threshold"))
    counts = metrics.threshold_metrics(metrics.confusion(rows.join(F.broadcast(middle), list(GROUP)), [*GROUP, "threshold"], F.col("threshold")))
    return rounded(counts.select(*GROUP, "threshold", "tp", "fp", "tn", "fn", "balanced_accuracy", "f1"), "threshold", "balanced_accuracy", "f1")


@book.query("e29_split_audit", f"{P}, s AS (SELECT DISTINCT outer_fold, subject FROM predictions WHERE cv_protocol = 'standard'), k AS (SELECT DISTINCT outer_fold AS fold FROM s) SELECT fold, subject, CASE WHEN fold = outer_fold THEN 'test' ELSE 'train' END AS part FROM s, k")
def e29(spark, sf_dir):
    own = predictions(spark, sf_dir).filter("cv_protocol = 'standard'").select("outer_fold", "subject").distinct()
    folds = own.select(F.col("outer_fold").alias("fold")).distinct()
    return own.crossJoin(F.broadcast(folds)).select("fold", "subject", F.when(F.col("fold") == F.col("outer_fold"), "test").otherwise("train").alias("part"))


@book.query("e30_best_rows_by_set", f"{P} SELECT cv_protocol, feature_set, seed, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM {auroc_sql(G)} JOIN {auprc_sql(G)} USING ({G}) WHERE feature_set IN ('signal', 'signal_qc') QUALIFY row_number() OVER (PARTITION BY cv_protocol, feature_set ORDER BY round(auroc, 9) DESC, round(auprc, 9) DESC, seed) = 1")
def e30(spark, sf_dir):
    from quillspan.operators.windows import top_k

    rows = predictions(spark, sf_dir).filter(F.col("feature_set").isin("signal", "signal_qc"))
    both = metrics.auroc(rows, GROUP).join(metrics.average_precision(rows, GROUP), list(GROUP))
    return rounded(top_k(both, ["cv_protocol", "feature_set"], [F.desc(F.round("auroc", 9)), F.desc(F.round("auprc", 9)), "seed"], 1), "auroc", "auprc")
