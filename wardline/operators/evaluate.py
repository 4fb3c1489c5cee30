"""Evaluation of predictions: confusion, rates, curves, areas, latency and run comparison.

Everything is grouped by `keys` (dataset, run, ...). Curves work on counts per
distinct score, whose running totals come from `ordering.cumulative_counts`; no
group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.ordering import at_percentiles, cumulative_counts, value_counts


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    return df.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    )


def prf_columns() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return {
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "accuracy": share(tp + tn, tp + tn + fp + fn),
    }


def rate_columns() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return {"fnr": share(fn, tp + fn), "fpr": share(fp, fp + tn), "tpr": share(tp, tp + fn), "tnr": share(tn, tn + fp)}


def prf(df: DataFrame, keys: list[str]) -> DataFrame:
    return confusion(df, keys).select(*keys, *[c.alias(n) for n, c in prf_columns().items()])


def rates(df: DataFrame, keys: list[str]) -> DataFrame:
    return confusion(df, keys).select(*keys, *[c.alias(n) for n, c in rate_columns().items()])


def score_table(df: DataFrame, keys: list[str], y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Per distinct score, highest first: own and running counts of positives and negatives."""
    per_score = df.groupBy(*keys, F.col(score).cast("double").alias("value")).agg(
        F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) != 1).alias("neg")
    )
    return cumulative_counts(per_score, keys, ["pos", "neg"], descending=True)


def roc_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    t = score_table(df, keys)
    return t.select(
        *keys, F.col("value").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        share(F.col("cum_pos"), F.col("total_pos")).alias("tpr"), share(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
    )


def auc_roc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve (tied scores count half); .5 when a class is missing."""
    return score_table(df, keys).groupBy(*keys).agg(roc_area())


def roc_area() -> Column:
    strip = F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2.0)
    area = F.sum(strip) / (F.max("total_pos").cast("double") * F.max("total_neg"))
    both = (F.max("total_pos") > 0) & (F.max("total_neg") > 0)
    return F.when(both, area).otherwise(0.5).alias("auc_roc")


def pr_points(t: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score and at the one before it (precision 1 at the start)."""
    before_pos, before_neg = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    start = (before_pos + before_neg) == 0
    return t.withColumns(
        {
            "precision": share(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")),
            "recall": share(F.col("cum_pos"), F.col("total_pos")),
            "_p0": F.when(start, 1.0).otherwise(share(before_pos, before_pos + before_neg)),
            "_r0": share(before_pos, F.col("total_pos")),
        }
    )


def pr_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    return pr_points(score_table(df, keys)).select(*keys, F.col("value").alias("threshold"), "precision", "recall")


def auc_pr(df: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid area under the precision-recall points, positive; 0 without positives."""
    return pr_points(score_table(df, keys)).groupBy(*keys).agg(pr_area())


def pr_area() -> Column:
    strip = (F.col("recall") - F.col("_r0")) * (F.col("precision") + F.col("_p0")) / 2.0
    return F.sum(strip).alias("auc_pr")


def class_report(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    cells = df.groupBy(*keys, F.col(y_true).cast("string").alias("t"), F.col(y_pred).cast("string").alias("p")).agg(
        F.count("*").alias("n")
    )
    as_true = cells.groupBy(*keys, F.col("t").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit")
    )
    as_pred = cells.groupBy(*keys, F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    joined = as_true.join(as_pred, [*keys, "class"], "full").na.fill(0, ["support", "hit", "predicted"])
    per_class = joined.select(
        *keys, "class", share(F.col("hit"), F.col("predicted")).alias("precision"),
        share(F.col("hit"), F.col("support")).alias("recall"),
        share(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"), "support",
    )
    names = ["precision", "recall", "f1"]
    macro = per_class.groupBy(*keys).agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in names], F.sum("support").alias("support")
    )
    weighted = per_class.groupBy(*keys).agg(
        F.lit("weighted avg").alias("class"),
        *[share(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in names],
        F.sum("support").alias("support"),
    )
    return per_class.unionByName(macro).unionByName(weighted)


def latency_profile(df: DataFrame, keys: list[str], millis: str, target: float = 200.0, by_mean: bool = False) -> DataFrame:
    """Count, mean, spread and exact p95/p99 of a duration; whether p95 (or the mean) meets the target."""
    counted = value_counts(df, keys, F.col(millis)).withColumn("nv", F.col("n") * F.col("value"))
    ranked = cumulative_counts(counted, keys, ["n", "nv"])
    off = F.col("value") - F.col("total_nv") / F.col("total_n")
    profile = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.max("total_nv") / F.max("total_n")).alias("avg_ms"),
        F.sqrt(F.sum(F.col("n") * off * off) / F.sum("n")).alias("std_ms"), F.min("value").alias("min_ms"), F.max("value").alias("max_ms"),
        F.max("total_nv").alias("sum_ms"), *at_percentiles({"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}),
    )
    met = F.col("avg_ms") if by_mean else F.col("p95_ms")
    return profile.withColumn("target_met", met <= target)


FINDINGS = [("slow_mean", "speed_up_model"), ("unsteady", "balance_load"), ("slow_tail", "profile_outliers"), ("idle_slots", "raise_concurrency")]


def bottlenecks(profile: DataFrame, keys: list[str], total: str) -> DataFrame:
    """One row per finding on a latency profile; `total` is the elapsed time of the run."""
    avg = F.col("avg_ms")
    tests = [
        avg > 200.0, F.col("std_ms") > avg * 0.5, F.col("p95_ms") > avg * 2.0, F.col(total) > F.col("max_ms") * 1.5,
    ]
    found = F.array_compact(
        F.array(
            *[
                F.when(t, F.struct(F.lit(a).alias("finding"), F.lit(b).alias("advice")))
                for t, (a, b) in zip(tests, FINDINGS)
            ]
        )
    )
    return profile.select(*keys, F.inline_outer(found)).where(F.col("finding").isNotNull())


def throughput(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows per second between the first and the last timestamp."""
    span = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return df.groupBy(*keys).agg(F.count("*").alias("n"), span.alias("seconds")).withColumn(
        "per_second", share(F.col("n"), F.col("seconds"))
    )


def evaluate(df: DataFrame, keys: list[str], millis: str = "ms", target: float = 200.0) -> DataFrame:
    """One row per run: confusion, P/R/F1, rates, both areas and latency."""
    counts = confusion(df, keys).withColumns({**prf_columns(), **rate_columns()})
    areas = pr_points(score_table(df, keys)).groupBy(*keys).agg(roc_area(), pr_area())
    latency = latency_profile(df, keys, millis, target).drop("sum_ms")
    return counts.join(areas, keys).join(latency, keys)


def evaluation_summary(runs: DataFrame, keys: list[str], order: str, fnr_target: float = 0.05) -> DataFrame:
    """Latest run against the first one, per key."""
    fields = F.struct("accuracy", "f1", "fnr", "avg_ms", "target_met", order)
    ends = runs.groupBy(*keys).agg(
        F.count("*").alias("total_evaluations"), F.max_by(fields, order).alias("z"), F.min_by(fields, order).alias("a")
    )
    return ends.select(
        *keys, "total_evaluations", F.col("z.accuracy").alias("accuracy"), F.col("z.f1").alias("f1"), F.col("z.fnr").alias("fnr"),
        (F.col("z.accuracy") - F.col("a.accuracy")).alias("accuracy_improvement"),
        (F.col("z.f1") - F.col("a.f1")).alias("f1_improvement"),
        (F.col("a.fnr") - F.col("z.fnr")).alias("fnr_improvement"),
        (F.col("a.avg_ms") - F.col("z.avg_ms")).alias("performance_improvement"),
        (F.col("z.fnr") <= fnr_target).alias("fnr_target_met"), F.col("z.target_met").alias("processing_target_met"),
    )


def compare_evaluations(runs: DataFrame, keys: list[str], run: str, names: list, metrics: list[str]) -> DataFrame:
    """Runs side by side: one row per metric, one column per named run."""
    long = runs.select(*keys, run, F.inline_outer(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return long.groupBy(*keys, "metric").pivot(run, names).agg(F.first("v"))


def ensemble_metrics(votes: DataFrame, id_col: str, probability: str, y_true: str) -> DataFrame:
    """Mean probability to one decision per row; spread of the members' votes and their agreement."""
    per_row = votes.groupBy(id_col).agg(
        (F.avg(probability) > 0.5).cast("int").alias("y_pred"),
        F.var_pop((F.col(probability) > 0.5).cast("int")).alias("_v"),
        F.first(y_true).alias("y_true"),
    )
    spread = per_row.agg(F.avg("_v").alias("prediction_variance"), F.avg((F.col("_v") < 0.25).cast("int")).alias("ensemble_agreement"))
    counts = confusion(per_row, []).withColumns({**prf_columns(), **rate_columns()})
    one = F.lit(0).alias("_k")
    return counts.select("*", one).join(F.broadcast(spread.select("*", one)), "_k").drop("_k")


def cross_entropy(probability: Column, label: Column) -> Column:
    p = F.when(label == 1, probability).otherwise(1.0 - probability)
    return -F.ln(F.greatest(p, F.lit(1e-12)))


def focal(probability: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    ce = cross_entropy(probability, label)
    return alpha * F.pow(1.0 - F.exp(-ce), F.lit(gamma)) * ce


def fnr_penalised(probability: Column, label: Column, weight: float = 3.0) -> Column:
    missed = (probability <= 0.5) & (label == 1)
    return cross_entropy(probability, label) * F.when(missed, weight).otherwise(1.0)


def losses(df: DataFrame, keys: list[str], probability: str, label: str) -> DataFrame:
    p, y = F.col(probability), F.col(label)
    return df.groupBy(*keys).agg(
        F.avg(focal(p, y)).alias("focal_loss"), F.avg(fnr_penalised(p, y)).alias("fnr_loss"),
        F.avg(0.7 * focal(p, y) + 0.3 * fnr_penalised(p, y)).alias("mixed_loss"),
    )


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the minimum and the maximum of each key; the maximum belongs to the last bin.

    Values are counted first, so the bounds meet one row per distinct value.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    bounds = counted.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = counted.join(bounds, keys) if keys else counted.crossJoin(bounds)
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    binned = joined.withColumns({"bin": index.cast("long"), "_w": width})
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"), F.first(F.col("lo") + F.col("bin") * F.col("_w")).alias("from_value")
    )


def training_summary(history: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Last and best value per metric: the smallest for losses, the largest otherwise."""
    return history.groupBy(*keys, "metric").agg(
        F.max_by(value, order).alias("final"),
        F.when(F.contains(F.first("metric"), F.lit("loss")), F.min(value)).otherwise(F.max(value)).alias("best"),
    )
