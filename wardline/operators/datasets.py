"""Labelled prompt datasets: filter, split, check, describe, label, weight and resample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators.generate import choice
from wardline.operators.ordering import running_index
from wardline.operators.rows import fenced


def filter_samples(df: DataFrame, label: int | None = None, attack_type: str | None = None) -> DataFrame:
    if label is not None:
        df = df.where(F.col("label") == label)
    if attack_type is not None:
        df = df.where(F.col("attack_type") == attack_type)
    return df


def split(df: DataFrame, id_col: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Add `part`: train for the given share of the id's hash range, test for the rest."""
    in_train = choice(F.col(id_col), 0, 1_000_000, seed, "split") < int(share * 1_000_000)
    return df.withColumn("part", F.when(in_train, "train").otherwise("test"))


def hash_order(id_col: str, seed: int = 0) -> Column:
    """A shuffled order as a column."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, id_col: str, label: str, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Add `part` with exactly ceil(share * n) test rows of every label, in hash order.

    Ranks come from ranges of the hash, so a label with most of the rows is many tasks.
    """
    ranked = running_index(df.withColumn("_h", hash_order(id_col, seed)), [label], ["_h", id_col], "_rank")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    joined = ranked.join(sizes, label)
    return joined.withColumn("part", F.when(F.col("_rank") < F.col("_n") * test_share, "test").otherwise("train")).drop(
        "_h", "_rank", "_n"
    )


def validate(df: DataFrame, text_col: str = "text", label: str = "label") -> DataFrame:
    """Problems of a dataset in one row. Duplicates are counted over text hashes, in two aggregates; null and empty differ."""
    per_text = df.groupBy(F.sha2(text_col, 256).alias("_t")).agg(
        F.count("*").alias("_n"),
        F.count_if(F.regexp_replace(F.coalesce(text_col, F.lit("")), tx.BLANK, "") == "").alias("_blank"),
        F.count_if(F.col(label) == 0).alias("_normal"),
        F.count_if(F.col(label) == 1).alias("_attack"),
    )
    return per_text.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_blank"), F.lit(0)).alias("blank"),
        (F.coalesce(F.sum("_n"), F.lit(0)) == 0).alias("is_empty"),
        ((F.coalesce(F.sum("_normal"), F.lit(0)) == 0) | (F.coalesce(F.sum("_attack"), F.lit(0)) == 0)).alias("single_class"),
    )


def dataset_stats(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Size, class balance, average length, attack types and number of sources per dataset.

    Counts per (dataset, attack type) come first; the histogram of a dataset is
    assembled from those few rows.
    """
    by_type = df.groupBy(*keys, "attack_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 0).alias("normal"),
        F.sum(F.length(text_col)).alias("chars"),
    )
    histogram = F.array_sort(
        F.collect_list(
            F.when(F.col("attack_type").isNotNull(), F.concat_ws("=", "attack_type", F.col("n").cast("string")))
        )
    )
    totals = by_type.groupBy(*keys).agg(
        F.sum("n").alias("total_samples"),
        F.sum("normal").alias("normal_samples"),
        (F.sum("n") - F.sum("normal")).alias("adversarial_samples"),
        (F.sum("normal") / F.sum("n")).alias("class_balance"),
        (F.sum("chars") / F.sum("n")).alias("avg_prompt_length"),
        F.array_join(histogram, ";").alias("attack_types"),
    )
    sources = df.groupBy(*keys, "source").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("*").alias("sources"))
    return totals.join(sources, keys)


def label_prompts(df: DataFrame, order: list[str], text_col: str = "text") -> DataFrame:
    """Automatic labels with the position of the row in the batch."""
    labelled = df.withColumns(tx.auto_label(F.col(text_col)))
    return running_index(labelled, [], order, "batch_index")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k n_c) per class."""
    per_class = df.groupBy(label).agg(F.count("*").alias("n"))
    total = per_class.agg(F.sum("n").alias("_total"), F.count("*").alias("_classes"))
    paired = per_class.withColumn("_k", F.lit(0)).join(F.broadcast(total.withColumn("_k", F.lit(0))), "_k")
    return paired.select(label, "n", (F.col("_total") / (F.col("_classes") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    return df.join(class_weights(df, label).select(label, "weight"), label)


# Cumulative probabilities of a Poisson variable of mean 1: how often a row is drawn when as
# many rows are drawn with replacement as there are.
POISSON_ONE = [0.367879, 0.735759, 0.919699, 0.98101, 0.99634, 0.999406, 0.999917, 0.99999]


def bootstrap_draws(key: Column, member: Column | int, seed: int = 42) -> Column:
    """Number of times a row is in a member's sample, from the hash of its key."""
    u = choice(key, member, 1_000_000, seed, "bootstrap") / 1_000_000.0
    return sum(((u >= c).cast("int") for c in POISSON_ONE), F.lit(0))


def bootstrap(df: DataFrame, id_col: str, members: int, seed: int = 42) -> DataFrame:
    """A sample with replacement, of about the table's size, per ensemble member; no shuffle."""
    each = df.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    drawn = fenced(each, {"_d": bootstrap_draws(F.col(id_col), F.col("member"), seed)}).where("_d > 0")
    return drawn.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_d")))).drop("_d")


def weighted_sampler(df: DataFrame, id_col: str, label: str, seed: int = 0) -> DataFrame:
    """Rows repeated in proportion to their class weight: floor(w) times, and once more with the
    fraction as probability (by hash). The expected size is that of the table."""
    weighted = with_class_weight(df, label)
    extra = choice(F.col(id_col), 0, 1_000_000, seed, "draw") / 1_000_000.0
    w = F.col("weight")
    draws = (F.floor(w) + F.when(extra < w - F.floor(w), 1).otherwise(0)).cast("int")
    drawn = weighted.withColumn("_d", draws).where("_d > 0")
    return drawn.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_d")))).drop("_d")
