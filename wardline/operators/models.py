"""Training and scoring of detection models on Spark ML, and a distributed isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.datasets import bootstrap, with_class_weight
from wardline.operators.ordering import exact_percentiles
from wardline.session import checkpointed


def scaler_stages(features: list[str], robust: bool = False, out: str = "scaled") -> list:
    assembler = VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")
    if robust:
        return [assembler, RobustScaler(inputCol="raw_features", outputCol=out, withCentering=True)]
    return [assembler, StandardScaler(inputCol="raw_features", outputCol=out, withMean=True)]


def fit_scaler(df: DataFrame, features: list[str], robust: bool = False) -> PipelineModel:
    return Pipeline(stages=scaler_stages(features, robust)).fit(df)


def fit_logistic(df: DataFrame, features: list[str], label: str = "label", iterations: int = 1000) -> PipelineModel:
    """Class-balanced logistic regression on standardised features."""
    weighted = with_class_weight(df, label)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=iterations, probabilityCol="probability_vec")
    return Pipeline(stages=[*scaler_stages(features), model]).fit(weighted)


def fit_random_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    model = RandomForestClassifier(
        featuresCol="scaled", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="probability_vec"
    )
    return Pipeline(stages=[*scaler_stages(features, robust=True), model]).fit(df)


def fit_mlp_ensemble(
    df: DataFrame, id_col: str, features: list[str], label: str = "label", members: int = 5, hidden: tuple[int, ...] = (256, 128, 64),
    iterations: int = 100, seed: int = 42,
) -> list[PipelineModel]:
    """Networks on bootstrap samples; members differ in sample and start weights."""
    out = []
    drawn = checkpointed(bootstrap(df, id_col, members, seed))
    for i in range(members):
        sample = drawn.where(F.col("member") == i)
        net = MultilayerPerceptronClassifier(
            layers=[len(features), *hidden, 2], featuresCol="scaled", labelCol=label, maxIter=iterations, seed=seed + i,
            probabilityCol="probability_vec",
        )
        out.append(Pipeline(stages=[*scaler_stages(features, robust=True), net]).fit(sample))
    return out


MODEL_COLUMNS = ["raw_features", "scaled", "rawPrediction", "probability_vec"]


def score_model(df: DataFrame, model: PipelineModel, hit: str = "hit", probability: str = "probability") -> DataFrame:
    scored = model.transform(df)
    p = F.get(vector_to_array("probability_vec"), F.lit(1))
    return scored.withColumns({probability: p, hit: F.col("prediction") == 1}).drop(*MODEL_COLUMNS, "prediction")


def score_ensemble(df: DataFrame, models: list[PipelineModel]) -> DataFrame:
    """Arrays `votes` and `probabilities` with one entry per model."""
    out, names = df, []
    for i, model in enumerate(models):
        out = score_model(out, model, f"_hit_{i}", f"_p_{i}")
        names.append(i)
    return out.withColumns(
        {
            "votes": F.array(*[F.col(f"_hit_{i}").cast("double") for i in names]),
            "probabilities": F.array(*[F.col(f"_p_{i}") for i in names]),
        }
    ).drop(*[f"_hit_{i}" for i in names], *[f"_p_{i}" for i in names])


# --- isolation forest --------------------------------------------------------------------

SAMPLE = 256  # rows per tree


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes (id, feature, cut, left, right, path): leaves have feature -1 and their path length."""
    nodes: list = []

    def grow(part: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append(None)
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(rows.shape[1])
        usable = np.nonzero(spread > 0)[0]
        if level >= depth or len(part) <= 1 or len(usable) == 0:
            nodes[me] = (me, -1, 0.0, -1, -1, level + average_path(len(part)))
            return me
        f = int(rng.choice(usable))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] < cut
        left, right = grow(part[below], level + 1), grow(part[~below], level + 1)
        nodes[me] = (me, f, cut, left, right, 0.0)
        return me

    grow(rows, 0)
    return nodes


def fit_isolation_forest(
    df: DataFrame, features: list[str], key: list[str], trees: int = 100, sample: int = SAMPLE, seed: int = 42
) -> list[np.ndarray]:
    """Trees on small samples, grown in parallel; the forest is bounded by trees x 2 x sample nodes.

    `key` names the rows: each has a hash per tree, and a tree takes the `sample` rows of smallest hash, so equal rows are
    drawn one by one. Rows far from the smallest hashes are dropped where they are read; the ranking keeps at most `sample`
    rows per tree and task before the shuffle.
    """
    total = df.count()
    if total == 0:
        raise ValueError("an isolation forest needs rows")
    # A little more than needed, so that hardly any tree falls short.
    share = min(1.0, (sample + 6 * sample**0.5) / total)
    drawn = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.xxhash64(*key).alias("_key"))
    # One uniform number per (row, tree) from the row's key, so that retried tasks draw the same rows.
    u = lambda t: F.pmod(F.xxhash64("_key", t), F.lit(1_000_003)) / 1_000_003.0
    # A loop over the trees with a condition, which Spark compiles; arrays of the numbers of all trees it would interpret.
    each = drawn.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)])))
    picked = each.withColumn("u", u(F.col("tree"))).where(F.col("u") <= share).select(*features, "_key", "tree", "u")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("u", "_key"))
    picked = picked.withColumn("_place", place).where(F.col("_place") <= sample)
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(features)[features].to_numpy()
        nodes = grow_tree(rows, np.random.default_rng(seed + tree), depth)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    schema = "tree int, node int, feature int, cut double, left int, right int, path double"
    nodes = picked.groupBy("tree").applyInPandas(grow, schema).toPandas()
    return [g.sort_values("node")[["feature", "cut", "left", "right", "path"]].to_numpy() for _, g in nodes.groupby("tree")]


def walkable(forest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """All trees end to end as flat arrays: feature, cut, (left, right) pairs and path, and (root, depth) per tree. A leaf is its
    own child, so rows walk without asking which have arrived."""
    sizes = [len(t) for t in forest]
    starts = np.cumsum([0, *sizes])[:-1]
    nodes = np.concatenate(forest)
    leaf, own = nodes[:, 0] < 0, np.arange(len(nodes))
    first = np.repeat(starts, sizes)
    left, right = (np.where(leaf, own, nodes[:, c].astype(np.int64) + first) for c in (2, 3))
    feature, cut = np.where(leaf, 0, nodes[:, 0]).astype(np.int64), np.where(leaf, -np.inf, nodes[:, 1])
    roots = []
    for start in starts.tolist():
        depth, level = 0, np.array([start])
        while len(level := level[~leaf[level]]):
            depth, level = depth + 1, np.concatenate([left[level], right[level]])
        roots.append((start, depth))
    return feature, cut, np.stack([right, left], axis=1).ravel(), nodes[:, 4], roots


#: Pairs of a row and a tree that walk down together.
WALK = 65_536


def path_lengths(forest: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Mean path length over all trees, all rows walking down together."""
    return walk(walkable(forest), rows)


def walk(trees: tuple, rows: np.ndarray) -> np.ndarray:
    feature, cut, child, path, roots = trees
    total, width, step = np.zeros(len(rows)), rows.shape[1], max(1, WALK // len(roots))
    start, depth = np.array([r for r, _ in roots]), max(d for _, d in roots)
    for lo in range(0, len(rows), step):
        flat = np.ascontiguousarray(rows[lo : lo + step]).ravel()
        base = np.arange(0, len(flat), width)
        at = np.repeat(start[:, None], len(base), axis=1)
        for _ in range(depth):
            below = flat[base + feature[at]] < cut[at]
            at = child[2 * at + below]
        total[lo : lo + step] = path[at].sum(axis=0)
    return total / len(roots)


def score_isolation_forest(df: DataFrame, forest: list[np.ndarray], features: list[str], sample: int = SAMPLE, out: str = "outlier") -> DataFrame:
    """Add the outlier score in 0..1; the forest travels with the task."""
    scale = average_path(sample)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = walkable(forest)
        for columns in batches:
            rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            yield pd.Series(np.power(2.0, -walk(trees, rows) / scale))

    return df.withColumn(out, run(*[F.col(f).cast("double") for f in features]))


def flag_outliers(scored: DataFrame, score: str = "outlier", contamination: float = 0.1, flag: str = "is_outlier") -> DataFrame:
    """Rows above the (1 - contamination) quantile of the score, which is exact and distributed."""
    cut = exact_percentiles(scored, [], F.col(score), {"q": 1.0 - contamination}).first()["q"]
    return scored.withColumn(flag, F.col(score) > F.lit(cut))
