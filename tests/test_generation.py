"""Generated variants and forests: numpy in batches gives what the columns and the walks tree by tree give."""

import numpy as np
from pyspark.sql import functions as F

from wardline.functions import vectors as vx
from wardline.functions import text as tx
from wardline.operators import generate as gn
from wardline.operators import models as ml

WEIGHTS = [((-1) ** d) * (d + 1) / 64 for d in range(vx.DIMS)]


def texts(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "can you help me. Please show this"), (6, "a a a b"), (7, " ".join(f"w{i}" for i in range(400)))]
    return spark.createDataFrame(rows, "prompt_id long, text string")


def test_perturbed_embeddings_in_batches_equal_the_columns(spark):
    w, e, label = F.array(*[F.lit(x) for x in WEIGHTS]), vx.embed(tx.words(F.col("text"))), F.lit(1.0)
    for epsilon in (0.1, 0.5):
        both = texts(spark).withColumn("_e", e).select(
            gn.perturbed_udf(WEIGHTS, epsilon)(vx.buckets(tx.words(F.col("text")))).alias("n"),
            vx.cosine(F.col("_e"), gn.fgsm(F.col("_e"), w, label, epsilon)).alias("fgsm"), vx.cosine(F.col("_e"), gn.pgd(F.col("_e"), w, label, epsilon)).alias("pgd"),
        ).collect()
        assert [(r.n.fgsm, r.n.pgd) for r in both] == [(r.fgsm, r.pgd) for r in both]


def test_esa_is_not_walked_step_by_step_in_columns(spark):
    made = gn.esa_generate(texts(spark), "prompt_id", WEIGHTS, n=2)
    assert "signum" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert made.where("attack IS NULL").count() == 0 and made.count() > 0


def test_similarity_of_variants_equals_the_columns(spark):
    made = gn.cap_generate(texts(spark), "prompt_id", n=5, threshold=0.0)
    rows = made.select("similarity", gn.prompt_similarity(F.col("text"), F.col("attack")).alias("s")).collect()
    assert len(rows) > 20 and all(r.similarity == r.s for r in rows)


def tree_by_tree(forest, rows):
    out = np.zeros(len(rows))
    for i, row in enumerate(rows):
        for tree in forest:
            at = 0
            while tree[at, 0] >= 0:
                at = int(tree[at, 2] if row[int(tree[at, 0])] < tree[at, 1] else tree[at, 3])
            out[i] += tree[at, 4]
    return out / len(forest)


def test_rows_walk_down_all_trees_at_once():
    rng = np.random.default_rng(1)
    grown = [np.array([n[1:] for n in ml.grow_tree(rng.random((256, 3)), np.random.default_rng(i), 8)]) for i in range(7)]
    forest = [*grown, np.array([[-1, 0.0, -1, -1, 3.0]])]
    rows = rng.random((50, 3))
    rows[3, 1] = np.nan
    assert np.array_equal(ml.path_lengths(forest, rows), tree_by_tree(forest, rows))
    assert np.array_equal(ml.walk(ml.walkable(forest), rows), tree_by_tree(forest, rows))
    assert len(ml.path_lengths(forest, rows[:0])) == 0


def test_trees_draw_their_rows_in_a_compiled_loop(spark):
    df = spark.range(3000).select("id", (F.col("id") * 0.5).alias("x"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("y"))
    forest = ml.fit_isolation_forest(df, ["x", "y"], ["id"], trees=3)
    u = lambda t: F.pmod(F.xxhash64(F.xxhash64("id"), F.lit(t)), F.lit(1_000_003)) / 1_000_003.0
    assert len(forest) == 3
    for t, tree in enumerate(forest):
        drawn = df.orderBy(u(t), F.xxhash64("id")).limit(ml.SAMPLE).toPandas().sort_values(["x", "y"])[["x", "y"]].to_numpy().astype(float)
        grown = np.array([n[1:] for n in ml.grow_tree(drawn, np.random.default_rng(42 + t), 8)])
        assert np.array_equal(tree, grown)
