"""Batches of texts: hashing of words and statistics of packs against the plain versions."""

import numpy as np
from pyspark.sql import functions as F

from wardline.functions import geometry as geo
from wardline.functions import spans as sp
from wardline.functions import text as tx
from wardline.functions import vectors as vx
from wardline.operators import enhanced as en
from wardline.operators import generate as gn
from wardline.operators import tokens as tk

TEXTS = ["", " ", "a", "A a. b", "Σοφός ΣΑΣ İstanbul　ÇA\u000bVA", "x " * 300, ". . .", "Straße STRASSE!\n\nwait", None, "word"]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")


def test_words_hashed_by_batch_are_the_column_buckets(spark):
    df = texts(spark).select("i", tx.words(F.col("text")).alias("w"))
    rows = df.select("w", geo.embedded(vx.HASHED, F.col("w")).alias("a"), vx.buckets(F.col("w")).alias("b")).collect()
    assert len(rows) == len(TEXTS) and all(r.a == r.b for r in rows)
    assert sum(r.w is None for r in rows) == 1


def test_no_word_is_hashed_by_the_plan(spark, capsys):
    """md5 of a word as a column costs more than all else; generators and the analysis hash each word of a batch once."""
    df = texts(spark)
    made = [gn.esa_generate(df, "i", [0.5] * 64, n=2).select("similarity"), gn.cap_generate(df, "i", n=2, threshold=2.0).select("similarity")]
    base = tk.with_tokens(df).withColumns({"cosines": F.array(F.lit(1.0)), "anomaly": F.array(F.lit(1.0)), "overall_anomaly": F.lit(0.0)})
    for d in [*made, en.features16(base, radius=1).select(*en.FEATURES)]:
        d.explain(True)
        analyzed = capsys.readouterr().out.split("== Optimized Logical Plan ==")[0]
        assert "lambda" in analyzed and "md5(cast(lower(" not in analyzed


def test_word_position_of_a_variant_is_computed_once(spark):
    """The position is a hash of the row; inside the lambda over words it would be computed for each word."""
    df = texts(spark).withColumn("v", gn.semantic_variant(F.col("text"), gn.choice(F.col("i"), 0, 1 << 20, 0, "semantic")))
    plan = df._jdf.queryExecution().analyzed().toString()
    inner = plan[plan.index("CASE WHEN (lambda") if "CASE WHEN (lambda" in plan else plan.index("namedlambdavariable") :]
    assert "md5" not in inner[: inner.index("swap") if "swap" in inner else inner.index("THEN")]


def test_packs_of_texts_have_the_numbers_of_each(spark):
    rng, space = np.random.default_rng(5), geo.TokenSpace()
    cells = [rng.integers(0, 64, n) for n in (0, 1, 2, 3, 0, 9, 150, 1, 2, 0)] + [np.full(7, 3), np.array([1, 1, 2])]
    for radius in (0, 1, 5, 40):
        got = geo.window_numbers_each(space, cells, radius)
        want = [(*geo.window_moments(space, c, radius), geo.text_gradient(space, c), geo.phrase_anomaly(space, c)) for c in cells]
        assert np.allclose(got, want, atol=1e-12)
    assert geo.window_numbers_each(space, [cells[0], cells[4]], 1).tolist() == [[0.0] * 5] * 2
    sizes = [rng.multinomial(len(c), np.ones(k) / k) if k else np.zeros(0, np.int64) for c, k in zip(cells, (0, 1, 2, 3, 4, 3, 12, 1, 3, 1, 2, 3))]
    assert np.allclose(geo.sentence_moments_each(space, cells, sizes), [geo.sentence_moments(space, c, s) for c, s in zip(cells, sizes)], atol=1e-12)


def test_sentences_as_words_have_the_numbers_of_buckets(spark):
    df = tk.with_tokens(texts(spark))
    text, run = F.coalesce("text", F.lit("")), geo.text_statistics_udf(geo.TokenSpace(), 1)
    df = df.withColumns({"s": sp.sentence_spans(text), "u": sp.sentence_units(text)})
    sizes = F.transform("s", lambda s: F.size(s))
    rows = df.select(run("buckets", F.flatten("s"), sizes).alias("a"), run("buckets", F.flatten("u"), sizes).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) > 3


def test_naturalness_with_the_number_of_sentences(spark):
    text = F.col("text")
    df = texts(spark).withColumn("n", F.size(tx.sentences(text)))
    assert all(r.a == r.b for r in df.select(tx.naturalness(text).alias("a"), tx.naturalness(text, F.col("n")).alias("b")).collect())
