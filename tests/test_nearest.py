"""Exact search among blocks, against all pairs: results, ties, and how little of the corpus is opened."""

import numpy as np
import pandas as pd
import pytest

from wardline.functions import geometry as geo
from wardline.operators import nearest as nr
from wardline.operators import similarity as sm
from wardline.operators import tokens as tk
from wardline.plans import similarity_queries as sq
from wardline.session import prepare


def windows_of_text(rng, tokens, radius=5, dims=64):
    """Windows around every token of a text whose tokens follow a steep distribution, as bucket counts."""
    cell = np.minimum(rng.zipf(1.3, tokens) - 1, 5000) * 2654435761 % dims
    return geo.TokenSpace(dims).around(cell, 0, tokens, radius, radius)


def all_cosines(a, b):
    norm = np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None])
    return np.divide(a @ b.T, norm, out=np.zeros((len(a), len(b))), where=norm > 0)


def corpora():
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(700, 16)) + 3 * rng.normal(size=(700, 1))
    yield "counts", windows_of_text(rng, 900), windows_of_text(rng, 300)
    yield "dense", dense, rng.normal(size=(200, 16))
    yield "one", dense[:1], dense[:5]
    yield "zeros and copies", np.concatenate([np.zeros((20, 16)), np.repeat(dense[:7], 9, axis=0)]), np.concatenate([np.zeros((3, 16)), dense[:9]])


@pytest.mark.parametrize("name,corpus,asked", list(corpora()), ids=[c[0] for c in corpora()])
def test_blocks_equal_all_pairs(name, corpus, asked, monkeypatch):
    monkeypatch.setattr(nr, "BOUNDS", 1000)
    ids = np.random.default_rng(1).permutation(len(corpus))
    blocks, want = nr.Blocks(corpus, ids.tolist()), all_cosines(asked, corpus)
    hi, lo = blocks.extremes(asked)
    assert np.allclose(hi, want.max(axis=1), atol=1e-12) and np.allclose(lo, want.min(axis=1), atol=1e-12)
    rounded = np.round(want, 9)
    for k in (1, 5, 40):
        got, sims = blocks.best(asked, k, 9)
        for q in range(len(asked)):
            order = np.lexsort((ids, -rounded[q]))[:k]
            assert got[q].tolist() == ids[order].tolist() and sims[q].tolist() == rounded[q][order].tolist()


def test_few_of_thirty_thousand_references_are_opened():
    rng = np.random.default_rng(5)
    known = np.concatenate([windows_of_text(rng, 300) for _ in range(100)])
    asked = np.concatenate([windows_of_text(rng, 30) for _ in range(50)])
    blocks = nr.Blocks(known, list(range(len(known))))
    hi, lo = blocks.extremes(asked)
    assert len(known) == 30_000 and np.allclose(hi, all_cosines(asked, known).max(axis=1))
    assert lo.max() == 0 or np.allclose(lo, all_cosines(asked, known).min(axis=1))
    assert blocks.opened < 0.25 * len(known) * len(asked)


def test_handed_out_and_joined_searches_agree(spark):
    rng = np.random.default_rng(9)
    texts = [(k, " ".join(f"w{rng.integers(40)}" for _ in range(rng.integers(0, 30)))) for k in range(40)]
    df = tk.with_tokens(spark.createDataFrame(texts, "prompt_id long, text string"))
    known = tk.text_reference(tk.with_tokens(spark.createDataFrame([(k, t) for k, t in texts[:25]], "ref_id long, text string")), "ref_id")
    both = []
    for limit in (nr.HANDED, 1024):
        one = tk.prepared(known, handed=limit)
        assert (one.blocks is None) == (limit == 1024)
        sims = {r.prompt_id: r for r in tk.with_reference_similarity(df, one, "prompt_id", 2).select("prompt_id", "max_sim", "min_sim", "mean_sim", "std_sim").collect()}
        top = {(r.prompt_id, r.pos, r["rank"]): (r.ref, r.similarity) for r in tk.top_similar_tokens(df, one, "prompt_id", 2, 2, 4).collect()}
        both.append((sims, top))
    (a, top_a), (b, top_b) = both
    assert set(a) == set(b) and top_a == top_b and len(top_a) > 100
    for k in a:
        for c in ("max_sim", "min_sim", "mean_sim", "std_sim"):
            assert np.allclose(a[k][c], b[k][c], atol=1e-12)


def test_knn_by_blocks_and_by_cells_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(400, 8)).round(1).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = [sorted(tuple(r) for r in sm.knn_search(df, df, "id", "v", 5, 0.3, limit).select("query_id", "corpus_id", "similarity", "rank").collect()) for limit in (nr.HANDED, 2000)]
    assert got[0] == got[1] and len(got[0]) > 1500
    assert sm.knn_search(df, df.where("false"), "id", "v").count() == 0 and sm.knn_search(df.where("false"), df, "id", "v").count() == 0


def test_cells_grow_with_the_corpus(spark):
    df = spark.range(3000).selectExpr("id", "array(sin(id), cos(id * 3), sin(id * 7)) AS v").select("id", nr.packed(nr.F.col("v")).alias("v"))
    small, large = (nr.build_index(df.where(f"id < {n}"), "id", "v", slice_rows=5) for n in (300, 3000))
    assert len(small.centers) == 60 and len(large.centers) == 219


def test_a_long_text_is_searched_in_steps(spark, monkeypatch):
    """20,000 tokens against many references: no matrix larger than the bounds of a step."""
    rng = np.random.default_rng(4)
    known = np.concatenate([windows_of_text(rng, 500) for _ in range(8)])
    blocks, largest = nr.Blocks(known, list(range(len(known)))), []
    bounds = blocks.bounds
    monkeypatch.setattr(blocks, "bounds", lambda asked, norm: largest.append(len(asked) * len(blocks.high)) or bounds(asked, norm))
    asked = windows_of_text(rng, 20_000)
    hi, _ = blocks.extremes(asked)
    assert max(largest) <= nr.BOUNDS and np.allclose(hi[:200], all_cosines(asked[:200], known).max(axis=1))


def test_packs_meet_every_block_once(spark, monkeypatch):
    """Equal vectors, queries that come twice, several packs and blocks: the hits of the search by blocks that are handed out."""
    monkeypatch.setattr(nr.blocks_of, "__defaults__", (64,))
    monkeypatch.setattr(nr.packs_of, "__defaults__", (10,))
    rng = np.random.default_rng(7)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(300, 4)).round(0).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    ask = df.where("id % 5 = 0").union(df.where("id = 5"))
    got, want = ([tuple(r) for r in sm.knn_search(ask, df, "id", "v", 4, 0.2, limit).select("query_id", "corpus_id", "similarity", "rank").collect()] for limit in (500, nr.HANDED))
    assert sorted(got) == sorted(want) and len(got) > 200


def plain_hits(asked, vectors, k, threshold):
    norm = np.sqrt((asked * asked).sum(axis=1)[:, None] * (vectors * vectors).sum(axis=1)[None])
    c = np.round(np.divide(asked @ vectors.T, norm, out=np.zeros(norm.shape), where=norm > 0), 9)
    best = np.argsort(-c, axis=1, kind="stable")[:, :k]
    return [(q, h, c[q, h]) for q, row in enumerate(best.tolist()) for h in row if c[q, h] >= threshold]


@pytest.mark.parametrize("n, singly", [(0, 512), (3, 512), (5, 512), (6, 512), (700, 512), (700, 0)])
def test_best_pairs_are_those_of_all_cosines(monkeypatch, n, singly):
    """Fewer vectors than k, equal vectors, zeros, cosines that differ by less than single precision tells."""
    monkeypatch.setattr(sm, "SINGLY", singly)
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, 8)).round(0 if n > 6 else 1)
    vectors[n // 2 :] += 1e-8 * rng.normal(size=vectors[n // 2 :].shape)
    vectors[: n // 50] = 0.0
    asked = np.concatenate([vectors, rng.normal(size=(130, 8))])
    for threshold in (0.2, -1.0):
        got = [(q, h, s) for found in sm.best_pairs(asked, vectors, 5, threshold) for q, h, s in zip(*(x.tolist() for x in found))]
        want = plain_hits(asked, vectors, 5, threshold)
        assert len(got) == len(want) and np.allclose([s for *_, s in got], [s for *_, s in want], atol=2e-9)
        assert sum(a[:2] == b[:2] for a, b in zip(got, want)) >= 0.99 * len(want)  # the ninth digit may round either way


def test_every_vector_is_a_query(spark, tmp_path):
    """Also one whose id is not divisible by 20, by the query and by its statement; vectors that are missing are no hits."""
    import duckdb

    rng = np.random.default_rng(11)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(90, 6)).round(3).tolist())] + [(90, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in sq.knn_search(spark, str(tmp_path)).select("query_id", "corpus_id", "similarity", "rank").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT query_id, corpus_id, similarity, rank FROM ({sq.ORACLE['knn_search']})").fetchall())
    assert got == want and {r[0] for r in got} == set(range(90))


def test_groups_of_packs_meet_every_block(spark, monkeypatch):
    """One block for many tasks: packs are dealt into groups, and each still meets it once."""
    monkeypatch.setattr(nr.packs_of, "__defaults__", (10,))
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(size=(300, 4)).round(0).tolist())], "id long, v array<float>")
    dealt, plain = [], nr.meet
    monkeypatch.setattr(nr, "meet", lambda *a: dealt.append(a[2:]) or plain(*a))
    got, want = ([tuple(r) for r in sm.knn_search(df, df, "id", "v", 4, 0.2, limit).select("query_id", "corpus_id", "similarity", "rank").collect()] for limit in (500, nr.HANDED))
    assert sorted(got) == sorted(want) and len(got) == 300 * 4 - 4 * sum(r == [0.0] * 4 for r in [list(x.v) for x in df.collect()])
    assert dealt[0][0] == 1 and dealt[0][-1] >= 8


def test_few_references_are_compared_without_bounds(monkeypatch):
    """The same hits and ties as by blocks; no bounds are made."""
    rng = np.random.default_rng(9)
    blocks, asked = nr.Blocks(rng.integers(0, 3, (200, 8)).astype(float), [str(i) for i in rng.permutation(200)]), rng.integers(0, 3, (3000, 8)).astype(float)
    with monkeypatch.context() as m:
        m.setattr(nr, "PLAIN", 0)
        (ids, sims), ends = blocks.best(asked, 5), blocks.extremes(asked)
    monkeypatch.setattr(blocks, "bounds", None)
    got, got_ends = blocks.best(asked, 5), blocks.extremes(asked)
    assert (got[0] == ids).all() and np.array_equal(got[1], sims) and all(np.array_equal(a, b) for a, b in zip(ends, got_ends))


def test_python_gets_batches_of_bounded_rows(spark):
    sizes = prepare(spark).range(5000).coalesce(1).mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long")
    assert {r.n for r in sizes.collect()} <= {1024, 5000 % 1024}
