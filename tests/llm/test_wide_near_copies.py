"""Near copies at a shingle similarity of 0.8: the wide index against brute force and against exact Jaccard similarities."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_against_brute_force import MEDIUM, WORD, components
from wardline.llm import gray_dedup, gray_wide
from wardline.llm.common import table

GOLDEN, M1, M2, ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


def shingles(text, k=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_bits(text):
    """512 bits from the definition, one shingle and one bit at a time."""
    hashes = sorted({xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)})
    out = []
    for word in range(1, 9):
        wide = []
        for h in hashes:
            z = (h + word * GOLDEN) & ALL
            z = ((z ^ z >> 30) * M1) & ALL
            z = ((z ^ z >> 27) * M2) & ALL
            wide.append(z ^ z >> 31)
        for byte in range(8):
            for bit in range(7, -1, -1):
                votes = [w >> (8 * byte + bit) & 1 for w in wide]
                out.append(int(bool(votes) and 2 * sum(votes) + votes[0] > len(votes)))
    return out


def plain_links(bits, similarity, cell):
    """Pairs within the radius that share the leading bits of an order."""
    n = len(bits)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / cell))))
    fronts = [gray_wide.order_bits(o, depth)[:depth] for o in range(gray_wide.orders_of(depth, similarity))]
    near = [(i, j) for i, j in combinations(range(n), 2) if (bits[i] != bits[j]).sum() <= gray_wide.radius_of(similarity)]
    return [(i, j) for i, j in near if any((bits[i][f] == bits[j][f]).all() for f in fronts)]


def clusters(seed, centers, each, apart):
    """Distinct fingerprints: balls of several sizes around random centers, and single ones."""
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, 2, 512) for _ in range(60)]
    for _ in range(centers):
        center = rng.integers(0, 2, 512)
        out += [center ^ (rng.random(512) < rng.uniform(0, apart)) for _ in range(each)]
    return np.unique(np.array(out, np.uint8), axis=0)


def test_fingerprint_from_the_definition():
    for text in ("", "one", "a b c d e", "a b c d e f", "A b C d e f g h a b c d e", "w1 w2 w3 w4 w5 w6 w7 " * 3, None):
        got = np.unpackbits(np.frombuffer(gray_wide.wide_fingerprint((text or "").encode()), np.uint8))
        assert got.tolist() == plain_bits(text)
    many = " ".join(f"w{k}" for k in range(700))  # more shingles than one count of bytes holds
    assert np.unpackbits(np.frombuffer(gray_wide.wide_fingerprint(many.encode()), np.uint8)).tolist() == plain_bits(many)


@pytest.mark.parametrize("cell,block", [(10_000, 4096), (10_000, 16), (16, 4096), (16, 8)])
def test_components_are_those_of_all_links(spark, cell, block):
    bits = clusters(cell + block, 4, 60, 0.12)
    rows = [(k, bytearray(np.packbits(b).tobytes())) for k, b in enumerate(bits)]
    distinct = spark.createDataFrame(rows, "node long, fp binary").repartition(3)
    label = {r.node: r.root for r in gray_wide.components(distinct, cell=cell, block=block).collect()}
    want = components(range(len(bits)), plain_links(bits, 0.8, cell))
    assert {k: label.get(k, k) for k in want} == want and len(set(want.values())) < len(want)


def test_leads_are_disjoint_and_differ_in_every_lap():
    fronts = [gray_wide.order_bits(o, 16)[:16] for o in range(64)]
    assert sorted(np.concatenate(fronts[:32]).tolist()) == list(range(512)) == sorted(np.concatenate(fronts[32:]).tolist())
    assert not {frozenset(f.tolist()) for f in fronts[:32]} & {frozenset(f.tolist()) for f in fronts[32:]}
    assert gray_wide.orders_of(0, 0.8) == 1 and gray_wide.orders_of(12, 0.8) < gray_wide.orders_of(20, 0.8)


def edited(rng, words, target):
    """Words replaced one by one until the similarity to the first text would fall below the target."""
    now, base = list(words), shingles(" ".join(words))
    while True:
        new = list(now)
        new[rng.randrange(len(new))] = f"edit{rng.randrange(10**9)}"
        if jaccard(base, shingles(" ".join(new))) < target:
            return " ".join(now)
        now = new


@pytest.mark.parametrize("cell", [gray_wide.CELL, 16])
def test_near_copies_of_whole_documents(spark, cell):
    """Copies at 0.8 to 0.95 of the given texts: nine in ten are found and no two unlike texts are put together."""
    rng = random.Random(7)
    docs = [r for r in table(spark, MEDIUM, "documents").orderBy("doc_id").collect() if len(WORD.findall(r.text or "")) >= 100]
    base = [(r.doc_id, r.text) for r in docs]
    copies = [(10**6 + k, edited(rng, WORD.findall(t), rng.choice([0.8, 0.82, 0.85, 0.9, 0.95]))) for k, t in base[:300] if len(t) < 20_000]
    rows = base + copies
    got = {r.doc_id: r.component_id for r in gray_wide.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()}
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(i, i + 10**6) for i, _ in base if i + 10**6 in sets]
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) >= 200 and all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in pairs) and found >= 0.9 * len(pairs)
    members = {}
    for i, c in got.items():
        members.setdefault(c, []).append(i)
    for group in members.values():
        for i in group:  # every member is like another one
            assert len(group) == 1 or max(jaccard(sets[i], sets[j]) for j in group if j != i) >= 0.6


def test_one_stays_of_every_group(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(200))
    near = text.replace("word77", "changed")
    rows = [(5, text), (3, near), (None, text), (9, "other text " * 30), (9, "other text " * 30), (1, None), (2, " \n"), (None, "alone with no id"), (7, "alone")]
    spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, fp string, row string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = gray_wide.one_per_group(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(3, near), (9, "other text " * 30), (1, None), (None, "alone with no id"), (7, "alone")], key=str)
    groups = sorted(((r.doc_id, r.component_id) for r in gray_wide.similar_groups(docs).collect()), key=str)
    assert groups == sorted([(5, 3), (3, 3), (None, 3), (9, 9), (9, 9), (1, 1), (2, 1), (None, None), (7, 7)], key=str)
    empty = docs.where("false")
    assert gray_wide.one_per_group(empty).count() == 0 == gray_wide.similar_groups(empty).count()
    assert gray_wide.one_per_group(docs.limit(1)).count() == 1
    assert gray_wide.similar_groups(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).select("component_id").distinct().count() == 1


def test_pairs_at_the_asked_similarity_are_linked(spark):
    """Bits differ as they do at 0.8, in many cells: not one pair in fifty is left out."""
    rng = np.random.default_rng(21)
    one = rng.integers(0, 2, (600, 512)).astype(np.uint8)
    other = one ^ (rng.random((600, 512)) < gray_wide.flip_rate(0.8))
    rows = [(k, bytearray(np.packbits(b).tobytes())) for k, b in enumerate(np.concatenate([one, other]))]
    label = {r.node: r.root for r in gray_wide.components(spark.createDataFrame(rows, "node long, fp binary"), cell=32).collect()}
    assert sum(label.get(600 + k) == k for k in range(600)) >= 588
    assert all(k % 600 == label[k] for k in label)


def test_the_stage_links_what_the_operator_links(spark, tmp_path):
    """Texts of one phrase again and again: alike to op2's operator, which counts repeats, and unlike by their sets of shingles;
    a near copy of either by its set joins them into one group."""
    rng = random.Random(3)
    some = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "ab"]
    a, b = ("alpha beta gamma " * 400 + x for x in some)
    near = "new " + b
    rows = [(4, a), (2, b), (3, near), (1, " ".join(f"w{k}" for k in range(80)))]
    assert jaccard(shingles(a), shingles(b)) < 0.2 and jaccard(shingles(b), shingles(near)) >= 0.8
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert {r.doc_id: r.component_id for r in gray_dedup.near_groups(docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 2}
    assert sorted(r.doc_id for r in gray_wide.one_per_group(docs).collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 2]
    apart = docs.where("doc_id <> 2")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, apart, "").collect()) == [1, 3]
    assert corpus_pipeline.near_copies(spark, docs.where("false"), "").count() == 0
    twice = docs.union(docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "IF(doc_id = 1, NULL, text) AS text"))
    twice.write.parquet(str(tmp_path / "t"))
    kept = [(r.doc_id, r.text is None) for r in corpus_pipeline.near_copies(spark, spark.read.parquet(str(tmp_path / "t")), "").collect()]
    assert sorted(kept, key=str) == [(1, False), (2, False), (None, True)]
