"""Every operator on nulls, blank and long texts, ties, repeated rows, clashing column names and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import adaptive_rules, block_simhash, bpe, bwt_dedup, chat_pairs, gray_dedup, hyper_langid, mixing, quality_trees, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CLASHES = ["row", "fp", "key", "size", "h", "words", "taken", "part", "root", "cell", "target", "ids", "score", "_copy", "pass", "spans", "kept", "label", "src", "n"]
TEXTS = [
    None, "", " \n\t ", "...", "One word", "Same text twice for a tie.", "Same text twice for a tie.", "żółć 漢字 \U0001f600 ünï",
    "a" * 3000, "x y z " * 30_000, ("The quick brown fox jumps over the lazy dog. " * 12), None,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = []
    for k, t in enumerate(TEXTS):
        out.append((k, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], len(t or "")))
    return [*out, out[5], out[5], (None, "no id here", "en", "a", 10), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "docs")
    spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs")
    docs.where("false").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(None, 1, 1), (3, None, None), (3, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def every():
    return F.lit(True)


def op4(docs, labels):
    return toxicity.score(docs, toxicity.fit(docs, labels, every()), F.col("doc_id") % 2 == 0)


def op6(docs, labels):
    return quality_trees.score(docs, quality_trees.fit(docs, labels, every()), F.col("doc_id") % 2 == 0)


def op9(docs, labels):
    return hyper_langid.identify(docs, hyper_langid.prototypes(docs, every()), F.col("doc_id") % 2 == 0)


OPERATORS = {
    "op2": lambda d, _: gray_dedup.near_groups(d),
    "op3": lambda d, _: bpe.digests(bpe.decode(bpe.encode(d, RANKS, public_tokenizers.PATTERN, chunk=1000, overlap=100), RANKS)),
    "op4": op4,
    "op5": lambda d, _: block_simhash.fingerprint_table(d),
    "op6": op6,
    "op7": lambda d, _: adaptive_rules.apply_rules(d),
    "op8": lambda d, _: bwt_dedup.digests(bwt_dedup.without_repeats(d)),
    "op9": op9,
    "op10": lambda d, _: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_every_document(docs, labels, name):
    got = OPERATORS[name](docs, labels).toPandas()
    assert len(got) == len(rows())
    assert got.doc_id.isna().sum() == 2
    assert sorted(got.doc_id.dropna().astype(int)) == sorted(r[0] for r in rows() if r[0] is not None)


@pytest.mark.parametrize("name", OPERATORS)
def test_equal_rows_get_equal_results(docs, labels, name):
    got = OPERATORS[name](docs, labels).where("doc_id = 5").toPandas()
    per_row = {"op10": ["taken"], "op5": ["edited_sha256", "edited_fingerprint", "near_edited", "near_next"]}.get(name, [])
    assert len(got) == 3 and len(got.drop(columns=per_row).drop_duplicates()) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, labels, name):
    df = OPERATORS[name](none, labels)
    assert df.count() == 0 and "doc_id" in df.columns


def test_defined_results(docs, labels):
    near = {r.doc_id: r for r in gray_dedup.near_groups(docs).collect()}
    assert near[1].fingerprint == "0" * 16 and near[0].component_id == 0 and near[2].component_id == 0 and near[6].component_id == 5
    langs = {r.doc_id: r for r in op9(docs, labels).collect()}
    assert langs[0].lang_pred == langs[3].lang_pred == "und" and langs[0].score == 0
    rules = {r.doc_id: r for r in adaptive_rules.apply_rules(docs).collect()}
    assert rules[0].base_failed and not rules[0].kept and rules[9].n_repeat_words == rules[9].n_words == 90_000
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert mixed[0]["size"] == 0 and mixed[0].taken == 0
    cut = {r.doc_id: r for r in bwt_dedup.without_repeats(docs).collect()}
    assert cut[0].n_bytes == 0 and cut[8].kept == b"" and len(cut[4].spans) == 0 and cut[10].n_bytes == 540


def test_no_labels_and_one_class(docs, labels):
    for d in (labels.where("false"), labels.where("quality = 1")):
        assert op6(docs, d).where("score between 0 and 1").count() == len(rows())
        assert op4(docs, d).where("score between 0 and 1").count() == len(rows())


def test_a_repeated_labelled_id_is_learned_once(spark, monkeypatch):
    rows = [(k, f"text number {k}") for k in range(8)] + [(3, f"copy {k % 5}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_trees, "fit_forest", lambda x, y: seen.append(len(y)))
    quality_trees.fit(df, marks, every())
    quality_trees.fit(df, marks, every(), rows=5)
    assert seen == [8, 5]


def test_nothing_learned(docs):
    assert set(r.lang_pred for r in hyper_langid.identify(docs, {}, every()).collect()) == {"und"}


def test_stages_keep_all_columns(spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for d in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, d, str(tmp_path))
            assert got.columns == d.columns, name
            assert got.count() <= 3 * len(rows())
        assert set(corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).columns) >= {"doc_id", "ids", "n_tokens"}


# --- conversations -------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, pair_id string, chosen string, t string"


def test_preference_pairs_on_edges(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "long answer"), (1, 1, "assistant", "long answer"), (2, None, None, None), (2, 3, "assistant", None),
        (None, 0, "user", "lost"), (3, 0, "assistant", "<|end|> inside"), (4, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*t, "c", "c", "c") for t in turns], TURN)
    got = {r.pair_id: r for r in chat_pairs.preference_pairs(chat_pairs.broken_off(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    one = got[1]
    assert one.n_shared == 1 and one.prompt == "<|user|>\nhi<|end|>\n"
    assert one.chosen == "<|assistant|>\nlong answer<|end|>\n" * 2 and one.rejected == "<|assistant|>\nlong <|end|>\n" * 2
    assert len(one.chosen) == len(one.chosen_mask) and len(one.rejected) == len(one.rejected_mask)
    trained = "".join(c for c, m in zip(one.chosen, one.chosen_mask) if m == "1")
    assert trained == "long answer<|end|>\n" * 2
    assert got[2].n_shared == 2 and got[2].chosen == "" and "< |end|>" in got[3].chosen
    assert chat_pairs.preference_pairs(chat_pairs.broken_off(df.where("false"))).count() == 0


def test_turns_without_a_conversation_stay_apart(spark):
    import duckdb
    import pandas as pd

    turns = [(None, i % 2, ("user", "assistant")[i % 2], f"lost {i % 3}") for i in range(40)] + [(5, 0, "user", "q"), (5, 1, "assistant", "answer")]
    conversations = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    pairs = chat_pairs.preference_pairs(chat_pairs.broken_off(df))
    assert pairs.where("pair_id is null").count() == 40
    want = duckdb.sql(chat_pairs.SQL)
    assert sorted(map(str, (tuple(r) for r in pairs.select(*want.columns).collect()))) == sorted(map(str, want.fetchall())) and len(conversations) == 42


def test_prefix_of_unequal_lengths(spark):
    kind = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    u, a, b = ("user", "q"), ("assistant", "a"), ("assistant", "b")
    pairs = [(1, [u, a], [u]), (2, [u], [u, a]), (3, None, [u]), (4, [], []), (5, [u, a, u, a], [u, a, u, b]), (6, None, None), (7, [a], [b])]
    got = {r.pair_id: r for r in chat_pairs.preference_pairs(spark.createDataFrame(pairs, kind)).collect()}
    assert [got[k].n_shared for k in range(1, 8)] == [1, 1, 0, 0, 3, 0, 0]
    assert got[1].rejected == "" and got[1].chosen == "<|assistant|>\na<|end|>\n" and got[5].prompt.count("<|end|>") == 3
