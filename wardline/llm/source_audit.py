"""How far the sources of a language differ, over a vocabulary held in minimal acyclic transducers.

1. Terms are counted by documents; each language keeps those of at least `min_docs` of its documents.
2. The kept terms are sorted and cut into shards of SHARD terms. A shard becomes a minimal acyclic transducer: equal tails are
   one state, and the outputs along the path of a term add up to its place in the sorted vocabulary, its ordinal.
3. The texts are streamed through the transducers, which yield ordinals for kept terms and nothing for others; counts per
   language, source and ordinal are summed. Transducers of at most PASS bytes are handed to the tasks at once; a larger
   vocabulary takes several passes over the texts.
4. Shares are whole numbers (parts of 10^9). Sources are compared in blocks of ordinals and tiles of sources, so that no task
   holds a whole vocabulary or all sources. Ties go by ordinal, which is the order of the terms.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import common

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Terms of a transducer, bytes of the transducers of a pass, entries that a task counts before it hands them on.
SHARD = 1 << 16
PASS = 1 << 26
HELD = 300_000
#: Ordinals of a block and sources of a tile.
TERMS = 4096
TILE = 128
#: Letters stay (A-Z as a-z), bytes of other characters than ASCII stay, everything else is a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


class Transducer:
    """Minimal acyclic transducer of sorted distinct terms: term -> place in the sorted list."""

    def __init__(self, key: np.ndarray, target: np.ndarray, output: np.ndarray, final: np.ndarray):
        self.key, self.target, self.output, self.final = key, target, output, final

    @classmethod
    def of(cls, words: list[bytes]) -> Transducer:
        """Words come in order; whenever a branch can no longer grow, its states are replaced by equal ones met before."""
        known: dict[tuple, int] = {}
        made: list[tuple] = []

        def settled(node: list) -> int:
            key = (node[0], tuple(node[1]))
            at = known.setdefault(key, len(made))
            if at == len(made):
                made.append(key)
            return at

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                node = open_.pop()
                arcs = open_[-1][1]
                arcs[-1] = (arcs[-1][0], settled(node))

        open_: list[list] = [[False, []]]
        for before, word in pairwise([b"", *words]):
            shared = next((k for k, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
            close(shared)
            for byte in word[shared:]:
                open_[-1][1].append((byte, -1))
                open_.append([False, []])
            open_[-1][0] = True
        close(0)
        settled(open_[0])  # the root is the last state
        below = np.zeros(len(made), np.int64)
        key, target, output = [], [], []
        for state, (final, arcs) in enumerate(made):
            n = int(final)
            for byte, to in arcs:
                key.append(state << 8 | byte), target.append(to), output.append(n)
                n += int(below[to])
            below[state] = n
        return cls(np.array(key, np.int64), np.array(target, np.int32), np.array(output, np.int32), np.array([m[0] for m in made], bool))

    def dump(self) -> dict[str, bytes]:
        return {n: getattr(self, n).tobytes() for n in ("key", "target", "output", "final")}

    @classmethod
    def load(cls, key: bytes, target: bytes, output: bytes, final: bytes) -> Transducer:
        return cls(np.frombuffer(key, np.int64), np.frombuffer(target, np.int32), np.frombuffer(output, np.int32), np.frombuffer(final, bool))

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """Place of every word, -1 for others. All words take their k-th step together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.key):
            return out
        data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        state, total, live, k = np.full(len(words), len(self.final) - 1, np.int64), np.zeros(len(words), np.int64), np.arange(len(words)), 0
        while len(live):
            ended = size[live] == k
            last = live[ended]
            out[last] = np.where(self.final[state[last]], total[last], -1)
            live = live[~ended]
            key = state[live] << 8 | data[start[live] + k]
            at = np.searchsorted(self.key, key).clip(max=len(self.key) - 1)
            hit = self.key[at] == key
            live, at = live[hit], at[hit]
            state[live], total[live], k = self.target[at], total[live] + self.output[at], k + 1
        return out


def plain(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, text) without nulls."""
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def document_counts(rows: DataFrame) -> DataFrame:
    """(lang, term, n): the documents of a language that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in common.slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), common.as_bytes(b.column(1))):
                held.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, held.values())) > HELD:
                yield handed(held)
                held = {}
        yield handed(held)

    def handed(held: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in held.items() for _ in c]
        found = [t for c in held.values() for t in c]
        n = [x for c in held.values() for x in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "term", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, base, n, terms, key, target, output, final): the transducers of the kept terms; `base` is a shard's first ordinal."""
    kept = common.stored(document_counts(rows).where(F.col("n") >= min_docs).select("lang", "term"), "audit-terms")
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), *((c, pa.binary()) for c in ("key", "target", "output", "final"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = None, []
        for b in common.slices(batches, 4096):
            for now, term in zip(*(c.to_pylist() for c in b.columns)):
                if held and (now != lang or len(held) == SHARD):
                    yield shard(lang, held)
                    held = []
                lang = now
                held.append(term)
        if held:
            yield shard(lang, held)

    def shard(lang: str, held: list[str]) -> pa.RecordBatch:
        made = Transducer.of([t.encode() for t in held]).dump()
        return pa.RecordBatch.from_pylist([{"lang": lang, "n": len(held), "terms": held, **made}], schema)

    shards = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, "lang string, n long, terms array<string>, key binary, target binary, output binary, final binary")
    shards = common.stored(shards, "audit-shards")
    first = F.element_at("terms", 1)
    # As many rows as shards: 65,536 terms each.
    starts = shards.select("lang", "n", first.alias("first")).withColumn("base", F.sum("n").over(Window.partitionBy("lang").orderBy("first")) - F.col("n"))
    return shards.withColumn("first", first).join(starts.drop("n"), ["lang", "first"])


def passes(shards: DataFrame, size: int) -> Iterator[list]:
    """Transducers in groups of about `size` bytes, one group on the driver at a time."""
    weight = F.sum(F.length("key") + F.length("target") + F.length("output") + F.length("final"))
    numbers = shards.groupBy("lang", "first").agg(weight.alias("bytes")).orderBy("lang", "first").toLocalIterator()
    group, held = [], 0
    for s in numbers:
        if group and held + s["bytes"] > size:
            yield group
            group, held = [], 0
        group.append((s["lang"], s["first"]))
        held += s["bytes"]
    if group:
        yield group


def recounted(rows: DataFrame, shards: DataFrame, size: int = PASS) -> DataFrame:
    """(lang, source, ord, n): occurrences of the kept terms, by streaming the texts through the transducers."""
    spark, found = rows.sparkSession, []
    for names in passes(shards, size):
        wanted = F.broadcast(spark.createDataFrame(names, "lang string, first string"))
        loaded = shards.join(wanted, ["lang", "first"]).select("lang", "first", "base", "key", "target", "output", "final").collect()
        found.append(streamed(rows, spark.sparkContext.broadcast([tuple(r) for r in loaded])))
    if not found:
        return spark.createDataFrame([], "lang string, source string, ord long, n long")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.select("lang", "source", F.explode(F.arrays_zip("ord", "n")).alias("x")).select("lang", "source", "x.ord", "x.n")
    return every.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def streamed(rows: DataFrame, loaded) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        for lang, first, base, *parts in sorted(loaded.value, key=lambda r: (r[0], r[1].encode())):
            by_lang.setdefault(lang, []).append((first.encode(), base, Transducer.load(*map(bytes, parts))))
        held: dict[tuple, Counter] = {}
        for b in common.slices(batches):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.as_bytes(b.column(2))):
                if lang in by_lang:
                    held.setdefault((lang, source), Counter()).update(terms(text))
            if sum(map(len, held.values())) > HELD:
                yield from handed(held, by_lang)
                held = {}
        yield from handed(held, by_lang)

    def handed(held: dict[tuple, Counter], by_lang: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for (lang, source), counter in held.items():
            first = [s[0] for s in by_lang[lang]]
            dealt: dict[int, list[bytes]] = {}
            for term in counter:
                dealt.setdefault(bisect_right(first, term) - 1, []).append(term)
            for k, words in dealt.items():
                if k >= 0:
                    _, base, machine = by_lang[lang][k]
                    place = machine.ordinals(words)
                    known = np.flatnonzero(place >= 0)
                    n = np.array([counter[words[i]] for i in known.tolist()], np.int64)
                    lists = [pa.array([x], pa.list_(pa.int64())) for x in (place[known] + base, n)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), *lists], ["lang", "source", "ord", "n"])

    return rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ord array<long>, n array<long>")


# --- shares ------------------------------------------------------------------------------------


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for any counts; null where nothing is kept."""
    top = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(19,0))"
    return F.expr(f"1 + ({top}) DIV CAST(nullif({total} + 2 * {kept}, 0) AS DECIMAL(19,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def tile_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of the differences between the sources of two tiles over the terms of one block.

    Rows with ord -1 give a source's share of an absent term; every source of the tiles has one."""
    marks = frame[frame.ord < 0].drop_duplicates("src").sort_values("src")
    src, lo, hi = marks.src.to_numpy(), int(frame.lo.iloc[0]), int(frame.hi.iloc[0])
    shares = np.repeat(marks.p.to_numpy(np.int64)[:, None], int(frame.width.iloc[0]), axis=1)
    rest = frame[frame.ord >= 0]
    shares[np.searchsorted(src, rest.src), rest.ord.to_numpy() % TERMS] = rest.p.to_numpy(np.int64)
    tile, out = src // TILE, []
    for k in np.flatnonzero(tile == lo):
        others = np.flatnonzero((tile == hi) & (src > src[k]))
        for at in range(0, len(others), 32):
            part = others[at : at + 32]
            gap, both = shares[part] - shares[k], shares[part] + shares[k]
            value = (gap * gap // np.maximum(both, 1)).sum(axis=1)
            out.append(pd.DataFrame({"lang": frame.lang.iloc[0], "a": src[k], "b": src[part], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=str), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "value": pd.Series(dtype="int64")})


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for sources a < b by number; groups: (lang, source, src, total, kept, tiles)."""
    block = F.floor(F.col("ord") / TERMS).cast("long")
    last = F.greatest(F.ceil(F.col("kept") / TERMS) - 1, F.lit(0)).cast("long")
    marks = groups.select("lang", "src", "kept", "tiles", F.lit(-1).cast("long").alias("ord"), F.coalesce(share("0", "total", "kept"), F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    seen = counts.join(groups.drop("all_total"), ["lang", "source"]).select("lang", "src", "kept", "tiles", "ord", share("n", "total", "kept").alias("p"), block.alias("block"))
    tile = F.floor(F.col("src") / TILE).cast("long")
    rows = marks.unionByName(seen).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", "block", F.least(tile, "other").alias("lo"), F.greatest(tile, "other").alias("hi"), "src", "ord", "p", F.least(F.lit(TERMS), F.col("kept") - F.col("block") * TERMS).alias("width"))
    sums = rows.groupBy("lang", "block", "lo", "hi").applyInPandas(tile_sums, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, pass_bytes: int = PASS) -> DataFrame:
    """(lang, source, part, item, value, rank): every source against the others of its language and against the language.

    Part `pair`: item is another source of the language and value the sum of the differences over all kept terms. Part
    `term`: the `top` terms that the source uses more than its language does, by difference.
    Null texts, languages and sources count as ''; repeated rows are documents of their own; a source without terms, and a
    language that keeps none, have their pairs (value 0 if nothing is kept); ties go by the order of the items; texts are
    read whole; other columns are ignored; an empty table gives no rows. The sums are as exact as 64-bit numbers of counts.
    """
    rows = plain(docs, text_col, lang_col, source_col)
    shards = common.stored(vocabulary(rows, min_docs), "audit-vocabulary")
    counts = common.stored(recounted(rows, shards, pass_bytes), "audit-counts")
    kept = shards.groupBy("lang").agg(F.sum("n").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "kept"])
    numbered = groups.withColumn("src", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    all_of = totals.groupBy("lang").agg(F.sum("total").alias("all_total"))
    groups = common.stored(numbered.join(tiles, "lang").join(all_of, "lang", "left"), "audit-groups")
    names = groups.select("lang", "src", "source")

    sums = common.stored(pair_sums(counts, groups), "audit-pairs")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = both.join(names.withColumnRenamed("src", "a"), ["lang", "a"]).join(names.select("lang", F.col("src").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    whole = counts.groupBy("lang", "ord").agg(F.sum("n").alias("all_n"))
    shares = counts.join(whole, ["lang", "ord"]).join(groups.drop("src", "tiles"), ["lang", "source"])
    shares = shares.select("lang", "source", "ord", share("n", "total", "kept").alias("p"), share("all_n", "all_total", "kept").alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    best = shares.withColumn("value", apart("p", "q")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = shards.select("lang", "base", F.posexplode("terms").alias("at", "item")).select("lang", (F.col("base") + F.col("at")).alias("ord"), "item")
    best = best.join(words, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
t AS (SELECT rid, lang, source, unnest(found) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT rid, lang, term FROM t) GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(total.total, 0) + 2 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN total USING (lang, source)),
q AS (
  SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v.v)) AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
more AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM more)
WHERE rank <= {TOP}
"""
