"""Quality rules with thresholds from mergeable quantile sketches per language and source.

A sketch is a table of counts: a measure is a whole number of thousandths, kept to six leading bits, so quantiles are right
within 1/32 and two sketches merge by adding counts. A rule's limit is the upper quartile plus some spreads of its own group,
instead of a number fixed for all; groups with few documents use the merged sketch of their language, then of all. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Measure (thousandths), whether small values fail too, and the least spread between quartiles that counts.
MEASURES = {
    "word_chars": (True, 400),
    "n_symbols": (False, 30),
    "n_dup_lines": (False, 10),
    "n_repeat_words": (False, 75),
}
SPREADS = 4
FEW = 50
BITS = 6


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the five counts per document; texts are read whole, a null text has no words.

    Windows are compared by 64-bit hashes; positions of hashes that occur twice are sorted, and each adds the words that the
    one before did not cover, so the work per text is that of a sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("lang"), F.col("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(common.WORD))
    without = lambda signs: F.length(F.translate("text", signs, ""))
    d = d.select(
        "doc_id", "lang", "source", F.filter(F.split("text", common.BLANKS), lambda w: w != "").alias("words"),
        lines.alias("lines"), without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("text") - without(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    d = d.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))).alias("h"),
    )
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = F.size("h") > F.size(F.array_distinct("h"))
    d = d.withColumn("s", F.when(twice, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("h")
    same = lambda k, step: F.coalesce(F.get("s", k)["h"] == F.get("s", k + step)["h"], F.lit(False))
    numbers = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    again = F.array_sort(F.transform(F.filter(numbers, lambda k: same(k, -1) | same(k, 1)), lambda k: F.get("s", k)["i"]))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(WINDOW))).alias("n"))
    return d.withColumn("n_repeat_words", F.aggregate(again, first, step, lambda a: a["n"])).drop("s")


def leading_bits(c: Column) -> Column:
    """The number without all but its first six bits: the sketch's cell."""
    shift = F.greatest(F.length(F.bin(c)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", c, shift), shift)


def cells(counts: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n): the sketches of all groups, summed map-side before anything is shuffled."""
    per = lambda m: F.floor(F.col(m) * 1000 / F.col("n_words"))
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), leading_bits(per(m)).alias("cell")) for m in MEASURES])
    rows = counts.where("n_words > 0").select("lang", "source", F.explode(measures).alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.cell").agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., measure, n, lo, hi): quartiles of merged sketches widened by the spreads."""
    merged = sketch.groupBy(*by, "measure", "cell").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(whole.orderBy("cell")), "all": F.sum("n").over(whole)})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("cell")))
    q = ranked.groupBy(*by, "measure").agg(F.first("all").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    least = F.create_map(*[x for m, (_, s) in MEASURES.items() for x in (F.lit(m), F.lit(s))])
    both = F.create_map(*[x for m, (b, _) in MEASURES.items() for x in (F.lit(m), F.lit(b))])
    spread = SPREADS * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")])
    return q.select(*by, "measure", "n", F.when(both[F.col("measure")], F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))


def group_limits(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with the limits of every measure, from the smallest group that has enough documents."""
    own, lang, every = limits(sketch, ["lang", "source"]), limits(sketch, ["lang"]), limits(sketch, [])
    lang = lang.select(F.col("lang").alias("lang2"), F.col("measure").alias("measure2"), F.struct("n", "lo", "hi").alias("of_lang"))
    every = every.select(F.col("measure").alias("measure3"), F.struct("n", "lo", "hi").alias("of_all"))
    g = own.select("lang", "source", "measure", F.struct("n", "lo", "hi").alias("own"))
    g = g.join(lang, g.lang.eqNullSafe(lang.lang2) & (g.measure == lang.measure2)).join(every, g.measure == every.measure3)
    used = F.when(F.col("own.n") >= FEW, F.col("own")).when(F.col("of_lang.n") >= FEW, F.col("of_lang")).otherwise(F.col("of_all"))
    g = g.withColumn("used", used)
    pick = lambda m, f: F.max(F.when(F.col("measure") == m, F.col(f"used.{f}"))).alias(f"{m}_{f}")
    return g.groupBy("lang", "source").agg(*[pick(m, f) for m in MEASURES for f in ("lo", "hi")])


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept per document.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated windows of eight. kept: not base_failed and all
    four measures within the limits of the document's language and source. Null languages and sources are groups of their
    own; null, empty and blank texts fail; repeated rows count as often as they occur; other columns are ignored; an empty
    table gives an empty table.
    """
    counts = common.stored(text_counts(docs, id_col, text_col), "rule-counts")
    g = common.checkpointed(group_limits(cells(counts)))
    g = g.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    d = counts.join(g, counts.lang.eqNullSafe(g.g_lang) & counts.source.eqNullSafe(g.g_source), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    per = lambda m: F.floor(F.col(m) * 1000 / F.col("n_words"))
    within = F.lit(True)
    for m, (both, _) in MEASURES.items():
        within &= (per(m) <= F.col(f"{m}_hi")) & (per(m) >= F.col(f"{m}_lo") if both else F.lit(True))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, False).otherwise(F.coalesce(within, F.lit(False))).alias("kept"))


def _sql_limits(by: str) -> str:
    keys, part = (by + ", ", f"PARTITION BY {by}, measure") if by else ("", "PARTITION BY measure")
    return f"""(SELECT {keys}measure, max(total) AS n, min(CASE WHEN upto >= 0.25 * total THEN cell END) AS q1, min(CASE WHEN upto >= 0.75 * total THEN cell END) AS q3
  FROM (SELECT {keys}measure, cell, sum(n) OVER ({part} ORDER BY cell) AS upto, sum(n) OVER ({part}) AS total
        FROM (SELECT {keys}measure, cell, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY {keys}measure)"""


def _sql() -> str:
    per = lambda m: f"floor({m} * 1000 / n_words)::BIGINT"
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {per(m)} AS v FROM k WHERE n_words > 0" for m in MEASURES)
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, (_, s) in MEASURES.items()) + " END"
    lim = lambda t: f"(SELECT *, q3 + {SPREADS} * greatest(q3 - q1, {least}) AS hi, q1 - {SPREADS} * greatest(q3 - q1, {least}) AS lo FROM {t})"
    picks = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {f} END) AS {m}_{f}" for m in MEASURES for f in ("lo", "hi"))
    within = " AND ".join(f"{per(m)} <= {m}_hi" + (f" AND {per(m)} >= {m}_lo" if both else "") for m, (both, _) in MEASURES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT id, sum(least({WINDOW}, coalesce(i - before, {WINDOW})))::BIGINT AS n_repeat_words FROM (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) AS before FROM r) GROUP BY id),
k AS (SELECT w.id, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON c.id = w.id),
sk AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - {BITS}, 0)::BIGINT) << greatest(length(bin(v)) - {BITS}, 0)::BIGINT AS cell, count(*) AS n FROM ({rows}) GROUP BY ALL),
own AS {lim(_sql_limits("lang, source"))}, lg AS {lim(_sql_limits("lang"))}, al AS {lim(_sql_limits(""))},
u AS (SELECT own.lang, own.source, own.measure,
      CASE WHEN own.n >= {FEW} THEN own.lo WHEN lg.n >= {FEW} THEN lg.lo ELSE al.lo END AS lo, CASE WHEN own.n >= {FEW} THEN own.hi WHEN lg.n >= {FEW} THEN lg.hi ELSE al.hi END AS hi
      FROM own JOIN lg ON own.lang IS NOT DISTINCT FROM lg.lang AND own.measure = lg.measure JOIN al ON own.measure = al.measure),
p AS (SELECT lang, source, {picks} FROM u GROUP BY lang, source),
f AS (SELECT k.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE coalesce({within}, false) END AS kept
FROM f LEFT JOIN p ON f.lang IS NOT DISTINCT FROM p.lang AND f.source IS NOT DISTINCT FROM p.source
"""


SQL = _sql()
