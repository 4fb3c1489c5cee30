r"""Spelling variants: words one code point apart, found in bidirectional FM-indexes of the vocabulary.

1. Runs of letters are counted as words; the ones that occur often enough are the vocabulary.
2. Two words one error apart share a half of the shorter one: what comes before the error, or what comes after it. Words are
   dealt by the halves they may share (their length and one less, either half), so each pair meets where its shared half is.
   The pair belongs to the left or the right half by its longest common beginning, so it is found once from each side. Halves
   that too many words share are cut again: the rest is halved, and so on until one place is left.
3. Groups are packed into buckets of bounded size. A bucket's words lie in one text between delimiters; the index keeps the
   transforms of that text and of its mirror image, with one interval in each. A search matches the shared half exactly from
   the word's end, and goes on across the rest allowing one error; the interval of a whole word between delimiters is its
   rank among the suffixes that begin with a delimiter, which is its place in the sorted vocabulary. All searches of a bucket
   take their steps together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

RUN = "A-Za-zÀ-ÿ"
LEAST = 7
MIN_COUNT = 2
RATIO = 10
SLIP = 31
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words a task counts before it hands them on; symbols of a bucket; symbols of the words of one key before it is cut again.
HELD = 300_000
BUCKET = 1 << 17
CROWDED = 1 << 19
#: Searches that step together, places between two stored rows of counts, and bytes of those rows.
TOGETHER = 4096
STEP = 8
TABLE = 1 << 26


def runs_of(doc_id: int | None, text: str, least: int, slip: int) -> Iterator[str]:
    """Lower-cased runs of at least `least` letters after the slips: a run whose checksum with the id is divisible by `slip` loses a letter."""
    id_part = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    known: dict[str, str] = {}
    for run in re.findall(f"[{RUN}]{{{least},}}", text.encode().translate(LOWERED).decode()):
        if (word := known.get(run)) is None:
            h = zlib.crc32(run.encode(), id_part)
            at = h % len(run)
            word = known[run] = run[:at] + run[at + 1 :] if h % slip == 0 else run
        if len(word) >= least:
            yield word


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): the vocabulary with its numbers of occurrences over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in common.slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), common.as_texts(b.column(1))):
                held.update(runs_of(doc_id, text, least, slip))
                if len(held) > HELD:
                    yield handed(held)
                    held = Counter()
        yield handed(held)

    def handed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- index ---------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling the compared length; the end counts as smallest."""
    n, rank = len(text), text.astype(np.int64) + 1
    for width in (1, 2):  # four symbols as one number; symbols are below 255
        pair = rank << (8 * width)
        pair[:-width] |= rank[width:]
        rank = pair
    width = 4
    while True:
        order = np.argsort(rank, kind="stable")
        sorted_ = rank[order]
        name = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        if name[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = name
        after = np.zeros(n, np.int64)
        if width < n:
            after[:-width] = rank[width:] + 1
        rank = rank * (n + 1) + after
        width *= 2


class Transform:
    """Burrows-Wheeler transform of a text with counts of smaller symbols before any place."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        order = suffix_order(text)
        last = text[order - 1]
        self.step = max(STEP, -(-n * (symbols + 1) * 4 // TABLE))
        pad = -(-(n + 1) // self.step) * self.step
        self.rows = np.full(pad, 255, np.uint8)
        self.rows[:n] = last
        self.rows = self.rows.reshape(-1, self.step)
        cell = (np.arange(n) // self.step + 1) * (symbols + 1) + last + 1
        hist = np.bincount(cell, minlength=(len(self.rows) + 1) * (symbols + 1)).astype(np.int32).reshape(-1, symbols + 1)
        self.table = np.cumsum(np.cumsum(hist, axis=0, dtype=np.int32), axis=1, dtype=np.int32)
        self.first = self.table[-1]
        self.places = np.arange(self.step)

    def smaller(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Symbols below `symbol` before the place `at`."""
        row, rest = np.divmod(at, self.step)
        inside = (self.rows[row] < symbol[:, None]) & (self.places < rest[:, None])
        return self.table[row, symbol] + inside.sum(axis=1)

    def all_smaller(self, at: np.ndarray) -> np.ndarray:
        """The same for every symbol and the one after the last: a column each."""
        row, rest = np.divmod(at, self.step)
        out, window = self.table[row].copy(), self.rows[row]
        symbols = np.arange(out.shape[1], dtype=np.uint8)
        for k in range(self.step):
            out += (window[:, k, None] < symbols) & (rest > k)[:, None]
        return out


class Index:
    """Bidirectional FM-index of sorted distinct words, each between delimiters (symbol 0)."""

    def __init__(self, words_: list[str]):
        self.size = np.array([len(w) for w in words_], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size
        points = np.frombuffer("".join(words_).encode("utf-32-le"), np.uint32)
        alphabet, code = np.unique(points, return_inverse=True)
        self.symbols = len(alphabet) + 1
        self.text = np.zeros(int((self.size + 1).sum()) + 1, np.uint8)
        filled = np.ones(len(self.text), bool)
        filled[np.r_[self.start - 1, len(self.text) - 1]] = False
        self.text[filled] = code + 1
        self.forward, self.mirrored = Transform(self.text, self.symbols), Transform(self.text[::-1].copy(), self.symbols)

    def letter(self, word: np.ndarray, at: np.ndarray, leftward: bool) -> np.ndarray:
        """The letter after `at` letters, read from the side where the search begins; 0 behind the last."""
        place = self.start[word] + (self.size[word] - 1 - at if leftward else at)
        return self.text[place].astype(np.int64)  # the text has a delimiter on both sides of a word

    def search(self, word: np.ndarray, exact: np.ndarray, longer: np.ndarray, leftward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, found word, letters matched before the error): all words one error away beyond `exact` letters.

        `longer` searches look for words with a letter less (kind 2), the others for one replaced (0) or one more (1). The
        letter after the error differs, so every word is found once."""
        own, other_first = (self.forward if leftward else self.mirrored), len(self.size) + 1
        n = len(word)
        which, at, kind, fault = np.arange(n), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        lo, other, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, other_first)
        out: list[tuple] = []
        while len(which):
            w, c = word[which], self.letter(word[which], at, leftward)
            ended = (kind >= 0) & (at == self.size[w])
            open_ = np.flatnonzero((kind < 0) & (at >= exact[which]))
            more = []
            less = open_[longer[which[open_]] & (at[open_] < self.size[w[open_]])]
            less = less[self.letter(w[less], at[less] + 1, leftward) != c[less]]
            more.append((which[less], at[less] + 1, np.full(len(less), 2), at[less], lo[less], other[less], size[less]))
            open_ = open_[~longer[which[open_]]]
            if len(open_):
                low, high = own.all_smaller(lo[open_]), own.all_smaller(lo[open_] + size[open_])
                inside = high - low
                counts = np.diff(inside, axis=1)
                counts[:, 0] = 0
                here = c[open_]
                counts[np.arange(len(open_)), here] = 0
                who, s = np.nonzero(counts)
                k = open_[who]
                step = (own.first[s] + low[who, s + 1] - low[who, s], other[k] + inside[who, s], counts[who, s])
                step = tuple(x.astype(np.int64) for x in step)
                swap = at[k] < self.size[w[k]]
                more.append((which[k[swap]], at[k[swap]] + 1, np.zeros(int(swap.sum()), np.int64), at[k[swap]], *(x[swap] for x in step)))
                more.append((which[k], at[k], np.ones(len(k), np.int64), at[k], *step))
            # On with the own letter; words without an error are not followed beyond their end.
            go = np.flatnonzero(ended | (at < self.size[w]))
            low0, low1 = own.smaller(lo[go], c[go]), own.smaller(lo[go], c[go] + 1)
            high0, high1 = own.smaller(lo[go] + size[go], c[go]), own.smaller(lo[go] + size[go], c[go] + 1)
            left = (high1 - high0) - (low1 - low0)
            alive = left > 0
            lo_, other_ = own.first[c[go]] + low1 - low0, other[go] + high0 - low0
            done = alive & ended[go]
            g = go[done]
            rank = lo_[done] if leftward else other_[done]
            out.append((which[g], rank - 1, fault[g]))
            keep = alive & ~ended[go]
            g = go[keep]
            more.append((which[g], at[g] + 1, kind[g], fault[g], lo_[keep], other_[keep], left[keep]))
            which, at, kind, fault, lo, other, size = (np.concatenate(x) for x in zip(*more))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def near_words(index: Index, word: np.ndarray, length: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, near word) for searches of `word` in pairs whose shorter word has `length` letters and whose common beginning has
    `begin` up to `end` - 1 letters (up to `end` if that is all). The longer of the two exact ends is matched first."""
    left = length - end > begin
    pairs = []
    for leftward in (False, True):
        mine = np.flatnonzero(left == leftward)
        for at in range(0, len(mine), TOGETHER):
            rows = mine[at : at + TOGETHER]
            exact = length[rows] - end[rows] if leftward else begin[rows]
            k, found, fault = index.search(word[rows], exact, index.size[word[rows]] > length[rows], leftward)
            rows = rows[k]
            common_ = beginnings(index, word[rows], found) if leftward else fault
            ok = (common_ >= begin[rows]) & ((common_ < end[rows]) | (end[rows] == length[rows]))
            pairs.append((word[rows[ok]], found[ok]))
    return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2


def beginnings(index: Index, word: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Letters that two words share from their beginning, compared together."""
    at, live = np.zeros(len(word), np.int64), np.arange(len(word))
    while len(live):
        a, b = index.text[index.start[word[live]] + at[live]], index.text[index.start[found[live]] + at[live]]
        live = live[(a == b) & (a > 0)]
        at[live] += 1
    return at


# --- dealing -------------------------------------------------------------------------------------


def keyed(rows: DataFrame) -> DataFrame:
    """With the key of the halves: length of the shorter word, where the error may be, and the letters around that."""
    after = F.expr("substring(word, -(length - end), length - end)")
    return rows.withColumn("key", F.xxhash64("length", "begin", "end", F.expr("substring(word, 1, begin)"), F.when(F.col("length") > F.col("end"), after)))


def cut_again(rows: DataFrame, begin: str = "begin", end: str = "end") -> DataFrame:
    """The places where the error may be as two halves, keyed anew."""
    lo, hi = F.expr(begin), F.expr(end)
    middle = F.floor((lo + hi) / 2).cast("int")
    zones = F.array(F.struct(lo.cast("int").alias("begin"), middle.alias("end")), F.struct(middle.alias("begin"), hi.cast("int").alias("end")))
    return keyed(rows.select("word", "n", "length", F.explode(zones).alias("z")).select("word", "n", "length", "z.begin", "z.end"))


def halves(vocabulary: DataFrame) -> DataFrame:
    """(word, n, length, begin, end, key): each word as the shorter and as the longer one of a pair, with either half shared."""
    size = F.length("word")
    rows = vocabulary.withColumn("length", F.explode(F.array(size, size - 1))).where("length >= 1")
    return cut_again(rows, "0", "length")


def dealt(vocabulary: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The rows of `halves`, those of crowded keys cut again until the keys are small or the error has one place left."""
    rows, done = halves(vocabulary), []
    while True:
        heavy = rows.groupBy("key").agg(F.sum(F.length("word") + 1).alias("symbols"), F.min(F.col("end") - F.col("begin")).alias("width"))
        heavy = common.checkpointed(heavy.where((F.col("symbols") > crowded) & (F.col("width") > 1)).select("key"))
        if heavy.isEmpty():
            break
        done.append(rows.join(heavy, "key", "left_anti"))
        rows = common.stored(cut_again(rows.join(heavy, "key", "left_semi")), "spelling-halves")
    for d in done:
        rows = rows.unionByName(d)
    return rows


def neighbours(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, n_near, form_n, form) by bucket: how many near words a word has there, and the most frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols, last = 0, None
        for b in common.slices(batches, 4096):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if symbols >= bucket and row[0] != last:
                    yield found(held)
                    held, symbols = [], 0
                held.append(row)
                symbols, last = symbols + len(row[1]) + 1, row[0]
        if held:
            yield found(held)

    def found(held: list[tuple]) -> pa.RecordBatch:
        count = {word: n for _, word, n, *_ in held}
        every = sorted(count)
        at = {w: k for k, w in enumerate(every)}
        n = np.array([count[w] for w in every], np.int64)
        columns = np.array([r[3:] for r in held], np.int64).T
        word, near = near_words(Index(every), np.array([at[r[1]] for r in held], np.int64), *columns)
        order = np.lexsort((near, -n[near], word))
        word, near = word[order], near[order]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(word)), bool), word[1:] != word[:-1]])
        times = np.diff(np.r_[first, len(word)])
        text = lambda k: pa.array([every[i] for i in k.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([text(word[first]), pa.array(times, pa.int64()), pa.array(n[near[first]]), text(near[first])], ["word", "n_near", "form_n", "form"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("key", "word", "n", "length", "begin", "end").repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "word string, n_near long, form_n long, form string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), following forms to the last. A form is RATIO times as frequent, so chains are short and
    their followed part doubles each round; a word has a bounded number of near words, so no form is a hot key."""
    now = common.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_count: int = MIN_COUNT, slip: int = SLIP, ratio: int = RATIO, bucket: int = BUCKET, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the vocabulary with the frequent word that it may be a variant of.

    Null texts have no words and a null id counts as no characters in the checksum; repeated rows count again; texts and words
    are taken whole; of near words equally frequent the smallest in code-point order is the form; other columns are ignored;
    an empty table gives no rows.
    """
    vocabulary = common.stored(words(docs, id_col, text_col, least, min_count, slip), "spelling-words")
    near = neighbours(dealt(vocabulary, crowded), bucket).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))
    both = vocabulary.join(near, "word", "left")
    frequent = -F.col("best.m") >= ratio * F.col("n")
    pick = lambda c: F.when(frequent, c)
    both = common.stored(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), pick(F.col("best.form")).alias("form"), pick(-F.col("best.m")).alias("form_n")), "spelling-forms")
    return both.join(roots(both.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
  FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM r WHERE length(run) >= {LEAST} GROUP BY doc_id, run),
b AS (SELECT run, n, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM c),
s AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) AS h FROM b, crc),
k AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM s),
w AS (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM x),
less AS (SELECT DISTINCT word, n, a || z AS short FROM cut),
near AS (
  SELECT p.word, q.word AS other, q.n AS m FROM cut AS p JOIN cut AS q ON p.i = q.i AND p.a = q.a AND p.z = q.z AND p.word <> q.word
  UNION ALL SELECT less.word, w.word, w.n FROM less JOIN w ON w.word = less.short
  UNION ALL SELECT w.word, less.word, less.n FROM less JOIN w ON w.word = less.short),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, other := other)) AS b FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN -b.m >= {RATIO} * w.n THEN -b.m END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f
LEFT JOIN (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word) AS l USING (word)
"""
