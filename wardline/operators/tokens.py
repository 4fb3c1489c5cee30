"""Token-level analysis: context windows, similarity to a reference corpus, semantic shifts.

One row per prompt in, one row per prompt out; tokens stay arrays of their row
until a caller explodes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import geometry as geo
from wardline.functions import severity as sv
from wardline.functions import spans as sp
from wardline.functions import text as tx
from wardline.functions import vectors as vx
from wardline.operators import nearest as nr
from wardline.operators.rows import fenced, inline_rows, position_rows
from wardline.session import checkpointed


@dataclass(frozen=True)
class TokenParams:
    """Fixed defaults of the analysis; all can be changed per call."""

    max_tokens: int | None = None
    radius: int = 5
    context_radius: int = 2
    shift_radius: int = 5
    shift_threshold: float = 0.7
    window: int = 5
    stride: int = 1
    anomaly_cut: float = 0.6
    embedder: vx.Embedder = vx.HASHED


def with_tokens(df: DataFrame, text_col: str = "text", max_tokens: int | None = None, embedder: vx.Embedder = vx.HASHED) -> DataFrame:
    """Add `tokens` and `buckets`, what the embedder gives per token (bucket numbers, or vectors if it is dense)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return fenced(df.withColumn("tokens", tx.tokenize(text, max_tokens)), {"buckets": geo.embedded(embedder, F.col("tokens"))})


def token_context(df: DataFrame, id_col: str, radius: int = 2) -> DataFrame:
    """Long table of tokens with their neighbours."""
    tokens = F.col("tokens")
    rows = F.transform(
        tokens, lambda t, i: F.struct(i.cast("long").alias("pos"), t.alias("token"), vx.window_at(tokens, i, radius).alias("ctx"))
    )
    return inline_rows(df, [id_col], rows, "pos")


def context_window_embedding(df: DataFrame, id_col: str, radius: int = 5) -> DataFrame:
    """Long table (id, pos, span): the bucket multiset that embeds each token's window, sorted."""
    spans = F.transform(sp.context_spans(F.col("buckets"), radius), lambda s: F.array_sort(s))
    return position_rows(df, [id_col], spans, "span")


def build_reference(df: DataFrame, id_col: str, radius: int = 5) -> DataFrame:
    """Distinct token windows of known-good prompts with the number of times each occurs."""
    spans = context_window_embedding(df, id_col, radius)
    return spans.groupBy("span").agg(F.count("*").alias("copies"))


def text_reference(df: DataFrame, id_col: str, embedder: vx.Embedder = vx.HASHED) -> DataFrame:
    """Whole texts as reference vectors: (ref, copies) and `span` for buckets, `vector` for a dense embedder."""
    ref = F.col(id_col).cast("string").alias("ref")
    if embedder.dense:
        return df.select(ref, embedder.sum_of_tokens(F.col("buckets")).alias("vector"), F.lit(1).alias("copies"))
    return df.select(ref, F.array_sort("buckets").alias("span"), F.lit(1).alias("copies"))


@dataclass
class Reference:
    """What a search needs of the reference vectors: their number, the sums of their unit vectors and of the products of their
    components, and the vectors themselves, in blocks if they are few enough to be handed to every task. Built once for any
    number of searches."""

    embedder: vx.Embedder
    weight: float
    total: np.ndarray
    second: np.ndarray
    blocks: nr.Blocks | None
    vectors: DataFrame


def prepared(reference: DataFrame | Reference, embedder: vx.Embedder = vx.HASHED, handed: int = nr.HANDED) -> Reference:
    """The reference vectors as (ref, v, copies), spans packed as counts; spans name themselves where there is no `ref`."""
    if isinstance(reference, Reference):
        return reference
    named = reference if "ref" in reference.columns else reference.withColumn("ref", F.array_join(F.col("span").cast("array<string>"), " "))
    given = fenced(named.select("ref", "copies", *(["vector"] if embedder.dense else ["span"])), {"_v": F.col("vector" if embedder.dense else "span")})
    vector = nr.packed(F.col("_v")) if embedder.dense else nr.packed_counts(F.col("_v"), embedder.dims)
    vectors = given.select("ref", vector.alias("v"), F.col("copies").cast("double").alias("copies"))
    few = nr.handed(vectors, embedder.dims, handed)
    if few is None:
        vectors = checkpointed(vectors)
        return Reference(embedder, *_sums(vectors, embedder.dims), None, vectors)
    if not few:
        return Reference(embedder, 0.0, np.zeros(0), np.zeros(0), None, vectors)
    rows, w = np.stack([nr.one_vector(bytes(r.v))[0] for r in few]), np.array([r.copies for r in few])
    u = nr.unit(rows)
    return Reference(embedder, w.sum(), w @ u, (u * w[:, None]).T @ u, nr.Blocks(rows, [r.ref for r in few]), vectors)


def _sums(vectors: DataFrame, dims: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of references, sum of their unit vectors and of the products of their components: dims squared numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(1 + dims + dims * dims)
        for b in batches:
            if len(b):
                u, w = nr.unit(np.stack([nr.one_vector(bytes(v))[0] for v in b["v"]])), b["copies"].to_numpy()
                out += np.r_[w.sum(), w @ u, ((u * w[:, None]).T @ u).ravel()]
        yield pd.DataFrame({"i": np.arange(len(out)), "x": out})

    total = vectors.select("v", "copies").mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(1 + dims + dims * dims)
    for r in total:
        flat[r.i] = r.x
    return flat[0], flat[1 : dims + 1], flat[dims + 1 :].reshape(dims, dims)


SIMILARITIES = "hi:array<double>,lo:array<double>,mean:array<double>,std:array<double>"


def _spread(windows: np.ndarray, total: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, square = geo.average_cosines(windows, total, second)
    return mean, np.sqrt(np.maximum(square - mean * mean, 0.0))


def similarity_numbers(blocks: nr.Blocks, space: geo.TokenSpace, windows: np.ndarray, total: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Largest, smallest and mean cosine and deviation, a row each; equal windows are searched once."""
    kinds, of = windows, None
    if not space.dense and len(windows):
        plain = np.ascontiguousarray(windows.astype(np.uint8 if windows.max() < 256 else np.int64))
        _, first, of = np.unique(plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel(), return_index=True, return_inverse=True)
        kinds = windows[first]
    out = np.stack([*blocks.extremes(kinds), *_spread(kinds, total, second)])
    return out if of is None else out[:, of]


#: Different windows that bucket numbers and radius allow, up to which a task keeps the numbers of those it has met.
KINDS = 1 << 19


class WindowNumbers:
    """`similarity_numbers` of the windows of bucket numbers, kept: each of the few possible windows is searched once in a task."""

    def __init__(self, space: geo.TokenSpace, radius: int, search: Callable[[np.ndarray], np.ndarray]):
        self.base, self.size, self.radius, self.search = space.dims + 1, 2 * radius + 1, radius, search
        self.numbers = np.full((4, self.base**self.size), np.nan)

    @staticmethod
    def few(space: geo.TokenSpace, radius: int) -> bool:
        return not space.dense and (space.dims + 1) ** (2 * radius + 1) <= KINDS

    def __call__(self, cells: list[np.ndarray]) -> np.ndarray:
        """Numbers of all windows of these texts, end to end."""
        flat, sizes, starts = geo.ends_of(cells)
        at, lo, hi = np.arange(len(flat)), np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        held = np.full((len(flat), self.size), self.base - 1)
        for k in range(self.size):
            near = at + k - self.radius
            inside = (near >= lo) & (near < hi)
            held[inside, k] = flat[near[inside]]
        held.sort(axis=1)
        key = held @ self.base ** np.arange(self.size)
        first = np.unique(key[np.isnan(self.numbers[0, key])])
        for part in range(0, len(first), geo.STEP):
            kinds = first[part : part + geo.STEP]
            windows = np.zeros((len(kinds), self.base))
            for k in range(self.size):
                windows[np.arange(len(kinds)), kinds // self.base**k % self.base] += 1
            self.numbers[:, kinds] = self.search(np.ascontiguousarray(windows[:, :-1]))
        return self.numbers[:, key]


def _windows(space: geo.TokenSpace, cells: list[np.ndarray], radius: int) -> Iterator[np.ndarray]:
    """The windows of a pack of short texts at once, those of one text in steps."""
    if len(cells) > 1:
        flat, sizes, _ = geo.ends_of(cells)
        yield space.around_each(flat, sizes, radius, radius)
        return
    for at in range(0, len(cells[0]), geo.STEP):
        yield space.around(cells[0], at, min(len(cells[0]), at + geo.STEP), radius, radius)


def similarity_udf(known: Reference, radius: int):
    """Token vectors of a text -> largest, smallest, mean and deviation of the cosines with all references, in one pass. The
    windows of many texts are searched together, long texts in steps; where few windows are possible, each once in a task."""
    blocks, space = known.blocks, geo.space_of(known.embedder)
    total, second = known.total / known.weight, known.second / known.weight

    def search(windows: np.ndarray) -> np.ndarray:
        return similarity_numbers(blocks, space, windows, total, second)

    def numbers(cells: list[np.ndarray]) -> np.ndarray:
        found, held, n = [np.zeros((4, 0))], [], 0
        for pack in geo.text_packs(space, cells):
            for windows in _windows(space, pack, radius):
                held.append(windows)
                n += len(windows)
                if n >= geo.STEP:
                    found.append(search(np.concatenate(held)))
                    held, n = [], 0
        if held:
            found.append(search(np.concatenate(held)))
        return np.concatenate(found, axis=1)

    kept: list[WindowNumbers] = []  # of the task: the function comes to each task anew

    @F.arrow_udf(f"struct<{SIMILARITIES}>")
    def run(batch: pa.Array) -> pa.Array:
        cells = geo.cells_of(space, batch)
        if WindowNumbers.few(space, radius):
            if not kept:
                kept.append(WindowNumbers(space, radius, search))
            found = np.concatenate([np.zeros((4, 0)), *map(kept[0], geo.text_packs(space, cells))], axis=1)
        else:
            found = numbers(cells)
        ends = pa.array(np.cumsum([0, *map(len, cells)]), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(row)) for row in found], ["hi", "lo", "mean", "std"])

    return run


def with_reference_similarity(df: DataFrame, reference: DataFrame | Reference, id_col: str, radius: int = 5, embedder: vx.Embedder = vx.HASHED) -> DataFrame:
    """Add arrays max_sim, mean_sim, min_sim, std_sim: every token window against all references.

    Mean and deviation come from sums over the references (a fixed number of them), largest and smallest from an exact search
    (see `nearest`), among blocks in the same pass or, if the references are too many to be handed out, among cells and joined
    back by `id_col`, which must name the rows. Without references the arrays are .5, .5, .5 and 0.
    """
    known = prepared(reference, embedder)
    if known.weight == 0:
        fixed = {"max_sim": 0.5, "mean_sim": 0.5, "min_sim": 0.5, "std_sim": 0.0}
        return df.withColumns({c: F.transform("buckets", _constant(v)) for c, v in fixed.items()})
    if known.blocks is not None:
        return _named(df.withColumn("_s", similarity_udf(known, radius)("buckets")))
    space = geo.space_of(embedder)
    total, second, unpack = known.total / known.weight, known.second / known.weight, space.unpack(radius)
    index = nr.build_index(known.vectors, "ref", "v")
    queries = df.select(F.col(id_col).alias("row"), space.pack("buckets").alias("payload"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = nr.scores(batch, unpack, lambda c: np.stack([c.max(axis=1), c.min(axis=1)], axis=1))
            yield pd.DataFrame([(row, c[:, 0], c[:, 1]) for row, c, _ in found if len(c)], columns=["row", "hi", "lo"])

    kind = df.schema[id_col].dataType.simpleString()
    found = nr.meetings(index, queries, unpack, 1, signs=(1, -1)).mapInPandas(ends, f"row {kind}, hi array<double>, lo array<double>")
    best = lambda c, pick: F.reduce(F.collect_list(c), F.array().cast("array<double>"), lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, pick)))
    merged = found.groupBy("row").agg(best("hi", lambda a, b: F.greatest(a, b)).alias("_hi"), best("lo", lambda a, b: F.least(a, b)).alias("_lo"))

    @F.pandas_udf("struct<mean:array<double>,std:array<double>>")
    def spread(batch: pd.Series) -> pd.DataFrame:
        cells = [space.cell(b) for b in batch]
        return pd.DataFrame([_spread(space.around(c, 0, len(c), radius, radius), total, second) for c in cells], columns=["mean", "std"])

    joined = df.join(merged.withColumnRenamed("row", id_col), id_col, "left").withColumn("_t", spread("buckets"))
    none = F.array().cast("array<double>")
    both = F.struct(F.coalesce("_hi", none).alias("hi"), F.coalesce("_lo", none).alias("lo"), F.col("_t.mean").alias("mean"), F.col("_t.std").alias("std"))
    return _named(joined.withColumn("_s", both).drop("_hi", "_lo", "_t"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"max_sim": F.col("_s.hi"), "mean_sim": F.col("_s.mean"), "min_sim": F.col("_s.lo"), "std_sim": F.col("_s.std")}).drop("_s")


def _constant(value: float):
    return lambda _: F.lit(value)


def top_similar_tokens(
    df: DataFrame, reference: DataFrame | Reference, id_col: str, radius: int = 5, first: int = 1, last: int = 5, embedder: vx.Embedder = vx.HASHED,
) -> DataFrame:
    """References of rank first..last per token by cosine, ties by reference name."""
    known, space = prepared(reference, embedder), geo.space_of(embedder)
    unpack = space.unpack(radius)
    queries = df.select(F.col(id_col).alias("row"), space.pack("buckets").alias("payload"))
    kind = df.schema[id_col].dataType.simpleString()
    if known.blocks is not None:
        blocks = known.blocks

        names = pa.array([str(r) for r in blocks.ids.tolist()], pa.string())

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The windows of many texts are searched together, long texts in steps."""
            for batch in batches:
                held, n = [], 0
                for k, payload in enumerate(batch.column("payload")):
                    windows = unpack(payload.as_py())
                    for at in range(0, len(windows), geo.STEP):
                        held.append((k, at, windows[at : at + geo.STEP]))
                        n += len(held[-1][2])
                        if n >= geo.STEP:
                            yield found(batch.column("row"), held)
                            held, n = [], 0
                if n:
                    yield found(batch.column("row"), held)

        def found(ids: pa.Array, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            size = [len(w) for _, _, w in held]
            row, pos = np.repeat([k for k, _, _ in held], size), np.concatenate([np.arange(at, at + len(w)) for _, at, w in held])
            places, sims = blocks.best_places(np.concatenate([w for _, _, w in held]).astype(np.float64), last)
            n, k = sims[:, first - 1 :].shape
            columns = [ids.take(pa.array(np.repeat(row, k))), pa.array(np.repeat(pos, k)), pa.array(np.tile(np.arange(first, first + k), n)), names.take(pa.array(places[:, first - 1 :].ravel())), pa.array(sims[:, first - 1 :].ravel())]
            return pa.RecordBatch.from_arrays(columns, [id_col, "pos", "rank", "ref", "similarity"])

        return queries.mapInArrow(nearest, f"{id_col} {kind}, pos bigint, rank bigint, ref string, similarity double")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, c, ids in nr.scores(batch, unpack):
                by_name = np.argsort(np.array(ids, object), kind="stable")
                names, c = np.array(ids, object)[by_name], c[:, by_name]
                order = np.argsort(-c, axis=1, kind="stable")[:, :last]
                pos = np.repeat(np.arange(len(c)), order.shape[1])
                out.append(pd.DataFrame({id_col: row, "pos": pos, "ref": names[order].ravel(), "similarity": np.take_along_axis(c, order, axis=1).ravel()}))
            if out:
                yield pd.concat(out)

    meetings = nr.meetings(nr.build_index(known.vectors, "ref", "v"), queries, unpack, last)
    rows = meetings.mapInPandas(top, f"{id_col} {kind}, pos bigint, ref string, similarity double")
    rank = F.row_number().over(Window.partitionBy(id_col, "pos").orderBy(F.col("similarity").desc(), "ref"))
    ranked = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= last)
    return ranked.where(F.col("rank") >= first).select(id_col, "pos", "rank", "ref", "similarity")


def sentence_statistics(df: DataFrame, id_col: str, text_col: str = "text", embedder: vx.Embedder = vx.HASHED) -> DataFrame:
    """(id, consistency, sentence): mean pairwise cosine of a text's sentences and 10 x variance of their embeddings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = fenced(df.select(id_col, text.alias("_t")), {"_s": sp.sentence_units(F.col("_t"), embedder)})
    sizes = F.transform("_s", lambda s: F.size(s))
    both = geo.sentence_statistics_udf(geo.space_of(embedder))(F.flatten("_s"), sizes)
    return spans.select(id_col, both.alias("_n")).select(id_col, "_n.consistency", "_n.sentence")


def token_anomaly(max_sim: Column, std_sim: Column) -> Column:
    """Anomaly of every token: min(1, 1 - max + 0.5 std)."""
    return F.zip_with(max_sim, std_sim, lambda m, s: F.least(F.lit(1.0), 1.0 - m + 0.5 * s))


def adjacent_shifts(tokens: Column, cosines: Column, threshold: float) -> Column:
    """Neighbouring tokens whose windows are less alike than the threshold."""
    rows = F.transform(cosines, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    low = F.filter(rows, lambda r: r["c"] < threshold)
    return F.transform(
        low,
        lambda r: F.struct(
            r["i"].cast("long").alias("position"),
            F.concat_ws(" ", F.get(tokens, r["i"]), F.get(tokens, r["i"] + 1)).alias("tokens"),
            r["c"].alias("similarity"),
            (1.0 - r["c"]).alias("magnitude"),
            F.lit("adjacent_shift").alias("type"),
            sv.shift_severity(1.0 - r["c"]).alias("severity"),
        ),
    )


def window_shifts(tokens: Column, cosines: Column, window: int, threshold: float) -> Column:
    """Token runs whose mean embedding differs from that of the run `stride` tokens on."""
    scored = F.transform(cosines, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    return F.transform(
        F.filter(scored, lambda r: r["c"] < threshold),
        lambda r: F.struct(
            r["i"].cast("long").alias("position"),
            F.array_join(F.slice(tokens, r["i"] + 1, 2 * window), " ").alias("tokens"),
            r["c"].alias("similarity"),
            (1.0 - r["c"]).alias("magnitude"),
            F.lit("window_based_shift").alias("type"),
            sv.shift_severity(1.0 - r["c"]).alias("severity"),
        ),
    )


def prompt_anomaly(anomaly: Column, cut: float = 0.6) -> Column:
    """min(1, 0.7 mean + 0.3 share of anomalous tokens); 0 without tokens."""
    flagged = F.size(F.filter(anomaly, lambda a: a > cut))
    share = tx.ratio(flagged, F.size(anomaly))
    return F.least(F.lit(1.0), 0.7 * sp.mean_of(anomaly) + 0.3 * share)


def anomaly_list(tokens: Column, anomaly: Column, shifts: Column, cut: float = 0.6) -> Column:
    """Token anomalies, then shifts, as one list of (type, position, detail, score, severity)."""
    rows = F.transform(anomaly, lambda a, i: F.struct(i.alias("i"), a.alias("a")))
    hits = F.filter(rows, lambda r: r["a"] > cut)
    from_tokens = F.transform(
        hits,
        lambda r: F.struct(
            F.lit("token_anomaly").alias("type"), r["i"].cast("long").alias("position"), F.get(tokens, r["i"]).alias("detail"),
            r["a"].alias("score"), sv.anomaly_severity(r["a"]).alias("severity"),
        ),
    )
    from_shifts = F.transform(
        shifts,
        lambda s: F.struct(
            s["type"].alias("type"), s["position"].alias("position"), s["tokens"].alias("detail"),
            s["magnitude"].alias("score"), s["severity"].alias("severity"),
        ),
    )
    return F.concat(from_tokens, from_shifts)


def with_cosines(df: DataFrame, params: TokenParams) -> DataFrame:
    """Add `cosines` of neighbouring windows and `run_cosines` of token runs, from one Arrow pass."""
    both = geo.token_numbers_udf(geo.space_of(params.embedder), params.shift_radius, params.window, params.stride)(F.col("buckets"))
    return df.withColumn("_c", both).withColumns({"cosines": F.col("_c.adjacent"), "run_cosines": F.col("_c.runs")}).drop("_c")


def with_shifts(df: DataFrame, params: TokenParams) -> DataFrame:
    """Add the list of shifts from the cosines, and their numbers for callers that do not need their tokens."""
    cut = params.shift_threshold
    return df.withColumns(
        {
            "shifts": F.concat(
                adjacent_shifts(F.col("tokens"), F.col("cosines"), cut),
                window_shifts(F.col("tokens"), F.col("run_cosines"), params.window, cut),
            ),
            "shift_counts": shift_counts(F.col("cosines"), F.col("run_cosines"), cut),
        }
    )


def shift_counts(cosines: Column, run_cosines: Column, threshold: float) -> Column:
    """Shifts of a magnitude above .5, and those of token runs, counted without building the shifts."""
    strong = lambda c: (c < threshold) & (1.0 - c > 0.5)
    return F.struct(
        (F.size(F.filter(cosines, strong)) + F.size(F.filter(run_cosines, strong))).alias("strong"),
        F.size(F.filter(run_cosines, lambda c: c < threshold)).alias("windows"),
    )


def analyze_tokens(
    df: DataFrame, reference: DataFrame | Reference, id_col: str, text_col: str = "text", params: TokenParams = TokenParams()
) -> DataFrame:
    """The whole token analysis; keeps the input columns and adds arrays per prompt."""
    tokens = with_tokens(df, text_col, params.max_tokens, params.embedder)
    known = prepared(reference, params.embedder)
    if known.blocks is not None:  # both passes over the token vectors in one Arrow stage
        both = geo.token_numbers_udf(geo.space_of(params.embedder), params.shift_radius, params.window, params.stride)("buckets")
        similar = _named(tokens.withColumns({"_s": similarity_udf(known, params.radius)("buckets"), "_c": both}))
        similar = similar.withColumns({"cosines": F.col("_c.adjacent"), "run_cosines": F.col("_c.runs")}).drop("_c")
    else:
        similar = with_cosines(with_reference_similarity(tokens, known, id_col, params.radius, params.embedder), params)
    scored = with_shifts(similar, params).withColumn("anomaly", token_anomaly(F.col("max_sim"), F.col("std_sim")))
    return scored.withColumns(
        {
            "overall_anomaly": prompt_anomaly(F.col("anomaly"), params.anomaly_cut),
            "anomalies": anomaly_list(F.col("tokens"), F.col("anomaly"), F.col("shifts"), params.anomaly_cut),
        }
    )
