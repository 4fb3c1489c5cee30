"""Similarity search, embedding store look-ups and access statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.functions import vectors as vx
from wardline.operators import nearest as nr
from wardline.operators.ordering import latest_per_key, running_index
from wardline.session import checkpointed

#: Bytes of vectors that a search of single vectors hands to every task; bounds leave little out where vectors have no clusters.
FEW = 1 << 24
#: Queries compared with a block at once, groups that bound their k-th best, pairs of a query up to which each is scored by itself.
TOGETHER, GROUPS, SINGLY = 64, 256, 512
HITS = "query_id bigint, corpus_id bigint, similarity double"


def keep_best(hits: DataFrame, k: int) -> DataFrame:
    """Global ranking; Spark drops all but k rows per query in each task before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "corpus_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def best_hits(meetings: DataFrame, k: int, threshold: float) -> DataFrame:
    """The best k of every query in every slice it meets, then of all slices; ties by corpus id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, cosines, ids in nr.scores(batch, nr.one_vector):
                sim, ids = np.round(cosines[0], 9), np.asarray(ids)
                top = np.lexsort((ids, -sim))[:k]
                top = top[sim[top] >= threshold]
                out.append(pd.DataFrame({"query_id": row, "corpus_id": ids[top], "similarity": sim[top]}))
            if out:
                yield pd.concat(out)

    return keep_best(meetings.mapInPandas(run, HITS), k)


def best_pairs(asked: np.ndarray, vectors: np.ndarray, k: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, cosine) of the k best of every query of at least the threshold, best first; of equal cosines the first vector.

    Unit vectors in single precision tell which pairs can be among them: their cosines are off by `slack` at most, and the k-th
    best of the largest cosines of GROUPS groups is a bound for the k-th best of all. Those pairs are scored in double precision.
    """
    near, own = nr.unit(vectors).astype(np.float32), (vectors * vectors).sum(axis=1)
    n, groups = len(vectors), min(max(GROUPS, k), len(vectors))
    slack = (vectors.shape[1] + 8) * np.finfo(np.float32).eps + 1e-9
    for at in range(0, len(asked) if n else 0, TOGETHER):
        part = asked[at : at + TOGETHER]
        rough = nr.unit(part).astype(np.float32) @ near.T
        cut = np.full(len(part), threshold - slack)
        if n > k:
            width = n // groups
            most = np.fmax.reduce(rough[:, : groups * width].reshape(len(part), groups, width), axis=2)
            most[np.isnan(most)] = -np.inf
            cut = np.maximum(cut, np.partition(most, groups - k, axis=1)[:, groups - k] - 2 * slack)
        row, hit = np.nonzero(rough >= cut[:, None])
        many = len(row) > SINGLY * len(part)
        shared = (part @ vectors.T)[row, hit] if many else np.einsum("ij,ij->i", part[row], vectors[hit])
        norm = np.sqrt((part * part).sum(axis=1)[row] * own[hit])
        sim = np.round(np.divide(shared, norm, out=np.zeros_like(shared), where=norm > 0), 9)
        order = np.lexsort((hit, -sim, row))
        order = order[sim[order] >= threshold]
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
        yield at + row[order], hit[order], sim[order]


def knn_search(queries: DataFrame, corpus: DataFrame, id_col: str, vec: str, k: int = 5, threshold: float = 0.7, handed: int = FEW) -> DataFrame:
    """Exact top-k by cosine among vectors of at least the threshold, ties by corpus id (numbers); see `nearest`."""
    queries, corpus = (df.where(F.col(vec).isNotNull()) for df in (queries, corpus))
    packed = corpus.select(F.col(id_col).alias("id"), nr.packed(F.col(vec)).alias("v"))
    asked = queries.select(F.col(id_col).alias("row"), nr.packed(F.col(vec)).alias("payload"))
    one = packed.first()
    few = nr.handed(packed, len(one.v) // 8 or 1, handed) if one else []
    if few is None:
        return by_blocks(queries, corpus, id_col, vec, k, threshold)
    few = sorted(few, key=lambda r: r.id)
    vectors, ids = np.array([nr.one_vector(bytes(r.v))[0] for r in few]), np.array([r.id for r in few])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(ids) and len(batch):
                for row, hit, sim in best_pairs(np.stack([nr.one_vector(bytes(v))[0] for v in batch["payload"]]), vectors, k, threshold):
                    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                    yield pd.DataFrame({"query_id": batch["row"].to_numpy()[row], "corpus_id": ids[hit], "similarity": sim, "rank": rank})

    return asked.mapInPandas(run, HITS + ", rank bigint")


def by_blocks(queries: DataFrame, corpus: DataFrame, id_col: str, vec: str, k: int, threshold: float) -> DataFrame:
    """Exact top-k where the corpus is too large to be handed out: packs of queries meet blocks of vectors, each pair leaves the
    k best of every query, and these are ranked."""
    rows = checkpointed(corpus.select(F.col(id_col).alias("id"), F.col(vec).alias("v")))
    asked = checkpointed(queries.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))).withColumn("query_id", F.monotonically_increasing_id())

    def use(ids: np.ndarray, q: np.ndarray, block: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        vectors = np.stack([np.asarray(v, np.float64) for v in block["v"]])
        for row, hit, sim in best_pairs(q, vectors, k, threshold):
            yield pd.DataFrame({"query_id": ids[row], "corpus_id": block["id"][hit], "similarity": sim})

    # Few blocks meet groups of packs, so that there is work for every task.
    blocks, many = nr.blocks_of(rows, rows.count(), ["id", "v"])
    groups = -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // many)
    met = nr.meet(nr.packs_of(asked.select("query_id", "v"), ["query_id"]), blocks, many, use, HITS, groups)
    named = asked.select(F.col("id").alias("_name"), "query_id")
    return keep_best(met, k).join(named, "query_id").select(F.col("_name").alias("query_id"), "corpus_id", "similarity", "rank")


def knn_approx(queries: DataFrame, corpus: DataFrame, id_col: str, vec: str, cells: int, probes: int, k: int = 5, threshold: float = 0.7) -> DataFrame:
    """Top-k by cosine within the `probes` nearest of `cells` cells of each query.

    Scores are exact, only far cells are left out; recall rises with the share of cells probed, cost as well. Both numbers
    belong to the data, so they have no default.
    """
    index = nr.build_index(checkpointed(corpus.select(id_col, nr.packed(F.col(vec)).alias("v"))), id_col, "v", cells)
    asked = queries.select(F.col(id_col).alias("row"), nr.packed(F.col(vec)).alias("payload"))
    return best_hits(nr.meetings(index, asked, nr.one_vector, k, threshold, probes=probes), k, threshold)


# --- embedding store ---------------------------------------------------------------------


def split_cached(requests: DataFrame, store: DataFrame, key: str, ts: str, stored_ts: str, ttl_seconds: int = 3600) -> DataFrame:
    """Every request with `cached`: its key is in the store and younger than the ttl at request time."""
    newest = store.groupBy(key).agg(F.max(stored_ts).alias("_at"))
    joined = requests.join(newest, key, "left")
    age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    return joined.withColumn("cached", F.coalesce((age >= 0) & (age < ttl_seconds * 1_000_000), F.lit(False))).drop("_at")


def two_level_lookup(requests: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Value of the first store that has the key, and which one it was. Stores have one row per key."""
    one = first.select(key, F.col(value).alias("_v1"), F.lit(True).alias("_in1"))
    two = second.select(key, F.col(value).alias("_v2"), F.lit(True).alias("_in2"))
    joined = requests.join(one, key, "left").join(two, key, "left")
    return joined.withColumns(
        {
            value: F.when(F.col("_in1"), F.col("_v1")).otherwise(F.col("_v2")),
            "level": F.when(F.col("_in1"), "first").when(F.col("_in2"), "second").otherwise("miss"),
        }
    ).drop("_v1", "_v2", "_in1", "_in2")


def get_or_compute(texts: DataFrame, store: DataFrame, text_col: str, embedder: vx.Embedder = vx.HASHED) -> tuple[DataFrame, DataFrame]:
    """(embedding of every distinct text, the part of it that was not stored).

    The second frame is what a caller appends to the store; each text is embedded
    once however often it occurs.
    """
    keyed = texts.withColumn("key", tx.content_key(F.lit(embedder.name), F.col(text_col)))
    distinct = keyed.groupBy("key").agg(F.first(text_col).alias("text"))
    missing = distinct.join(store.select("key"), "key", "left_anti")
    fresh = missing.select("key", embedder.embed_text(tx.words(F.col("text"))).alias("embedding"))
    known = store.select("key", "embedding").join(distinct.select("key"), "key", "left_semi")
    both = known.withColumn("origin", F.lit("stored")).unionByName(fresh.withColumn("origin", F.lit("computed")))
    return both, fresh


def upsert_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest_per_key(rows, keys, order)


def hot_keys(accesses: DataFrame, key: str, n: int = 10) -> DataFrame:
    return accesses.groupBy(key).agg(F.count("*").alias("accesses")).orderBy(F.col("accesses").desc(), key).limit(n)


def hit_rate(accesses: DataFrame, key: str, order: list[str], decay: float = 0.9) -> DataFrame:
    """Hits of a store that never evicts: plain rate and exponential moving average after the last access.

    The first access of a key misses. The average is a weighted sum over positions
    from the end, so it is one aggregate after the running index.
    """
    first = accesses.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    indexed = running_index(accesses.select(key, *order), [], order)
    flagged = indexed.join(first, key).withColumn("_hit", (F.struct(*order) != F.col("_first")).cast("int"))
    total = accesses.agg(F.count("*").alias("_n"))
    k = F.lit(0).alias("_k")
    weighted = flagged.select("_hit", "idx", k).join(F.broadcast(total.select("_n", k)), "_k")
    weight = (1.0 - decay) * F.pow(F.lit(decay), F.col("_n") - 1 - F.col("idx"))
    return weighted.agg(
        F.count("*").alias("accesses"), F.sum("_hit").alias("hits"), F.avg("_hit").alias("hit_rate"), F.sum(F.col("_hit") * weight).alias("moving_rate")
    )


def store_stats(store: DataFrame, vec: str, accesses: DataFrame, key: str, millis: str, order: list[str], last: int = 1000) -> DataFrame:
    """Entries, bytes, hit rate and mean duration of the last look-ups, in one row."""
    k = F.lit(0).alias("_k")
    size = store.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.size(vec) * 4), F.lit(0)).alias("size_bytes"))
    uses = accesses.groupBy(key).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("lookups"), (F.sum(F.col("n") - 1) / F.sum("n")).alias("hit_rate")
    )
    recent = accesses.orderBy(*[F.col(c).desc() for c in order]).limit(last).agg(F.avg(millis).alias("avg_lookup_ms"))
    joined = size.select("*", k).join(F.broadcast(uses.select("*", k)), "_k").join(F.broadcast(recent.select("*", k)), "_k")
    return joined.drop("_k").withColumn("size_mb", F.col("size_bytes") / (1024.0 * 1024.0))


def batch_metrics(requests: DataFrame, batch: str, cached: str, ts: str) -> DataFrame:
    """Requests, uptime, share that had to be computed and average batch size."""
    per_batch = requests.groupBy(batch).agg(
        F.count("*").alias("n"), F.count_if(~F.col(cached)).alias("computed"), F.min(ts).alias("a"), F.max(ts).alias("z")
    )
    span = (F.unix_micros(F.max("z").cast("timestamp")) - F.unix_micros(F.min("a").cast("timestamp"))) / 1e6
    return per_batch.agg(
        F.sum("n").alias("requests"), F.count("*").alias("batches"), span.alias("uptime_seconds"),
        (F.sum("computed") / F.sum("n")).alias("utilization"), F.avg("n").alias("avg_batch_size"),
    )
