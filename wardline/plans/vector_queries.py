"""Queries over embeddings, vector sequences and token windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import spans as sp
from wardline.functions import text as tx
from wardline.functions import vectors as vx
from wardline.operators import sequences as sq
from wardline.operators import tokens as tk
from wardline.operators.rows import inline_rows, position_rows
from wardline.plans.common import (
    SQL_PROMPTS, load, prompts, r6, rounded, section, sql_bucket, sql_buckets, sql_counts, sql_overlap, sql_r6,
    sql_span_cosine, sql_words,
)

QUERIES, ORACLE, query = section()

W = sql_words("text")
VEC = "embedding::DOUBLE[]"
REV = "list_reverse(embedding::DOUBLE[])"


def embeddings(spark, sf):
    return load(spark, sf, "embeddings")


@query(
    "embed",
    f"""WITH e AS (SELECT prompt_id, {sql_buckets(W)} AS b FROM ({SQL_PROMPTS}))
    SELECT prompt_id, d::BIGINT AS dim, {sql_r6("c / sqrt(m::DOUBLE)")} AS x FROM (SELECT prompt_id, {sql_overlap('b', 'b')} AS m,
    unnest(range(64)) AS d, unnest({sql_counts('b')}) AS c FROM e) WHERE c > 0""",
)
def embed(spark, sf):
    e = prompts(spark, sf).select("prompt_id", vx.embed(tx.words(F.col("text"))).alias("v"))
    return rounded(position_rows(e, ["prompt_id"], "v", "x", "dim").where(F.col("x") > 0), "x")


@query("dot", f"SELECT vec_id, {sql_r6(f'list_dot_product({VEC}, {REV})')} AS dot FROM embeddings")
def dot(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(vx.dot(F.col("embedding"), F.reverse("embedding"))).alias("dot"))


@query("cosine", f"SELECT vec_id, {sql_r6(f'list_cosine_similarity({VEC}, {REV})')} AS cosine FROM embeddings")
def cosine(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(vx.cosine(F.col("embedding"), F.reverse("embedding"))).alias("cosine"))


@query("l2_norm", f"SELECT vec_id, {sql_r6(f'sqrt(list_dot_product({VEC}, {VEC}))')} AS norm FROM embeddings")
def l2_norm(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(vx.l2_norm(F.col("embedding"))).alias("norm"))


@query(
    "normalize",
    f"""SELECT vec_id, unnest(range(64))::BIGINT AS dim, round(unnest(list_transform({VEC}, lambda x: x * (vec_id + 1)))
    / nullif(sqrt(list_dot_product({VEC}, {VEC})) * (vec_id + 1), 0), 6) + 0.0 AS x FROM embeddings""",
)
def normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    return rounded(position_rows(embeddings(spark, sf), ["vec_id"], vx.normalize(scaled), "x", "dim"), "x")


@query(
    "embedding_variance",
    f"SELECT vec_id, {sql_r6(f'list_var_pop({VEC})')} AS variance FROM embeddings",
)
def embedding_variance(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(vx.variance(F.col("embedding"))).alias("variance"))


@query(
    "gradient_magnitude",
    f"""WITH c AS (SELECT vec_id, unnest(range(64)) AS i, {VEC} AS v FROM embeddings),
    g AS (SELECT vec_id, (v[least(i+1,63)+1] - v[greatest(i-1,0)+1]) / (least(i+1,63) - greatest(i-1,0)) AS g FROM c)
    SELECT vec_id, {sql_r6('sqrt(sum(g*g))')} AS gradient FROM g GROUP BY vec_id""",
)
def gradient_magnitude(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(vx.gradient_magnitude(F.col("embedding"))).alias("gradient"))


SQL_STEPS = f"""SELECT label, vec_id, sqrt(list_sum([x*x for x in [a-b for a, b in list_zip(v, p)]])) FROM x"""
SQL_STEP_CTE = f"""l AS (SELECT label, vec_id, {VEC} AS v, lag({VEC}) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    s AS (SELECT label, list_distance(v, p) AS step FROM l WHERE p IS NOT NULL)"""


@query(
    "smoothness",
    f"""WITH {SQL_STEP_CTE} SELECT label, (count(*)+1)::BIGINT AS n, {sql_r6('1.0/(1.0+avg(step))')} AS smoothness
    FROM s GROUP BY label""",
)
def smoothness(spark, sf):
    return rounded(sq.smoothness(embeddings(spark, sf), "label", "vec_id", "embedding"), "smoothness")


SQL_DIM_CTE = f"""d AS (SELECT label, vec_id, unnest(range(64)) AS dim, unnest({VEC}) AS x FROM embeddings),
    m AS (SELECT label, dim, avg(x) AS mean, var_pop(x) AS var, count(*) AS n FROM d GROUP BY label, dim)"""


@query(
    "perturbation_signature",
    f"""WITH {SQL_DIM_CTE} SELECT label, {sql_r6("CASE WHEN max(n) < 3 THEN 0.0 ELSE least(greatest(1.0 - stddev_pop(var)/(avg(var)+1e-8), 0.0), 1.0) END")} AS signature
    FROM m GROUP BY label""",
)
def perturbation_signature(spark, sf):
    return rounded(sq.perturbation_signature(embeddings(spark, sf), "label", "embedding"), "signature")


SQL_OUTLIER = """CASE WHEN count(*) < 3 OR stddev_pop(dist) < 1e-6 THEN 0.0 ELSE
    least(greatest(max(dist)-avg(dist), avg(dist)-min(dist)) / stddev_pop(dist) / 3.0, 1.0) END"""


@query(
    "outlier_score",
    f"""WITH {SQL_DIM_CTE}, t AS (SELECT d.label, vec_id, sqrt(sum((x-mean)*(x-mean))) AS dist FROM d JOIN m USING (label, dim) GROUP BY ALL)
    SELECT label, {sql_r6(SQL_OUTLIER)} AS outlier_score FROM t GROUP BY label""",
)
def outlier_score(spark, sf):
    return rounded(sq.outlier_score(embeddings(spark, sf), "label", "embedding"), "outlier_score")


def sql_esa(scale: float, tag: str) -> str:
    return f"""SELECT e.label, '{tag}' AS scale, e.n, {sql_r6('mean_step')} AS mean_step, {sql_r6('max_step')} AS max_step, num_perturbations,
    least(1.0, max_step/{scale}) > 1.0-0.8 AS is_detected,
    {sql_r6(f'CASE WHEN least(1.0, max_step/{scale}) > 1.0-0.8 THEN least(1.0, max_step/{scale}) ELSE 0.0 END')} AS confidence
    FROM (SELECT label, count(*)::BIGINT AS n FROM embeddings GROUP BY label) e JOIN g USING (label)"""


@query(
    "esa",
    f"""WITH {SQL_STEP_CTE}, t AS (SELECT label, avg(step) AS mean_step, stddev_pop(step) AS sd, max(step) AS max_step FROM s GROUP BY label),
    g AS (SELECT label, mean_step, max_step, count(*) FILTER (WHERE step > mean_step + 2*sd)::BIGINT AS num_perturbations
      FROM s JOIN t USING (label) GROUP BY ALL)
    {sql_esa(10.0, 'default')} UNION ALL {sql_esa(5.0, 'half')}""",
)
def esa(spark, sf):
    e = embeddings(spark, sf)
    both = [
        sq.embedding_shift(e, "label", "vec_id", "embedding", scale=s).withColumn("scale", F.lit(tag))
        for s, tag in ((10.0, "default"), (5.0, "half"))
    ]
    return rounded(both[0].unionByName(both[1]), "mean_step", "max_step", "confidence")


# --- texts as spans ----------------------------------------------------------------------

SQL_SENT = f"list_transform(string_split(text, '.'), lambda s: {sql_buckets(sql_words('s'))})"


@query(
    "semantic_consistency",
    f"""WITH s AS (SELECT doc_id, unnest({SQL_SENT}) AS b, unnest(range(len(string_split(text,'.')))) AS i FROM documents),
    n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE len(b) > 0) AS filled FROM s GROUP BY doc_id),
    c AS (SELECT doc_id, i, x, count(*) AS c FROM (SELECT doc_id, i, unnest(b) AS x FROM s) GROUP BY ALL),
    u AS (SELECT doc_id, x, c / sqrt(sum(c*c) OVER (PARTITION BY doc_id, i)) AS u FROM c),
    t AS (SELECT doc_id, sum(t*t) AS sq FROM (SELECT doc_id, x, sum(u) AS t FROM u GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, {sql_r6("CASE WHEN n < 2 THEN 1.0 ELSE (coalesce(sq,0.0) - filled) / (n*(n-1.0)) END")} AS consistency
    FROM n LEFT JOIN t USING (doc_id)""",
)
def semantic_consistency(spark, sf):
    return rounded(tk.sentence_statistics(load(spark, sf, "documents"), "doc_id").select("doc_id", "consistency"), "consistency")


def sql_component_variance(size: str, filled: str, n: str) -> str:
    return f"least(greatest(10.0*({filled}/({n}*64.0) - ({size}/({n}*64.0))*({size}/({n}*64.0))), 0.0), 1.0)"


@query(
    "phrase_anomaly",
    f"""WITH b AS (SELECT doc_id, {sql_buckets(W)} AS b FROM documents),
    t AS (SELECT doc_id, unnest([b[i+1:i+3] for i in range(len(b)-2)]) AS s FROM b WHERE len(b) >= 3),
    a AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(3.0/sqrt({sql_overlap('s', 's')}::DOUBLE)) AS k FROM t GROUP BY doc_id)
    SELECT b.doc_id, {sql_r6(f"coalesce({sql_component_variance('k', 'n', 'n')}, 0.0)")} AS score FROM b LEFT JOIN a USING (doc_id)""",
)
def phrase_anomaly(spark, sf):
    d = load(spark, sf, "documents").withColumn("_b", vx.buckets(tx.words(F.col("text"))))
    return d.select("doc_id", r6(sp.phrase_anomaly(F.col("_b"))).alias("score"))


@query(
    "sentence_anomaly",
    f"""WITH s AS (SELECT doc_id, unnest({SQL_SENT}) AS b FROM documents),
    a AS (SELECT doc_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE len(b) > 0)::DOUBLE AS f,
      sum(coalesce(len(b)/nullif(sqrt({sql_overlap('b', 'b')}::DOUBLE), 0), 0)) AS k FROM s GROUP BY doc_id)
    SELECT doc_id, {sql_r6(f"CASE WHEN n >= 2 THEN {sql_component_variance('k', 'f', 'n')} ELSE 0.0 END")} AS score FROM a""",
)
def sentence_anomaly(spark, sf):
    return rounded(tk.sentence_statistics(load(spark, sf, "documents"), "doc_id").select("doc_id", F.col("sentence").alias("score")), "score")


@query(
    "cross_level_consistency",
    f"""SELECT event_id, {sql_r6("least(greatest(1.0-list_stddev_pop([a, b, c]), 0.0), 1.0)")} AS consistency FROM
    (SELECT event_id, least(value/100.0, 1.0) AS a, (props->>'$.k')::INT/100.0::DOUBLE AS b, 0.5::DOUBLE AS c FROM events)""",
)
def cross_level_consistency(spark, sf):
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int") / 100.0
    level = sp.cross_level_consistency(F.least(F.col("value") / 100.0, F.lit(1.0)), k, F.lit(0.5))
    return e.select("event_id", r6(level).alias("consistency"))


# --- token windows -----------------------------------------------------------------------


def sql_tokens(radius: int, source: str = SQL_PROMPTS) -> str:
    """CTEs tok(prompt_id, w, b) and span(prompt_id, pos, token, s, m)."""
    return f"""tok AS (SELECT prompt_id, {W} AS w, {sql_buckets(W)} AS b FROM ({source})),
    pos AS (SELECT prompt_id, unnest(range(len(b)))::BIGINT AS pos, w, b FROM tok),
    cut AS (SELECT prompt_id, pos, w[pos+1] AS token, b[greatest(pos-{radius},0)+1 : pos+{radius}+1] AS s FROM pos),
    span AS (SELECT *, {sql_overlap('s', 's')} AS m FROM cut)"""


@query(
    "token_context",
    f"""WITH t AS (SELECT prompt_id, {W} AS w FROM ({SQL_PROMPTS})), p AS (SELECT prompt_id, w, unnest(range(len(w)))::BIGINT AS pos FROM t)
    SELECT prompt_id, pos, w[pos+1] AS token, array_to_string(w[greatest(pos-2,0)+1 : pos+3], ' ') AS ctx FROM p""",
)
def token_context(spark, sf):
    t = tk.token_context(tk.with_tokens(prompts(spark, sf)), "prompt_id", 2)
    return t.withColumn("ctx", F.array_join("ctx", " "))


@query(
    "context_window_embedding",
    f"WITH {sql_tokens(5)} SELECT prompt_id, pos, array_to_string(list_sort(s), ' ') AS span FROM span",
)
def context_window_embedding(spark, sf):
    t = tk.context_window_embedding(tk.with_tokens(prompts(spark, sf)), "prompt_id", 5)
    return t.withColumn("span", F.array_join("span", " "))


@query(
    "build_reference",
    f"""WITH {sql_tokens(5, SQL_PROMPTS + " WHERE role = 'user'")}
    SELECT array_to_string(list_sort(s), ' ') AS span, count(*)::BIGINT AS copies FROM span GROUP BY 1""",
)
def build_reference(spark, sf):
    good = prompts(spark, sf).where("role = 'user'")
    t = tk.build_reference(tk.with_tokens(good), "prompt_id", 5)
    return t.withColumn("span", F.array_join("span", " "))


def reference(spark, sf):
    """The benchmark texts as known-good reference vectors."""
    b = tk.with_tokens(load(spark, sf, "benchmark"))
    return tk.text_reference(b, "item_id")


SQL_REFS = f"""refs AS (SELECT item_id::VARCHAR AS ref, {sql_counts('b')} AS rc, {sql_overlap('b', 'b')} AS rm
    FROM (SELECT item_id, {sql_buckets(W)} AS b FROM benchmark)),
    sims AS (SELECT prompt_id, pos, token, ref, list_sum(list_transform(s, lambda x: rc[x+1]))::DOUBLE / sqrt((m*rm)::DOUBLE) AS sim FROM span, refs),
    tsim AS (SELECT prompt_id, pos, token, max(sim) AS max_sim, avg(sim) AS mean_sim, min(sim) AS min_sim, stddev_pop(sim) AS std_sim
      FROM sims GROUP BY prompt_id, pos, token)"""


@query(
    "reference_similarity",
    f"""WITH {sql_tokens(5)}, {SQL_REFS} SELECT prompt_id, pos, {sql_r6('max_sim')} AS max_sim, {sql_r6('mean_sim')} AS mean_sim,
    {sql_r6('min_sim')} AS min_sim, {sql_r6('std_sim')} AS std_sim FROM tsim""",
)
def reference_similarity(spark, sf):
    scored = tk.with_reference_similarity(tk.with_tokens(prompts(spark, sf)), reference(spark, sf), "prompt_id", 5)
    names = ["max_sim", "mean_sim", "min_sim", "std_sim"]
    rows = position_rows(scored, ["prompt_id"], F.arrays_zip(*names), "z")
    return rows.select("prompt_id", "pos", *[r6(F.col(f"z.{n}")).alias(n) for n in names])


# A second embedder: 128 buckets, handed over as dense vectors like those of a model.
def one_hot(tokens):
    def vector(token):
        return vx.let(vx.bucket(token, 128), lambda b: F.transform(F.sequence(F.lit(0), F.lit(127)), lambda d: (d == b).cast("float")))

    return F.transform(tokens, vector)


DENSE = vx.Embedder("one-hot-128", 128, one_hot)


def sql_wide(sql: str) -> str:
    return sql.replace("%64)", "%128)").replace("range(64)", "range(128)")


@query(
    "dense_reference_similarity",
    sql_wide(f"""WITH {sql_tokens(5)}, {SQL_REFS} SELECT prompt_id, pos, {sql_r6('max_sim')} AS max_sim, {sql_r6('mean_sim')} AS mean_sim,
    {sql_r6('min_sim')} AS min_sim, {sql_r6('std_sim')} AS std_sim FROM tsim"""),
)
def dense_reference_similarity(spark, sf):
    known = tk.text_reference(tk.with_tokens(load(spark, sf, "benchmark"), embedder=DENSE), "item_id", DENSE)
    scored = tk.with_reference_similarity(tk.with_tokens(prompts(spark, sf), embedder=DENSE), known, "prompt_id", 5, DENSE)
    names = ["max_sim", "mean_sim", "min_sim", "std_sim"]
    rows = position_rows(scored, ["prompt_id"], F.arrays_zip(*names), "z")
    return rows.select("prompt_id", "pos", *[r6(F.col(f"z.{n}")).alias(n) for n in names])


@query(
    "top_similar_tokens",
    f"""WITH {sql_tokens(5)}, {SQL_REFS}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, pos ORDER BY sim DESC, ref) AS rank FROM sims)
    SELECT prompt_id, pos, rank::BIGINT AS rank, ref, {sql_r6('sim')} AS similarity FROM r WHERE rank <= 5""",
)
def top_similar_tokens(spark, sf):
    top = tk.top_similar_tokens(tk.with_tokens(prompts(spark, sf)), reference(spark, sf), "prompt_id", 5)
    return rounded(top, "similarity")


SQL_ANOMALY = "anom AS (SELECT *, least(1.0, 1.0 - max_sim + 0.5*std_sim) AS anomaly FROM tsim)"


@query(
    "token_anomaly",
    f"""WITH {sql_tokens(5)}, {SQL_REFS}, {SQL_ANOMALY}
    SELECT prompt_id, pos, {sql_r6('anomaly')} AS anomaly, anomaly > 0.6 AS is_anomalous FROM anom""",
)
def token_anomaly(spark, sf):
    scored = tk.with_reference_similarity(tk.with_tokens(prompts(spark, sf)), reference(spark, sf), "prompt_id", 5)
    a = tk.token_anomaly(F.col("max_sim"), F.col("std_sim"))
    rows = position_rows(scored, ["prompt_id"], a, "anomaly")
    return rounded(rows.withColumn("is_anomalous", F.col("anomaly") > 0.6), "anomaly")


def sql_adjacent(radius: int, threshold: float, source: str = SQL_PROMPTS) -> str:
    """CTE adj(prompt_id, position, tokens, c) of neighbouring windows; needs sql_tokens(radius)."""
    return f"""pair AS (SELECT prompt_id, pos, token, s, m, lead(token) OVER w AS token2, lead(s) OVER w AS s2, lead(m) OVER w AS m2 FROM span
      WINDOW w AS (PARTITION BY prompt_id ORDER BY pos)),
    adj AS (SELECT prompt_id, pos AS position, token||' '||token2 AS tokens, {sql_overlap('s', 's2')}::DOUBLE / sqrt((m*m2)::DOUBLE) AS c
      FROM pair WHERE s2 IS NOT NULL)"""


def sql_window_shift(window: int, stride: int) -> str:
    """CTE win(prompt_id, position, tokens, c); needs tok."""
    return f"""wp AS (SELECT prompt_id, w, b, unnest(range(len(b)-{window}-{stride}+1)) AS i FROM tok WHERE len(b) >= 2*{window}),
    ws AS (SELECT prompt_id, i, w, b[i+1:i+{window}] AS a, b[i+{stride}+1:i+{stride}+{window}] AS z FROM wp),
    win AS (SELECT prompt_id, i::BIGINT AS position, array_to_string(w[i+1:i+2*{window}], ' ') AS tokens, {sql_span_cosine('a', 'z')} AS c FROM ws)"""


def sql_severity3(x: str) -> str:
    return f"CASE WHEN {x} > 0.8 THEN 'critical' WHEN {x} > 0.6 THEN 'high' WHEN {x} > 0.4 THEN 'medium' ELSE 'low' END"


# Neighbouring windows of radius 5 share ten of eleven tokens and never fall below the
# default threshold, so the checked queries use radius 1 with .8 and stride 2.
SHIFTS = tk.TokenParams(shift_radius=1, stride=2, shift_threshold=0.7)


@query(
    "adjacent_shift",
    f"""WITH {sql_tokens(1)}, {sql_adjacent(1, 0.7)} SELECT prompt_id, position, tokens, {sql_r6('c')} AS similarity,
    {sql_r6('1.0-c')} AS magnitude, {sql_severity3('(1.0-c)')} AS severity FROM adj WHERE c < 0.7""",
)
def adjacent_shift(spark, sf):
    t = tk.with_shifts(tk.with_cosines(tk.with_tokens(prompts(spark, sf)), SHIFTS), SHIFTS)
    return _shift_rows(t, "adjacent_shift")


def _shift_rows(t, kind):
    rows = inline_rows(t, ["prompt_id"], F.filter("shifts", lambda s: s["type"] == kind), "position")
    return rounded(rows.drop("type"), "similarity", "magnitude")


@query(
    "window_shift",
    f"""WITH {sql_tokens(0)}, {sql_window_shift(5, 2)} SELECT prompt_id, position, tokens, {sql_r6('c')} AS similarity,
    {sql_r6('1.0-c')} AS magnitude, {sql_severity3('(1.0-c)')} AS severity FROM win WHERE c < 0.7""",
)
def window_shift(spark, sf):
    t = tk.with_shifts(tk.with_cosines(tk.with_tokens(prompts(spark, sf)), SHIFTS), SHIFTS)
    return _shift_rows(t, "window_based_shift")


@query(
    "prompt_anomaly",
    f"""WITH {sql_tokens(5)}, {SQL_REFS}, {SQL_ANOMALY}
    SELECT prompt_id, {sql_r6("least(1.0, 0.7*avg(anomaly) + 0.3*avg((anomaly > 0.6)::INT))")} AS overall_anomaly FROM anom GROUP BY prompt_id""",
)
def prompt_anomaly(spark, sf):
    scored = tk.with_reference_similarity(tk.with_tokens(prompts(spark, sf)), reference(spark, sf), "prompt_id", 5)
    a = tk.token_anomaly(F.col("max_sim"), F.col("std_sim"))
    return scored.select("prompt_id", r6(tk.prompt_anomaly(a)).alias("overall_anomaly"))


@query(
    "position_entropy",
    f"""WITH {sql_tokens(5)}, {SQL_REFS}, {SQL_ANOMALY},
    p AS (SELECT prompt_id, anomaly / (sum(anomaly) OVER (PARTITION BY prompt_id) + 1e-8) AS p FROM anom)
    SELECT prompt_id, {sql_r6("CASE WHEN count(*) > 1 THEN -sum(p*ln(p+1e-8))/ln(count(*)) ELSE 0.0 END")} AS entropy FROM p GROUP BY prompt_id""",
)
def position_entropy(spark, sf):
    scored = tk.with_reference_similarity(tk.with_tokens(prompts(spark, sf)), reference(spark, sf), "prompt_id", 5)
    scored = scored.withColumn("anomaly", tk.token_anomaly(F.col("max_sim"), F.col("std_sim")))
    return scored.select("prompt_id", r6(sp.position_entropy(F.col("anomaly"))).alias("entropy"))




def sql_analysis(source: str = SQL_PROMPTS) -> str:
    """All CTEs of the token analysis: tok, span, tsim, anom, adj, win and shifts."""
    return f"""{sql_tokens(1, source)}, {SQL_REFS}, {SQL_ANOMALY}, {sql_adjacent(1, 0.7)}, {sql_window_shift(5, 2)},
    shifts AS (SELECT prompt_id, position, tokens, c, 'adjacent_shift' AS type FROM adj WHERE c < 0.7
      UNION ALL SELECT prompt_id, position, tokens, c, 'window_based_shift' FROM win WHERE c < 0.7)"""


SQL_ANALYSIS = sql_analysis()
ANALYSIS = tk.TokenParams(radius=1, shift_radius=1, stride=2)


def analyzed(spark, sf, df=None):
    return tk.analyze_tokens(prompts(spark, sf) if df is None else df, reference(spark, sf), "prompt_id", params=ANALYSIS)


@query(
    "anomaly_list",
    f"""WITH {SQL_ANALYSIS} SELECT prompt_id, 'token_anomaly' AS type, pos AS position, token AS detail, {sql_r6('anomaly')} AS score,
    CASE WHEN anomaly > 0.9 THEN 'critical' WHEN anomaly > 0.7 THEN 'high' WHEN anomaly > 0.5 THEN 'medium' ELSE 'low' END AS severity
    FROM anom WHERE anomaly > 0.6
    UNION ALL SELECT prompt_id, type, position, tokens, {sql_r6('1.0-c')}, {sql_severity3('(1.0-c)')} FROM shifts""",
)
def anomaly_list(spark, sf):
    return rounded(inline_rows(analyzed(spark, sf), ["prompt_id"], "anomalies", "type"), "score")


@query(
    "analyze_tokens",
    f"""WITH {SQL_ANALYSIS}, a AS (SELECT prompt_id, count(*)::BIGINT AS tokens, least(1.0, 0.7*avg(anomaly) + 0.3*avg((anomaly > 0.6)::INT)) AS o,
      max(anomaly) AS hi, count(*) FILTER (WHERE anomaly > 0.6) AS na FROM anom GROUP BY prompt_id),
    s AS (SELECT prompt_id, count(*) AS ns, max(1.0-c) AS mag FROM shifts GROUP BY prompt_id)
    SELECT a.prompt_id, tokens, {sql_r6('o')} AS overall_anomaly, {sql_r6('hi')} AS max_anomaly, coalesce(ns, 0)::BIGINT AS n_shifts,
    (na + coalesce(ns, 0))::BIGINT AS n_anomalies, {sql_r6('coalesce(mag, 0.0)')} AS max_shift FROM a LEFT JOIN s USING (prompt_id)""",
)
def analyze_tokens(spark, sf):
    a = analyzed(spark, sf)
    return a.select(
        "prompt_id", F.size("tokens").cast("long").alias("tokens"), r6(F.col("overall_anomaly")).alias("overall_anomaly"),
        r6(F.array_max("anomaly")).alias("max_anomaly"), F.size("shifts").cast("long").alias("n_shifts"),
        F.size("anomalies").cast("long").alias("n_anomalies"),
        r6(F.coalesce(F.array_max(F.transform("shifts", lambda s: s["magnitude"])), F.lit(0.0))).alias("max_shift"),
    )
