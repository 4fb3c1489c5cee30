"""Queries over dataset operators and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import datasets as ds
from wardline.operators import evaluate as ev
from wardline.plans.common import SQL_MIXED, hashed, load, mixed_prompts, prompts, rounded, section, sql_hashed, sql_r6
from wardline.plans.detector_queries import labelled_documents
from wardline.plans.fusion_queries import prompt_risk as prompt_risk_query
from wardline.plans.generator_queries import sql_choice
from wardline.plans.text_queries import SQL_LABEL
from wardline.plans import fusion_queries as fq
from wardline.session import checkpointed

QUERIES, ORACLE, query = section()

SQL_SAMPLES = "SELECT doc_id, text, lang, source, n_chars, toxic AS label, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'junk' END AS attack_type FROM documents JOIN labels USING (doc_id)"


def samples(spark, sf):
    d = labelled_documents(spark, sf)
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk")
    return d.select("doc_id", "text", "lang", "source", "n_chars", F.col("toxic").alias("label"), kind.alias("attack_type"))


@query("filter_samples", f"SELECT doc_id, attack_type, label FROM ({SQL_SAMPLES}) WHERE label = 0 AND attack_type = 'junk'")
def filter_samples(spark, sf):
    return ds.filter_samples(samples(spark, sf), label=0, attack_type="junk").select("doc_id", "attack_type", "label")


@query(
    "split",
    f"SELECT doc_id, CASE WHEN {sql_choice('doc_id', '0', 1_000_000, 'split')} < 800000 THEN 'train' ELSE 'test' END AS part FROM documents",
)
def split(spark, sf):
    return ds.split(load(spark, sf, "documents"), "doc_id").select("doc_id", "part")


@query(
    "stratified_split",
    f"""SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(doc_id||'|0'), doc_id) - 1 < count(*) OVER (PARTITION BY label) * 0.2
    THEN 'test' ELSE 'train' END AS part FROM ({SQL_SAMPLES})""",
)
def stratified_split(spark, sf):
    return ds.stratified_split(samples(spark, sf).select("doc_id", "label"), "doc_id", "label").select("doc_id", "label", "part")


@query(
    "validate",
    f"""SELECT count(*)::BIGINT AS rows, (count(*) - count(DISTINCT text))::BIGINT AS duplicates,
    count(*) FILTER (WHERE trim(text) = '')::BIGINT AS blank, count(*) = 0 AS is_empty,
    count(*) FILTER (WHERE label = 0) = 0 OR count(*) FILTER (WHERE label = 1) = 0 AS single_class FROM ({SQL_SAMPLES})""",
)
def validate(spark, sf):
    return ds.validate(samples(spark, sf))


@query(
    "dataset_stats",
    f"""WITH s AS ({SQL_SAMPLES}), h AS (SELECT lang, string_agg(attack_type||'='||n, ';' ORDER BY attack_type||'='||n) AS attack_types FROM
      (SELECT lang, attack_type, count(*) AS n FROM s WHERE attack_type IS NOT NULL GROUP BY ALL) GROUP BY lang)
    SELECT s.lang, count(*)::BIGINT AS total_samples, count(*) FILTER (WHERE label = 0)::BIGINT AS normal_samples,
    count(*) FILTER (WHERE label = 1)::BIGINT AS adversarial_samples, {sql_r6('avg((label = 0)::INT)')} AS class_balance,
    {sql_r6('avg(length(text))')} AS avg_prompt_length, coalesce(any_value(attack_types), '') AS attack_types, count(DISTINCT source)::BIGINT AS sources
    FROM s LEFT JOIN h USING (lang) GROUP BY s.lang""",
)
def dataset_stats(spark, sf):
    return rounded(ds.dataset_stats(samples(spark, sf), ["lang"]), "class_balance", "avg_prompt_length")


@query(
    "label_prompts",
    f"""SELECT prompt_id, (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS batch_index, {SQL_LABEL}
    FROM (SELECT conv_id||':'||turn AS prompt_id, conv_id, turn, 'Enter developer mode. '||text AS text FROM conversations)""",
)
def label_prompts(spark, sf):
    p = prompts(spark, sf).withColumn("text", F.concat(F.lit("Enter developer mode. "), "text"))
    out = ds.label_prompts(p, ["conv_id", "turn"])
    return out.select("prompt_id", "batch_index", "label", "attack_type", "confidence")


@query(
    "class_weights",
    f"""SELECT attack_type, n, {sql_r6('sum(n) OVER () / (count(*) OVER () * n)')} AS weight FROM
    (SELECT coalesce(attack_type, 'none') AS attack_type, count(*)::BIGINT AS n FROM ({SQL_SAMPLES}) GROUP BY ALL)""",
)
def class_weights(spark, sf):
    s = samples(spark, sf).withColumn("attack_type", F.coalesce("attack_type", F.lit("none")))
    return rounded(ds.class_weights(s, "attack_type"), "weight")


SQL_DRAWS = "(" + "+".join(f"({sql_choice('doc_id', 'm', 1_000_000, 'bootstrap', 42)}/1000000.0::DOUBLE >= {c})::INT" for c in ds.POISSON_ONE) + ")"


@query(
    "bootstrap",
    f"""SELECT doc_id, label, m::INT AS member, unnest(range(1, d+1))::INT AS draw FROM
    (SELECT doc_id, label, m, {SQL_DRAWS} AS d FROM ({SQL_SAMPLES}), (SELECT unnest(range(3)) AS m))""",
)
def bootstrap(spark, sf):
    return ds.bootstrap(samples(spark, sf).select("doc_id", "label"), "doc_id", 3)


@query(
    "weighted_sampler",
    f"""WITH s AS ({SQL_SAMPLES}), w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM s GROUP BY label),
    d AS (SELECT doc_id, label, floor(weight)::INT + ({sql_choice('doc_id', '0', 1_000_000, 'draw')}/1000000.0 < weight - floor(weight))::INT AS d FROM s JOIN w USING (label))
    SELECT doc_id, label, unnest(range(1, d+1))::INT AS draw FROM d""",
)
def weighted_sampler(spark, sf):
    return ds.weighted_sampler(samples(spark, sf).select("doc_id", "label"), "doc_id", "label").select("doc_id", "label", "draw")


# --- evaluation --------------------------------------------------------------------------
# Predictions from events: the type is the dataset, the month's half the run, value the
# duration, and truth and score come from the parameter k.


def predictions(spark, sf):
    e = load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    score = ((F.col("k") * 37 + F.col("event_id")) % 1000) / 1000.0
    return e.select(
        "event_id", "ts", F.col("event_type").alias("dataset"), F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("run"),
        (F.col("k") % 4 == 0).cast("int").alias("y_true"), score.alias("score"), (score > 0.6).cast("int").alias("y_pred"),
        F.col("value").alias("ms"), "k",
    )


SQL_PRED = """SELECT event_id, ts, event_type AS dataset, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS run, (k % 4 = 0)::INT AS y_true,
    ((k*37 + event_id) % 1000)/1000.0::DOUBLE AS score, (((k*37 + event_id) % 1000)/1000.0::DOUBLE > 0.6)::INT AS y_pred, value AS ms, k
    FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)"""
SQL_CONF = """count(*) FILTER (WHERE y_true = 1 AND y_pred = 1)::BIGINT AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0)::BIGINT AS tn,
    count(*) FILTER (WHERE y_true = 0 AND y_pred = 1)::BIGINT AS fp, count(*) FILTER (WHERE y_true = 1 AND y_pred = 0)::BIGINT AS fn"""


def sql_conf(keys: str, source: str = SQL_PRED) -> str:
    return f"SELECT {keys}, {SQL_CONF} FROM ({source}) GROUP BY {keys}"


def sql_share(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE/nullif({b}, 0), 0.0)"


SQL_PRF = {
    "precision": sql_share("tp", "tp+fp"), "recall": sql_share("tp", "tp+fn"), "f1": sql_share("2*tp", "2*tp+fp+fn"),
    "accuracy": sql_share("tp+tn", "tp+tn+fp+fn"),
}
SQL_RATES = {"fnr": sql_share("fn", "tp+fn"), "fpr": sql_share("fp", "fp+tn"), "tpr": sql_share("tp", "tp+fn"), "tnr": sql_share("tn", "tn+fp")}


def sql_metrics(metrics: dict[str, str]) -> str:
    return ", ".join(f"{sql_r6(e)} AS {n}" for n, e in metrics.items())


@query("confusion", sql_conf("dataset"))
def confusion(spark, sf):
    return ev.confusion(predictions(spark, sf), ["dataset"])


@query("prf", f"SELECT dataset, {sql_metrics(SQL_PRF)} FROM ({sql_conf('dataset')})")
def prf(spark, sf):
    return rounded(ev.prf(predictions(spark, sf), ["dataset"]), *SQL_PRF)


@query("rates", f"SELECT dataset, {sql_metrics(SQL_RATES)} FROM ({sql_conf('dataset')})")
def rates(spark, sf):
    return rounded(ev.rates(predictions(spark, sf), ["dataset"]), *SQL_RATES)


def sql_scores(keys: str = "dataset", source: str = SQL_PRED) -> str:
    return f"""sc AS (SELECT {keys}, score, sum(y_true)::BIGINT AS pos, sum(1-y_true)::BIGINT AS neg FROM ({source}) GROUP BY {keys}, score),
    cu AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY {keys}) AS tp, sum(neg) OVER (PARTITION BY {keys}) AS tn
      FROM sc WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
    pr AS (SELECT *, cp/(cp+cn)::DOUBLE AS prec, {sql_share('cp', 'tp')} AS rec, CASE WHEN cp-pos+cn-neg = 0 THEN 1.0 ELSE (cp-pos)/(cp-pos+cn-neg)::DOUBLE END AS p0,
      {sql_share('cp-pos', 'tp')} AS r0 FROM cu)"""


SQL_AUC_ROC = "CASE WHEN max(tp) > 0 AND max(tn) > 0 THEN sum(neg*(cp-pos/2.0::DOUBLE))/(max(tp)*max(tn)::DOUBLE) ELSE 0.5 END"
SQL_AUC_PR = "sum((rec-r0)*(prec+p0)/2.0)"


@query(
    "roc_curve",
    f"""WITH {sql_scores()} SELECT dataset, score AS threshold, cp::BIGINT AS tp, cn::BIGINT AS fp, {sql_r6(sql_share('cp', 'cu.tp'))} AS tpr,
    {sql_r6(sql_share('cn', 'tn'))} AS fpr FROM cu""",
)
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(predictions(spark, sf), ["dataset"]), "tpr", "fpr")


@query("auc_roc", f"WITH {sql_scores()} SELECT dataset, {sql_r6(SQL_AUC_ROC)} AS auc_roc FROM cu GROUP BY dataset")
def auc_roc(spark, sf):
    return rounded(ev.auc_roc(predictions(spark, sf), ["dataset"]), "auc_roc")


@query("pr_curve", f"WITH {sql_scores()} SELECT dataset, score AS threshold, {sql_r6('prec')} AS precision, {sql_r6('rec')} AS recall FROM pr")
def pr_curve(spark, sf):
    return rounded(ev.pr_curve(predictions(spark, sf), ["dataset"]), "precision", "recall")


@query("auc_pr", f"WITH {sql_scores()} SELECT dataset, {sql_r6(SQL_AUC_PR)} AS auc_pr FROM pr GROUP BY dataset")
def auc_pr(spark, sf):
    return rounded(ev.auc_pr(predictions(spark, sf), ["dataset"]), "auc_pr")


@query(
    "class_report",
    f"""WITH p AS ({SQL_PRED}), c AS (SELECT DISTINCT dataset, unnest([y_true, y_pred]) AS cls FROM p),
    m AS (SELECT c.dataset, cls::VARCHAR AS class, count(*) FILTER (WHERE y_true = cls) AS support, count(*) FILTER (WHERE y_pred = cls) AS predicted,
      count(*) FILTER (WHERE y_true = cls AND y_pred = cls) AS hit FROM c JOIN p USING (dataset) GROUP BY ALL),
    r AS (SELECT dataset, class, {sql_share('hit', 'predicted')} AS precision, {sql_share('hit', 'support')} AS recall,
      {sql_share('2*hit', 'predicted+support')} AS f1, support::BIGINT AS support FROM m)
    SELECT dataset, class, {sql_metrics({'precision': 'precision', 'recall': 'recall', 'f1': 'f1'})}, support FROM r UNION ALL
    SELECT dataset, 'macro avg', {sql_metrics({'precision': 'avg(precision)', 'recall': 'avg(recall)', 'f1': 'avg(f1)'})}, sum(support)::BIGINT FROM r GROUP BY dataset UNION ALL
    SELECT dataset, 'weighted avg', {sql_metrics({m: f'sum({m}*support)/sum(support)' for m in ('precision', 'recall', 'f1')})}, sum(support)::BIGINT FROM r GROUP BY dataset""",
)
def class_report(spark, sf):
    return rounded(ev.class_report(predictions(spark, sf), ["dataset"]), "precision", "recall", "f1")


def sql_latency(keys: str, source: str = SQL_PRED) -> str:
    return f"""SELECT {keys}, count(ms)::BIGINT AS n, avg(ms) AS avg_ms, stddev_pop(ms) AS std_ms, min(ms) AS min_ms, max(ms) AS max_ms, sum(ms) AS sum_ms,
    quantile_cont(ms, 0.5) AS median_ms, quantile_cont(ms, 0.95) AS p95_ms, quantile_cont(ms, 0.99) AS p99_ms, quantile_cont(ms, 0.95) <= 200.0 AS target_met
    FROM ({source}) GROUP BY {keys}"""


LATENCY = ["avg_ms", "std_ms", "min_ms", "max_ms", "median_ms", "p95_ms", "p99_ms"]


@query("latency_profile", f"SELECT dataset, n, {sql_metrics({m: m for m in LATENCY})}, target_met FROM ({sql_latency('dataset')})")
def latency_profile(spark, sf):
    return rounded(ev.latency_profile(predictions(spark, sf), ["dataset"], "ms").drop("sum_ms"), *LATENCY)


def sql_findings() -> str:
    tests = ["avg_ms > 200.0", "std_ms > avg_ms*0.5", "p95_ms > avg_ms*2.0", "sum_ms > max_ms*1.5"]
    return "[" + ", ".join(f"CASE WHEN {t} THEN '{a}' END" for t, (a, _) in zip(tests, ev.FINDINGS)) + "]"


@query(
    "bottlenecks",
    f"""SELECT dataset, finding, MAP {{{', '.join(f"'{a}': '{b}'" for a, b in ev.FINDINGS)}}}[finding] AS advice FROM
    (SELECT dataset, unnest({sql_findings()}) AS finding FROM (SELECT * REPLACE (avg_ms*20 AS avg_ms, std_ms*20 AS std_ms, p95_ms*20 AS p95_ms) FROM ({sql_latency('dataset')})))
    WHERE finding IS NOT NULL""",
)
def bottlenecks(spark, sf):
    slow = ev.latency_profile(predictions(spark, sf), ["dataset"], "ms").withColumns(
        {c: F.col(c) * 20 for c in ("avg_ms", "std_ms", "p95_ms")}
    )
    return ev.bottlenecks(slow, ["dataset"], "sum_ms")


@query(
    "throughput",
    f"""SELECT dataset, n, {sql_metrics({'seconds': 'seconds', 'per_second': 'n/seconds'})} FROM
    (SELECT dataset, count(*)::BIGINT AS n, (epoch_us(max(ts))-epoch_us(min(ts)))/1e6 AS seconds FROM ({SQL_PRED}) GROUP BY dataset)""",
)
def throughput(spark, sf):
    return rounded(ev.throughput(predictions(spark, sf), ["dataset"], "ts"), "seconds", "per_second")


SQL_EVAL = f"""WITH {sql_scores('dataset, run')}, cf AS ({sql_conf('dataset, run')}), la AS ({sql_latency('dataset, run')}),
    a1 AS (SELECT dataset, run, {SQL_AUC_ROC} AS auc_roc FROM cu GROUP BY ALL), a2 AS (SELECT dataset, run, {SQL_AUC_PR} AS auc_pr FROM pr GROUP BY ALL),
    mt AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in {**SQL_PRF, **SQL_RATES}.items())} FROM cf),
    ev AS (SELECT * FROM mt JOIN a1 USING (dataset, run) JOIN a2 USING (dataset, run) JOIN la USING (dataset, run))"""
METRICS = [*SQL_PRF, *SQL_RATES, "auc_roc", "auc_pr", *LATENCY]


@query("evaluate", f"{SQL_EVAL} SELECT dataset, run, tp, tn, fp, fn, n, target_met, {sql_metrics({m: m for m in METRICS})} FROM ev")
def evaluate(spark, sf):
    return rounded(ev.evaluate(predictions(spark, sf), ["dataset", "run"]), *METRICS)


@query(
    "evaluation_summary",
    f"""{SQL_EVAL}, z AS (SELECT * FROM ev WHERE run = 2), a AS (SELECT * FROM ev WHERE run = 1)
    SELECT z.dataset, 2::BIGINT AS total_evaluations, {sql_metrics({'accuracy': 'z.accuracy', 'f1': 'z.f1', 'fnr': 'z.fnr',
    'accuracy_improvement': 'z.accuracy-a.accuracy', 'f1_improvement': 'z.f1-a.f1', 'fnr_improvement': 'a.fnr-z.fnr', 'performance_improvement': 'a.avg_ms-z.avg_ms'})},
    z.fnr <= 0.05 AS fnr_target_met, z.target_met AS processing_target_met FROM z JOIN a USING (dataset)""",
)
def evaluation_summary(spark, sf):
    runs = ev.evaluate(predictions(spark, sf), ["dataset", "run"])
    s = ev.evaluation_summary(runs, ["dataset"], "run")
    return rounded(s, "accuracy", "f1", "fnr", "accuracy_improvement", "f1_improvement", "fnr_improvement", "performance_improvement")


@query(
    "compare_evaluations",
    f"""{SQL_EVAL}, l AS (UNPIVOT (SELECT dataset, run, accuracy, f1, fnr, auc_roc FROM ev) ON accuracy, f1, fnr, auc_roc INTO NAME metric VALUE v)
    SELECT dataset, metric, round(max(v) FILTER (WHERE run = 1), 6) + 0.0 AS run_1, round(max(v) FILTER (WHERE run = 2), 6) + 0.0 AS run_2 FROM l GROUP BY ALL""",
)
def compare_evaluations(spark, sf):
    runs = ev.evaluate(predictions(spark, sf), ["dataset", "run"])
    c = ev.compare_evaluations(runs, ["dataset"], "run", [1, 2], ["accuracy", "f1", "fnr", "auc_roc"])
    return rounded(c.withColumnsRenamed({"1": "run_1", "2": "run_2"}), "run_1", "run_2")


SQL_VOTES = f"SELECT event_id, y_true, unnest([score, ((k*13+event_id)%1000)/1000.0::DOUBLE, ((k*7+event_id*3)%1000)/1000.0::DOUBLE]) AS p FROM ({SQL_PRED})"


def votes(spark, sf):
    """Three members' probabilities per row."""
    p = predictions(spark, sf)
    members = F.array("score", (F.col("k") * 13 + F.col("event_id")) % 1000 / 1000.0, (F.col("k") * 7 + F.col("event_id") * 3) % 1000 / 1000.0)
    return p.select("event_id", "y_true", F.explode_outer(members).alias("p"))


@query(
    "ensemble_metrics",
    f"""WITH r AS (SELECT event_id, (avg(p) > 0.5)::INT AS y_pred, var_pop((p > 0.5)::INT) AS v, any_value(y_true) AS y_true FROM ({SQL_VOTES}) GROUP BY event_id),
    c AS (SELECT {SQL_CONF} FROM r), s AS (SELECT avg(v) AS pv, avg((v < 0.25)::INT) AS ag FROM r)
    SELECT tp, tn, fp, fn, {sql_metrics({**SQL_PRF, **SQL_RATES})}, {sql_r6('pv')} AS prediction_variance, {sql_r6('ag')} AS ensemble_agreement FROM c, s""",
)
def ensemble_metrics(spark, sf):
    return rounded(ev.ensemble_metrics(votes(spark, sf), "event_id", "p", "y_true"), *SQL_PRF, *SQL_RATES, "prediction_variance", "ensemble_agreement")


SQL_CE = "(-ln(greatest(CASE WHEN y_true = 1 THEN score ELSE 1.0-score END, 1e-12)))"
SQL_FOCAL = f"(0.25*power(1.0-exp(-{SQL_CE}), 2.0)*{SQL_CE})"
SQL_FNR = f"({SQL_CE}*CASE WHEN score <= 0.5 AND y_true = 1 THEN 3.0 ELSE 1.0 END)"


@query("focal_loss", f"SELECT dataset, {sql_r6(f'avg({SQL_FOCAL})')} AS focal_loss FROM ({SQL_PRED}) GROUP BY dataset")
def focal_loss(spark, sf):
    return rounded(ev.losses(predictions(spark, sf), ["dataset"], "score", "y_true").select("dataset", "focal_loss"), "focal_loss")


@query(
    "fnr_loss",
    f"SELECT dataset, {sql_r6(f'avg({SQL_FNR})')} AS fnr_loss, {sql_r6(f'avg(0.7*{SQL_FOCAL}+0.3*{SQL_FNR})')} AS mixed_loss FROM ({SQL_PRED}) GROUP BY dataset",
)
def fnr_loss(spark, sf):
    out = ev.losses(predictions(spark, sf), ["dataset"], "score", "y_true").select("dataset", "fnr_loss", "mixed_loss")
    return rounded(out, "fnr_loss", "mixed_loss")


@query(
    "histogram",
    f"""WITH p AS ({SQL_PRED}), b AS (SELECT dataset, min(ms) AS lo, max(ms) AS hi, (max(ms)-min(ms))/50 AS w FROM p GROUP BY dataset)
    SELECT dataset, bin, count(*)::BIGINT AS n, {sql_r6('any_value(lo+bin*w)')} AS from_value FROM
    (SELECT dataset, lo, w, least(floor((ms-lo)/w), 49)::BIGINT AS bin FROM p JOIN b USING (dataset)) GROUP BY dataset, bin""",
)
def histogram(spark, sf):
    return rounded(ev.histogram(predictions(spark, sf), ["dataset"], "ms"), "from_value")


@query(
    "training_summary",
    f"""{SQL_EVAL}, l AS (UNPIVOT (SELECT dataset, run, accuracy, f1, fnr AS miss_loss FROM ev) ON accuracy, f1, miss_loss INTO NAME metric VALUE v)
    SELECT dataset, metric, round(max_by(v, run), 6) + 0.0 AS final, round(CASE WHEN any_value(metric) LIKE '%loss%' THEN min(v) ELSE max(v) END, 6) + 0.0 AS best FROM l GROUP BY ALL""",
)
def training_summary(spark, sf):
    runs = ev.evaluate(predictions(spark, sf), ["dataset", "run"]).withColumn("miss_loss", F.col("fnr"))
    long = runs.unpivot(["dataset", "run"], ["accuracy", "f1", "miss_loss"], "metric", "v")
    return rounded(ev.training_summary(long, ["dataset"], "run", "v"), "final", "best")


SQL_SCORED_RUN = f"""SELECT p.prompt_id, truth AS y_true, is_malicious::INT AS y_pred, risk_score AS score, 'mixed' AS dataset, value AS ms
    FROM ({SQL_MIXED}) p JOIN ({fq.ORACLE['prompt_risk']}) r USING (prompt_id) LEFT JOIN events ON event_id = {sql_hashed('prompt_id', '(SELECT count(*) FROM events)')}"""


@query(
    "engine_evaluation",
    f"""WITH {sql_scores('dataset', 'SELECT * FROM run')}, cf AS ({sql_conf('dataset', 'SELECT * FROM run')}),
    a1 AS (SELECT dataset, {SQL_AUC_ROC} AS auc_roc FROM cu GROUP BY dataset), la AS ({sql_latency('dataset', 'SELECT * FROM run')})
    SELECT dataset, tp, tn, fp, fn, {sql_metrics({**SQL_PRF, 'fnr': SQL_RATES['fnr'], 'auc_roc': 'auc_roc', 'avg_ms': 'avg_ms', 'p95_ms': 'p95_ms'})}, target_met
    FROM cf JOIN a1 USING (dataset) JOIN la USING (dataset)""".replace("WITH ", f"WITH run AS MATERIALIZED ({SQL_SCORED_RUN}), ", 1),
)
def engine_evaluation(spark, sf):
    """The full score against the truth of the mixed prompts. Prompts carry no durations: each takes that of an event, drawn by
    the hash of its id."""
    p, events = mixed_prompts(spark, sf), load(spark, sf, "events")
    scored = prompt_risk_query(spark, sf).select("prompt_id", F.col("is_malicious").cast("int").alias("y_pred"), F.col("risk_score").alias("score"))
    timed = p.join(scored, "prompt_id").withColumn("event_id", hashed(F.col("prompt_id"), max(events.count(), 1)).cast("long"))
    timed = timed.join(events.select("event_id", F.col("value").alias("ms")), "event_id", "left")
    run = checkpointed(timed.select(F.lit("mixed").alias("dataset"), F.col("truth").alias("y_true"), "y_pred", "score", "ms"))
    counts = ev.confusion(run, ["dataset"]).withColumns({**ev.prf_columns(), **ev.rate_columns()})
    latency = ev.latency_profile(run, ["dataset"], "ms").select("dataset", "avg_ms", "p95_ms", "target_met")
    e = counts.join(ev.auc_roc(run, ["dataset"]), "dataset").join(latency, "dataset")
    e = e.select("dataset", "tp", "tn", "fp", "fn", *SQL_PRF, "fnr", "auc_roc", "avg_ms", "p95_ms", "target_met")
    return rounded(e, *SQL_PRF, "fnr", "auc_roc", "avg_ms", "p95_ms")
