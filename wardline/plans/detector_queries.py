"""Queries over the basic and the sixteen-feature detectors, on prompts with and without attack openers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import vectors as vx
from wardline.operators import detectors as dt
from wardline.operators import enhanced as en
from wardline.plans.common import (
    NUDGE, SQL_MIXED, load, mixed_prompts, r6, rounded, section, sql_buckets, sql_overlap, sql_r6, sql_words,
)
from wardline.plans.text_queries import (
    SPECIAL, SQL_LINGUISTIC, SQL_NATURALNESS, UPPER, sql_action, sql_ratio,
)
from wardline.plans.vector_queries import (
    SQL_OUTLIER, SQL_SENT, analyzed, sql_analysis, sql_component_variance,
)

QUERIES, ORACLE, query = section()

W = sql_words("text")
ESA_SCALE = 4.0  # radius-1 windows move at most ~.8 per token, so the default of 10 never fires

SQL_DETECT = f"""{sql_analysis(SQL_MIXED)},
    g AS (SELECT prompt_id, sqrt(greatest(2.0 - 2.0*c, 0.0)) AS g FROM adj),
    gs AS (SELECT prompt_id, avg(g) AS mean_g, stddev_pop(g) AS sd_g, max(g) AS max_g FROM g GROUP BY prompt_id),
    gn AS (SELECT prompt_id, count(*) FILTER (WHERE g > mean_g + 2.0*sd_g) AS far FROM g JOIN gs USING (prompt_id) GROUP BY prompt_id),
    an AS (SELECT prompt_id, count(*) AS n, avg(anomaly) AS mean_a, stddev_pop(anomaly) AS sd_a, max(anomaly) AS max_a,
      least(1.0, 0.7*avg(anomaly) + 0.3*avg((anomaly > 0.6)::INT)) AS overall, count(*) FILTER (WHERE anomaly > 0.6) AS n_anom,
      count(*) FILTER (WHERE anomaly > 0.6 AND max_sim > 0.7) AS masked, avg(max_sim) AS mean_sim, min(max_sim) AS min_sim,
      avg(length(token)) AS avg_len FROM anom GROUP BY prompt_id),
    sh AS (SELECT prompt_id, count(*) AS n_shift, count(*) FILTER (WHERE 1.0-c > 0.5) AS strong,
      count(*) FILTER (WHERE type = 'window_based_shift') AS windows, max(1.0-c) AS max_shift FROM shifts GROUP BY prompt_id),
    joined AS (SELECT p.prompt_id, p.text, p.truth, n, mean_a, sd_a, max_a, overall, n_anom, masked, mean_sim, min_sim, avg_len,
      coalesce(n_shift, 0) AS n_shift, coalesce(strong, 0) AS strong, coalesce(windows, 0) AS windows, coalesce(max_shift, 0.0) AS max_shift,
      coalesce(far, 0) AS far, coalesce(mean_g, 0.0) AS mean_g, coalesce(least(1.0, max_g/{ESA_SCALE}), 0.0) AS esa_size
      FROM ({SQL_MIXED}) p JOIN an USING (prompt_id) LEFT JOIN sh USING (prompt_id) LEFT JOIN gs USING (prompt_id) LEFT JOIN gn USING (prompt_id)),
    flags AS (SELECT *, ((strong > 2)::INT + (masked > n*0.2)::INT + (((1.0-overall) - (1.0 - masked::DOUBLE/n)) > 0.3)::INT
      + (windows > 1)::INT) / 4.0::DOUBLE AS cap_score FROM joined),
    det AS (SELECT *, esa_size > 1.0-0.8 AS esa_hit, cap_score >= 1.0-0.75 AS cap_hit, (mean_a > 0.7 OR sd_a > 0.3) AS stat_hit,
      CASE WHEN esa_size > 1.0-0.8 THEN esa_size ELSE 0.0 END AS esa_conf, CASE WHEN cap_score >= 1.0-0.75 THEN cap_score ELSE 0.0 END AS cap_conf,
      CASE WHEN mean_a > 0.7 OR sd_a > 0.3 THEN least(1.0, (mean_a+sd_a)/2.0) ELSE 0.0 END AS stat_conf FROM flags),
    scored AS (SELECT *, greatest(esa_conf, cap_conf, stat_conf) AS conf,
      least(1.0, greatest(esa_conf*0.9, cap_conf*0.8, stat_conf*0.6)) AS attack_risk,
      list_filter([CASE WHEN esa_hit THEN 'ESA' END, CASE WHEN cap_hit THEN 'CAP' END, CASE WHEN stat_hit THEN 'STATISTICAL_ANOMALY' END],
        lambda x: x IS NOT NULL) AS attacks,
      list_filter([CASE WHEN esa_hit THEN '- Embedding Shift Attack: '||far||' perturbations detected' END,
        CASE WHEN cap_hit THEN '- Contrastive Adversarial Prompting: '||printf('%.2f', round(cap_score,2))||' manipulation score' END,
        CASE WHEN stat_hit THEN '- Statistical Anomaly: '||printf('%.2f', round(mean_a,2))||' anomaly ratio' END], lambda x: x IS NOT NULL) AS said FROM det)"""

SQL_DETECTION_TEXT = """CASE WHEN len(said) = 0 THEN 'No adversarial attacks detected. The prompt appears to be legitimate.' ELSE
    'Detected '||len(said)||' potential attack(s) with '||printf('%.2f', round(conf,2))||' confidence: '||array_to_string(said, ' ') END"""


def analysed_mixed(spark, sf):
    return analyzed(spark, sf, mixed_prompts(spark, sf))


@query(
    "cap",
    f"WITH {SQL_DETECT} SELECT prompt_id, cap_score, cap_hit AS hit, cap_conf AS confidence FROM det",
)
def cap(spark, sf):
    v = analysed_mixed(spark, sf).withColumn("v", dt.cap())
    return v.select(
        "prompt_id", F.col("v.measure").alias("cap_score"), F.col("v.hit").alias("hit"), F.col("v.confidence").alias("confidence")
    )


@query(
    "stat_anomaly_basic",
    f"""WITH {SQL_DETECT} SELECT prompt_id, {sql_r6('mean_a')} AS mean_anomaly, stat_hit AS hit, {sql_r6('stat_conf')} AS confidence FROM det""",
)
def stat_anomaly_basic(spark, sf):
    v = analysed_mixed(spark, sf).withColumn("v", dt.statistical(F.col("anomaly")))
    return v.select(
        "prompt_id", r6(F.col("v.measure")).alias("mean_anomaly"), F.col("v.hit").alias("hit"), r6(F.col("v.confidence")).alias("confidence")
    )


@query(
    "classifier_features",
    f"""WITH {SQL_DETECT} SELECT prompt_id, length(text)::DOUBLE AS prompt_length, n::DOUBLE AS num_tokens, {sql_r6('avg_len')} AS avg_token_length,
    {sql_r6('mean_a')} AS mean_anomaly, {sql_r6('max_a')} AS max_anomaly, {sql_r6('sd_a')} AS std_anomaly, n_shift::DOUBLE AS num_shifts,
    {sql_r6('max_shift')} AS max_shift, {sql_r6('mean_sim')} AS mean_similarity, {sql_r6('min_sim')} AS min_similarity,
    {sql_r6('overall')} AS overall_anomaly, (n_anom + n_shift)::DOUBLE AS num_anomalies FROM det""",
)
def classifier_features(spark, sf):
    f = analysed_mixed(spark, sf).select("prompt_id", *[c.alias(n) for n, c in dt.classifier_features().items()])
    return rounded(f, *dt.CLASSIFIER_FEATURES)


@query(
    "attack_risk",
    f"""SELECT event_id, {sql_r6('least(1.0, greatest(a*0.9, b*0.8, c*0.6, d*0.7, 0.5*e))')} AS risk FROM
    (SELECT event_id, k/100.0 AS a, ((k*7)%100)/100.0 AS b, ((k*13)%100)/100.0 AS c, ((k*29)%100)/100.0 AS d, least(value/100.0, 1.0) AS e
     FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))""",
)
def attack_risk(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    scores = {
        "ESA": k / 100.0, "CAP": (k * 7) % 100 / 100.0, "STATISTICAL_ANOMALY": (k * 13) % 100 / 100.0,
        "ENSEMBLE_CLASSIFIER": (k * 29) % 100 / 100.0, "OTHER": F.least(F.col("value") / 100.0, F.lit(1.0)),
    }
    return load(spark, sf, "events").select("event_id", r6(dt.attack_risk(scores)).alias("risk"))


@query(
    "detect_attacks",
    f"""WITH {SQL_DETECT} SELECT prompt_id, array_to_string(attacks, ',') AS attacks, {sql_r6('conf')} AS confidence,
    {sql_r6('attack_risk')} AS risk, len(attacks) > 0 AS is_adversarial, {SQL_DETECTION_TEXT} AS explanation FROM scored""",
)
def detect_attacks(spark, sf):
    d = dt.detect_attacks(analysed_mixed(spark, sf), esa_scale=ESA_SCALE)
    return d.select(
        "prompt_id", F.array_join("attacks", ",").alias("attacks"), r6(F.col("detection_confidence")).alias("confidence"),
        r6(F.col("attack_risk")).alias("risk"), "is_adversarial", F.col("detection_text").alias("explanation"),
    )


SQL_BROKEN = "(t IS NULL OR regexp_replace(t, '[\\s\\x{00A0}\\x{3000}]+', '', 'g') = '')"


@query(
    "fail_safe",
    f"""SELECT prompt_id, {SQL_BROKEN} AS error, CASE WHEN {SQL_BROKEN} THEN 'DETECTION_ERROR' ELSE '' END AS error_attack,
    (CASE WHEN {SQL_BROKEN} THEN 1.0 ELSE 0.0 END)::DOUBLE AS error_confidence FROM
    (SELECT conv_id||':'||turn AS prompt_id, CASE turn % 5 WHEN 1 THEN NULL WHEN 3 THEN '  ' ELSE text END AS t FROM conversations)""",
)
def fail_safe(spark, sf):
    """Null and blank texts keep their row and count as attacks."""
    c = load(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("prompt_id"),
        F.when(F.col("turn") % 5 == 1, None).when(F.col("turn") % 5 == 3, "  ").otherwise(F.col("text")).alias("text"),
    )
    d = dt.detect_attacks(analyzed(spark, sf, c), esa_scale=ESA_SCALE)
    failed = F.array_contains("attacks", "DETECTION_ERROR")
    return d.select(
        "prompt_id", failed.alias("error"), F.when(failed, F.array_join("attacks", ",")).otherwise("").alias("error_attack"),
        F.when(failed, F.col("detection_confidence")).otherwise(0.0).alias("error_confidence"),
    )


# --- sixteen features --------------------------------------------------------------------

SQL_FEATURES = f"""{SQL_DETECT},
    sd AS (SELECT prompt_id, pos, x AS dim, count(*) AS c, any_value(m) AS m FROM (SELECT prompt_id, pos, m, unnest(s) AS x FROM span) GROUP BY prompt_id, pos, x),
    dm AS (SELECT prompt_id, dim, sum(c/sqrt(m::DOUBLE)) AS s1, sum(c*c/m::DOUBLE) AS s2 FROM sd GROUP BY prompt_id, dim),
    dims AS (SELECT prompt_id, any_value(n) AS n, list(coalesce(s1,0.0)/n) AS means, list(coalesce(s2,0.0)/n - (coalesce(s1,0.0)/n)*(coalesce(s1,0.0)/n)) AS vars
      FROM (SELECT prompt_id, n, d AS dim FROM an, (SELECT unnest(range(64)) AS d)) LEFT JOIN dm USING (prompt_id, dim) GROUP BY prompt_id),
    uni AS (SELECT prompt_id, any_value(1.0/64.0 - power(sw/(64.0*n), 2)) AS embedding_variance FROM
      (SELECT prompt_id, sum(len(s)/sqrt(m::DOUBLE)) AS sw, count(*) AS n FROM span GROUP BY prompt_id) GROUP BY prompt_id),
    pd AS (SELECT sd.prompt_id, sd.pos, sum(sd.c * (dm.s1/an.n) / sqrt(sd.m::DOUBLE)) AS dot FROM sd JOIN dm USING (prompt_id, dim) JOIN an USING (prompt_id) GROUP BY ALL),
    cn AS (SELECT prompt_id, sum((s1/n)*(s1/n)) AS cc FROM dm JOIN an USING (prompt_id) GROUP BY prompt_id),
    ds AS (SELECT prompt_id, sqrt(greatest(1.0 - 2.0*dot + cc, 0.0)) AS dist FROM pd JOIN cn USING (prompt_id)),
    ol AS (SELECT prompt_id, {SQL_OUTLIER} AS outlier FROM ds GROUP BY prompt_id),
    sg AS (SELECT prompt_id, CASE WHEN n < 3 THEN 0.0 ELSE least(greatest(1.0 - list_stddev_pop(vars)/(list_avg(vars)+1e-8), 0.0), 1.0) END AS signature FROM dims),
    ww AS (SELECT prompt_id, {W} AS w, b FROM tok JOIN ({SQL_MIXED}) USING (prompt_id)),
    wd AS (SELECT prompt_id, unnest(range(64)) AS i, list_transform(range(64), lambda d: len(list_filter(b, lambda y: y = d))) AS cv, {sql_overlap('b','b')} AS bm FROM ww),
    gr AS (SELECT prompt_id, sqrt(sum(power((cv[least(i+1,63)+1]-cv[greatest(i-1,0)+1])/sqrt(bm::DOUBLE)/(least(i+1,63)-greatest(i-1,0)), 2))) AS gradient FROM wd GROUP BY prompt_id),
    sent AS (SELECT prompt_id, unnest({SQL_SENT}) AS b, unnest(range(len(string_split(text,'.')))) AS i FROM ({SQL_MIXED})),
    sn AS (SELECT prompt_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE len(b) > 0)::DOUBLE AS f,
      sum(coalesce(len(b)/nullif(sqrt({sql_overlap('b', 'b')}::DOUBLE), 0), 0)) AS k FROM sent GROUP BY prompt_id),
    sc AS (SELECT prompt_id, i, x, count(*) AS c FROM (SELECT prompt_id, i, unnest(b) AS x FROM sent) GROUP BY ALL),
    su AS (SELECT prompt_id, x, c / sqrt(sum(c*c) OVER (PARTITION BY prompt_id, i)) AS u FROM sc),
    sq AS (SELECT prompt_id, sum(t*t) AS sq FROM (SELECT prompt_id, x, sum(u) AS t FROM su GROUP BY ALL) GROUP BY prompt_id),
    tri AS (SELECT prompt_id, unnest([b[i+1:i+3] for i in range(len(b)-2)]) AS s FROM tok WHERE len(b) >= 3),
    ph AS (SELECT prompt_id, count(*)::DOUBLE AS n, sum(3.0/sqrt({sql_overlap('s', 's')}::DOUBLE)) AS k FROM tri GROUP BY prompt_id),
    fq AS (SELECT prompt_id, max(c)::DOUBLE/sum(c) AS freq FROM (SELECT prompt_id, t, count(*) AS c FROM (SELECT prompt_id, unnest(w) AS t FROM tok) GROUP BY ALL) GROUP BY prompt_id),
    en AS (SELECT prompt_id, CASE WHEN count(*) > 1 THEN -sum(p*ln(p+1e-8))/ln(count(*)) ELSE 0.0 END AS entropy FROM
      (SELECT prompt_id, anomaly / (sum(anomaly) OVER (PARTITION BY prompt_id) + 1e-8) AS p FROM anom) GROUP BY prompt_id),
    feat0 AS (SELECT s.*, embedding_variance, coalesce(gradient, 0.0) AS gradient_magnitude, CASE WHEN s.n < 2 THEN 1.0 ELSE 1.0/(1.0+mean_g) END AS embedding_smoothness,
      signature AS perturbation_signature, CASE WHEN sn.n < 2 THEN 1.0 ELSE (coalesce(sq.sq,0.0) - sn.f)/(sn.n*(sn.n-1.0)) END AS semantic_consistency,
      0.8::DOUBLE AS paraphrase_similarity, 0.2::DOUBLE AS intent_deviation, {SQL_NATURALNESS} AS linguistic_naturalness, freq AS token_frequency_anomaly,
      outlier AS embedding_outlier_score, entropy AS position_entropy, 0.3::DOUBLE AS attention_divergence, overall AS token_level_anomaly,
      coalesce({sql_component_variance('ph.k', 'ph.n', 'ph.n')}, 0.0) AS phrase_level_anomaly,
      CASE WHEN sn.n >= 2 THEN {sql_component_variance('sn.k', 'sn.f', 'sn.n')} ELSE 0.0 END AS sentence_level_anomaly
      FROM scored s JOIN uni USING (prompt_id) JOIN gr USING (prompt_id) JOIN sg USING (prompt_id) JOIN sn USING (prompt_id) LEFT JOIN sq USING (prompt_id)
      JOIN fq USING (prompt_id) JOIN ol USING (prompt_id) JOIN en USING (prompt_id) LEFT JOIN ph USING (prompt_id)),
    feat AS (SELECT *, least(greatest(1.0 - list_stddev_pop([token_level_anomaly, phrase_level_anomaly, sentence_level_anomaly]), 0.0), 1.0) AS cross_level_consistency FROM feat0)"""


def featured(spark, sf):
    return en.features16(analysed_mixed(spark, sf), radius=1)


@query("features16", f"WITH {SQL_FEATURES} SELECT prompt_id, {', '.join(f'{sql_r6(f)} AS {f}' for f in en.FEATURES)} FROM feat")
def features16(spark, sf):
    return rounded(featured(spark, sf).select("prompt_id", *en.FEATURES), *en.FEATURES)


# Cheap feature rows for the scores themselves: sixteen values per event from the parameter k.
def event_features(spark, sf):
    e = load(spark, sf, "events").withColumn("_k", F.get_json_object("props", "$.k").cast("int") + F.col("event_id").cast("int"))
    return e.select(
        "event_id", F.col("event_type").alias("text"), F.col("value"),
        *[((F.col("_k") * (2 * i + 3)) % 101 / 100.0).alias(n) for i, n in enumerate(en.FEATURES)],
    )


SQL_EVENT_FEATURES = (
    "SELECT event_id, event_type AS text, value, "
    + ", ".join(f"((k*{2 * i + 3}) % 101)/100.0::DOUBLE AS {n}" for i, n in enumerate(en.FEATURES))
    + " FROM (SELECT *, (props->>'$.k')::INT + event_id::INT AS k FROM events)"
)
SQL_ESA = "(0.3*embedding_variance + 0.4*gradient_magnitude + 0.2*(1.0-embedding_smoothness) + 0.1*perturbation_signature)"
SQL_CAP = """(0.35*(1.0-semantic_consistency) + 0.25*(1.0-paraphrase_similarity) + 0.25*intent_deviation
    + 0.15*(1.0-linguistic_naturalness))"""
SQL_GRAN = """(greatest(token_level_anomaly, phrase_level_anomaly, sentence_level_anomaly) + 0.3*(1.0-cross_level_consistency))"""
SQL_SEM = "(1.0 - (semantic_consistency + (1.0-intent_deviation) + linguistic_naturalness)/3.0)"


def _score_query(name, fn, sql, cut):
    @query(
        name,
        f"SELECT event_id, {sql_r6(sql)} AS score, round({sql}, 9) > {cut} AS hit FROM ({SQL_EVENT_FEATURES})",
    )
    def run(spark, sf):
        score = fn(en.feature_columns())
        return event_features(spark, sf).select("event_id", r6(score).alias("score"), (F.round(score, 9) > cut).alias("hit"))


_score_query("esa_enhanced", en.esa_score, SQL_ESA, 0.8)
_score_query("cap_enhanced", en.cap_score, SQL_CAP, 0.75)
_score_query("multi_granularity", en.granularity_score, SQL_GRAN, 0.7)
_score_query("semantic_check", en.semantic_score, SQL_SEM, 0.4)

@query(
    "feature_scores",
    f"""WITH {SQL_FEATURES} SELECT prompt_id, {', '.join(f"{sql_r6(f'{e} + {NUDGE}')} AS {n}" for n, e in (('esa', SQL_ESA), ('cap', SQL_CAP), ('granularity', SQL_GRAN), ('semantic', SQL_SEM)))} FROM feat""",
)
def feature_scores(spark, sf):
    """The four scores on the features of prompts."""
    f = en.feature_columns()
    scores = {"esa": en.esa_score(f), "cap": en.cap_score(f), "granularity": en.granularity_score(f), "semantic": en.semantic_score(f)}
    return rounded(featured(spark, sf).select("prompt_id", *[c.alias(n) for n, c in scores.items()]), *scores, nudge=NUDGE)


SQL_JUDGED = f"""base AS (SELECT *, {SQL_ESA} AS e1, {SQL_CAP} AS e2, {SQL_GRAN} AS e3, 0.0::DOUBLE AS e4, {SQL_SEM} AS e5 FROM (@source)),
    hit AS (SELECT *, list_filter([CASE WHEN e1 > 0.8 THEN 'ESA' END, CASE WHEN e2 > 0.75 THEN 'CAP' END, CASE WHEN e3 > 0.7 THEN 'MULTI_GRANULARITY' END,
        CASE WHEN e5 > 0.4 THEN 'SEMANTIC_INCONSISTENCY' END], lambda x: x IS NOT NULL) AS hits,
      greatest(CASE WHEN e1 > 0.8 THEN e1 ELSE 0.0 END, CASE WHEN e2 > 0.75 THEN e2 ELSE 0.0 END, CASE WHEN e3 > 0.7 THEN e3 ELSE 0.0 END,
        CASE WHEN e5 > 0.4 THEN e5 ELSE 0.0 END) AS best, list_stddev_pop([e1, e2, e3, e4, e5]) AS unc,
      (e1 > 0.5)::INT + (e2 > 0.5)::INT + (e3 > 0.5)::INT + (e5 > 0.5)::INT AS half FROM base),
    jud AS (SELECT *, least(greatest(half/5.0 + 0.5*(gradient_magnitude + semantic_consistency + cross_level_consistency)/3.0, 0.0), 1.0) AS soph,
      CASE WHEN len(hits) > 0 THEN least(greatest(0.4*(len(hits)/7.0) + 0.4*best + 0.2*((perturbation_signature + intent_deviation
        + (1.0-semantic_consistency))/3.0) - 0.3*unc, 0.0), 1.0) ELSE 0.0 END AS erisk FROM hit)"""


def sql_judged(source: str) -> str:
    return SQL_JUDGED.replace("@source", source)


@query(
    "aggregate_detections",
    f"""WITH {sql_judged(SQL_EVENT_FEATURES)} SELECT event_id, array_to_string(hits, ',') AS attacks, {sql_r6('best')} AS confidence,
    {sql_r6('unc')} AS uncertainty FROM jud""",
)
def aggregate_detections(spark, sf):
    d = en.detect_enhanced(event_features(spark, sf))
    return rounded(d.select("event_id", F.array_join("attacks", ",").alias("attacks"), "confidence", "uncertainty"), "confidence", "uncertainty")


@query("sophistication", f"WITH {sql_judged(SQL_EVENT_FEATURES)} SELECT event_id, {sql_r6('soph')} AS sophistication FROM jud")
def sophistication(spark, sf):
    return rounded(en.detect_enhanced(event_features(spark, sf)).select("event_id", "sophistication"), "sophistication")


@query("enhanced_risk", f"WITH {sql_judged(SQL_EVENT_FEATURES)} SELECT event_id, {sql_r6('erisk')} AS risk FROM jud")
def enhanced_risk(spark, sf):
    return rounded(en.detect_enhanced(event_features(spark, sf)).select("event_id", "risk"), "risk")


@query(
    "detect_enhanced",
    f"""WITH {SQL_FEATURES}, {sql_judged('SELECT * FROM feat')} SELECT prompt_id, array_to_string(hits, ',') AS attacks, {sql_r6('best')} AS confidence,
    {sql_r6('unc')} AS uncertainty, {sql_r6('soph')} AS sophistication, {sql_r6('erisk')} AS risk,
    {sql_action('len(hits) > 0', 'erisk', 'unc', 'soph')} AS action FROM jud""",
)
def detect_enhanced(spark, sf):
    d = en.detect_enhanced(featured(spark, sf).drop("attacks"))
    out = d.select(
        "prompt_id", F.array_join("attacks", ",").alias("attacks"), "confidence", "uncertainty", "sophistication", "risk", "action"
    )
    return rounded(out, "confidence", "uncertainty", "sophistication", "risk")


@query(
    "dynamic_threshold",
    f"""WITH s AS (SELECT lang, toxic = 1 AS pos, n_chars % 1009 / 1009.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
    p AS (SELECT lang, count(*)::BIGINT AS n, quantile_cont(score, 0.95) FILTER (WHERE pos) AS pp, quantile_cont(score, 0.05) FILTER (WHERE NOT pos) AS pn
      FROM s GROUP BY lang)
    SELECT lang, n, {sql_r6("CASE WHEN n >= 10 AND pp IS NOT NULL AND pn IS NOT NULL THEN least(greatest(0.5 + 0.1*((pp+pn)/2.0 - 0.5), 0.1), 0.9) ELSE 0.5 END")} AS threshold FROM p""",
)
def dynamic_threshold(spark, sf):
    rows = labelled_documents(spark, sf).select(
        "lang", (F.col("toxic") == 1).alias("pos"), (F.col("n_chars") % 1009 / 1009.0).alias("score")
    )
    t = en.dynamic_threshold(rows, ["lang"], "score", "pos", 0.5)
    return rounded(t.select("lang", "n", "threshold"), "threshold")


def labelled_documents(spark, sf):
    """Documents with their labels; both sides have one row per document, the join is on a unique key."""
    return load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
