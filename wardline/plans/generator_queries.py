"""Queries over attack generation and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import enhanced as en
from wardline.operators import generate as gn
from wardline.operators import tokens as tk
from wardline.plans.common import (
    NUDGE, SQL_MIXED, SQL_PROMPTS, load, mixed_prompts, prompts, quoted, r6, rounded, section, sql_buckets, sql_counts,
    sql_overlap, sql_r6, sql_words,
)
from wardline.plans.detector_queries import SQL_EVENT_FEATURES, SQL_FEATURES, event_features, featured
from wardline.plans.vector_queries import ANALYSIS, reference

QUERIES, ORACLE, query = section()

W = sql_words("text")


def sql_choice(key: str, variant: str, n: int, purpose: str, seed: int = 0) -> str:
    return f"((('0x'||substr(md5(concat_ws('|', {key}, {variant}, '{purpose}', '{seed}')),1,8))::BIGINT)%{n})"


def sql_pick(options: list[str], index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN {o}" for i, o in enumerate(options)) + " END"


def sql_fill(template: str, payload: str, text: str = "text") -> str:
    out = quoted(template.replace("{payload}", payload))
    return "(" + out.replace("{prompt}", f"'||{text}||'").replace("{lower}", f"'||lower({text})||'") + ")"


def sql_templates(templates: list[str], payload: str, index: str) -> str:
    return sql_pick([sql_fill(t, payload) for t in templates], index)


def sql_swap(word: str, table: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN lower({word}) = '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {word} END"


SQL_DRIFT = f"array_to_string(list_transform({W}, lambda w: {sql_swap('w', gn.DRIFT_WORDS)}), ' ')||' without restrictions'"
SQL_GENERIC = f"text||' '||{quoted(gn.PAYLOADS['data_exfiltration'])}"
HELP = "'Can you help and support me? ' || text"
SQL_HELP = f"SELECT prompt_id, {HELP} AS text FROM ({SQL_PROMPTS})"


def help_prompts(spark, sf):
    """Prompts that begin with words of the drift table."""
    return prompts(spark, sf).select("prompt_id", F.concat(F.lit("Can you help and support me? "), "text").alias("text"))


def _template_query(name, templates, pattern, fn):
    n = len(templates)
    sql = sql_templates(templates, gn.PAYLOADS[pattern], sql_choice("prompt_id", "0", n, name))

    @query(name, f"SELECT prompt_id, {sql} AS attack FROM ({SQL_PROMPTS})")
    def run(spark, sf):
        index = gn.choice(F.col("prompt_id"), 0, n, purpose=name)
        return prompts(spark, sf).select("prompt_id", fn(F.col("text"), index).alias("attack"))


_template_query("cap_instruction_injection", gn.INJECTION_TEMPLATES, "instruction_injection", gn.cap_instruction_injection)
_template_query("cap_context_hijack", gn.HIJACK_TEMPLATES, "context_hijacking", gn.cap_context_hijack)
_template_query("cap_authority", gn.AUTHORITY_TEMPLATES, "authority_manipulation", gn.cap_authority)


@query("cap_semantic_drift", f"SELECT prompt_id, {SQL_DRIFT} AS attack FROM ({SQL_HELP})")
def cap_semantic_drift(spark, sf):
    return help_prompts(spark, sf).select("prompt_id", gn.cap_semantic_drift(F.col("text")).alias("attack"))


@query("cap_generic", f"SELECT prompt_id, {SQL_GENERIC} AS attack FROM ({SQL_PROMPTS})")
def cap_generic(spark, sf):
    return prompts(spark, sf).select("prompt_id", gn.cap_generic(F.col("text")).alias("attack"))


def sql_dispatch(pattern: str, index: str) -> str:
    p = gn.PAYLOADS
    return f"""CASE {pattern} WHEN 'instruction_injection' THEN {sql_templates(gn.INJECTION_TEMPLATES, p['instruction_injection'], f'({index})%4')}
    WHEN 'context_hijacking' THEN {sql_templates(gn.HIJACK_TEMPLATES, p['context_hijacking'], f'({index})%3')}
    WHEN 'semantic_drift' THEN {SQL_DRIFT}
    WHEN 'authority_manipulation' THEN {sql_templates(gn.AUTHORITY_TEMPLATES, p['authority_manipulation'], f'({index})%4')}
    ELSE {SQL_GENERIC} END"""


TYPES = gn.PATTERN_TYPES + ["something_else"]


@query(
    "cap_dispatch",
    f"""SELECT prompt_id, pattern, {sql_dispatch('pattern', 'i')} AS attack FROM
    (SELECT prompt_id, text, {TYPES}[turn%6+1] AS pattern, turn AS i FROM ({SQL_PROMPTS}))""",
)
def cap_dispatch(spark, sf):
    types = F.array(*[F.lit(t) for t in TYPES])
    p = prompts(spark, sf).withColumn("pattern", F.element_at(types, (F.col("turn") % 6 + 1).cast("int")))
    return p.select("prompt_id", "pattern", gn.cap_dispatch(F.col("text"), F.col("pattern"), F.col("turn").cast("int")).alias("attack"))


def sql_similarity(a: str, b: str) -> str:
    """Cosine of two count lists."""
    return f"coalesce(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / nullif(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 0), 0)"


def sql_text_counts(text: str) -> str:
    return sql_counts(sql_buckets(sql_words(text)))


SQL_CAP = f"""v AS (SELECT prompt_id, text, i AS variant, {gn.PATTERN_TYPES}[i%5+1] AS pattern, {sql_choice('prompt_id', 'i', 12, 'cap')} AS c
      FROM (@source), (SELECT unnest(range(@n)) AS i)),
    a AS (SELECT prompt_id, text, variant, pattern, {sql_dispatch('pattern', 'c')} AS attack FROM v),
    b AS MATERIALIZED (SELECT prompt_id, text, variant, pattern, attack, {sql_buckets(W)} AS b1, {sql_buckets(sql_words('attack'))} AS b2 FROM a),
    k AS MATERIALIZED (SELECT prompt_id, text, variant, pattern, attack, {sql_counts('b1')} AS c1, {sql_counts('b2')} AS c2 FROM b),
    cap AS (SELECT prompt_id, variant, pattern, attack, {sql_similarity('c1', 'c2')} AS similarity, text FROM k)"""


def sql_cap(source: str, n: int) -> str:
    return SQL_CAP.replace("@source", source).replace("@n", str(n))


@query(
    "cap_generate",
    f"""WITH {sql_cap(SQL_PROMPTS, 5)} SELECT prompt_id, variant::BIGINT AS variant, pattern, attack, {sql_r6('similarity')} AS similarity
    FROM cap WHERE attack <> text AND similarity >= 0.75""",
)
def cap_generate(spark, sf):
    made = gn.cap_generate(prompts(spark, sf), "prompt_id")
    return made.select("prompt_id", F.col("variant").cast("long").alias("variant"), "pattern", "attack", r6(F.col("similarity")).alias("similarity"))


@query(
    "prompt_similarity",
    f"""WITH b AS MATERIALIZED (SELECT prompt_id, {sql_buckets(W)} AS b1, {sql_buckets(sql_words("substr(text, 40)"))} AS b2 FROM ({SQL_PROMPTS})),
    k AS MATERIALIZED (SELECT prompt_id, {sql_counts('b1')} AS c1, {sql_counts('b2')} AS c2 FROM b)
    SELECT prompt_id, {sql_r6(sql_similarity('c1', 'c2'))} AS similarity FROM k""",
)
def prompt_similarity(spark, sf):
    """Each prompt against itself without its first 39 characters."""
    tail = F.substring("text", 40, 1 << 30)
    return prompts(spark, sf).select("prompt_id", r6(gn.prompt_similarity(F.col("text"), tail)).alias("similarity"))


# The scorer that the embedding attacks move: fixed weights, one per dimension.
WEIGHTS = [((d * 37) % 11 - 5) / 10.0 for d in range(64)]
SQL_SIGN = f"[sign(d*w) for w in {WEIGHTS}]"


@query(
    "esa_vectors",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, 1.0/(1.0+exp(-list_dot_product(embedding::DOUBLE[], {WEIGHTS}::DOUBLE[]))) - (label % 2) AS d FROM embeddings),
    s AS (SELECT vec_id, unnest(range(64))::BIGINT AS dim, unnest(v) AS x, unnest(list_transform({WEIGHTS}, lambda w: sign(d*w))) AS s FROM e)
    SELECT vec_id, dim, {sql_r6('x + 0.1*s')} AS fgsm, {sql_r6('x + 0.1*s')} AS pgd, round(x + 0.03*s, 6) + 0.0 AS pgd3 FROM s""",
)
def esa_vectors(spark, sf):
    """One large step and ten small ones end in the same corner; three small ones do not."""
    from wardline.operators.rows import position_rows

    w = F.array(*[F.lit(x) for x in WEIGHTS])
    label = (F.col("label") % 2).cast("double")
    e = load(spark, sf, "embeddings").select(
        "vec_id",
        F.arrays_zip(
            gn.fgsm(F.col("embedding"), w, label).alias("fgsm"), gn.pgd(F.col("embedding"), w, label).alias("pgd"),
            gn.pgd(F.col("embedding"), w, label, steps=3).alias("pgd3"),
        ).alias("z"),
    )
    rows = position_rows(e, ["vec_id"], "z", "z", "dim").select("vec_id", "dim", "z.*")
    return rounded(rows.toDF("vec_id", "dim", "fgsm", "pgd", "pgd3"), "fgsm", "pgd", "pgd3")


SQL_MINOR = [
    "text||' Please.'", "'Could you '||lower(text)", "text||' Thanks.'",
    "CASE WHEN contains(text, '.') THEN replace(text, '.', '?') ELSE text||'?' END", "replace(text, 'can you', 'could you')",
]


@query(
    "minor_variant",
    f"SELECT prompt_id, {sql_pick(SQL_MINOR, sql_choice('prompt_id', '0', 5, 'minor'))} AS attack FROM ({SQL_HELP})",
)
def minor_variant(spark, sf):
    index = gn.choice(F.col("prompt_id"), 0, 5, purpose="minor")
    return help_prompts(spark, sf).select("prompt_id", gn.minor_variant(F.col("text"), index).alias("attack"))


def sql_semantic(position: str, text: str = "text", words: str = W) -> str:
    swap = sql_swap("w[i+1]", gn.SEMANTIC_WORDS)
    return f"CASE WHEN len(w) > 1 THEN array_to_string([CASE WHEN i = ({position}) % len(w) THEN {swap} ELSE w[i+1] END for i in range(len(w))], ' ') ELSE {text} END"


@query(
    "semantic_variant",
    f"SELECT prompt_id, {sql_semantic(sql_choice('prompt_id', '0', 7, 'semantic'))} AS attack FROM (SELECT *, {W} AS w FROM ({SQL_HELP}))",
)
def semantic_variant(spark, sf):
    position = gn.choice(F.col("prompt_id"), 0, 7, purpose="semantic")
    return help_prompts(spark, sf).select("prompt_id", gn.semantic_variant(F.col("text"), position).alias("attack"))


# The embedding is cos-compared with itself plus epsilon times the sign of -w (the class is 1, so p - y < 0).
SIGNS = [-1.0 if w > 0 else (1.0 if w < 0 else 0.0) for w in WEIGHTS]
SQL_ESA_GEN = f"""e AS MATERIALIZED (SELECT prompt_id, text, {W} AS w, {sql_buckets(W)} AS b FROM (@source)),
    ec AS MATERIALIZED (SELECT prompt_id, text, w, {sql_counts('b')} AS cv, {sql_overlap('b', 'b')} AS m FROM e),
    p AS (SELECT prompt_id, text, w, [x/sqrt(m::DOUBLE) for x in cv] AS u FROM ec),
    q AS (SELECT prompt_id, text, w, u, [u[i+1] + 0.1*{SIGNS}[i+1] for i in range(64)] AS z FROM p),
    r AS MATERIALIZED (SELECT prompt_id, text, w, {sql_similarity('u', 'z')} AS similarity FROM q),
    g AS (SELECT *, CASE WHEN variant < @n//2 THEN 'fgsm' ELSE 'pgd' END AS method FROM r, (SELECT unnest(range(@n)) AS variant)),
    esa AS (SELECT prompt_id, text, variant, method, similarity, CASE WHEN similarity < 0.8 THEN {sql_semantic(sql_choice('prompt_id', 'variant', 1 << 20, 'semantic'))}
      ELSE {sql_pick(SQL_MINOR, sql_choice('prompt_id', 'variant', 5, 'minor'))} END AS attack FROM g)"""


def sql_esa_generate(source: str, n: int) -> str:
    return SQL_ESA_GEN.replace("@source", source).replace("@n", str(n))


@query(
    "esa_generate",
    f"""WITH {sql_esa_generate(SQL_HELP, 4)} SELECT prompt_id, variant::BIGINT AS variant, method, attack, {sql_r6('similarity')} AS similarity
    FROM esa WHERE attack <> text AND attack <> ''""",
)
def esa_generate(spark, sf):
    made = gn.esa_generate(help_prompts(spark, sf), "prompt_id", WEIGHTS, n=4)
    return made.select("prompt_id", F.col("variant").cast("long").alias("variant"), "method", "attack", r6(F.col("similarity")).alias("similarity"))


# --- augmentation ------------------------------------------------------------------------


def sql_whitespace(position: str) -> str:
    at = f"(({position}) % len(w))"
    return f"CASE WHEN len(w) > 1 THEN array_to_string(list_concat(list_concat(w[1:{at}], [' ']), w[{at}+1:]), ' ') ELSE array_to_string(w, ' ') END"


SQL_WITH_WORDS = f"SELECT *, {W} AS w FROM ({SQL_MIXED})"


@query("aug_whitespace", f"SELECT prompt_id, {sql_whitespace(sql_choice('prompt_id', '0', 50, 'w'))} AS text FROM ({SQL_WITH_WORDS})")
def aug_whitespace(spark, sf):
    position = gn.choice(F.col("prompt_id"), 0, 50, purpose="w")
    return mixed_prompts(spark, sf).select("prompt_id", gn.aug_whitespace(F.col("text"), position).alias("text"))


SQL_WRAPS = ["text||'.'", "text||'!'", "text||'?'", "text||'...'", "'('||text||')'", "'\"'||text||'\"'"]


@query("aug_punctuation", f"SELECT prompt_id, {sql_pick(SQL_WRAPS, sql_choice('prompt_id', '0', 6, 'p'))} AS text FROM ({SQL_MIXED})")
def aug_punctuation(spark, sf):
    index = gn.choice(F.col("prompt_id"), 0, 6, purpose="p")
    return mixed_prompts(spark, sf).select("prompt_id", gn.aug_punctuation(F.col("text"), index).alias("text"))


def sql_capitalized(x: str) -> str:
    return f"((CASE WHEN substr({x},1,1) = 'ß' THEN 'Ss' ELSE upper(substr({x},1,1)) END)||lower(substr({x},2)))"


SQL_TITLE = f"array_to_string(list_transform(regexp_extract_all(text, '\\p{{L}}+|\\P{{L}}+'), lambda r: {sql_capitalized('r')}), '')"
SQL_CASES = ["lower(text)", "upper(replace(text, 'ß', 'ss'))", SQL_TITLE, sql_capitalized("text")]


@query("aug_case", f"SELECT prompt_id, {sql_pick(SQL_CASES, sql_choice('prompt_id', '0', 4, 'c'))} AS text FROM ({SQL_MIXED})")
def aug_case(spark, sf):
    index = gn.choice(F.col("prompt_id"), 0, 4, purpose="c")
    return mixed_prompts(spark, sf).select("prompt_id", gn.aug_case(F.col("text"), index).alias("text"))


def sql_synonym(key: str, variant: str) -> str:
    bare = "trim(lower(w[i+1]), '.,!?')"
    cases = " ".join(
        f"WHEN {bare} = '{old}' THEN replace(w[i+1], {bare}, {new}[{sql_choice(f"{key}||'#'||i", variant, len(new), 'synonym')}+1])"
        for old, new in gn.SYNONYMS.items()
    )
    return f"array_to_string([CASE {cases} ELSE w[i+1] END for i in range(len(w))], ' ')"


@query("aug_synonym", f"SELECT prompt_id, {sql_synonym('prompt_id', '0')} AS text FROM ({SQL_WITH_WORDS})")
def aug_synonym(spark, sf):
    return mixed_prompts(spark, sf).select("prompt_id", gn.aug_synonym(F.col("text"), F.col("prompt_id"), F.lit(0)).alias("text"))


SQL_PARAPHRASE = (
    "CASE " + " ".join(f"WHEN contains(lower(text), {quoted(a.lower())}) THEN replace(text, {quoted(a)}, {quoted(b)})" for a, b in gn.PARAPHRASES)
    + " ELSE text END"
)


@query("aug_paraphrase", f"SELECT prompt_id, {SQL_PARAPHRASE} AS text FROM ({SQL_MIXED})")
def aug_paraphrase(spark, sf):
    return mixed_prompts(spark, sf).select("prompt_id", gn.aug_paraphrase(F.col("text")).alias("text"))


def sql_augmented(v: str) -> str:
    c = lambda n, purpose: sql_choice("prompt_id", v, n, purpose)
    return sql_pick(
        [
            sql_whitespace(c(1 << 20, "whitespace")), sql_pick(SQL_WRAPS, c(6, "punctuation")), sql_pick(SQL_CASES, c(4, "case")),
            sql_synonym("prompt_id", v), SQL_PARAPHRASE,
        ],
        c(5, "technique"),
    )


@query(
    "augment",
    f"""SELECT prompt_id, 0::BIGINT AS variant, 'mixed' AS source, text, NULL AS technique FROM ({SQL_MIXED}) UNION ALL
    SELECT prompt_id, variant::BIGINT, 'augmented_mixed', {sql_augmented('variant')}, {gn.TECHNIQUES}[{sql_choice('prompt_id', 'variant', 5, 'technique')}+1]
    FROM (SELECT *, unnest(range(1, 2 + ({sql_choice('prompt_id', '0', 1_000_000, 'extra')} < 500000)::INT)) AS variant FROM ({SQL_WITH_WORDS}))""",
)
def augment(spark, sf):
    rows = mixed_prompts(spark, sf).withColumn("source", F.lit("mixed"))
    a = gn.augment(rows, "prompt_id", factor=2.5)
    return a.select("prompt_id", F.col("variant").cast("long").alias("variant"), "source", "text", "technique")


@query(
    "training_mix",
    f"""WITH {sql_esa_generate(SQL_HELP, 2)}, {sql_cap(SQL_HELP, 2)}
    SELECT prompt_id AS id, text, 0 AS label, 'normal' AS origin FROM ({SQL_HELP}) UNION ALL
    SELECT prompt_id, text, 1, 'attack' FROM ({SQL_MIXED}) WHERE truth = 1 UNION ALL
    SELECT prompt_id||'#esa#'||variant, attack, 1, 'esa' FROM esa WHERE attack <> text AND attack <> '' UNION ALL
    SELECT prompt_id||'#cap#'||variant, attack, 1, 'cap' FROM cap WHERE attack <> text AND similarity >= 0.75""",
)
def training_mix(spark, sf):
    return gn.training_mix(help_prompts(spark, sf), mixed_prompts(spark, sf).where("truth = 1"), "prompt_id", WEIGHTS)


def sql_uniform(key: str, variant: str, purpose: str, seed: int = 7) -> str:
    return f"(({sql_choice(key, variant, 1_000_000, purpose, seed)}+0.5)/1000000.0::DOUBLE)"


def sql_normal(key: str, i: int) -> str:
    return f"(sqrt(-2.0*ln({sql_uniform(key, str(i), 'radius')}))*cos({sql_uniform(key, str(i), 'angle')}*2.0*pi()))"


@query(
    "feature_noise",
    f"""SELECT event_id, {', '.join(f"{sql_r6(f'{f} + 0.1*' + sql_normal('event_id', i))} AS {f}" for i, f in enumerate(en.FEATURES))}
    FROM ({SQL_EVENT_FEATURES}) WHERE {sql_uniform('event_id', '0', 'chosen')} < 0.5""",
)
def feature_noise(spark, sf):
    noisy = gn.feature_noise(event_features(spark, sf), "event_id", en.FEATURES, ratio=2.0)
    return rounded(noisy.select("event_id", *en.FEATURES), *en.FEATURES)


@query(
    "training_features",
    f"""WITH {SQL_FEATURES} SELECT prompt_id, truth AS label, {', '.join(f'{sql_r6(f)} AS {f}' for f in en.FEATURES)} FROM feat""",
)
def training_features(spark, sf):
    return rounded(featured(spark, sf).select("prompt_id", F.col("truth").alias("label"), *en.FEATURES), *en.FEATURES)


SQL_GENERATED = f"""WITH {sql_esa_generate(SQL_PROMPTS, 2)}, {sql_cap(SQL_PROMPTS, 2)}
    SELECT prompt_id||'#esa#'||variant AS prompt_id, attack AS text, 1 AS truth FROM esa WHERE attack <> text AND attack <> '' UNION ALL
    SELECT prompt_id||'#cap#'||variant, attack, 1 FROM cap WHERE attack <> text AND similarity >= 0.75 UNION ALL
    SELECT prompt_id, text, 0 FROM ({SQL_PROMPTS})"""


@query(
    "augment_features",
    f"""WITH src AS MATERIALIZED ({SQL_GENERATED}), {SQL_FEATURES.replace(SQL_MIXED, 'SELECT * FROM src')}
    SELECT prompt_id, truth AS label, {', '.join(f"{sql_r6(f'{f} + {NUDGE}')} AS {f}" for f in en.FEATURES)} FROM feat WHERE truth = 1 UNION ALL
    SELECT prompt_id, truth, {', '.join(sql_r6(f'{f} + {NUDGE} + 0.1*' + sql_normal('prompt_id', i)) for i, f in enumerate(en.FEATURES))}
    FROM feat WHERE truth = 0 AND {sql_uniform('prompt_id', '0', 'chosen')} < 0.125""",
)
def augment_features(spark, sf):
    """Sixteen features of generated attacks (label 1) and of noisy copies of the normal rows (label 0)."""
    normal = prompts(spark, sf).select("prompt_id", "text")
    mix = gn.training_mix(normal, normal, "prompt_id", WEIGHTS).where("origin in ('esa', 'cap')")
    attacks = mix.select(F.col("id").alias("prompt_id"), "text", "label")
    rows = attacks.unionByName(normal.withColumn("label", F.lit(0)))
    feats = en.features16(tk.analyze_tokens(rows, reference(spark, sf), "prompt_id", params=ANALYSIS), radius=1)
    feats = feats.select("prompt_id", "label", *en.FEATURES)
    noisy = gn.feature_noise(feats.where("label = 0"), "prompt_id", en.FEATURES, ratio=0.5)
    return rounded(feats.where("label = 1").unionByName(noisy), *en.FEATURES, nudge=NUDGE)
