"""Text features as Column expressions: no shuffle, no Python workers.

Every function takes the text as a Column and returns a Column, so a whole
feature set is one projection over the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.vectors import let

# Blank characters that separate words: ASCII blanks, no-break space, ideographic space.
BLANK = r"[\s\u00A0\u3000]+"

# Phrases that mark a prompt as an injection when auto-labelling.
ATTACK_PHRASES = [
    "ignore all previous instructions",
    "forget everything",
    "system override",
    "developer mode",
    "admin access",
    "bypass restrictions",
    "role-play as",
    "pretend you are",
    "jailbreak",
    "dan mode",
]

# Words of which two or more make a prompt suspicious.
SUSPICIOUS_WORDS = [
    "hack",
    "malware",
    "virus",
    "exploit",
    "vulnerability",
    "password",
    "secret",
    "private",
    "confidential",
]

# Phrases of the prompt-injection event detector.
INJECTION_PHRASES = [
    "ignore previous instructions",
    "disregard the above",
    "forget what you were told",
    "act as if you are",
    "pretend to be",
    "roleplay as",
    "jailbreak",
    "developer mode",
    "admin override",
]

# Words that make a log message security relevant.
SECURITY_WORDS = [
    "authentication", "auth", "login", "logout", "signin", "signout",
    "authorization", "permission", "access", "denied", "forbidden",
    "attack", "intrusion", "malicious", "suspicious", "threat",
    "injection", "xss", "csrf", "sql injection", "code injection",
    "brute force", "dictionary attack", "ddos", "dos",
    "vulnerability", "exploit", "breach", "compromise",
    "anomaly", "unusual", "abnormal", "outlier",
    "security", "violation", "alert", "incident",
]
SECURITY_LOGGERS = ["security", "auth"]

# Tool-call parameter rules.
PATH_PATTERNS = ["../", "..\\"]
COMMAND_PATTERNS = ["rm -rf", "del /", "format c:", "shutdown", "reboot"]
SQL_PATTERNS = ["union select", "drop table", "'; --", "1=1"]
MAX_EXECUTION_SECONDS = 30.0

# Event-code prefix to category; the first matching prefix wins.
EVENT_CATEGORIES = [
    ("auth", "authentication"),
    ("access", "authorization"),
    ("input", "input_validation"),
    ("tool", "tool_security"),
    ("prompt", "prompt_security"),
    ("system", "system_security"),
    ("data", "data_protection"),
    ("network", "network_security"),
    ("compliance", "compliance"),
]

THREAT_LEVELS = ["INFORMATIONAL", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def words(text: Column) -> Column:
    """Non-empty blank-separated words, in order."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def tokenize(text: Column, max_tokens: int | None = None) -> Column:
    """Tokens of the text; `max_tokens` keeps the first n (None keeps them all)."""
    tokens = words(text)
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def avg_word_length(text: Column) -> Column:
    return ratio(F.length(F.regexp_replace(text, BLANK, "")), word_count(text))


def char_count(text: Column, chars: str) -> Column:
    """Occurrences of any of `chars`, by length difference (stays in codegen)."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def uppercase_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))


def special_count(text: Column) -> Column:
    """Characters that are neither letters, digits nor blanks."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s\u00A0\u3000]+", ""))


def context_features(text: Column) -> dict[str, Column]:
    n = F.length(text)
    return {
        "prompt_length": n.cast("long"),
        "word_count": word_count(text).cast("long"),
        "avg_word_length": avg_word_length(text),
        "punctuation_density": ratio(char_count(text, ".,!?;:"), n),
        "uppercase_ratio": ratio(uppercase_count(text), n),
        "special_char_ratio": ratio(special_count(text), n),
    }


def linguistic_anomaly(text: Column) -> Column:
    """Share of four oddities: very few or many words, many symbols, repeated words, upper case."""
    n = F.length(text)
    by_char = (ratio(special_count(text), n) > 0.3).cast("int") + (ratio(uppercase_count(text), n) > 0.5).cast("int")

    def by_word(w: Column) -> Column:
        size = F.size(w)
        repeated = (size > 5) & (F.size(F.array_distinct(w)) < size * 0.5)
        return ((size < 2) | (size > 100)).cast("int") + repeated.cast("int")

    return (let(words(text), by_word) + by_char) / F.lit(4.0)


def sentence_count(text: Column) -> Column:
    return char_count(text, ".") + 1


def sentences(text: Column) -> Column:
    """Parts between full stops; empty parts are kept."""
    return F.split(text, "[.]", -1)


def naturalness(text: Column, parts: Column | None = None) -> Column:
    """How near words are to 5 characters and sentences to 15 words; `parts` is the number of `sentences`, if it is known."""
    parts = sentence_count(text) if parts is None else parts

    def score(w: Column) -> Column:
        n, chars = F.size(w).cast("double"), F.length(F.array_join(w, "")).cast("double")
        by_length = 1.0 / (1.0 + F.abs(F.try_divide(chars, n) - 5.0))
        by_structure = 1.0 / (1.0 + F.abs(n / parts - 15.0))
        return F.when(n > 0, (by_length + by_structure) / 2.0).otherwise(0.0)

    return let(words(text), score)


def max_repeat(tokens: Column) -> Column:
    """Size of the largest group of equal elements: one pass over the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, token):
        run = F.when(acc["prev"].eqNullSafe(token), acc["run"] + 1).otherwise(1)
        return F.struct(token.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(tokens), start, step, lambda acc: acc["best"])


def token_frequency_anomaly(tokens: Column) -> Column:
    return ratio(max_repeat(tokens), F.size(tokens))


def ngrams(tokens: Column, n: int = 3) -> Column:
    """All contiguous n-word phrases; an empty array below n words."""
    empty = F.array().cast("array<string>")
    spans = let(
        tokens,
        lambda t: F.transform(
            F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")
        ),
    )
    return F.when(F.size(tokens) >= n, spans).otherwise(empty)


def matched_phrases(text: Column, phrases: list[str]) -> Column:
    """The phrases that occur in the case-folded text, in the order of the list."""
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in phrases]))


def contains_any(text: Column, phrases: list[str]) -> Column:
    lowered = F.lower(text)
    hit = F.contains(lowered, F.lit(phrases[0]))
    for phrase in phrases[1:]:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return hit


def auto_label(text: Column) -> dict[str, Column]:
    attack = contains_any(text, ATTACK_PHRASES)
    suspicious = F.size(matched_phrases(text, SUSPICIOUS_WORDS)) >= 2
    return {
        "label": F.when(attack | suspicious, 1).otherwise(0),
        "attack_type": F.when(attack, "prompt_injection").when(suspicious, "suspicious_content"),
        "confidence": F.when(attack, 0.8).when(suspicious, 0.6).otherwise(0.9),
    }


def injection_patterns(text: Column) -> Column:
    return matched_phrases(text, INJECTION_PHRASES)


def injection_threat(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "HIGH").otherwise("MEDIUM")


def tool_call_indicators(params: Column, execution_seconds: Column) -> Column:
    """Findings for a MAP<STRING,STRING> of tool parameters and the call duration."""

    def findings(entry):
        key, value = entry["key"], entry["value"]
        path = F.contains(value, F.lit(PATH_PATTERNS[0])) | F.contains(value, F.lit(PATH_PATTERNS[1]))
        return F.array_compact(
            F.array(
                F.when(path, F.concat(F.lit("Path traversal in "), key)),
                F.when(contains_any(value, COMMAND_PATTERNS), F.concat(F.lit("Command injection in "), key)),
                F.when(contains_any(value, SQL_PATTERNS), F.concat(F.lit("SQL injection in "), key)),
            )
        )

    slow = F.when(
        execution_seconds > MAX_EXECUTION_SECONDS,
        F.array(F.concat(F.lit("Unusually long execution time: "), execution_seconds.cast("string"), F.lit("s"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.flatten(F.transform(F.map_entries(params), findings)), slow)


def is_security_log(message: Column, logger: Column, flagged: Column | None = None) -> Column:
    hit = contains_any(message, SECURITY_WORDS) | contains_any(logger, SECURITY_LOGGERS)
    return hit if flagged is None else F.coalesce(flagged, F.lit(False)) | hit


def event_category(event_code: Column) -> Column:
    chain = F.when(event_code.startswith(EVENT_CATEGORIES[0][0]), EVENT_CATEGORIES[0][1])
    for prefix, category in EVENT_CATEGORIES[1:]:
        chain = chain.when(event_code.startswith(prefix), category)
    return chain.otherwise("system_security")


def threat_level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in THREAT_LEVELS]), level.cast("int") + 1)


def content_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", model, text), 256)


def fold_fullwidth(text: Column) -> Column:
    """Full-width ASCII forms and the ideographic space folded to plain ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    plain = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    return F.translate(text, wide, plain)


def log_level(severity: Column) -> Column:
    known = F.upper(severity).isin("CRITICAL", "ERROR", "WARNING")
    return F.when(known, F.upper(severity)).otherwise("INFO")


def merge_context(outer: Column, local: Column) -> Column:
    """Two string maps as one; the local value wins for a key in both."""
    outer_only = F.map_filter(outer, lambda k, _: ~F.array_contains(F.map_keys(local), k))
    return F.coalesce(F.map_concat(outer_only, local), local, outer)


def map_as_text(m: Column) -> Column:
    """A map as sorted `key=value` text."""
    pairs = F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(F.array_sort(pairs), ";")
