"""Redaction of secrets and personal data as ordered regex rewrites.

A rule is (name, pattern, replacement); rules run one after the other, each on
the output of the one before. All rules of a text are one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"


class Rule(NamedTuple):
    name: str
    pattern: str
    replacement: str


# Patterns and masks, in the order in which they run. The token
# rule runs before the key rule, which would otherwise take the token's head.
CREDIT_CARD = Rule("credit_card", r"\b(?:\d{4}[-\s]?){3}(\d{4})\b", "****-****-****-$1")
SSN = Rule("ssn", r"\b\d{3}-\d{2}-(\d{4})\b", "***-**-$1")
EMAIL = Rule("email", r"\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "$1***@$2")
PHONE = Rule(
    "phone",
    r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\+\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}",
    "***-***-$1",
)
PASSWORD = Rule("password", r"(?i)(password|pwd|pass)\s*[:=]\s*['\"]?[^'\"\s]+['\"]?", "$1=[REDACTED]")
JWT = Rule(
    "jwt", r"\beyJ[A-Za-z0-9_/+=.-]+\.eyJ[A-Za-z0-9_/+=.-]+\.[A-Za-z0-9_/+=.-]+\b", "[REDACTED_JWT]"
)
API_KEY = Rule(
    "api_key",
    r"(?i)(api[_-]?key|token|secret|sk_[a-z]+_)\s*[:=]?\s*['\"]?([A-Za-z0-9_+/-]{8})[A-Za-z0-9_+/-]{7,}",
    "$1=$2***",
)
URL_CREDENTIALS = Rule("url_credentials", r"(https?://)[^\s:/@]+:[^\s@]+@", "$1[REDACTED]:[REDACTED]@")
IPV4 = Rule("ipv4", r"\b(\d{1,3})(?:\.\d{1,3}){3}\b", "$1.***.***.***")
MAC = Rule(
    "mac_address",
    r"\b[0-9A-Fa-f]{2}([-:])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){3}\1([0-9A-Fa-f]{2})\b",
    "**$1**$1**$1**$1**$1$2",
)
RULES = [CREDIT_CARD, SSN, EMAIL, PHONE, PASSWORD, JWT, API_KEY, URL_CREDENTIALS, IPV4, MAC]

# Field names whose value is dropped whole.
SENSITIVE_FIELDS = [
    "password", "pwd", "secret", "token", "api_key", "private_key",
    "credit_card", "ssn", "social_security", "passport_number",
    "auth_token", "access_token", "refresh_token", "session_id",
    "csrf_token", "x_api_key", "authorization", "jwt_token",
    "client_secret", "private_data", "confidential", "sensitive",
]


# What a match of the phone rule ends in, whatever alternative matched.
LAST_FOUR = r"(?<=([\s\S]{4}))"


def apply_rule(text: Column, rule: Rule) -> Column:
    pattern = f"(?:{rule.pattern}){LAST_FOUR}" if rule.name == PHONE.name else rule.pattern
    return F.regexp_replace(text, pattern, rule.replacement)


def redact_text(text: Column, rules: list[Rule] = RULES, enabled: bool = True) -> Column:
    if enabled:
        for rule in rules:
            text = apply_rule(text, rule)
    return text


def add_rule(rules: list[Rule], name: str, pattern: str, replacement: str = REDACTED) -> list[Rule]:
    return [r for r in rules if r.name != name] + [Rule(name, pattern, replacement)]


def remove_rule(rules: list[Rule], name: str) -> list[Rule]:
    return [r for r in rules if r.name != name]


def redact_with(text: Column, mask: Callable[[Column], Column]) -> Column:
    """Redaction by a function of columns, for masks that no single pattern states; null stays null."""
    return F.when(text.isNotNull(), mask(text))


def rule_counts(text: Column, rules: list[Rule] = RULES) -> dict[str, Column]:
    """Matches per rule on the original text."""
    return {r.name: F.regexp_count(text, F.lit(r.pattern)) for r in rules}


def redact_value(value: Column, dtype: T.DataType, rules: list[Rule] = RULES) -> Column:
    """Redact a value by its type: strings by rule, nested fields by name and rule.

    Under a sensitive map key a string becomes the mask and any other value null.
    """
    if isinstance(dtype, T.StringType):
        return redact_text(value, rules)
    if isinstance(dtype, T.StructType):
        parts = []
        for field in dtype.fields:
            inner = value[field.name]
            if field.name.lower() in SENSITIVE_FIELDS:
                inner = F.lit(REDACTED)
            else:
                inner = redact_value(inner, field.dataType, rules)
            parts.append(inner.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: redact_value(item, dtype.elementType, rules))
    if isinstance(dtype, T.MapType):
        kind = dtype.valueType
        masked = F.lit(REDACTED) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)
        hidden = lambda k: F.lower(k.cast("string")).isin(SENSITIVE_FIELDS)
        return F.transform_values(value, lambda k, v: F.when(hidden(k), masked).otherwise(redact_value(v, kind, rules)))
    return value


def redact_record(df, rules: list[Rule] = RULES, keep: tuple[str, ...] = ()):
    """Redact every column of a DataFrame by its name and type."""
    cols = []
    for field in df.schema.fields:
        if field.name in keep:
            cols.append(F.col(field.name))
        elif field.name.lower() in SENSITIVE_FIELDS:
            cols.append(F.lit(REDACTED).alias(field.name))
        else:
            cols.append(redact_value(F.col(field.name), field.dataType, rules).alias(field.name))
    return df.select(*cols)
