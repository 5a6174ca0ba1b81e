"""What a column's name says: identifier, measurement, target. Each rule is a pattern that the driver and Spark SQL both take."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in column names, matched on lower-cased names.
MEASUREMENT = ["salary", "estimatedsalary", "income", "age", "balance", "score", "height", "weight", "amount", "price", "cost", "total", "value", "quantity", "duration", "time", "distance", "percent", "ratio"]
EXEMPT = ["postal", "zip"]
ENTITIES = ["row", "order", "customer", "user", "account", "employee", "transaction", "invoice", "ticket", "shipment", "session", "product"]
COUNTED = ["customer", "user", "account", "employee", "transaction", "order", "invoice", "product"]
KEY_WORDS = ["id", "number", "key", "user", "customer", "account", "employee", "transaction", "row", "product", "order"]
TARGETS = ["target", "label", "class", "outcome", "result", "status", "income", "sales", "price", "cost", "amount", "value", "revenue", "profit", "score", "rating", "stroke", "churn", "exited", "purchase", "default", "risk", "loan", "disease", "approved", "survived"]
#: First match wins.
STRENGTHS = [
    (4, ["target", "label", "class", "outcome", "result"]),
    (3, ["income", "sales", "price", "value", "revenue", "profit"]),
    (1, ["status"]),
    (4, ["churn", "exited", "stroke", "default", "approved", "purchased", "survived", "score", "rating"]),
    (-4, ["id", "row", "customer", "user"]),
]
IDENTIFIER_LIKE = ["id", "row", "customerid", "userid", "account", "transaction", "employee", "invoice", "code", "key", "index"]
WEIGHTS = ["fnlwgt", "weight_count", "sample_weight"]


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _between(words: list[str]) -> str:
    return f"(^|_){_any(words)}(_|$)"


#: Of names reduced to words.
IDENTIFIER_NAME = rf"{_any(ENTITIES)} ?(?:id|identifier|number|key|code)|\b(?:id|identifier|uuid|guid)\b|{_any(COUNTED)} ?(?:no|num|number|id)"
KEY_NAME = rf"\b{_any(KEY_WORDS)}\b"
KEY_VALUE = "^[A-Za-z0-9_-]+$"
TARGET_NAME = _between(TARGETS)


def words(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def is_measurement(name: str) -> bool:
    return re.search(_any(MEASUREMENT), words(name)) is not None


def is_exempt(name: str) -> bool:
    return re.search(_any(EXEMPT), words(name)) is not None


def is_identifier_name(name: str) -> bool:
    return not is_measurement(name) and not is_exempt(name) and re.search(IDENTIFIER_NAME, words(name)) is not None


def is_key_name(name: str) -> bool:
    return not is_measurement(name) and not is_exempt(name) and re.search(KEY_NAME, words(name)) is not None


def is_target_name(name: str) -> bool:
    return re.search(TARGET_NAME, name.lower().replace(" ", "_")) is not None


def target_strength(name: str) -> int:
    plain = name.lower().replace(" ", "_")
    return next((n for n, own in STRENGTHS if re.search(_between(own), plain)), 0)


def is_identifier_like(name: str) -> bool:
    return re.search(_any(IDENTIFIER_LIKE), name.lower()) is not None


# The same as expressions over a column of names.
def words_of(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def escapes_identifier(name: Column) -> Column:
    """Measurement or postal name: never an identifier."""
    return words_of(name).rlike(_any(MEASUREMENT + EXEMPT))


def identifier_name(name: Column) -> Column:
    return ~escapes_identifier(name) & words_of(name).rlike(IDENTIFIER_NAME)


def key_name(name: Column) -> Column:
    return ~escapes_identifier(name) & words_of(name).rlike(KEY_NAME)


def target_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_")).rlike(TARGET_NAME)


def strength_of(name: Column) -> Column:
    plain = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    out = F.when(plain.rlike(_between(STRENGTHS[0][1])), STRENGTHS[0][0])
    for n, own in STRENGTHS[1:]:
        out = out.when(plain.rlike(_between(own)), n)
    return out.otherwise(0)


def identifier_like(name: Column) -> Column:
    return F.lower(name).rlike(_any(IDENTIFIER_LIKE))


def weight_like(name: Column) -> Column:
    return F.lower(name).rlike(_any(WEIGHTS))
