"""Scalar expressions: names, sources, claims, confidences, vectors. All JVM-side unless marked."""

from __future__ import annotations

import difflib
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = Column | str


def _col(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(value: Value) -> Column:
    """Case folding: lower case, with the sharp s written out."""
    return F.replace(F.lower(_col(value)), F.lit("ß"), F.lit("ss"))


def normalize_name(value: Value) -> Column:
    """Folded, runs of anything but a-z and 0-9 become one space, ends trimmed."""
    return F.trim(F.regexp_replace(fold(value), "[^a-z0-9]+", " "))


def _snake(value: Value, default: str) -> Column:
    snake = F.regexp_replace(F.regexp_replace(fold(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(snake, F.lit("")), F.lit(default))


def normalize_candidate(value: Value) -> Column:
    return _snake(value, "anon")


def normalize_verb(value: Value) -> Column:
    return _snake(value, "unknown")


SOURCE_ID = r"^([A-Za-z0-9][A-Za-z0-9._-]*):"


def source_id(ref: Value) -> Column:
    """The source before the first colon; an error for a reference without one, or outside the grammar."""
    ref = _col(ref)
    found = F.regexp_extract(ref, SOURCE_ID, 1)
    return F.when(ref.isNull(), F.lit(None)).when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("not a source reference: "), ref)).cast("string"))


def source_id_or_null(ref: Value) -> Column:
    return F.nullif(F.regexp_extract(_col(ref), SOURCE_ID, 1), F.lit(""))


def source_prefix(ref: Value) -> Column:
    """Everything before the first colon, unchecked."""
    return F.substring_index(_col(ref), ":", 1)


def relation_type(value: Value) -> Column:
    """Upper case; an error unless it is an identifier."""
    upper = F.upper(F.trim(_col(value)))
    return F.when(upper.rlike("^[A-Z][A-Z0-9_]*$"), upper).otherwise(F.raise_error(F.concat(F.lit("not a relation type: "), upper)).cast("string"))


def claim(subject: Value, relation: Value, object_: Value, rendered: Value | None = None) -> Column:
    """Subject, relation in words, object; a claim that is there already wins."""
    text = F.concat_ws(" ", _col(subject), F.lower(F.translate(_col(relation), "_", " ")), _col(object_))
    return text if rendered is None else F.coalesce(F.nullif(F.trim(_col(rendered)), F.lit("")), text)


def state_claim(entity: Value, key: Value, value: Value) -> Column:
    return F.concat(_col(entity), F.lit("'s "), _col(key), F.lit(" is "), _col(value))


def scoped_claim(subject: Value, relation: Value, object_: Value, scope: Value) -> Column:
    scope = _col(scope)
    return F.concat(claim(subject, relation, object_), F.when(F.trim(F.coalesce(scope, F.lit(""))) != "", F.concat(F.lit(" ("), scope, F.lit(")"))).otherwise(F.lit("")))


def flag_note(subject: Value, relation: Value, object_: Value, evidence: Value, step: Value, guard: Value) -> Column:
    return F.format_string("[%s/%s] %s | evidence: %s", _col(guard), _col(step), claim(subject, relation, object_), _col(evidence))


def ensure_scope(scope: Value) -> Column:
    scope = F.coalesce(_col(scope), F.lit(""))
    return F.when(F.trim(scope) == "", F.lit("unconditional")).otherwise(scope)


def extend_scope(scope: Value, more: Value) -> Column:
    return F.trim(F.concat_ws(" ", _col(scope), _col(more)))


def clamp(value: Value) -> Column:
    """Into [0, 1]; null stays null."""
    value = _col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def combine(previous: Value, event: Value, independent: Value) -> Column:
    """1 - (1 - p)(1 - e) for independent evidence, else unchanged; clamped."""
    p, e = clamp(previous), clamp(event)
    return F.when(_col(independent), clamp(1 - (1 - p) * (1 - e))).otherwise(p)


def differs(a: Value, b: Value, epsilon: float = 1e-12) -> Column:
    return F.abs(_col(a) - _col(b)) > epsilon


def cosine(a: Value, b: Value) -> Column:
    """Cosine over the common prefix of two vectors; 0 where a norm is 0, null where a vector is."""
    n = F.least(F.size(_col(a)), F.size(_col(b)))
    x, y = (F.slice(_col(v).cast("array<double>"), F.lit(1), n) for v in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(_col(a).cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v)) * F.sqrt(F.aggregate(_col(b).cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v))
    return F.when(_col(a).isNull() | _col(b).isNull(), F.lit(None)).when(norm == 0, F.lit(0.0)).otherwise(dot / norm).cast("double")


def scaled_score(score: Value) -> Column:
    """(1 + cosine) / 2, as vector indexes report it."""
    return (1 + _col(score)) / 2


def append_absent(base: Value, more: Value) -> Column:
    """``base`` followed by what it lacks, in order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(_col(base), empty), F.coalesce(_col(more), empty)))


def evidence_count(evidence: Value) -> Column:
    return F.when(_col(evidence).isNull(), 0).otherwise(F.size(_col(evidence)))


def join_evidence(evidence: Value) -> Column:
    return F.array_join(F.filter(_col(evidence), lambda e: F.trim(e) != ""), "\n")


def split_items(endpoint: Value) -> Column:
    """The items of an enumeration by commas and the word ``and`` (its case counts)."""
    return F.filter(F.transform(F.split(_col(endpoint), r",|\band\b"), F.trim), lambda p: p != "")


def name_tokens(value: Value) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_name(value), " "), lambda t: t != ""))


def element_id(*key: Value) -> Column:
    return F.sha2(F.concat_ws("\x1f", *map(_col, key)), 256)


def best_ratio(name: str, names: list[str]) -> float:
    """The largest Ratcliff-Obershelp ratio; Python, used where the built-in distances aren't equivalent."""
    return max((difflib.SequenceMatcher(None, name, n).ratio() for n in names), default=0.0)


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_ratio(x or "", [y or ""]) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


def clean_markup(text: Value) -> Column:
    return F.trim(unescape(F.regexp_replace(_col(text), "<[^>]*>", "")))


def redirect_target(url: Value, parameter: str = "uddg") -> Column:
    """The address behind a redirect link, or the link itself."""
    inner = F.regexp_extract(_col(url), rf"[?&]{parameter}=([^&]*)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(_col(url))
