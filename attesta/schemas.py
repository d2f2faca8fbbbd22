"""The tables of the evidence graph. Schemas are fixed here and never inferred."""

from pyspark.sql import types as T


_ATOMS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(columns: str) -> T.StructType:
    """``name type, ...`` of flat columns; needs no session, unlike Spark's own parser."""
    fields = []
    for name, kind in (c.split() for c in columns.split(", ")):
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(T.StructField(name, T.ArrayType(_ATOMS[inner]) if inner != kind else _ATOMS[kind]))
    return T.StructType(fields)


ENTITIES = _struct("name string, type string, aliases array<string>, embedding array<double>, created_at timestamp, updated_at timestamp")
LEDGER = _struct(
    "subject string, relation string, object string, source_ref string, confidence double, evidence string, evidence_embedding array<double>, "
    "scope_conditions string, domain string, raw_relation string, source_id string, created_at timestamp, updated_at timestamp, seq bigint"
)
ARROWS = _struct(
    "subject string, relation string, object string, confidence double, scope_conditions string, created_at timestamp, updated_at timestamp, "
    "evidence array<string>, source_ref string"
)
STATE_EVENTS = _struct(
    "entity string, entity_type string, state_key string, source_ref string, value string, unit string, as_of string, confidence double, evidence string, "
    "evidence_embedding array<double>, scope_conditions string, created_at timestamp, updated_at timestamp, seq bigint"
)
SOURCES = _struct("id string, first_seen timestamp")
VERDICTS = _struct(
    "id string, subject string, relation string, object string, source_ref string, verdict string, confidence double, evidence_urls array<string>, "
    "model string, search_provider string, reasoning string, created_at string"
)
REJECTED = _struct("candidate string, source_ref string, evidence string, scope_conditions string, decision string, reason string, verdict string, guard_class string, step string")
REGISTRY = _struct("kind string, label string, canonical string, flip_to string, is_staged boolean, description string, version int")
CHUNKS = _struct("source_id string, ordinal int, chunk_id string, text string, section_path array<string>, pages array<int>, source_ref string")
TRIPLES = _struct(
    "subject string, subject_type string, relation string, object string, object_type string, confidence double, evidence string, "
    "scope_conditions string, source_ref string, domain string"
)
STATES = _struct(
    "entity string, entity_type string, state_key string, value string, unit string, as_of string, confidence double, evidence string, "
    "scope_conditions string, source_ref string"
)

TABLES = {"entities": ENTITIES, "ledger": LEDGER, "arrows": ARROWS, "state_events": STATE_EVENTS, "sources": SOURCES, "verdicts": VERDICTS, "rejected": REJECTED}
IDENTITY = ("subject", "relation", "object", "source_ref")
TRIPLE = ("subject", "relation", "object")
STATE_IDENTITY = ("entity", "entity_type", "state_key", "source_ref")
