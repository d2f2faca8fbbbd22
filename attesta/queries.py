"""Registered queries over tables derived from the star schema, and the SQL that each is held against.

The derived tables use expressions that both engines evaluate alike: a ledger
from order lines (suppliers report on brands), state events from the event
stream, entities from suppliers, parts and customers, vectors from embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.operators import canonical, cells, contracts, dispatch, factcheck, guards, ledger, maintenance, novelty, resolution, search, states, walks
from attesta.operators.components import durable
from attesta.plans import fanout
from attesta.schemas import IDENTITY, TRIPLE
from attesta.sources import chunking, registry

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _registry(spark: SparkSession) -> DataFrame:
    return registry.packaged_table(spark)


def _round(column: str) -> Column:
    """Six places, off the ties that products of short decimals hit."""
    return F.round(F.col(column) + 3.3e-10, 6)


# --- derived inputs -------------------------------------------------------------------------------------------------

_RELATION = {"A": "replaces", "N": "supports", "R": "superseded_by"}


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def claims_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest confidence and first date of order lines that agree in their keys, relation and domain.

    Grouped where the join with orders has dealt the lines, before anything is spelled out: the rest of a claim follows from these columns.
    """
    line, order = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("domain"))
    domains = order.join(customer, order["o_custkey"] == customer["c_custkey"]).select("o_orderkey", "domain").repartition("o_orderkey").distinct()
    relation = F.create_map(*[F.lit(x) for kv in _RELATION.items() for x in kv])[F.col("l_returnflag")]
    lines = line.select(*_KEYS, relation.alias("relation"), F.round(0.05 + 5 * F.col("l_discount").cast("double"), 6).alias("confidence"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    dealt = lines.join(domains.hint("merge"), lines["l_orderkey"] == domains["o_orderkey"])
    return dealt.groupBy(*_KEYS, "relation", "domain").agg(F.max("confidence").alias("confidence"), F.min("created_at").alias("created_at"))


_CLAIMS = """claims AS (
  SELECT s_name AS subject, CASE l_returnflag WHEN 'A' THEN 'replaces' WHEN 'N' THEN 'supports' WHEN 'R' THEN 'superseded_by' END AS relation, p_brand AS object,
    'doc-' || CAST(l_orderkey % 200 AS VARCHAR) || ':x' AS source_ref, round(0.05 + 5 * CAST(l_discount AS DOUBLE), 6) AS confidence,
    'line ' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS evidence,
    CASE WHEN l_linenumber % 3 = 0 THEN 'order ' || CAST(l_orderkey AS VARCHAR) ELSE '' END AS scope_conditions,
    lower(c_mktsegment) AS domain, CAST(l_shipdate AS TIMESTAMP) AS created_at,
    lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS order_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


def _source_ref() -> Column:
    return F.concat(F.lit("doc-"), (F.col("l_orderkey") % 200).cast("string"), F.lit(":x"))


def bare_claims(spark: SparkSession, sf_dir: str, about: str | None = None) -> DataFrame:
    """One claim per (order, line, part, supplier, relation): the strongest of rows that agree; what follows from the keys isn't spelled out.

    about: only claims with this name at either end.
    """
    part, supplier = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("object")).distinct(), _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("subject")).distinct()
    keyed = claims_by_key(spark, sf_dir)
    rows = keyed.join(part, keyed["l_partkey"] == part["p_partkey"]).join(supplier, keyed["l_suppkey"] == supplier["s_suppkey"])
    if about is not None:
        rows = rows.where((F.col("subject") == about) | (F.col("object") == about))
    return rows.select("subject", "relation", "object", "domain", F.col("relation").alias("raw_relation"), *_KEYS, "confidence", "created_at")


def spelled(rows: DataFrame) -> DataFrame:
    """Bare claims with what follows from their keys; ``seq`` orders them by keys, then by the relation that was written.

    A reference that is there already stays the column that it is, so that rows dealt by it needn't be dealt again.
    """
    spelled_out = {
        "source_ref": F.col("source_ref") if "source_ref" in rows.columns else _source_ref(),
        "evidence": F.concat(F.lit("line "), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")),
        "scope_conditions": F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))).otherwise(F.lit("")),
        "seq": F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in _KEYS], "raw_relation"),
    }
    return rows.withColumns(spelled_out).drop(*_KEYS)


_DISTINCT = _CLAIMS + """, d AS (
  SELECT subject, relation, object, source_ref, evidence, scope_conditions, domain, order_key || '-' || relation AS seq, max(confidence) AS confidence, min(created_at) AS created_at
  FROM claims GROUP BY ALL)"""


def claims(spark: SparkSession, sf_dir: str, about: str | None = None) -> DataFrame:
    return spelled(bare_claims(spark, sf_dir, about))


#: The canonical form of the three relations: replaces is an alias of supersedes, superseded_by its inverse.
_CANON = """c AS (
  SELECT CASE WHEN relation = 'superseded_by' THEN object ELSE subject END AS subject, CASE WHEN relation = 'supports' THEN 'SUPPORTS' ELSE 'SUPERSEDES' END AS relation,
    CASE WHEN relation = 'superseded_by' THEN subject ELSE object END AS object, relation AS raw_relation, source_ref, evidence, scope_conditions, domain, seq, confidence, created_at FROM d)"""
_KEPT = """k AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, object, source_ref ORDER BY seq) AS rn FROM c) WHERE rn = 1)"""
_LEDGER = f"WITH {_DISTINCT}, {_CANON}, {_KEPT}"
_ARROWS = _LEDGER + """, a AS (SELECT subject, relation, object, 1 - product(1 - confidence) AS confidence,
  coalesce(arg_max(scope_conditions, CASE WHEN scope_conditions <> '' THEN seq END), '') AS scope_conditions, count(*) AS n_rows, arg_max(source_ref, seq) AS source_ref FROM k GROUP BY ALL)"""


def _bare_canonical(spark: SparkSession, sf_dir: str, about: str | None = None) -> DataFrame:
    return canonical.canonicalize_triples(bare_claims(spark, sf_dir, about), _registry(spark)).drop("flipped", "relation_known")


def canonical_claims(spark: SparkSession, sf_dir: str, about: str | None = None) -> DataFrame:
    return spelled(_bare_canonical(spark, sf_dir, about))


def _dealt_claims(spark: SparkSession, sf_dir: str, about: str | None = None) -> DataFrame:
    """Canonical claims dealt by triple before they are spelled out: identities and arrows are worked out where their rows lie."""
    return spelled(_bare_canonical(spark, sf_dir, about).repartition(*TRIPLE))


def stored_ledger(spark: SparkSession, sf_dir: str, about: str | None = None) -> DataFrame:
    """The keep-first ledger, or its rows about one name: a canonical triple has the ends that its claims have."""
    return ledger.dedupe(_dealt_claims(spark, sf_dir, about)).withColumn("source_id", S.source_id("source_ref"))


def _written_ledger(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Triples and ``columns`` of the ledger, written once for queries that read it more than once."""
    return durable(stored_ledger(spark, sf_dir).select(*TRIPLE, *columns))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("organization").alias("type"))
    p = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("product").alias("type")).distinct()
    b = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit("product").alias("type")).distinct()
    c = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("person").alias("type"))
    return s.unionByName(p).unionByName(b).unionByName(c).distinct()


_ENTITIES = """e AS (SELECT s_name AS name, 'organization' AS type FROM supplier UNION SELECT p_name, 'product' FROM part UNION SELECT p_brand, 'product' FROM part UNION SELECT c_name, 'person' FROM customer)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity"), F.lit("person").alias("entity_type"), F.col("event_type").alias("state_key"),
        F.format_string("%.3f", F.col("value")).alias("value"), F.lit("").alias("unit"), F.date_format("ts", "yyyy-MM-dd HH").alias("as_of"),
        (F.pmod(F.col("event_id"), F.lit(10)) / 10).alias("confidence"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("evidence"),
        F.lit("").alias("scope_conditions"), F.concat(F.lit("log-"), F.pmod(F.col("event_id"), F.lit(50)).cast("string"), F.lit(":e")).alias("source_ref"), F.col("event_id").alias("seq"),
    )


_STATES = """st AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS entity, 'person' AS entity_type, event_type AS state_key, printf('%.3f', value) AS value, strftime(ts, '%Y-%m-%d %H') AS as_of,
  (event_id % 10) / 10.0 AS confidence, 'event ' || CAST(event_id AS VARCHAR) AS evidence, 'log-' || CAST(event_id % 50 AS VARCHAR) || ':e' AS source_ref, event_id AS seq FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v-"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("name"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("type"), F.col("embedding").cast("array<double>").alias("embedding"), "vec_id",
    )


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in _table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first().embedding]


_VECTORS = """v AS (SELECT 'v-' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS name, 't' || CAST(label AS VARCHAR) AS type, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings)"""

# --- ledger ---------------------------------------------------------------------------------------------------------


@_query(_ARROWS + " SELECT subject, relation, object, round(confidence + 3.3e-10, 6) AS confidence, n_rows, scope_conditions, source_ref FROM a")
def arrows_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ledger.arrows(stored_ledger(spark, sf_dir))
    return a.select(*TRIPLE, _round("confidence").alias("confidence"), "n_rows", "scope_conditions", "source_ref")


@_query(_LEDGER + " SELECT subject, relation, object, source_ref, confidence, evidence, scope_conditions, raw_relation FROM k")
def ledger_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_ledger(spark, sf_dir).select(*TRIPLE, "source_ref", "confidence", "evidence", "scope_conditions", "raw_relation")


@_query(f"WITH {_DISTINCT}, {_CANON} SELECT subject, relation, object, source_ref, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, object, source_ref ORDER BY seq DESC) AS rn FROM c) WHERE rn = 1")
def ledger_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.dedupe(_dealt_claims(spark, sf_dir), last=True).select(*TRIPLE, "source_ref", "confidence", "evidence")


def _plan_sql(mode: str) -> str:
    order = "seq" if mode == "keep-first" else "seq DESC"
    hit = "'update'" if mode == "refresh" else "'skip'"
    return (
        f"WITH {_DISTINCT}, {_CANON}, old AS (SELECT DISTINCT subject, relation, object, source_ref FROM c WHERE domain = 'building'), r AS (SELECT c.*, row_number() OVER (PARTITION BY c.subject, c.relation, c.object, c.source_ref ORDER BY {order}) AS rn, "
        "old.subject IS NOT NULL AS hit FROM c LEFT JOIN old ON c.subject = old.subject AND c.relation = old.relation AND c.object = old.object AND c.source_ref = old.source_ref WHERE c.domain <> 'building') "
        f"SELECT subject, relation, object, source_ref, evidence, CASE WHEN rn = 1 AND NOT hit THEN 'create' WHEN rn = 1 AND hit THEN {hit} ELSE 'skip' END AS action FROM r"
    )


def _plan(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = durable(_bare_canonical(spark, sf_dir).select(*TRIPLE, _source_ref().alias("source_ref"), "domain", "raw_relation", *_KEYS))  # used twice
    old, new = rows.where("domain = 'building'").select(*IDENTITY), rows.where("domain <> 'building'").repartition(*IDENTITY)
    return ledger.plan_writes(old, spelled(new), mode).select(*TRIPLE, "source_ref", "evidence", "action")


@_query(_plan_sql("keep-first"))
def write_plan_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "keep-first")


@_query(_plan_sql("refresh"))
def write_plan_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "refresh")


@_query(f"WITH {_DISTINCT}, {_CANON} SELECT subject, relation, object, raw_relation, count(*) AS n FROM c GROUP BY ALL")
def canonicalize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_claims(spark, sf_dir).groupBy(*TRIPLE, "raw_relation").agg(F.count("*").alias("n"))


@_query("SELECT 'domain' AS kind, lower(c_mktsegment) AS label, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'state_key', event_type, count(*) FROM events GROUP BY ALL")
def unknown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _registry(spark)
    a = canonical.unknown_counts(_table(spark, sf_dir, "customer"), reg, {"c_mktsegment": "domain"})
    return a.unionByName(canonical.unknown_counts(_table(spark, sf_dir, "events"), reg, {"event_type": "state_key"}))


@_query(f"""WITH {_DISTINCT}, raw AS (SELECT *, upper(relation) AS old FROM d), first AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY subject, old, object, source_ref ORDER BY seq) AS rn FROM raw) WHERE rn = 1),
  t AS (SELECT CASE WHEN relation = 'superseded_by' THEN object ELSE subject END AS s, CASE WHEN relation = 'supports' THEN 'SUPPORTS' ELSE 'SUPERSEDES' END AS r, CASE WHEN relation = 'superseded_by' THEN subject ELSE object END AS o, * FROM first),
  w AS (SELECT *, r = old AND s = subject AND o = object AS kept FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY s, r, o, source_ref ORDER BY kept DESC, seq) AS rn FROM w)
  SELECT s AS subject, r AS relation, o AS object, source_ref, evidence, CASE WHEN rn > 1 THEN 'collapse' WHEN kept THEN 'keep' ELSE 'rewrite' END AS action FROM n""")
def normalize_relations_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = maintenance.with_canonical(bare_claims(spark, sf_dir).withColumn("relation", F.upper("relation")), _registry(spark))
    rows = spelled(named.repartition(*TRIPLE))  # rows of one stored identity have one canonical triple, so both are told apart where they lie
    return maintenance.plan_canonical(ledger.dedupe(rows, (*maintenance.STORED, *IDENTITY))).select(*TRIPLE, "source_ref", "evidence", "action")


@_query(_ARROWS + " , cut AS (SELECT * FROM k WHERE NOT (domain = 'machinery')) SELECT subject, relation, object, round(confidence + 3.3e-10, 6) AS confidence FROM a WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.subject = a.subject AND cut.relation = a.relation AND cut.object = a.object)")
def backfill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written_ledger(spark, sf_dir, "confidence", "domain")
    return maintenance.backfill_candidates(ledger.arrows(rows), rows.where("NOT (domain = 'machinery')")).select(*TRIPLE, _round("confidence").alias("confidence"))


@_query(_ARROWS + " SELECT subject, relation, object, source_ref FROM a WHERE EXISTS (SELECT 1 FROM k WHERE domain = 'machinery' AND k.subject = a.subject AND k.relation = a.relation AND k.object = a.object)")
def strip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written_ledger(spark, sf_dir, "source_ref", "confidence", "domain", "seq")
    own = ledger.arrows(rows).withColumn("evidence", F.lit(None).cast("array<string>"))
    return maintenance.strip_candidates(own, rows.where("domain = 'machinery'")).select(*TRIPLE, "source_ref")


@_query(_ARROWS + """, b AS (SELECT subject, relation, object, 1 - product(1 - confidence) AS previous FROM k WHERE domain = 'building' GROUP BY ALL)
  SELECT a.subject, a.relation, a.object, round(a.confidence + 3.3e-10, 6) AS confidence, round(b.previous + 3.3e-10, 6) AS previous_confidence FROM a JOIN b ON a.subject = b.subject AND a.relation = b.relation AND a.object = b.object""")
def delta_changed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written_ledger(spark, sf_dir, "source_ref", "confidence", "scope_conditions", "domain", "seq", "evidence")
    edges = rows.withColumn("evidence", F.array("evidence"))
    _, changed = ledger.assemble_delta(edges, ledger.arrows(rows.where("domain = 'building'")))
    return changed.select(*TRIPLE, _round("confidence").alias("confidence"), _round("previous_confidence").alias("previous_confidence"))


# --- read side ------------------------------------------------------------------------------------------------------


@_query(_ARROWS + """, seeds AS (SELECT s_name AS seed FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)),
  x AS (SELECT seed, relation, object AS neighbor, confidence, scope_conditions, 'out' AS direction FROM a JOIN seeds ON subject = seed UNION ALL SELECT seed, relation, subject, confidence, scope_conditions, 'in' FROM a JOIN seeds ON object = seed WHERE subject <> object),
  y AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, relation, neighbor, direction) AS n FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY seed, relation, neighbor ORDER BY confidence DESC, n) AS m FROM y WHERE n <= 20)
  SELECT CAST(row_number() OVER (ORDER BY confidence DESC, neighbor, seed, relation) AS INTEGER) AS rank, seed, relation, neighbor, round(confidence + 3.3e-10, 6) AS confidence, 1.0::DOUBLE AS seed_score, scope_conditions FROM z WHERE m = 1 ORDER BY 1 LIMIT 5""")
def fanout_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest directions around the first supplier."""
    first = _table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_name").first()
    name = first.s_name if first else ""
    seeds = spark.range(1).select(F.lit(name).alias("name"), F.lit(1.0).alias("seed_score"))
    return fanout.directions(seeds, ledger.arrows(stored_ledger(spark, sf_dir, name))).withColumn("confidence", _round("confidence"))


@_query(_LEDGER + " SELECT subject, relation, object, source_ref, evidence, confidence FROM k WHERE split_part(source_ref, ':', 1) = 'doc-7'")
def provenance_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.provenance_for_source(stored_ledger(spark, sf_dir), "doc-7").select(*TRIPLE, "source_ref", "evidence", "confidence")


@_query(_LEDGER + " SELECT split_part(source_ref, ':', 1) AS id, strftime(min(created_at), '%Y-%m-%d') AS first_seen FROM k GROUP BY 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.first_seen(stored_ledger(spark, sf_dir)).select("id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@_query(_ARROWS + f", {_ENTITIES}, n AS (SELECT relation, 'out' AS direction, object AS name FROM a WHERE subject = 'Brand#11' UNION SELECT relation, 'in', subject FROM a WHERE object = 'Brand#11') SELECT DISTINCT relation, direction, n.name, type FROM n JOIN e ON n.name = e.name")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.neighbours(ledger.arrows(stored_ledger(spark, sf_dir, "Brand#11")), entities(spark, sf_dir), "Brand#11")


@_query(_LEDGER + f", {_STATES} SELECT DISTINCT * FROM (SELECT 'REPORTED' AS role, relation, source_ref, evidence, confidence FROM k WHERE subject = 'Brand#11' UNION ALL SELECT 'ABOUT', relation, source_ref, evidence, confidence FROM k WHERE object = 'Brand#11' UNION ALL SELECT 'HAS_STATE_EVENT', state_key, source_ref, evidence, confidence FROM st WHERE entity = 'Brand#11')")
def entity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.entity_events(stored_ledger(spark, sf_dir, "Brand#11"), measured(spark, sf_dir), "Brand#11")


@_query(f"WITH {_STATES} SELECT state_key, value, '' AS unit, as_of, CAST(confidence AS DOUBLE) AS confidence, source_ref FROM st WHERE entity = 'user-1'")
def entity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.entity_states(measured(spark, sf_dir), "user-1", "person")


@_query(_ARROWS + """, r AS (SELECT subject, relation, object, string_agg(evidence, ' | ' ORDER BY seq, evidence) AS evidence FROM k GROUP BY ALL)
  SELECT a.subject, a.relation, a.object, round(confidence + 3.3e-10, 6) AS confidence, a.source_ref, r.evidence FROM a JOIN r ON a.subject = r.subject AND a.relation = r.relation AND a.object = r.object WHERE a.subject = 'Brand#11' OR a.object = 'Brand#11'""")
def edges_for_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_ledger(spark, sf_dir, "Brand#11")
    found = walks.edges_for_entity(ledger.arrows(rows), rows, "Brand#11")
    return found.select(*TRIPLE, _round("confidence").alias("confidence"), "source_ref", F.array_join("evidence", " | ").alias("evidence"))


@_query(_ARROWS + " SELECT DISTINCT relation FROM a")
def relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.relation_types(ledger.arrows(stored_ledger(spark, sf_dir)))


@_query(_ARROWS + """ SELECT DISTINCT object AS neighbor, relation FROM a WHERE subject = 'Brand#11' AND relation = 'SUPERSEDES' UNION SELECT DISTINCT subject, relation FROM a WHERE object = 'Brand#11' AND relation = 'SUPERSEDES'""")
def structural_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("neighbor"), F.lit("SUPERSEDES").alias("relation"))
    return walks.structural_corroboration(ledger.arrows(stored_ledger(spark, sf_dir, "Brand#11")), "Brand#11", pairs)


# --- states ---------------------------------------------------------------------------------------------------------


@_query(f"WITH {_STATES} SELECT entity, state_key, value, as_of, CAST(confidence AS DOUBLE) AS confidence, source_ref FROM (SELECT *, row_number() OVER (PARTITION BY entity, state_key ORDER BY as_of DESC, confidence DESC, seq) AS rn FROM st) WHERE rn = 1")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.current_state(measured(spark, sf_dir)).select("entity", "state_key", "value", "as_of", "confidence", "source_ref")


@_query(f"WITH {_STATES}, c AS (SELECT entity, state_key, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, state_key ORDER BY as_of DESC, confidence DESC, seq) AS rn FROM st) WHERE rn = 1) SELECT entity, string_agg(state_key || '=' || value, ';' ORDER BY state_key) AS state FROM c GROUP BY entity")
def current_state_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = states.state_map(states.current_state(measured(spark, sf_dir)))
    entries = F.transform(F.array_sort(F.map_keys("state")), lambda k: F.concat(k, F.lit("="), F.col("state")[k]["value"]))
    return maps.select("entity", F.array_join(entries, ";").alias("state"))


@_query(f"WITH {_STATES} SELECT entity, state_key, source_ref, evidence, CASE WHEN row_number() OVER (PARTITION BY entity, entity_type, state_key, source_ref ORDER BY seq) = 1 THEN 'create' ELSE 'skip' END AS action FROM st")
def state_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir)
    return states.plan_states(rows.limit(0), rows).select("entity", "state_key", "source_ref", "evidence", "action")


# --- vectors --------------------------------------------------------------------------------------------------------


@_query(f"WITH {_VECTORS}, p AS (SELECT * FROM v ORDER BY s DESC, name, type LIMIT 100) SELECT name, type, round(s, 6) AS score FROM p WHERE s >= 0.1 ORDER BY s DESC, name LIMIT 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.similar_entities(vectors(spark, sf_dir), _query_vector(spark, sf_dir), 5, 0.1)
    return found.select("name", "type", F.round("score", 6).alias("score"))


@_query(f"WITH {_VECTORS}, p AS (SELECT * FROM v ORDER BY s DESC, name, type LIMIT 100) SELECT name, type, round(s, 6) AS score FROM p WHERE s >= 0.1 ORDER BY s DESC, name LIMIT 5")
def vector_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same five by the inverted file."""
    index = cells.build(vectors(spark, sf_dir), "embedding")
    found = cells.nearest(index, _query_vector(spark, sf_dir), 5, ["name", "type"]).where(F.col("score") >= 0.1)
    return found.select("name", "type", F.round("score", 6).alias("score"))


@_query(f"WITH {_VECTORS} SELECT name, type, round(s, 6) AS score FROM v WHERE type = 't3' ORDER BY s DESC, name LIMIT 10")
def vector_type_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_by_type(vectors(spark, sf_dir), _query_vector(spark, sf_dir), "t3").withColumn("score", F.round("score", 6))


@_query(f"WITH {_VECTORS}, p AS (SELECT * FROM v ORDER BY s DESC, name LIMIT 10) SELECT name, type, round(s, 6) AS score FROM p WHERE type = (SELECT 't' || CAST(label AS VARCHAR) FROM embeddings WHERE vec_id = 0)")
def vector_type_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = vectors(spark, sf_dir).where("vec_id = 0").first().type
    return search.search_by_type(vectors(spark, sf_dir), _query_vector(spark, sf_dir), label, prefilter=False).withColumn("score", F.round("score", 6))


# --- fact checks ----------------------------------------------------------------------------------------------------


@_query(_LEDGER + " SELECT domain, count(DISTINCT split_part(source_ref, ':', 1)) AS n_sources FROM k GROUP BY domain HAVING count(DISTINCT split_part(source_ref, ':', 1)) >= 2")
def factcheck_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factcheck.overlapping_domains(stored_ledger(spark, sf_dir))


@_query(_LEDGER + """, w AS (SELECT * FROM k WHERE source_ref IN ('doc-1:x', 'doc-2:x')), o AS (SELECT * FROM k WHERE source_ref NOT IN ('doc-1:x', 'doc-2:x')), h AS (SELECT DISTINCT domain FROM o WHERE domain IN (SELECT domain FROM w))
  SELECT domain, count(*) AS n_rows FROM k WHERE domain IN (SELECT domain FROM h) GROUP BY domain""")
def factcheck_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written_ledger(spark, sf_dir, "source_ref", "confidence", "scope_conditions", "created_at", "seq", "domain")
    mine = F.col("source_ref").isin("doc-1:x", "doc-2:x")
    return factcheck.candidates_for_write(rows.where(mine), rows.where(~mine)).groupBy("domain").agg(F.count("*").alias("n_rows"))


@_query(_LEDGER + " SELECT subject, relation, object, source_ref, 'supported' AS verdict FROM k WHERE domain = 'furniture' AND split_part(source_ref, ':', 1) = 'doc-7'")
def verdict_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written_ledger(spark, sf_dir, "source_ref", "confidence", "scope_conditions", "created_at", "seq", "domain", "source_id")
    receipts = rows.where("domain = 'furniture'").select(*TRIPLE, "source_ref", F.lit("supported").alias("verdict"), F.lit("2024-01-01").alias("created_at"), F.concat_ws("/", *TRIPLE, "source_ref").alias("id"))
    return walks.verdicts_for_source(rows, receipts, "doc-7").select(*TRIPLE, "source_ref", "verdict")


# --- names, guards, contracts, chunks -------------------------------------------------------------------------------

_ENDPOINTS = """ep AS (SELECT s_suppkey AS id, CASE s_suppkey % 9 WHEN 0 THEN '$' || CAST(s_suppkey AS VARCHAR) || ' trillion' WHEN 1 THEN 'elevated' WHEN 2 THEN 'the previous ' || s_name WHEN 3 THEN s_name || ' (old)' WHEN 4 THEN 'one two three four five six seven'
  WHEN 5 THEN 'France, Japan and ' || s_name WHEN 6 THEN 'France and ' || s_name WHEN 7 THEN s_name ELSE 'Plain Name' END AS subject, s_name AS object FROM supplier)"""


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 9
    subject = (
        F.when(k == 0, F.concat(F.lit("$"), F.col("s_suppkey").cast("string"), F.lit(" trillion"))).when(k == 1, "elevated").when(k == 2, F.concat(F.lit("the previous "), F.col("s_name"))).when(k == 3, F.concat(F.col("s_name"), F.lit(" (old)")))
        .when(k == 4, "one two three four five six seven").when(k == 5, F.concat(F.lit("France, Japan and "), F.col("s_name"))).when(k == 6, F.concat(F.lit("France and "), F.col("s_name"))).when(k == 7, F.col("s_name")).otherwise("Plain Name")
    )
    return s.select(F.col("s_suppkey").alias("id"), subject.alias("subject"), F.col("s_name").alias("object"))


@_query(f"WITH {_ENDPOINTS} SELECT id, CASE id % 9 WHEN 0 THEN 'numeric_endpoint' WHEN 1 THEN 'qualitative_endpoint' WHEN 2 THEN 'deictic' WHEN 3 THEN 'description_in_name' WHEN 4 THEN 'clause' WHEN 5 THEN 'list' WHEN 6 THEN 'compound_actor' WHEN 7 THEN 'self_loop' ELSE '' END AS classes FROM ep")
def guard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.classify(_endpoints(spark, sf_dir)).select("id", F.array_join("guard_classes", ",").alias("classes"))


@_query("""SELECT c_custkey AS id, concat_ws(';', CASE WHEN c_custkey % 4 = 0 THEN 'evidence must be a non-empty string' END, CASE WHEN c_custkey % 5 = 0 THEN 'relation must be lowercase snake_case' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'confidence must be a number in [0, 1]' END, CASE WHEN c_custkey % 7 = 0 THEN 'domain must be lowercase snake_case when present' END) AS failures FROM customer""")
def contract_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("subject"), F.lit("person").alias("subject_type"), F.when(k % 5 == 0, "Trades With").otherwise("trades_with").alias("relation"), F.lit("Other").alias("object"), F.lit("place").alias("object_type"),
        F.when(k % 3 == 0, 1.5).otherwise(0.5).alias("confidence"), F.when(k % 4 == 0, "  ").otherwise("seen").alias("evidence"), F.lit("unconditional").alias("scope_conditions"), F.lit("d:chunk-1").alias("source_ref"), F.when(k % 7 == 0, "Two Words").alias("domain"),
    )
    return contracts.check_triples(rows).select("id", F.array_join("failures", ";").alias("failures"))


@_query("SELECT c_custkey AS id, trim(regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS name, regexp_replace(regexp_replace(lower(c_mktsegment || ' !'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS verb FROM customer")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), S.normalize_name(F.concat_ws(" & ", "c_name", "c_mktsegment")).alias("name"), S.normalize_verb(F.concat("c_mktsegment", F.lit(" !"))).alias("verb"))


@_query(_LEDGER + " SELECT source_ref, regexp_extract(source_ref, '^([A-Za-z0-9][A-Za-z0-9._-]*):', 1) AS source_id, count(*) AS n FROM k GROUP BY ALL")
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_ledger(spark, sf_dir).groupBy("source_ref", S.source_id("source_ref").alias("source_id")).agg(F.count("*").alias("n"))


@_query("""WITH p AS (SELECT DISTINCT p_name AS name, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM part),
  q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name, list_distinct(list_filter(string_split(trim(regexp_replace(lower(split_part(p_name, ' ', 1)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM part)
  SELECT q.name AS a_name, p.name AS b_name FROM q JOIN p ON len(list_intersect(q.t, p.t)) = len(q.t) AND len(q.t) < len(p.t) OR len(list_intersect(q.t, p.t)) = len(p.t) AND len(p.t) < len(q.t) WHERE len(q.t) > 0 AND len(p.t) > 0""")
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("product").alias("type")).distinct()
    short = part.select(F.substring_index("name", " ", 1).alias("name"), "type").distinct()
    return resolution.containment_pairs(short, part.withColumn("aliases", F.array().cast("array<string>"))).select("a_name", "b_name")


@_query("""WITH b AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS t FROM documents), f AS (SELECT doc_id, i, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM b)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, strlen(t) AS n_bytes FROM f WHERE t <> ''""")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a page of its own; lines that end in a stop never continue."""
    docs = _table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    pages = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.transform(lines, lambda x: F.concat(x, F.lit(" ."))).alias("pages"))
    return chunking.chunk_pages(pages).select(F.col("source_id").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), (F.octet_length("text") - 2).cast("long").alias("n_bytes"))


@_query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 4) AS INTEGER) AS batch FROM conversations")
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("ordinal"))
    return walks.batches(c, 4).select(F.col("source_id").alias("conv_id"), F.col("ordinal").alias("turn"), "batch")


@_query(f"WITH {_DISTINCT}, q AS (SELECT subject || ' ' || lower(replace(relation, '_', ' ')) || ' ' || object AS claim FROM d) SELECT count(*) AS candidates, count(DISTINCT claim) AS unique_claims, count(*) FILTER (WHERE strlen(claim) % 2 = 0) AS kept, count(*) FILTER (WHERE strlen(claim) % 2 = 1) AS dropped FROM q")
def novelty_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(novelty.counted_claims(novelty.with_claims(claims(spark, sf_dir))))  # used twice
    verdicts = rows.select("claim", F.when(F.octet_length("claim") % 2 == 0, "novel").otherwise("known").alias("choice"))
    return novelty.gate_counts(rows, verdicts)


@_query(f"WITH {_ENDPOINTS} SELECT CASE id % 9 WHEN 0 THEN 'drop_noise' WHEN 1 THEN 'to_scope' WHEN 2 THEN 'to_source' WHEN 3 THEN 'normalize_name' WHEN 4 THEN 'drop_noise' WHEN 5 THEN 'drop_noise' WHEN 6 THEN 'named_group' WHEN 7 THEN 'missing_endpoint' ELSE 'bypassed' END AS step, count(*) AS n FROM ep GROUP BY 1")
def dispatch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guards.classify(_endpoints(spark, sf_dir))
    step = {"numeric_endpoint": "drop_noise", "qualitative_endpoint": "to_scope", "deictic": "to_source", "description_in_name": "normalize_name", "clause": "drop_noise", "list": "drop_noise", "compound_actor": "named_group", "self_loop": "missing_endpoint"}
    choice = F.create_map(*[F.lit(x) for kv in step.items() for x in kv])[F.col("primary_class")]
    decided = rows.where("primary_class IS NOT NULL").withColumn("choice", choice)
    return dispatch.counters(decided, rows.where("primary_class IS NULL"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, site, type (the language) and name (the title) of every page that has a title."""
    html = F.col("html")
    named = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"([^./]+\.[^./:?#]+)(?:[:/?#]|$)", 1).alias("site"), F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("type"), F.trim(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)).alias("name"))
    return named.where("name <> ''")


@_query()
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different titles of pages of one language with a ratio of 0.90; Ratcliff-Obershelp has no SQL form, tests hold it against brute force."""
    names = titles(spark, sf_dir).select("name", "type").distinct()
    return resolution.fuzzy_pairs(names, names).where("a_name < b_name")


def title_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title as a mention, in the order of pages, with a session per site and the vector of the page's number where there is one."""
    vectors_ = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return titles(spark, sf_dir).join(vectors_, "page_id", "left").select(F.col("site").alias("session"), "type", F.col("page_id").alias("seq"), F.col("name").alias("mention"), "embedding")


def title_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first sentences of titles name, with the least title as an alias where there are several, the vector of the first page that has one, and how many pages there are."""
    mentions = title_mentions(spark, sf_dir).withColumn("name", F.trim(F.substring_index("mention", ".", 1))).where("name <> ''")
    first = F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("seq")))
    return mentions.groupBy("name", "type").agg(F.when(F.count("*") > 1, F.array(F.min("mention"))).alias("aliases"), first.alias("embedding"), F.count("*").cast("int").alias("corroborations"))


@_query()
def resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent, so without SQL; tests hold it against one fold over each session and type."""
    found = resolution.resolve(title_mentions(spark, sf_dir), title_entities(spark, sf_dir))
    return found.select("session", "type", "seq", "mention", "outcome", "canonical", "layer")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}
