"""Further registered queries: the write path, contracts, repairs, maintenance and scalar functions, with the SQL of each.

Their input is light: a ledger of notes from orders, measurements from events,
entities from suppliers and customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import queries as Q
from attesta.functions import scalars as S
from attesta.operators import canonical, components, contracts, dispatch, factcheck, guards, ledger, maintenance, novelty, resolution, search, states, walks
from attesta.plans import fanout, ingest
from attesta.plans.scan import render_roster, scan_pass
from attesta.queries import _query, _registry, _round, _table
from attesta.schemas import ARROWS, LEDGER, STATE_EVENTS, TRIPLE
from attesta.sources import chunking

_NOW = "2030-01-01 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


def _shaped(df: DataFrame, schema) -> DataFrame:
    """``df`` with the columns of a table, null where it has none."""
    return df.select(*[(df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger row per order."""
    key = F.col("o_orderkey").cast("long")
    text = lambda x: x.cast("string")
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), text(F.col("o_custkey") % 40)).alias("subject"), F.when(key % 3 == 0, "SUPPORTS").when(key % 3 == 1, "SUPERSEDES").otherwise("MAY_DESCRIBE").alias("relation"),
        F.concat(F.lit("p"), text(key % 7)).alias("object"), F.concat(F.lit("doc-"), text(key % 30), F.lit(":n")).alias("source_ref"), ((key % 10) / 10).alias("confidence"),
        F.concat(F.lit("order "), text(key)).alias("evidence"), F.when(key % 4 == 0, F.concat(F.lit("scope "), text(key))).otherwise("").alias("scope_conditions"),
        F.when(key % 5 == 0, "trade").otherwise("storage").alias("domain"), F.lit("noted").alias("raw_relation"), F.col("o_orderdate").cast("timestamp").alias("created_at"), key.alias("seq"),
    )


_NOTES = """n AS (SELECT 'c' || CAST(o_custkey % 40 AS VARCHAR) AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'SUPERSEDES' ELSE 'MAY_DESCRIBE' END AS relation, 'p' || CAST(o_orderkey % 7 AS VARCHAR) AS object,
  'doc-' || CAST(o_orderkey % 30 AS VARCHAR) || ':n' AS source_ref, (o_orderkey % 10) / 10.0::DOUBLE AS confidence, 'order ' || CAST(o_orderkey AS VARCHAR) AS evidence,
  CASE WHEN o_orderkey % 4 = 0 THEN 'scope ' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS scope_conditions, CASE WHEN o_orderkey % 5 = 0 THEN 'trade' ELSE 'storage' END AS domain, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderkey AS BIGINT) AS seq FROM orders)"""
_ID, _TR = "subject, relation, object, source_ref", "subject, relation, object"
#: The stored rows are the first of each identity among orders with an even key; the others are candidates.
_OLD_NEW = _NOTES + f""", old AS (SELECT * FROM n WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY {_ID} ORDER BY seq) = 1),
  fresh AS (SELECT * FROM n WHERE seq % 2 = 1), top AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY {_ID} ORDER BY seq DESC) = 1)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.dedupe(notes(spark, sf_dir).where("seq % 2 = 0"))
    return _shaped(rows.withColumns({"source_id": S.source_id("source_ref"), "updated_at": F.col("created_at")}), LEDGER)


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).where("seq % 2 = 1").withColumn("source_id", S.source_id("source_ref"))


# --- upserts --------------------------------------------------------------------------------------------------------


@_query(f"WITH {_OLD_NEW} SELECT {_ID}, coalesce(t.confidence, o.confidence) AS confidence, coalesce(t.evidence, o.evidence) AS evidence, coalesce(t.scope_conditions, o.scope_conditions) AS scope_conditions, coalesce(o.seq, t.seq) AS seq, t.seq IS NOT NULL AS touched FROM old o FULL JOIN top t USING ({_ID})")
def ledger_upsert_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _stored(spark, sf_dir)
    after = ledger.apply_plan(old, ledger.plan_writes(old, _fresh(spark, sf_dir), "refresh"), _now())
    return after.select(*ledger.IDENTITY, "confidence", "evidence", "scope_conditions", "seq", (F.col("updated_at") == _now()).alias("touched"))


@_query(f"WITH {_OLD_NEW}, f AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY {_ID} ORDER BY seq) = 1) SELECT {_ID}, confidence, evidence, seq, EXISTS (SELECT 1 FROM f WHERE f.subject = o.subject AND f.relation = o.relation AND f.object = o.object AND f.source_ref = o.source_ref) AS touched FROM old o UNION ALL SELECT {_ID}, confidence, evidence, seq, true FROM f ANTI JOIN old USING ({_ID})")
def ledger_upsert_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _stored(spark, sf_dir)
    after = ledger.apply_plan(old, ledger.plan_writes(old, _fresh(spark, sf_dir), "keep-first"), _now())
    return after.select(*ledger.IDENTITY, "confidence", "evidence", "seq", (F.col("updated_at") == _now()).alias("touched"))


@_query(f"""WITH {_OLD_NEW}, after AS (SELECT {_ID}, coalesce(t.confidence, o.confidence) AS confidence FROM old o FULL JOIN top t USING ({_ID})), a AS (SELECT {_TR}, 1 - product(1 - confidence) AS confidence FROM after GROUP BY ALL),
  s AS (SELECT {_TR}, coalesce(arg_max(scope_conditions, seq) FILTER (WHERE scope_conditions <> ''), '') AS stored FROM old GROUP BY ALL), p AS (SELECT {_TR}, arg_max(scope_conditions, seq) AS planned FROM top GROUP BY ALL)
  SELECT {_TR}, round(a.confidence + 3.3e-10, 6) AS confidence, CASE WHEN coalesce(planned, '') <> '' THEN planned ELSE coalesce(stored, '') END AS scope_conditions FROM a LEFT JOIN s USING ({_TR}) LEFT JOIN p USING ({_TR})""")
def arrows_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _stored(spark, sf_dir)
    plan = ledger.plan_writes(old, _fresh(spark, sf_dir), "refresh")
    stored = _shaped(ledger.arrows(old).drop("source_ref"), ARROWS)
    return ledger.merge_arrows(stored, ledger.planned_arrows(old, plan), _now()).select(*TRIPLE, _round("confidence").alias("confidence"), "scope_conditions")


@_query(f"WITH {_NOTES}, l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY {_TR} ORDER BY seq % 2 DESC, seq DESC) = 1) SELECT {_TR}, confidence, evidence, scope_conditions, source_ref FROM l")
def edge_upsert_without_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = notes(spark, sf_dir).withColumn("evidence", F.array("evidence"))
    none = spark.createDataFrame([], ARROWS)
    first = ledger.upsert_edges(none, edges.where("seq % 2 = 0"), _now())
    return ledger.upsert_edges(first, edges.where("seq % 2 = 1"), _now()).select(*TRIPLE, "confidence", F.col("evidence")[0].alias("evidence"), "scope_conditions", "source_ref")


@_query(f"WITH {Q._STATES}, old AS (SELECT * FROM st WHERE seq % 2 = 0), new AS (SELECT * FROM st WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY entity, state_key, source_ref ORDER BY seq) = 1) SELECT entity, state_key, source_ref, evidence FROM old UNION ALL SELECT entity, state_key, source_ref, evidence FROM new ANTI JOIN old USING (entity, state_key, source_ref)")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.measured(spark, sf_dir)
    after, _ = states.upsert_states(_shaped(rows.where("seq % 2 = 0"), STATE_EVENTS), rows.where("seq % 2 = 1"), _registry(spark), _now())
    return after.select("entity", "state_key", "source_ref", "evidence")


@_query("""SELECT s_name AS name, 'organization' AS type, 'S' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 2 = 0 THEN '|also ' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS aliases, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS vector, s_suppkey % 2 = 0 AS touched FROM supplier
  UNION ALL SELECT 'new ' || n_name, 'place', n_name, NULL, true FROM nation""")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unseen aliases are appended, an empty new vector leaves the old one, unknown names are added."""
    s, k = _table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    old = s.select(F.col("s_name").alias("name"), F.lit("organization").alias("type"), F.array(F.concat(F.lit("S"), k.cast("string"))).alias("aliases"), F.array(F.lit(1.0)).alias("embedding"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    new = s.where(k % 2 == 0).select(F.col("s_name").alias("name"), F.lit("organization").alias("type"), F.array(F.concat(F.lit("S"), k.cast("string")), F.concat(F.lit("also "), k.cast("string"))).alias("aliases"), F.when(k % 4 == 0, F.array(F.lit(2.0))).alias("embedding"))
    more = _table(spark, sf_dir, "nation").select(F.concat(F.lit("new "), "n_name").alias("name"), F.lit("place").alias("type"), F.array("n_name").alias("aliases"), F.lit(None).cast("array<double>").alias("embedding"))
    after = resolution.upsert_entities(old, new.unionByName(more), _now())
    return after.select("name", "type", F.array_join("aliases", "|").alias("aliases"), F.col("embedding")[0].alias("vector"), F.col("updated_at").isNotNull().alias("touched"))


@_query(f"WITH {_NOTES}, d AS (SELECT DISTINCT {_ID} FROM n WHERE domain = 'trade') SELECT {_ID}, 'supported' AS verdict, (SELECT count(*) FROM nation) AS missing FROM d")
def verdict_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of stored rows are appended; those whose row is missing are counted."""
    rows = notes(spark, sf_dir)
    receipts = rows.where("domain = 'trade'").select(*ledger.IDENTITY).distinct().unionByName(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("subject"), F.lit("X").alias("relation"), F.lit("y").alias("object"), F.lit("z:1").alias("source_ref"))).withColumn("verdict", F.lit("supported"))
    new, missing = factcheck.append_verdicts(rows.select(*ledger.IDENTITY), receipts)
    return new.crossJoin(F.broadcast(missing)).select(*ledger.IDENTITY, "verdict", "missing")  # missing is one row


# --- contracts, guards, gates ---------------------------------------------------------------------------------------


@_query("""SELECT c_custkey AS id, concat_ws(';', CASE WHEN c_custkey % 4 = 0 THEN 'entity must be a non-empty string' END, CASE WHEN c_custkey % 5 = 0 THEN 'as_of must be a non-empty string' END, CASE WHEN c_custkey % 11 = 0 THEN 'scope_conditions must be a string' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'state_key must be lowercase snake_case' END, CASE WHEN c_custkey % 7 = 0 THEN 'confidence must be a number in [0, 1]' END) AS failures FROM customer""")
def state_contract_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 4 == 0, " ").otherwise(F.col("c_name")).alias("entity"), F.lit("person").alias("entity_type"), F.when(k % 3 == 0, "Net-Worth").otherwise("net_worth").alias("state_key"), F.lit(" 5 ").alias("value"), F.lit("").alias("unit"),
        F.when(k % 5 != 0, "2024").alias("as_of"), F.when(k % 7 == 0, -0.1).otherwise(0.5).alias("confidence"), F.lit("seen").alias("evidence"), F.when(k % 11 != 0, "").alias("scope_conditions"), F.lit("d:chunk-1").alias("source_ref"),
    )
    return contracts.check_states(rows).select("id", F.array_join("failures", ";").alias("failures"))


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 30 >= 25 OR o_orderkey % 3 = 0 THEN 'source_ref must be that of the chunk' ELSE '' END AS failures FROM orders")
def grounding_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's reference must be that of the chunk it names; 25 of 30 chunks exist."""
    n = F.col("n_nationkey").cast("string")
    chunks = _table(spark, sf_dir, "nation").select(F.concat(F.lit("chunk-"), n).alias("chunk_id"), F.concat(F.lit("doc:chunk-"), n).alias("source_ref"))
    k = F.col("o_orderkey") % 30
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("chunk-"), k.cast("string")).alias("chunk_id"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "other:chunk-").otherwise("doc:chunk-"), k.cast("string")).alias("source_ref"), F.array().cast("array<string>").alias("failures"))
    return contracts.grounded(rows, chunks).select("id", F.array_join("failures", ";").alias("failures"))


@_query("SELECT c_custkey % 2 = 1 AS valid, CASE WHEN c_custkey % 2 = 1 THEN '' ELSE 'evidence must be a non-empty string' END AS reason, count(*) AS n FROM customer GROUP BY ALL")
def contract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid candidates go on, the others become records with their reasons."""
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("subject"), F.lit("person").alias("subject_type"), F.lit("trades_with").alias("relation"), F.lit("Other").alias("object"), F.lit("place").alias("object_type"), F.lit(0.5).alias("confidence"),
        F.when(F.col("c_custkey") % 2 == 1, "seen").otherwise("").alias("evidence"), F.lit("always").alias("scope_conditions"), F.lit("d:chunk-1").alias("source_ref"),
    )
    valid, rejected = contracts.split_valid(contracts.check_triples(rows))
    both = valid.select(F.lit(True).alias("valid"), F.lit("").alias("reason")).unionByName(rejected.select(F.lit(False).alias("valid"), "reason"))
    return both.groupBy("valid", "reason").agg(F.count("*").alias("n"))


@_query(f"WITH {Q._ENDPOINTS} SELECT id, 'as given' AS side, CASE WHEN id % 9 < 7 THEN 'subject' WHEN id % 9 = 7 THEN 'object' END AS flagged FROM ep UNION ALL SELECT id, 'turned', CASE WHEN id % 9 < 8 THEN 'object' END FROM ep")
def flagged_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q._endpoints(spark, sf_dir)
    turned = rows.select("id", F.col("object").alias("subject"), F.col("subject").alias("object"))
    both = rows.withColumn("side", F.lit("as given")).unionByName(turned.withColumn("side", F.lit("turned")))
    return guards.classify(both).select("id", "side", F.col("flagged_endpoint").alias("flagged"))


@_query(f"WITH {_NOTES}, q AS (SELECT seq, subject || ' ' || lower(replace(relation, '_', ' ')) || ' ' || object AS claim FROM n) SELECT seq, claim FROM q WHERE strlen(claim) % 2 = 0")
def novelty_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = novelty.with_claims(notes(spark, sf_dir))
    verdicts = novelty.unique_claims(rows).select("claim", F.when(F.octet_length("claim") % 2 == 0, "novel").otherwise("known").alias("choice"))
    return novelty.gate(rows, verdicts).select("seq", "claim")


@_query(f"WITH {Q._STATES} SELECT entity || '''s ' || state_key || ' is ' || value AS claim, min(seq) AS seq FROM st GROUP BY 1")
def state_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.unique_claims(novelty.with_claims(Q.measured(spark, sf_dir), state=True))


@_query("SELECT 'novel' AS label, round(avg(c_custkey % 10 / 10.0), 6) AS p FROM customer UNION ALL SELECT 'known', round(avg(CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.0 END), 6) FROM customer")
def novelty_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    both = F.when(k % 2 == 0, F.create_map(F.lit("novel"), (k % 10) / 10, F.lit("known"), F.lit(0.5))).otherwise(F.create_map(F.lit("novel"), (k % 10) / 10))
    return novelty.mean_probabilities(_table(spark, sf_dir, "customer").select(both.alias("probabilities"))).select("label", F.round("p", 6).alias("p"))


# --- repairs of flagged candidates ----------------------------------------------------------------------------------

_STEPS = ("to_scope", "named_group", "normalize_name", "missing_endpoint", "decompose", "to_state", "to_source", "pass_flagged", "drop_noise", "unknown", "joint_with_scope", "to_state")
_PAYLOADS = (
    '{"scope": "in spring"}', '{"group_name": "Group", "group_type": "organization"}', '{"name": "Plain", "qualifier": "of old"}', '{"endpoint": "End", "endpoint_type": "place"}',
    '{"triples": [{"subject": "a", "object": "b"}, {"subject": "a", "object": "c"}, {"subject": "", "object": "d"}]}', '{"entity": "E", "entity_type": "person", "state_key": "net_worth", "value": "5", "as_of": "2024"}',
    '{"note": "see source"}', "{}", "{}", "{}", '{"edges": [{"subject": "x", "object": "y"}], "scope_conditions": "together"}', "{}",
)


@_query("""WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_suppkey % 12 AS k, s_name AS s, 'obj' AS o FROM supplier)
  SELECT 'triple' AS kind, id, CASE k WHEN 1 THEN 'Group' WHEN 2 THEN 'Plain' ELSE s END AS a, CASE k WHEN 3 THEN 'End' ELSE o END AS b, CASE k WHEN 0 THEN 'base in spring' WHEN 2 THEN 'base of old' ELSE 'base' END AS c FROM k WHERE k IN (0, 1, 2, 3)
  UNION ALL SELECT 'triple', id, 'a', x, 'base' FROM k, (VALUES ('b'), ('c')) v(x) WHERE k = 4 UNION ALL SELECT 'triple', id, 'x', 'y', 'together' FROM k WHERE k = 10
  UNION ALL SELECT 'state', id, 'E', 'net_worth', '5' FROM k WHERE k = 5 UNION ALL SELECT 'flag', id, s, o, CASE k WHEN 6 THEN 'see source' ELSE '[clause/pass_flagged] ' || s || ' knows ' || o || ' | evidence: ' || CAST(id AS VARCHAR) END FROM k WHERE k IN (6, 7)
  UNION ALL SELECT 'record', id, CASE k WHEN 7 THEN 'flagged' WHEN 8 THEN 'dropped' WHEN 9 THEN 'dropped' ELSE 'rejected' END, CASE k WHEN 4 THEN 'invalid_payload' WHEN 11 THEN 'invalid_payload' WHEN 7 THEN 'flagged' ELSE 'noise' END,
    CASE k WHEN 4 THEN 'subject must be a non-empty string' WHEN 11 THEN 'payload lacks what the step needs: to_state' WHEN 7 THEN 'held for review' ELSE 'not knowledge' END FROM k WHERE k IN (4, 7, 8, 9, 11)""")
def dispatch_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of step on one candidate a supplier: triples, states, flags and records that come of it."""
    k = (F.col("s_suppkey") % 12).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), k + 1)
    rows = _table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("subject"), F.lit("person").alias("subject_type"), F.lit("knows").alias("relation"), F.lit("obj").alias("object"), F.lit("place").alias("object_type"), F.lit(0.5).alias("confidence"), F.col("s_suppkey").cast("string").alias("evidence"),
        F.lit("base").alias("scope_conditions"), F.lit("d:chunk-1").alias("source_ref"), F.lit("clause").alias("primary_class"), F.lit("subject").alias("flagged_endpoint"), pick(_STEPS).alias("choice"), pick(_PAYLOADS).alias("payload"),
    )
    done = dispatch.execute(rows)
    own = F.col("evidence").cast("long").alias("id")
    out = done.triples.select(F.lit("triple").alias("kind"), own, F.col("subject").alias("a"), F.col("object").alias("b"), F.col("scope_conditions").alias("c"))
    out = out.unionByName(done.states.select(F.lit("state").alias("kind"), own, F.col("entity").alias("a"), F.col("state_key").alias("b"), F.col("value").alias("c")))
    out = out.unionByName(done.flagged.select(F.lit("flag").alias("kind"), own, F.col("subject").alias("a"), F.col("object").alias("b"), F.col("note").alias("c")))
    return out.unionByName(done.rejected.select(F.lit("record").alias("kind"), own, F.col("decision").alias("a"), F.col("verdict").alias("b"), F.col("reason").alias("c")))


@_query("SELECT o_orderkey AS id, 'text of ' || CAST(o_orderkey % 25 AS VARCHAR) AS chunk_text FROM orders")
def candidate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    chunks = _table(spark, sf_dir, "nation").select(F.concat(F.lit("doc:chunk-"), n).alias("source_ref"), F.concat(F.lit("text of "), n).alias("text"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("doc:chunk-"), (F.col("o_orderkey") % 25).cast("string")).alias("source_ref"))
    return dispatch.with_chunk(rows, chunks).select("id", "chunk_text")


# --- reads ----------------------------------------------------------------------------------------------------------


@_query(f"WITH {_NOTES} SELECT seq, evidence FROM n WHERE domain = 'trade'")
def domain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.rows_for_domain(notes(spark, sf_dir), "trade").select("seq", "evidence")


@_query("SELECT s_name AS name, 'organization' AS type FROM supplier WHERE s_suppkey = 7 OR s_suppkey = 9")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By normalized name (the seventh supplier) and by alias (the ninth carries it as one)."""
    s = _table(spark, sf_dir, "supplier")
    seventh = s.where("s_suppkey = 7").first().s_name
    rows = s.select(F.col("s_name").alias("name"), F.lit("organization").alias("type"), F.when(F.col("s_suppkey") == 9, F.array(F.lit(f" {seventh.upper()} !"))).alias("aliases"))
    return walks.find_entities(rows, seventh.replace("#", " - "), "organization").select("name", "type")


@_query("SELECT DISTINCT c_mktsegment AS label, upper(c_mktsegment) AS relation FROM customer")
def relation_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label"), S.relation_type(F.lower("c_mktsegment")).alias("relation")).distinct()


@_query(f"WITH {Q._VECTORS} SELECT name, type, round(s, 6) AS seed_score FROM v WHERE s >= 0.2 UNION ALL SELECT s_name, 'organization', 1.0 FROM supplier WHERE s_suppkey = 7")
def seed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic seeds over the threshold, and the exact seed of a name."""
    s = _table(spark, sf_dir, "supplier")
    people = s.select(F.col("s_name").alias("name"), F.lit("organization").alias("type"), F.array().cast("array<string>").alias("aliases"))
    exact = fanout.exact_seeds(people, s.where("s_suppkey = 7").first().s_name.lower())
    near = fanout.semantic_seeds(Q.vectors(spark, sf_dir), Q._query_vector(spark, sf_dir), 0.2)
    return near.unionByName(exact).select("name", "type", F.round("seed_score", 6).alias("seed_score"))


@_query("""WITH p AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT split_part(lower(min(p_name)), ' ', 1) AS a, split_part(lower(min(p_name)), ' ', 2) AS b FROM part)
  SELECT name FROM p, w WHERE list_has_any(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), [a, b]) ORDER BY name LIMIT 100""")
def containment_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("product").alias("type"), F.array().cast("array<string>").alias("aliases")).distinct()
    least = part.agg(F.min("name")).first()[0]
    return walks.containment_candidates(part, " ".join(least.split(" ")[:2]), "product").select("name")


@_query(f"""WITH {_NOTES}, a AS (SELECT {_TR}, 1 - product(1 - confidence) AS confidence, string_agg(evidence, ' | ' ORDER BY seq) AS evidence, arg_max(source_ref, seq) AS source_ref FROM n GROUP BY ALL)
  SELECT {_TR}, round(confidence + 3.3e-10, 6) AS confidence, evidence, source_ref FROM a WHERE object = 'p3'""")
def edge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    found = ledger.edge_lookup(ledger.arrows(rows), rows, rows.where("object = 'p3'"))
    return found.select(*TRIPLE, _round("confidence").alias("confidence"), F.array_join("evidence", " | ").alias("evidence"), "source_ref")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.vectors(spark, sf_dir).select(F.col("name").alias("subject"), F.when(F.col("vec_id") % 3 != 0, "SUPPORTS").alias("relation"), F.col("type").alias("object"), F.concat(F.lit("d:"), "name").alias("source_ref"), F.col("name").alias("evidence"), F.lit(0.5).alias("confidence"), F.col("embedding").alias("evidence_embedding"))


_HITS = "SELECT v.name AS evidence, round(s, 6) AS score, CASE WHEN e.vec_id % 2 = 0 THEN v.name END AS subject, v.type AS object FROM v JOIN embeddings e ON v.name = 'v-' || lpad(CAST(e.vec_id AS VARCHAR), 9, '0')"


def _wired_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Q.vectors(spark, sf_dir)
    return v.where("vec_id % 2 = 0").select("name", F.lit("claim").alias("type")).unionByName(v.select(F.col("type").alias("name"), F.lit("topic").alias("type")).distinct())


@_query(f"WITH {Q._VECTORS} {_HITS} WHERE s >= 0.1 ORDER BY s DESC, v.name LIMIT 5")
def event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest evidence rows over the threshold, with the entities at their ends (half of the subjects are none)."""
    found = search.search_events(_evidence(spark, sf_dir), _wired_entities(spark, sf_dir), Q._query_vector(spark, sf_dir), 5, 0.1)
    return found.select("evidence", F.round("score", 6).alias("score"), F.col("subject.name").alias("subject"), F.col("object.name").alias("object"))


@_query(f"WITH {Q._VECTORS} {_HITS} WHERE e.vec_id % 3 <> 0 ORDER BY s DESC, v.name LIMIT 10")
def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_evidence(_evidence(spark, sf_dir), _wired_entities(spark, sf_dir), Q._query_vector(spark, sf_dir))
    return found.select("evidence", F.round("score", 6).alias("score"), F.col("subject.name").alias("subject"), F.col("object.name").alias("object"))


@_query(f"""WITH {Q._STATES}, c AS (SELECT entity, state_key, value FROM st QUALIFY row_number() OVER (PARTITION BY entity, state_key ORDER BY as_of DESC, confidence DESC, seq) = 1)
  SELECT entity AS name, state_key, entity || '''s ' || state_key || ' is ' || value AS claim FROM c WHERE entity IN ('user-1', 'user-2')""")
def seed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("user-1", "person"), ("user-2", "person"), ("user-3", "place")], "name string, type string")
    return fanout.seed_states(seeds, states.current_state(Q.measured(spark, sf_dir))).select("name", "state_key", "claim")


@_query("""WITH RECURSIVE a AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS subject, 'n' || CAST((n_nationkey + 1) % 25 AS VARCHAR) AS object, (n_nationkey % 7 + 2) / 10.0::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'n' || CAST((n_nationkey + 2) % 25 AS VARCHAR), 0.5 FROM nation),
  b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, object) = 1),
  w AS (SELECT 1 AS hop, subject, object, confidence FROM b WHERE subject = 'n0' UNION ALL SELECT hop + 1, b.subject, b.object, b.confidence FROM w JOIN b ON b.subject = w.object WHERE hop < 6)
  SELECT hop, subject, object, confidence, min(confidence) OVER () AS path_confidence FROM w""")
def strongest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hops along the strongest edges, with the least confidence of the path."""
    k, node = F.col("n_nationkey"), lambda x: F.concat(F.lit("n"), x.cast("string"))
    n = _table(spark, sf_dir, "nation")
    edges = n.select(node(k).alias("subject"), F.lit("NEXT").alias("relation"), node((k + 1) % 25).alias("object"), ((k % 7 + 2) / 10).alias("confidence")).unionByName(n.select(node(k).alias("subject"), F.lit("NEXT").alias("relation"), node((k + 2) % 25).alias("object"), F.lit(0.5).alias("confidence")))
    start = spark.createDataFrame([("n0",)], "start string")
    return fanout.strongest_paths(edges, 6, starts=start).select("hop", "subject", "object", "confidence", "path_confidence")


@_query("""WITH RECURSIVE a AS (SELECT 'p' || page_id AS subject, 'p' || ((page_id * 7 + 1) % 997) AS object, (page_id % 7 + 2) / 10.0::DOUBLE AS confidence FROM pages UNION ALL SELECT 'p' || page_id, 'p' || ((page_id * 3 + 2) % 997), 0.5 FROM pages),
  b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, object) = 1),
  w AS (SELECT subject AS start, 1 AS hop, subject, object, confidence, [subject] AS seen FROM b WHERE object <> subject UNION ALL
    SELECT start, hop + 1, b.subject, b.object, b.confidence, list_append(seen, b.subject) FROM w JOIN b ON b.subject = w.object WHERE hop < 13 AND NOT list_contains(list_append(seen, b.subject), b.object))
  SELECT start, hop, subject, object, confidence, min(confidence) OVER (PARTITION BY start) AS path_confidence FROM w""")
def strongest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen hops from every page; a thousand pages are linked to by all others, and paths run into cycles."""
    k, node = F.col("page_id"), lambda x: F.concat(F.lit("p"), x.cast("string"))
    p = _table(spark, sf_dir, "pages")
    edges = p.select(node(k).alias("subject"), F.lit("LINKS").alias("relation"), node((k * 7 + 1) % 997).alias("object"), ((k % 7 + 2) / 10).alias("confidence")).unionByName(p.select(node(k).alias("subject"), F.lit("LINKS").alias("relation"), node((k * 3 + 2) % 997).alias("object"), F.lit(0.5).alias("confidence")))
    return fanout.strongest_paths(edges, 13).select("start", "hop", "subject", "object", "confidence", "path_confidence")


@_query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 100 = 0)
  SELECT a AS mention, 'v-' || lpad(CAST(b AS VARCHAR), 9, '0') AS name, round(s, 6) AS score FROM p WHERE s >= 0.85""")
def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Q.vectors(spark, sf_dir)
    return resolution.semantic_pairs(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("mention"), "type", "embedding"), v.select("name", "type", "embedding")).select("mention", "name", F.round("score", 6).alias("score"))


@_query(f"WITH {_NOTES}, a AS (SELECT {_TR}, 1 - product(1 - confidence) AS confidence FROM n GROUP BY ALL), o AS (SELECT DISTINCT {_TR} FROM n WHERE domain = 'trade') SELECT {_TR} FROM a ANTI JOIN o USING ({_TR})")
def delta_new_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    new, _ = ledger.assemble_delta(rows.withColumn("evidence", F.array("evidence")), ledger.arrows(rows.where("domain = 'trade'")))
    return new.select(*TRIPLE)


# --- maintenance ----------------------------------------------------------------------------------------------------


@_query(f"WITH {_NOTES} SELECT seq FROM n WHERE seq % 2 = 0 AND seq % 3 <> 0")
def rows_without_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).withColumns({"evidence": F.when(F.col("seq") % 3 != 0, F.col("evidence")).otherwise(""), "evidence_embedding": F.when(F.col("seq") % 2 == 1, F.array(F.lit(1.0)))})
    return search.without_embedding(rows).select("seq")


@_query(f"WITH {_NOTES} SELECT seq, CASE WHEN seq % 2 = 1 THEN 1.0 WHEN seq % 3 = 0 THEN NULL ELSE strlen(evidence) END::DOUBLE AS vector FROM n")
def vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).withColumns({"evidence": F.when(F.col("seq") % 3 != 0, F.col("evidence")).otherwise(""), "evidence_embedding": F.when(F.col("seq") % 2 == 1, F.array(F.lit(1.0)))})
    return maintenance.backfill_embeddings(rows, F.array(F.octet_length("evidence").cast("double"))).select("seq", F.col("evidence_embedding")[0].alias("vector"))


@_query(f"""WITH {_NOTES}, f AS (SELECT split_part(source_ref, ':', 1) AS id, min(created_at) AS t FROM n GROUP BY 1) SELECT id, strftime(CASE WHEN CAST(substr(id, 5) AS INTEGER) % 2 = 0 THEN TIMESTAMP '2000-01-01' ELSE t END, '%Y-%m-%d') AS first_seen,
  (SELECT count(*) FROM f WHERE CAST(substr(id, 5) AS INTEGER) % 2 = 1) AS created, (SELECT count(*) FROM n) AS linked FROM f""")
def source_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).withColumn("source_id", F.lit(None).cast("string"))
    known = rows.select(S.source_prefix("source_ref").alias("id")).distinct().where("CAST(substr(id, 5) AS INT) % 2 = 0").withColumn("first_seen", F.lit("2000-01-01").cast("timestamp"))
    sources, _, report = maintenance.backfill_sources(rows, known)
    return sources.crossJoin(F.broadcast(report)).select("id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.col("sources_created").alias("created"), F.col("rows_linked").alias("linked"))  # the report is one row


@_query(f"""WITH {_NOTES}, a AS (SELECT {_TR}, 1 - product(1 - confidence) AS confidence FROM n GROUP BY ALL), r AS (SELECT DISTINCT {_TR} FROM n WHERE domain = 'trade'), m AS (SELECT * FROM a ANTI JOIN r USING ({_TR}))
  SELECT {_TR}, 'doc-x:1' AS source_ref, round(confidence + 3.3e-10, 6) AS confidence, 'one' || chr(10) || 'two' AS evidence, (SELECT max(seq) FROM n WHERE domain = 'trade') + row_number() OVER (ORDER BY {_TR}) AS seq FROM m""")
def ledger_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that arrows without any get."""
    rows = notes(spark, sf_dir)
    held = _shaped(rows.where("domain = 'trade'"), LEDGER)
    arrows = _shaped(ledger.arrows(rows).withColumns({"evidence": F.array(F.lit("one"), F.lit(" "), F.lit("two")), "source_ref": F.lit("doc-x:1")}), ARROWS)
    after, _, _ = maintenance.migrate_ledger(arrows, held, _now())
    return after.where(F.col("created_at") == _now()).select(*ledger.IDENTITY, _round("confidence").alias("confidence"), "evidence", "seq")


@_query(f"""WITH {_NOTES}, raw AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'REPLACES' WHEN 1 THEN 'SUPERSEDED_BY' WHEN 2 THEN 'SUPERSEDES' ELSE 'MAY_DESCRIBE' END AS old FROM n), f AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY subject, old, object, source_ref ORDER BY seq) = 1),
  t AS (SELECT *, CASE WHEN old = 'SUPERSEDED_BY' THEN object ELSE subject END AS s, CASE WHEN old IN ('REPLACES', 'SUPERSEDED_BY') THEN 'SUPERSEDES' ELSE old END AS r, CASE WHEN old = 'SUPERSEDED_BY' THEN subject ELSE object END AS o FROM f),
  k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY s, r, o, source_ref ORDER BY r = old AND s = subject AND o = object DESC, seq) = 1)
  SELECT s AS subject, r AS relation, o AS object, round(1 - product(1 - confidence) + 3.3e-10, 6) AS confidence, count(*) AS n_rows FROM k GROUP BY ALL""")
def relation_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrows after rows moved to canonical triples, with the rows that each has then."""
    k = F.col("seq") % 4
    rows = notes(spark, sf_dir).withColumn("relation", F.when(k == 0, "REPLACES").when(k == 1, "SUPERSEDED_BY").when(k == 2, "SUPERSEDES").otherwise("MAY_DESCRIBE"))
    held = _shaped(ledger.dedupe(rows), LEDGER)
    after, arrows, _ = maintenance.normalize_relations(held, _shaped(ledger.arrows(held).drop("source_ref"), ARROWS), _registry(spark), _now())
    return arrows.join(after.groupBy(*TRIPLE).agg(F.count("*").alias("n_rows")), list(TRIPLE)).select(*TRIPLE, _round("confidence").alias("confidence"), "n_rows")


@_query(f"WITH {_NOTES} SELECT DISTINCT lower(relation) AS verb, CASE WHEN relation = 'MAY_DESCRIBE' THEN 'may_describe' ELSE lower(relation) END AS anchor FROM n UNION ALL SELECT 'quite_new', NULL")
def verb_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs of an inventory at the registry or at relations in use; others stay unmatched."""
    rows = notes(spark, sf_dir)
    verbs = rows.select(F.initcap(F.translate("relation", "_", " ")).alias("v")).distinct().unionByName(spark.createDataFrame([("Quite  new!",), ("??",)], "v string"))
    return ingest.anchor_verbs(verbs.select(F.array("v").alias("verbs")), _registry(spark), rows.select("relation").distinct()).select("verb", "anchor")


# --- scalar functions and chunks ------------------------------------------------------------------------------------


@_query("""SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS candidate, CASE WHEN c_custkey % 2 = 0 THEN 'unconditional' ELSE 'if ' || c_mktsegment END AS scope, trim(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'if ' || c_mktsegment END || ' more') AS longer,
  c_name || ' trades with X' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' (if ' || c_mktsegment || ')' END AS claim, '[list/drop_noise] ' || c_name || ' trades with X | evidence: e' AS note, CASE WHEN c_custkey % 2 = 0 THEN 'a|b|c' ELSE 'a|b' END AS united,
  CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END AS n_evidence, 'one' || chr(10) || c_name AS joined, sha256(c_name || chr(31) || 'person') AS element, round(1 - (1 - (c_custkey % 10) / 10.0) * 0.75, 6) AS combined, c_custkey % 10 <> 3 AS differs,
  'https://x.org/?q=' || CAST(c_custkey AS VARCHAR) AS target, c_name || ' & co' AS bare FROM customer""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    even = k % 2 == 0
    rows = _table(spark, sf_dir, "customer").select(
        k.alias("id"), name.alias("name"), F.when(even, "").otherwise(F.concat(F.lit("if "), "c_mktsegment")).alias("scope_in"), F.when(even, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"))).alias("more"),
        F.when(even, F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("evidence"), ((k % 10) / 10).alias("p"),
    )
    x = F.lit("X")
    return rows.select(
        "id", S.normalize_candidate("name").alias("candidate"), S.ensure_scope("scope_in").alias("scope"), S.extend_scope("scope_in", F.lit("more")).alias("longer"), S.scoped_claim("name", F.lit("TRADES_WITH"), x, "scope_in").alias("claim"),
        S.flag_note("name", F.lit("trades_with"), x, F.lit("e"), F.lit("drop_noise"), F.lit("list")).alias("note"), F.array_join(S.append_absent(F.array(F.lit("a"), F.lit("b")), "more"), "|").alias("united"), S.evidence_count("evidence").alias("n_evidence"),
        S.join_evidence(F.array(F.lit("one"), F.lit("  "), F.col("name"))).alias("joined"), S.element_id("name", F.lit("person")).alias("element"), F.round(S.combine("p", F.lit(0.25), F.lit(True)), 6).alias("combined"), S.differs("p", F.lit(0.3)).alias("differs"),
        S.redirect_target(F.concat(F.lit("//duck/l/?uddg=https%3A%2F%2Fx.org%2F%3Fq%3D"), F.col("id").cast("string"), F.lit("&rut=1"))).alias("target"), S.clean_markup(F.concat(F.lit("<b>"), F.col("name"), F.lit("</b> &amp; co "))).alias("bare"),
    )


@_query("""WITH k AS (SELECT 'd' || CAST(c_custkey AS VARCHAR) AS id, c_custkey % 2 AS odd, c_name FROM customer), v(odd, n, path, body) AS (VALUES (0, 1, '', 'before'), (0, 2, 'Top', '# Top' || chr(10) || 'intro'), (0, 3, 'Top > Deep', '### Deep'), (0, 4, 'Top > Mid', '## Mid' || chr(10) || 'more'), (0, 5, 'Next', '# Next'),
  (1, 1, 'A', '## A' || chr(10) || 'x'), (1, 2, 'A > B', '## B'), (1, 3, 'A > B > C', '##### C'), (1, 4, 'A > B > D', '### D'))
  SELECT id || ':chunk-' || CAST(n AS VARCHAR) AS source_ref, n AS ordinal, path, body || CASE WHEN body LIKE '%more' OR body LIKE '%x' THEN ' ' || c_name ELSE '' END AS text FROM k JOIN v USING (odd)""")
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a heading; a heading that skips levels hangs below what there is."""
    even = F.concat(F.lit("before\r\n# Top\nintro\n\n### Deep  \n## Mid\nmore "), F.col("c_name"), F.lit("\n\n# Next\n"))
    odd = F.concat(F.lit("\n## A\nx "), F.col("c_name"), F.lit("\n## B\n##### C\n### D"))
    docs = _table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("source_id"), F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd).alias("text"))
    return chunking.chunk_markdown(docs).select("source_ref", "ordinal", F.array_join("section_path", " > ").alias("path"), "text")


@_query("""SELECT 'd' || CAST(c_custkey AS VARCHAR) AS source_id, v.n AS ordinal, v.pages AS pages, replace(v.body, '@', c_name) AS text FROM customer, (VALUES (1, '1', 'First.'), (2, '1,2,3', '@ goes on to' || chr(10) || 'the next page,' || chr(10) || 'and ends.'), (3, '3', 'Last of three,'), (4, '4', '2.1 Heading'), (5, '4', 'Done')) v(n, pages, body)""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that go on over one page break or two are joined; numbered headings never are."""
    pages = F.array(F.concat(F.lit("First.\n\n"), F.col("c_name"), F.lit(" goes on to")), F.lit("the next page,"), F.lit(" and ends.\n \nLast of three,"), F.lit("2.1 Heading\n\nDone"))
    docs = _table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("source_id"), pages.alias("pages"))
    return chunking.chunk_pages(docs).select("source_id", "ordinal", F.array_join("pages", ",").alias("pages"), "text")


@_query("SELECT DISTINCT event_type AS label, true AS unknown FROM events UNION ALL SELECT 'net_worth', false WHERE false")
def unknown_state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states.with_unknown_key(Q.measured(spark, sf_dir), _registry(spark))
    return rows.select(F.col("state_key").alias("label"), F.col("unknown_key").alias("unknown")).distinct()


@_query("SELECT DISTINCT lower(c_mktsegment) AS domain, false AS known FROM customer")
def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("domain"))
    return canonical.with_canonical(rows, _registry(spark), "domain", "domain").select("domain", F.col("domain_known").alias("known")).distinct()


# --- scan pass ------------------------------------------------------------------------------------------------------


def _inventory(text: str) -> dict:
    """Stand-in model: a verb for every word in -tion (by its length a known one, one of the graph, or the word), a name for every capital word."""
    import hashlib
    import re

    words = re.findall(r"[a-z]+tion", text)
    names = re.findall(r"[A-Z][a-z]{4,}", text)
    return {"verbs": [("Leads To", "HEDGES", w)[len(w) % 3] for w in words], "entities": [{"name": hashlib.md5(w.encode()).hexdigest(), "type": "company"} for w in names]}


def _cluster(verbs: list[str], entities: list[dict]) -> dict:
    """Stand-in model: verbs by their first two letters, names in capitals."""
    groups = sorted({v[:2] for v in verbs})
    return {"verbs": [{"canonical": f"{g} Kind", "aliases": [v for v in verbs if v.startswith(g)]} for g in groups], "entities": [{"canonical": e["name"].upper(), "entity_type": "product", "aliases": [e["name"]]} for e in entities]}


@_query("""WITH v AS (SELECT conv_id, unnest(regexp_extract_all(text, '[a-z]+tion')) AS w FROM conversations), n AS (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS w FROM conversations),
  m AS (SELECT DISTINCT conv_id, CASE length(w) % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'hedges' ELSE w[1:2] || '_kind' END AS verb FROM v), menu AS (SELECT conv_id, string_agg(verb, ',' ORDER BY verb) AS verb_menu FROM m GROUP BY ALL),
  k AS (SELECT conv_id, w, md5(w) AS h, count(*) AS n, length(w) % 2 = 0 AS stored FROM n GROUP BY ALL), r AS (SELECT conv_id, CASE WHEN stored THEN h || ' (organization; aka: ' || w || ')' WHEN n > 1 THEN h || ' (organization)' ELSE upper(h) || ' (product; aka: ' || h || ')' END AS e FROM k),
  roster AS (SELECT conv_id, string_agg(e, '; ' ORDER BY e) AS entity_roster FROM r GROUP BY ALL),
  asked AS (SELECT DISTINCT conv_id FROM (SELECT conv_id FROM v WHERE length(w) % 3 = 2 UNION ALL SELECT conv_id FROM k WHERE NOT stored)), c AS (SELECT conv_id, CAST(ceil(count(*) / 4) AS INTEGER) AS scan_calls FROM conversations GROUP BY ALL)
  SELECT c.conv_id, coalesce(verb_menu, '') AS verb_menu, coalesce(entity_roster, '') AS entity_roster, scan_calls, CASE WHEN asked.conv_id IS NULL THEN 0 ELSE 1 END AS cluster_calls FROM c LEFT JOIN menu USING (conv_id) LEFT JOIN roster USING (conv_id) LEFT JOIN asked USING (conv_id)""")
def scan_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The menu and roster of every conversation, with the model calls they took. Entities hold the capital words of even length."""
    turns = _table(spark, sf_dir, "conversations")
    chunks = turns.select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("ordinal"), F.concat(F.lit("chunk-"), F.col("turn").cast("string")).alias("chunk_id"), "text", F.array().cast("array<string>").alias("section_path"))
    words = turns.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), 0)).alias("w")).distinct().where("length(w) % 2 = 0")
    known = components.durable(words.select(F.md5("w").alias("name"), F.lit("organization").alias("type"), F.array("w").alias("aliases"), F.lit(None).cast("array<double>").alias("embedding")))
    live = spark.createDataFrame([("HEDGES",)], "relation string")
    found = scan_pass(chunks, known, live, _registry(spark), _inventory, lambda df, name: components.durable(df), _cluster)
    joined = lambda c, sep: F.array_join(F.array_sort(c), sep)
    return found.hints.select(F.col("source_id").cast("long").alias("conv_id"), joined(F.col("verb_menu"), ",").alias("verb_menu"), joined(render_roster("entity_roster"), "; ").alias("entity_roster"), "scan_calls", "cluster_calls")
