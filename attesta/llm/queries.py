"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import harmonic, huffman, line_rules, merkle, minhash, packing, sharding, spaced_seeds, suffix_array, toxicity, url_cascade, warc, whitening
from attesta.llm.common import Scratch, read_table


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    warc.write_captures(read_table(spark, sf_dir, "pages"), scratch.path("archives"))
    found = scratch.keep(warc.read_records(spark, scratch.path("archives"), with_payload=False), "records")
    scratch.drop("archives")
    captures = scratch.keep(warc.assemble(found), "captures")
    rows = warc.resolve_revisits(captures, scratch)
    full = F.coalesce("original.response", "response")
    return rows.select(
        warc.page_of("metadata").alias("page_id"),
        full["payload_bytes"].alias("payload_bytes"),
        full["payload_digest"].alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        warc.page_of("original.metadata").alias("refers_to"),
    )


def op2_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean(read_table(spark, sf_dir, "documents"), with_text=False)


def op3_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.col("doc_id").cast("long"), "text"), model, ["doc_id"])
    predicted = F.when(F.col("__score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("__score").alias("score"), predicted.alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch=scratch)


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    folder = scratch.path("ids")
    huffman.write_ids(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), scratch=scratch)
    return huffman.read_digests(spark, folder, scratch)


def op6_vector_bin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    return sharding.assign(read_table(spark, sf_dir, "documents"), scratch=scratch)


def op7_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in url_cascade.LISTED_HOSTS], "key string")
    return url_cascade.judge(read_table(spark, sf_dir, "pages"), listed)


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, scratch=scratch)


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digest columns: what is left of the text, and its length as ``documents`` counts it."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = suffix_array.deduplicate(docs, ["doc_id"], scratch=Scratch(spark, "op10"))
    names = {"__n_bytes": "n_bytes", "__n_removed": "n_removed", "__n_spans": "n_spans", "__sha256": "kept_sha256"}
    return found.select("doc_id", *[F.col(c).alias(name) for c, name in names.items()], F.col("__kept_text").alias("text"), F.length("__kept_text").cast("long").alias("n_chars"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh or so document comes back tampered with, and only its own proof fails."""
    docs = read_table(spark, sf_dir, "documents")
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("decimal(20,0)")
    fields = lambda n: [doc_id, F.col("source"), F.col("lang"), n, F.col("text")]
    hit = n_chars.isNotNull() & F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))
    keep = {"doc_id": doc_id, "received": F.when(hit, merkle.leaf_digest(*fields(n_chars + 1)))}
    rows = merkle.manifest(docs, fields(n_chars), F.col("lang"), doc_id, keep, Scratch(spark, "op11"))
    rows = merkle.refolded(rows.withColumn("received", F.coalesce("received", "__leaf")), "received", "folded_root")
    return rows.select(
        "doc_id", F.col("__leaf").alias("leaf"), F.col("__subroot").alias("subroot"), F.col("__root").alias("root"), merkle.proof_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("__root")).alias("verified"),
    )


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = harmonic.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch=Scratch(spark, "op12"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding")
    rows, basis = whitening.whiten(vectors, "embedding", ["vec_id"], scratch=Scratch(spark, "op13"))
    error = whitening.identity_error(rows)
    entries = F.posexplode(F.arrays_zip(F.col("__whitened").alias("w"), F.col("__explained").alias("e"))).alias("k", "c")
    return rows.select("vec_id", F.col("__deviation").cast("long").alias("deviation"), entries).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(basis.n if basis else 0).cast("long").alias("n"), "deviation", F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_transactions, op2_line_first_cleaning, op3_toxicity_counterfactual, op4_best_fit_packing, op5_token_id_files, op6_vector_bin_shards, op7_url_bloom_cascade, op8_minhash_near_duplicates, op9_spaced_seed_decontamination, op10_suffix_array_dedup, op11_merkle_manifest, op12_harmonic_packing, op13_embedding_whitening)}


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_warc_transactions": """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  o AS (SELECT payload_digest, max(page_id) AS owner FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM d LEFT JOIN o USING (payload_digest)""",
    "op2_line_first_cleaning": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, {_WORDS} AS ws FROM t),
  base AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars FROM w),
  sy AS (SELECT doc_id, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM t),
  x AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w),
  g AS (SELECT doc_id, i, w, lead(w) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  c AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS again FROM g),
  v AS (SELECT doc_id, again OR coalesce(lag(again) OVER d, false) OR coalesce(lag(again, 2) OVER d, false) AS covered FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  rep AS (SELECT doc_id, count(*) FILTER (WHERE covered) AS n_repeat_words FROM v GROUP BY 1),
  l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM t),
  m AS (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
  n AS (SELECT doc_id, bare, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
    NOT regexp_matches(bare, '[.!?…。！？]["'')\]”’»]*$') OR length(regexp_replace(bare, '[^|•·»›]', '', 'g')) >= 3
    OR regexp_matches(lower(bare), 'all rights reserved|accept cookies|cookie policy|privacy policy|terms of service|terms of use|enable javascript|subscribe to our newsletter|click here|sign up for|log in to|follow us on|share this|read more|lorem ipsum|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados')
    OR 10 * length(regexp_replace(bare, '[^#*$%&|<>]', '', 'g')) > length(bare) AS fails FROM m WHERE bare <> ''),
  ln AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (WHERE fails) AS n_failed_lines, sum(length(bare)) AS chars, coalesce(sum(length(bare)) FILTER (WHERE fails), 0) AS chars_lost FROM n GROUP BY 1),
  f AS (SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
    CAST(coalesce(chars, 0) AS BIGINT) AS chars, CAST(coalesce(chars_lost, 0) AS BIGINT) AS chars_lost FROM base JOIN sy USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * chars_lost <= 40 * chars AS kept FROM f""",
    "op7_url_bloom_cascade": """
WITH h AS (SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  r(verdict, rule, rhost, rpath) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
  listed(k) AS (SELECT a || '.example.' || b FROM (VALUES ('cheap-pills'), ('casino-win'), ('spam-farm')) x(a), (VALUES ('com'), ('net'), ('org')) y(b)),
  f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
  i AS (SELECT page_id, bool_or(k IS NOT NULL) AS listed FROM h LEFT JOIN listed ON host = k OR ends_with(host, '.' || k) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM h JOIN i USING (page_id) LEFT JOIN f USING (page_id)""",
    "op8_minhash_near_duplicates": rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.replace("text", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", 1)} AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN ws ELSE ws[i : i + 3] END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM t WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  e AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 80 * (na.n + nb.n - c)),
  bi AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
  walk(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.d, bi.y FROM walk JOIN bi ON walk.r = bi.x)
SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM walk LEFT JOIN n ON n.doc_id = d GROUP BY d""",
    "op10_suffix_array_dedup": """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
  w AS (SELECT doc_id, i, md5(b[i : i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, greatest(octet_length(b) - 398, 1))) AS i FROM t)),
  again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
  s AS (SELECT doc_id, i, i + 400 AS e FROM w WHERE h IN (SELECT h FROM again)),
  m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  k AS (SELECT *, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m),
  r AS (SELECT doc_id, span, min(i) AS a, max(e) AS z FROM k GROUP BY ALL),
  keep AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS lo, a AS hi FROM r UNION ALL SELECT doc_id, max(z), 1000000000 FROM r GROUP BY doc_id),
  n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
  seg AS (SELECT doc_id, lo, hex(b[lo : hi - 1]) AS h FROM keep JOIN t USING (doc_id) WHERE lo < hi),
  bare AS (SELECT *, regexp_replace(regexp_replace(h, '^([89AB][0-9A-F]){1,3}', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '') AS clean FROM seg),
  parts AS (SELECT doc_id, string_agg(h, '' ORDER BY lo) AS hexed, string_agg(decode(unhex(clean)), '' ORDER BY lo) AS kept FROM bare GROUP BY doc_id),
  x AS (SELECT doc_id, CASE WHEN n_removed IS NULL THEN decode(b) ELSE coalesce(kept, '') END AS text FROM t LEFT JOIN n USING (doc_id) LEFT JOIN parts USING (doc_id))
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(coalesce(hexed, '')) END) AS kept_sha256, text, length(text) AS n_chars
FROM t JOIN x USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN parts USING (doc_id)""",
    "op11_merkle_manifest": """
WITH RECURSIVE f AS (SELECT *, coalesce('=' || lang, '-') AS t, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) AS crc FROM documents),
  h AS (SELECT doc_id, t, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS plus, head, tail, n_chars FROM f),
  l AS (SELECT doc_id, t, leaf, sha256(head || coalesce(strlen((n_chars + plus)::VARCHAR) || ':' || (n_chars + plus), '-') || tail) AS received, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM h),
  nodes(t, lv, i, d, n) AS (SELECT t, 0, i, leaf, n FROM l UNION ALL SELECT t, lv + 1, i // 2, sha256(d || coalesce(nxt, '')), (n + 1) // 2 FROM (SELECT *, lead(d) OVER (PARTITION BY t ORDER BY i) AS nxt FROM nodes WHERE n > 1) WHERE i % 2 = 0),
  subs AS (SELECT t, d, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
  tops(lv, i, d, n) AS (SELECT 0, i, d, n FROM subs UNION ALL SELECT lv + 1, i // 2, sha256(d || coalesce(nxt, '')), (n + 1) // 2 FROM (SELECT *, lead(d) OVER (ORDER BY i) AS nxt FROM tops WHERE n > 1) WHERE i % 2 = 0),
  walk(doc_id, t, leaf, lv, i, n, acc, sibs) AS (SELECT doc_id, t, leaf, 0, i, n, received, '' FROM l UNION ALL
    SELECT w.doc_id, w.t, w.leaf, w.lv + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.d || w.acc ELSE w.acc || coalesce(s.d, '') END), w.sibs || coalesce(s.d, '') FROM walk w LEFT JOIN nodes s ON s.t = w.t AND s.lv = w.lv AND s.i = xor(w.i, 1) WHERE w.n > 1),
  up(doc_id, t, leaf, lv, i, n, acc, sibs) AS (SELECT w.doc_id, w.t, w.leaf, 0, s.i, s.n, w.acc, w.sibs FROM walk w JOIN subs s ON s.t = w.t WHERE w.n = 1 UNION ALL
    SELECT w.doc_id, w.t, w.leaf, w.lv + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.d || w.acc ELSE w.acc || coalesce(s.d, '') END), w.sibs || coalesce(s.d, '') FROM up w LEFT JOIN tops s ON s.lv = w.lv AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subs.d AS subroot, (SELECT d FROM tops WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = (SELECT d FROM tops WHERE n = 1) AS verified FROM up JOIN subs USING (t) WHERE up.n = 1""",
}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are held against brute force by the tests."""
    return dict(ORACLES)
