"""Vector bin packing into shards: bytes, tokens and rows balanced jointly.

Items are groups of equal texts, placed one after another in the shard whose
residual capacity has the largest dot product with the group's vector (bytes,
tokens, rows as shares of the whole). What is placed on the driver is bounded
whatever the corpus: groups above ``1 / (shards * FINE)`` of the bytes are
placed by themselves (at most ``shards * FINE`` of them), in parts where one is
larger than a quarter of a shard, and all smaller groups are placed by lots,
``shards * LOTS`` hash ranges of the text that keep equal texts together.

Law: ``bytes``. Null text: 8 bytes and no tokens, equal to no empty text's
group but of the same size. Null doc_id: placed and numbered like any other.
Repeated rows: members of one group. Empty table: no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, dense_rank_in

SHARDS, FINE, LOTS, ROW_BYTES = 24, 64, 512, 8


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """A shard for every vector (rows of bytes, tokens, rows), largest first, by dot product with the residual capacity.

    A shard whose bytes are full takes nothing more while another has room.
    """
    total = vectors.sum(0)
    share = vectors / np.where(total > 0, total, 1)
    room = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-share[:, 0], kind="stable"):
        score = room @ share[i]
        fits = room[:, 0] >= share[i, 0]
        best = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(room[:, 0]))
        room[best] -= share[i]
        out[i] = best
    return out


def assign(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, lots: int = LOTS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("long").alias("tokens"),
            F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.md5(F.encode(text, "utf-8"))).alias("key"),
        ),
        "rows",
    )
    lot = F.pmod(F.xxhash64("key"), F.lit(shards * lots))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    whole = rows.agg(*sums).first()
    if not whole.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    groups = scratch.keep(rows.groupBy("key").agg(*sums), "groups")
    large = (F.col("size") > whole.size / (shards * fine))
    singles = groups.where(large).orderBy("key").collect()  # at most shards * fine groups
    mixed = groups.where(~large).groupBy(lot.alias("lot")).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).orderBy("lot").collect()  # at most shards * lots

    items, names = [], []
    for g in singles:  # a group over a quarter of a shard is dealt in parts; a single row can't be
        parts = min(g.n, math.ceil(g["size"] / (whole.size / shards / 4)))
        items += [(g["size"] / parts, g.tokens / parts, g.n / parts)] * parts
        names += [(g.key, p) for p in range(parts)]
    for m in mixed:
        items.append((m["size"], m.tokens, m.n))
        names.append((None, m.lot))
    shard_of = place(np.array(items, float), shards).tolist()
    by_group: dict[str, list[int]] = {}
    by_lot = [0] * (shards * lots)
    for (key, part), shard in zip(names, shard_of, strict=True):
        if key is None:
            by_lot[part] = shard
        else:
            by_group.setdefault(key, []).append(shard)
    own = spark.createDataFrame([(k, v) for k, v in by_group.items()], "key string, __parts array<int>")
    placed = rows.join(F.broadcast(own), "key", "left")  # at most shards * fine rows
    inside = F.element_at("__parts", (F.pmod(F.xxhash64("doc_id", "text_crc32"), F.size("__parts")) + 1).cast("int"))
    in_lot = F.element_at(F.array(*[F.lit(s) for s in by_lot]) if len(by_lot) <= 64 else F.from_json(F.lit(str(by_lot)), "array<int>"), (lot + 1).cast("int"))
    placed = placed.withColumn("shard", F.coalesce(F.when(F.col("__parts").isNotNull(), inside), in_lot).cast("int"))
    ranked = dense_rank_in(placed.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "size", "text_crc32"], whole.n, "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
