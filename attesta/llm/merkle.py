"""Merkle dataset manifest: every row a leaf, a tree per group, a tree over the groups' roots, proofs by coordinate lookup.

Nodes are SHA-256 in lower-case hex over the concatenated hex of two consecutive
nodes, or of a last one alone; a lone leaf is its tree's root. Everything is
DataFrame work in the JVM:

1. Leaves are hashed once and written. They are numbered within their tree by a
   range partitioning, counts per partition and a prefix sum over those.
2. The node table is built a tile at a time: a tile is ``2 ** TILE`` consecutive
   nodes of one level and the ``TILE`` levels above them, so a group of that many
   digests at most is ever gathered. The tiles' tops are the next tier's nodes.
3. Proofs: a node explodes the coordinates (level, index) of the siblings that
   its index and its tree's size require within its tile, joins the node table,
   orders and concatenates what it found, and appends the proof of its tile,
   which was found the same way one tier up. A node is thus asked for by fewer
   than ``2 ** TILE`` others, however large its tree is; one tree may hold all rows.
4. ``folded`` recomputes a root from a leaf and its siblings.

Defined results. Null in any field: ``-`` stands for it (so it differs from an
empty text, ``0:``). Null group: a tree of its own, the first. Null order: first;
ties are ordered by their leaves, and repeated rows are leaves side by side.
Whole texts, of any length. Empty table: no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, join_counted

#: Levels of a tile; its base has 2 ** TILE nodes.
TILE = 6
#: Leaves a task numbers.
PER_TASK = 250_000
KEY = ["__tree", "__index"]
#: Levels above a tree's leaves.
HEIGHT = "if(__size > 1, length(bin(__size - 1)), 0)"


def encoded(*fields: Column) -> Column:
    """The fields one after another, each as its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(encoded(*fields), 256)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` (a written table with __tree) with __index, gapless from 0 in each tree by ``order``, and __size, the tree's leaves."""
    parts = max(1, math.ceil(rows.count() / PER_TASK))
    dealt = rows.repartitionByRange(parts, "__tree", *order).sortWithinPartitions("__tree", *order)
    dealt = scratch.keep(dealt.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), f"dealt-{name}")
    # A row a partition and tree: partitions are ranges, so these are fewer than partitions and trees together.
    spans = dealt.groupBy("__tree", "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    tree = Window.partitionBy("__tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("__tree", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(tree).alias("__size"))
    out = dealt.join(spans, ["__tree", "__part"]).withColumn("__index", F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")
    out = scratch.keep(out, f"numbered-{name}")
    scratch.drop(f"dealt-{name}")
    return out


def _tiles(base: DataFrame) -> DataFrame:
    """All nodes of the tiles over ``base`` (__tree, __index, __size, __digest; trees of several nodes): with __level in the tile and __top."""
    tile = F.shiftright("__index", TILE)
    held = base.groupBy("__tree", "__size", tile.alias("__tile")).agg(F.array_sort(F.collect_list(F.struct("__index", "__digest"))).alias("__nodes"))
    steps = f"least({TILE}, {HEIGHT})"
    levels = f"""aggregate(slice(sequence(1, {TILE}), 1, {steps}), array(transform(__nodes, x -> x.__digest)),
      (done, l) -> concat(done, array(transform(sequence(0, (size(element_at(done, -1)) - 1) div 2),
        i -> sha2(concat(element_at(done, -1)[2 * i], coalesce(get(element_at(done, -1), 2 * i + 1), '')), 256)))))"""
    each = held.select("__tree", "__size", "__tile", F.expr(steps).alias("__steps"), F.posexplode(F.expr(levels)).alias("__level", "__row"))
    each = each.select("__tree", "__size", "__tile", "__level", (F.col("__level") == F.col("__steps")).alias("__top"), F.posexplode("__row").alias("__at", "__digest"))
    return each.select("__tree", "__level", F.expr(f"__tile * shiftright({1 << TILE}, __level) + __at").cast("long").alias("__index"), "__digest", "__top", "__size")


def _own_siblings(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """__tree, __index, __own: the digests of the siblings within the tile, from the lowest level up."""
    wanted = F.expr(f"""filter(transform(sequence(0, least({TILE}, {HEIGHT}) - 1), l -> named_struct('level', l, 'at', shiftright(__index, l) ^ 1L)),
      c -> c.at <= shiftright(__size - 1, c.level))""")
    asked = base.select(*KEY, F.explode(wanted).alias("__c")).select("__tree", F.col("__index").alias("__of"), F.col("__c.level").alias("__level"), F.col("__c.at").alias("__index"))
    found = asked.join(nodes.where("NOT __top").select("__tree", "__level", "__index", "__digest"), ["__tree", "__level", "__index"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__level", "__digest"))), lambda x: x["__digest"])
    return found.groupBy("__tree", F.col("__of").alias("__index")).agg(ordered.alias("__own"))


def proofs(leaves: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(__tree, __index, __siblings: from the leaf up) and (__tree, __root) for ``leaves`` (__tree, __index, __size, __digest)."""
    tiers, roots = [], []
    base = leaves.select(*KEY, "__size", "__digest")
    while True:
        roots.append(base.where("__size = 1").select("__tree", F.col("__digest").alias("__root")))
        base = base.where("__size > 1")
        if base.isEmpty():
            break
        k = len(tiers)
        nodes = scratch.keep(_tiles(base), f"nodes-{name}-{k}")
        tiers.append((base, scratch.keep(_own_siblings(base, nodes), f"own-{name}-{k}")))
        top = (F.shiftright(F.col("__size") - 1, TILE) + 1).alias("__size")
        base = nodes.where("__top").select("__tree", F.when(F.col("__size") > 1 << TILE, F.col("__index")).otherwise(0).alias("__index"), top, "__digest")
        # A tile's top is its level TILE, or the tree's root, below it; either is the one node of its tile, so its index is the tile's.
    path = None
    none = F.array().cast("array<string>")
    for k, (base, own) in reversed(list(enumerate(tiers))):
        here = base.select(*KEY).join(own, KEY, "left")
        if path is not None:
            above = path.select("__tree", F.col("__index").alias("__tile"), F.col("__siblings").alias("__above"))
            here = here.withColumn("__tile", F.shiftright("__index", TILE)).join(above, ["__tree", "__tile"], "left")
        both = F.concat(F.coalesce("__own", none), F.coalesce("__above", none) if path is not None else none)
        path = scratch.keep(here.select(*KEY, both.alias("__siblings")), f"paths-{name}-{k}")
    all_roots = roots[0]
    for more in roots[1:]:
        all_roots = all_roots.unionByName(more)
    if path is None:
        path = leaves.select(*KEY, none.alias("__siblings")).where("false")
    return path, scratch.keep(all_roots, f"roots-{name}")


def folded(leaf: str, siblings: str, index: str, size: str) -> Column:
    """The root that a leaf at ``index`` of ``size`` leads to with its siblings, lowest first."""
    sibling = f"if((shiftright({index}, l) ^ 1L) <= shiftright({size} - 1, l), get({siblings}, acc.k), '')"
    return F.expr(f"""aggregate(slice(sequence(0, 62), 1, if({size} > 1, length(bin({size} - 1)), 0)), named_struct('d', {leaf}, 'k', 0),
      (acc, l) -> named_struct('d', sha2(if((shiftright({index}, l) & 1L) = 1, concat({sibling}, acc.d), concat(acc.d, {sibling})), 256),
        'k', acc.k + if((shiftright({index}, l) ^ 1L) <= shiftright({size} - 1, l), 1, 0)), acc -> acc.d)""")


def manifest(docs: DataFrame, fields: list[Column], group: Column, order: Column, keep: dict[str, Column], scratch: Scratch | None = None) -> DataFrame:
    """Columns ``keep`` of every row, with

    __leaf; __index and __size, its place among the leaves of its group;
    __siblings, its proof within the group, lowest first; __subroot; __top_index,
    __top_size, __top_siblings, the same for the group's root among all groups
    (by the bytes of their names, null first); __root.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))  # sorts before any "=", and so does null
    hashed = docs.select(*[c.alias(n) for n, c in keep.items()], order.alias("__order"), tree.alias("__tree"), leaf_digest(*fields).alias("__digest"))
    hashed = scratch.keep(hashed.withColumn("__row", F.monotonically_increasing_id()), "hashed")
    leaves = numbered(hashed, ["__order", "__digest", "__row"], scratch, "leaves")
    scratch.drop("hashed")
    paths, roots = proofs(leaves, scratch, "leaves")
    sizes = leaves.groupBy("__tree").agg(F.first("__size").alias("__size"))
    heads = scratch.keep(sizes.join(roots, "__tree").select(F.lit("").alias("__tree"), F.col("__tree").alias("__group"), F.col("__size").alias("__leaves"), F.col("__root").alias("__digest")), "heads")
    tops = numbered(heads, ["__group"], scratch, "heads")
    top_paths, root = proofs(tops, scratch, "heads")
    none = F.array().cast("array<string>")
    per_group = tops.join(top_paths, KEY, "left").join(root, "__tree").select(
        F.col("__group").alias("__tree"), F.col("__leaves").alias("__n"), F.col("__digest").alias("__subroot"), F.col("__index").alias("__top_index"), F.col("__size").alias("__top_size"),
        F.coalesce("__siblings", none).alias("__top_siblings"), "__root",
    )
    per_group = scratch.keep(per_group, "groups")
    rows = leaves.join(paths, KEY, "left").withColumn("__siblings", F.coalesce("__siblings", none))
    out = join_counted(rows, per_group, ["__tree"], "__n", leaves.count())
    scratch.drop("heads", "roots-leaves", "numbered-heads", "roots-heads", *(f"{x}-{n}-{k}" for n in ("leaves", "heads") for k in range(12) for x in ("nodes", "own")))
    scratch.drop(*(f"paths-{n}-{k}" for n, least in (("leaves", 1), ("heads", 0)) for k in range(least, 12)))
    return out.select(*keep, F.col("__digest").alias("__leaf"), "__index", "__size", "__siblings", "__subroot", "__top_index", "__top_size", "__top_siblings", "__root")


def proof_digest() -> Column:
    """H of all siblings of a row of ``manifest``, concatenated."""
    return F.sha2(F.array_join(F.concat("__siblings", "__top_siblings"), ""), 256)


def refolded(rows: DataFrame, leaf: str, out: str) -> DataFrame:
    """``rows`` of ``manifest`` with ``out``: the root recomputed from column ``leaf`` and the siblings."""
    held = rows.withColumn("__sub", folded(leaf, "__siblings", "__index", "__size"))
    return held.withColumn(out, folded("__sub", "__top_siblings", "__top_index", "__top_size")).drop("__sub")
