"""Entity resolution: similarity joins in the JVM, and the order-dependent cascade per group of mentions that could decide on one another.

A mention is resolved against stored entities of its type and against what its
session made of earlier mentions of that type. A (session, type) of up to
``WHOLE`` mentions is folded in ``seq`` order as it is. In a larger one only an
earlier mention that is equal, or that may have been created and is similar,
contained or near by vector, can matter: its mentions fall into the connected
components of that relation, and each component is folded by itself. A mention
with a store match by name creates nothing, so it needs no search by vector. A
group's mentions and the stored entities that could match one of them are what
one call holds.

The joins: names by the rarest positional q-grams (prefix filtering), token sets
by their rarest token, vectors in blocks of near ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.scalars import best_ratio, cosine, fuzzy_ratio, name_tokens, normalize_name
from attesta.operators.components import components, durable
from attesta.operators.vectors import near_links, near_vectors

FUZZY, SEMANTIC, MARGIN, CORROBORATIONS = 0.90, 0.85, 0.05, 2
WHOLE = 500  # mentions of a session and type that are folded without a search for their components
LOT = 500  # mentions that one call folds, about: whole groups and components
RESULT = "session string, type string, seq long, mention string, outcome string, canonical string, layer string, new_alias string, matches array<struct<score:double,name:string,layer:string>>"


def norm(value: str) -> str:
    return re.sub("[^a-z0-9]+", " ", value.casefold()).strip()


def _tokens(values: list[str]) -> frozenset[str]:
    return frozenset(t for v in values for t in norm(v).split())


def _cos(a, b) -> float:
    n = min(len(a), len(b))
    x, y = np.asarray(a[:n], float), np.asarray(b[:n], float)
    d = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(x @ y) / d if d else 0.0


class Known:
    """An identity that mentions can resolve to."""

    def __init__(self, name: str, aliases: list[str], vector, corroborations: int = 0):
        self.name, self.aliases, self.vector, self.corroborations = name, list(aliases), vector, corroborations
        self.fuzzy_names = [norm(name), *map(norm, aliases)]
        self.names, self.tokens = frozenset(self.fuzzy_names), _tokens([name, *aliases])


class _Rows:
    """A matrix that grows by rows."""

    def __init__(self, width: int = 0):
        self._data, self._n = np.zeros((16, width)), 0

    def add(self, row: np.ndarray) -> None:
        rows, width = self._data.shape
        if self._n == rows or len(row) > width:
            grown = np.zeros((max(rows, 2 * self._n), max(width, len(row))))
            grown[:rows, :width] = self._data
            self._data = grown
        self._data[self._n, : len(row)] = row
        self._n += 1

    def rows(self) -> np.ndarray:
        return self._data[: self._n]


def _letters_of(name: str) -> np.ndarray:
    return np.bincount(np.frombuffer(name.encode("ascii"), np.uint8), minlength=128)[:128]


class Pool:
    """Identities in their order. Names and vectors are held against bounds all at once; only what these leave is scored."""

    def __init__(self, items: list[Known] = ()):
        self.items: list[Known] = []
        self.exact: dict[str, list[Known]] = {}
        self._letters, self._lengths, self._named = _Rows(128), _Rows(1), []
        self._units, self._with_vector = _Rows(), []
        self._by_token: dict[str, list[int]] = {}
        for k in items:
            self.add(k)

    def add(self, known: Known) -> None:
        at = len(self.items)
        self.items.append(known)
        for name in known.names:
            self.exact.setdefault(name, []).append(known)
            self._letters.add(_letters_of(name))
            self._lengths.add(np.array([len(name)]))
            self._named.append(at)
        for token in known.tokens:
            self._by_token.setdefault(token, []).append(at)
        if known.vector is not None:
            self._units.add(_unit(known.vector))
            self._with_vector.append(at)

    def similar(self, key: str) -> list[tuple[float, Known]]:
        """Every identity with a name or alias whose ratio is at least FUZZY: the letters that two names share bound it."""
        if not self.items:
            return []
        shared = np.minimum(self._letters.rows(), _letters_of(key)).sum(axis=1)
        may = np.flatnonzero(2 * shared >= (FUZZY - 1e-9) * (self._lengths.rows()[:, 0] + len(key)))
        owners = sorted({self._named[i] for i in may})
        return [(r, k) for k in (self.items[i] for i in owners) if (r := best_ratio(key, k.fuzzy_names)) >= FUZZY]

    def near(self, vector) -> list[tuple[float, Known]]:
        if vector is None or not self._with_vector:
            return []
        units, own = self._units.rows(), _unit(vector)
        n = min(units.shape[1], len(own))
        may = np.flatnonzero(units[:, :n] @ own[:n] >= SEMANTIC - 1e-9)
        return [(c, k) for k in (self.items[self._with_vector[i]] for i in may) if (c := _cos(vector, k.vector)) >= SEMANTIC]

    def contained(self, own: frozenset[str]) -> list[Known]:
        """One of two sets holds the other, so they share a token."""
        may = sorted({i for t in own for i in self._by_token.get(t, ())})
        return [k for k in (self.items[i] for i in may) if own < k.tokens or k.tokens < own]


def _unit(vector) -> np.ndarray:
    v = np.asarray(vector, float)
    n = float(np.linalg.norm(v))
    return v / n if 0 < n < float("inf") else np.zeros(len(v))


def _margin(scored: list[tuple[float, Known]]) -> Known | None:
    scored = sorted(scored, key=lambda x: (-x[0], x[1].name))
    if len(scored) == 1 or scored and scored[0][0] - scored[1][0] >= MARGIN:
        return scored[0][1]
    return None


def resolve_one(mention: str, vector, session: Pool, store: Pool, recorded: dict[str, Known] | None = None) -> tuple[str, str | None, str, list[tuple[float, str]]]:
    """(outcome, canonical, layer, matches): the first decisive layer wins; queue where it is ambiguous.

    ``session`` holds the entities that the session created; ``recorded`` the
    aliases that it has recorded so far (of stored entities too), which only
    exact lookups see.
    """
    key = norm(mention)
    own = _tokens([mention])

    def show(scored: list[tuple[float, Known]]) -> list[tuple[float, str]]:
        return sorted(((s, k.name) for s, k in scored), key=lambda x: (-x[0], x[1]))

    if hit := next(iter(session.exact.get(key, ())), None) or (recorded or {}).get(key):
        return "resolve", hit.name, "session_exact", [(1.0, hit.name)]
    if found := session.similar(key):
        return ("resolve", found[0][1].name, "session_fuzzy", show(found)) if len(found) == 1 else ("queue", None, "session_fuzzy", show(found))
    if found := session.near(vector):
        best = _margin(found)
        return ("resolve", best.name, "session_semantic", show(found)) if best else ("queue", None, "session_semantic", show(found))
    if exact := store.exact.get(key):
        shown = show([(1.0, k) for k in exact])
        return ("resolve", exact[0].name, "store_exact", shown) if len(exact) == 1 else ("queue", None, "store_exact", shown)
    if found := store.similar(key):
        return ("resolve", found[0][1].name, "store_fuzzy", show(found)) if len(found) == 1 else ("queue", None, "store_fuzzy", show(found))
    for pool, layer in ((store, "store_containment"), (session, "session_containment")):
        if near := pool.contained(own):
            scored = [(_cos(vector, k.vector) if vector is not None and k.vector is not None else 0.0, k) for k in near]
            sure = [(s, k) for s, k in scored if s >= SEMANTIC]
            if len(sure) == 1:
                return "resolve", sure[0][1].name, layer, show(scored)
            return "queue", None, layer, show(scored)
    if found := store.near(vector):
        best = _margin(found)
        if best is None:
            backed = [k for _, k in found if k.corroborations >= CORROBORATIONS]
            best = backed[0] if len(backed) == 1 else None
        return ("resolve", best.name, "store_semantic", show(found)) if best else ("queue", None, "store_semantic", show(found))
    return "create", mention, "create", []


#: Layers whose match is recorded as a new alias: exact ones found the name there already, and a vector alone doesn't name a stored entity.
_ALIASING = ("session_fuzzy", "session_semantic", "store_fuzzy", "store_containment", "session_containment")


def resolve_group(mentions: pd.DataFrame, store: pd.DataFrame) -> pd.DataFrame:
    pool = Pool([Known(r.name_, [] if r.aliases is None else list(r.aliases), r.embedding, int(r.corroborations or 0)) for r in store.rename(columns={"name": "name_"}).itertuples()])
    session = Pool()
    by_name: dict[str, Known] = {}
    for k in pool.items:
        by_name.setdefault(k.name, k)
    created: dict[str, Known] = {}
    recorded: dict[str, Known] = {}
    out = []
    for m in mentions.sort_values("seq").itertuples():
        outcome, canonical, layer, matches = resolve_one(m.mention, m.embedding, session, pool, recorded)
        alias = None
        if outcome == "create":
            created.setdefault(m.mention, Known(m.mention, [], m.embedding))
            session.add(created[m.mention])
        elif outcome == "resolve":
            known = created.get(canonical) or by_name[canonical]
            if layer in _ALIASING and norm(m.mention) not in known.names:
                recorded[norm(m.mention)] = known
                alias = m.mention
        out.append((m.session, m.type, m.seq, m.mention, outcome, canonical, layer, alias, [{"score": s, "name": n, "layer": layer} for s, n in matches]))
    return pd.DataFrame(out, columns=["session", "type", "seq", "mention", "outcome", "canonical", "layer", "new_alias", "matches"])


def resolve(mentions: DataFrame, entities: DataFrame, whole: int = WHOLE) -> DataFrame:
    """RESULT for every mention (session, type, seq, mention, embedding) against ``entities`` (name, type, aliases, embedding, corroborations).

    Null mentions count as empty names, rows that repeat are resolved one after another (in any order where their
    seq is the same); without entities or mentions nothing fails. ``whole`` changes the work, not the result.
    """
    entities = entities if "corroborations" in entities.columns else entities.withColumn("corroborations", F.lit(0))
    columns = mentions.select("session", "type", F.col("seq").cast("long").alias("seq"), F.coalesce("mention", F.lit("")).alias("mention"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = durable(columns.withColumns({"__x": normalize_name("mention"), "__node": F.monotonically_increasing_id()}))
    entities = entities.toDF(*entities.columns)  # both sides may come from one table
    matches, unmatched = store_matches(own, entities)
    sizes = durable(own.groupBy("session", "type").agg(F.count("*").alias("n"), F.min("__node").alias("first")))
    group = own["session"].eqNullSafe(sizes["session"]) & own["type"].eqNullSafe(sizes["type"])
    sized = own.join(sizes, group).select(own["*"], "n", "first")
    placed = sized.where(F.col("n") <= whole).withColumn("__root", F.col("first"))
    if not sizes.where(F.col("n") > whole).isEmpty():
        large = durable(sized.where(F.col("n") > whole))
        roots = components(_decisive(large, unmatched))
        placed = placed.unionByName(large.join(roots.withColumnRenamed("member", "__node"), "__node", "left").withColumn("__root", F.coalesce("root", "__node")).drop("root"))
    placed = durable(placed.select("__root", "__x", "session", "type", "seq", "mention", "embedding"))
    store = candidates(placed, entities, matches, unmatched)
    lots = sizes.agg(F.sum("n")).first()[0] or 0
    lot = F.pmod(F.xxhash64("__root"), F.lit(lots // LOT + 1)).alias("__lot")
    store = store.toDF(*store.columns).select(lot, "*")  # names of its own for the key that both sides share
    columns = ["session", "type", "seq", "mention", "outcome", "canonical", "layer", "new_alias", "matches"]

    def run(m: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        known = {root: rows for root, rows in s.groupby("__root", sort=False)}
        found = [resolve_group(rows, known.get(root, s[:0])) for root, rows in m.groupby("__root", sort=False)]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    return placed.drop("__x").select(lot, "*").groupBy("__lot").cogroup(store.groupBy("__lot")).applyInPandas(run, RESULT)


def _decisive(own: DataFrame, unmatched: DataFrame) -> DataFrame:
    """a, b (__node): links whose components hold every two mentions of a session and type that could decide on one another.

    Only a name without a store match by name (``unmatched``: g the type, x) may be created, and only what is created
    is met by similarity, containment or vector. Equal names are linked to the first of them, which stands for the name
    in all other links.
    """
    g = F.struct("session", "type")
    names = durable(own.groupBy(g.alias("g"), F.col("__x").alias("x")).agg(F.min("__node").alias("first")))
    equal = own.select(g.alias("g"), F.col("__x").alias("x"), F.col("__node").alias("a")).join(names, ["g", "x"]).select("a", F.col("first").alias("b"))
    free = unmatched.toDF("free_g", "free_x")
    may = durable(names.join(free, names["g.type"].eqNullSafe(free["free_g"]) & (names["x"] == free["free_x"]), "left_semi"))
    if may.isEmpty():
        return equal
    bare, new = names.select("g", "x"), may.select("g", "x")
    tokens = new.select("g", "x", _tokens_of("x").alias("tokens"))
    # What is contained is looked for where the store has no match by name, so both sides are such.
    by_name = near_names(new, bare, FUZZY).where("x <> y").select("g", "x", "y").unionByName(subset_pairs(tokens, tokens.toDF(*tokens.columns)).select("g", "x", "y"))
    a, b = names.withColumnRenamed("first", "a"), names.select("g", F.col("x").alias("y"), F.col("first").alias("b"))
    by_name = by_name.join(a, ["g", "x"]).join(b, ["g", "y"]).select("a", "b")
    held = own.where("embedding IS NOT NULL").select(g.alias("s"), F.to_json(g).alias("type"), "embedding", F.col("__x").alias("x"), F.col("__node").alias("b"))
    same = durable(held.groupBy("type", "embedding").agg(F.min("b").alias("name")))  # equal vectors are linked to the first of them
    again = held.join(same, ["type", "embedding"]).select(F.col("b").alias("a"), F.col("name").alias("b"))
    made = held.join(new.select(F.col("g").alias("s"), "x"), ["s", "x"], "left_semi").select("type", "embedding").distinct()
    side = lambda df: df.select(F.col("type").alias("g"), F.col("name").alias("id"), F.col("embedding").alias("v"))
    by_vector = near_links(side(same), SEMANTIC, side(same.join(made, ["type", "embedding"], "left_semi"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return equal.unionByName(by_name).unionByName(by_vector).unionByName(again)


def store_matches(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, x, name: the entities of a type that the first store layer by name with any match has for a normalized mention; g, x: mentions without any).

    The layers are asked in their order, equal names or aliases, similar ones, contained token sets, each for what
    those before have left: a layer with a match decides, whatever later ones would have.
    """
    bare = durable(mentions.select(F.col("type").alias("g"), F.col("__x").alias("x")).distinct())
    stored = durable(entities.select(F.col("type").alias("g"), "name", F.explode(_names(entities)).alias("y")).distinct())
    found, left = [], bare

    def ask(layer) -> None:
        nonlocal left
        if not left.isEmpty():
            found.append(durable(layer(left).select("g", "x", "name").distinct()))
            left = durable(left.join(found[-1].select("g", "x").distinct(), ["g", "x"], "left_anti"))

    ask(lambda rest: rest.join(stored.withColumnRenamed("y", "x"), ["g", "x"]))
    ask(lambda rest: near_names(rest, stored.select("g", "y").distinct(), FUZZY).join(stored, ["g", "y"]))
    theirs = entities.select(F.col("type").alias("g"), F.col("name").alias("x"), _pooled_tokens(entities).alias("tokens")).distinct()

    def contained(rest: DataFrame) -> DataFrame:
        mine = rest.select("g", "x", _tokens_of("x").alias("tokens"))
        inside = subset_pairs(mine, theirs).select("g", "x", F.col("y").alias("name"))
        return inside.unionByName(subset_pairs(theirs, mine).select("g", F.col("y").alias("x"), F.col("x").alias("name")))

    ask(contained)
    matches = found[0] if found else bare.select("g", "x", F.col("x").alias("name"))  # no mentions, no matches
    for more in found[1:]:
        matches = matches.unionByName(more)
    return matches, left


def candidates(mentions: DataFrame, entities: DataFrame, matches: DataFrame, unmatched: DataFrame) -> DataFrame:
    """__root and the entities of its mentions' type that some layer could pick for one of them: ``matches`` by name, near vectors for names without any.

    mentions: __root, __x (the normalized mention), type, embedding.
    """
    named = mentions.select("__root", F.col("type").alias("g"), F.col("__x").alias("x")).distinct()
    keys = named.join(matches, ["g", "x"]).select("__root", F.col("g").alias("type"), "name")
    asked = mentions.where("embedding IS NOT NULL").select(F.col("type").alias("g"), F.col("__x").alias("x"), F.col("__root").alias("id"), F.col("embedding").alias("v")).join(unmatched, ["g", "x"], "left_semi").select("g", "id", "v").distinct()
    asked = durable(asked)
    if not asked.isEmpty():
        held = entities.where("embedding IS NOT NULL").select("type", "name", F.col("embedding").cast("array<double>").alias("v"))
        each = _numbered(held)
        by_vector = near_vectors(asked, each, SEMANTIC).distinct().join(each.select("g", "v", F.col("id").alias("y")), "y").join(held.withColumnRenamed("type", "g"), ["g", "v"]).select(F.col("x").alias("__root"), F.col("g").alias("type"), "name")
        keys = keys.unionByName(by_vector)
    columns = entities.select("name", "type", "aliases", F.col("embedding").cast("array<double>").alias("embedding"), F.col("corroborations").cast("int").alias("corroborations"))
    return keys.distinct().join(columns, ["type", "name"]).select("__root", "name", "aliases", "embedding", "corroborations")


def _numbered(vectors: DataFrame) -> DataFrame:
    """g, id, v: a number for each different vector of a type (``vectors``: type, v)."""
    return durable(vectors.select(F.col("type").alias("g"), "v").where("g IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()))


def semantic_pairs(mentions: DataFrame, entities: DataFrame, threshold: float = SEMANTIC) -> DataFrame:
    """Pairs of one type with a cosine of at least ``threshold`` (above 0): columns of ``mentions``, name, score.

    Different vectors meet in blocks of near ones (``operators.vectors``) and are
    scored; rows with equal vectors join what was found for one of them.
    """
    asked = mentions.where("embedding IS NOT NULL").withColumn("__v", F.col("embedding").cast("array<double>"))
    own = entities.where("embedding IS NOT NULL").select("type", "name", F.col("embedding").cast("array<double>").alias("__w"))
    left, right = _numbered(asked.select("type", F.col("__v").alias("v"))), _numbered(own.select("type", F.col("__w").alias("v")))
    near = near_vectors(left, right, threshold)
    near = near.join(left.select(F.col("g").alias("type"), F.col("id").alias("x"), F.col("v").alias("__v")), "x").join(right.select(F.col("id").alias("y"), F.col("v").alias("__w")), "y")
    scored = near.select("type", "__v", "__w", cosine("__v", "__w").alias("score")).where(F.col("score") >= threshold)
    return asked.join(scored, ["type", "__v"]).join(own, ["type", "__w"]).select(*mentions.columns, "name", "score")


def _tokens_of(normalized: str):
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def _pooled_tokens(entities: DataFrame):
    """The tokens of the name and of all aliases together."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in entities.columns else F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(name_tokens("name"), F.array().cast("array<string>")), F.flatten(F.transform(F.array_compact(aliases), name_tokens))))


def subset_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(g, x, y): the tokens of x of ``small`` are a strict, not empty, subset of those of y of ``large`` (both g, x, tokens; distinct).

    A set that holds another holds the rarest of its tokens, so a set is looked
    for under that one only, and a token that all names have brings nobody
    together. Sets with a token that ``large`` doesn't have are out at once.
    """
    index = large.select("g", F.col("x").alias("y"), F.col("tokens").alias("__all"), F.explode("tokens").alias("t"))
    counts = index.groupBy("g", "t").agg(F.count("*").alias("n"))
    own = small.select("g", "x", "tokens", F.explode("tokens").alias("t")).join(counts, ["g", "t"])
    rarest = own.groupBy("g", "x", "tokens").agg(F.min_by("t", F.struct("n", "t")).alias("t"), F.count("*").alias("k")).where("k = size(tokens)").drop("k")
    holds = (F.size("tokens") < F.size("__all")) & (F.size(F.array_except("tokens", "__all")) == 0)
    return rarest.join(index, ["g", "t"]).where(holds).select("g", "x", "y")


def containment_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_name, b_name, type): the tokens of one are a strict subset of the other's (aliases pooled in b)."""
    left = a.select(F.col("type").alias("g"), F.col("name").alias("x"), name_tokens("name").alias("tokens")).distinct()
    right = b.select(F.col("type").alias("g"), F.col("name").alias("x"), _pooled_tokens(b).alias("tokens")).distinct()
    inside = subset_pairs(left, right).select(F.col("g").alias("type"), F.col("x").alias("a_name"), F.col("y").alias("b_name"))
    around = subset_pairs(right, left).select(F.col("g").alias("type"), F.col("y").alias("a_name"), F.col("x").alias("b_name"))
    return inside.unionByName(around).distinct()


#: How often each character of a normalized name is told apart; 63 bits a number.
_COUNTED = (("abcdefg", 9), ("hijklmn", 9), ("opqrstu", 9), ("vwxyz", 9), ("0123456789", 6))
_LENGTHS = 1.1  # lengths are dealt into classes that grow by this factor


def gram_length(threshold: float) -> int:
    """The longest grams of which common blocks always leave one whole at the threshold (above 0): 3, 2 or 1."""
    return next((q for q in (3, 2) if (2 * q - 1) * (1 - threshold) < 1), 1)


def _letters(x: str, letters: str, most: int):
    """Bits that tell how often letters occur: ``most`` a letter, as many of them set as it occurs."""
    return F.expr(" | ".join(f"shiftleft(shiftleft(1L, least(length({x}) - length(replace({x}, '{c}', '')), {most})) - 1, {most * k})" for k, c in enumerate(letters)))


def _grams(names: DataFrame, x: str, q: int) -> DataFrame:
    """``names`` (g, x) with every gram and its place p; both ends are padded."""
    padded = F.concat(F.lit("^" * (q - 1)), F.col(x), F.lit("$" * (q - 1)))
    last = F.length(x) + q - 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda p: F.struct(F.substring(padded, p, F.lit(q)).alias("gram"), p.alias("p")))
    return names.select("g", x, F.explode(each).alias("e")).select("g", x, "e.gram", "e.p")


def near_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(g, x, y, ratio) of distinct normalized names of one group (``left``: g, x; ``right``: g, y or x): all with a Ratcliff-Obershelp ratio of at least ``threshold``.

    A ratio of r leaves at most (1 - r) of both lengths outside the common
    blocks, that is so many letters left out and put in between the two. Each
    letter left out breaks at most q grams of a name of n letters, each one put in
    q - 1; that is most where letters are only left out, q n (2 - 2r) / (2 - r). With
    the grams of all names in one order, rarest first, one more than so many of a
    name's first meet as many of the other's, moved by no more than was put in or
    left out. These keys, in proportion to a name's length, meet by gram and class
    of length. What meets is held against bounds on places, lengths, letters and
    edits, and then scored whole.
    """
    q, t = gram_length(threshold), threshold
    # Normalized names have 37 characters, with the paddings 39: there are at most 39 ** 3 grams, so their counts may be broadcast.
    sides = {"x": left.select("g", "x"), "y": right.select("g", F.col(right.columns[1]).alias("y"))}
    grams = {k: _grams(df, k, q) for k, df in sides.items()}
    counts = grams["x"].select("gram").unionByName(grams["y"].select("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    cls = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(_LENGTHS))).cast("int")
    own, keyed = {}, {}
    for k, df in grams.items():
        n = F.length(k)
        picked = df.join(F.broadcast(counts), "gram").groupBy("g", k).agg(F.collect_list(F.struct("n", "gram", "p")).alias("all"))
        # What is counted of a name is counted once, before its keys fan out; keys carry its number.
        first = F.slice(F.array_sort("all"), F.lit(1), (F.floor(q * n * ((2 - 2 * t) / (2 - t)) + 1e-9) + 1).cast("int"))
        counted = [_letters(k, *c).alias(f"has{i}_{k}") for i, c in enumerate(_COUNTED)]
        own[k] = durable(picked.select(F.col("g").alias(f"g_{k}"), k, n.alias(f"n_{k}"), *counted, F.transform(first, lambda e: F.struct(e["gram"].alias("gram"), e["p"].alias("p"))).alias("first"), F.monotonically_increasing_id().alias(f"id_{k}")))
        least = F.ceil(n * (t / (2 - t)) - 1e-9)
        classes = F.sequence(cls(least), cls(F.floor(n * ((2 - t) / t) + 1e-9))) if k == "x" else F.array(cls(n))
        each = own[k].withColumn("classes", classes).withColumn("e", F.explode("first")).withColumn("class", F.explode("classes"))
        keyed[k] = each.select(F.xxhash64(f"g_{k}", "e.gram", "class").alias("key"), f"id_{k}", f"n_{k}", *[f"has{i}_{k}" for i in range(len(_COUNTED))], F.col("e.p").alias(f"p_{k}"))
    n, m = F.col("n_x"), F.col("n_y")
    most = (1 - t) * (n + m) + 1e-9
    moved = F.col("p_y") - F.col("p_x")
    letters = sum(F.bit_count(F.col(f"has{i}_x").bitwiseXOR(F.col(f"has{i}_y"))) for i in range(len(_COUNTED)))  # what goes or comes flips one bit at most
    may = (2 * moved <= most + m - n) & (-2 * moved <= most + n - m) & (F.abs(n - m) <= most) & (letters <= most)
    # The tables of names are compressed on disk and may look small enough to broadcast: they are dealt instead, whatever their size.
    met = durable(keyed["x"].hint("merge").join(keyed["y"].hint("merge"), "key").where(may).select("id_x", "id_y").distinct())  # written, so that edits are counted once a pair
    edits = (1 - t) * (F.length("x") + F.length("y")) + 1e-9
    named = met.join(own["x"].select("id_x", F.col("g_x").alias("g"), "x").hint("merge"), "id_x").join(own["y"].select("id_y", "g_y", "y").hint("merge"), "id_y").where("g = g_y")  # keys are hashes: groups are told here
    return named.where(F.levenshtein("x", "y") <= edits).select("g", "x", "y").withColumn("ratio", fuzzy_ratio("x", "y")).where(F.col("ratio") >= t)


def _names(entities: DataFrame):
    """The name and the aliases, normalized."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in entities.columns else F.array().cast("array<string>")
    return F.array_compact(F.array_distinct(F.transform(F.concat(F.array("name"), aliases), normalize_name)))


def fuzzy_pairs(a: DataFrame, b: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(type, a_name, b_name, ratio): all pairs of one type, the best ratio of a's name to b's name and aliases. The threshold is above 0."""
    left = a.where("name IS NOT NULL").select(F.col("type").alias("g"), F.col("name").alias("a_name"), normalize_name("name").alias("x"))
    right = b.select(F.col("type").alias("g"), F.col("name").alias("b_name"), F.explode(_names(b)).alias("y"))
    scored = near_names(left.select("g", "x").distinct(), right.select("g", "y").distinct(), threshold)
    return scored.join(left, ["g", "x"]).join(right, ["g", "y"]).groupBy(F.col("g").alias("type"), "a_name", "b_name").agg(F.max("ratio").alias("ratio"))


def alias_deltas(resolutions: DataFrame) -> DataFrame:
    """name, type, aliases to add, in mention order; committed after approval only."""
    rows = resolutions.where("new_alias IS NOT NULL AND outcome = 'resolve'")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "new_alias"))), lambda x: x["new_alias"])
    return rows.groupBy(F.col("canonical").alias("name"), "type").agg(F.array_distinct(ordered).alias("aliases"))


def ambiguities(resolutions: DataFrame) -> DataFrame:
    """Queued mentions with a note of their matches, best first."""
    best = F.array_join(F.transform("matches", lambda m: F.format_string("%s (%.2f)", m["name"], m["score"])), ", ")
    return resolutions.where("outcome = 'queue'").select("session", "type", "seq", "mention", "layer", F.concat(F.col("mention"), F.lit(" may be: "), best).alias("note"))


def upsert_entities(stored: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """The next snapshot by (name, type): an empty new vector keeps the old one, unseen aliases are appended."""
    new = incoming.groupBy("name", "type").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("__aliases"), F.max_by("embedding", F.col("embedding").isNotNull()).alias("__embedding"), F.lit(True).alias("__hit"))
    joined = stored.join(new, ["name", "type"], "full_outer")
    empty = F.array().cast("array<string>")
    aliases = F.coalesce("aliases", empty)
    fresh = F.array_except(F.coalesce("__aliases", empty), aliases)
    return joined.withColumns(
        {
            "aliases": F.concat(aliases, fresh), "embedding": F.coalesce(F.col("__embedding").cast("array<double>"), F.col("embedding")),
            "created_at": F.coalesce("created_at", now), "updated_at": F.when(F.col("__hit"), now).otherwise(F.col("updated_at")),
        }
    ).select(*stored.columns)


Embedder = Callable[[str], list[float] | None]


def embedding_udf(embed: Embedder, dimension: int | None = None):
    """A column function over an injected embedder: failures and wrong dimensions give null, and distinct texts of a batch are embedded once."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[float] | None] = {}
        for t in texts.dropna().unique():
            try:
                vector = embed(t) if t else None
            except Exception:  # the contract of the seam: an unreachable model gives no vector
                vector = None
            known[t] = vector if vector is not None and (dimension is None or len(vector) == dimension) else None
        return texts.map(lambda t: known.get(t))

    return run.asNondeterministic()
