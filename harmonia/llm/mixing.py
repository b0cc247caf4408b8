"""Mixing sources to target weights by hierarchical budgeting; DataFrame operations only."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import discard, stash

#: So many leaves may be broadcast; tables with more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Bits of the order that one step of the search for a prefix's end resolves, and up to how many rows of a leaf are sorted at last.
BINS, DETAIL = 10, 1024


def n_tokens(text: Column) -> Column:
    """White-space words of a text; 0 for null and blank texts."""
    own = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "))
    return F.when(own == "", 0).otherwise(F.size(F.split(own, " +"))).cast("long")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _path(names: Sequence[str]) -> Column:
    """A node's path as text; equal only for equal paths, nulls included."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("null")) for n in names])) if names else F.lit("[]")


def allocate(stock: DataFrame, names: Sequence[str], budget: float, weights: Mapping[tuple, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """``stock(names..., tokens)``, a row for each leaf, with the tokens it gets as ``target``.

    A node's budget goes to its children by weight (1 unless ``weights`` has the child's path).
    No subtree gets more than ``epochs`` times its stock: what it can't take goes to its siblings by
    weight until all of them are full; only a subtree that is full as a whole sends the rest to
    its own siblings.  Children of weight 0 get nothing while a sibling of positive weight has room.

    Level by level, for any number of leaves: siblings stand by room over weight, and running sums
    tell up to which of them all are full; the others share what is left by weight."""
    spark = stock.sparkSession
    told = [(json.dumps([f"={x}" if x is not None else "null" for x in path], ensure_ascii=False, separators=(",", ":")), float(w)) for path, w in (weights or {}).items()]
    weight_of = F.broadcast(spark.createDataFrame(told, "path string, w double"))  # a parameter's size
    given = None
    for k in range(1, len(names) + 1):
        nodes = stock.groupBy(*names[:k]).agg((F.sum("tokens") * F.lit(float(epochs))).alias("room"))
        nodes = nodes.select(_path(names[:k]).alias("path"), _path(names[: k - 1]).alias("parent"), "room").join(weight_of, "path", "left")
        tier = F.when(F.coalesce("w", F.lit(1.0)) > 0, 0).otherwise(1)
        nodes = nodes.withColumn("tier", tier).withColumn("w", F.when(F.col("tier") == 1, 1.0).otherwise(F.coalesce("w", F.lit(1.0))))
        if given is None:
            nodes = nodes.withColumn("given", F.least(F.lit(float(budget)), F.sum("room").over(Window.partitionBy("parent"))))
        else:
            nodes = nodes.join(given, "parent")
        ahead = F.coalesce(F.sum(F.when(F.col("tier") == 0, F.col("room"))).over(Window.partitionBy("parent")), F.lit(0.0))
        left = F.col("given") - F.least("given", ahead)
        nodes = nodes.withColumn("given", F.when(F.col("tier") == 0, F.col("given")).when(left > 1e-9, left).otherwise(0.0))
        peers = Window.partitionBy("parent", "tier")
        before = peers.orderBy(F.col("room") / F.col("w"), "path").rowsBetween(Window.unboundedPreceding, -1)
        rest = F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0.0))
        unit = rest / (F.sum("w").over(peers) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        nodes = nodes.withColumn("unit", F.greatest(unit, F.lit(0.0)))
        full = F.col("room") <= F.col("unit") * F.col("w")
        level = F.max(F.when(~full, F.col("unit"))).over(peers)
        given = nodes.select(F.col("path").alias("parent"), F.when(full, F.col("room")).otherwise(F.col("w") * level).alias("given"))
    return stock.withColumn("_path", _path(names)).join(given, F.col("_path") == F.col("parent")).select(*names, "tokens", F.col("given").alias("target"))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def plan(docs: DataFrame, levels: Sequence[str], *, share: float, weights: Mapping[tuple, float] | None, epochs: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, leaves): rows(key, doc_id, levels..., tokens) materialised, and for each leaf its
    full epochs, the cut hash of the last epoch's prefix and its numbers."""
    rows = stash(
        docs.select(
            row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"l{i}") for i, c in enumerate(levels)],
            n_tokens(F.col("text")).alias("tokens"),
        )
    )
    names = [f"l{i}" for i in range(len(levels))]
    stock = stash(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    total = stock.agg(F.sum("tokens")).first()[0] or 0
    gets = allocate(stock, names, share * total, weights, epochs).withColumn("target", F.round("target", 3))
    full = F.when(F.col("tokens") > 0, F.floor((F.col("target") + 1e-6) / F.col("tokens"))).otherwise(0).cast("int")
    leaves = gets.select(*names, F.col("tokens").alias("leaf_tokens"), "target", full.alias("full"))
    leaves = stash(leaves.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("leaf_tokens"))))
    some = _side(leaves.where("rest > 0"))
    placed = rows.join(some, _same(rows, some, names)).select(*[rows[n] for n in names], "tokens", "rest", order(seed).alias("h"))
    cuts = _cuts(placed, names)
    done = stash(
        leaves.join(cuts, _same(leaves, cuts, names), "left").select(*[leaves[n] for n in names], "leaf_tokens", "target", "full", "rest", "cut")
    )
    discard(stock, leaves, cuts)
    return rows, done


def _cuts(placed: DataFrame, names: list[str]) -> DataFrame:
    """(names..., cut): of each leaf whose rows ``placed(names..., tokens, rest, h)`` exceed ``rest``, the
    first place that the prefix leaves out.

    The end is searched by ranges of the order, 2^BINS at a time within the last step's range, until
    no leaf has more than DETAIL rows in it or a range is one place: a window never holds more than
    that of a leaf, however large the leaf."""
    inside, bits = placed.withColumn("ahead", F.lit(0).cast("long")), 0
    found = None
    while True:
        bits = min(64, bits + BINS)
        bins = inside.groupBy(*names, F.shiftright("h", 64 - bits).alias("bin")).agg(
            F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("rest").alias("rest"), F.max("ahead").alias("ahead")
        )
        upto = F.col("ahead") + F.sum("t").over(Window.partitionBy(*names).orderBy("bin"))
        over = bins.withColumn("upto", upto).where("upto > rest")
        first = over.groupBy(*names).agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("t")).alias("ahead"), "rest", "n"), "bin").alias("c"))
        last, found = found, stash(first.select(*names, "c.*"))
        if last is not None:
            discard(last)
        most = found.agg(F.max("n")).first()[0] or 0
        if bits == 64:
            return found.select(*names, F.col("bin").alias("cut"))
        own = _side(found.withColumnRenamed("rest", "its_rest"))
        inside = placed.join(own, _same(placed, own, names)).where(F.shiftright("h", 64 - bits) == F.col("bin"))
        inside = inside.select(*[placed[n] for n in names], "tokens", "rest", "h", "ahead")
        if most <= DETAIL:
            places = inside.groupBy(*names, "h").agg(F.sum("tokens").alias("t"), F.max("ahead").alias("ahead"), F.max("rest").alias("rest"))
            upto = F.col("ahead") + F.sum("t").over(Window.partitionBy(*names).orderBy("h"))
            cuts = stash(places.withColumn("upto", upto).where("upto > rest").groupBy(*names).agg(F.min("h").alias("cut")))
            discard(found)
            return cuts


def order(seed: int) -> Column:
    """Seeded order of a leaf's rows in the epoch after its full ones."""
    return F.xxhash64(F.col("key"), F.lit(seed), F.col("full"))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _copies(seed: int) -> Column:
    part = (F.col("rest") > 0) & (F.col("cut").isNull() | (order(seed) < F.col("cut")))
    return (F.col("full") + part.cast("int")).cast("int")


def mix(docs: DataFrame, levels: Sequence[str] = ("domain", "lang", "source"), *, share: float = 0.5, weights: Mapping[tuple, float] | None = None, epochs: float = 4.0, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, the levels, tokens, target (the leaf's budget), copies.

    The budget is ``share`` of all tokens; it goes down the tree of ``levels`` as ``allocate`` says.
    A leaf takes every row ``full`` times for its whole epochs and, of the next epoch in seeded
    order, the longest prefix of rows whose tokens fit the rest.  ``copies`` counts both.

    Null levels are a branch of their own; null texts have no tokens; equal rows (same id and
    text) have one place in the order and are taken together.  Budgets and cuts are found by
    aggregations, windows and joins over leaves and hash ranges, so neither the number of leaves nor
    the rows of a hot one matter.  An empty table gives no rows."""
    rows, leaves = plan(docs, levels, share=share, weights=weights, epochs=epochs, seed=seed)
    names = [f"l{i}" for i in range(len(levels))]
    leaves = _side(leaves)
    joined = rows.join(leaves, _same(rows, leaves, names))
    return joined.select("doc_id", *[rows[n].alias(c) for n, c in zip(names, levels, strict=True)], "tokens", "target", _copies(seed).alias("copies"))


def keep_mixture(docs: DataFrame, domain: Column, *, share: float, weights: Mapping[tuple, float] | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that one epoch at most of the mixture takes; columns unchanged.  Null levels are a
    branch of their own, and a leaf without any words stays whole."""
    levels = ("domain", "lang", "source")
    own = docs.select("doc_id", "text", "lang", "source").withColumn("domain", domain)
    rows, leaves = plan(own, levels, share=share, weights=weights, epochs=1.0, seed=seed)
    leaves = leaves.select(*[F.col(c).alias(f"_mix_{c}") for c in leaves.columns])
    here = {"l0": domain, "l1": docs["lang"], "l2": docs["source"]}
    on = F.lit(True)
    for n, c in here.items():
        on = on & c.cast("string").eqNullSafe(leaves[f"_mix_{n}"])
    place = F.xxhash64(F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")), F.lit(seed), F.col("_mix_full"))
    taken = (F.col("_mix_full") > 0) | (F.col("_mix_leaf_tokens") == 0) | ((F.col("_mix_rest") > 0) & (F.col("_mix_cut").isNull() | (place < F.col("_mix_cut"))))
    discard(rows)
    return docs.join(_side(leaves), on).where(taken).select(*[docs[c] for c in docs.columns])
