"""Minimax contiguous partition of documents into shards."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window

from ._store import discard, stash

FIRST_BITS, MORE_BITS = 14, 12
#: A piece of the order with at most so many groups is read whole when a cut falls into it.
DETAIL = 4096


def text_hash(text: Column) -> Column:
    """Place of a text in the order; equal texts share it and so are one atomic group."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


class _Pieces:
    """The ordered groups as the driver sees them: single groups near cuts, sums elsewhere."""

    def __init__(self, groups: DataFrame):
        self.groups, self.shift = groups, 64 - FIRST_BITS
        self.items = self._sums(groups, self.shift)

    @staticmethod
    def _sums(groups: DataFrame, shift: int) -> list[tuple]:
        """(first hash, size, groups, largest group, shift) of each range of hashes, in order."""
        key = F.shiftright("h", shift) if shift else F.col("h")
        rows = groups.groupBy(key.alias("k")).agg(F.sum("size"), F.count("*"), F.max("size"))
        return sorted((k << shift, s, n, m, shift) for k, s, n, m in rows.collect())

    def refine(self, which: set[int]) -> None:
        by: dict[int, list[int]] = {}
        for i in which:
            start, _, n, _, shift = self.items[i]
            by.setdefault((shift, 0 if n <= DETAIL else max(0, shift - MORE_BITS)), []).append(start >> shift)
        fresh: list[tuple] = []
        for (shift, finer), keys in by.items():
            own = self.groups.where(F.shiftright("h", shift).isin(keys))
            fresh += self._sums(own, finer)
        self.items = sorted([x for i, x in enumerate(self.items) if i not in which] + fresh)


def _greedy(upto: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (piece numbers) of shards filled in order, or None if ``shards`` don't suffice."""
    ends, at = [], 0
    for _ in range(shards):
        at = bisect_right(upto, (upto[at - 1] if at else 0) + capacity)
        ends.append(at)
        if at == len(upto):
            return ends
    return None


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(first hashes of shards 1.., smallest feasible capacity) for ``groups(h, size)``.

    The capacity is binary-searched: a capacity is feasible if filling shards greedily in order
    needs no more than ``shards``.  Cuts are then placed in order, each as near to an even share
    of what remains as that capacity allows.  The driver holds sums over 2^14 ranges of the
    order and single groups only inside ranges that some tried cut falls into."""
    pieces = _Pieces(groups)
    if not pieces.items:
        return [], 0
    for _ in range(200):
        items = pieces.items
        upto = list(accumulate(x[1] for x in items))
        coarse: set[int] = set()

        def touched(ends: list[int]) -> None:
            coarse.update(i for e in ends for i in (e,) if i < len(items) and items[i][2] > 1)

        low = max(-(-upto[-1] // shards), max(x[3] for x in items))
        high = max(low, low + max(x[1] for x in items))
        while _greedy(upto, high, shards) is None:
            high *= 2
        while low < high:
            middle = (low + high) // 2
            ends = _greedy(upto, middle, shards)
            if ends is None:
                low = middle + 1
                part, at = [], 0
                for _ in range(shards):
                    at = bisect_right(upto, (upto[at - 1] if at else 0) + middle)
                    part.append(at)
                touched(part)
            else:
                high = middle
                touched(ends)
        capacity, cuts, at = low, [], 0
        touched(_greedy(upto, capacity, shards))
        for left in range(shards - 1, 0, -1):
            done = upto[at - 1] if at else 0
            rest = upto[-1] - done
            goal = done + rest / (left + 1)
            down = bisect_right(upto, goal)
            coarse.update({down} if down < len(items) and items[down][2] > 1 else ())
            best = None
            for end in sorted({max(down, at), min(down + 1, len(upto))}, key=lambda e: abs((upto[e - 1] if e else 0) - goal)):
                size = (upto[end - 1] if end else 0) - done
                tail = [u - done - size for u in upto[end:]]
                if size <= capacity and (not tail or _greedy(tail, capacity, left) is not None):
                    best = end
                    break
            if best is None:
                best = bisect_right(upto, done + capacity)
            cuts.append(best)
            at = best
        if not coarse:
            return [items[c][0] if c < len(items) else None for c in cuts], capacity
        pieces.refine(coarse)
    raise RuntimeError("cuts did not settle")


def shard_of(hash_: Column, cuts: list[int]) -> Column:
    out = F.lit(0)
    for c in cuts:
        if c is not None:
            out = out + (hash_ >= F.lit(c).cast("long")).cast("int")
    return out.cast("int")


def shards(docs: DataFrame, n: int = 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    ``size`` is the text's UTF-8 bytes plus 8.  Equal texts are one atomic group (null counts as
    empty); groups stand in the order of a 64-bit hash of their text and are cut into ``n`` contiguous runs
    whose largest is as small as can be.  ``slot`` counts a shard's rows from 0.  Slots come from a
    range-partitioned sort in which ties are dealt by row, so a group of any size spreads over
    partitions, and from the counts of each partition.  Repeated rows get slots of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), text_hash(F.col("text")).alias("h"),
        )
    )
    groups = stash(rows.groupBy("h").agg(F.sum("size").alias("size")))
    cuts, _ = minimax_cuts(groups, n)
    placed = rows.withColumn("shard", shard_of(F.col("h"), cuts)).withColumn("tie", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    ordered = stash(
        placed.repartitionByRange("h", "tie").sortWithinPartitions("h", "tie").drop("tie", "h").withColumn("mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("mid", 33)
    runs = ordered.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stash(runs.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    runs = runs.withColumnRenamed("shard", "run_shard")
    discard(rows, groups)
    out = ordered.join(runs, (part == F.col("part")) & (F.col("shard") == F.col("run_shard")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("ahead") + F.col("mid") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shard(docs: DataFrame, n: int = 24) -> DataFrame:
    """``docs`` with an int column ``shard``, by the same partition; only hashes and sizes are shuffled."""
    sizes = docs.select(text_hash(F.col("text")).alias("h"), (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 8).cast("long").alias("size"))
    groups = stash(sizes.groupBy("h").agg(F.sum("size").alias("size")))
    cuts, _ = minimax_cuts(groups, n)
    discard(groups)
    return docs.withColumn("shard", shard_of(text_hash(F.col("text")), cuts))
