"""Near-duplicate documents by SetSketch registers, banding, likelihood and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._graph import connected_components
from ._memory import lean_batches, lean_groups
from ._store import discard, stash
from ._words import shingle_set, word_hashes

BANDS, ROWS, BASE, LOWEST = 32, 6, 1.2, 12
BLOCK = 256
#: So many ids (16 bytes each in a hash relation) may be broadcast to filter texts before a shuffle.
MOST_BROADCAST = 1_000_000
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
KEYS = [f"k{i}" for i in range(BANDS)]


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: ``floor(1 - log_b(min x))`` of exponential variates ``x``,
    truncated to one byte.  The sketch of a union is the element-wise maximum."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(best, ((low[None, k : k + 1024] ^ _XOR) * _MUL).min(axis=1), out=best)
    x = -np.log1p(-(best.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + LOWEST, 0, 255).astype(np.uint8)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """ROWS one-byte registers packed into one long for each band."""
    shift = np.uint64(8) * np.arange(ROWS, dtype=np.uint64)
    return (regs.reshape(-1, BANDS, ROWS).astype(np.uint64) << shift).sum(axis=2).astype(np.int64)


def unpack(keys: np.ndarray) -> np.ndarray:
    shift = np.uint64(8) * np.arange(ROWS, dtype=np.uint64)
    return ((keys.astype(np.uint64)[:, :, None] >> shift) & np.uint64(255)).astype(np.uint8).reshape(len(keys), -1)


def likely_jaccard(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard index from the numbers of registers in
    which a exceeds b and falls below it, given both cardinalities."""
    grid = np.linspace(0.02, 1.0, 50)
    u = (na / (na + nb))[:, None]
    v = 1 - u
    cap = np.minimum(u / v, v / u)
    j = np.minimum(grid[None, :], cap)
    prob = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = prob(u - v * j), prob(v - u * j)
    same = np.clip(1 - up - down, 1e-12, None)
    total = BANDS * ROWS
    score = more[:, None] * np.log(np.clip(up, 1e-12, None)) + less[:, None] * np.log(np.clip(down, 1e-12, None))
    score += (total - more - less)[:, None] * np.log(same)
    return j[np.arange(len(j)), score.argmax(axis=1)]


def _sketch(n_words: int):
    names = ["doc_id", "n_shingles", "set_hi", "set_lo", *KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            sizes, digest = np.zeros(rows, np.int64), np.zeros((rows, 2), np.int64)
            regs = np.zeros((rows, BANDS * ROWS), np.uint8)
            for row, words in word_hashes(batch.column(1)):
                own = shingle_set(words, n_words)
                sizes[row] = len(own)
                if len(own):
                    digest[row] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                    regs[row] = registers(own)
            keys = band_keys(regs)
            columns = [batch.column(0), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(keys[:, i]) for i in range(BANDS)], names=names)

    return run, ", ".join(f"{c} long" for c in names)


def _estimate(floor: float):
    """Keep pairs whose likelihood estimate reaches ``floor``; columns a, b, na, nb, ka, kb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (unpack(_matrix(batch.column(i))) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            keep = likely_jaccard((a > b).sum(axis=1), (a < b).sum(axis=1), na, nb) >= floor
            keep &= np.minimum(na, nb) >= (floor - 0.02) * np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in batch.columns[:2]], names=["a", "b"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), BANDS)


def _runs(batch: pa.RecordBatch, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices whose texts (columns 2 and 3) have about ``most`` bytes, one row at least."""
    size = np.cumsum(sum(pc.binary_length(batch.column(k)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3)))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _verify(percent: int, n_words: int):
    """Exact Jaccard of the two texts of each row, on their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _runs(whole):
                left = {r: shingle_set(w, n_words) for r, w in word_hashes(batch.column(2))}
                keep = np.zeros(batch.num_rows, bool)
                for r, w in word_hashes(batch.column(3)):
                    x, y = left.pop(r), shingle_set(w, n_words)
                    if not len(x) or not len(y):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[r] = 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _untested(band: int, node: np.ndarray, comp: np.ndarray, n: np.ndarray, keys: np.ndarray, regs: np.ndarray, side: np.ndarray, own: bool, floor: float):
    """For each row of one block pair, its likely partners in other components: pairs that meet in no
    earlier band and of which neither is the bucket's pivot, so that each is examined once."""
    left = np.flatnonzero(side == 0)
    right = left if own else np.flatnonzero(side == 1)
    for i in left:
        js = right[(comp[right] != comp[i]) & ((node[right] > node[i]) if own else True)]
        if not len(js):
            continue
        js = js[(keys[js] == keys[i]).argmax(axis=1) == band]
        small = np.minimum(n[js], n[i]) >= (floor - 0.02) * np.maximum(n[js], n[i])
        js = js[small]
        if len(js):
            est = likely_jaccard(
                (regs[i] > regs[js]).sum(axis=1), (regs[i] < regs[js]).sum(axis=1), np.full(len(js), float(n[i])), n[js].astype(float)
            )
            keep = est >= floor
            if keep.any():
                yield i, js[keep], est[keep]


def _block(key: tuple, table: pa.Table) -> tuple:
    node, comp, n, side = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles", "side"))
    keys = _matrix(table.column("ks").combine_chunks())
    pivot = table.column("pivot").to_numpy() == node
    side = np.where(pivot, -1, side)
    return key[0].as_py(), node, comp, n, keys, unpack(keys), side, key[2].as_py() == key[3].as_py()


def _promising(floor: float):
    """Rows of one block pair that have a likely partner; linear in the rows, whatever the group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for i, js, _ in _untested(*_block(key, table), floor):
            some[i] = True
            some[js] = True
        return table.filter(pa.array(some))

    return run


def _settle(floor: float, percent: int, n_words: int):
    """Verify likely partners on full sets, likeliest first, as long as their components differ."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = _block(key, table)
        node, comp = block[1], block[2]
        pairs = [(float(e), int(i), int(j)) for i, js, est in _untested(*block, floor) for j, e in zip(js, est, strict=True)]
        pairs.sort(key=lambda x: (-x[0], x[1], x[2]))
        sets = {r: shingle_set(w, n_words) for r, w in word_hashes(table.column("text").combine_chunks())}
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c] = parent.get(parent[c], parent[c])
            return c

        found = []
        for _, i, j in pairs:
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x == y:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(x, y)] = min(x, y)
                found.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts whose id is listed: a broadcast up to MOST_BROADCAST counted ids, a shuffle beyond."""
    small = ids.count() <= MOST_BROADCAST
    return texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _linked(pairs: DataFrame, reps: DataFrame, texts: DataFrame, floor: float, percent: int, n_words: int) -> DataFrame:
    """Pairs (a, b) that pass the estimate and the exact check, materialised."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.array(*KEYS).alias(f"k{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ka", "kb")
    pairs = stash(both.mapInArrow(lean_batches(_estimate(floor)), "a long, b long").distinct())
    needed = stash(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    own = _only(texts, needed)
    text = lambda x: own.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    full = pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "ta", "tb")
    links = stash(full.mapInArrow(lean_batches(_verify(percent, n_words)), "a long, b long").distinct())
    discard(pairs, needed)
    return links


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, n_words: int = 5, slack: float = 0.16
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when the Jaccard index of their distinct ``n_words``-word shingles is
    at least ``percent`` / 100.  Equal sets collapse to one representative; each representative's
    192 registers form 32 bands; every bucket's members meet the bucket's smallest member, are
    estimated jointly by likelihood and then verified on full sets.  Buckets that still hold
    several components have their remaining cross-component pairs examined within blocks of rows
    (sketches first, then full sets), each pair once, and only links that join components leave a
    block: no pair of a bucket goes unexamined and no group is expanded into rows of pairs.  At J = 0.85 a
    pair misses every band with probability below 1e-6 (2e-5 at 0.8).

    Null or blank texts have no shingles and link with nothing.  A null id is kept, with a null
    component.  Repeated rows are each returned; rows that share an id are one node.  Other
    columns of ``docs`` are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch, schema = _sketch(n_words)
    every = stash(texts.mapInArrow(lean_batches(sketch), schema))
    floor = percent / 100 - slack
    usable = every.where("n_shingles > 0 and doc_id is not null")
    reps = stash(
        usable.groupBy("set_hi", "set_lo").agg(
            F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles"), *[F.min(k).alias(k) for k in KEYS]
        )
    )
    banded = reps.select("node", F.posexplode(F.array(*KEYS)).alias("band", "key"))
    buckets = stash(
        banded.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    )
    members = banded.join(buckets, ["band", "key"])
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = _linked(stars, reps, texts, floor, percent, n_words)
    first = stash(connected_components(links))

    labelled = (
        members.where("size > 2")
        .join(first, "node", "left")
        .select("band", "key", "size", "pivot", "node", F.coalesce("component", "node").alias("component"))
    )
    mixed = (
        labelled.groupBy("band", "key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("band", "key")
    )
    mixed = stash(mixed)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    open_rows = (
        labelled.join(mixed, ["band", "key"])
        .join(reps.select("node", "n_shingles", F.array(*KEYS).alias("ks")), "node")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "pivot", "component", "n_shingles", "ks",
        )
    )
    promising = stash(open_rows.groupBy("band", "key", "i", "j").applyInArrow(lean_groups(_promising(floor)), open_rows.schema))
    needed = stash(promising.select(F.col("node").alias("doc_id")).distinct())
    full = promising.join(_only(texts, needed).select(F.col("doc_id").alias("node"), "text"), "node")
    later = stash(full.groupBy("band", "key", "i", "j").applyInArrow(lean_groups(_settle(floor, percent, n_words)), "a long, b long").distinct())
    contracted = (
        later.join(first.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(first.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    second = connected_components(contracted).select(F.col("node").alias("component"), F.col("component").alias("top"))
    component = stash(
        reps.select("set_hi", "set_lo", "node")
        .join(first, "node", "left")
        .select("set_hi", "set_lo", F.coalesce("component", "node").alias("component"))
        .join(second, "component", "left")
        .select("set_hi", "set_lo", F.coalesce("top", "component").alias("component_id"))
    )
    discard(reps, buckets, links, first, mixed, promising, needed, later)
    of_set = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return (
        every.select("doc_id", "n_shingles", "set_hi", "set_lo")
        .join(component, ["set_hi", "set_lo"], "left")
        .select("doc_id", "n_shingles", of_set.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, **more) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept.

    Documents are told apart by a hash of id and text, so an id that two different texts share loses neither
    unless it is a copy; of rows with equal id and text one stays.  The smallest id of a group stays (by a
    hash where ids tie).  Null, blank and null-id rows link with nothing by id: a null-id row always stays,
    blank texts stay once per id."""
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    gone, twice = _losers(docs, id_col, text_col, key, percent, more)
    side = lambda ids: F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    named = docs.withColumn(KEY, F.when(F.col(id_col).isNotNull(), key))
    kept = named.join(side(gone), KEY, "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(side(twice), KEY, "left_anti").select(docs.columns)
    return once.unionByName(kept.join(side(twice), KEY, "left_semi").dropDuplicates([KEY]).select(docs.columns))


#: Name of the row key while rows are filtered.
KEY = "_near_duplicate_key"


def _losers(docs: DataFrame, id_col: str, text_col: str, key, percent: int, more: dict) -> tuple[DataFrame, DataFrame]:
    """Keys of rows that go, and keys that stand in several rows."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), key.alias("k"))
    counts = rows.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys")).where("n > 1")
    again = stash(counts)
    torn = again.where("keys > 1").select("id")
    if torn.isEmpty():  # an id is one document: link by id
        found = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent, **more).where("not kept").select(F.col("doc_id").alias("id"))
        gone = stash(rows.join(found.distinct(), "id").select(F.col("k").alias(KEY)).distinct())
    else:  # link by key, then keep the smallest (id, key) of each class
        by_key = docs.where(F.col(id_col).isNotNull()).select(key.alias("_k"), F.col(text_col).alias("_t"))
        found = near_duplicates(by_key, id_col="_k", text_col="_t", percent=percent, **more).select(F.col("doc_id").alias("k"), "component_id").distinct()
        ranked = stash(rows.distinct().join(found, "k"))
        best = ranked.groupBy("component_id").agg(F.min(F.struct("id", "k")).alias("best"))
        gone = stash(ranked.join(best, "component_id").where(F.struct("id", "k") != F.col("best")).select(F.col("k").alias(KEY)).distinct())
    twice = stash(rows.join(again.select("id"), "id", "left_semi").groupBy("k").count().where("count > 1").select(F.col("k").alias(KEY)))
    return gone, twice
