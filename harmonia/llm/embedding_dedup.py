"""Near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._graph import connected_components
from ._memory import lean_batches, lean_groups
from ._store import discard, stash

#: Rows of one side of a tile, and how many leading dimensions a step of the comparison adds.
TILE, STEP, SLAB = 2048, 16, 256


def _usable(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """For each row its double vector, or None for null, empty, zero, or null and non-finite parts."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        if not v.is_valid or not len(v.values) or v.values.null_count:
            out.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(x if np.isfinite(x).all() and np.isfinite(x @ x) and x.any() else None)
    return np.array([x is not None for x in out]), out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and dimension: count, sum and outer-product sum of unit vectors, flat."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        ok, vectors = _usable(batch.column(0))
        by: dict[int, list[np.ndarray]] = {}
        for x in vectors:
            if x is not None:
                by.setdefault(len(x), []).append(_unit(x))
        for d, rows in by.items():
            m = np.stack(rows)
            own = np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
            sums[d] = sums[d] + own if d in sums else own
    for d, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([own.tolist()], pa.list_(pa.float64()))], names=["dim", "s"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / math.sqrt(x @ x)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal axes by falling variance for each vector length present; summed on the executors."""
    parts = vectors.select("embedding").mapInArrow(lean_batches(_moments), "dim int, s array<double>")
    rows = parts.select("dim", F.posexplode("s").alias("p", "v")).groupBy("dim", "p").agg(F.sum("v").alias("v")).collect()
    flat: dict[int, dict[int, float]] = {}
    for d, p, v in rows:
        flat.setdefault(d, {})[p] = v
    axes = {}
    for d, values in flat.items():
        s = np.array([values[p] for p in range(1 + d + d * d)])
        mean = s[1 : 1 + d] / s[0]
        cov = s[1 + d :].reshape(d, d) / s[0] - np.outer(mean, mean)
        value, vector = np.linalg.eigh((cov + cov.T) / 2)
        axes[d] = vector[:, np.argsort(-value)]
    return axes


def _place(axes: dict[int, np.ndarray], width: float):
    """vec_id, label, embedding -> with validity, a digest of the exact vector and its grid cell."""
    names = ["vec_id", "label", "dim", "hi", "lo", "cx", "cy", "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, vectors = _usable(batch.column(2))
            has = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            n = batch.num_rows
            dim, digest, cell = np.zeros(n, np.int32), np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int32)
            for i, x in enumerate(vectors):
                if x is None or not has[i]:
                    continue
                dim[i] = len(x)
                digest[i] = np.frombuffer(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest(), np.int64)
                lead = _unit(x) @ axes[len(x)][:, :2]
                cell[i, : len(lead)] = np.floor(lead / width)
            columns = [batch.column(0), batch.column(1), pa.array(dim), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(cell[:, 0]), pa.array(cell[:, 1]), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def tile_pairs(a: np.ndarray, b: np.ndarray, at_least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles of unit vectors in principal axes whose product can reach ``at_least``.

    Leading dimensions are summed first; the Cauchy bound of the rest by the suffix norms drops
    pairs that can't reach the threshold, and only survivors see further dimensions."""
    d = a.shape[1]
    cuts = list(range(STEP, d, STEP)) or [d]
    suffix = lambda x, k: np.sqrt(np.clip((x[:, k:] ** 2).sum(axis=1), 0, None))
    sa, sb = {k: suffix(a, k) for k in cuts}, {k: suffix(b, k) for k in cuts}
    first, left, right = cuts[0], [], []
    for at in range(0, len(a), SLAB):
        own = a[at : at + SLAB]
        part = own[:, :first] @ b[:, :first].T
        i, j = np.nonzero(part + np.outer(sa[first][at : at + SLAB], sb[first]) >= at_least)
        if same:
            keep = j > i + at
            i, j = i[keep], j[keep]
        value = part[i, j]
        for k, upto in zip(cuts, [*cuts[1:], d], strict=True):
            if upto == k or not len(i):
                break
            value = value + np.einsum("ij,ij->i", own[i, k:upto], b[j, k:upto])
            rest = sa[upto][i + at] * sb[upto][j] if upto in sa else 0.0
            keep = value + rest >= at_least
            i, j, value = i[keep], j[keep], value[keep]
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable within one tile pair, by min propagation and pointer jumping."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _tile(axes: dict[int, np.ndarray], threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        same = [k.as_py() for k in key[2:5]] == [k.as_py() for k in key[5:8]]
        order = np.lexsort((table.column("node").to_numpy(), table.column("side").to_numpy()))
        table = table.take(pa.array(order))
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        n_a = len(node) if same else int((table.column("side").to_numpy() == 0).sum())
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        raw = flat.reshape(-1, dim)
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        raw = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        turned = raw @ axes[dim]
        a, b = (turned, turned) if same else (turned[:n_a], turned[n_a:])
        i, j = tile_pairs(a, b, threshold - 1e-9, same)
        j = j if same else j + n_a
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            keep[at : at + (1 << 16)] = np.einsum("ij,ij->i", raw[i[at : at + (1 << 16)]], raw[j[at : at + (1 << 16)]]) >= threshold
        i, j = i[keep], j[keep]
        links = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
        label = _labels(len(node), i, j)
        some = np.flatnonzero(links > 0)
        return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(node[label[some]])})

    return run


def near_vectors(embeddings: DataFrame, *, threshold: float = 0.98) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label are linked when their cosine, in double precision, is at
    least ``threshold``; null or zero vectors and those with null or non-finite parts link with
    nothing, and vectors of different length never meet.  Equal vectors collapse to one
    representative with a count.  Representatives fall into a grid over the two leading principal
    axes whose width is the largest distance of a linked pair; each cell is dealt into tiles of
    about 2048 rows and only tiles of neighbouring cells are compared, leading dimensions first.
    A tile pair returns link counts and a spanning forest, at most a row for each of its rows.

    A null id links with nothing, has no component and is kept.  Repeated rows count as vectors of their own; rows
    that share an id share a component.  An empty table gives an empty result."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    axes = principal_axes(rows.where(F.col("label").isNotNull()))
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    schema = "vec_id long, label long, dim int, hi long, lo long, cx int, cy int, embedding array<double>"
    placed = rows.mapInArrow(lean_batches(_place(axes, width)), schema).withColumn("embedding", F.col("embedding").cast("array<double>"))
    placed = stash(placed)
    exact = ["label", "dim", "hi", "lo"]
    usable = placed.where("dim > 0 and vec_id is not null")
    groups = stash(usable.groupBy(*exact).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    reps = usable.join(groups, exact).where("vec_id = node").dropDuplicates(exact)
    reps = stash(reps.select("label", "dim", "cx", "cy", "node", "copies", "embedding"))
    cell = ["label", "dim", "cx", "cy"]
    cells = stash(reps.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    near = cells.withColumnRenamed("tiles", "own_tiles").withColumn("o", F.explode(around))
    near = near.select(*cell, "own_tiles", (F.col("cx") + F.col("o.x")).alias("nx"), (F.col("cy") + F.col("o.y")).alias("ny"))
    other = cells.select("label", "dim", F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("tiles").alias("n_tiles"))
    near = stash(near.join(other, ["label", "dim", "nx", "ny"]))
    dealt = reps.join(near, cell).withColumn("own", F.pmod(F.xxhash64("node"), F.col("own_tiles")).cast("int"))
    dealt = dealt.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    mine, theirs = F.struct("cx", "cy", F.col("own").alias("t")), F.struct(F.col("nx").alias("cx"), F.col("ny").alias("cy"), F.col("tile").alias("t"))
    lo, hi = F.when(mine <= theirs, mine).otherwise(theirs), F.when(mine <= theirs, theirs).otherwise(mine)
    dealt = dealt.select(
        "label", "dim", lo["cx"].alias("x1"), lo["cy"].alias("y1"), lo["t"].alias("t1"), hi["cx"].alias("x2"), hi["cy"].alias("y2"), hi["t"].alias("t2"),
        F.when(mine <= theirs, 0).otherwise(1).alias("side"), "node", "copies", "embedding",
    )
    found = stash(
        dealt.groupBy("label", "dim", "x1", "y1", "t1", "x2", "y2", "t2").applyInArrow(lean_groups(_tile(axes, threshold)), "node long, links long, root long")
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = stash(
        groups.join(links, "node", "left")
        .join(components, "node", "left")
        .select(*exact, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    discard(reps, cells, near, found, groups)
    out = placed.drop("embedding").join(told, exact, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
