"""Secrets in documents, told from widely copied examples by how many owners hold them."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._graph import connected_components
from ._memory import lean_batches
from ._store import discard, stash
from ._words import shingle_set, word_hashes
from .minhash import band_keys, registers

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")
#: Strings that the method weighs beside the base ones.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
LEAST_ENTROPY, LEAST_CLASSES = 3.5, 3


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, secret) of the base patterns, by start and then kind."""
    out = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(s: str) -> bool:
    """A digit, at least three of lower case, upper case, digits and signs, and 3.5 bits a character."""
    if not re.search("[0-9]", s):
        return False
    classes = bool(re.search("[a-z]", s)) + bool(re.search("[A-Z]", s)) + bool(re.search("[0-9]", s)) + bool(re.search("[+/_=-]", s))
    if classes < LEAST_CLASSES:
        return False
    counts = [s.count(c) for c in set(s)]
    return -sum(c / len(s) * math.log2(c / len(s)) for c in counts) >= LEAST_ENTROPY


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Live-looking strings that no base span overlaps."""
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        if not any(b[0] < m.end() and b[1] > m.start() for b in base[at : at + 4]) and looks_live(m[0]):
            out.append((m.start(), m.end(), 3, m[0]))
    return out


_SPAN = "array<struct<start:long,end:long,kind:int,hash:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("hash", pa.string())]))
    for batch in batches:
        found, sketches = [], []
        for text in batch.column(3):
            t = text.as_py() or ""
            base = base_spans(t)
            spans = base + more_spans(t, base)
            found.append([{"start": s, "end": e, "kind": k, "hash": hashlib.sha256(x.encode()).hexdigest()[:32]} for s, e, k, x in spans])
            sketches.append(_sketch(t) if spans else None)
        columns = [*batch.columns[:3], pa.array(found, kind), pa.array(sketches, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "repo", "owner", "spans", "sketch"])


def _sketch(text: str) -> list[int]:
    """Band keys of a text's five-word shingles."""
    ((_, words),) = word_hashes(pa.array([text]))
    return band_keys(registers(shingle_set(words, 5)))[0].tolist()


def _classes(rows: DataFrame) -> DataFrame:
    """(row, text_class) of ``rows(row, sketch)``: copies and near copies share a class.  Rows that meet
    in a band count as copies unverified, which can only lower a hash's number of owners."""
    reps = stash(rows.groupBy("sketch").agg(F.min("row").alias("node")))
    banded = reps.select("node", F.posexplode("sketch").alias("band", "key"))
    pivots = banded.groupBy("band", "key").agg(F.min("node").alias("pivot"))
    top = connected_components(banded.join(pivots, ["band", "key"]).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    reps = reps.join(top, "node", "left").select("sketch", F.coalesce("component", "node").alias("text_class"))
    return rows.join(reps, "sketch").select("row", "text_class")


def _spread(each: DataFrame, sketches: DataFrame, n_owners: int, most_owners: int, wide_share: float) -> DataFrame:
    """(hash, repos, owners) of the hashes in more than one repository, counted over classes of texts."""
    held = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash").count().where("count > 1").select("hash")
    held = stash(each.join(held, "hash", "left_semi").select("hash", "row", "owner", "repo").distinct())
    classes = _classes(sketches.join(held.select("row").distinct(), "row", "left_semi"))
    pairs = stash(held.join(classes, "row").select("hash", "text_class", "owner", "repo").distinct())
    first = pairs.groupBy("hash", "text_class").agg(F.min(F.struct("owner", "repo")).alias("first"), F.countDistinct("owner").alias("own"))
    wide = F.col("own") > max(most_owners, wide_share * n_owners)
    counted = pairs.join(first, ["hash", "text_class"]).where(wide | (F.struct("owner", "repo") == F.col("first")))
    return counted.groupBy("hash").agg(F.countDistinct("owner", "repo").alias("repos"), F.countDistinct("owner").alias("owners"))


def find_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
    most_owners: int = 2,
    wide_share: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, spans array<struct<start, end, kind, hash, repos, owners, verdict>>.

    Every whole text is scanned for the base patterns and for other strings that look like live
    keys.  All hashes are then counted over the corpus by distinct repositories and owners: one held by
    more than ``most_owners`` owners is an ``example`` that many copy, any other is ``live``.  Copies and
    near copies of a text count as one, under their first owner, unless that text itself stands under more
    than ``most_owners`` owners and ``wide_share`` of all owners: then all of its owners count.  Base spans
    are always returned; other strings only if they are live.
    Default owner: ``source``; default repository: source and language.  Null owners or
    repositories count as one.  Offsets are code points, the end exclusive; null texts are empty."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col(text_col).cast("string").alias("text"),
    )
    scanned = own.mapInArrow(lean_batches(_scan), f"doc_id long, repo string, owner string, spans {_SPAN}, sketch array<long>")
    scanned = stash(scanned.withColumn("row", F.monotonically_increasing_id()))
    each = scanned.where(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("s")).select("row", "repo", "owner", "s.*")
    sketches = scanned.where(F.size("spans") > 0).select("row", "sketch")
    spread = stash(_spread(each, sketches, scanned.select("owner").distinct().count(), most_owners, wide_share))
    judged = each.join(spread, "hash", "left").withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("repos", "owners")})
    judged = judged.withColumn("verdict", F.when(F.col("owners") > most_owners, "example").otherwise("live"))
    judged = judged.where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", "end", "hash", "repos", "owners", "verdict"))).alias("spans")
    per_row = stash(judged.groupBy("row").agg(spans))
    discard(spread)
    return scanned.select("row", "doc_id").join(per_row, "row", "left")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_examples, n_live of ``find_secrets`` rows."""
    s = F.coalesce(F.col("spans"), F.expr("cast(array() as array<struct<start:long,kind:int,end:long,hash:string,repos:long,owners:long,verdict:string>>)"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter(s, test)).cast("long")
    return found.select(
        "doc_id", count(lambda x: x["kind"] == 0).alias("n_assign"), count(lambda x: x["kind"] == 1).alias("n_access"), count(lambda x: x["kind"] == 2).alias("n_hex"),
        F.sha2(text(F.filter(s, lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), text(s).alias("spans"),
        count(lambda x: x["kind"] == 3).alias("n_owned"), count(lambda x: x["verdict"] == "example").alias("n_examples"), count(lambda x: x["verdict"] == "live").alias("n_live"),
    )
