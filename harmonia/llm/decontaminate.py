"""Benchmark passages in documents by template canonicalisation, window hash joins and slot checks.

DataFrame functions only: everything here runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._store import discard, stash

N = 5
#: Beyond so many benchmark windows the window table is joined by shuffling instead of broadcasting.
BROADCAST_WINDOWS = 1_000_000
#: Unit words that count as a unit after a number.
UNITS = (
    "mm|cm|m|km|in|inch|inches|ft|feet|yard|yards|mile|miles|mg|g|kg|lb|lbs|oz|ml|l|liter|liters|litre|litres|"
    "s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|"
    "dollar|dollars|euro|euros|cent|cents|percent|degrees|mph|kmh|hz|kb|mb|gb|tb|w|kw|v"
)
_NUMBER = r"(?<![^\s])[(\[\"'$€£+-]*([0-9][0-9.,:/]*)(%?)[)\]\"'.,;:!?]*(?![^\s])"
_NUMBER_UNIT = rf"(?<![^\s])[(\[\"'$€£+-]*([0-9][0-9.,:/]*)((?i:{UNITS}))[)\]\"'.,;:!?]*(?![^\s])"
_UNIT = rf"(#num:[^\s]*\s+)(?:[^\p{{L}}\p{{N}}\s#]+\s+)?((?i:{UNITS}))[)\]\"'.,;:!?]*(?![^\s])"
_NAME = r"(?<=[\p{Ll},;]\s)(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"


def tokens(text: Column, names: bool = True) -> Column:
    """Template tokens of a text.  Numbers become ``#num:value``, units behind them ``#unit:word`` and,
    with ``names``, capitalised words within a sentence ``#name:word``; all else is lower-cased and
    stripped of signs."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(
        t.rlike("[0-9]"),
        F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _NUMBER_UNIT, "#num:$1 #unit:$2"), _NUMBER, "#num:$1"), _UNIT, "$1#unit:$2"),
    ).otherwise(t)
    if names:
        t = F.regexp_replace(t, _NAME, "#name:$1")
    t = F.regexp_replace(F.lower(t), r"[^#:\p{L}\p{N}\s]+|(?<!#num|#unit|#name):|#(?!(?:num|unit|name):)", "")
    return F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")


def canonical(words: Column) -> Column:
    """Tokens without slot values: what windows are hashed on."""
    return F.split(F.regexp_replace(F.concat_ws(" ", words), r"(#num|#unit|#name):[^ ]*", "$1"), " ")


def _window(words: Column, i: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, N)))


def _starts(words: Column, step) -> Column:
    last = F.size(words) - N
    return F.when(last >= 0, F.sequence(F.lit(0), last, step)).otherwise(F.expr("cast(array() as array<int>)"))


def _forms(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, form, full, canon): tokens with and without name slots, and as within a sentence."""
    base = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    forms = [base.select("item_id", F.lit(int(named)).alias("form"), tokens(F.col("text"), named).alias("full")) for named in (True, False)]
    within = F.slice(tokens(F.concat(F.lit("a "), F.trim("text"))), 2, 1 << 30)  # as it reads in the middle of a sentence
    forms.append(base.where("text is not null").select("item_id", F.lit(2).alias("form"), within.alias("full")))
    return forms[0].unionByName(forms[1]).unionByName(forms[2]).withColumn("canon", canonical(F.col("full")))


def _item_windows(forms: DataFrame) -> DataFrame:
    """(item_id, form, place, hash, slots) of every window of every form."""
    each = forms.select("item_id", "form", "full", "canon", F.explode(_starts(F.col("canon"), F.lit(1))).alias("place"))
    slots = F.filter(F.slice("full", F.col("place") + 1, N), lambda x: x.startswith("#"))
    return each.select("item_id", "form", "place", _window(F.col("canon"), F.col("place")).alias("hash"), slots.alias("slots"))


def benchmark_windows(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", literal: int = 3) -> DataFrame:
    """(hash, item_id, place, slots, windows): every window of every item, with and without name
    slots, that has at least ``literal`` tokens which are not placeholders.  ``windows`` counts the
    item's usable places.  An item left with one or two usable places of more keeps all its windows.
    Items with fewer than five tokens, or without a usable place, have none (``whole_items``)."""
    return _kept_windows(_item_windows(_forms(benchmark, id_col, text_col)), literal).drop("form").distinct()


def _kept_windows(rows: DataFrame, literal: int = 3) -> DataFrame:
    usable = F.size("slots") <= N - literal
    counts = rows.groupBy("item_id").agg(F.countDistinct(F.when(usable, F.col("place"))).alias("usable"), F.countDistinct("place").alias("places"))
    thin = F.col("usable") < F.least(F.lit(3), F.col("places"))
    kept = rows.join(counts.where("usable > 0"), "item_id").where(usable | thin)
    return kept.withColumn("windows", F.when(thin, F.col("places")).otherwise(F.col("usable"))).drop("usable", "places")


def whole_items(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", literal: int = 3) -> DataFrame:
    """(item_id, full, lead, anchor): token sequences, slot values included, of the forms that have fewer
    than five tokens or a window with less than ``literal`` words.  ``anchor`` hashes the first ``lead``."""
    return _whole(_forms(benchmark, id_col, text_col), literal)


def _whole(forms: DataFrame, literal: int = 3) -> DataFrame:
    filled = lambda i: F.size(F.filter(F.slice("full", i + 1, N), lambda x: x.startswith("#"))) > N - literal
    odd = forms.where("size(full) > 0 and full[0] <> ''").where((F.size("full") < N) | F.exists(_starts(F.col("full"), F.lit(1)), filled))
    lead = F.least(F.size("full"), F.lit(N)).alias("lead")
    return odd.select("item_id", "full", lead).distinct().withColumn("anchor", _anchor(F.lit(0), F.col("lead")))


def _anchor(i: Column, lead: Column) -> Column:
    return F.xxhash64(F.lit("whole"), F.concat_ws(" ", F.slice("full", i + 1, lead)))


def _stride(bench: DataFrame, coverage: float) -> int:
    """Places between two probes: up to five where every form of every item has consecutive windows, else 1."""
    runs = bench.groupBy("item_id", "form").agg(F.countDistinct("place").alias("n"), (F.max("place") - F.min("place") + 1).alias("extent"))
    gaps, least = runs.agg(F.max(F.col("extent") > F.col("n")), F.min("n")).first()
    return 1 if gaps or least is None else max(1, min(N, int(least * coverage)))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: Column | None = None,
) -> DataFrame:
    """One row for each document and benchmark item that it leaks.

    Columns: key, doc_id, item_id, windows, matched, coverage, first_token, last_token,
    changed_slots.  A leak holds at least ``coverage`` of the item's five-token template windows.
    Windows of one alignment count only if every slot value of the benchmark stands for one value of
    the document there; ``changed_slots`` counts values that differ (a re-parameterised question).

    Every fifth window of each document meets all windows of the benchmark in a hash join, which
    finds every run of nine matching tokens (shorter items: the stride shrinks to fit the shortest; items
    whose usable windows have gaps: every window); only documents that meet some window are then compared
    window by window.  Items of fewer than five tokens, and items with a window of too few words, are also
    found as whole token sequences with equal slot values (coverage 1, ``windows`` all their places).  Null texts and items are empty; ``key`` tells rows
    apart (default: a hash of id and text), so repeated rows give equal rows once.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("key", F.xxhash64("doc_id", "text") if key is None else key)
    forms = stash(_forms(benchmark))
    formed = stash(_kept_windows(_item_windows(forms)))
    bench, whole = stash(formed.drop("form").distinct()), stash(_whole(forms))
    held, leads = bench.count(), sorted(r[0] for r in whole.select("lead").distinct().collect())
    if not held and not leads:
        discard(forms, formed, bench, whole)
        return _report(own.limit(0).select("key", "doc_id", F.lit(0).cast("long").alias("item_id"), *_none()))
    small = F.broadcast if held + whole.count() <= BROADCAST_WINDOWS else (lambda x: x)
    step = _stride(formed, coverage)
    hashes = bench.select("hash").union(whole.select("anchor")).distinct()
    probes = own.select("key", "doc_id", tokens(F.col("text")).alias("full"))
    probes = probes.select("key", "doc_id", *(["full"] if leads else []), canonical(F.col("full")).alias("words"))
    at_steps = F.transform(_starts(F.col("words"), F.lit(step)), lambda i: _window(F.col("words"), i))
    at_items = [F.transform(_spots(leads), lambda x: x["anchor"])] if leads else []
    probes = probes.select("key", "doc_id", F.concat(at_steps, *at_items).alias("h"))
    probes = probes.select("key", "doc_id", F.explode(F.array_distinct("h")).alias("hash"))
    wanted = stash(probes.join(small(hashes), "hash", "left_semi").select("key").distinct())
    words = own.join(wanted, "key", "left_semi").select("key", "doc_id", tokens(F.col("text")).alias("full"))
    # Materialised: inlined into the window function below, tokens would be made anew for every window.
    words = stash(words.withColumn("canon", canonical(F.col("full"))))
    # Windows are built as one narrow array before they are exploded: no output row carries the text.
    window = lambda i: F.struct(
        i.alias("at"), _window(F.col("canon"), i).alias("hash"), F.filter(F.slice("full", i + 1, N), lambda x: x.startswith("#")).alias("values")
    )
    each = words.select("key", "doc_id", F.transform(_starts(F.col("canon"), F.lit(1)), window).alias("w"))
    each = each.select("key", "doc_id", F.explode("w").alias("w")).select("key", "doc_id", "w.*")
    met = stash(
        each.join(small(bench), "hash").select(
            "key", "doc_id", "item_id", "windows", "at", "place", (F.col("at") - F.col("place")).alias("line"), "slots", "values"
        )
    )
    exact = stash(_exact(words, whole, leads, small))
    discard(wanted, words, forms, formed, bench, whole)
    pairs = (
        met.where(F.size("slots") > 0)
        .select("key", "item_id", "line", F.explode(F.arrays_zip("slots", "values")).alias("p"))
        .groupBy("key", "item_id", "line", F.col("p.slots").alias("slot"))
        .agg(F.min("p.values").alias("lo"), F.max("p.values").alias("hi"))
    )
    lines = pairs.groupBy("key", "item_id", "line").agg(
        F.max((F.col("lo") != F.col("hi")).cast("int")).alias("torn"), F.sum((F.col("slot") != F.col("lo")).cast("long")).alias("changed")
    )
    judged = met.join(lines, ["key", "item_id", "line"], "left").where(F.coalesce("torn", F.lit(0)) == 0)
    found = judged.groupBy("key", "doc_id", "item_id").agg(
        F.max("windows").alias("windows"), F.countDistinct("place").alias("matched"), F.min("at").cast("long").alias("first_token"),
        (F.max("at") + N - 1).cast("long").alias("last_token"), F.max(F.coalesce("changed", F.lit(0))).cast("long").alias("changed_slots"),
    )
    found = found.where(F.col("matched") >= coverage * F.col("windows"))
    if not leads:
        return _report(found)
    found = stash(found)
    return _report(found.unionByName(exact.join(found, ["key", "item_id"], "left_anti")))


def _spots(leads: list[int]) -> Column:
    """(at, anchor) of the stretches of ``full`` of each length of ``leads``."""
    none = F.expr("cast(array() as array<struct<at:int,anchor:bigint>>)")

    def of(n: int) -> Column:  # not a default argument: transform would pass the index for it
        starts = F.when(F.size("full") >= n, F.sequence(F.lit(0), F.size("full") - n)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), _anchor(i, F.lit(n)).alias("anchor")))

    return F.concat(none, *[of(n) for n in leads])


def _exact(words: DataFrame, whole: DataFrame, leads: list[int], small) -> DataFrame:
    """Documents that hold an item's whole sequence, slot values included; columns as ``leaks`` groups them."""
    met = words.select("key", F.explode(_spots(leads)).alias("w")).select("key", "w.*").join(small(whole.select("anchor").distinct()), "anchor", "left_semi")
    near = words.select("key", "doc_id", "full").join(met.distinct(), "key").join(small(whole.withColumnRenamed("full", "item")), "anchor")
    near = near.where(F.slice("full", F.col("at") + 1, F.size("item")) == F.col("item"))
    places = F.greatest(F.size("item") - N + 1, F.lit(1)).cast("long")
    return near.groupBy("key", "doc_id", "item_id").agg(
        F.max(places).alias("windows"), F.max(places).alias("matched"), F.min("at").cast("long").alias("first_token"),
        F.max(F.col("at") + F.size("item") - 1).cast("long").alias("last_token"), F.lit(0).cast("long").alias("changed_slots"),
    )


def _none() -> list[Column]:
    names = ("windows", "matched", "first_token", "last_token", "changed_slots")
    return [F.lit(0).cast("long").alias(n) for n in names]


def _report(found: DataFrame) -> DataFrame:
    share = (F.col("matched") / F.col("windows")).alias("coverage")
    return found.select("key", "doc_id", "item_id", "windows", "matched", share, "first_token", "last_token", "changed_slots")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """``docs`` without the rows that leak a benchmark item; columns unchanged."""
    gone = stash(leaks(docs, benchmark, **more).select(F.col("key").alias("_leak")).distinct())
    row = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return docs.join(gone, row == gone["_leak"], "left_anti")
