"""Spectra, blocks and Wick products as small DataFrames.

A key table has (idx, s1, s2, f1, f2, canon).  These tables depend on the run's configuration, not on
data: a few hundred rows at most, so joins with them are planned as broadcasts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import canonical_key

#: What each field letter becomes under leakage (true letter, kernel letter, sign).
COLUMNS = (("T", "T", "T", 1), ("E", "E", "E", 1), ("E", "B", "B", 1), ("B", "E", "B", -1), ("B", "B", "E", 1))
#: Kernel letter of a field -> channel letter (T scalar, D direct, L leaked).
CHANNEL = {"T": "T", "E": "D", "B": "L"}
#: Spectra pairs that contract with the scalar, the mixed and the polarised norm.
NORMS = (
    ("TT", "TT", "00"), ("TT", "EE", "20"), ("TT", "TE", "20"), ("TT", "ET", "20"), ("EE", "TT", "20"), ("TE", "TT", "20"), ("ET", "TT", "20"),
    ("TE", "TE", "20"), ("TE", "ET", "20"), ("ET", "TE", "20"), ("ET", "ET", "20"), ("EE", "EE", "EE"), ("EE", "TE", "EE"), ("EE", "ET", "EE"),
    ("TE", "EE", "EE"), ("ET", "EE", "EE"),
)
PARITY_ODD = ("TB", "BT", "EB", "BE")


def field_dims(spark: SparkSession, stokes: Sequence[str], freqs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    s = spark.createDataFrame([(k, x) for k, x in enumerate(stokes)], "s_idx int, s string")
    f = spark.createDataFrame([(k, x) for k, x in enumerate(freqs)], "f_idx int, f string")
    return s, f


def spectrum_keys(stokes: DataFrame, freqs: DataFrame, *, pairs: DataFrame | None = None, drop_mirrored: bool = False) -> DataFrame:
    """Distinct spectra in generation order: frequency pairs outside, Stokes pairs inside.

    ``stokes(s_idx, s)`` and ``freqs(f_idx, f)``; ``pairs(p_idx, s1, s2)`` lists Stokes pairs instead of all
    products.  The first way of writing a spectrum stays; with ``drop_mirrored`` a spectrum whose
    Stokes mirror came earlier is left out as well."""
    f1, f2 = freqs.toDF("i1", "f1"), freqs.toDF("i2", "f2")
    if pairs is None:
        a, b = stokes.toDF("j1", "s1"), stokes.toDF("j2", "s2")
        pairs = a.crossJoin(b).select((F.col("j1") * 1000 + F.col("j2")).alias("p_idx"), "s1", "s2")
    every = F.broadcast(f1).crossJoin(F.broadcast(f2)).crossJoin(F.broadcast(pairs))
    every = every.withColumn("canon", canonical_key("s1", "s2", "f1", "f2"))
    order = ["i1", "i2", "p_idx"]
    first = every.withColumn("rn", F.row_number().over(Window.partitionBy("canon").orderBy(*order))).where("rn = 1")
    if drop_mirrored:
        mirror = canonical_key("s2", "s1", "f1", "f2")
        group = first.withColumn("pair", F.least("canon", mirror))
        first = group.withColumn("rn", F.row_number().over(Window.partitionBy("pair").orderBy(*order))).where("rn = 1")
    idx = F.row_number().over(Window.orderBy(*order)) - 1
    return first.select(idx.cast("int").alias("idx"), "s1", "s2", "f1", "f2", "canon")


def block_positions(keys: DataFrame, parity_mixed: bool = False) -> DataFrame:
    """Blocks (idx1 <= idx2) with both keys' letters; parity-mixed ones only on request."""
    a = keys.select(*[F.col(c).alias(f"a_{c}") for c in keys.columns])
    b = keys.select(*[F.col(c).alias(f"b_{c}") for c in keys.columns])
    out = a.join(F.broadcast(b), F.col("a_idx") <= F.col("b_idx"))
    if not parity_mixed:
        odd = lambda x: F.concat(f"{x}_s1", f"{x}_s2").isin(*PARITY_ODD)
        out = out.where(odd("a") == odd("b"))
    return out.withColumnRenamed("a_idx", "idx1").withColumnRenamed("b_idx", "idx2")


def contractions(blocks: DataFrame) -> DataFrame:
    """The two Wick contractions of each block: (02)(13) and (03)(12), with canonical spectra."""
    leg = lambda s, f: F.struct(F.col(s).alias("s"), F.col(f).alias("f"))
    x = [leg("a_s1", "a_f1"), leg("a_s2", "a_f2"), leg("b_s1", "b_f1"), leg("b_s2", "b_f2")]

    def product(n, i, j, k, m):
        spec = lambda p, q: canonical_key(p["s"], q["s"], p["f"], q["f"])
        letters = lambda p, q: F.concat(p["s"], q["s"])
        return F.struct(
            F.lit(n).alias("term"), letters(x[i], x[j]).alias("left_stokes"), spec(x[i], x[j]).alias("left"),
            letters(x[k], x[m]).alias("right_stokes"), spec(x[k], x[m]).alias("right"),
        )

    both = F.array(product(0, 0, 2, 1, 3), product(1, 0, 3, 1, 2))
    return blocks.select("idx1", "idx2", F.explode(both).alias("p")).select("idx1", "idx2", "p.*")


def norm_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NORMS, "left_stokes string, right_stokes string, norm string")


def wick_with_b(products: DataFrame, columns: DataFrame) -> DataFrame:
    """Wick products with E-B leakage.

    ``products(id, term, w, x, y, z)``: contraction of letters (w x)(y z); ``columns(letter, true, kernel, sign)``
    as COLUMNS.  Every leg becomes its true letters; equal products merge, those of coefficient 0 go.
    Result: id, left (true spectrum), ch1, right, ch2, coef."""
    out = products
    for leg in "wxyz":
        dim = columns.toDF(leg, f"{leg}t", f"{leg}k", f"{leg}g")
        out = out.join(F.broadcast(dim), leg)
    name = lambda a: F.translate(F.col(a), "TEB", "TDL")
    coef = F.col("wg") * F.col("xg") * F.col("yg") * F.col("zg")
    out = out.select(
        "id", F.concat("wt", "xt").alias("left"), F.concat(name("wk"), name("xk")).alias("ch1"),
        F.concat("yt", "zt").alias("right"), F.concat(name("yk"), name("zk")).alias("ch2"), coef.alias("coef"),
    )
    return out.groupBy("id", "left", "ch1", "right", "ch2").agg(F.sum("coef").cast("int").alias("coef")).where("coef <> 0")


def missing(required: DataFrame, available: DataFrame) -> DataFrame:
    """Kernel pairs that are needed and not there."""
    return required.distinct().join(available, ["ch1", "ch2"], "left_anti")


def required_pairs(terms: DataFrame) -> DataFrame:
    return terms.select("ch1", "ch2").distinct()


def lookup(blocks: DataFrame, one: str, two: str) -> DataFrame:
    """Blocks of two spectra named in any spelling: letters and frequencies ('ET,150x090') or letters alone ('TE').

    Both orders of the pair are found; ``blocks`` has the letters and frequencies of both keys."""
    from ..functions.columns import canonical_key

    def names(side: str, what: str):
        letters, _, freqs = what.partition(",")
        own = F.concat(f"{side}_s1", f"{side}_s2").isin(letters, letters[::-1])
        if not freqs:
            return own
        f1, f2 = freqs.split("x")
        return F.col(f"{side}_canon") == canonical_key(F.lit(letters[0]), F.lit(letters[1]), F.lit(f1), F.lit(f2))

    return blocks.where((names("a", one) & names("b", two)) | (names("a", two) & names("b", one)))


def term_multisets(products: DataFrame, by: tuple[str, ...] = ("idx1", "idx2")) -> DataFrame:
    """(by, terms): the products of each block as a sorted list, each in the order of its factors that comes first."""
    forth, back = F.struct(F.col("left").alias("a"), F.col("ch1").alias("c"), F.col("right").alias("b"), F.col("ch2").alias("e")), F.struct(F.col("right").alias("a"), F.col("ch2").alias("c"), F.col("left").alias("b"), F.col("ch1").alias("e"))
    return products.groupBy(*by).agg(F.array_sort(F.collect_list(F.least(forth, back))).alias("terms"))


def one_orientation(terms: DataFrame, mirrored: DataFrame, by: tuple[str, ...] = ("idx1", "idx2")) -> DataFrame:
    """(by, single): whether a block and its mirror image consist of the same terms, so that one of them will do."""
    both = term_multisets(terms, by).join(term_multisets(mirrored, by).withColumnRenamed("terms", "other"), list(by))
    return both.select(*by, (F.col("terms") == F.col("other")).alias("single"))


def norm_channels(products: DataFrame, norms: DataFrame) -> DataFrame:
    """The norms that T and E blocks need."""
    return products.join(F.broadcast(norms), ["left_stokes", "right_stokes"]).select("norm").distinct()
