"""Queries of the engine over the driver's tables, each with SQL for another engine where SQL can say it.

The tables hold no spectra or masks, so inputs are derived from them: harmonic-like coefficients are
averages of ``lineitem`` by quantity (degree), line number (order), status (field letter) and return
flag (frequency); mask spectra are histograms of ``part`` sizes; mask pixels are the first three
components of ``embeddings``; ring samples are ``events`` by hour.  All run over whole tables.  Queries whose inputs are
a run's settings (keys, bins, filters, nodes) read no table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import columns as C
from .operators import dense, relational as R, sky
from .plans import keys as K

LMAX, LMIN = 50, 2
FREQS = (("090", 5.0, 20.0), ("150", 2.0, 9.0), ("220", 1.5, 30.0))
BINS = ((0, 2, 10), (1, 10, 20), (2, 20, 35), (3, 35, 51))
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(x, n: int = 8) -> Column:
    return F.round(C.c(x), n) + F.lit(0.0)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def alm(spark: SparkSession, d: str) -> DataFrame:
    """(s, f, l, m, re, im)."""
    t = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    s = F.when(F.col("l_linestatus") == "O", "T").otherwise("E").alias("s")
    f = F.when(F.col("l_returnflag") == "A", "090").when(F.col("l_returnflag") == "N", "150").otherwise("220").alias("f")
    ell, m = F.col("l_quantity").cast("int").alias("l"), (F.col("l_linenumber") - 1).cast("int").alias("m")
    price = F.col("l_extendedprice")
    grouped = t.select(s, f, ell, m, (price * (1 - F.col("l_discount"))).alias("x"), (price * F.col("l_tax")).alias("y")).where("m <= l")
    return grouped.groupBy("s", "f", "l", "m").agg((F.avg("x") / 1e5).alias("re"), (F.avg("y") / 1e4).alias("im"))


ALM = """alm AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'T' ELSE 'E' END AS s,
  CASE l_returnflag WHEN 'A' THEN '090' WHEN 'N' THEN '150' ELSE '220' END AS f,
  CAST(l_quantity AS INTEGER) AS l, CAST(l_linenumber - 1 AS INTEGER) AS m,
  AVG(l_extendedprice * (1 - l_discount)) / 1e5 AS re, AVG(l_extendedprice * l_tax) / 1e4 AS im
  FROM lineitem WHERE l_linenumber - 1 <= CAST(l_quantity AS INTEGER) GROUP BY 1, 2, 3, 4)"""
CANON = """CASE WHEN {f1} < {f2} OR ({f1} = {f2} AND {s1} >= {s2}) THEN {s1} || {s2} || ',' || {f1} || 'x' || {f2}
  ELSE {s2} || {s1} || ',' || {f2} || 'x' || {f1} END"""


def canon(s1: str, s2: str, f1: str, f2: str) -> str:
    return CANON.format(s1=s1, s2=s2, f1=f1, f2=f2)


def spectra(spark: SparkSession, d: str) -> DataFrame:
    """(canon, s1, s2, f1, f2, ell, v), each spectrum once."""
    a = alm(spark, d)
    full = R.alm_to_cl(a.withColumnRenamed("s", "s1").withColumnRenamed("f", "f1"), a.withColumnRenamed("s", "s2").withColumnRenamed("f", "f2"), ["s1", "f1"], ["s2", "f2"])
    forth = F.concat("s1", "s2", F.lit(","), "f1", F.lit("x"), "f2")
    return full.withColumn("canon", C.canonical_key("s1", "s2", "f1", "f2")).where(F.col("canon") == forth)


SPECTRA = f"""{ALM}, cl0 AS (SELECT a.s AS s1, a.f AS f1, b.s AS s2, b.f AS f2, a.l AS ell,
  SUM(CASE WHEN a.m = 0 THEN 1.0 ELSE 2.0 END * (a.re * b.re + a.im * b.im)) / (2 * a.l + 1) AS v
  FROM alm a JOIN alm b ON a.l = b.l AND a.m = b.m GROUP BY 1, 2, 3, 4, 5),
cl AS (SELECT s1 || s2 || ',' || f1 || 'x' || f2 AS canon, * FROM cl0 WHERE f1 < f2 OR (f1 = f2 AND s1 >= s2))"""


def mask_wl(spark: SparkSession, d: str) -> DataFrame:
    """(g, l, wl): share of parts of each size, by material (first letter of the type)."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("l"))
    n = p.groupBy("g", "l").agg(F.count("*").alias("n"))
    total = p.groupBy("g").agg(F.count("*").alias("t"))
    return n.join(F.broadcast(total), "g").select("g", "l", (F.col("n") / F.col("t")).alias("wl"))


MASK = """wl AS (SELECT p_brand AS g, p_size AS l, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY p_brand) AS wl FROM part GROUP BY 1, 2)"""


def xi(spark: SparkSession, d: str) -> DataFrame:
    """(norm, l1, l2, v): a banded kernel from the histogram of all part sizes."""
    p = table(spark, d, "part")
    h = p.groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n"))
    total = p.agg(F.count("*").alias("t"))
    h = h.crossJoin(F.broadcast(total)).select("k", (F.col("n") / F.col("t")).alias("w"))
    l1, l2 = spark.range(LMAX + 1).select(F.col("id").cast("int").alias("l1")), spark.range(LMAX + 1).select(F.col("id").cast("int").alias("l2"))
    pairs = l1.crossJoin(l2).withColumn("k", F.abs(F.col("l1") - F.col("l2")) + 1)
    norms = spark.createDataFrame([("00", 1.0), ("20", 0.5), ("EE", 0.25)], "norm string, x double")
    v = F.col("w") * F.col("x") / (F.col("l1") + F.col("l2") + 1)
    return pairs.join(F.broadcast(h), "k").crossJoin(F.broadcast(norms)).select("norm", "l1", "l2", v.alias("v"))


XI = f"""h AS (SELECT p_size AS k, COUNT(*) / (SELECT COUNT(*) FROM part) AS w FROM part GROUP BY 1),
xi AS (SELECT norm, CAST(i AS INTEGER) AS l1, CAST(j AS INTEGER) AS l2, w * x / (i + j + 1) AS v FROM range({LMAX + 1}) a(i), range({LMAX + 1}) b(j), h,
  (VALUES ('00', 1.0::DOUBLE), ('20', 0.5::DOUBLE), ('EE', 0.25::DOUBLE)) n(norm, x) WHERE k = ABS(i - j) + 1)"""


def bins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BINS, "bin int, lo int, hi int")


BINS_SQL = "bins AS (SELECT * FROM (VALUES " + ", ".join(str(b) for b in BINS) + ") b(bin, lo, hi))"


def ells(spark: SparkSession, top: int = LMAX) -> DataFrame:
    return spark.range(top + 1).select(F.col("id").cast("int").alias("ell"))


def weights_sql(flatten: bool) -> str:
    w = f"ell * (ell + 1) / {2 * math.pi!r}" if flatten else "1.0::DOUBLE"
    return f"""{BINS_SQL}, w0 AS (SELECT bin, CAST(i AS INTEGER) AS ell, CASE WHEN i < {LMIN} THEN 0.0 ELSE {w.replace('ell', 'i')} END AS w0
  FROM range({LMAX + 1}) r(i) JOIN bins ON i >= lo AND i < hi),
w AS (SELECT bin, ell, w0 / SUM(w0) OVER (PARTITION BY bin) AS w FROM w0 WHERE w0 > 0)"""


def fields(spark: SparkSession, stokes: str = "TE", freqs=tuple(f[0] for f in FREQS)):
    return K.field_dims(spark, list(stokes), list(freqs))


KEYS_SQL = f"""fr AS (SELECT * FROM (VALUES (0, '090'), (1, '150'), (2, '220')) f(i, f)), st AS (SELECT * FROM (VALUES (0, 'T'), (1, 'E')) s(j, s)),
k0 AS (SELECT a.i AS i1, b.i AS i2, c.j * 1000 + e.j AS p, c.s AS s1, e.s AS s2, a.f AS f1, b.f AS f2, {canon('c.s', 'e.s', 'a.f', 'b.f')} AS canon
  FROM fr a, fr b, st c, st e),
k1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY canon ORDER BY i1, i2, p) AS rn FROM k0),
keys AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY i1, i2, p) - 1 AS INTEGER) AS idx, s1, s2, f1, f2, canon FROM k1 WHERE rn = 1)"""
BLOCKS_SQL = f"""{KEYS_SQL}, blocks AS (SELECT a.idx AS idx1, a.s1 AS a1, a.s2 AS a2, a.f1 AS fa1, a.f2 AS fa2, b.idx AS idx2, b.s1 AS b1, b.s2 AS b2, b.f1 AS fb1, b.f2 AS fb2
  FROM keys a JOIN keys b ON a.idx <= b.idx),
prods AS (SELECT idx1, idx2, 0 AS term, a1 || b1 AS left_stokes, {canon('a1', 'b1', 'fa1', 'fb1')} AS lft, a2 || b2 AS right_stokes, {canon('a2', 'b2', 'fa2', 'fb2')} AS rgt FROM blocks
  UNION ALL SELECT idx1, idx2, 1, a1 || b2, {canon('a1', 'b2', 'fa1', 'fb2')}, a2 || b1, {canon('a2', 'b1', 'fa2', 'fb1')} FROM blocks)"""


def products(spark: SparkSession) -> DataFrame:
    return K.contractions(K.block_positions(K.spectrum_keys(*fields(spark))))


@query(f"WITH {SPECTRA} SELECT canon, ell, ROUND(v, 8) + 0.0 AS v FROM cl")
def alm_cross_spectra(spark, d):
    return spectra(spark, d).select("canon", "ell", r("v").alias("v"))


@query(f"WITH {SPECTRA} SELECT canon, ell, ROUND(CASE WHEN ell < 2 THEN 0.0 ELSE {2 * math.pi!r} * v / (ell * (ell + 1)) END, 8) + 0.0 AS cl, ROUND(ell * (ell + 1) / {2 * math.pi!r} * v, 6) + 0.0 AS dl FROM cl")
def spectrum_units(spark, d):
    return spectra(spark, d).select("canon", "ell", r(C.to_cl("ell", "v", "Dl")).alias("cl"), r(C.cl_to_dl("ell", "v"), 6).alias("dl"))


def beams(spark: SparkSession) -> DataFrame:
    dim = spark.createDataFrame(FREQS, "f string, fwhm double, sigma double")
    return ells(spark).crossJoin(F.broadcast(dim)).select("f", "ell", C.gaussian_beam("ell", "fwhm").alias("b"), C.white_noise("sigma").alias("n"))


_FR = ", ".join(f"('{f}', {w}::DOUBLE, {s}::DOUBLE)" for f, w, s in FREQS)
_SIG = C.ARCMIN / math.sqrt(8 * math.log(2))
BEAMS_SQL = f"""beams AS (SELECT f, CAST(i AS INTEGER) AS ell, EXP(-0.5 * i * (i + 1) * (fwhm * {_SIG!r}) * (fwhm * {_SIG!r})) AS b, POW(sigma * {C.ARCMIN!r}, 2) AS n
  FROM range({LMAX + 1}) r(i), (VALUES {_FR}) f(f, fwhm, sigma))"""


@query(f"WITH {BEAMS_SQL} SELECT f, ell, ROUND(b, 10) + 0.0 AS b, ROUND(n * 1e6, 8) + 0.0 AS n, ROUND(2 * n * 1e6, 8) + 0.0 AS n_pol FROM beams")
def beams_and_noise(spark, d):
    return beams(spark).select("f", "ell", r("b", 10).alias("b"), r(F.col("n") * 1e6).alias("n"), r(2 * F.col("n") * 1e6).alias("n_pol"))


def modelled(spark: SparkSession, d: str) -> DataFrame:
    b = beams(spark)
    one, two = b.select(F.col("f").alias("f1"), "ell", F.col("b").alias("b1"), "n"), b.select(F.col("f").alias("f2"), "ell", F.col("b").alias("b2"))
    joined = spectra(spark, d).join(F.broadcast(one), ["f1", "ell"]).join(F.broadcast(two), ["f2", "ell"])
    noise = F.when((F.col("f1") == F.col("f2")) & (F.col("s1") == F.col("s2")), F.when(F.col("s1") == "T", 1.0).otherwise(2.0) * F.col("n")).otherwise(0.0)
    fl = F.col("ell") / F.lit(LMAX + 1.0)
    model = F.col("b1") * F.col("b2") * fl
    ratio = C.safe_divide(F.lit(1.0), "model", 1.0) * C.transfer_inflation(fl)
    return joined.withColumn("fl", fl).withColumn("model", model).select("canon", "ell", (F.col("v") * F.col("model") + noise).alias("v"), "model", ratio.alias("debias"))


MODEL_SQL = f"""{SPECTRA}, {BEAMS_SQL}, model AS (SELECT canon, cl.ell, v * (x.b * y.b * (cl.ell / {LMAX + 1.0})) + CASE WHEN f1 = f2 AND s1 = s2 THEN CASE WHEN s1 = 'T' THEN 1.0 ELSE 2.0 END * x.n ELSE 0.0 END AS v,
  x.b * y.b * (cl.ell / {LMAX + 1.0}) AS model, 1.0 / (x.b * y.b * (cl.ell / {LMAX + 1.0})) * (1 + SQRT((1 - cl.ell / {LMAX + 1.0}) / 3999.0)) AS debias
  FROM cl JOIN beams x ON x.f = f1 AND x.ell = cl.ell JOIN beams y ON y.f = f2 AND y.ell = cl.ell)"""


@query(f"WITH {MODEL_SQL} SELECT canon, ell, ROUND(v, 8) + 0.0 AS v, ROUND(model, 10) + 0.0 AS model, ROUND(debias, 6) + 0.0 AS debias FROM model")
def data_model(spark, d):
    return modelled(spark, d).select("canon", "ell", r("v").alias("v"), r("model", 10).alias("model"), r("debias", 6).alias("debias"))


_NEST = f"WITH {SPECTRA}, a AS (SELECT canon, ell, v FROM cl WHERE ell <= 40), b AS (SELECT canon, ell, v * 2 AS v FROM cl WHERE ell >= 10 AND s1 = s2)"


def _nested(spark, d, how):
    s = spectra(spark, d)
    a, b = s.where("ell <= 40"), s.where("ell >= 10 and s1 = s2").withColumn("v", F.col("v") * 2)
    return R.nested_combine(a, b, ["canon", "ell"], how).select("canon", "ell", r("v").alias("v"))


@query(f"{_NEST} SELECT canon, ell, ROUND(COALESCE(a.v, 0.0) + COALESCE(b.v, 0.0), 8) + 0.0 AS v FROM a FULL JOIN b USING (canon, ell)")
def nested_add(spark, d):
    return _nested(spark, d, "add")


@query(f"{_NEST} SELECT canon, ell, ROUND(COALESCE(a.v, 1.0) * COALESCE(b.v, 1.0), 8) + 0.0 AS v FROM a FULL JOIN b USING (canon, ell)")
def nested_multiply(spark, d):
    return _nested(spark, d, "multiply")


@query(f"WITH {KEYS_SQL} SELECT * FROM keys")
def spectrum_keys(spark, d):
    return K.spectrum_keys(*fields(spark))


@query(f"""WITH {KEYS_SQL}, m AS (SELECT *, LEAST(canon, {canon('s2', 's1', 'f1', 'f2')}) AS pair FROM k1 WHERE rn = 1),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair ORDER BY i1, i2, p) AS rn2 FROM m)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY i1, i2, p) - 1 AS INTEGER) AS idx, s1, s2, f1, f2, canon FROM n WHERE rn2 = 1""")
def spectrum_keys_without_mirrors(spark, d):
    return K.spectrum_keys(*fields(spark), drop_mirrored=True)


OBS = ("TT", "EE", "TE", "ET", "BB", "TB", "BT", "EB", "BE")


def _observed(spark):
    pairs = spark.createDataFrame([(k, o[0], o[1]) for k, o in enumerate(OBS)], "p_idx int, s1 string, s2 string")
    return K.spectrum_keys(*fields(spark), pairs=pairs)


_OBS_SQL = KEYS_SQL.split("k0 AS")[0] + f"""pr AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{o[0]}', '{o[1]}')" for k, o in enumerate(OBS))}) p(p, s1, s2)),
k0 AS (SELECT a.i AS i1, b.i AS i2, p, s1, s2, a.f AS f1, b.f AS f2, {canon('s1', 's2', 'a.f', 'b.f')} AS canon FROM fr a, fr b, pr),
k1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY canon ORDER BY i1, i2, p) AS rn FROM k0),
keys AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY i1, i2, p) - 1 AS INTEGER) AS idx, s1, s2, f1, f2, canon FROM k1 WHERE rn = 1)"""
_ODD = "('TB', 'BT', 'EB', 'BE')"


@query(f"WITH {_OBS_SQL} SELECT a.idx AS idx1, b.idx AS idx2, a.canon AS canon1, b.canon AS canon2 FROM keys a JOIN keys b ON a.idx <= b.idx WHERE (a.s1 || a.s2 IN {_ODD}) = (b.s1 || b.s2 IN {_ODD})")
def block_positions(spark, d):
    return K.block_positions(_observed(spark)).select("idx1", "idx2", F.col("a_canon").alias("canon1"), F.col("b_canon").alias("canon2"))


@query(f"WITH {BLOCKS_SQL} SELECT idx1, idx2, CAST(term AS INTEGER) AS term, left_stokes, lft AS left_key, right_stokes, rgt AS right_key FROM prods")
def wick_contractions(spark, d):
    return products(spark).select("idx1", "idx2", "term", "left_stokes", F.col("left").alias("left_key"), "right_stokes", F.col("right").alias("right_key"))


def _b_terms(spark):
    letters = [(a + b, a, b) for a in "TEB" for b in "TEB"]
    p = spark.createDataFrame(letters, "o string, x string, y string")
    a, b = p.toDF("o1", "a", "b"), p.toDF("o2", "c", "e")
    pairs = a.crossJoin(b).withColumn("id", F.concat("o1", "o2"))
    both = pairs.select("id", F.col("a").alias("w"), F.col("c").alias("x"), F.col("b").alias("y"), F.col("e").alias("z")).unionByName(
        pairs.select("id", F.col("a").alias("w"), F.col("e").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    )
    columns = spark.createDataFrame(K.COLUMNS, "letter string, true string, kernel string, sign int")
    return K.wick_with_b(both, columns)


_B_SQL = f"""WITH col AS (SELECT * FROM (VALUES {', '.join(str(c) for c in K.COLUMNS)}) c(letter, t, k, g)), f AS (SELECT UNNEST(['T', 'E', 'B']) AS x),
p AS (SELECT a.x || b.x || c.x || e.x AS id, a.x AS a, b.x AS b, c.x AS c, e.x AS e FROM f a, f b, f c, f e),
q AS (SELECT id, a AS w, c AS x, b AS y, e AS z FROM p UNION ALL SELECT id, a, e, b, c FROM p),
n AS (SELECT id, cw.t || cx.t AS lft, TRANSLATE(cw.k || cx.k, 'TEB', 'TDL') AS ch1, cy.t || cz.t AS rgt, TRANSLATE(cy.k || cz.k, 'TEB', 'TDL') AS ch2, CAST(SUM(cw.g * cx.g * cy.g * cz.g) AS INTEGER) AS coef
  FROM q JOIN col cw ON cw.letter = w JOIN col cx ON cx.letter = x JOIN col cy ON cy.letter = y JOIN col cz ON cz.letter = z GROUP BY 1, 2, 3, 4, 5 HAVING SUM(cw.g * cx.g * cy.g * cz.g) <> 0)"""


@query(f"{_B_SQL} SELECT id, lft AS left_key, ch1, rgt AS right_key, ch2, coef FROM n")
def wick_with_leakage(spark, d):
    return _b_terms(spark).select("id", F.col("left").alias("left_key"), "ch1", F.col("right").alias("right_key"), "ch2", "coef")


@query(f"{_B_SQL} SELECT DISTINCT ch1, ch2 FROM n")
def required_kernel_pairs(spark, d):
    return K.required_pairs(_b_terms(spark))


@query(f"{_B_SQL} SELECT DISTINCT ch1, ch2 FROM n WHERE NOT (ch1 IN ('TT', 'DD') AND ch2 IN ('TT', 'DD', 'LL'))")
def missing_kernel_pairs(spark, d):
    have = spark.createDataFrame([(a, b) for a in ("TT", "DD") for b in ("TT", "DD", "LL")], "ch1 string, ch2 string")
    return K.missing(K.required_pairs(_b_terms(spark)), have)


@query(f"WITH {weights_sql(True)} SELECT bin, ell, ROUND(w, 10) + 0.0 AS w FROM w")
def bin_matrix(spark, d):
    return R.bin_weights(ells(spark), bins(spark), lmin=LMIN).select("bin", "ell", r("w", 10).alias("w"))


@query(f"WITH {weights_sql(False)} SELECT bin, ell, ROUND(w, 10) + 0.0 AS w FROM w")
def bin_matrix_flat(spark, d):
    return R.bin_weights(ells(spark), bins(spark), lmin=LMIN, flatten=False).select("bin", "ell", r("w", 10).alias("w"))


@query(f"WITH {SPECTRA}, {weights_sql(True)} SELECT canon, bin, ROUND(SUM(w * v), 8) + 0.0 AS v FROM cl JOIN w USING (ell) GROUP BY 1, 2")
def binned_spectra(spark, d):
    w = R.bin_weights(ells(spark), bins(spark), lmin=LMIN)
    return R.bin_spectrum(spectra(spark, d), w, ["canon"]).select("canon", "bin", r("v").alias("v"))


@query(f"""WITH {SPECTRA}, {weights_sql(True)} SELECT canon, bin, ROUND(SUM(w * w * 2 * v * v / (2 * cl.ell + 1)), 8) + 0.0 AS variance
FROM cl JOIN w USING (ell) WHERE s1 = s2 AND f1 = f2 GROUP BY 1, 2""")
def full_sky_variance(spark, d):
    """Narrow-kernel covariance on the full sky, where the kernel is the identity over 2l + 1."""
    auto = spectra(spark, d).where("s1 = s2 and f1 = f2")
    w = R.bin_weights(ells(spark), bins(spark), lmin=LMIN)
    cov = auto.select("canon", F.col("ell").alias("l1"), F.col("ell").alias("l2"), (2 * F.col("v") * F.col("v") / (2 * F.col("ell") + 1)).alias("v"))
    return R.bin_blocks(cov, w, ["canon"]).where("bin1 = bin2").select("canon", F.col("bin1").alias("bin"), r("v").alias("variance"))


def nka(spark: SparkSession, d: str) -> DataFrame:
    return R.nka_blocks(products(spark), R.spectra_arrays(spectra(spark, d), LMAX), xi(spark, d), K.norm_table(spark))


_AVG = lambda s, a, b: f"CASE WHEN {s} IN ('TT', 'EE', 'BB') THEN SQRT(ABS({a}.v * {b}.v)) ELSE ({a}.v + {b}.v) / 2 END"
NKA_SQL = f"""{SPECTRA}, {XI}, {BLOCKS_SQL}, norms AS (SELECT * FROM (VALUES {', '.join(str(n) for n in K.NORMS)}) n(ls, rs, norm)),
nka AS (SELECT idx1, idx2, l1, l2, SUM(({_AVG('left_stokes', 'a', 'b')}) * ({_AVG('right_stokes', 'x', 'y')}) * xi.v) AS v
  FROM prods JOIN norms ON ls = left_stokes AND rs = right_stokes JOIN xi USING (norm)
  JOIN cl a ON a.canon = lft AND a.ell = l1 JOIN cl b ON b.canon = lft AND b.ell = l2 JOIN cl x ON x.canon = rgt AND x.ell = l1 JOIN cl y ON y.canon = rgt AND y.ell = l2 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {NKA_SQL}, {weights_sql(True)} SELECT idx1, idx2, i.bin AS bin1, j.bin AS bin2, ROUND(SUM(i.w * j.w * v), 8) + 0.0 AS v FROM nka JOIN w i ON i.ell = l1 JOIN w j ON j.ell = l2 GROUP BY 1, 2, 3, 4")
def nka_binned_blocks(spark, d):
    w = R.bin_weights(ells(spark), bins(spark), lmin=LMIN)
    return R.bin_blocks(nka(spark, d), w).select("idx1", "idx2", "bin1", "bin2", r("v").alias("v"))


_DL2 = f"(l1 * (l1 + 1) / {2 * math.pi!r}) * (l2 * (l2 + 1) / {2 * math.pi!r})"


@query(f"""WITH {NKA_SQL}, {weights_sql(False)}, b AS (SELECT idx1, idx2, i.bin AS bin1, j.bin AS bin2, SUM(i.w * j.w * v * {_DL2}) AS v FROM nka JOIN w i ON i.ell = l1 JOIN w j ON j.ell = l2 GROUP BY 1, 2, 3, 4)
SELECT spec1, bin1, spec2, bin2, ROUND(v, 4) + 0.0 AS v FROM (SELECT idx1 AS spec1, bin1, idx2 AS spec2, bin2, v FROM b UNION ALL SELECT idx2, bin2, idx1, bin1, v FROM b WHERE idx1 <> idx2)""")
def covariance_matrix(spark, d):
    """Whole D_l covariance: keys, Wick products, kernel blocks, scaling, binning, both triangles."""
    w = R.bin_weights(ells(spark), bins(spark), lmin=LMIN, flatten=False)
    return R.full_matrix(R.bin_blocks(R.scale_blocks(nka(spark, d), dl=True), w)).select("spec1", "bin1", "spec2", "bin2", r("v", 4).alias("v"))


@query(f"""WITH {NKA_SQL}, {weights_sql(True)}, b AS (SELECT idx1, idx2, i.bin AS bin1, j.bin AS bin2, SUM(i.w * j.w * v) AS v FROM nka JOIN w i ON i.ell = l1 JOIN w j ON j.ell = l2 GROUP BY 1, 2, 3, 4),
full_m AS (SELECT idx1 AS spec1, bin1, idx2 AS spec2, bin2, v FROM b UNION ALL SELECT idx2, bin2, idx1, bin1, v FROM b WHERE idx1 <> idx2),
fold AS (SELECT idx, MIN(idx) OVER (PARTITION BY f1, f2, LEAST(s1 || s2, s2 || s1)) AS n FROM keys), cnt AS (SELECT n, COUNT(*) AS c FROM fold GROUP BY 1)
SELECT x.n AS spec1, bin1, y.n AS spec2, bin2, ROUND(SUM(v) / (ANY_VALUE(p.c) * ANY_VALUE(q.c)), 8) + 0.0 AS v FROM full_m JOIN fold x ON x.idx = spec1 JOIN fold y ON y.idx = spec2 JOIN cnt p ON p.n = x.n JOIN cnt q ON q.n = y.n GROUP BY 1, 2, 3, 4""")
def folded_covariance(spark, d):
    from pyspark.sql import Window

    keys = K.spectrum_keys(*fields(spark))
    letters = F.least(F.concat("s1", "s2"), F.concat("s2", "s1"))
    fold = keys.select("idx", F.min("idx").over(Window.partitionBy("f1", "f2", letters)).alias("new_idx"))
    w = R.bin_weights(ells(spark), bins(spark), lmin=LMIN)
    return R.fold_mirrored(R.full_matrix(R.bin_blocks(nka(spark, d), w)), fold).select("spec1", "bin1", "spec2", "bin2", r("v").alias("v"))


def _master(spark, d):
    x = xi(spark, d).where("norm in ('00', 'EE')").select(F.when(F.col("norm") == "00", "TT").otherwise("EE").alias("stokes"), "l1", "l2", (F.col("v") * (2 * F.col("l2") + 1)).alias("v"))
    return x


@query(f"""WITH {SPECTRA}, {XI}, m AS (SELECT CASE norm WHEN '00' THEN 'TT' ELSE 'EE' END AS stokes, l1, l2, v * (2 * l2 + 1) AS v FROM xi WHERE norm IN ('00', 'EE')),
n AS (SELECT stokes, l1, l2, v / SUM(v) OVER (PARTITION BY stokes, l1) AS v FROM m)
SELECT canon, CAST(l1 AS INTEGER) AS ell, ROUND(SUM(n.v * cl.v), 8) + 0.0 AS v FROM n JOIN cl ON cl.s1 || cl.s2 = stokes AND cl.ell = l2 GROUP BY 1, 2""")
def smoothed_spectra(spark, d):
    s = spectra(spark, d).where("s1 = s2").withColumn("stokes", F.concat("s1", "s2"))
    return R.inka_spectra(s, _master(spark, d)).select("canon", "ell", r("v").alias("v"))


@query(f"""WITH {XI}, m AS (SELECT norm, l1, l2, v FROM xi), n AS (SELECT norm, l1, l2, v / SUM(v) OVER (PARTITION BY norm, l1) AS v FROM m)
SELECT norm, l1, l2, ROUND(v, 10) + 0.0 AS v FROM n""")
def row_normalised_kernel(spark, d):
    return R.row_normalise(xi(spark, d), ["norm"]).select("norm", "l1", "l2", r("v", 10).alias("v"))


@query(f"WITH {XI} SELECT norm, l1, l2, ROUND(v / SUM(v) OVER (PARTITION BY norm), 10) + 0.0 AS v FROM xi")
def unit_sum_kernel(spark, d):
    return R.unit_sum(xi(spark, d), ["norm"]).select("norm", "l1", "l2", r("v", 10).alias("v"))


@query(f"""WITH {XI}, g AS (SELECT l1, l2, v FROM xi WHERE norm = '00'), s AS (SELECT l1, l2, v FROM xi WHERE norm = 'EE'),
a AS (SELECT g.l1, s.l2, SUM(g.v * s.v) AS v FROM g JOIN s ON g.l2 = s.l1 GROUP BY 1, 2)
SELECT a.l1, g.l1 AS l2, ROUND(SUM(a.v * g.v), 10) + 0.0 AS v FROM a JOIN g ON a.l2 = g.l2 GROUP BY 1, 2""")
def leg_transform(spark, d):
    """G S G^T by two long matrix products."""
    k = xi(spark, d)
    g, s = k.where("norm = '00'").drop("norm"), k.where("norm = 'EE'").drop("norm")
    return R.matmul(R.matmul(g, s), R.transpose(g)).select("l1", "l2", r("v", 10).alias("v"))


L_STAR, DMAX, SIZE = 3, 4, 8


def _acc_kernels(spark, d):
    p = table(spark, d, "part")
    cell = F.col("p_size") - 1
    raw = p.groupBy((F.floor(cell / SIZE)).cast("int").alias("i"), (cell % SIZE).cast("int").alias("j")).agg((F.avg("p_retailprice") / 1e3).alias("v"))
    pairs = spark.createDataFrame([(a, b, k) for a, b in (("TT", "TT"), ("TT", "DD"), ("DD", "DD")) for k in range(DMAX)], "ch1 string, ch2 string, d int")
    return R.unit_sum(raw.crossJoin(F.broadcast(pairs)), ["ch1", "ch2", "d"])


_ACC = [("a", 1, "TT,090x090", "TT", "TT,150x150", "TT", "00"), ("a", 1, "TT,090x150", "TT", "TT,090x150", "TT", "00"), ("b", 2, "EE,090x090", "DD", "EE,090x090", "DD", "EE"), ("c", 1, "TT,220x220", "TT", "EE,220x220", "DD", "20")]


@query(f"""WITH {SPECTRA}, {XI}, raw AS (SELECT CAST(FLOOR((p_size - 1) / {SIZE}) AS INTEGER) AS i, CAST((p_size - 1) % {SIZE} AS INTEGER) AS j, AVG(p_retailprice) / 1e3 AS v FROM part GROUP BY 1, 2),
k AS (SELECT i, j, v / SUM(v) OVER () AS v FROM raw), prod AS (SELECT * FROM (VALUES {', '.join(str(p) for p in _ACC)}) p(id, coef, lft, ch1, rgt, ch2, norm)), ds AS (SELECT CAST(x AS INTEGER) AS d FROM range({DMAX}) r(x)),
up AS (SELECT id, xi.l1, xi.l2, SUM(coef * a.v * k.v * b.v * xi.v) AS v FROM prod, k, ds, xi, cl a, cl b
  WHERE xi.norm = prod.norm AND xi.l2 - xi.l1 = d AND a.canon = lft AND b.canon = rgt AND a.ell = xi.l1 - {L_STAR} + i AND b.ell = xi.l1 - {L_STAR} + j GROUP BY 1, 2, 3)
SELECT id, l1, l2, ROUND(v, 8) + 0.0 AS v FROM (SELECT * FROM up UNION ALL SELECT id, l2, l1, v FROM up WHERE l1 <> l2)""")
def precomputed_kernel_blocks(spark, d):
    p = spark.createDataFrame(_ACC, "id string, coef int, left string, ch1 string, right string, ch2 string, norm string")
    out = R.acc_bands(p, spectra(spark, d), _acc_kernels(spark, d), xi(spark, d), l_star=L_STAR, dmax=DMAX)
    return out.select("id", "l1", "l2", r("v").alias("v"))


@query(f"""WITH {XI}, {weights_sql(True)} SELECT bin, CAST(l2 AS INTEGER) AS ell, ROUND(SUM(w * (1 + l1 / 100.0) * v * (2 * l2 + 1)) * EXP(-0.01 * l2), 10) + 0.0 AS v
FROM w JOIN xi ON xi.l1 = w.ell WHERE norm = '00' GROUP BY 1, l2""")
def window_functions(spark, d):
    w = R.bin_weights(ells(spark), bins(spark), lmin=LMIN)
    kernel = xi(spark, d).where("norm = '00'").select("l1", "l2", (F.col("v") * (2 * F.col("l2") + 1)).alias("v"))
    scale, model = ells(spark).withColumn("v", 1 + F.col("ell") / 100.0), ells(spark).withColumn("v", F.exp(-0.01 * F.col("ell")))
    return R.window_functions(w, scale, kernel, model).select("bin", "ell", r("v", 10).alias("v"))


@query(f"WITH {MASK} SELECT g, ROUND(SUM((2 * l + 1) * wl * l * (l + 1)) / SUM((2 * l + 1) * wl), 6) + 0.0 AS moment FROM wl GROUP BY 1")
def mask_spectral_moment(spark, d):
    return R.mask_moment(mask_wl(spark, d)).select("g", r("moment", 6).alias("moment"))


@query(f"""WITH {MASK}, c AS (SELECT g, l, SUM((2 * l + 1) * GREATEST(wl, 0)) OVER (PARTITION BY g ORDER BY l) AS upto, SUM((2 * l + 1) * GREATEST(wl, 0)) OVER (PARTITION BY g) AS total FROM wl)
SELECT g, MIN(l) AS width FROM c WHERE upto >= 0.9 * total GROUP BY 1""")
def mask_coupling_width(spark, d):
    return R.coupling_width(mask_wl(spark, d), 0.9)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    norm = F.sqrt(sum(F.get(e, F.lit(k)).cast("double") * F.get(e, F.lit(k)).cast("double") for k in range(3)))
    xyz = [(F.get(e, F.lit(k)).cast("double") / norm).alias(n) for k, n in enumerate("xyz")]
    return table(spark, d, "embeddings").select(F.pmod("vec_id", F.lit(4)).cast("int").alias("g"), (F.col("label") / 10.0).alias("w"), *xyz)


PIX = """pix AS (SELECT CAST(vec_id % 4 AS INTEGER) AS g, label / 10.0::DOUBLE AS w, CAST(embedding[1] AS DOUBLE) / n AS x, CAST(embedding[2] AS DOUBLE) / n AS y, CAST(embedding[3] AS DOUBLE) / n AS z
  FROM (SELECT *, SQRT(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2 + CAST(embedding[3] AS DOUBLE) ** 2) AS n FROM embeddings))"""


@query(f"""WITH {PIX} SELECT g, COUNT(*) AS n, ROUND(MIN(w), 8) + 0.0 AS lo, ROUND(MAX(w), 8) + 0.0 AS hi, ROUND(AVG(w), 8) + 0.0 AS mean, ROUND(STDDEV_POP(w), 8) + 0.0 AS std,
COUNT(*) FILTER (w = 0) AS zero, COUNT(*) FILTER (w < 0) AS negative, ROUND(AVG(w * w), 8) + 0.0 AS mean_square FROM pix GROUP BY 1""")
def mask_statistics(spark, d):
    s = R.mask_statistics(pixels(spark, d))
    return s.select("g", "n", *[r(c).alias(c) for c in ("lo", "hi", "mean", "std")], "zero", "negative", r("mean_square").alias("mean_square"))


@query("WITH " + PIX + " SELECT g, " + ", ".join([f"ROUND(SUM(w * {a}) / SUM(w), 8) + 0.0 AS c_{a}" for a in "xyz"] + [f"ROUND(SUM(w * {a} * {b}) / SUM(w), 8) + 0.0 AS t_{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]) + " FROM pix GROUP BY 1")
def mask_direction_moments(spark, d):
    m = R.direction_moments(pixels(spark, d))
    return m.select("g", *[r(c).alias(c) for c in m.columns if c != "g"])


_LEAK = f"""WITH {SPECTRA}, {XI}, ee AS (SELECT ell, v FROM cl WHERE canon = 'EE,090x090'), tt AS (SELECT ell, v FROM cl WHERE canon = 'TT,090x090'),
a AS (SELECT l1 AS ell, SUM(xi.v * ee.v) AS leak FROM xi JOIN ee ON ee.ell = l2 WHERE norm = 'EE' GROUP BY 1), b AS (SELECT l1 AS ell, SUM(xi.v * tt.v) AS sig FROM xi JOIN tt ON tt.ell = l2 WHERE norm = '00' GROUP BY 1),
i AS (SELECT ell, POW(1 + leak / sig, 2) AS inflation FROM a JOIN b USING (ell))"""


def _leak(spark, d):
    s, k = spectra(spark, d), xi(spark, d)
    ee, tt = (s.where(F.col("canon") == f"{x},090x090").select("ell", "v") for x in ("EE", "TT"))
    return R.leakage_limit(k.where("norm = '00'").drop("norm"), k.where("norm = 'EE'").drop("norm"), ee, tt, lmin=LMIN, threshold=1.5)


@query(f"{_LEAK} SELECT CAST(ell AS INTEGER) AS ell, ROUND(inflation, 8) + 0.0 AS inflation FROM i")
def leakage_inflation(spark, d):
    return _leak(spark, d)[0].select("ell", r("inflation").alias("inflation"))


@query(f"{_LEAK} SELECT CAST(COALESCE(MAX(ell) + 1, {LMIN}) AS INTEGER) AS ell_safe FROM i WHERE ell >= {LMIN} AND inflation > 1.5")
def leakage_safe_ell(spark, d):
    return _leak(spark, d)[1]


@query(f"""WITH {BLOCKS_SQL}, x AS (SELECT idx1, idx2, LENGTH(REGEXP_REPLACE(a1 || a2 || b1 || b2, '[^EB]', '', 'g')) AS n_e FROM blocks)
SELECT idx1, idx2, CAST(n_e AS INTEGER) AS n_e, ROUND(CAST(0.5 * n_e AS DOUBLE) * CAST(0.013 AS DOUBLE), 8) + 0.0 AS bias FROM x""")
def error_budget(spark, d):
    b = K.block_positions(K.spectrum_keys(*fields(spark))).select("idx1", "idx2", F.concat("a_s1", "a_s2").alias("stokes1"), F.concat("b_s1", "b_s2").alias("stokes2"))
    return R.error_budget(b, F.lit(0.013)).select("idx1", "idx2", "n_e", r("bias").alias("bias"))


_SEL_SQL = f"""{ALM}, x0 AS (SELECT m, SUM(re * re + im * im) AS p FROM alm WHERE s = 'T' AND f = '090' GROUP BY 1), x AS (SELECT m, p FROM x0 UNION ALL SELECT -m, p FROM x0 WHERE m > 0),
y0 AS (SELECT m, SUM(re * re + im * im) AS p FROM alm WHERE s = 'E' AND f = '090' GROUP BY 1), y AS (SELECT m, p FROM y0 UNION ALL SELECT -m, p FROM y0 WHERE m > 0),
ac AS (SELECT b.m - a.m AS d, SUM(a.p * b.p) AS a FROM x a, x b GROUP BY 1)"""
AZ = f"""{ALM}, p0 AS (SELECT m, SUM(re * re + im * im) AS p FROM alm WHERE s = 'T' AND f = '090' GROUP BY 1), p AS (SELECT m, p FROM p0 UNION ALL SELECT -m, p FROM p0 WHERE m > 0),
ac AS (SELECT CAST(y.m - x.m AS INTEGER) AS d, SUM(x.p * y.p) AS a FROM p x, p y GROUP BY 1)"""


def _azimuthal(spark, d):
    return R.azimuthal_spectrum(alm(spark, d).where("s = 'T' and f = '090'"))


@query(f"WITH {AZ} SELECT CAST(m AS INTEGER) AS m, ROUND(p, 8) + 0.0 AS p FROM p")
def azimuthal_spectrum(spark, d):
    return _azimuthal(spark, d).select("m", r("p").alias("p"))


@query(f"WITH {AZ} SELECT d, ROUND(a, 6) + 0.0 AS a FROM ac")
def azimuthal_autocorrelation(spark, d):
    return R.autocorrelation(_azimuthal(spark, d)).select("d", r("a", 6).alias("a"))


@query(f"""WITH {AZ}, k AS (SELECT ABS(d) AS k, SUM(a) AS a FROM ac GROUP BY 1), c AS (SELECT k, SUM(a) OVER (ORDER BY k) AS upto, SUM(a) OVER () AS total FROM k)
SELECT CAST(MIN(k) AS INTEGER) AS band FROM c WHERE upto >= 0.8 * total""")
def band_choice(spark, d):
    return R.band_choice(R.autocorrelation(_azimuthal(spark, d)), 0.2)


@query(f"WITH {AZ} SELECT CAST(m AS INTEGER) AS m, ROUND(p, 8) + 0.0 AS p FROM p WHERE p >= 0.95 * (SELECT MAX(p) FROM p)")
def kept_modes(spark, d):
    return R.keep_modes(_azimuthal(spark, d), 0.95).select("m", r("p").alias("p"))


def _node_sums(spark, d):
    a = alm(spark, d).where("s = 'E'")
    power = a.groupBy("l").agg(F.sum(F.col("re") * F.col("re")).alias("f"), F.sum(F.col("im") * F.col("im") + F.col("re") * F.col("re")).alias("u"))
    node = spark.createDataFrame([(5,), (20,), (45,)], "node int")
    return power.crossJoin(F.broadcast(node)).select("node", F.col("l").alias("ell"), "f", F.when(F.col("l") % 4 == 1, 0.0).otherwise(F.col("u")).alias("u"))


@query(f"""WITH {ALM}, pw AS (SELECT l, SUM(re * re) AS f, CASE WHEN l % 4 = 1 THEN 0.0 ELSE SUM(im * im + re * re) END AS u FROM alm WHERE s = 'E' GROUP BY 1),
nd AS (SELECT UNNEST([5, 20, 45]) AS node), ok AS (SELECT node, l, f / u AS r FROM pw, nd WHERE u > 1e-9 * (SELECT MAX(u) FROM pw)),
sd AS (SELECT node, ABS(l - node) AS d, AVG(r) AS g FROM ok WHERE ABS(l - node) <= 12 GROUP BY 1, 2), grid AS (SELECT node, CAST(x AS INTEGER) AS d FROM nd, range(13) r(x))
SELECT CAST(grid.node AS INTEGER) AS node, grid.d, ROUND(COALESCE(LAST_VALUE(g IGNORE NULLS) OVER (PARTITION BY grid.node ORDER BY grid.d ROWS UNBOUNDED PRECEDING), 1.0), 8) + 0.0 AS g FROM grid LEFT JOIN sd ON sd.node = grid.node AND sd.d = grid.d""")
def ratio_by_distance(spark, d):
    return R.ratio_by_distance(_node_sums(spark, d), 12).select("node", "d", r("g").alias("g"))


@query(f"WITH {SPECTRA} SELECT canon, ell, ROUND(SUM(v) OVER (PARTITION BY canon ORDER BY ell), 8) + 0.0 AS upto FROM cl")
def cumulative_spectra(spark, d):
    return R.running_sum(spectra(spark, d), ["canon"], "ell", "v", "upto").select("canon", "ell", r("upto").alias("upto"))


@query(f"""WITH {XI}, b AS (SELECT CAST(l2 - l1 + 4 AS INTEGER) AS rw, LEAST(l1, l2) AS ell, v FROM xi WHERE norm = '00' AND ABS(l1 - l2) < 5)
SELECT CAST(CASE WHEN rw >= 4 THEN ell ELSE ell - (rw - 4) END AS INTEGER) AS l1, CAST(CASE WHEN rw >= 4 THEN ell + (rw - 4) ELSE ell END AS INTEGER) AS l2, ROUND(v, 10) + 0.0 AS v FROM b""")
def unflattened_bands(spark, d):
    b = xi(spark, d).where("norm = '00' and abs(l1 - l2) < 5").select((F.col("l2") - F.col("l1") + 4).alias("row"), F.least("l1", "l2").alias("ell"), "v")
    return R.bands_to_pairs(b, 5).select("l1", "l2", r("v", 10).alias("v"))


def _skewed(spark, d):
    return xi(spark, d).select(F.col("norm").alias("g"), "l1", "l2", (F.col("v") * (1 + 0.01 * F.col("l1")) - F.when((F.col("l1") == F.col("l2")) & (F.col("l1") % 7 == 0), 1.0).otherwise(0.0)).alias("v"))


_SKEW = f"{XI}, c AS (SELECT norm AS g, l1, l2, v * (1 + 0.01 * l1) - CASE WHEN l1 = l2 AND l1 % 7 = 0 THEN 1.0 ELSE 0.0 END AS v FROM xi)"


@query(f"WITH {_SKEW} SELECT a.g, ROUND(MAX(ABS(a.v - COALESCE(b.v, 0))), 10) + 0.0 AS worst, ROUND(MAX(ABS(a.v - COALESCE(b.v, 0))) / MAX(ABS(a.v)), 10) + 0.0 AS relative, COUNT(*) FILTER (a.l1 = a.l2 AND a.v <= 0) AS bad_diagonal FROM c a LEFT JOIN c b ON a.g = b.g AND a.l1 = b.l2 AND a.l2 = b.l1 GROUP BY 1")
def conditioning_symmetry(spark, d):
    return R.asymmetry(_skewed(spark, d)).select("g", r("worst", 10).alias("worst"), r("relative", 10).alias("relative"), "bad_diagonal")


@query(f"WITH {_SKEW}, dg AS (SELECT g, l1 AS k, v FROM c WHERE l1 = l2) SELECT c.g, c.l1, c.l2, ROUND(CASE WHEN x.v > 0 AND y.v > 0 THEN c.v / SQRT(x.v * y.v) ELSE 0.0 END, 8) + 0.0 AS v FROM c LEFT JOIN dg x ON x.g = c.g AND x.k = c.l1 LEFT JOIN dg y ON y.g = c.g AND y.k = c.l2")
def correlation_matrix(spark, d):
    return R.correlation(_skewed(spark, d)).select("g", "l1", "l2", r("v").alias("v"))


@query()
def correlation_eigenvalues(spark, d):
    """Eigenvalues have no SQL form; tests compare with numpy."""
    return dense.eigenvalues(R.correlation(_skewed(spark, d))).select("g", "k", r("value", 6).alias("value"))


@query(f"""WITH e AS (SELECT user_id, CAST(EXTRACT(hour FROM ts) AS INTEGER) AS k, SUM(value) / 1e3 AS v FROM events GROUP BY 1, 2)
SELECT user_id, CAST(m AS INTEGER) AS mode, ROUND(SUM(v * COS({-2 * math.pi!r} * m * k / 24)), 6) + 0.0 AS re, ROUND(SUM(v * SIN({-2 * math.pi!r} * m * k / 24)), 6) + 0.0 AS im FROM e, range(13) r(m) GROUP BY 1, 2""")
def ring_transform(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("k")).agg((F.sum("value") / 1e3).alias("v")).withColumn("n", F.lit(24))
    return R.ring_transform(e, ["user_id"], 13).select("user_id", "mode", r("re", 6).alias("re"), r("im", 6).alias("im"))


_RINGS = "WITH p AS (SELECT CAST(i AS INTEGER) AS ring, SIN((i + 0.5) * PI() / 16) AS s, CAST(m AS INTEGER) AS m FROM range(16) a(i), range(40) b(m))"


def rings(spark: SparkSession) -> DataFrame:
    i, m = spark.range(16).select(F.col("id").cast("int").alias("ring")), spark.range(40).select(F.col("id").cast("int").alias("m"))
    return i.crossJoin(m).withColumn("s", F.sin((F.col("ring") + 0.5) * F.lit(math.pi) / 16))


@query(f"{_RINGS} SELECT ring, m, CASE WHEN m = 0 THEN 0.0::DOUBLE WHEN m > 10.0 * s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sharp, ROUND(CASE WHEN m = 0 THEN 0.0 ELSE EXP(-POW(10.0 * s / m, 6)) END, 8) + 0.0 AS smooth, ROUND((CASE WHEN m = 0 THEN 0.0 ELSE EXP(-POW(10.0 * s / m, 6)) END) * (CASE WHEN m = 0 THEN 1.0 ELSE EXP(-POW(m / (30.0 * s), 6)) END), 8) + 0.0 AS both FROM p")
def ring_filters(spark, d):
    smooth = C.highpass("m", "s", 10.0, "exp")
    return rings(spark).select("ring", "m", C.highpass("m", "s", 10.0).alias("sharp"), r(smooth).alias("smooth"), r(smooth * C.lowpass("m", "s", 30.0)).alias("both"))


@query(f"WITH {_RINGS[5:]}, f AS (SELECT m, SUM(CASE WHEN m = 0 THEN 0.0 ELSE EXP(-POW(10.0 * s / m, 6)) END * s) / SUM(s) AS f FROM p GROUP BY 1) SELECT m, ROUND(f, 8) + 0.0 AS f, ROUND(CASE WHEN f > 0 THEN 0.9 / (f * f) ELSE 1.0 END, 4) + 0.0 AS factor, ROUND(CASE WHEN f > 0.01 THEN 2.0 / f ELSE 2.0 END, 6) + 0.0 AS noise FROM f WHERE f = 0 OR f > 1e-4")
def transfer_correction(spark, d):
    f = rings(spark).groupBy("m").agg((F.sum(C.highpass("m", "s", 10.0, "exp") * F.col("s")) / F.sum("s")).alias("f")).where("f = 0 or f > 1e-4")
    return f.select("m", r("f").alias("f"), r(C.transfer_correction(F.lit(0.9), "f", "f"), 4).alias("factor"), r(C.pre_filter_noise(F.lit(2.0), "f"), 6).alias("noise"))


_T = "t AS (SELECT CAST(i AS INTEGER) AS i, i * PI() / 180 AS th FROM range(61) r(i))"


@query(f"WITH {_T} SELECT i, ROUND(CASE WHEN th < {math.pi / 6!r} THEN 0.5 * (1 + COS(PI() * th / {math.pi / 6!r})) ELSE 0.0 END, 8) + 0.0 AS cosine, ROUND(CASE WHEN th < {math.pi / 6!r} THEN EXP(-0.5 * POW(th / {math.pi / 6 / math.sqrt(8 * math.log(2))!r}, 2)) ELSE 0.0 END, 8) + 0.0 AS gaussian FROM t")
def apodization(spark, d):
    t = spark.range(61).select(F.col("id").cast("int").alias("i"), (F.col("id") * F.lit(math.pi) / 180).alias("th"))
    return t.select("i", r(C.apodization("th", math.pi / 6, 1)).alias("cosine"), r(C.apodization("th", math.pi / 6, 0)).alias("gaussian"))


@query(f"WITH {ALM} SELECT s, f, l, m, ROUND(CASE WHEN l <= 30 THEN re * (1 - l / 60.0) ELSE 0.0 END, 8) + 0.0 AS re, ROUND(CASE WHEN l <= 30 THEN im * (1 - l / 60.0) ELSE 0.0 END, 8) + 0.0 AS im FROM alm")
def transferred_alm(spark, d):
    fl = ells(spark, 30).withColumn("v", 1 - F.col("ell") / 60.0)
    return R.apply_transfer(alm(spark, d), fl).select("s", "f", "l", "m", r("re").alias("re"), r("im").alias("im"))


@query(f"WITH {MODEL_SQL}, {BINS_SQL} SELECT canon, bin, ROUND(MIN(model), 10) + 0.0 AS lowest, CAST(ARG_MIN(ell, model) AS INTEGER) AS at FROM model JOIN bins ON ell >= lo AND ell < hi GROUP BY 1, 2")
def bin_lowest_transfer(spark, d):
    m = modelled(spark, d).join(F.broadcast(bins(spark)), (F.col("ell") >= F.col("lo")) & (F.col("ell") < F.col("hi")))
    return m.groupBy("canon", "bin").agg(r(F.min("model"), 10).alias("lowest"), F.min_by("ell", "model").alias("at"))


@query(f"WITH {SPECTRA} SELECT k.canon, CAST(i AS INTEGER) AS ell, ROUND(COALESCE(v, 0.0), 8) + 0.0 AS v FROM (SELECT DISTINCT canon FROM cl) k CROSS JOIN range(61) r(i) LEFT JOIN cl ON cl.canon = k.canon AND cl.ell = i")
def filled_spectra(spark, d):
    return R.filled(spectra(spark, d).select("canon", "ell", "v"), ells(spark, 60), ["canon"]).select("canon", "ell", r("v").alias("v"))


_MU = [k / 7 for k in range(-6, 7)]


@query(f"""WITH RECURSIVE mu AS (SELECT UNNEST({_MU}) AS mu), p(mu, l, p, q) AS (SELECT CAST(mu AS DOUBLE), 0, 1.0::DOUBLE, 0.0::DOUBLE FROM mu UNION ALL
SELECT mu, l + 1, ((2 * l + 1) * mu * p - l * q) / (l + 1), p FROM p WHERE l < 20) SELECT mu, l, ROUND(p, 10) + 0.0 AS v FROM p""")
def legendre_table(spark, d):
    nodes = spark.createDataFrame([(x,) for x in _MU], "mu double")
    return dense.wigner_table(nodes, 20, 0, 0).select("mu", "l", r("v", 10).alias("v"))


def _quadrature() -> str:
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(80)
    return ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in zip(x.tolist(), w.tolist(), strict=True))


@query(f"""WITH RECURSIVE h AS (SELECT p_size AS k, COUNT(*) / (SELECT COUNT(*) FROM part) AS w FROM part GROUP BY 1), n AS (SELECT * FROM (VALUES {_quadrature()}) n(mu, w)),
p(mu, l, p, q) AS (SELECT mu, 0, 1.0::DOUBLE, 0.0::DOUBLE FROM n UNION ALL SELECT mu, l + 1, ((2 * l + 1) * mu * p - l * q) / (l + 1), p FROM p WHERE l < 50),
wm AS (SELECT p.mu, SUM((2 * k + 1) / {4 * math.pi!r} * h.w * p.p) AS c FROM h JOIN p ON p.l = h.k GROUP BY 1)
SELECT CAST(a.l AS INTEGER) AS l1, CAST(b.l AS INTEGER) AS l2, ROUND((2 * b.l + 1) * SUM(0.5 * n.w * c * a.p * b.p), 8) + 0.0 AS v
FROM p a JOIN p b ON a.mu = b.mu JOIN n ON n.mu = a.mu JOIN wm ON wm.mu = a.mu GROUP BY a.l, b.l""")
def master_kernel(spark, d):
    p = table(spark, d, "part")
    h = p.groupBy(F.col("p_size").alias("l")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(p.agg(F.count("*").alias("t"))))
    kernel = dense.coupling_kernels(h.select("l", (F.col("n") / F.col("t")).alias("wl")), LMAX)
    return kernel.where("channel = 'TT'").select("l1", "l2", r("v").alias("v"))


@query(f"WITH {SPECTRA} SELECT CAST(i AS INTEGER) AS l1, CAST(x.ell AS INTEGER) AS l2, ROUND(CASE WHEN x.ell = i THEN 2 * v * v / (2 * i + 1) ELSE 0.0 END, 7) + 0.0 AS v FROM cl x, range({LMAX + 1}) r(i) WHERE canon = 'TT,090x090'")
def exact_rows_full_sky(spark, d):
    """Exact rows through the quadrature grid; without a mask they are the cosmic variance."""
    cl = spectra(spark, d).where("canon = 'TT,090x090'").select("ell", "v")
    out = dense.exact_rows(cl, lambda mu, phi: mu * 0 + phi * 0 + 1.0, LMAX, [x.ell for x in cl.select("ell").orderBy("ell").collect()], 0)
    return out.select("l1", "l2", r("v", 7).alias("v"))


_POL = (("EE", "EE"), ("TT", "EE"), ("TE", "TE"))


@query(f"""WITH {SPECTRA}, w AS (SELECT ell, MAX(v) FILTER (canon = 'TT,090x090') AS tt, MAX(v) FILTER (canon = 'EE,090x090') AS ee, MAX(v) FILTER (canon = 'TE,090x090') AS te FROM cl WHERE ell BETWEEN 2 AND 12 GROUP BY 1),
b AS (SELECT ell, 'EE' AS lft, 'EE' AS rgt, 2 * ee * ee AS x FROM w UNION ALL SELECT ell, 'TT', 'EE', 2 * te * te FROM w UNION ALL SELECT ell, 'TE', 'TE', tt * ee + te * te FROM w)
SELECT lft AS left_stokes, rgt AS right_stokes, CAST(ell AS INTEGER) AS ell, ROUND(x / (2 * ell + 1), 6) + 0.0 AS v FROM b""")
def exact_polarised_full_sky(spark, d):
    """Exact polarised rows; without a mask they are the cosmic variances of the three blocks, up to the 12 multipoles of the fixture's grid."""
    cl = spectra(spark, d).where("canon in ('TT,090x090', 'EE,090x090', 'TE,090x090') and ell <= 12")
    named = cl.select(F.concat("s1", "s2").alias("stokes"), "ell", "v")
    out = dense.exact_rows_polarised(named, lambda mu, phi: mu * 0 + phi * 0 + 1.0, 12, list(range(2, 13)), list(_POL), 0)
    return out.where("l1 = l2").select(F.col("left").alias("left_stokes"), F.col("right").alias("right_stokes"), F.col("l1").alias("ell"), r("v", 6).alias("v"))


def _narrow_quadrature() -> str:
    from .functions import numerics as N

    x, w = N.gauss_legendre(12 + 5 + 32, math.cos(math.pi / 6), 1.0)
    return ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in zip(x.tolist(), w.tolist(), strict=True))


def _narrow(spark):
    wl = spark.range(11).select(F.col("id").cast("int").alias("l"), (F.exp(-0.1 * F.col("id") * (F.col("id") + 1))).alias("wl"))
    return dense.polspice(wl, 12, math.pi / 6)


@query(f"""WITH RECURSIVE n AS (SELECT * FROM (VALUES {_narrow_quadrature()}) n(mu, w)),
p(mu, l, p, q) AS (SELECT mu, 0, 1.0::DOUBLE, 0.0::DOUBLE FROM n UNION ALL SELECT mu, l + 1, ((2 * l + 1) * mu * p - l * q) / (l + 1), p FROM p WHERE l < 12),
c AS (SELECT mu, SUM((2 * l + 1) / {4 * math.pi!r} * EXP(-0.1 * l * (l + 1)) * p) AS c FROM p WHERE l <= 10 GROUP BY 1),
f AS (SELECT n.mu, w, 0.5 * (1 + COS(PI() * ACOS(n.mu) / {math.pi / 6!r})) AS f, c FROM n JOIN c ON c.mu = n.mu)
SELECT ch AS channel, CAST(a.l AS INTEGER) AS l1, CAST(b.l AS INTEGER) AS l2, ROUND((2 * b.l + 1) * SUM(0.5 * w * f * CASE ch WHEN 'K0' THEN 1.0 ELSE 1 / c END * a.p * b.p), 6) + 0.0 AS v
FROM p a JOIN p b ON a.mu = b.mu JOIN f ON f.mu = a.mu, (VALUES ('K0'), ('G0')) k(ch) GROUP BY ch, a.l, b.l""")
def polspice_kernel(spark, d):
    """Scalar regularised kernels of a narrow mask up to 30 degrees."""
    return _narrow(spark).where("channel in ('K0', 'G0')").select("channel", "l1", "l2", r("v", 6).alias("v"))


@query()
def polspice_polarised(spark, d):
    """The other kernels; tests check the identities."""
    return _narrow(spark).where("channel not in ('K0', 'G0')").select("channel", "l1", "l2", r("v", 6).alias("v"))


@query("SELECT CAST(dd AS INTEGER) AS d, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, p.ch1, p.ch2, CASE WHEN dd = 0 AND i = 5 AND j = 5 THEN 11.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(2) x(dd), range(9) a(i), range(9) b(j), (VALUES ('TT', 'TT'), ('TT', 'DD'), ('DD', 'DD')) p(ch1, ch2)")
def couplings_full_sky(spark, d):
    """Precomputed kernels without a mask: 2 l + 1 at the centre, nothing elsewhere."""
    made = sky.coupling_kernels(spark, lambda mu, phi: mu * 0 + phi * 0 + 1.0, 8, 0, 5, 2, [("TT", "TT"), ("TT", "DD"), ("DD", "DD")])
    return made.select("d", "i", "j", "ch1", "ch2", r("v").alias("v"))


@query(f"""WITH RECURSIVE h AS (SELECT p_size AS k, COUNT(*) / (SELECT COUNT(*) FROM part) AS w FROM part GROUP BY 1), n AS (SELECT * FROM (VALUES {_quadrature()}) n(mu, w)),
p(mu, l, p, q) AS (SELECT mu, 0, 1.0::DOUBLE, 0.0::DOUBLE FROM n UNION ALL SELECT mu, l + 1, ((2 * l + 1) * mu * p - l * q) / (l + 1), p FROM p WHERE l < 50),
wm AS (SELECT p.mu, SUM((2 * k + 1) / {4 * math.pi!r} * h.w * p.p) AS c FROM h JOIN p ON p.l = h.k GROUP BY 1)
SELECT CAST(m AS INTEGER) AS m, ROUND({2 * math.pi!r} * SUM(n.w * c * c * CASE WHEN m = 0 THEN {3 / (4 * math.pi)!r} * n.mu * n.mu ELSE {3 / (8 * math.pi)!r} * (1 - n.mu * n.mu) END), 8) + 0.0 AS p
FROM n JOIN wm ON wm.mu = n.mu, range(-1, 2) r(m) GROUP BY 1""")
def mode_power(spark, d):
    """Share of a symmetric mask's power that each order of degree 1 sees."""
    p = table(spark, d, "part")
    h = p.groupBy(F.col("p_size").alias("l")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(p.agg(F.count("*").alias("t"))))
    return dense.mode_power(h.select("l", (F.col("n") / F.col("t")).alias("wl")), 1).select("m", r("p").alias("p"))


@query(f"WITH {ALM} SELECT s, f, l, m, ROUND(re, 8) + 0.0 AS re, ROUND(im, 8) + 0.0 AS im FROM alm WHERE l <= 20")
def truncated_alm(spark, d):
    return R.truncated(alm(spark, d), 20).select("s", "f", "l", "m", r("re").alias("re"), r("im").alias("im"))


@query(f"WITH {ALM} SELECT s, f, l, m, ROUND(re, 6) + 0.0 AS re, ROUND(im, 6) + 0.0 AS im FROM alm UNION ALL SELECT s, f, l, CAST(-m AS INTEGER), ROUND(CASE WHEN m % 2 = 0 THEN re ELSE -re END, 6) + 0.0, ROUND(CASE WHEN m % 2 = 0 THEN -im ELSE im END, 6) + 0.0 FROM alm WHERE m > 0")
def full_order_alm(spark, d):
    return R.full_orders(alm(spark, d)).select("s", "f", "l", "m", r("re", 6).alias("re"), r("im", 6).alias("im"))


@query(f"""WITH {ALM}, p AS (SELECT a.f, a.l, a.m, a.re AS tr, a.im AS ti, b.re AS er, b.im AS ei FROM alm a JOIN alm b ON a.f = b.f AND a.l = b.l AND a.m = b.m WHERE a.s = 'T' AND b.s = 'E')
SELECT f, l, m, ROUND(tr, 6) + 0.0 AS re, ROUND(CASE WHEN m = 0 THEN 0.0 ELSE ti END, 6) + 0.0 AS im, ROUND(er, 6) + 0.0 AS re2, ROUND(CASE WHEN m = 0 THEN 0.0 ELSE ei END, 6) + 0.0 AS im2 FROM p""")
def real_pair_of_complex_alm(spark, d):
    """T + iE as one complex field over both signs of m, and back to its two real parts."""
    whole = R.full_orders(alm(spark, d).withColumn("im", F.when(F.col("m") == 0, 0.0).otherwise(F.col("im"))))
    t, e = whole.where("s = 'T'").drop("s"), whole.where("s = 'E'").select("f", "l", "m", F.col("re").alias("er"), F.col("im").alias("ei"))
    field = t.join(e, ["f", "l", "m"]).select("f", "l", "m", (F.col("re") - F.col("ei")).alias("re"), (F.col("im") + F.col("er")).alias("im"))
    return R.half_orders(field, ["f"]).select("f", "l", "m", *[r(x, 6).alias(x) for x in ("re", "im", "re2", "im2")])


@query("SELECT CAST(i AS INTEGER) AS ell, CAST(GREATEST(128, POW(2, FLOOR(LOG2(i + 100)))) AS INTEGER) AS nside FROM range(3001) r(i)")
def resolution(spark, d):
    return ells(spark, 3000).select("ell", C.nside_for("ell").alias("nside"))


@query("SELECT CAST(k AS INTEGER) AS k, ROUND(CASE WHEN k % 2 = 0 THEN 2.0::DOUBLE / (k + 1) ELSE 0.0::DOUBLE END, 10) + 0.0 AS moment FROM range(24) r(k)")
def quadrature_moments(spark, d):
    """Moments of the least grid for a field of band limit 8 and a mask of 6: exact up to degree 23."""
    from .functions import numerics as N

    x, w = N.gauss_legendre(N.minimal_band(8, 6) + 1)
    nodes = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w, strict=True)], "mu double, w double")
    k = spark.range(24).select(F.col("id").cast("int").alias("k"))
    return k.crossJoin(F.broadcast(nodes)).groupBy("k").agg(r(F.sum(F.col("w") * F.pow("mu", F.col("k"))), 10).alias("moment"))


@query(f"WITH {_OBS_SQL} SELECT a.idx AS idx1, b.idx AS idx2 FROM keys a JOIN keys b ON a.idx <= b.idx WHERE (a.s1 || a.s2 IN {_ODD}) = (b.s1 || b.s2 IN {_ODD}) AND ((a.canon = 'TE,090x150' AND b.s1 || b.s2 = 'EE') OR (b.canon = 'TE,090x150' AND a.s1 || a.s2 = 'EE'))")
def block_lookup(spark, d):
    return K.lookup(K.block_positions(_observed(spark)), "ET,150x090", "EE").select("idx1", "idx2")


@query(f"""WITH {BLOCKS_SQL}, norms AS (SELECT * FROM (VALUES {', '.join(str(n) for n in K.NORMS)}) n(ls, rs, norm)) SELECT DISTINCT norm FROM prods JOIN norms ON ls = left_stokes AND rs = right_stokes""")
def needed_channels(spark, d):
    return K.norm_channels(products(spark), K.norm_table(spark))


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT idx1, idx2, LEAST(lft || '|' || left_stokes || '#' || rgt || '|' || right_stokes, rgt || '|' || right_stokes || '#' || lft || '|' || left_stokes) AS t FROM prods),
g AS (SELECT idx1, idx2, STRING_AGG(t, ';' ORDER BY t) AS t FROM t GROUP BY 1, 2) SELECT idx1, idx2, COUNT(*) OVER (PARTITION BY t) AS blocks FROM g""")
def equal_term_blocks(spark, d):
    """How many blocks consist of the same products, either way round."""
    from pyspark.sql import Window

    p = products(spark).select("idx1", "idx2", "left", F.col("left_stokes").alias("ch1"), "right", F.col("right_stokes").alias("ch2"))
    return K.term_multisets(p).select("idx1", "idx2", F.count("*").over(Window.partitionBy("terms")).alias("blocks"))


@query(f"""WITH {_SEL_SQL}, k AS (SELECT x.m, y.m AS mp, x.p * y.p * a.a AS e, x.p >= 0.2 * (SELECT MAX(p) FROM x) AS ox, y.p >= 0.2 * (SELECT MAX(p) FROM y) AS oy FROM x, y, ac a WHERE a.d = x.m - y.m)
SELECT CAST(m AS INTEGER) AS m, CAST(mp AS INTEGER) AS mp FROM k WHERE ox AND oy AND e >= 0.3 * (SELECT MAX(e) FROM k)""")
def kept_order_pairs(spark, d):
    one, two = (R.azimuthal_spectrum(alm(spark, d).where(f"s = '{s}' and f = '090'")) for s in "TE")
    return R.kept_pairs(one, two, R.autocorrelation(one), 0.2, 0.3)


@query(f"WITH {_SEL_SQL}, u AS (SELECT m, p >= 0.9 * (SELECT MAX(p) FROM x) AS keep FROM x UNION ALL SELECT m, p >= 0.9 * (SELECT MAX(p) FROM y) FROM y) SELECT CAST(m AS INTEGER) AS m, BOOL_OR(keep) AS keep FROM u GROUP BY 1")
def union_of_selections(spark, d):
    from pyspark.sql import Window

    sel = None
    for s in "TE":
        p = R.azimuthal_spectrum(alm(spark, d).where(f"s = '{s}' and f = '090'"))
        own = p.select("m", (F.col("p") >= 0.9 * F.max("p").over(Window.partitionBy())).alias("keep"))
        sel = own if sel is None else sel.unionByName(own)
    return R.union_of_selections(sel, ["m"])


@query(f"""WITH {NKA_SQL}, {weights_sql(False)} SELECT idx1, idx2, i.bin AS bin1, j.bin AS bin2, ROUND(SUM(i.w * j.w * v * {_DL2} * (1 + l1 / 100.0) * (1 + l2 / 100.0)), 4) + 0.0 AS v
FROM nka JOIN w i ON i.ell = l1 JOIN w j ON j.ell = l2 GROUP BY 1, 2, 3, 4""")
def debiased_blocks(spark, d):
    """Binned blocks in D_l, with the debiasing of both legs."""
    debias = spectra(spark, d).select(F.col("canon").alias("key"), "ell", (1 + F.col("ell") / 100.0).alias("v"))
    legs = K.spectrum_keys(*fields(spark)).select("idx", F.col("canon").alias("key"))
    w = R.bin_weights(ells(spark), bins(spark), lmin=LMIN, flatten=False)
    return R.bin_blocks(R.scale_blocks(nka(spark, d), dl=True, debias=debias, legs=legs), w).select("idx1", "idx2", "bin1", "bin2", r("v", 4).alias("v"))


_SUMS = "sm AS (SELECT ch1, ch2, CAST(CASE WHEN p_size <= 25 THEN 0 ELSE 1 END AS INTEGER) AS d, SUM(p_retailprice / 1e6) AS s FROM part, (VALUES ('TT', 'TT'), ('TT', 'DD'), ('TT', 'LL'), ('DD', 'DD'), ('DL', 'LD'), ('TL', 'DD')) c(ch1, ch2) WHERE (ch2 <> 'LL' OR p_size % 5 = 0) GROUP BY 1, 2, 3)"


def _sums(spark, d):
    """Kernel sums by channel pair and distance: prices of small and large parts."""
    pairs = spark.createDataFrame([("TT", "TT"), ("TT", "DD"), ("TT", "LL"), ("DD", "DD"), ("DL", "LD"), ("TL", "DD")], "ch1 string, ch2 string")
    p = table(spark, d, "part").crossJoin(F.broadcast(pairs)).where("ch2 <> 'LL' or p_size % 5 = 0")
    return p.groupBy("ch1", "ch2", F.when(F.col("p_size") <= 25, 0).otherwise(1).alias("d")).agg(F.sum(F.col("p_retailprice") / 1e6).alias("s"))


@query(f"WITH {_SUMS} SELECT d, ROUND(SUM(s) FILTER (ch1 = 'TT' AND ch2 = 'LL') / SUM(s) FILTER (ch1 = 'TT' AND ch2 = 'DD'), 10) + 0.0 AS ratio FROM sm GROUP BY 1")
def leakage_ratio(spark, d):
    return R.leakage_ratio(_sums(spark, d)).select("d", r("ratio", 10).alias("ratio"))


def _wide_xi(spark, d):
    pick = lambda n: F.max(F.when(F.col("norm") == n, F.col("v")))
    wide = xi(spark, d).groupBy("l1", "l2").agg(pick("00").alias("x00"), pick("20").alias("x20"), pick("EE").alias("xee"))
    return wide.withColumn("xeb", F.col("xee") * (0.05 + 0.5 / (F.col("l1") + F.col("l2") + 2)))


_WIDE = f"""{XI}, wx AS (SELECT l1, l2, MAX(v) FILTER (norm = '00') AS x00, MAX(v) FILTER (norm = '20') AS x20, MAX(v) FILTER (norm = 'EE') AS xee, CAST(0.05 + 0.5::DOUBLE / (l1 + l2 + 2) AS DOUBLE) AS rho FROM xi GROUP BY 1, 2)"""


@query(f"""WITH {_WIDE}, {_SUMS}, g AS (SELECT CASE ch2 WHEN 'TT' THEN '00' ELSE '20' END AS rule, d, SUM(s) AS s FROM sm WHERE ch1 = 'TT' AND ch2 IN ('TT', 'DD', 'LL') GROUP BY 1, 2),
o AS (SELECT rule, g.d, ABS(s / (21 * (2 * (10 + g.d) + 1) * CASE rule WHEN '00' THEN x00 ELSE x20 END) - 1) AS off FROM g JOIN wx ON l1 = 10 AND l2 = 10 + g.d)
SELECT rule, ROUND(MAX(off), 8) + 0.0 AS worst, ARG_MAX(d, off) AS at FROM o GROUP BY 1""")
def normalisation_consistency(spark, d):
    return R.normalisation_consistency(_sums(spark, d), _wide_xi(spark, d), 10).select("rule", r("worst").alias("worst"), "at")


@query(f"""WITH {_WIDE}, {_SUMS}, u AS (SELECT l1, l2 - l1 AS d, x00, x20, xee, rho FROM wx WHERE l2 >= l1),
j AS (SELECT sm.*, u.l1 AS m, u.x00, u.x20, u.xee, u.rho, c.x00 AS c00, c.x20 AS c20, c.xee AS cee, c.rho AS crho,
  LENGTH(REGEXP_REPLACE(ch1 || ch2, 'T', '', 'g')) AS n, LENGTH(REGEXP_REPLACE(ch1 || ch2, '[^L]', '', 'g')) AS k, 21 * (2 * (10 + sm.d) + 1) AS modes FROM sm JOIN u ON u.d = sm.d JOIN u c ON c.d = sm.d AND c.l1 = 10),
q AS (SELECT *, CASE n WHEN 0 THEN x00 WHEN 2 THEN x20 WHEN 4 THEN xee ELSE x00 * POW(x20 / x00, n / 2.0) END * POW(rho, k / 2.0) AS p, CASE n WHEN 0 THEN c00 WHEN 2 THEN c20 WHEN 4 THEN cee ELSE c00 * POW(c20 / c00, n / 2.0) END * POW(crho, k / 2.0) AS pc FROM j),
e AS (SELECT *, s / (modes * pc) AS e FROM q)
SELECT ch1, ch2, d, CAST(m AS INTEGER) AS m, ROUND(CASE WHEN n = 0 THEN x00 / s WHEN k = 0 THEN p * (1 - (1 - e) * rho / crho) / s
  WHEN ch1 = 'DL' AND ch2 = 'LD' THEN p * SIGN(e) * GREATEST(0, LEAST(0.5, 0.25 + (ABS(e) - 0.25) * (21 + d) / (2 * m + d + 1))) / s ELSE p / (modes * pc) END, 6) + 0.0 AS x FROM e""")
def term_scales(spark, d):
    """What each Wick term of a run with leakage is multiplied by."""
    return R.term_scale(_wide_xi(spark, d), _sums(spark, d), 10).select("ch1", "ch2", "d", "m", r("x", 6).alias("x"))


@query()
def rho_interpolation(spark, d):
    """Monotone cubic lookup in ln l between nodes; the dense form is checked in tests."""
    g = R.ratio_by_distance(_node_sums(spark, d), 12)
    return dense.interpolate_nodes(g, LMAX, 12).select("l1", "l2", r("v").alias("v"))
