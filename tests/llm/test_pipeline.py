import corpus_pipeline
from pyspark.sql import functions as F

from harmonia.llm import decontaminate, minhash, registry

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name != "sharding":
            assert docs.columns == before.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "toxicity":
            clean = labels.where("toxic = 0")
            lost = before.join(clean, "doc_id").count() - docs.join(clean, "doc_id").count()
            assert lost <= 0.05 * clean.count()
        if name == "near_duplicates":
            assert minhash.near_duplicates(docs, percent=80).where("not kept").count() == 0
        if name == "decontamination":
            assert decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > sizes[4] == sizes[5]
    assert docs.agg(F.min("shard"), F.max("shard")).first()[1] == 23


def test_stages_handle_edges(spark):
    rows = [(None, "null id", "en", "s"), (None, None, None, None), (1, None, "en", None), (2, "", None, "s"), (3, " \t", "en", "s"), (4, "a b c d e f g", "en", "s"), (4, "a b c d e f g", "en", "s"), (4, "something else by the same name", "en", "t")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("shard", "score", "key", "component_id", "tokens", "item_id")})
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and set(out.columns) == set(docs.columns)
        left = sorted(str((r.doc_id, r.text)) for r in out.collect())
        want = sorted(str((r[0], r[1])) for r in rows)
        if name == "near_duplicates":
            want.remove(str((4, "a b c d e f g")))
        if name == "mixing":
            assert set(left) <= set(want) and len(left) >= 4
        else:
            assert left == want, name


def test_names():
    assert corpus_pipeline.ORACLE_SQL is None
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 11))
