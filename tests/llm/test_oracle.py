import duckdb
import pytest

from harmonia.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    df = registry.QUERIES[name](spark, SF)
    kinds = {"double": "DOUBLE", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {k: kinds[t] for k, t in df.dtypes} == {x[0]: str(x[1]) for x in cur.description}
    got = sorted((tuple(r) for r in df.select(names).collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr)
