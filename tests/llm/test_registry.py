import duckdb
import pytest

from lodestone.llm import registry

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    rel = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, D).select(*rel.columns)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    assert [kinds[k] for _, k in got.dtypes] == [str(t) for t in rel.types]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
