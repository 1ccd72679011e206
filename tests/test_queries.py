import pytest

from logweave.plans import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], SQL[name], SF)


def test_partition_count_does_not_matter(spark):
    from tests.oracle import rows

    q = registry.queries()["w4_search_slice"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in (1, 7, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(q(spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]
