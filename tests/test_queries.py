"""Every query of the library against its SQL."""

import pytest

from oracle import check, connect
from siltstone.plans.queries import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_matches_sql(spark, con, name):
    check(queries()[name](spark, SF), con, oracles()[name])


@pytest.mark.parametrize("name", ["training_manifest", "split_rows", "length_buckets", "components"])
def test_partitioning_does_not_matter(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        check(queries()[name](spark, SF), con, oracles()[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
