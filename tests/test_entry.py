"""Driver contract: entry runs, queries and oracles line up."""

import __spark_entry__ as E


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "usage_id" in df.columns


def test_scale_settings():
    from schedlens.session import scale_settings

    small = scale_settings(10 << 20)
    assert small["spark.sql.shuffle.partitions"] == "200"
    big = scale_settings(100 * 10**12)  # 100 TB
    assert big["spark.sql.shuffle.partitions"] == str(-(-100 * 10**12 // (512 << 20)))  # no cap
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert scale_settings(2 * 10**12)["spark.sql.shuffle.partitions"] == str(-(-2 * 10**12 // (512 << 20)))
