"""Every column of the seven written band files, against the feature table's oracle."""

import math
import os

import duckdb

import __spark_entry__ as E
from schedlens.plans import pipelines
from schedlens.plans.queries import SQL_BANDS, stages
from schedlens.session import scratch_path

SF = "/root/testdata/sf0.01"


def same(a, b):
    if isinstance(a, str) or a is None or b is None:
        return a == b
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) or math.isnan(a) and math.isnan(b)


def test_written_bands_hold_every_feature_column(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    con.execute(f"CREATE TABLE features AS {E.oracle_sql()['job_features']}")
    names = [x[0] for x in con.execute("DESCRIBE features").fetchall()]
    st = stages(spark, SF)
    paths = pipelines.export_jobs(spark, st.job_utils, st.tasks_with_jobs_and_machines, scratch_path(spark, "bands"))
    assert paths.keys() == SQL_BANDS.keys() and len(names) > 170
    rows = 0
    for band, cond in SQL_BANDS.items():
        got = spark.read.parquet(paths[band])
        assert sorted(got.columns) == sorted(names)
        have = {r[names.index("job_id")]: r for r in map(tuple, got.select(*[f"`{n}`" for n in names]).collect())}
        want = con.execute(f"SELECT * FROM features WHERE {cond}").fetchall()
        assert len(have) == len(want) == got.count()
        rows += len(want)
        for w in want:
            h = have[w[names.index("job_id")]]
            assert [n for n, x, y in zip(names, h, w) if not same(x, y)] == []
    assert rows > 15  # 15 jobs, most of them in several bands
