"""Every stage of the pipeline against a plain version of its decision."""

import corpus_pipeline as C
from schedlens.llm import exact_dedup, quality

from .helpers import awkward, clashing, docs, sample
from .test_packing import check
from .test_pii import PATTERNS, base
from .test_simhash import brute as components

SF = "/root/testdata/sf0.001"
NAMES = [n for n, _ in C.STAGES]
FN = dict(C.STAGES)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_operators():
    assert NAMES == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]


def test_stages_in_sequence(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    columns = read.columns
    scored = {r.doc_id: r.predicted for r in quality.classify(read, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    have = texts(read)
    out = FN["quality"](spark, read, SF)
    good = texts(out)
    assert out.columns == columns and good == {d: t for d, t in have.items() if scored[d]}

    out = FN["exact_dedup"](spark, docs(spark, good.items()), SF)
    first = {}
    for d in sorted(good):
        first.setdefault(exact_dedup.normalise(good[d].encode()), d)
    once = texts(out)
    assert out.columns == columns and once == {d: good[d] for d in first.values()}

    out = FN["near_dedup"](spark, docs(spark, once.items()), SF)
    apart = texts(out)
    assert out.columns == columns and sorted(apart) == sorted({c for _, _, c in components(list(once.items()))})

    out = FN["pii"](spark, docs(spark, apart.items()), SF)
    clear = out.collect()
    assert out.columns == columns and {r.doc_id for r in clear} == set(apart)
    for r in clear:
        assert r.n_chars == len(r.text) and not base(r.text)
        if not base(apart[r.doc_id]) and "=" not in apart[r.doc_id] and "AKIA" not in apart[r.doc_id]:
            assert r.text == apart[r.doc_id]

    pairs = [(r.doc_id, r.text) for r in clear]
    check(pairs, FN["packing"](spark, docs(spark, pairs), SF).collect(), C.packing.MAX_LEN, C.packing.TOKEN_BUDGET)
    assert PATTERNS


def test_run_is_the_composition(spark):
    out = C.run(spark, SF).collect()
    step = spark.read.parquet(f"{SF}/documents.parquet")
    for name in NAMES:
        step = FN[name](spark, step, SF)
    assert sorted(map(tuple, out)) == sorted(map(tuple, step.collect()))


def test_awkward_rows_and_empty_tables(spark):
    for rows in (awkward() + [(12, "A B C d")] + sample()[:20], []):
        step = clashing(docs(spark, rows))
        for name in NAMES[:-1]:
            columns = step.columns
            step = spark.createDataFrame(FN[name](spark, step, SF).collect(), step.schema)
            assert step.columns == columns
        FN["packing"](spark, step, SF).collect()


def test_repeated_rows_leave_one(spark):
    out = FN["exact_dedup"](spark, docs(spark, [(1, "a  b"), (1, "a b"), (1, "c"), (None, "a b"), (2, "c")]), SF).collect()
    assert sorted((r.doc_id, r.text.replace("  ", " ")) for r in out) == [(1, "a b"), (1, "c")]
