import hashlib
import zlib

from pyspark.sql import functions as F

from schedlens.llm import merkle as M

from .helpers import DOCS, awkward, clashing


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], text)])


def climb(nodes):
    """Root, and every node's siblings level by level, by definition."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, a in enumerate(at):
            first = a // 3 * 3
            paths[i].append((level[first:a], level[a + 1:first + 3]))
        at = [a // 3 for a in at]
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r, leaf(r, r[1])) for r in rows if r[3] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = (own, *climb([x[1] for x in own]))
    root, over = climb([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, over):
        own, sub, paths = trees[s]
        for (r, l), path in zip(own, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r, r[1].replace("\n", "") if hit else r[1])
            for a, b in path + up:
                node = h(*a, node, *b)
            proof = h(*[x for a, b in path + up for x in a + b])
            out.append((r[0], l, sub, root, proof, node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, DOCS)
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", ""))
    out = M.merkle_manifest(clashing(df).repartition(3), found, **kw)
    return out


def digests(out):
    got = out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("p"), "folded_root", "verified")
    return sorted([tuple(r) for r in got.collect()], key=repr)


def rows_of(pairs, sources):
    return [(i, t, None if k % 7 == 0 else "en", sources[k % len(sources)], None if k % 5 == 0 else len(t or ""))
            for k, (i, t) in enumerate(pairs)]


def test_awkward_rows(spark):
    rows = rows_of(awkward() + [(k, f"line {k}\nnext\n") for k in range(40, 70)], ["b", None, "a", "", "é", "b"])
    assert digests(run(spark, rows)) == brute(rows)


def test_many_tiers_and_a_hot_source(spark):
    """Blocks of three leaves: five tiers of blocks over the hot source."""
    rows = [(k, f"t{k}\n", "en", "hot" if k % 3 else f"s{k}", k) for k in range(1, 250)] + [(7, None, None, None, None)] * 4
    want = brute(rows)
    assert digests(run(spark, rows, block_levels=1)) == want
    assert digests(run(spark, rows, block_levels=2)) == want


def test_one_row_and_none(spark):
    rows = [(2, "a\nb", "en", "s", 3)]
    got = digests(run(spark, rows))
    assert got == brute(rows) and got[0][1] == got[0][2] == got[0][3]
    assert run(spark, []).collect() == []


def test_versions_share_all_but_their_path(spark):
    rows = [(k, f"t{k}\n", "en", "ab"[k % 2], k) for k in range(60)]
    out = run(spark, rows, block_levels=2).collect()
    changed = [r for r in out if r.copied is not None]
    assert changed and all(r.copied[-1] == r.folded_root and not r.verified for r in changed)
    assert all(r.verified for r in out if r.copied is None)
    tree = M.BlockTree([h(str(i)) for i in range(20)], 3)
    before = [list(x) for x in tree.levels]
    copied = tree.version(11, h("x"))
    assert tree.levels == before and len(copied) == len(before)
    again = M.BlockTree([h(str(i)) if i != 11 else h("x") for i in range(20)], 3)
    for up, (old, new) in enumerate(zip(tree.levels, again.levels)):
        assert [i for i, (a, b) in enumerate(zip(old, new)) if a != b] == [11 // 3 ** up]
        assert new[11 // 3 ** up] == copied[up]
