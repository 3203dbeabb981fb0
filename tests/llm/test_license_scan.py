import math
import re

from schedlens.llm import license_scan as S

from .helpers import awkward, sample

FILES = "doc_id long, path string, text string, license string, dir string, salt int"


def files(spark, rows):
    return spark.createDataFrame([(i, p, t, "x", "y", 1) for i, p, t in rows], FILES)


def brute(rows):
    """The scan from its definition, scoring every sentence (no anchors)."""
    n = len(rows)
    seen = [set(S.terms_of(t or "")) for _, _, t in rows]
    idf = lambda t: math.log((1 + n) / (1 + sum(t in s for s in seen))) + 1
    weight = {}

    def vector(ts):
        for t in ts:
            if t not in weight:
                weight[t] = idf(t)
        return {t: ts.count(t) * weight[t] for t in set(ts)}

    templates = [(name, S.terms_of(x), vector(S.terms_of(x))) for name, ts in S.TEMPLATES.items() for x in ts]

    def best(ts, cut):
        top = (0.0, "~")
        for name, words, w in templates:
            last = max(len(ts) - len(words), 0) if cut else 0
            for a in range(last + 1):
                if a < last and ts[a] not in words:
                    continue
                v = vector(ts[a:a + len(words)] if cut else ts)
                if not v:
                    continue
                c = sum(x * w.get(t, 0) for t, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values()))
                c = round(c, 9)
                if c > top[0] or c == top[0] and name < top[1]:
                    top = (c, name)
        return top if top[0] >= S.THRESHOLD else None

    notes, speaks = [], {}
    for i, p, t in rows:
        t, p = t or "", p or ""
        own, count = None, 0
        for piece in re.split(r"\n|(?<=[.;!?])\s", t):
            ts = S.terms_of(piece)
            b = best(ts, True)
            if b:
                count += 1
                if own is None or (-b[0], b[1]) < (-own[0], own[1]):
                    own = b
        whole = best(S.terms_of(t), False)
        folder, _, name = p.rpartition("/")
        note = (own or whole) if re.match(S.FILE_NAMES, name) else whole
        if note:
            cur = speaks.get(folder)
            if cur is None or (-note[0], note[1]) < (-cur[0], cur[1]):
                speaks[folder] = note
        notes.append((i, p, folder, own, count))
    out = []
    for i, p, folder, own, count in notes:
        if own:
            out.append((i, p, own[1], round(own[0], 6), count, "header", None))
            continue
        parts = folder.split("/")
        for k in range(len(parts), -1, -1):
            above = "/".join(parts[:k]) if k else ""
            if above in speaks:
                out.append((i, p, speaks[above][1], round(speaks[above][0], 6), count, "inherited", above))
                break
        else:
            out.append((i, p, None, None, count, "none", None))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.path, r.license, None if r.score is None else round(r.score, 6), r.n_notices, r.method, r.from_dir)
                   for r in df.collect()], key=repr)


TREE = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "print(1)"), (3, "a/b/c/y.py", None),
    (4, "a/b/c/COPYING", "Some words first.\nThis work is licensed under the GNU General Public License, version 3.\nMore words."),
    (5, "z.txt", ""), (6, "q/w.txt", "Licensed under the Apache License, Version 2.0."), (7, "q/v.txt", "no notice here"),
    (8, "a/own.py", "# Licensed under CC BY-NC 4.0.\ncode code code. " + "filler words " * 400), (9, None, "plain"),
    (10, "a/b/long.txt", "word " * 70 + "Licensed under the Apache License Version 2.0 " + "word " * 200),
    (11, "a/b/not.txt", "the public was licensed to the general version of this work"), (None, "a/b/x.py", "print(1)"), (2, "a/b/x.py", "print(1)"),
]


def test_tree(spark):
    got = found(S.scan(files(spark, TREE)))
    assert got == brute(TREE)
    by = {r[0]: r for r in got if r[0]}
    assert by[2][2] == by[3][2] or by[3][2] == "GPL-3.0"
    assert by[2][5] == "inherited" and by[2][2] == "MIT" and by[2][6] == "a"
    assert by[3][2] == "GPL-3.0" and by[3][6] == "a/b/c" and by[5][5] == "none"
    # a notice inside a long sentence
    assert by[10][2] == "Apache-2.0" and by[10][5] == "header" and by[10][3] > 0.99
    assert by[7][2] == "Apache-2.0" and by[8][2] == "CC-BY-NC-4.0" and by[8][5] == "header"


def test_documents(spark):
    docs = [(i, f"s{i % 3}/en/{i // 50}/{i}.txt", t) for i, t in sample() + awkward() if i is not None]
    got = found(S.scan(files(spark, docs)))
    assert got == brute(docs)
    assert sum(r[5] == "header" for r in got) == sum(bool(re.search("(?i)licen[sc]e", t or "")) for _, _, t in docs)


def test_repeated_notices_of_any_length_speak_for_the_directory(spark):
    rows = [(i, f"d{i}/all.txt", "Released under the MIT License.\n" * n) for i, n in ((1, 2), (2, 80), (3, 140), (4, 2000))]
    rows += [(10 + i, f"d{i}/x.py", "print(1)") for i in (1, 2, 3, 4)]
    got = {r[0]: r for r in found(S.scan(files(spark, rows)))}
    assert [got[10 + i][2:] for i in (1, 2, 3, 4)] == [("MIT", got[i][3], 0, "inherited", f"d{i}") for i in (1, 2, 3, 4)]


def test_a_notice_among_common_words_is_found_at_every_size(spark):
    """The same shares of files hold each word at 1 and 300 times the files."""
    notice = "Project released under the MIT License."
    for times in (1, 300):
        w = spark.range(20 * times).selectExpr("id AS doc_id", "concat('p', id % 7, '/', id, '.txt') AS path",
                                               f"CASE WHEN id % 20 = 0 THEN '{notice}' WHEN id % 4 = 0 THEN 'the project is under way' ELSE 'other words' END AS text")
        got = S.scan(w).filter("method = 'header'").select("license").collect()
        assert len(got) == times and {r.license for r in got} == {"MIT"}


def test_anchors_lose_nothing():
    w = S.Weights(1000, {"the": 900, "under": 300, "license": 20})
    for _, v in w.templates:
        assert math.sqrt(sum(x * x for t, x in v.items() if t not in w.anchors)) < S.THRESHOLD


def test_empty(spark):
    assert S.scan(files(spark, [])).collect() == []
