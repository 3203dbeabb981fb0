import hashlib
import random
import re

from schedlens.llm import pii as P

from .helpers import awkward, clashing, docs, rows, sample

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if good(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


HARD = [
    "a@b.c._x@d.e a@b..c @x.y a.@b-.c x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 9.9.9.9.", "é\U0001f600 ü 10.0.0.1  12 a@bc.d",
    "4111 1111 1111 1111, 4111-1111-1111-1111 41111111 11111111 4111  1111 1111 1111 4111111111111112",
    "+1 (988) 555-2485 +49 30 123456 +1+2 +12 +1 2 +1 555 555 5555 5555 5", "1 " * 40 + "+4" + "1" * 30 + " 2." * 9,
    "a@b" + ".c" * 6000, "7" * 30_000, "1 2" * 9_000, "x" * 30_000 + "@y.de", "+1" + " " * 9_000 + "2", "1." * 9_000, "@" * 9_000,
]


def fuzz(n):
    rng = random.Random(5)
    signs = "0123456789+-() .@ab_%\né"
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_base_spans_match_the_patterns(spark):
    texts = HARD + fuzz(1500)
    pairs = awkward() + sample() + [(1000 + i, t) for i, t in enumerate(texts)]
    got = P.find_pii(clashing(docs(spark, pairs)).repartition(4)).collect()
    have = sorted(((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base)) for r in got), key=repr)
    assert have == sorted(((d, ",".join(base(t))) for d, t in pairs), key=repr)
    for r in got:
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.all}
        assert [(s.start, s.rank) for s in r.all] == sorted((s.start, s.rank) for s in r.all)


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    for r in P.op9_pii(spark, sf).collect():
        want = base(dict(sample())[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_added_spans(spark):
    filler = [(i, f"mail a{i}@example.com or tel +1 (555) 555-12{i:02d} from host 10.0.0.{i} card 4111 1111 1111 1111") for i in range(40)]
    more = [(100, "my password=e3b3ed3cc8548923d6 ok"), (101, "phone (988) 555-2485 now"), (102, "version 2.0 of the text, 300.1.1.1 and 12345678901234")]
    got = {r.doc_id: r for r in P.find_pii(docs(spark, filler + more)).collect()}
    assert [s.kind for s in got[100].all] == ["secret"] and [s.kind for s in got[101].all] == ["phone"]
    assert got[102].all == []


def test_redaction(spark):
    pairs = [(1, "é a@b.cd x +1 (555) 555-1234!"), (2, None), (3, ""), (4, "clean text"), (5, "+1 555 555 10.0.0.1")]
    out = {r.doc_id: r.text for r in P.redact(clashing(docs(spark, pairs))).collect()}
    assert out[1] == "é [EMAIL] x [PHONE]!" and out[2] is None and out[3] == "" and out[4] == "clean text"
    assert "10.0" not in out[5] and "555" not in out[5]


def test_long_secrets_are_covered_whole(spark):
    rng = random.Random(7)
    long = {n: "".join(rng.choice("abcdefXYZ0123456789+/_.-") for _ in range(n - 1)) + "7" for n in (199, 200, 201, 1000, 50_000)}
    filler = [(i, f"my password=e3b3ed3cc8548923d{i:03d} ok") for i in range(40)]
    pairs = filler + [(n, f"é the token={x} ends") for n, x in long.items()]
    pairs += [(2000, "password=alice@example.com"), (2001, "token=10.20.30.40"), (2002, f"token={'ab3/' * 100}+49 30 1234567890")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r["all"]] for r in P.find_pii(docs(spark, pairs)).collect()}
    clear = {r.doc_id: r.text for r in P.redact(docs(spark, pairs)).collect()}
    for n in long:
        assert ("secret", 6, 6 + len("token=") + n) in got[n] and all(a >= 6 and b <= 12 + n for _, a, b in got[n])
        assert clear[n] == "é the [SECRET] ends"
    assert got[1000] == [("secret", 6, 1012)] and len(got[50_000]) > 1  # the longest holds what looks like a phone number
    assert [x[0] for x in got[2000]] == ["email"] and [x[0] for x in got[2001]] == ["ip"]
    assert clear[2002] == "[SECRET]"


def test_empty(spark):
    assert P.find_pii(docs(spark, [])).collect() == [] and P.redact(docs(spark, [])).collect() == []


def test_em_finds_the_unreliable_labeler():
    rng = random.Random(3)
    patterns = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = tuple((y if rng.random() < q else 1 - y) * 1 for q in (0.95, 0.9, 0.85, 0.5))
        patterns[v] = patterns.get(v, 0) + 1
    prior, rel, post = P.em(patterns)
    assert abs(prior - 0.4) < 0.05
    assert all(a > 0.8 and b < 0.2 for a, b in rel[:3]) and abs(rel[3][0] - rel[3][1]) < 0.1
    assert post[1, 1, 1, 0] > 0.95 and post[0, 0, 0, 1] < 0.05


def test_starts_of_many_matches(spark):
    from pyspark.sql import functions as F

    n = 1500
    df = spark.createDataFrame([([i % 5 for i in range(n)],), ([],), ([3],)], "l array<int>")
    got = [r[0] for r in df.select(P._starts(F.col("l"))).collect()]
    assert got == [[sum(i % 5 for i in range(j)) for j in range(n)], [], [0]] and rows(df)
