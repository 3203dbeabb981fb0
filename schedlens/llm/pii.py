"""Personal data by weak supervision, in DataFrame and SQL functions only.

Spans. Four base kinds (email, ip, card, phone) are found with their exact patterns,
leftmost and non-overlapping per kind; offsets are code points, the end exclusive.
The patterns are written without loops over groups, so that very long runs cannot
exhaust the regex engine's stack: a separator between two signs of a run is first
replaced by one private sign of the same length. More candidates come from looser
patterns (national phone numbers, spelled-out addresses, national ids, account
numbers, keys and passwords) and from base matches that failed their check.

Votes. Four labelers vote 1, 0 or abstain (-1) on every candidate: its strict
*regex*, a *gazetteer* (top-level domains, card issuers, key names), *context* words
to the left, and its *structure* (checksum, ranges, digits). Expectation-maximisation
(Dawid-Skene with abstentions) over the table of vote patterns of all documents
estimates the labelers' reliabilities and each pattern's posterior.

Classifier. A logistic regression on span features (kind with digits, length, signs,
context and structure) is fitted to these posteriors. Both fits read one grouped table,
whose size is bounded by the number of feature and vote values, not by the documents.
A candidate scored 0.5 or more that overlaps no base span is added; base spans stay. A
secret is also added, whole, when base spans leave ``SECRET`` signs of its value or more:
a run of digits inside a long key does not release the rest of it.

Everything but that grouping is row-local: no shuffle of texts, no grouping of a
document's spans, so neither hot sources nor copies matter. A null or empty text has no
spans; null ids, repeated rows and extra columns pass through; no documents, no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.llm.common import stage, table, texts

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE = KINDS[:4]
HOLD = "\ue000"  # stands for a separator inside a run; its own occurrences become OTHER
OTHER = "\ue001"
LEFT, SECRET = 40, 6
EM_STEPS, FIT_STEPS, FIT_RATE, FIT_L2 = 30, 400, 1.0, 1e-3
VOTES = ("v_regex", "v_gazetteer", "v_context", "v_structure")

#: Loose candidates: kind -> (what a text must contain, pattern). Quantifiers are bounded, or possessive on one class of signs.
LOOSE = {
    "email": (r"(?i)[\[(]at[\])]| at [a-z0-9-]{1,40} dot ",
              r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[a-z0-9-]{1,60} ?(?:\[dot\]|\(dot\)| dot |\.) ?[a-z]{2,12}(?![a-z0-9])"),
    "phone": (r"[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}",
              r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": (r"(?i)passw|secret|token|api[_-]?key|AKIA",
               r"(?i)(?<![a-z0-9])(?:(?:password|passwd|secret|token|api[_-]?key) {0,2}[=:] {0,2}[\"']?[a-z0-9+/_.-]{6,}+|AKIA[0-9A-Z]{16}(?![a-z0-9]))"),
}

#: Words to the left that speak for (by kind) or against personal data.
CUES = {
    "email": r"e-?mail|contact|write|mailto|courriel|correo", "ip": r"\bip\b|address|host|server|client|adresse",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta", "phone": r"phone|tel|call|mobile|fax|telefon|appel",
    "ssn": r"ssn|social|security", "iban": r"iban|account|bank|konto|compte|cuenta",
    "secret": r"password|secret|token|key|login|credential",
}
AGAINST = r"version|release|section|isbn|issn|figure|chapter|doi|rfc"
DOMAINS = r"(?i)[. ](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it)$"


def _starts(lens: Column, block: int = 256) -> Column:
    """Running totals before each entry of an array of lengths, in blocks, so that
    thousands of matches in one text cost no quadratic copying."""
    zero = F.lit(0)
    none = F.array().cast("array<int>")

    def sums(part, start):
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")),
                           lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
                           lambda a: a["out"])

    blocks = F.transform(F.sequence(zero, F.greatest(zero, F.floor((F.size(lens) - 1) / block).cast("int"))),
                         lambda b: F.slice(lens, b * block + 1, block))
    totals = F.transform(blocks, lambda p: F.aggregate(p, zero, lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, sums(totals, zero), lambda p, at: sums(p, at)))


def _spans(kind: str, gaps: Column, found: Column, at: Column) -> Column:
    """Matches with their offsets and what stands to the left of each."""
    return F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m"), at.alias("at")), lambda x: F.struct(
        F.lit(kind).alias("kind"), (x["at"] + F.length(x["g"])).alias("start"),
        (x["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
        F.replace(x["m"], F.lit(HOLD), F.lit("." if kind == "email" else " ")).alias("m"),
        F.lower(F.right(x["g"], F.lit(LEFT))).alias("left")))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets_valid(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3)
                    & (F.coalesce(F.when(F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3,
                                         F.regexp_replace(p, "^0+(?=[0-9])", "").cast("int")), F.lit(999)) <= 255))


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(_digits(m))
    card = F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", _octets_valid(m))
            .when(kind == "card", card).otherwise(n.between(10, 15)))


def _searches() -> list[tuple[str, str, Column, str]]:
    """(kind, column searched, what a text must contain, pattern); the base kinds first."""
    text = F.col("__text")
    word, local = "[A-Za-z0-9-]", f"[A-Za-z0-9._%+{HOLD}-]"
    base = [
        ("email", "__dotted", F.contains(text, F.lit("@")), rf"(?:(?<!{local})|\G){local}++@{word}++{HOLD}[A-Za-z0-9{HOLD}-]++"),
        ("ip", "__text", F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        ("card", "__joined", F.rlike(text, F.lit("(?:[0-9][ -]?){13}[0-9]")), f"[0-9][0-9{HOLD}]++"),
        ("phone", "__text", F.rlike(text, F.lit(r"\+[0-9]")), r"\+[0-9][ ().0-9-]+[0-9]"),
    ]
    return base + [(k, "__text", F.rlike(text, F.lit(needs)), p) for k, (needs, p) in LOOSE.items()]


def with_candidates(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with array<struct<kind, start, end, m, left, base>> of ``text`` as column
    ``name``. Each search runs once a text: later projections refer to its columns."""
    own = [F.col(f"`{c}`") for c in df.columns]
    clean = F.replace(F.col("__text"), F.lit(HOLD), F.lit(OTHER))
    searches, none = _searches(), F.array().cast("array<string>")
    out = df.select(*own, F.coalesce(text, F.lit("")).alias("__text"))
    out = out.select("*", *[needs.alias(f"__n{i}") for i, (_, _, needs, _) in enumerate(searches)])
    out = out.select(
        "*", F.when(F.col("__n0"), F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", HOLD)).alias("__dotted"),
        F.when(F.col("__n2"), F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", HOLD)).alias("__joined"))

    def search(i, group):
        whole = F.lit(rf"\G([\s\S]*?)({searches[i][3]})")
        return F.when(F.col(f"__n{i}"), F.regexp_extract_all(F.col(searches[i][1]), whole, F.lit(group))).otherwise(none)

    every = range(len(searches))
    out = out.select(*own, *[search(i, 1).alias(f"__g{i}") for i in every], *[search(i, 2).alias(f"__m{i}") for i in every])
    out = out.select("*", *[F.zip_with(f"__g{i}", f"__m{i}", lambda g, m: F.length(g) + F.length(m)).alias(f"__l{i}") for i in every])
    out = out.select("*", *[_starts(F.col(f"__l{i}")).alias(f"__s{i}") for i in every])
    found = [_spans(searches[i][0], F.col(f"__g{i}"), F.col(f"__m{i}"), F.col(f"__s{i}")) for i in every]

    def checked(i, kind):
        return F.transform(found[i], lambda x: x.withField("base", _valid(F.lit(kind), x["m"]) if i < len(BASE) else F.lit(False)))

    found = [checked(i, searches[i][0]) for i in every]
    # most digit runs are numbers of no interest: of the failed ones those of a card's length stay
    found[2] = F.filter(found[2], lambda x: x["base"] | F.length(_digits(x["m"])).between(14, 19))
    return out.select(*own, F.concat(*found).alias(name))


def _vote(cond: Column, against: Column | None = None) -> Column:
    """1 where cond, 0 where against (or, without it, everywhere else), -1 otherwise."""
    return F.when(cond, 1).when(F.lit(True) if against is None else against, 0).otherwise(-1)


def _features(c) -> Column:
    kind, m, left = c["kind"], c["m"], c["left"]
    digits = F.length(_digits(m))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, F.rlike(left, F.lit(words))).otherwise(cue)
    against = F.rlike(left, F.lit(AGAINST))
    structure = (F.when(kind == "email", F.rlike(m, F.lit("(?i)[a-z].*[a-z]")))
                 .when(kind == "ip", _valid(F.lit("ip"), m) & ~F.rlike(m, F.lit(r"^0*\.")))
                 .when(kind == "card", _valid(F.lit("card"), m))
                 .when(kind == "phone", digits.between(10, 15) & ~F.rlike(m, F.lit(r"^\(?[01]")))
                 .when(kind == "ssn", ~F.rlike(m, F.lit("^(?:000|666|9)|-00-|-0000$")))
                 .when(kind == "iban", F.length(F.replace(m, F.lit(" "))).between(15, 34) & (digits >= 8))
                 .otherwise((digits >= 2) & (F.length(m) >= 12)))
    gazetteer = (F.when(kind == "email", _vote(F.rlike(m, F.lit(DOMAINS))))
                 .when(kind == "card", _vote(F.rlike(m, F.lit("^[3-6]"))))
                 .when(kind == "secret", _vote(F.rlike(m, F.lit(r"(?i)^(?:password|passwd|secret|token|api.?key|AKIA)"))))
                 .otherwise(-1))
    strict = _vote(c["base"] | ~kind.isin(*BASE) | (kind == "phone") & ~F.startswith(m, F.lit("+")),
                   kind.isin("ip", "card", "phone"))
    size = F.length(m)
    return F.struct(
        kind.alias("kind"),
        F.when(digits == 0, "0").when(digits < 7, "1-6").when(digits < 10, "7-9").when(digits < 16, "10-15").otherwise("16+").alias("digits"),
        F.when(size < 10, "s").when(size < 20, "m").when(size < 40, "l").otherwise("x").alias("size"),
        F.when(F.rlike(m, F.lit("[A-Za-z]")), F.when(digits > 0, "both").otherwise("letters"))
        .when(F.rlike(m, F.lit("[^0-9]")), "signs").otherwise("digits").alias("signs"),
        F.when(cue, "for").when(against, "against").otherwise("none").alias("cue"),
        F.when(structure, "ok").otherwise("bad").alias("structure"),
        strict.alias("v_regex"), gazetteer.alias("v_gazetteer"),
        _vote(cue, against).alias("v_context"), _vote(structure).alias("v_structure"))


PAIRS = ("digits", "size", "signs", "cue", "structure")


def em(patterns: dict[tuple[int, ...], int], steps: int = EM_STEPS) -> tuple[float, list[tuple[float, float]], dict]:
    """Prior, per labeler (P(1 | personal), P(1 | not)), and each pattern's posterior."""
    prior, rel = 0.5, [(0.8, 0.2)] * len(VOTES)
    post = {}
    for _ in range(steps):
        for v in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for x, (a, b) in zip(v, rel):
                if x >= 0:
                    yes += math.log(a if x else 1 - a)
                    no += math.log(b if x else 1 - b)
            post[v] = 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
        total, ones = sum(patterns.values()), sum(n * post[v] for v, n in patterns.items())
        prior = (ones + 1) / (total + 2) if total else 0.5
        rel = []
        for i in range(len(VOTES)):
            said = [(v[i], n, post[v]) for v, n in patterns.items() if v[i] >= 0]
            p, q = sum(n * w for _, n, w in said), sum(n * (1 - w) for _, n, w in said)
            # a labeler is taken to be better than chance: 4 + 1 votes of prior belief
            rel.append(((sum(n * w for x, n, w in said if x) + 4) / (p + 5), (sum(n * (1 - w) for x, n, w in said if x) + 1) / (q + 5)))
    return prior, rel, post


def fit(rows: list[tuple[list[str], float, float]]) -> dict[str, float]:
    """Logistic regression on one-hot features; rows are (features, weight, soft label)."""
    w = {"": 0.0} | {f: 0.0 for fs, _, _ in rows for f in fs}
    total = sum(n for _, n, _ in rows)
    for _ in range(FIT_STEPS if total else 0):
        grad = dict.fromkeys(w, 0.0)
        for fs, n, y in rows:
            g = n / total * (1 / (1 + math.exp(-max(-60.0, min(60.0, w[""] + sum(w[f] for f in fs))))) - y)
            grad[""] += g
            for f in fs:
                grad[f] += g
        for f in w:
            w[f] -= FIT_RATE * (4 * grad[f] + FIT_L2 * w[f])
    return w


def train(found: DataFrame, column: str = "found") -> dict[str, float]:
    """Weights of the span classifier, from the candidates of all documents."""
    names = ["kind", *PAIRS, *VOTES]
    grouped = (found.select(F.explode(column).alias("c")).select(_features(F.col("c")).alias("f")).select("f.*")
               .groupBy(*names).agg(F.count("*").alias("n")).collect())  # feature and vote values, not documents
    patterns: dict[tuple[int, ...], int] = {}
    for r in grouped:
        v = tuple(r[x] for x in VOTES)
        patterns[v] = patterns.get(v, 0) + r.n
    _, _, post = em(patterns)
    return fit(sorted(([f"{r.kind}|{p}|{r[p]}" for p in PAIRS], float(r.n), post[tuple(r[x] for x in VOTES)]) for r in grouped))


def _score(c, weights: dict[str, float]) -> Column:
    table_ = F.create_map(*[F.lit(x) for f, w in sorted(weights.items()) for x in (f, w)])
    f = _features(c)
    total = F.lit(weights.get("", 0.0))
    for p in PAIRS:
        total = total + F.coalesce(F.try_element_at(table_, F.concat_ws("|", f["kind"], F.lit(p), f[p])), F.lit(0.0))
    return total


def with_spans(found: DataFrame, weights: dict[str, float], column: str = "found") -> DataFrame:
    """``found`` with its candidates replaced by ``base`` and ``added`` spans, sorted."""
    own = [F.col(f"`{c}`") for c in found.columns if c != column]
    out = found.select(*own, F.filter(column, lambda c: c["base"]).alias("__base"),
                       F.filter(column, lambda c: ~c["base"] & (_score(c, weights) >= 0)).alias("__more"))

    def free(c):
        value = c["end"] - F.length(F.regexp_replace(c["m"], "^[^=:]*[=:] {0,2}[\"']?", ""))
        covered = F.aggregate("__base", F.lit(0), lambda n, b: n + F.greatest(
            F.lit(0), F.least(b["end"], c["end"]) - F.greatest(b["start"], value)))
        alone = ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return alone | (c["kind"] == "secret") & (c["end"] - value - covered >= SECRET)

    out = out.select(*own, "__base", F.filter("__more", free).alias("__more"))
    return out.select(*own, _sorted(F.col("__base")).alias("__base"), _sorted(F.concat("__base", "__more")).alias("__all"))


def _sorted(spans_: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    return F.array_distinct(F.array_sort(F.transform(spans_, lambda c: F.struct(
        c["start"].alias("start"), F.element_at(rank, c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))))


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all: sorted arrays of (start, rank, end, kind). The candidates are
    stored once (without the texts); training and scoring read that table."""
    found = stage(with_candidates(texts(docs, id_col, text_col), F.col("text"), "found").select("doc_id", "found"), "pii-candidates")
    return with_spans(found, train(found)).select("doc_id", F.col("__base").alias("base"), F.col("__all").alias("all"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans
    become one, under the first one's kind. A null text stays null."""
    text = F.col(f"`{text_col}`")
    weights = train(stage(with_candidates(docs.select(text.alias("text")), F.col("text"), "found").select("found"), "pii-candidates"))
    rows = with_spans(with_candidates(docs, text, "__found"), weights, "__found")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        piece = F.concat(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    def end(a):
        return F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text)))

    clear = F.when(F.size("__all") > 0, F.aggregate("__all", start, step, end)).otherwise(text)
    return rows.select(*[clear.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
