"""License scan: sparse TF-IDF cosine to templates, then inheritance along paths.

Only DataFrame and SQL functions run. Terms are runs of a-z and 0-9 after lower-casing.
The document frequency of every term is counted over all files. Every file is cut into
sentences (at line ends and after . ; ! ?). For each template a sentence gives windows of
the template's number of terms: at every term that the template has, and the last one; a
sentence that is not longer is one window. A window, and the whole of a file of any length,
is a sparse vector of term count times inverse document frequency, and its cosine to the
template decides; at ``THRESHOLD`` or more it is that license's notice, the best template
(of equal ones the first by name) wins.

Sentences without an *anchor* are skipped without loss: anchors are chosen, from the
weights, so that the other terms of any template carry too little of its norm for a
cosine of ``THRESHOLD`` (Cauchy-Schwarz). A template is tried on a sentence only if the
terms they share carry enough of its norm, and a window is kept only if its cosine could
reach the threshold with every term outside the templates at the least possible weight, 1.
Only what is kept has those terms joined to their frequencies: distinct terms first, then
salted.

A file that is nothing but a notice, or is named like a license file, speaks for its
directory. A file without a notice of its own inherits from the nearest ancestor
directory that has such a file: the distinct directories are expanded to their
ancestors and joined by path; files then join their directory, salted, because one
directory may hold a third of all files.

Defined results: null or empty texts have no notice but may inherit; a null path is the
root directory; long texts are read whole. Null ids and repeated rows pass through, one row
each; of equal cosines the first name wins. Other columns, whatever their names, are not
read. No files, no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.llm.common import stage, table

THRESHOLD = 0.6
SALTS = 32
FILE_NAMES = r"(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[.-].*)?$"

#: Short notices of common licenses (fixed values).
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License version 3",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
                   "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license",
                     "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License version 2.1"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License version 3"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


class Weights:
    """Inverse document frequencies and unit template vectors over the template terms."""

    def __init__(self, files: int, df: dict[str, int], templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        rows = sorted((name, terms_of(t)) for name, ts in templates.items() for t in ts)
        self.vocabulary = sorted({t for _, ts in rows for t in ts})
        self.files = files
        self.idf = {t: math.log((1 + files) / (1 + df.get(t, 0))) + 1 for t in self.vocabulary}
        self.templates = []
        self.sizes = [len(ts) for _, ts in rows]
        for name, ts in rows:
            v = {t: ts.count(t) * self.idf[t] for t in ts}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.templates.append((name, {t: x / norm for t, x in v.items()}))
        self.anchors: list[str] = []
        for t in sorted(self.vocabulary, key=lambda t: (-self.idf[t], t)):
            if all(self._rest(v) < threshold for _, v in self.templates):
                break
            # only terms of templates that are still open
            if any(t in v and self._rest(v) >= threshold for _, v in self.templates):
                self.anchors.append(t)

    def _rest(self, v: dict[str, float]) -> float:
        """Norm of a unit template without the anchors."""
        return math.sqrt(sum(x * x for t, x in v.items() if t not in self.anchors)) + 1e-9

    def literal(self) -> Column:
        """The templates as one constant array; ``at`` is a term's place in the vocabulary."""
        return F.array(*[F.struct(F.lit(name).alias("license"), F.lit(n).alias("n"), F.array(*[F.struct(
            F.lit(self.vocabulary.index(t)).alias("at"), F.lit(t).alias("term"), F.lit(x).alias("w"), F.lit(x * self.idf[t]).alias("part"))
            for t, x in sorted(v.items())]).alias("terms")) for (name, v), n in zip(self.templates, self.sizes)])


def document_frequencies(files: DataFrame) -> DataFrame:
    """(term, n): the files that hold each term, over whole texts; counted before the shuffle."""
    return files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _known(terms: Column, w: Weights) -> Column:
    return F.filter(terms, lambda t: t.isin(w.vocabulary))


def _scored(terms: Column, w: Weights, templates: Column) -> Column:
    """array<struct<license, dot, square>>: the templates whose cosine to the terms can reach the
    threshold. ``square`` is the norm's share of the template vocabulary; the other terms weigh
    at least 1 each."""
    idf = F.array(*[F.lit(w.idf[t]) for t in w.vocabulary])

    def of_counts(counts):
        square = F.aggregate(F.zip_with(counts, idf, lambda c, x: c * x * c * x), F.lit(0.0), lambda a, x: a + x)
        least = F.size(terms) - F.aggregate(counts, F.lit(0), lambda a, x: a + x)

        def of_square(sq):
            dots = F.transform(templates, lambda t: F.struct(t["license"].alias("license"), F.aggregate(
                t["terms"], F.lit(0.0), lambda a, x: a + F.get(counts, x["at"]) * x["part"]).alias("dot"), sq.alias("square")))
            return F.filter(dots, lambda d: (d["dot"] > 0) & (d["dot"] >= (THRESHOLD - 1e-6) * F.sqrt(sq + least)))

        return _let(square, of_square)

    counts = _let(_known(terms, w), lambda k: F.transform(F.array(*map(F.lit, w.vocabulary)), lambda v: F.size(F.filter(k, lambda x: x == v))))
    return _let(counts, of_counts)


def _sentences(text: Column, w: Weights) -> Column:
    """Terms of every sentence that holds an anchor."""
    anchors = F.array(*map(F.lit, w.anchors))
    return F.filter(F.transform(F.split(text, r"\n|(?<=[.;!?])\s"), _terms), lambda t: F.arrays_overlap(t, anchors))


def _open_templates(terms: Column, w: Weights) -> Column:
    """Templates of whose norm the shared terms carry enough."""
    def shared(known):
        return F.filter(w.literal(), lambda t: F.aggregate(t["terms"], F.lit(0.0), lambda a, x: a + F.when(
            F.array_contains(known, x["term"]), x["w"] * x["w"]).otherwise(0.0)) >= THRESHOLD * THRESHOLD - 1e-6)

    return _let(F.array_distinct(_known(terms, w)), shared)


def _starts(terms: Column, template: Column) -> Column:
    last = F.greatest(F.size(terms) - template["n"], F.lit(0)) + 1
    names = F.transform(template["terms"], lambda x: x["term"])
    return F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.array_contains(names, F.element_at(terms, i)))


def own_notices(files: DataFrame, frequencies: DataFrame, w: Weights) -> DataFrame:
    """(doc_id, path, dir, n_notices, own, named, whole): best notice of a file's sentences and
    of its whole text, as struct<cosine, license>; n_notices sentences hold one."""
    some = F.rlike(F.lower("text"), F.lit("(?:^|[^a-z0-9])(?:" + "|".join(w.anchors) + ")(?:[^a-z0-9]|$)"))
    rows = stage(files.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "path", F.when(some, F.col("text")).alias("text")), "license-files")
    texts = rows.filter("text is not null")
    pieces = texts.select("rid", F.posexplode(_sentences(F.col("text"), w)).alias("piece", "ts"))
    tried = pieces.select("rid", "piece", "ts", F.explode(_open_templates(F.col("ts"), w)).alias("t"))
    windows = tried.select("rid", "piece", "t", F.explode(F.transform(
        _starts(F.col("ts"), F.col("t")), lambda i: F.slice("ts", i, F.col("t.n")))).alias("ts"))
    windows = windows.select("rid", "piece", "ts", F.explode(_scored(F.col("ts"), w, F.array("t"))).alias("c"))
    wholes = texts.select("rid", F.lit(-1).alias("piece"), _terms(F.col("text")).alias("ts"))
    wholes = wholes.select("rid", "piece", "ts", F.explode(_scored(F.col("ts"), w, w.literal())).alias("c"))
    kept = windows.unionByName(wholes).select(F.monotonically_increasing_id().alias("cid"), "rid", "piece", "c.*",
                                              F.filter("ts", lambda t: ~t.isin(w.vocabulary)).alias("others"))
    kept = stage(kept, "license-candidates")
    others = kept.select("cid", F.explode("others").alias("term")).groupBy("cid", "term").agg(F.count("*").alias("tf"))
    needed = others.select("term").distinct().join(frequencies, "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    weight = F.col("tf") * (F.log((1 + w.files) / (1 + F.col("n"))) + 1)
    extra = (others.withColumn("salt", F.pmod("cid", F.lit(SALTS)).cast("int")).join(needed, ["term", "salt"])
             .groupBy("cid").agg(F.sum(weight * weight).alias("extra")))
    cosine = F.round(F.col("dot") / F.sqrt(F.col("square") + F.coalesce("extra", F.lit(0.0))), 9)
    hits = kept.join(extra, "cid", "left").select("rid", "piece", F.struct((-cosine).alias("c"), "license").alias("hit")).filter(F.col("hit.c") <= -THRESHOLD)
    hits = hits.groupBy("rid", "piece").agg(F.min("hit").alias("hit")).groupBy("rid").agg(
        F.count_if(F.col("piece") >= 0).cast("int").alias("n"), F.min(F.when(F.col("piece") >= 0, F.col("hit"))).alias("own"),
        F.min(F.when(F.col("piece") < 0, F.col("hit"))).alias("whole"))

    def note(c):
        return F.when(F.col(c).isNotNull(), F.struct((-F.col(f"{c}.c")).alias("cosine"), F.col(f"{c}.license").alias("license"))).alias(c)

    return rows.drop("text").join(hits, "rid", "left").select(
        "doc_id", "path", F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/+$", "").alias("dir"),
        F.coalesce("n", F.lit(0)).alias("n_notices"), note("own"),
        F.coalesce(F.rlike(F.regexp_extract("path", "([^/]*)$", 1), F.lit(FILE_NAMES)), F.lit(False)).alias("named"), note("whole"))


def _ancestors(path: Column) -> Column:
    """The directory and all above it, the root ('') last; depth is the number of parts."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.struct(
        n.alias("depth"), F.when(n > 0, F.array_join(F.slice(parts, 1, n), "/")).otherwise("").alias("above")))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per file: doc_id, path, license (own or inherited, null when none), score,
    n_notices and method (header, inherited or none); from_dir says where it came from."""
    rows = files.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    frequencies = stage(document_frequencies(rows), "license-terms")
    known = sorted({t for ts in TEMPLATES.values() for x in ts for t in terms_of(x)})
    df = {r.term: r.n for r in frequencies.filter(F.col("term").isin(known)).collect()}  # at most the template terms
    notes = stage(own_notices(rows, frequencies, Weights(rows.count(), df)), "license-notices")
    speaks = notes.select("dir", F.when(F.col("named"), F.coalesce("own", "whole")).otherwise(F.col("whole")).alias("note")).filter("note is not null")
    # the best notice of a directory; of equal ones the first name
    per_dir = (speaks.groupBy("dir", "note").agg(F.count("*").alias("n")).groupBy("dir")
               .agg(F.min(F.struct((-F.col("note.cosine")).alias("c"), F.col("note.license").alias("license"))).alias("m"))
               .select(F.col("dir").alias("above"), F.col("m.license").alias("license"), (-F.col("m.c")).alias("score")))
    dirs = notes.filter("own is null").groupBy("dir").agg(F.count("*").alias("n")).select("dir", F.explode(_ancestors(F.col("dir"))).alias("a"))
    near = (dirs.select("dir", "a.depth", "a.above").join(per_dir, "above").groupBy("dir")
            .agg(F.max(F.struct("depth", "above", "license", "score")).alias("m")))
    near = stage(near.select("dir", F.col("m.license").alias("in_license"), F.col("m.score").alias("in_score"), F.col("m.above").alias("from_dir")),
                 "license-directories")
    salted = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # only files without a notice need the join
    left = notes.filter("own is null").withColumn("salt", F.pmod(F.xxhash64("path", "doc_id"), F.lit(SALTS)).cast("int"))
    inherited = left.join(salted, ["dir", "salt"], "left").select(
        "doc_id", "path", F.col("in_license").alias("license"), F.col("in_score").alias("score"), "n_notices",
        F.when(F.col("in_license").isNull(), "none").otherwise("inherited").alias("method"), "from_dir")
    own = notes.filter("own is not null").select("doc_id", "path", F.col("own.license").alias("license"), F.col("own.cosine").alias("score"),
                                                 "n_notices", F.lit("header").alias("method"), F.lit(None).cast("string").alias("from_dir"))
    return own.unionByName(inherited)


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source / language / thousand / id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("xx")),
                       F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none")),
                       F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(table(spark, sf_dir, "documents")))


def _oracle() -> str:
    """The scan of the documents in SQL: every window is scored, without anchors or bounds."""
    def q(text):
        return "'" + text.replace("'", "''") + "'"

    rows = ", ".join(f"({i}, {q(n)}, {q(t)})" for i, (n, t) in enumerate(sorted((n, t) for n, ts in TEMPLATES.items() for t in ts)))
    terms = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    return rf"""
WITH files AS (SELECT doc_id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'xx'), coalesce(CAST(doc_id // 1000 AS VARCHAR), 'none'),
    concat(coalesce(CAST(doc_id AS VARCHAR), 'none'), '.txt')) AS path, coalesce(text, '') AS text FROM documents),
paths AS (SELECT doc_id, path, text, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
n AS (SELECT count(*) AS n FROM files),
template(t, license, body) AS (VALUES {rows}),
words AS (SELECT t, term, count(*) AS tf FROM (SELECT t, unnest({terms.format("body")}) AS term FROM template) GROUP BY t, term),
df AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({terms.format("text")})) AS term FROM files) GROUP BY term),
known AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + coalesce(df.n, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM words) LEFT JOIN df USING (term)),
vectors AS (SELECT t, term, idf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM words JOIN known USING (term)),
lists AS (SELECT t, list(term) AS names, CAST(sum(tf) AS BIGINT) AS m FROM words GROUP BY t),
pieces AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.;!?])[ \t\n\x0B\f\r]', '\1' || chr(10), 'g'), chr(10))) AS piece FROM files),
parts AS (SELECT row_number() OVER () AS p, doc_id, {terms.format("piece")} AS ts FROM pieces),
cuts AS (SELECT p, doc_id, t, ts[i : i + m - 1] AS ts FROM (SELECT p, doc_id, t, m, names, ts, greatest(len(ts) - m, 0) + 1 AS last,
  unnest(range(1, greatest(len(ts) - m, 0) + 2)) AS i FROM parts, lists WHERE list_has_any(ts, names)) WHERE i = last OR list_contains(names, ts[i])),
segments AS (SELECT row_number() OVER () AS s, p, doc_id, FALSE AS whole, t AS mine, ts FROM cuts
  UNION ALL SELECT -1 - row_number() OVER (), NULL, doc_id, TRUE, NULL, {terms.format("text")} FROM files),
counts AS (SELECT s, mine, term, count(*) AS tf FROM (SELECT s, mine, unnest(ts) AS term FROM segments) GROUP BY s, mine, term),
weighed AS (SELECT s, mine, term, tf, ln((1 + (SELECT n FROM n)) / (1 + df.n)) + 1 AS idf FROM counts JOIN df USING (term)),
norms AS (SELECT s, sqrt(sum(tf * idf * tf * idf)) AS norm FROM weighed GROUP BY s),
dots AS (SELECT s, t, sum(tf * weighed.idf * w) AS dot FROM weighed JOIN vectors USING (term) WHERE mine IS NULL OR mine = t GROUP BY s, t),
hits AS (SELECT s, min((-round(dot / norm, 9), license)) AS hit FROM dots JOIN norms USING (s) JOIN template USING (t)
  WHERE round(dot / norm, 9) >= {THRESHOLD} GROUP BY s),
found AS (SELECT doc_id, whole, p, hit FROM segments JOIN hits USING (s)),
own AS (SELECT doc_id, min(hit) AS hit, count(DISTINCT p) AS n_notices FROM found WHERE NOT whole GROUP BY doc_id),
per_dir AS (SELECT dir, min(hit) AS hit FROM found JOIN paths USING (doc_id) WHERE whole GROUP BY dir),
above AS (SELECT dir, d AS depth, array_to_string(string_split(dir, '/')[1:d], '/') AS above
  FROM (SELECT DISTINCT dir, unnest(range(len(string_split(dir, '/')) + 1)) AS d FROM paths)),
near AS (SELECT a.dir, a.above AS from_dir, p.hit FROM above a JOIN per_dir p ON p.dir = a.above
  QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY depth DESC) = 1)
SELECT doc_id, path, CASE WHEN own.hit IS NOT NULL THEN own.hit[2] ELSE near.hit[2] END AS license,
  CASE WHEN own.hit IS NOT NULL THEN -own.hit[1] ELSE -near.hit[1] END AS score, CAST(coalesce(n_notices, 0) AS INTEGER) AS n_notices,
  CASE WHEN own.hit IS NOT NULL THEN 'header' WHEN near.hit IS NOT NULL THEN 'inherited' ELSE 'none' END AS method,
  CASE WHEN own.hit IS NULL THEN from_dir END AS from_dir
FROM paths LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)
"""


ORACLE = _oracle()
