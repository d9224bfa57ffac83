"""Licence scans: sparse TF-IDF cosine of headers and licence files to licence templates, then inheritance along directories.

All steps are column expressions, joins and aggregates. What is compared are the parts of a text: its lines, sentences and paragraphs (a header
is a paragraph, with or without comment marks) and the whole text. Document frequencies of all terms come from all texts. Parts without
an anchor term are not scored: the rarest terms of a template without which, by the Cauchy-Schwarz inequality, no part
reaches the threshold. By the same inequality the terms of a whole text must hold enough of one template's weight, else no part of it is scored.
Of the parts those are scored whose cosine can reach the threshold if every term that no template has is as common as can be. Equal parts are scored once. A file without a licence of its own gets the licence of the nearest
directory above it that holds a licence file.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import text_key, text_or_empty
from harrow.operators.lookup import lookup_join
from harrow.runtime import stabilise

# Titles, notices, headers and texts as the licences word them
NOTICES = {
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007", "GNU Affero General Public License"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "BSD 3-Clause License",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0", "Creative Commons Attribution 4.0 International",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related rights CC0 1.0 public domain",
        "Creative Commons CC0 1.0 Universal",
    ],
    "GPL-2.0": [
        "GNU General Public License Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": [
        "Released under the MIT License", "The MIT License (MIT)", "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": ["All rights reserved"],
}
# Tags that stand for these licences behind SPDX-License-Identifier
TAGS = {
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"], "BSD-3-Clause": ["BSD-3-Clause"], "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC0-1.0": ["CC0-1.0"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "ISC": ["ISC"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"],
}
# Speaks only where no other licence does: many licence texts open with it
WEAKEST = "proprietary"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
# A tag and its mark are one term
MARK, MARKED = r"spdx-license-identifier:[ \t]*", "spdx-license-identifier-"
SENTENCE = r"\n|[.;][ \t]+"
PARAGRAPH = r"\n[^a-z0-9\n]*\n"
THRESHOLD = 0.75
# Scores have six digits, so one below the threshold by less than this may be rounded up to it
ROUNDING = 1e-6
# A file of at most so many words that has a licence is a licence file, if no other mark says so
LICENCE_FILE_WORDS = 25


def template_texts() -> list[tuple[str, str]]:
    """(licence, text) of every template."""
    notices = [(name, text) for name, texts in NOTICES.items() for text in texts]
    return notices + [(name, f"SPDX-License-Identifier: {tag}") for name, tags in TAGS.items() for tag in tags]


def _tokens(text: str) -> list[str]:
    return re.findall(TOKEN, re.sub(MARK, MARKED, text.lower()))


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), MARK, MARKED)


def tokens(text: Column) -> Column:
    """Terms of a folded text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def document_counts(files: DataFrame, text: str = "text") -> DataFrame:
    """(``term``, ``n``): in how many texts each term occurs; the empty term is in all. Counted in the tasks before the shuffle."""
    terms = F.concat(F.array(F.lit("")), F.array_distinct(tokens(folded(text_or_empty(text)))))
    return files.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def template_weights(counts: DataFrame) -> tuple[dict[str, float], int]:
    """Inverse document frequency of the templates' terms, and the number of texts."""
    vocabulary = sorted({t for _, text in template_texts() for t in _tokens(text)})
    known = {r["term"]: r["n"] for r in counts.where(F.col("term").isin(["", *vocabulary])).collect()}  # at most a row for each term of the templates
    n = known.get("", 0)
    return {t: math.log((n + 1) / (known.get(t, 0) + 1)) + 1 for t in vocabulary}, n


def template_vectors(idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """Licence and unit vector of each template."""
    out = []
    for name, text in template_texts():
        own: dict[str, float] = {}
        for token in _tokens(text):
            own[token] = own.get(token, 0.0) + idf[token]
        norm = math.sqrt(sum(w * w for w in own.values()))
        out.append((name, {t: w / norm for t, w in own.items()}))
    return out


def anchors(vectors: list[tuple[str, dict[str, float]]], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a part has at least one if it reaches the threshold for some template: the rarest ones."""
    out = set()
    for _, own in vectors:
        rest = 1.0
        for term, weight in sorted(own.items(), key=lambda x: (-idf[x[0]], x[0])):
            if rest < (threshold - ROUNDING) ** 2:
                break
            out.add(term)
            rest -= weight * weight
    return sorted(out)


def _literal(value, kind: str) -> Column:
    """One literal for the planner, which reads it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def template_squares(vectors: list[tuple[str, dict[str, float]]]) -> Column:
    """Map from each term of the templates to its squared weight in every template."""
    rows = {t: [own.get(t, 0.0) ** 2 for _, own in vectors] for t in sorted({t for _, own in vectors for t in own})}
    return _literal(rows, "map<string,array<double>>")


def template_terms(vectors: list[tuple[str, dict[str, float]]], idf: dict[str, float]) -> Column:
    """For every template its terms, their inverse document frequencies and their weights."""
    return _literal([[{"term": t, "idf": idf[t], "weight": w} for t, w in own.items()] for _, own in vectors], "array<array<struct<term:string,idf:double,weight:double>>>")


def held_weights(terms: Column, squares: Column, templates: int) -> Column:
    """How much of each template's squared weight is on ``terms``."""
    return F.aggregate(
        F.array_intersect(terms, F.map_keys(squares)), F.array_repeat(F.lit(0.0), templates),
        lambda sums, term: F.zip_with(sums, squares[term], lambda a, b: a + b),
    )


def may_hold(terms: Column, squares: Column, templates: int, threshold: float) -> Column:
    """Whether ``terms`` hold so much of a template's weight that the cosine of some part of them can reach the threshold."""
    return F.array_max(held_weights(terms, squares, templates)) >= (threshold - ROUNDING) ** 2


def may_reach(terms: Column, squares: Column, templates: Column, count: int, threshold: float) -> Column:
    """Whether the cosine of ``terms`` themselves to one of the ``count`` templates can reach the threshold.

    The product with the template and its terms' share of the norm are known here. Every other term adds one to the
    square of the norm at least each time it occurs, as no inverse document frequency is less than one.
    """

    def add(sums: Column, own: Column) -> Column:
        times = F.size(terms) - F.size(F.array_remove(terms, own["term"]))
        weight = times * own["idf"]
        return F.struct((sums["dot"] + weight * own["weight"]).alias("dot"), (sums["square"] - times + weight * weight).alias("square"))

    def reach(template: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("dot"), F.size(terms).cast("double").alias("square"))
        return F.aggregate(template, zero, add, lambda sums: sums["dot"] >= (threshold - ROUNDING) * F.sqrt(sums["square"]))

    enough = F.zip_with(
        held_weights(terms, squares, count), templates, lambda held, template: (held >= (threshold - ROUNDING) ** 2) & reach(template)
    )
    return F.array_contains(enough, F.lit(True))


def parts(text: Column) -> Column:
    """Different lines, sentences and paragraphs of a folded text, and the text itself."""
    cuts = [F.split(text, "\n"), F.split(text, SENTENCE), F.split(text, PARAGRAPH), F.array(text)]
    return F.array_distinct(F.concat(*cuts))


def _best(licence: Column, score: Column) -> Column:
    return F.min(F.struct((licence == WEAKEST).alias("last"), (-score).alias("low"), licence.alias("licence")))


def licences(files: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(``text_id``, ``licence``, ``score``): the best match of each different text's parts, ties by name; texts without one have no row."""
    spark = files.sparkSession
    counts = stabilise(document_counts(files, text))
    idf, n = template_weights(counts)
    vectors = template_vectors(idf)
    postings = F.broadcast(spark.createDataFrame(
        [(t, k, name, w) for k, (name, own) in enumerate(vectors) for t, w in own.items()], "term string, template int, licence string, weight double"
    ))
    marks = F.array(*map(F.lit, anchors(vectors, idf, threshold)))
    squares, templates = template_squares(vectors), template_terms(vectors, idf)

    def may_match(part: Column) -> Column:
        # an array of one makes the terms of a part a variable, found once
        return F.exists(
            F.array(tokens(part)), lambda terms: F.arrays_overlap(terms, marks) & may_reach(terms, squares, templates, len(vectors), threshold)
        )

    held = files.select(text_key(text_or_empty(text)).alias("text_id"), folded(text_or_empty(text)).alias("content"))
    marked = held.where(F.arrays_overlap(tokens(F.col("content")), marks) & may_hold(tokens(F.col("content")), squares, len(vectors), threshold))
    found = marked.select("text_id", F.explode(F.filter(parts(F.col("content")), may_match)).alias("part"))
    found = stabilise(found.select("text_id", "part", text_key(F.col("part")).alias("part_id")))
    # one shuffle by part: its terms are then counted where it is. Keys are columns already: beside explode() they would be hashed once a term
    different = found.groupBy("part_id").agg(F.first("part").alias("part"))
    words = stabilise(
        different.select("part_id", F.explode(tokens(F.col("part"))).alias("term")).groupBy("part_id", "term").agg(F.count("*").alias("times"))
    )
    rarity = counts.select("term", (F.log((n + 1) / (F.col("n") + 1)) + 1).alias("idf"))
    weighed = lookup_join(words, rarity, "term", "inner").withColumn("w", F.col("times") * F.col("idf"))
    norm = weighed.groupBy("part_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = weighed.join(postings, "term").groupBy("part_id", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dot.join(norm, "part_id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    hits = scored.groupBy("part_id").agg(_best(F.col("licence"), F.col("score")).alias("b")).select("part_id", "b.licence", (-F.col("b.low")).alias("score"))
    matched = lookup_join(found.select("text_id", "part_id"), hits, "part_id", "inner")
    best = matched.groupBy("text_id").agg(_best(F.col("licence"), F.col("score")).alias("b"))
    return stabilise(best.select("text_id", "b.licence", (-F.col("b.low")).alias("score")))


def parent(path: Column) -> Column:
    """Directory of a path; the root is the empty text."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def scan(files: DataFrame, threshold: float = THRESHOLD, text: str = "text", is_licence_file: Column | None = None) -> DataFrame:
    """One row per row of ``files`` (``path`` and a text): ``path``, ``licence``, ``score``, ``origin`` and ``licence_dir``.

    ``origin`` is ``line`` for a match of the file's own text, ``directory`` for an inherited licence, else ``none``; the first file by
    score, path and licence speaks for a directory. A row is a file: rows of one path are judged each by its own text, repeated rows alike. A null path is
    the file of the root without a name; null and empty texts have no licence of their own. Of equal scores the first name wins;
    ``proprietary`` gives way to any other licence of the text. An empty table gives an empty one; other columns are not read.
    """
    named = F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike("^(licen[cs]e|copying|notice|unlicense)([.-].*)?$")
    small = F.size(F.regexp_extract_all(text_or_empty(text), F.lit(r"\S+"), F.lit(0))) <= LICENCE_FILE_WORDS
    files = files.withColumn("path", F.coalesce(F.col("path").cast("string"), F.lit("")))
    rows = files.select(
        "path", parent(F.col("path")).alias("dir"), (named | small if is_licence_file is None else is_licence_file).alias("speaks"),
        text_key(text_or_empty(text)).alias("text_id"),
    )
    matched = lookup_join(rows, licences(files, threshold, text), "text_id")
    spoken = (
        matched.filter(F.col("speaks") & F.col("licence").isNotNull()).groupBy(F.col("dir").alias("licence_dir"))
        .agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "path", "licence")).alias("given"))
    )
    # each directory once, however many files it has, with every directory above it
    above = F.transform(F.sequence(F.lit(0), F.size("steps")), lambda n: F.array_join(F.slice("steps", 1, n), "/"))
    dirs = rows.select(F.col("dir").alias("of_dir")).distinct().withColumn("steps", F.split("of_dir", "/"))
    nearest = (
        dirs.select("of_dir", F.explode(F.array_distinct(above)).alias("licence_dir"))
        .join(spoken, "licence_dir").groupBy("of_dir")
        .agg(F.max_by(F.struct("licence_dir", "given"), F.length("licence_dir")).alias("n"))
    )
    joined = matched.join(nearest, F.col("dir") == F.col("of_dir"), "left")
    has, gets = F.col("licence").isNotNull(), F.col("n").isNotNull()
    return joined.select(
        "path", F.coalesce("licence", "n.given.licence").alias("licence"), F.coalesce("score", "n.given.score").alias("score"),
        F.when(has, "line").when(gets, "directory").otherwise("none").alias("origin"),
        F.when(~has & gets, F.col("n.licence_dir")).alias("licence_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source / language / hundreds of the id / id."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("source", "lang")]
    hundreds = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("-"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return docs.select(F.concat_ws("/", *parts, hundreds, name).alias("path"), "text")


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` as SQL text; every part of every text is scored there."""
    templates = ", ".join("(%d, '%s', '%s')" % (k, name, text) for k, (name, text) in enumerate(template_texts()))
    return r"""
with f as (select doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(floor(doc_id / 100)::bigint::varchar, '-'), coalesce(doc_id::varchar, '-')) as path,
  coalesce(text, '') as text, regexp_replace(lower(coalesce(text, '')), 'MARK', 'TAG', 'g') as content, row_number() over () as id from documents),
t as (select k, licence, regexp_replace(lower(notice), 'MARK', 'TAG', 'g') as notice from (values TEMPLATES) as v(k, licence, notice)),
tt as (select k, licence, unnest(regexp_extract_all(notice, 'TOKEN')) as term from t),
df as (select term, count(*) as n from (select unnest(list_distinct(regexp_extract_all(content, 'TOKEN'))) as term from f) group by 1),
total as (select count(*) as n from f),
terms as (select term from df union select term from tt),
idf as (select term, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 as idf from terms left join df using (term), total),
tw as (select k, licence, term, count(*) * any_value(idf) as w from tt join idf using (term) group by 1, 2, 3),
tv as (select k, licence, term, w / sqrt(sum(w * w) over (partition by k)) as weight from tw),
p as (select id, unnest(list_distinct(list_concat(string_split(content, chr(10)), regexp_split_to_array(content, 'SENTENCE'), regexp_split_to_array(content, 'PARAGRAPH'), [content]))) as part from f),
u as (select part, row_number() over () as part_no from (select distinct part from p)),
w as (select part_no, term, count(*) * any_value(idf) as w from (select part_no, unnest(regexp_extract_all(part, 'TOKEN')) as term from u) join idf using (term) group by 1, 2),
nn as (select part_no, sqrt(sum(w * w)) as norm from w group by 1),
d as (select part_no, k, licence, sum(w * weight) as dot from w join tv using (term) group by 1, 2, 3),
s as (select id, licence, round(dot / norm, 6) as score from d join nn using (part_no) join u using (part_no) join p using (part)),
o as (select id, licence, score from (select *, row_number() over (partition by id order by licence = 'WEAKEST', score desc, licence) as r from s where score >= LIMIT) where r = 1),
m as (select f.path, regexp_extract(f.path, '^(.*)/[^/]*$', 1) as dir, len(regexp_extract_all(text, '\S+')) <= WORDS as speaks, licence, score from f left join o using (id)),
g as (select dir, licence, score from (select *, row_number() over (partition by dir order by score desc, path, licence) as r from m where speaks and licence is not null) where r = 1),
n as (select of_dir, dir as licence_dir, licence, score from (select a.dir as of_dir, g.*, row_number() over (partition by a.dir order by length(g.dir) desc) as r
  from (select distinct dir from m) a join g on a.dir = g.dir or starts_with(a.dir, g.dir || '/')) where r = 1)
select m.path, coalesce(m.licence, n.licence) as licence, coalesce(m.score, n.score) as score,
  case when m.licence is not null then 'line' when n.licence is not null then 'directory' else 'none' end as origin,
  case when m.licence is null then n.licence_dir end as licence_dir
from m left join n on m.dir = n.of_dir
""".replace("TEMPLATES", templates).replace("TOKEN", TOKEN).replace("MARK", MARK).replace("TAG", MARKED).replace("SENTENCE", SENTENCE).replace(
        "PARAGRAPH", PARAGRAPH).replace("LIMIT", str(threshold)).replace("WORDS", str(LICENCE_FILE_WORDS)).replace("WEAKEST", WEAKEST)
