"""Language profiles, line rules, licence lines, page text and the n-gram model on small fixtures."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harrow.llm import html_text, kneser_ney, language, license_scan, line_rules

ENGLISH = "the house and the garden are in the old town where they were with all of them that day "
GERMAN = "das haus und der garten sind in der alten stadt wo sie mit allen von ihnen an dem tag waren "


def test_languages_held_out_and_odd_rows(spark, odd_docs, no_docs):
    rows = [(k, (ENGLISH if k % 2 else GERMAN) * (1 + k % 3), "en" if k % 2 else "de") for k in range(60)]
    rows += [(100, None, "en"), (101, "1234 !!", "de"), (102, ENGLISH, None), (102, ENGLISH, None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 60:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0 < r.score <= 1
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (100, 101)} == {("und", 0.0)}
    assert {r.held_out for r in got} == {True, False}
    assert len(language.identify(odd_docs).collect()) == odd_docs.count()
    assert language.identify(no_docs).count() == 0 and language.keep_known(no_docs).columns == no_docs.columns
    assert language.keep_known(odd_docs).columns == odd_docs.columns


def test_profile_is_the_plain_count():
    grams, counts = language.count_grams(language.symbols("Abba, ab!"))
    plain = Counter()
    for word in ("abba", "ab"):
        padded = f"_{word}_"
        for n in (1, 2, 3):
            plain.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != "_")
    assert sorted(counts.tolist()) == sorted(plain.values()) and len(grams) == len(plain)


def _base(text):
    """Counts of the base rules by definition."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_base_counts(odd_docs, no_docs):
    got = line_rules.judge(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    want = Counter((r.doc_id, *_base(r.text)) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert line_rules.judge(no_docs).count() == 0
    assert line_rules.keep_good(odd_docs).columns == odd_docs.columns


def test_shared_lines_go_but_for_the_first(spark):
    body = [f"own line number {k} with a handful of words that nobody else has " + "abcdefghij"[k % 10] * k for k in range(30)]
    rows = [(k, f"Accept our   cookies now\n{body[k]}", "h1") for k in range(30)] + [(100 + k, "accept our cookies now\nplease " + str(k), "h1") for k in range(9)]
    rows += [(200 + k, "A good text that was copied very often, with enough words to be kept.\nAnd one more line.", "h2") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = line_rules.Limits(line_texts=5, min_words=5)
    got = {r.doc_id: r for r in line_rules.judge(docs, limits).collect()}
    assert got[0].kept and got[0].removed_words == 0 and got[1].removed_words == 4 and got[1].kept
    assert not any(got[100 + k].kept for k in range(9))
    assert all(got[200 + k].kept for k in range(40))  # exact copies count once
    cleaned = {r.doc_id: r.text for r in line_rules.keep_good(docs, limits).collect()}
    assert cleaned[5] == body[5] and cleaned[0].startswith("Accept")


def test_shared_lines_go_under_the_limits_in_use(spark):
    """Six texts of a host are too many, five are not, however large the host is."""
    def body(name):
        return " ".join(f"{name}x{i}" for i in range(20))

    rows = [(k, f"Accept our cookies now\n{body(f'w{k}')}", "small") for k in range(6)]
    rows += [(1000 + k, f"Accept our cookies now\n{body(f'v{k}')}" if k % 80 == 0 else body(f"v{k}"), "large") for k in range(400)]
    rows += [(2000 + k, f"Accept our cookies now\n{body(f'u{k}')}" if k % 60 == 0 else body(f"u{k}"), "other") for k in range(400)]
    rows += [(3000 + k, f"Accept our cookies now\n{body('same')}", "copies") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.removed_words for r in line_rules.judge(docs).collect()}
    gone = {*range(1, 6), *(2000 + k for k in range(60, 400, 60))}
    assert got == {k: 4 if k in gone else 0 for k, _, _ in rows}


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/x.py", "code " * 40), ("a/y.py", "code " * 40), ("z.py", "code " * 40), ("a/b/own.py", "All rights reserved.\n" + "code " * 40), (None, None), ("e", ""),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.origin, r.licence_dir) for r in license_scan.scan(files).collect()}
    assert got["a/b/c/x.py"] == ("Apache-2.0", "directory", "a/b") and got["a/y.py"] == ("MIT", "directory", "a")
    assert got["z.py"] == (None, "none", None) and got["a/b/own.py"] == ("proprietary", "line", None) and got[""][1] == "none"
    assert license_scan.scan(files.limit(0)).count() == 0


MIT_FILE = """MIT License

Copyright (c) 2019 Somebody Unknown. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL_HEADER = """#!/usr/bin/python
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
import os
"""
GPL_2_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Everyone is permitted to copy and distribute verbatim copies of this document.
"""
PLAIN = "plain words of a file and all of the rest, under any other name, with no more to say\n" * 9


@pytest.fixture(scope="module")
def licence_of(spark):
    """Licence of each text among many plain ones, all under one path."""

    def run(texts):
        rows = [("same/path", t) for t in texts] + [("p/q", f"{PLAIN}{k}") for k in range(80)]
        files = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit(1)).withColumn("text_id", F.lit("x"))
        found = license_scan.licences(files).withColumnRenamed("text_id", "key").collect()
        keys = {bytes(r.key): (r.licence, r.score) for r in found}
        return [keys.get(hashlib.sha256((t or "").encode()).digest(), (None, None))[0] for t in texts]

    return run


def test_files_headers_and_tags(licence_of):
    cases = {
        MIT_FILE: "MIT", MIT_FILE.split("\n", 2)[2]: "MIT", GPL_HEADER: "GPL-3.0", GPL_2_FILE: "GPL-2.0", GPL_2_FILE.replace("2, June 1991", "3, 29 June 2007"): "GPL-3.0",
        "x = 1\n// SPDX-License-Identifier: Apache-2.0\n" + PLAIN: "Apache-2.0", "# spdx-license-identifier:  GPL-2.0-or-later": "GPL-2.0",
        "# Copyright (c) 2020 Foo Inc. All rights reserved.": "proprietary", "and the of Released under the MIT License.": "MIT",
        PLAIN * 400 + "Mozilla Public License Version 2.0\n" + PLAIN * 400: "MPL-2.0", "All rights reserved.\nLicensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
        PLAIN: None, "the rights of all": None, "SPDX-License-Identifier: Unheard-1.0": None, "": None,
    }
    assert dict(zip(cases, licence_of(list(cases)))) == cases


def test_parts_with_too_many_other_words_are_not_listed(spark):
    vocabulary = sorted({t for _, text in license_scan.template_texts() for t in license_scan._tokens(text)})
    idf = {t: 1.0 + (k * 37 % 100) / 10 for k, t in enumerate(vocabulary)}
    vectors = license_scan.template_vectors(idf)
    rng = random.Random(3)
    texts = [(PLAIN * 40 + "MIT License").lower()]
    for _ in range(300):
        own = license_scan._tokens(rng.choice(license_scan.template_texts())[1])
        own = [t for t in own if rng.random() < 0.9] + [f"w{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        texts.append(" ".join(own))
    terms = license_scan.tokens(F.col("text"))
    may = license_scan.may_reach(terms, license_scan.template_squares(vectors), license_scan.template_terms(vectors, idf), len(vectors), 0.75)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", may.alias("may"))
    got = [(r.text, r.may) for r in frame.collect()]

    def best(text):
        """Largest cosine of the text when a word that no template has weighs one."""
        own = Counter(license_scan._tokens(text))
        norm = math.sqrt(sum((n * idf.get(t, 1.0)) ** 2 for t, n in own.items()))
        return max(sum(own[t] * idf[t] * w for t, w in v.items()) for _, v in vectors) / norm if norm else 0.0

    assert not got[0][1]
    assert all(may for text, may in got if best(text) >= 0.75) and 30 < sum(may for _, may in got) < 300


def test_files_of_one_path_are_not_mixed(spark):
    rows = [("a/x", MIT_FILE), ("a/x", "All rights reserved"), ("a/x", "All rights reserved"), ("a/x", None), ("a/LICENSE", "MIT License"), ("a/COPYING", "ISC License")]
    got = license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    own = sorted((r.licence, r.score) for r in got if r.path == "a/x" and r.origin == "line")
    assert own == [("MIT", 1.0), ("proprietary", 1.0), ("proprietary", 1.0)]
    # a/COPYING and a/LICENSE score alike, as do the short texts of a/x: the first path speaks
    assert [(r.licence, r.licence_dir) for r in got if r.origin == "directory"] == [("ISC", "a")]


def test_licences_of_odd_rows(odd_docs, no_docs):
    files = license_scan.document_paths(odd_docs)
    got = license_scan.scan(files).collect()
    assert len(got) == odd_docs.count() and {r.origin for r in got} == {"none"}
    assert license_scan.scan(license_scan.document_paths(no_docs)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="content"><article><h2>A  title &amp; more</h2><p>First <b>bold</b> paragraph, long enough to matter.<br>Next
line.<p>Second &eacute; one, with commas, and stops. And more text in it.<div class=ad>Buy!</div><form><p>Your mail</p></form>
<script>var x = "</p>";</script></article><section class="comments"><p>Nice article, I agree with all of it, really!</p></section></div>
<aside><p>Related things</p></aside><footer>&copy; 2020</footer></body>"""


def test_page_text(spark):
    want = "A title & more\nFirst bold paragraph, long enough to matter. Next line.\nSecond é one, with commas, and stops. And more text in it."
    assert html_text.main_text(PAGE) == want
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html_text.main_text(plain) == want
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>unclosed <b"), (4, "x", "<nav>only</nav>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got if r.page_id == 1] == [want, want] and [r.text for r in got if r.page_id in (2, 4, None)] == ["", "", ""]
    assert all(r.n_chars == len(r.text) for r in got)


LONG = "A paragraph of the article that says something, with commas, and that is long enough to be taken for its text."


@pytest.mark.parametrize("wrapper", [
    '<div class="layout has-sidebar"><article>{}</article></div>', '<div class="layout has-sidebar"><div>{}</div></div>', '<div class="elementor-widget-text">{}</div>',
    '<div id="search-results">{}</div>', '<div class="no-comments menu-open"><main>{}</main></div>', '<div class="post"><div class="discussion">{}</div></div>',
])
def test_a_name_of_a_wrapper_drops_no_article(wrapper):
    own = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    rest = '<div class="sidebar"><ul><li><a href=/x>Other page</a></li></ul></div><div class="comments"><p>Nice article, I agree with all of it!</p></div>'
    assert html_text.main_text(f"<html><body>{wrapper.format(own)}{rest}</body></html>") == f"Title\n{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["ad", "comments", "cookie-notice"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_a_side_longer_than_the_article_goes(name, tag):
    page = f'<body><{tag} id="text"><h1>Title</h1><p>{LONG}</p></{tag}><div class="{name}"><p>{LONG} {LONG}</p></div></body>'
    assert html_text.main_text(page) == f"Title\n{LONG}"


def test_headers_and_sections_of_an_article_stay():
    page = f"""<body><article><div class="post-header"><h1>Title</h1></div><div class="elementor-widget"><p>{LONG}</p></div><div class="elementor-widget"><p>{LONG}</p></div>
<section class="related-work"><p>{LONG}</p></section><div class="related"><a href=/y>Another article</a></div><div class="cookie-notice">We use cookies.</div></article>
<section class="comments"><article>{LONG} {LONG} {LONG} {LONG}</article></section></body>"""
    assert html_text.main_text(page) == f"Title\n{LONG}\n{LONG}\n{LONG}"


def test_short_blocks_of_a_page_of_divs_stay():
    long = LONG * 3
    page = f"""<body><div class="page"><div><ul><li><a href=/a>Start</a></li><li><a href=/b>News</a></li></ul></div><div class="text"><h1>Title</h1><p>{long}</p>
<ul><li>A short item</li><li>One with <a href=/c>a link</a></li></ul><p>{long}</p><table><caption>Yields</caption><tr><th>Crop</th><td>3.1</td></tr></table><pre>x = 1</pre>
<dl><dt>Term</dt><dd>Meaning</dd></dl><figure><img src=z.png><figcaption>A figure</figcaption></figure><p>{long}</p></div></div></body>"""
    want = ["Title", long, "A short item", "One with a link", long, "Yields", "Crop", "3.1", "x = 1", "Term", "Meaning", "A figure", long]
    assert html_text.main_text(page).split("\n") == want
    bare = page.replace("<div class=\"page\"><div>", "").replace("</ul></div><div class=\"text\">", "</ul>").replace("</div></div></body>", "</body>")
    assert [x for x in html_text.main_text(bare).split("\n") if x not in ("Start", "News")] == want
    listing = f"<div class=a><h1>Title</h1><p>Short one.</p><pre>{long * 4}</pre><p>Short two.</p></div>"
    assert html_text.main_text(listing).split("\n") == ["Title", "Short one.", long * 4, "Short two."]


def test_kneser_ney_adds_up_and_tells_junk(spark, no_docs):
    text = "a good plain text about many good plain things that we like to read "
    rows = [(k, text[k % 9 :] * 3, "en") for k in range(40)] + [(90, "#$%& QQ|| zzz$$$ <<>>", "en"), (91, None, "en"), (92, text, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)] + [(90, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels, 0.9).collect()}
    assert len(got) == len(rows) and not got[90].kept and not got[91].kept and got[91].perplexity is None and got[92].kept
    assert got[90].perplexity > 50 * got[1].perplexity
    counts = kneser_ney.count_trusted(docs, labels.filter("quality = 1"))
    model = kneser_ney.Model(counts)
    context = int(kneser_ney.windows(*kneser_ney.stretch(["plai"]))[0][3])
    seen = counts.select("sym").distinct()
    asked = seen.unionByName(spark.createDataFrame([(0x10FFFF,)], "sym int")).withColumn("ctx", F.lit(context))
    total = sum(math.exp(r.logp) for r in model.log_probability(asked).collect())
    assert total == pytest.approx(1.0, abs=1e-9)
    assert kneser_ney.classify(no_docs, labels).count() == 0


def _plain_model(texts):
    """Interpolated modified Kneser-Ney by definition, on tuples of characters."""
    tables = {4: Counter()}
    for text in texts:
        padded = "   " + " ".join(text.split())
        tables[4].update(padded[k : k + 4] for k in range(len(padded) - 3))
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    parts = {}
    for n, table in tables.items():
        times = Counter(min(v, 5) for v in table.values())
        y = times[1] / (times[1] + 2 * times[2]) if times[1] + 2 * times[2] else 0.5
        raw = [k - (k + 1) * y * times[k + 1] / times[k] if times[k] else (0.5, 1.0, 1.5)[k - 1] for k in (1, 2, 3)]
        off = [min(max(d, 0.1), 0.95 if k == 1 else float(k)) for k, d in zip((1, 2, 3), raw)]
        total, given = Counter(), Counter()
        for g, v in table.items():
            total[g[:-1]] += v
            given[g[:-1]] += off[min(v, 3) - 1]
        parts[n] = (table, off, total, given)
    base = 1 / (len(tables[1]) + 1)

    def p(gram):
        value = base
        for n in (1, 2, 3, 4):
            table, off, total, given = parts[n]
            own, ctx = gram[4 - n :], gram[4 - n : -1]
            if total[ctx]:
                value = (max(table[own] - off[min(table[own], 3) - 1], 0) if table[own] else 0) / total[ctx] + given[ctx] / total[ctx] * value
        return value

    return p


def test_kneser_ney_against_the_definition(spark, odd_docs):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()] + [(200 + k, ENGLISH * k, "en") for k in range(5)] + [(300, GERMAN, "de"), (301, "b" * 4, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, ctx string, threshold int").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in (4, 5, 6, 7, 50, 201, 202, 202, None)] + [(300, 0, 1)], "doc_id long, quality int, toxic int")
    chosen = {4, 5, 6, 7, 50, 201, 202}
    p = _plain_model([t or "" for k, t, _ in rows if k in chosen])
    want = Counter()
    for k, text, lang in rows:
        padded = "   " + " ".join((text or "").split())
        n = len(padded) - 3
        value = math.exp(-sum(math.log(p(padded[i : i + 4])) for i in range(n)) / n) if n else None
        want[(k, lang, n, None if value is None else round(value, 6))] += 1
    for most in (1_000_000, 3):  # broadcast ids, or one join of texts
        scored = kneser_ney.perplexities(docs, kneser_ney.Model(kneser_ney.count_trusted(docs, labels.filter("quality = 1"), most)))
        assert Counter((r.doc_id, r.lang, r.n_grams, r.perplexity and round(r.perplexity, 6)) for r in scored.collect()) == want
    got = kneser_ney.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r.kept == (r.perplexity is not None and r.perplexity <= r.threshold) for r in got)


def test_kneser_ney_keeps_characters_apart(spark):
    rows = [(k, "aAbB " * 10, "en") for k in range(20)] + [(90, "".join(chr(ord(c) + 0x8000) if c != " " else c for c in "aAbB " * 10), "en")]
    # more characters in one text than 16 bits can tell apart
    rows += [(50, "".join(map(chr, range(0x4E00, 0xD800))) + "".join(map(chr, range(0x20000, 0x2A000))), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in [*range(20), 50]] * 2, "doc_id long")
    counts = kneser_ney.count_trusted(docs, trusted)
    text = [r[1] for r in rows if r[0] != 90]
    assert counts.agg({"n": "sum"}).first()[0] == sum(len(t.strip()) for t in text)
    assert counts.select("sym").distinct().count() == len(set("".join(text)))
    got = {r.doc_id: r.perplexity for r in kneser_ney.perplexities(docs, kneser_ney.Model(counts)).collect()}
    assert got[90] > 50 * got[1] and got[50] > got[1]


def test_kneser_ney_counts_every_trusted_document(spark):
    docs = spark.range(200_010).selectExpr("id as doc_id", "'ab' as text")
    counts = kneser_ney.count_trusted(docs, docs.select("doc_id"))
    assert counts.agg({"n": "sum"}).first()[0] == 2 * 200_010


def test_perplexity_does_not_depend_on_blocks(spark, odd_docs, no_docs):
    model = kneser_ney.Model(kneser_ney.count_trusted(odd_docs, odd_docs.select("doc_id")))

    def scored(docs, chars):
        return sorted(map(str, kneser_ney.perplexities(docs, model, chars).collect()))

    got = scored(odd_docs, 40)
    assert got == scored(odd_docs, 1 << 24) and len(got) == odd_docs.count()
    assert scored(no_docs, 40) == []


def test_windows_are_hashed_once():
    # a higher-order function evaluates an argument each time it is named
    assert str(line_rules._window_hashes(F.col("the_words"))).count("the_words") == 1
    assert str(line_rules._covered(F.col("the_hashes"))).count("the_hashes") == 1
