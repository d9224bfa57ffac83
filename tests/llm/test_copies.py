"""Near copies, repeated strings and nearest vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import graph, jaccard_join, suffix_dedup, top_k


def _shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _families(seed, sizes=(8, 15, 30, 60, 140)):
    rnd = random.Random(seed)
    texts = []
    for size in sizes:
        for _ in range(4):
            base = [f"w{rnd.randint(0, 400)}" for _ in range(size)]
            for _ in range(6):
                own = list(base)
                for _ in range(rnd.randint(0, max(1, size // 25))):
                    own[rnd.randrange(len(own))] = f"v{rnd.randint(0, 99)}"
                base = own if rnd.random() < 0.5 else base  # some families drift
                texts.append(" ".join(own))
    return texts + ["common passage of a few words here " * 2 + t for t in texts[::5]]


def test_texts_and_sketches_are_written_once(spark, monkeypatch):
    written, keep = [], jaccard_join.stabilise
    monkeypatch.setattr(jaccard_join, "stabilise", lambda df, *more: written.append(df) or keep(df, *more))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(_families(4, (8, 15)))], "doc_id long, text string").repartition(40)
    jaccard_join.cluster(docs)
    texts, shared = written[:2]
    assert texts.columns == ["tid", "first_doc", "text", "size", "bits"]
    assert shared.columns == ["code", "tid", "skip"] and len(keep(shared).inputFiles()) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 90, 5)])
def test_components_equal_brute_force(spark, odd_docs, n, percent, seed):
    rows = [(k, t) for k, t in enumerate(_families(seed))] + [(1000, None), (1001, " "), (1002, ""), (1003, "A b"), (1004, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [_shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.cluster(docs, n, percent).collect()}
    assert got == {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    assert jaccard_join.cluster(odd_docs).count() == odd_docs.count() and jaccard_join.cluster(no_docs).count() == 0
    kept = jaccard_join.without_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert [r.doc_id for r in kept.filter("text like 'the same text twice%'").collect()] == [50]
    assert kept.filter("doc_id is null").count() == 1


def test_components_of_a_long_path(spark):
    links = spark.range(40).selectExpr("39 - id as a", "40 - id as b")
    assert {(r.node, r.root) for r in graph.components(links).collect()} == {(k, 0) for k in range(41)}


def _cut(rows, size):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            k = b[i : i + size]
            first[k] = min(first.get(k, doc), doc)
    out = {}
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < doc:
                gone[i : i + size] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group_bytes", [12 << 20, 4000])
def test_repeats_equal_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    rnd = random.Random(7)
    phrase = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(30, 90))) for _ in range(25)]
    texts = ["".join(rnd.choice(phrase) if rnd.random() < 0.4 else "".join(rnd.choice("xyzé") for _ in range(40)) for _ in range(rnd.randint(0, 12))) for _ in range(120)]
    texts += [texts[3], "ab" * 300, "ab" * 200, "q" * 49, "q" * 49, "q" * 50, "q" * 51, None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == _cut(rows, 50)


def test_texts_whose_digests_begin_alike_are_two(spark):
    def begin(text):
        return hashlib.sha256(text.encode()).digest()[:2]

    passage = "a passage of more than fifty bytes that only two texts of this table have"
    first = f"{passage} first"
    second = next(t for t in (f"second {k} {passage}" for k in range(10_000_000)) if begin(t) == begin(first))
    rows = [(0, first), (1, second), (2, "another text of more than fifty bytes that shares nothing with them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == _cut(rows, 50) and got[1][1] >= len(passage)


def test_suffixes_are_sorted():
    data = np.frombuffer(b"abracadabra" * 9 + b"banana" * 9, np.uint8)
    at = np.arange(len(data) - 50)
    order = suffix_dedup.sort_suffixes(data, at, np.zeros(len(at), np.int64), 50)
    sorted_ = [data[i : i + 50].tobytes() for i in at[order]]
    assert sorted_ == sorted(sorted_)


def test_only_suffixes_that_another_document_has_are_sorted(monkeypatch):
    rng, passage = np.random.default_rng(5), bytes(range(60))
    texts = [rng.integers(0, 256, 400, np.uint8).tobytes() for _ in range(6)]
    texts[4] += passage
    texts[1] += passage
    data, length = np.frombuffer(b"".join(texts), np.uint8), [len(t) for t in texts]
    begin = np.cumsum(length) - length
    at = np.concatenate([np.arange(b, b + n - 49) for b, n in zip(begin, length)])
    doc = np.repeat(np.arange(6), [n - 49 for n in length])
    sorted_, sort = [], suffix_dedup.sort_suffixes
    monkeypatch.setattr(suffix_dedup, "sort_suffixes", lambda d, a, *more: sorted_.append(len(a)) or sort(d, a, *more))
    least = suffix_dedup.least_document(data, at, np.zeros(len(at), np.int64), doc, 50)
    assert np.flatnonzero(least != doc).tolist() == [k for k, (a, d) in enumerate(zip(at, doc)) if d == 4 and a >= begin[4] + 400]
    assert set(least[least != doc]) == {1} and sorted_ == [22]


def test_suffixes_with_one_hash_are_compared_once(monkeypatch):
    passage, rng = bytes(range(40, 140)), np.random.default_rng(6)
    texts = [rng.integers(0, 256, 60, np.uint8).tobytes() + passage for _ in range(64)]
    data, compared, common = np.frombuffer(b"".join(texts), np.uint8), [], suffix_dedup.Hashes.common
    at = np.concatenate([np.arange(160 * k, 160 * k + 111) for k in range(64)])
    monkeypatch.setattr(suffix_dedup.Hashes, "common", lambda self, a, b, size: compared.append(len(a)) or common(self, a, b, size))
    least = suffix_dedup.least_document(data, at, np.zeros(len(at), np.int64), np.repeat(np.arange(64), 111), 50).reshape(64, 111)
    # 51 different strings are in every document, each followed by its 63 twins
    assert (least[:, 60:] == 0).all() and (least[:, :56] == np.arange(64)[:, None]).all()
    assert sum(compared) < 51 * 64


def test_one_python_worker_a_task_cuts_and_restores(spark):
    docs = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, more string")
    assert "MapInArrow" not in suffix_dedup.without_repeats(docs)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_words_kept_are_bounded():
    jaccard_join.shingles(" ".join(f"w{k}" for k in range(200_000)), 3)
    assert len(jaccard_join._words) <= 1 << 16


def test_rows_travel_with_their_texts(spark):
    text = "a passage of more than fifty bytes that more than one text of this table holds"
    rows = [(1, None, 1.5, ["x"]), (2, text, None, None), (3, text + " é more", 2.5, []), (3, text + " é more", 2.5, ["y"]), (4, text, 0.0, None), (None, "", 3.5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, z double, rest array<string>").repartition(3)
    left = suffix_dedup.without_repeats(docs)
    want = [(1, None, 1.5, ["x"]), rows[1], (3, " é more", 2.5, []), (3, " é more", 2.5, ["y"]), rows[5]]
    assert left.schema == docs.schema and sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, want))
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2  # of ids with digests; none has texts


def test_repeats_of_odd_rows(odd_docs, no_docs):
    got = suffix_dedup.remove_repeats(odd_docs)
    assert got.count() == odd_docs.count() and suffix_dedup.remove_repeats(no_docs).count() == 0
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[50].n_removed == 0 and rows[51].n_removed == rows[51].n_bytes
    left = suffix_dedup.without_repeats(odd_docs)
    assert left.columns == odd_docs.columns and left.filter("doc_id = 51").count() == 0 and left.filter("doc_id = 50").count() == 2


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "DATA_BLOCK", 60)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 5)
    rnd = np.random.default_rng(4)
    near = rnd.normal(size=(8, 6))
    v = [(near[k % 8] + 0.05 * rnd.normal(size=6)).tolist() for k in range(300)]
    v += [v[0]] * 60 + [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] * 6, [0.5] * 3, [-0.5] * 3, []]
    table = spark.createDataFrame([(k, x, 1, 2) for k, x in enumerate(v)] + [(None, v[0], 1, 2)], "vec_id long, embedding array<double>, rank int, id int")
    got = {}
    for r in top_k.search(top_k.grid_vectors(table), F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {k: np.floor(64 * np.array(x)).astype(int) for k, x in enumerate(v) if x is not None and all(y is not None and np.isfinite(y) for y in x)}
    for k in [k for k in q if k % 20 == 0]:
        best = sorted((-int(q[k] @ q[j]), j) for j in q if j != k and len(q[j]) == len(q[k]))[:20]
        assert sorted(got.get(k, [])) == [(i + 1, j, -s) for i, (s, j) in enumerate(best)]
    assert top_k.search(top_k.grid_vectors(table.limit(0)), F.col("id") % 20 == 0).count() == 0


def test_pipeline_on_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", F.lit(1).alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} <= {r.doc_id for r in odd_docs.collect()}


def test_pipeline_is_the_operators_one_after_the_other(spark, tmp_path):
    """Whole run over a folder: rejected, unknown and copied documents go, shared lines and passages are cut, lengths are those of the texts."""
    words = "the and of to in that it was for on are with they be at this have from or one had by but not what all were when we there can an".split()
    rnd = random.Random(4)
    passage = " ".join(rnd.choices(words, k=60))
    rows = []
    for k in range(60):
        body = " ".join(rnd.choices(words, k=80)) + f" mark{k} end{k * 7}."
        rows.append((k, f"Accept our cookies now please\n{body}" if k < 20 else f"{body} {passage}" if k < 30 else body, "en", "s1"))
    rows += [(100 + k, rows[30 + k][1], "en", "s2") for k in range(5)] + [(110 + k, rows[40 + k][1] + " tail", "en", "s2") for k in range(5)]
    rows += [(120, "too short", "en", "s1"), (121, None, "en", "s1"), (122, "1234 5678 " * 30, "en", "s1")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        assert all(r.n_chars == len(r.text) for r in kept.collect()), name
    left = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id for r in packed} == set(left) == {*range(60)}
    assert "cookies" in left[0] and not any("cookies" in left[k] for k in range(1, 60))
    assert passage in left[20] and not any(passage in left[k] for k in range(60) if k != 20)
    ids = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    place = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(place, packed)) == sorted(map(place, ids))


def test_pipeline_on_an_empty_table(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
