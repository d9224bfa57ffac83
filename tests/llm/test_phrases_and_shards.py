"""Phrase mining and sharding against plain counts, with hot words, hot sources, repeated and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from harrow.llm import phrases, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(rows, order=3, least=10, cover=50, top=2000):
    """The contract by definition."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, order + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        rest = []
        for p, a in candidates.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            covered = any(
                100 * n >= cover * a for q, n in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if not covered:
                rest.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _texts(rng, n):
    vocabulary = [f"w{k}" for k in range(40)] + ["Ünï", "CÖDE", "▁x"]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=[1 / (1 + k) for k in range(43)], k=rng.randint(0, 80))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in words)
        rows.append((text + " hot Pair " * rng.randint(0, 9), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("shard_bytes, order, top", [(8 << 20, 3, 2000), (400, 3, 2000), (900, 2, 7), (500, 4, 50)])
def test_phrases_against_plain_counts(spark, monkeypatch, shard_bytes, order, top):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
    rows = _texts(random.Random(order), 120)
    df = spark.createDataFrame([(t, x, 1, "y") for t, x in rows], "text string, lang string, n long, phrase string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, order=order, least=5, top=top).collect())
    assert got == mined(rows, order, 5, top=top) and got


def test_phrases_of_odd_rows_and_ties(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    got = sorted(tuple(r) for r in phrases.collocations(odd_docs).collect())
    assert got == mined(rows)
    assert phrases.collocations(no_docs).count() == 0
    tied = [("a b, c d, e f. " * 6, "en"), ("a b, c d, e f. " * 6, "en"), ("?!", None), (None, "de")]
    df = spark.createDataFrame(tied, "text string, lang string")
    assert [tuple(r)[1:3] for r in phrases.collocations(df).orderBy("rank").collect()] == [(1, "a b"), (2, "c d"), (3, "e f")]


def _placed(rows, shards, seed):
    """The placement by definition: (doc_id, size, crc, shard, slot) of (doc_id, text, source)."""
    digits = lambda *parts: hashlib.md5(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()
    strata = defaultdict(list)
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        strata["" if source is None else "=" + source].append((digits(seed, doc_id, size, crc), doc_id is not None, doc_id or 0, doc_id, size, crc))
    spread = []
    for name, own in strata.items():
        start = int(digits(seed, name)[:8], 16) / 2**32
        for place, (*_, doc_id, size, crc) in enumerate(sorted(own)):
            spread.append(((place + start) / len(own), name, place, doc_id, size, crc))
    n, out = len(spread), []
    for at, (*_, doc_id, size, crc) in enumerate(sorted(spread, key=lambda r: r[:3])):
        shard = at * shards // n
        out.append((doc_id, size, crc, shard, at - -(-shard * n // shards)))
    return Counter(out)


@pytest.mark.parametrize("n, shards", [(0, 16), (5, 16), (400, 16), (733, 7)])
def test_shards_against_the_definition(spark, n, shards):
    rng = random.Random(n)
    rows = [(k, f"text {k} é" * (k % 9), "hot" if k % 3 == 0 else None if k % 7 == 0 else f"s{rng.randint(0, 60)}") for k in range(n)]
    rows += [(None, "one text", "hot")] * (n // 3) + [(None, None, None)] * (n > 0) + [(1, "", "s1")] * (n > 0) * 3
    df = spark.createDataFrame([(*r, k % 2, "z") for k, r in enumerate(rows)], "doc_id long, text string, source string, shard int, stratum string").repartition(4)
    placed = sharding.place(df, shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in placed) == _placed(rows, shards, sharding.SEED)
    filled = Counter(r.shard for r in placed)
    assert not rows or max(filled.values()) - min([filled[k] for k in range(shards)]) <= 1
    # each source is within a row of its share between two fractions; the cuts move by a row per source at most
    strata = Counter(r.stratum for r in placed)
    for source, size in strata.items():
        own = Counter(r.shard for r in placed if r.stratum == source)
        assert all(abs(own[k] - size / shards) <= 2 + 2 * size * len(strata) / len(placed) for k in range(shards))


def test_whole_rows_meet_their_places(spark, odd_docs, tmp_path):
    whole = sharding.with_shards(odd_docs, 4, shard="to", slot="nth")
    assert whole.columns == [*odd_docs.columns, "to", "nth"]
    assert Counter(tuple(r)[:-2] for r in whole.collect()) == Counter(tuple(r) for r in odd_docs.collect())
    sharding.write_shards(odd_docs.drop("rank"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd_docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
