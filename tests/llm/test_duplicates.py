import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventskim.llm import simhash
from eventskim.llm.components import components
from eventskim.llm.repeats import chunked, op8_repeats, remove_repeats
from eventskim.llm.simhash import anchors, close_links, fingerprint, op10_simhash

from .conftest import text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeats(rows, n=20):
    """Words, how many go and what is left, for each (doc_id, text)."""
    first = {}
    key = lambda i, s: (i is None, i or 0, s)
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in texts:
        for s in range(len(w) - n + 1):
            window = tuple(w[s : s + n])
            first[window] = min(first.get(window, key(i, s)), key(i, s))
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < key(i, s):
                gone[s : s + n] = [True] * n
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


@pytest.mark.parametrize("chunk_bytes", [1500, 4 << 20])
def test_repeats_of_odd_rows(odd_docs, odd_rows, chunk_bytes):
    out = remove_repeats(odd_docs, chunk_bytes=chunk_bytes)
    found = out.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == Counter(without_repeats(odd_rows))
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert not r.n_removed or all(s.end - s.start >= 20 for s in r.removed)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "n_words", "n_removed", "removed"])


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_few_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(90)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (5, 6, 20):
        out = remove_repeats(docs, window, 700).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == Counter(without_repeats(rows, window))


def test_repeats_query(small, no_docs):
    rows = [(r.doc_id, r.text) for r in small("documents").select("doc_id", "text").collect()]
    out = op8_repeats(small("documents")).collect()
    want = Counter((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in without_repeats(rows))
    assert Counter(map(tuple, out)) == want
    assert op8_repeats(no_docs).collect() == []


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, threshold):
    """Smallest linked value of each value, by comparing all pairs."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def check_components(rows, out):
    prints = {r.doc_id: int(r.fingerprint, 16) for r in out}
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    roots = linked([int(r.fingerprint, 16) for r in out], 4)
    smallest = {}
    for i, p in prints.items():
        if i is not None:
            smallest[roots[p]] = min(i, smallest.get(roots[p], i))
    for r in out:
        assert r.component_id == smallest.get(roots[int(r.fingerprint, 16)])


def test_simhash_of_odd_rows(odd_docs, odd_rows, no_docs):
    out = op10_simhash(odd_docs).collect()
    want = Counter((i, f"{plain_fingerprint(t):016x}") for i, t, *_ in odd_rows if t != "x" * 300_000)
    assert not want - Counter((r.doc_id, r.fingerprint) for r in out)
    check_components(odd_rows, out)
    assert op10_simhash(no_docs).collect() == []


def test_simhash_query(small):
    rows = small("documents").select("doc_id", "text").collect()
    out = op10_simhash(small("documents")).collect()
    found = {r.doc_id: r.fingerprint for r in out}
    assert all(found[r.doc_id] == f"{plain_fingerprint(r.text):016x}" for r in rows)
    check_components(rows, out)


@pytest.mark.parametrize("split", [8, 4096])
@pytest.mark.parametrize("threshold", [0, 1, 3, 4, 6])
def test_links(spark, split, threshold, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(threshold)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):  # chains of near values, and a dense group
        v = rng.choice(values[-60:] if rng.random() < 0.7 else values[:2])
        for bit in rng.sample(range(64), rng.randrange(1, 6)):
            v ^= 1 << bit
        values.append(v)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    found = {r.node: r.root for r in components(close_links(prints, threshold)).collect()}
    want = linked(signed, threshold)
    assert {v: found.get(v, v) for v in signed} == want


def test_all_near_values_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    for flips in (1, 2, 4):
        y = x.copy()
        for k in range(len(y)):
            for bit in rng.choice(64, flips, replace=False):
                y[k] ^= np.int64(np.uint64(1 << int(bit)).astype(np.int64))
        home, guest = ({}, {})
        for place, values in ((home, x), (guest, y)):
            anchor, row, role = anchors(values, 4)
            for a, r, g in zip(anchor, row, role, strict=True):
                if g == (0 if place is home else 1):
                    place.setdefault(int(r), set()).add(int(a))
        assert all(home[k] & guest[k] for k in range(len(x)))


def test_fingerprint_of_no_words():
    assert fingerprint(b"") == fingerprint(b" \n\t") == bytes(8)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    links += [(300, i) for i in range(301, 380)] + [(5, 5), (None, 3), (3, None)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {v: find(v) for v in root if find(v) != v}
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == want and len(out) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_without_ids_are_dealt_out(spark):
    """A third of all rows without an id, some of them equal: no chunk holds much more than it should."""
    rng = random.Random(3)
    shared = text_of(rng, 60)
    rows = [(None if i % 3 == 0 else i, text_of(rng, 150) + (f" {shared} " if i % 20 == 0 else " ") + text_of(rng, 150)) for i in range(900)]
    rows += [(None, rows[0][1])] * 200 + [(7, text_of(rng, 300)) for _ in range(200)] + [(None, "")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    size = 30_000
    placed, n = chunked(docs, ["doc_id", "text"], size, 100)
    held = placed.groupBy("__chunk").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).collect()
    assert n > 10 and max(r.bytes for r in held) < 4 * size and max(r.rows for r in held) < 400
    assert placed.filter("__split").select("doc_id").distinct().count() == 2
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    out = remove_repeats(docs, chunk_bytes=size).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, out), key=key) == sorted(without_repeats(rows), key=key)
