import hashlib
import random
import re
import zlib

from eventskim.llm.periodic import _of_texts, op11_runs, periodic_runs, runs


def brute_runs(words, least=12):
    """Every maximal stretch of a period, for all periods, without those of a smaller one."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : start + length]
            if length >= max(least, 2 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def want(doc_id, text):
    words = planted(doc_id, text)
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
    return (doc_id, len(found), *best, exponent, *digests)


def odd_words(rng):
    n, letters = rng.randrange(80), rng.choice([1, 2, 3, 6])
    words = [rng.randrange(letters) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 2))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5:
            words[rng.randrange(n)] = 9
    return words


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        words, least = odd_words(rng), rng.choice([2, 3, 6, 12])
        assert runs(words, least) == brute_runs(words, least)


def test_stretches_leave_out_no_run():
    rng = random.Random(4)
    for _ in range(300):
        texts = [" ".join(f"w{w}" for w in odd_words(rng)) for _ in range(rng.randrange(6))]
        texts.append(" new ".join(texts))
        found, left = _of_texts([*texts, None], 12)
        for text, f, c in zip(texts, found, left):
            words = text.split()
            assert f == brute_runs(words)
            gone = {i for s, n, q in f for i in range(s + q, s + n)}
            assert c.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert found[-1] == [] and left[-1] == b""


def test_known_runs():
    assert runs(list("mississippi"), 4) == [(1, 7, 3)]
    assert runs(["a"] * 12) == [(0, 12, 1)]
    assert runs(["a"] * 11) == runs([]) == []
    line = [f"w{i}" for i in range(30)]
    assert runs(["x", *line, *line, *line[:7], "y"]) == [(1, 67, 30)]
    assert runs([*line, "x", *line]) == []


def test_long_runs():
    words = [i % 700 for i in range(30_000)]
    assert runs(words) == [(0, 30_000, 700)]
    assert runs([1] * 50_000) == [(0, 50_000, 1)]


def test_query_against_brute_force(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 50_000]
    rows += [(1000 + i, " ".join(f"w{w}" for w in odd_words(rng))) for i in range(300)]
    rows += [(2000 + i, " a\x1c b\x85 \t c\n" * rng.randrange(9)) for i in range(40)]
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, start int, runs string").repartition(3)
    out = sorted(map(tuple, op11_runs(docs).collect()), key=repr)
    assert out == sorted((want(*r) for r in rows), key=repr)
    assert op11_runs(odd_docs).count() == len(odd_rows) and op11_runs(no_docs).collect() == []


def test_long_texts(spark):
    rows = [(i, " ".join(f"w{k * k % 9973}" for k in range(20_000))) for i in range(20)] + [(99, "x" * 400_000)]
    out = {r.doc_id: r for r in op11_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = planted(i, text)
        planted_here = zlib.crc32(str(i).encode()) % 10 == 0 and i != 99
        assert out[i].n_runs >= planted_here
        if planted_here:
            g = zlib.crc32(str(i).encode()) // 10
            assert out[i].start <= g % len(words) and out[i].start + out[i].length == len(words)


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "b " * 20, "mine")], "id int, body string, collapsed string")
    (row,) = periodic_runs(docs, "body").collect()
    assert (row.id, row.body, row.collapsed) == (1, "b " * 20, "b") and [tuple(r) for r in row.runs] == [(0, 20, 1)]
