import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from eventskim.llm.divergence import folded, op13_divergence, source_divergences, terms
from eventskim.llm.queries import oracle_sql

DOCS = "text string, lang string, source string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10, top=10):
    """The rows of the contract, by plain integers."""
    docs = [tuple(x or "" for x in r) for r in rows]
    held, n, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        groups[lang].add(source)
        held.update((lang, t) for t in set(found))
        n.update((lang, source, t) for t in found)
    out = []
    for lang, sources in groups.items():
        kept = [t for (l, t), k in held.items() if l == lang and k >= least]

        def probabilities(counts):
            total = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        counts = {s: Counter({t: n[lang, s, t] for t in kept}) for s in sources}
        p = {s: probabilities(c) for s, c in counts.items()}
        q = probabilities(sum(counts.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(far(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                ranked = enumerate(found if part == "pair" else found[:top], 1)
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in ranked]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("Al", "be", "ñu", "日", "Éx", "st", "\x85") for b in ("a", "O", "ß", "", "zz")]
    out = []
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "en", "fr", "xx", None, ""]), rng.choice(["a", "a", "b", "é", "𝒞", None, ""])
        some = rng.sample(words, 1 + rng.randrange(len(words)))
        out.append((rng.choice([" ", "1", "_", "\x00", "-"]).join(rng.choices(some, k=rng.randrange(60))), lang, source))
    out += [(None, "de", "a"), ("", "de", "b"), ("nur hier", "de", None), (None, None, None)]
    out += [("only two", "it", "a")] * 3 + [("all alone", "pt", "a")] * 12
    return out


@pytest.mark.parametrize(("held", "block_terms", "cells"), [(400_000, 4096, 1 << 21), (3, 4096, 40), (50, 2, 1 << 21), (9, 9, 1)])
def test_against_brute_force(spark, rows, held, block_terms, cells):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{DOCS}, part string, value int").repartition(4)
    want = brute(rows)
    assert rows_of(source_divergences(docs, held=held, block_terms=block_terms, cells=cells)) == want
    assert {r[0] for r in want if r[2] == "pair" and r[4] == 0} == {"de"}  # groups without kept terms have pairs too
    assert rows_of(source_divergences(docs, 1, 3, held, block_terms, cells)) == brute(rows, 1, 3)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    assert rows_of(op13_divergence(odd_docs)) == brute([r[1:4] for r in odd_rows])
    assert op13_divergence(no_docs).collect() == []


def test_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({oracle_sql()['op13_divergence']})").fetchall()
    assert sorted(found) == brute(rows)


def test_stripes_are_spilled_whole(spark, rows):
    docs = spark.createDataFrame([tuple(x or "" for x in r) for r in rows], DOCS).coalesce(1)
    whole, spilled = folded(docs).collect(), folded(docs, 30).collect()
    assert len(spilled) > len(whole) == len({(r.lang, r.term) for r in whole})
    added = [Counter(), Counter()]
    for into, found in zip(added, (whole, spilled)):
        for r in found:
            into.update({(r.lang, r.term, s): n for s, n in zip(r.sources, r.counts)})
    assert added[0] == added[1]


def test_a_hot_source_and_long_texts(spark):
    rows = [("the " * 30_000 + f"rare{i % 7}x", "en", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(60)]
    rows += [("x" * 200_000, "en", "hot")] * 11
    assert rows_of(op13_divergence(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_terms():
    assert terms("Don't STOP, é\x00È 1a2b日本_x") == [w.encode() for w in ("don", "t", "stop", "é", "È", "a", "b日本", "x")]
