import re
from collections import Counter, defaultdict

import pytest

from eventskim.llm.mixing import mix, op4_mixing, repeated


def targets(sizes):
    """The rule as it is worded: deal out, stop at twice the size, deal the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            out[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
    return out


def check(rows, out):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most = Counter(), Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += words(text)
        most[source] = max(most[source], words(text))
    want, taken = targets(sizes), Counter()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], words(r[1])) for r in rows)
    sources = defaultdict(set)
    for doc_id, text, _, source, *_ in rows:
        sources[doc_id, words(text)].add(source)
    for r in out:
        source = next(s for s in sources[r.doc_id, r.size] if r.source_size == sizes[s] and r.target == pytest.approx(want[s]))
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= most[source]
    return taken


def test_odd_rows(odd_docs, odd_rows):
    check(odd_rows, op4_mixing(odd_docs).collect())


def test_near_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first, again = (sorted(op4_mixing(docs.repartition(n, "n_chars")).collect()) for n in (3, 5))
    assert first == again
    taken = check(rows, first)
    assert all(taken[s] > 0 for s in taken)
    # Fractions are unbiased over documents: long and short ones are taken alike.
    hot = [r for r in first if rows[r.doc_id][3] == "hot" and r.target < 2 * r.source_size]
    for size in range(1, 8):
        rate = [r.taken / r.size for r in hot if r.size == size]
        assert not rate or sum(rate) / len(rate) == pytest.approx(hot[0].target / hot[0].source_size, abs=0.1)


def test_one_source_without_words(spark):
    docs = spark.createDataFrame([(1, "", "s"), (2, None, "s"), (3, None, None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.copies) for r in mix(docs).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 0, 0.0, 0)}


def test_no_rows(no_docs):
    assert op4_mixing(no_docs).collect() == []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_ids_are_rounded_one_by_one(spark):
    """Equal rows and different ones without ids; no unit has the mass of more than a document."""
    big = [(i, "w " * 40, "en", "a", 1) for i in range(100)]
    for rest in (
        [(None, "b " * 10, "en", "b", 1)] * 1000,
        [(None, f"b{i} " * 5, "en", "b", 1) for i in range(1500)],
        [(7, "b " * 3, "en", "b", 1)] * 400 + [(7, "c " * 3, "en", "b", 1)] * 401 + [(None, None, "en", "b", 1)] * 30,
    ):
        docs = spark.createDataFrame(big + rest, SCHEMA).repartition(4)
        check(big + rest, op4_mixing(docs).collect())
        again = op4_mixing(docs.repartition(7)).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, op4_mixing(docs).collect()))


def test_repeated_rows_are_dealt_in_portions(spark):
    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 3001), ("d", 0)], "k string, n long")
    assert Counter(r.k for r in repeated(df, "n", 100).collect()) == {"a": 1, "b": 10, "c": 3001}
