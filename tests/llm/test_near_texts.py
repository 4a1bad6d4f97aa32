import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventskim.llm.near_texts import least_forest, near_text_groups, similar_forest, similar_links


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1))))


def similar_groups(texts, least=0.8):
    """For each text the first one of its group, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for t in texts]
    root, holding, same = list(range(len(texts))), defaultdict(list), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        i, j = sorted((find(i), find(j)))
        root[j] = i

    common = Counter()
    for i, s in enumerate(sets):
        if same.setdefault(s, i) != i:
            join(i, same[s])
            continue
        for x in s:
            common.update((j, i) for j in holding[x])
            holding[x].append(i)
    for (i, j), n in common.items():
        if n >= least * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            join(i, j)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, share):
    return " ".join(rng.choice("xyz") + str(rng.randrange(99)) if rng.random() < share else w for w in words)


def test_groups_of_edited_texts(spark):
    """Recall and precision of links over copies edited to all degrees, a large group among them."""
    rng, texts = random.Random(4), []
    for k in range(60):
        words = [f"w{k}v{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        texts += [" ".join(words)] + [edited(rng, words, rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.1])) for _ in range(300 if k == 0 else 4)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(4)
    out = {r.doc_id: r.root for r in near_text_groups(docs.select("doc_id", "text")).collect()}
    sets = [shingles(t) for t in texts]
    links = found = 0
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                links += 1
                found += out[i] == out[j]
    print("links", links, found)
    assert links > 5000 and found >= 0.97 * links
    # No group holds texts that links do not join.
    want = similar_groups(texts)
    groups = defaultdict(set)
    for i in out:
        groups[out[i]].add(want[i])
    assert all(len(g) == 1 for g in groups.values())


def test_links_of_a_large_group_at_the_threshold(spark):
    """Copies most of which fall short of one another: whoever has a similar one is joined to it."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [edited(rng, words, rng.choice([0.02, 0.04, 0.06])) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.root for r in near_text_groups(docs).collect()}
    want = similar_groups(texts)
    of = defaultdict(set)
    for i, root in enumerate(want):
        of[root].add(out[i])
    print("groups", len(of), sum(len(g) for g in of.values()), "of", len(texts))
    assert len(of) < 1000 and sum(len(g) for g in of.values()) <= 0 + len(of)
    assert len(set(out.values())) == sum(len(g) for g in of.values())


@pytest.mark.parametrize("seed", range(4))
def test_forest_of_similar_sets(seed):
    """The same groups as by all pairs, sets of few and of equal values among them."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(100)]
    for _ in range(8):
        words = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(5, 90))]
        texts += [edited(rng, words, rng.choice([0, 0.02, 0.05, 0.1])) for _ in range(25)]
    number = defaultdict(lambda: len(number))
    sets = [np.array(sorted(number[x] for x in shingles(t)), np.uint64) for t in texts]
    a, b = similar_forest(sets)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert find(i) != find(j)
        i, j = sorted((find(i), find(j)))
        root[j] = i
    want = similar_groups(texts)
    some = [i for i in range(len(sets)) if len(sets[i])]
    assert [find(i) for i in some] == [want[i] for i in some]


def test_tiles_of_a_neighbourhood(spark):
    """All pairs meet, however small the tiles."""
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*words, *(f"t{j}" for j in range(k))])) for k in range(60)]
    texts = spark.createDataFrame(rows, "node long, text string")
    nodes = texts.select("node", (F.col("node") + 56).alias("shingles"))
    near = nodes.select("node", F.lit(0).cast("long").alias("root"))
    for tile in (1 << 20, 700):
        links = {tuple(r) for r in similar_links(near, nodes, texts, tile=tile).collect()}
        assert len({i for link in links for i in link}) == 60
        assert all(min(i, j) * 5 + 56 * 5 >= (max(i, j) + 56) * 4 for i, j in links)


def test_small_texts_and_ties(spark, odd_docs, odd_rows, no_docs):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a  B"), (6, "a b c d e f"), (7, "a b c d e f g"), (8, "b a")]
    out = {r.doc_id: r.root for r in near_text_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == out[2] == out[3] and out[4] == out[5] and len(set(out.values())) == 5
    found = near_text_groups(odd_docs.select("doc_id", "score", "text")).collect()
    assert len(found) == len(odd_rows) and near_text_groups(no_docs.select("doc_id", "text")).collect() == []
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add(r.root)
    assert len({*by_id[200], *by_id[239]}) == 1


@pytest.mark.parametrize("seed", range(5))
def test_least_forest(seed):
    rng = np.random.default_rng(seed)
    a, b, width = rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.integers(0, 9, 200)
    a, b, width = a[a != b], b[a != b], width[a != b]
    kept = least_forest(a, b, width)

    def joined(numbers):
        root = list(range(30))
        total = 0
        for k in sorted(numbers, key=lambda k: width[k]):
            i, j = a[k], b[k]
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            if i != j:
                root[i] = j
                total += width[k]
        return sum(root[i] == i for i in range(30)), total

    trees, total = joined(range(len(a)))
    assert joined(kept) == (trees, total) and len(kept) == 30 - trees and width[kept].sum() == total
