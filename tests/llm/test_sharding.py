import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from eventskim.llm.sharding import cut, minimax_shards, op3_sharding, plan, smallest_capacity


def brute(sizes, shards):
    @cache
    def best(i, k):
        if k == 1:
            return sum(sizes[i:])
        return min(max(sum(sizes[i:j]), best(j, k - 1)) for j in range(i, len(sizes) + 1))

    return best(0, shards)


@pytest.mark.parametrize("seed", range(30))
def test_capacity_and_cuts(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2, 5, 30, 100]) for _ in range(rng.randrange(0, 14))]
    shards = rng.randrange(1, 6)
    capacity = smallest_capacity(sizes, shards)
    assert capacity == brute(tuple(sizes), shards)
    edges = [0, *cut(sizes, shards), len(sizes)]
    assert edges == sorted(edges) and len(edges) == shards + 1
    assert max(sum(sizes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)) <= capacity


def test_heavy_groups_have_shards_of_their_own():
    of_heavy, first = plan([1000, 500, 12], [10] * 40, 10)
    assert of_heavy[:2] == [0, 1] and of_heavy[2] == 2
    assert len(first) == 9 and first[0] == 0 and first == sorted(first)


def check(rows, out, shards):
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    text = defaultdict(set)
    for doc_id, t, *_ in rows:
        text[doc_id].add(((len((t or "").encode()) + 16), zlib.crc32((t or "").encode())))
    slots, of_text, total = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        assert (r.size, r.text_crc32) in text[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        of_text[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for (size, _), s in of_text.items() if size > 16)
    return total


def test_odd_rows(odd_docs, odd_rows):
    check(odd_rows, op3_sharding(odd_docs).collect(), 40)


def test_near_equal(spark):
    rows = [(i, "w" * (i % 97)) if i % 3 else (i, "copy") for i in range(4000)]
    rows = [(i, f"{t}{i}" if i % 3 else t) for i, t in rows]
    total = check(rows, op3_sharding(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), 4)
    assert max(total.values()) <= 1.02 * sum(total.values()) / 4


def test_rerun_agrees_and_columns_stay(odd_docs):
    def run():
        rows = odd_docs.select("doc_id", "shard", "slot", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
        out = minimax_shards(rows, F.col("n"), ["h"], ["doc_id"], 7)
        assert out.columns == ["doc_id", "n", "h", "shard", "slot"]
        return sorted((r.doc_id or -1, r.h, r.shard) for r in out.collect())

    assert run() == run()


def test_no_rows(no_docs):
    assert op3_sharding(no_docs).collect() == []
