from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from eventskim.llm import quality
from eventskim.llm.queries import vocabulary

from .test_duplicates import without_repeats
from .test_near_texts import similar_groups

SF = "/root/testdata/sf0.01"


def test_stages_on_the_table(spark, tmp_path):
    """Each stage against its brute-force version, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / name))
        seen.append((docs.collect(), spark.read.parquet(path).collect()))
        docs = spark.read.parquet(path)
    assert all(tuple(out[0].asDict()) == pipeline.COLUMNS for _, out in seen[:-1])
    before, good = seen[0]
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores(model.compressors(), [r.text for r in before])
    assert Counter(r for r, s in zip(before, scores, strict=True) if s >= 0.3) == Counter(good)
    # One document, the first, of each group that pairs of five-word similarity 0.8 make.
    before, kept = seen[1]
    root = similar_groups([r.text for r in before])
    first = {}
    for r, k in sorted(zip(before, root)):
        first.setdefault(k, r)
    assert Counter(kept) == Counter(first.values()) and len(kept) < len(before)
    before, left = seen[2]
    want = {i: (gone, text) for i, _, gone, text in without_repeats([(r.doc_id, r.text) for r in before])}
    whole = {r.doc_id: r for r in before}
    assert len(left) == len(before)
    for r in left:
        gone, text = want[r.doc_id]
        assert (r.text, r.n_chars) == ((text, len(text)) if gone else (whole[r.doc_id].text, whole[r.doc_id].n_chars))
    before, mixed = seen[3]
    times = Counter(r.doc_id for r in mixed)
    assert set(mixed) <= set(before) and max(times.values()) <= 2
    size = Counter()
    taken = Counter()
    for r in before:
        size[r.source] += len(r.text.split())
        taken[r.source] += len(r.text.split()) * times[r.doc_id]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.03)
    before, encoded = seen[4]
    library = Tokenizer.from_file(vocabulary())
    want = Counter((r.doc_id, np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()) for r in before)
    assert Counter((r.doc_id, bytes(r.ids)) for r in encoded) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in encoded)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * docs.count()
    kept = pipeline.drop_near_copies(spark, odd_docs, SF).collect()
    # The passage that many share makes one group; of the rows without an id one is in it.
    ids = [r.doc_id for r in kept]
    assert 100 in ids and not {200, 306} & set(ids) and ids.count(None) == 1


def test_different_texts_of_one_id_stay(spark):
    """Which row stays does not depend on the order of rows; equal rows leave one."""
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, text(1), "en", "a", 1), (1, text(2), "en", "a", 1), (1, text(1), "en", "a", 1), (None, text(3), "en", "a", 1)]
    rows += [(None, text(3) + " end", "en", "b", 1), (None, text(4), None, None, None), (5, text(1, 59), "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out = [sorted(map(str, pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema).repartition(n), SF).collect())) for n in (1, 4)]
    assert out[0] == out[1] and len(out[0]) == 4
    assert sum("doc_id=1," in r for r in out[0]) == 2 and sum("doc_id=None" in r for r in out[0]) == 2


def test_copies_of_rows_without_ids(spark):
    rows = [(None, f"t{i} " * 10, "en", "a", 1) for i in range(300)] + [(None, "same " * 10, "en", "a", 1)] * 300
    rows += [(i, "big " * 50, "en", "b", 1) for i in range(100)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out = pipeline.mix_sources(spark, spark.createDataFrame(rows, schema).repartition(3), SF).collect()
    times, given = Counter(out), Counter(rows)
    assert all(times[r] <= 2 * given[tuple(r)] for r in times)
    taken = Counter()
    for r in out:
        taken[r.source] += len(r.text.split())
    # Sizes 6,000 and 5,000 words; the first source weighs 5 to 2, and 1.5 times all is shared.
    assert taken["a"] == pytest.approx(16500 * 5 / 7, abs=10) and taken["b"] == pytest.approx(16500 * 2 / 7, abs=50)


def test_run(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0
