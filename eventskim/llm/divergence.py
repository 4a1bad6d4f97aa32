"""How the words of each source differ from those of other sources, exactly.

Partitions fold whole documents into stripes, one a term: the number of its documents
and its count in each source. A mapper spills its stripes when they are many; stripes of
one term are merged after one shuffle by (lang, term). The merged stripes are dealt into
blocks of bounded size, each with the totals of its lang, and every block gives its part
of all divergences; sums of the parts are the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fixed, released

#: A term is kept in a lang with at least so many documents that hold it.
LEAST_DOCS = 10
#: Terms reported for each source.
TOP_TERMS = 10
#: Probabilities are whole multiples of one over this.
SCALE = 1_000_000_000
#: Entries of all stripes (a term's documents, or a term's count in a source) a mapper holds.
HELD = 400_000
#: Terms of a block, and terms times sources of one.
BLOCK_TERMS = 4096
CELLS = 2 << 20
_ROWS = 1 << 16  # stripes of an Arrow batch

#: Bytes outside terms become blanks; A-Z are lower-cased, all else stays.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
STRIPES = "lang string, term string, sources array<string>, counts array<bigint>"


def terms(text: str) -> list[bytes]:
    """Longest runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_TERM_BYTES).split()


def _spilled(stripes: dict[str, dict[bytes, dict]]) -> Iterator[pa.RecordBatch]:
    for lang, of in stripes.items():
        rows = list(of.items())
        for at in range(0, len(rows), _ROWS):
            part = rows[at : at + _ROWS]
            offsets = pa.array(np.cumsum([0, *(len(s) for _, s in part)]), pa.int32())
            sources = pa.array([k for _, s in part for k in s], pa.string())
            counts = pa.array([n for _, s in part for n in s.values()], pa.int64())
            columns = [
                pa.array([lang] * len(part), pa.string()),
                pa.array([t for t, _ in part], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(offsets, sources),
                pa.ListArray.from_arrays(offsets, counts),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "sources", "counts"])


def folded(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Stripes of ``docs`` (lang, source, text), a term's possibly in several rows.

    ``counts`` are those of ``sources``; the source NULL stands for the number of documents.
    A mapper holds ``held`` entries and those of one document at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[str, dict[bytes, dict]] = {}
        entries = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of = stripes.setdefault(lang, {})
                for term, n in Counter(terms(text)).items():
                    stripe = of.get(term)
                    if stripe is None:
                        of[term] = {None: 1, source: n}
                        entries += 2
                        continue
                    stripe[None] += 1
                    if source in stripe:
                        stripe[source] += n
                    else:
                        stripe[source] = n
                        entries += 1
                if entries > held:
                    yield from _spilled(stripes)
                    stripes, entries = {}, 0
        yield from _spilled(stripes)

    return docs.select("lang", "source", "text").mapInArrow(released(run), STRIPES)


def merged(stripes: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, sources, counts) of each term in at least ``least_docs`` documents of its lang.

    Rows of a term add up as they come, so a term in every spill fills no buffer.
    """
    entries = stripes.repartition("lang", "term").select(
        "lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e")
    )
    counted = entries.groupBy("lang", "term", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    of = F.when(F.col("source").isNotNull(), F.struct("source", "n"))
    whole = counted.groupBy("lang", "term").agg(
        F.sum(F.when(F.col("source").isNull(), F.col("n"))).alias("docs"), F.collect_list(of).alias("s")
    )
    return whole.filter(F.col("docs") >= least_docs).select(
        "lang", "term", F.col("s.source").alias("sources"), F.col("s.n").alias("counts")
    )


def _probability(counts: np.ndarray, total, kept: int) -> np.ndarray:
    if counts.size and int(counts.max()) > (1 << 62) // SCALE:
        counts, total = counts.astype(object), np.asarray(total, object)
    return (1 + (counts + 2) * SCALE // (total + 2 * kept)).astype(np.int64)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


PARTS = "lang string, source string, part string, item string, value bigint"


def _divergences(top: int):
    def of(stripes: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        sources, total = groups["source"].to_pylist(), groups["total"].to_numpy()
        lang, kept = groups["lang"][0], groups["kept"][0].as_py()
        stripes = stripes.sort_by("term")
        number = {s: i for i, s in enumerate(sources)}
        lists = stripes["sources"].combine_chunks()
        flat = lists.flatten().dictionary_encode()
        column = np.array([number[s] for s in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy()]
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), np.int64))
        counts = np.zeros((len(lists), len(sources)), np.int64)
        counts[row, column] = stripes["counts"].combine_chunks().flatten().to_numpy()
        p = _probability(counts, total, kept)
        q = _probability(counts.sum(axis=1), total.sum(), kept)
        out = {"source": [], "part": [], "item": [], "value": []}
        between = np.zeros((len(sources), len(sources)), np.int64)
        for i in range(len(sources) - 1):
            between[i, i + 1 :] = _distance(p[:, i + 1 :], p[:, i : i + 1]).sum(axis=0)
        between += between.T
        for i, source in enumerate(sources):
            others = [j for j in range(len(sources)) if j != i]
            more = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
            value = _distance(p[more, i], q[more])
            first = np.argsort(-value, kind="stable")[:top]
            out["source"] += [source] * (len(others) + len(first))
            out["part"] += ["pair"] * len(others) + ["term"] * len(first)
            out["item"] += [sources[j] for j in others] + stripes["term"].take(more[first]).to_pylist()
            out["value"] += [*between[i, others].tolist(), *value[first].tolist()]
        table = pa.table({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in out.items()})
        return table.add_column(0, "lang", pa.array([lang.as_py()] * len(table), pa.string()))

    return of


def source_divergences(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    held: int = HELD,
    block_terms: int = BLOCK_TERMS,
    cells: int = CELLS,
) -> DataFrame:
    """Divergences of every (lang, source) group of ``docs`` (lang, source, text), ranked.

    NULL lang, source and text are ''. A group gives a term kept in its lang the
    probability p = 1 + floor(10^9 (n + 2) / (N + 2 V)), with n its occurrences there, N
    those of all kept terms and V the kept terms; the lang as a whole gives it q by the
    same rule. Two probabilities are (p - q)^2 / (p + q) apart, rounded down. Rows of part
    ``pair`` have the sum over all kept terms for each other source of the lang, 0 without
    any kept term; rows of part ``term`` the ``top`` terms that the group has with p > q.
    ``rank`` counts from 1 by value, largest first, then by the UTF-8 bytes of ``item``.

    Repeated rows are documents of their own; an empty table gives no row. A block holds
    about ``block_terms`` terms, fewer where times sources they exceed ``cells``. The work of pairs grows with the
    square of a lang's sources, as their rows do.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    stripes = fixed(merged(folded(docs, held), least_docs))
    counts = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    totals = counts.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    kept = stripes.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = (
        docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept")))
    )
    groups = fixed(groups)
    number = F.greatest(F.max("kept") / block_terms, F.max("kept") * F.count("*") / cells)
    per_lang = groups.groupBy("lang").agg(F.ceil(number).cast("int").alias("blocks"))
    # Langs of several blocks; there is one for so many stripes at most, so they stay few.
    blocks = F.broadcast(per_lang.filter("blocks > 1"))
    several = F.coalesce("blocks", F.lit(1))
    left = stripes.join(blocks, "lang", "left").withColumn("block", F.pmod(F.xxhash64("term"), several).cast("int"))
    right = groups.join(blocks, "lang", "left").withColumn("block", F.explode(F.sequence(F.lit(0), several - 1)))
    found = (
        left.select("lang", "block", "term", "sources", "counts").groupBy("lang", "block")
        .cogroup(right.select("lang", "block", "source", "total", "kept").groupBy("lang", "block"))
        .applyInArrow(_divergences(top), PARTS)
    )
    added = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = added.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_divergence(docs: DataFrame) -> DataFrame:
    """Divergences between the sources of each lang, and the terms that mark each source."""
    return source_divergences(docs)
