"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .ann import op7_ann
from .bpe import op2_bpe
from .common import table
from .divergence import op13_divergence
from .knn_join import op6_topk
from .mixing import op4_mixing
from .page_text import op12_main_text
from .periodic import op11_runs
from .quality import op5_quality
from .repeats import op8_repeats
from .sharding import op3_sharding
from .simhash import op10_simhash
from .toxicity import op1_toxicity
from .warc import op9_warc


#: Vocabulary of op2; every executor opens the file at this path.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _bpe(docs: DataFrame) -> DataFrame:
    """:func:`~.bpe.op2_bpe` with the public vocabulary.

    NULL and empty texts have no ids; every row stands for itself, whatever its id; an
    empty table gives no row.
    """
    return op2_bpe(docs, vocabulary())


def _over(names: str, operator: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query that applies ``operator`` to whole tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return operator(*(table(spark, sf_dir, name) for name in names.split()))

    query.__doc__ = operator.__doc__
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": _over("documents labels", op1_toxicity),
        "op2_bpe": _over("documents", _bpe),
        "op3_sharding": _over("documents", op3_sharding),
        "op4_mixing": _over("documents", op4_mixing),
        "op5_quality": _over("documents labels", op5_quality),
        "op6_topk": _over("embeddings", op6_topk),
        "op7_ann": _over("embeddings", op7_ann),
        "op8_repeats": _over("documents", op8_repeats),
        "op9_warc": _over("pages", op9_warc),
        "op10_simhash": _over("documents", op10_simhash),
        "op11_runs": _over("documents", op11_runs),
        "op12_main_text": _over("pages", op12_main_text),
        "op13_divergence": _over("documents", op13_divergence),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
            ), r AS (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
            )
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
        """,
        "op8_repeats": r"""
            WITH d AS (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), windows AS (
                SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
            ), ordered AS (
                SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows
            ), gone AS (
                SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(s, s + 20)) AS pos FROM ordered WHERE r > 1)
            ), words AS (
                SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
            ), kept AS (
                SELECT words.doc_id, count(gone.pos) AS n_removed,
                    string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS text
                FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id
            )
            SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
                sha256(coalesce(kept.text, '')) AS kept_sha256
            FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
        """,
        # Revisit resolution is a window over equal payloads; the archives are written and read by the query.
        "op9_warc": """
            WITH p AS (
                SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
                FROM pages
            ), q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
            FROM q
        """,
        "op13_divergence": r"""
            WITH d AS (
                SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
                FROM documents
            ), w AS (
                SELECT lang, source, doc, term, count(*) AS n
                FROM (SELECT lang, source, doc, unnest(regexp_extract_all(low, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
                GROUP BY ALL
            ), k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 10),
            v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
            c AS (SELECT lang, source, term, sum(n) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
            g AS (SELECT DISTINCT lang, source FROM d),
            t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
            q AS (
                SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)) AS BIGINT) AS q
                FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY ALL) USING (lang) GROUP BY ALL
            ), p AS (
                SELECT lang, source, term, coalesce(n, 0) AS n,
                    CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (coalesce(total, 0) + 2 * v) AS BIGINT) AS p
                FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)
            ), pairs AS (
                SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
                FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
            ), f AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                    LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                UNION ALL
                SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
            )
            SELECT lang, source, part, item, value,
                CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
            FROM f QUALIFY part = 'pair' OR rank <= 10
        """,
    }
