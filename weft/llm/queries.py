"""The queries of this subpackage: one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bwt_merge, cuckoo, curve_clusters, jaccard, line_chunks, lm_score, mixing, ordinal, packing, pivot_search, setm, token_coder, warc
from weft.llm.common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_coder.token_round_trip(table(spark, sf_dir, "documents"))


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_search.quantised(table(spark, sf_dir, "embeddings"))
    return pivot_search.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_chunks.line_dedup(docs)
    return out.select("doc_id", "text", F.col("_removed").alias("n_removed"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op9_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.score(docs, model)


def op10_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(table(spark, sf_dir, "documents"))


def op11_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bwt_merge.repeats_removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256).alias("kept_sha256"))


def op12_setm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setm.collocations(table(spark, sf_dir, "documents"))


def op13_curve_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_clusters.clusters(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_pivot_search, op3_line_chunks, op4_mixing, op5_lm_score, op6_packing, op7_warc, op8_jaccard, op9_ordinal, op10_cuckoo, op11_bwt_merge, op12_setm, op13_curve_clusters, pipeline)
}

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _rounds(n: int) -> str:
    """Rounds of assigning vectors v to centroids c0 and moving these, as common tables c1 to cn."""
    return "".join(
        f"""
        a{i} AS (SELECT vec_id, v, min({{'d': list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j]))), 'c': c}}) AS b FROM v, c{i} GROUP BY vec_id, v),
        s{i} AS (SELECT b.c AS c, j, sum(x) AS s, count(*) AS n FROM (SELECT b, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY b.c, j),
        c{i + 1} AS (SELECT c, coalesce(t.m, k.m) AS m FROM c{i} AS k LEFT JOIN
            (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c) AS t USING (c)),"""
        for i in range(n)
    )


SQL = {
    "op7_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
        d AS (SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i:
            substr('{_B32}', CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS digest FROM h),
        f AS (SELECT h, min(page_id) AS first FROM h GROUP BY h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to FROM d JOIN f USING (h)""",
    "op8_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
        l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM s LEFT JOIN m ON m.x = s.doc_id""",
    "op2_pivot_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
    "op10_cuckoo": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        k AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN k USING (text_sha256)""",
    "op11_bwt_merge": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM b)),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS r FROM w),
        g AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM r WHERE r > 1),
        i AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM g),
        x AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM i GROUP BY doc_id, i),
        y AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS q FROM x),
        k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * q + 1, 2 * (a - q)), '' ORDER BY a) AS before, max(z) AS z FROM y JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)""",
    "op12_setm": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
        o AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        x AS (SELECT lang, k, phrase, f AS a, s, unnest(range(1, k)) AS c FROM (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 1)),
        y AS (SELECT x.lang, x.phrase, a, c, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS score FROM x
            JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(s[1:c], ' ') JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(s[c + 1:], ' ')),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM y),
        i AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase
            FROM (SELECT lang, f, string_split(phrase, ' ') AS s FROM f WHERE k = 3)) GROUP BY lang, phrase),
        r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE o = 1 AND (i.f IS NULL OR 100 * i.f < 50 * a))
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_curve_clusters": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16)),{_rounds(3)}
        z AS (SELECT vec_id, min({{'d': list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j]))), 'c': c}}) AS b FROM v, c3 GROUP BY vec_id)
        SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN c3 ON c = b.c""",
}
