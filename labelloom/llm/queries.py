"""The registered queries: each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import (
    ball_search,
    bloom_lm,
    embeddings,
    language,
    lines,
    mixing,
    ngram_join,
    packing,
    prefix_trie,
    quality,
    secrets,
    sharding,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, repeats=3).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, fold=0)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=0.8).drop("node")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_shared_lines(docs, min_docs=10, min_key=1).drop("text")


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_texts(table(spark, sf_dir, "documents"), folds=7, fold=2)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"), folds=5, fold=0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return ball_search.search(docs, items, k=10).select("item_id", "rank", "doc_id", "score")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_bloom_lm": op10_bloom_lm,
    "op11_language": op11_language,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ball_search": op13_ball_search,
}

def mixing_sql(rounds: int = mixing.ROUNDS) -> str:
    """Targets by capped shares, then per round the hashes up to which running sums stay within what is left."""
    steps = ""
    for k in range(rounds):
        steps += f"""
        e{k} AS (
            SELECT b.key, b.h, b.size, t{k}.left_over,
                   CAST(sum(b.size) OVER (PARTITION BY b.key ORDER BY b.h) AS BIGINT) AS upto
            FROM b JOIN t{k} ON b.key = t{k}.key WHERE b.h > t{k}.low AND b.size <= t{k}.left_over AND b.size > 0),
        f{k} AS (
            SELECT key, min(h) FILTER (WHERE upto > left_over) AS stop,
                   max(upto) FILTER (WHERE upto <= left_over) AS fits FROM e{k} GROUP BY key),
        t{k + 1} AS (
            SELECT t{k}.key, coalesce(f{k}.stop, CAST(1152921504606846976 AS BIGINT)) AS low,
                   t{k}.left_over - coalesce(f{k}.fits, 0) AS left_over
            FROM t{k} LEFT JOIN f{k} ON t{k}.key = f{k}.key),"""
    more = " OR ".join(f"(b.h > t{k}.low AND b.h < t{k + 1}.low AND b.size <= t{k}.left_over)" for k in range(rounds))
    joins = " ".join(f"JOIN t{k} ON b.key = t{k}.key" for k in range(rounds + 1))
    return rf"""
        WITH b AS (
            SELECT doc_id, coalesce('=' || source, '') AS key,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
            FROM documents),
        s AS (SELECT key, CAST(sum(size) AS BIGINT) AS total FROM b GROUP BY key),
        w AS (SELECT key, total, (row_number() OVER (ORDER BY key = '', key) - 1) % 3 + 1 AS weight FROM s),
        r AS (
            SELECT *, CAST(total * 3 AS DOUBLE) / weight AS ratio,
                   CAST(sum(total) OVER () AS BIGINT) AS budget, CAST(sum(weight) OVER () AS BIGINT) AS weights
            FROM w),
        v AS (
            SELECT *, CAST(budget - coalesce(CAST(sum(total * 3) OVER o AS BIGINT), 0) AS DOUBLE)
                      / (weights - coalesce(CAST(sum(weight) OVER o AS BIGINT), 0)) AS level,
                   row_number() OVER (ORDER BY ratio, key = '', key) AS place
            FROM r WINDOW o AS (ORDER BY ratio, key = '', key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        u AS (SELECT *, (SELECT arg_min(level, place) FROM v WHERE level <= ratio) AS share FROM v),
        t AS (
            SELECT key, total, CASE WHEN ratio < share THEN CAST(total * 3 AS DOUBLE) ELSE coalesce(share, 0) * weight END AS target
            FROM u),
        c AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS copies FROM t),
        t0 AS (SELECT key, CAST(-1 AS BIGINT) AS low, target - CAST(copies * total AS DOUBLE) AS left_over FROM c),{steps}
        x AS (
            SELECT b.doc_id, b.size, c.total, c.target,
                   CASE WHEN b.size > 0 THEN c.copies + CASE WHEN {more} THEN 1 ELSE 0 END ELSE 0 END AS copies
            FROM b JOIN c ON b.key = c.key {joins})
        SELECT doc_id, size, total AS source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
        FROM x"""


ORACLE = {
    "op1_mixing": mixing_sql(),
    "op9_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        k AS (
            SELECT doc_id, line, pos,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (
                       PARTITION BY conv_id
                       ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base,
                   xor(4294967295, list_reduce(
                       list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                       lambda a, x: list_reduce(
                           list_prepend(xor(a, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
                           lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (
            SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
            UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
        l AS (
            SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.own, r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS turns
            FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id),
        m AS (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS depth FROM l),
        n AS (
            SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends
            FROM m GROUP BY depth, turns[1:depth]),
        k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY path[1:depth - 1]),
        w AS (
            SELECT n.*, coalesce(k.n_children, 0) AS n_children,
                   CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * octet_length(encode(n.path[n.depth].text)) ELSE 0 END AS worth
            FROM n LEFT JOIN k ON n.path = k.path),
        u AS (SELECT path, n_children, worth, unnest(generate_series(0, depth)) AS upto FROM w),
        s AS (
            SELECT path[1:upto] AS path, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves,
                   CAST(sum(worth) AS BIGINT) AS saved_tokens
            FROM u GROUP BY path[1:upto])
        SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens,
               sha256(w.ends) AS ends_sha256
        FROM w JOIN s ON w.path = s.path LEFT JOIN n p ON w.depth > 0 AND p.path = w.path[1:w.depth - 1]""",
    "op13_ball_search": r"""
        WITH t AS (
            SELECT doc_id, rn, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT *, row_number() OVER () AS rn FROM documents)),
        f AS (SELECT doc_id, rn, term, count(*) AS tf FROM t GROUP BY doc_id, rn, term),
        d AS (SELECT rn, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY rn),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
        w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        s AS (
            SELECT q.item_id, f.rn, f.doc_id,
                   CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * d.n * c.docs) // c.terms)))) AS BIGINT) AS score
            FROM q JOIN f ON q.term = f.term JOIN w ON q.term = w.term JOIN d ON f.rn = d.rn, c
            GROUP BY q.item_id, f.rn, f.doc_id),
        r AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
            FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
