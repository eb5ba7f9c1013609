"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_tree, decontaminate, fingerprint, hilbert, ngram_join, quality, surrogates, token_arrow, warc
from ._store import Scratch


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    files = warc.deduplicated_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
    records = scratch.keep(warc.read_archives(spark, files.repartition(files.count() or 1, "file")), "records")
    return warc.with_payload_bytes(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_join.ngram_components(docs, Scratch(spark, "op2"))


def op3_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, Scratch(spark, "op3"))
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_token_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_arrow.read_tokens(spark, token_arrow.write_tokens(docs, Scratch(spark, "op4")))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.document_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op5"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return surrogates.replace_entities(docs, Scratch(spark, "op6"), surrogates.key_of(spark)).select("doc_id", "text", "n_entities")


def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # a conversation whose texts look like the template
    mark = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", mark), (-1, 1, "assistant", mark)], rows.schema)
    return chat_tree.read_back(*chat_tree.build(rows.unionByName(extra), Scratch(spark, "op7")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.digest(decontaminate.find_contamination(docs, items, Scratch(spark, "op9")))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_revisits,
        op2_ngram_jaccard_join,
        op3_quality_machine,
        op4_token_arrow,
        op5_hilbert_shards,
        op6_surrogates,
        op7_chat_tree,
        op8_bpe,
        op9_decontamination,
        op10_fingerprint,
    )
}
ORACLE = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
             r AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN response <> page_id THEN response END AS refers_to
        FROM d LEFT JOIN r USING (payload_digest)
    """,
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE
          WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g, len(ws) < 5 AS short FROM w),
        n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_shingles FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.short = b.short AND a.doc_id < b.doc_id
          GROUP BY 1, 2),
        l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n_shingles + q.n_shingles - common)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, e.y FROM c JOIN e ON c.r = e.x)
        SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, m.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM c GROUP BY 1) m USING (doc_id)
    """,
    "op7_chat_tree": r"""
        WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text,
          '') AS text FROM conversations
                   UNION ALL SELECT -1, NULL, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL
                     SELECT -1, NULL, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
             e AS (SELECT *, length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS n_text,
                          length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10),
                            chr(92) || 'n')) AS n_role FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(24 + n_role + n_text) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id, alone
    """,
    "op9_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
             i AS (SELECT item_id, least(13, len(ws)) AS m, unnest(list_distinct(list_transform(range(1, len(ws) - least(13, len(ws)) + 2),
               lambda k: array_to_string(ws[k:k + least(13, len(ws)) - 1], ' ')))) AS g FROM b WHERE len(ws) > 0),
             m AS (SELECT DISTINCT m FROM i),
             p AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS k, ws FROM d, m),
             h AS (SELECT doc_id, p.m, k, item_id FROM (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS g FROM p) p
               JOIN i ON i.g = p.g AND i.m = p.m),
             c AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, m)) AS j FROM h) GROUP BY 1),
             t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items,
          '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
}
