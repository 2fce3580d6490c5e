"""The registered query of each operator, with production parameters over its whole table, and its SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, fingerprint, html_text, mixing, near_dedup, packing, sharding, suffix_dedup, toxicity, vector_codes, warc, whitening

def _tokenizer() -> str:
    """The vocabulary of the packing query, which is not part of the repository; a path that executors can open."""
    try:
        import public_tokenizers
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"
    return public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = os.environ.get("BYTE_BPE_TOKENIZER") or _tokenizer()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    # Nothing is learned from rows without an id, so they are held out.
    return toxicity.score_documents(docs, model).withColumn("held_out", ~F.coalesce(toxicity.training_rows(F.col("doc_id")), F.lit(False)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2, capacity=1024, with_ids=False, added=True)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_likeness(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("digest", "text_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.whole(warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A conversation whose texts try to end their own turn.
HOSTILE = (-7, r"\### Assistant: </turn> ok")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(HOSTILE[0]).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(HOSTILE[1]))
    return chat.conversation_digests(chat.format_turns(turns.union(hostile)))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), length=200)
    removed, spans = F.col("n_bytes") - F.length("kept"), F.size("spans").cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_best_fit_packing, op3_fingerprints, op4_exact_dedup, op5_mixing, op6_warc, op7_chat_formatting, op8_html_extraction, op9_minhash_near_dedup, op10_sharding,
        op11_suffix_dedup, op12_embedding_whitening, op13_vector_codes,
    )
}


def _vector_codes_sql() -> str:
    """Product codes over 64 dimensions: two rounds of nearest entries and floored means, then the codes."""

    def nearest(name: str, book: str) -> str:
        return f"""{name} AS (SELECT vec_id, part, min({{'d': (p.x[1] - b.x[1]) ** 2 + (p.x[2] - b.x[2]) ** 2 + (p.x[3] - b.x[3]) ** 2 + (p.x[4] - b.x[4]) ** 2, 'e': entry}}) AS m
  FROM p JOIN {book} b USING (part) GROUP BY vec_id, part)"""

    def means(name: str, found: str, before: str) -> str:
        floored = ", ".join(f"(sum(p.x[{i}])::BIGINT - ((sum(p.x[{i}])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)" for i in (1, 2, 3, 4))
        return f"""{name} AS (SELECT part, entry, coalesce(n.x, o.x) AS x FROM {before} o LEFT JOIN
  (SELECT part, m.e AS entry, [{floored}] AS x FROM p JOIN {found} USING (vec_id, part) GROUP BY part, m.e) n USING (part, entry))"""

    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, x[4 * part + 1 : 4 * part + 4] AS x FROM v, range(16) r(part)),
b0 AS (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64) USING (vec_id)),
{nearest("a0", "b0")},
{means("b1", "a0", "b0")},
{nearest("a1", "b1")},
{means("b2", "a1", "b1")},
{nearest("a2", "b2")},
c AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), s
"""


ORACLES = {
    "op13_vector_codes": _vector_codes_sql(),
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
-- Clamped sources are those with the least cap per weight: the first k, with k the least for which none of the rest exceeds its cap.
o AS (SELECT *, row_number() OVER r AS k, coalesce(sum(cap) OVER p, 0) AS used, sum(weight) OVER q AS free FROM w
      WINDOW r AS (ORDER BY cap / weight, source NULLS LAST), p AS (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM s),
l AS (SELECT min_by((budget - used) / free, k) FILTER (weight * (budget - used) / free <= cap) AS level, coalesce(min(k) FILTER (weight * (budget - used) / free <= cap), 1e9) AS k FROM o, b),
t AS (SELECT source, source_size, CASE WHEN o.k < l.k THEN cap ELSE weight * level END AS target FROM o, l),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, whole * size + least(greatest(round(target - whole * source_size)::BIGINT - ahead, 0), size) AS taken FROM c
""",
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
h AS (SELECT *, ('0b' || array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', sha1(html)[i])]), '')) AS bits FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN bits[3 + 5 * i + j] = '1' THEN (16 >> j) ELSE 0 END))::INT]), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM h
""",
}
