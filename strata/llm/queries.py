"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, crf, debruijn, fingerprint, minhash, packing, rules, sharding, suffix
from .common import read


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_shingles", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(extra), tokenizer=tokenizers.path("byte_bpe_50k.json"), pattern=tokenizers.PATTERN))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = debruijn.remove_repeated_words(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.judge(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), ranks, tokenizers.PATTERN), ranks)
    return got.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.interleave(read(spark, sf_dir, "documents"), n_shards=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix.remove_repeated_bytes(read(spark, sf_dir, "documents"), keep_first=False)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_document_fingerprints": op3_document_fingerprints,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_sharding": op8_sharding,
        "op9_byte_level_bpe": op9_byte_level_bpe,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
    }


#: A window is known by its words joined by a space, which no word has.
_OP5_SQL = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS content FROM (SELECT doc_id, words, UNNEST(range(1, len(words) - 33)) AS i FROM docs)
), repeated AS (
    SELECT content FROM windows GROUP BY content HAVING COUNT(*) > 1
), covered AS (
    SELECT DISTINCT doc_id, UNNEST(range(i, i + 35)) AS j FROM windows SEMI JOIN repeated USING (content)
), kept AS (
    SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.j) AS text, COUNT(*) AS n
    FROM (SELECT doc_id, UNNEST(words) AS word, UNNEST(range(1, len(words) + 1)) AS j FROM docs) w ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.j = c.j
    GROUP BY w.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


#: A sketch is the 256 smallest of the shingles' digests, 15 digits each; a fingerprint shows them as eight bytes each.
_OP3_SQL = r"""
WITH texts AS (
    SELECT doc_id, COALESCE(text, '') AS text, COALESCE(LEAD(text) OVER byid, CASE WHEN LEAD(doc_id) OVER byid IS NULL THEN FIRST_VALUE(text) OVER byid END, '') AS next, length(COALESCE(text, '')) AS n
    FROM documents WINDOW byid AS (ORDER BY doc_id)
), edits AS (
    SELECT *, left(text, n - n // 4) || left(next, n // 4) AS edited FROM texts
), sketched AS (
    SELECT doc_id, kind, list_sort(list_distinct(list_transform(
        CASE WHEN len(words) = 0 THEN [] ELSE list_transform(range(1, greatest(2, len(words) - 3)), lambda i: array_to_string(words[i:i + 4], ' ')) END,
        lambda x: substr(md5(x), 1, 15))))[1:256] AS s
    FROM (
        SELECT doc_id, 'own' AS kind, regexp_extract_all(text, '[^ 	-
]+') AS words FROM edits
        UNION ALL SELECT doc_id, 'edited', regexp_extract_all(edited, '[^ 	-
]+') FROM edits
        UNION ALL SELECT doc_id, 'next', regexp_extract_all(next, '[^ 	-
]+') FROM edits
    )
), wide AS (
    SELECT doc_id, ANY_VALUE(s) FILTER (kind = 'own') AS a, ANY_VALUE(s) FILTER (kind = 'edited') AS b, ANY_VALUE(s) FILTER (kind = 'next') AS c FROM sketched GROUP BY doc_id
), unions AS (
    SELECT *, list_sort(list_distinct(a || b))[1:256] AS ab, list_sort(list_distinct(a || c))[1:256] AS ac FROM wide
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
    to_base64(unhex(array_to_string(list_transform(a, lambda x: '0' || x), ''))) AS fingerprint,
    to_base64(unhex(array_to_string(list_transform(b, lambda x: '0' || x), ''))) AS edited_fingerprint,
    CASE WHEN len(ab) = 0 THEN 1 ELSE len(list_intersect(ab, list_intersect(a, b)))::DOUBLE / len(ab) END AS near_edited,
    CASE WHEN len(ac) = 0 THEN 1 ELSE len(list_intersect(ac, list_intersect(a, c)))::DOUBLE / len(ac) END AS near_next,
    CASE WHEN len(a) < 256 THEN len(a)::DOUBLE ELSE 255 / ((('0x' || a[256])::BIGINT::DOUBLE + 1) / 1152921504606846976::DOUBLE) END AS distinct_shingles
FROM edits JOIN unions USING (doc_id)
"""

#: Blobs are cut by place, so a window is the digest of 400 bytes. Kept pieces lie between the spans, and are joined as hexadecimal digits.
_OP10_SQL = """
WITH docs AS (
    SELECT doc_id, encode(COALESCE(text, '')) AS b FROM documents
), windows AS (
    SELECT doc_id, i, md5(b[i:i + 399]) AS content FROM (SELECT doc_id, b, UNNEST(range(1, octet_length(b) - 398)) AS i FROM docs)
), repeated AS (
    SELECT content FROM windows GROUP BY content HAVING COUNT(*) > 1
), hits AS (
    SELECT doc_id, i, COALESCE(i - LAG(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS new FROM windows SEMI JOIN repeated USING (content)
), spans AS (
    SELECT doc_id, MIN(i) AS a, MAX(i) + 400 AS e
    FROM (SELECT doc_id, i, SUM(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits) GROUP BY doc_id, span
), pieces AS (
    SELECT doc_id, COALESCE(LAG(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_, a AS to_ FROM spans
    UNION ALL SELECT doc_id, COALESCE(MAX(e), 1), MAX(octet_length(b)) + 1 FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
    SELECT doc_id, unhex(COALESCE(string_agg(hex(b[from_:to_ - 1]), '' ORDER BY from_) FILTER (to_ > from_), '')) AS rest FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, (octet_length(b) - octet_length(rest))::BIGINT AS n_removed, COALESCE(n, 0)::BIGINT AS n_spans, sha256(rest) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM spans GROUP BY doc_id) USING (doc_id)
"""


def _crc_step() -> str:
    """CRC-32 of one byte more, half a byte at a time, with the remainders of the sixteen half bytes."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    half = "xor({t}[({c} & 15) + 1], {c} >> 4)".replace("{t}", str(table))
    return half.replace("{c}", half.replace("{c}", "xor(c, b)"))


#: Ranks and fractions over whole windows; cells are only how tasks share the work.
_OP8_SQL = """
WITH docs AS (
    SELECT doc_id, source, COALESCE(text, '') AS text, COALESCE('=' || source, '') AS stratum FROM documents
), drawn AS (
    SELECT doc_id, source, stratum, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, {draw('7:' || COALESCE(doc_id::VARCHAR, '') || ':' || text)} AS draw,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT) AS text_crc32
    FROM docs
), sources AS (
    SELECT stratum, n, (ROW_NUMBER() OVER (PARTITION BY n ORDER BY {draw('7:' || stratum)}, stratum) - 1 + ({draw('7:' || n)} + 0.5::DOUBLE) / 1152921504606846976::DOUBLE) / COUNT(*) OVER (PARTITION BY n) AS shift
    FROM (SELECT stratum, COUNT(*) AS n FROM drawn GROUP BY stratum)
), ranked AS (
    SELECT d.*, (ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY draw, doc_id NULLS FIRST, text_crc32, size) - shift) / n AS fraction FROM drawn d JOIN sources USING (stratum)
), placed AS (
    SELECT *, ROW_NUMBER() OVER (ORDER BY fraction, stratum, draw, doc_id NULLS FIRST, text_crc32, size) - 1 AS position, COUNT(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position * 16 // total AS INT) AS shard,
    CAST(position - ((position * 16 // total) * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source, fraction
FROM placed
""".replace("{step}", _crc_step())
_OP8_SQL = re.sub(r"\{draw\((.*?)\)\}(?= AS|,| \+)", r"('0x' || substr(md5(\1), 1, 15))::BIGINT", _OP8_SQL)


def oracle_sql() -> dict[str, str]:
    """Of the other queries, models, signatures and token ids aren't expressible in SQL. They are tested against plain Python."""
    return {"op3_document_fingerprints": _OP3_SQL, "op5_substring_dedup": _OP5_SQL, "op8_sharding": _OP8_SQL, "op10_suffix_array_dedup": _OP10_SQL}
