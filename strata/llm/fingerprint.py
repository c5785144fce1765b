"""Bottom-k sketches of five-word shingles.

A document's fingerprint is the k smallest distinct hashes of its shingles, 60 bits of a digest each. The fingerprint of a
union is the k smallest of the union of fingerprints, so parts are sketched apart and merged in any order.
From two fingerprints follow resemblance and containment, from one the number of distinct shingles. With k
hashes the standard error of a resemblance r is sqrt(r (1 - r) / k); texts of k shingles or fewer are exact.
Everything is a built-in column expression, and one that any SQL engine with md5 can repeat.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, text_or_empty

SHINGLE = 5
K = 256


#: Hashes are below this, 15 hexadecimal digits.
HASHES = 16**15


def sketch(text: str, k: int = K, shingle: int = SHINGLE) -> Column:
    """Fingerprint (ascending array of longs) of a column of texts that are not null. A text of fewer words
    than a shingle has one shingle of all its words; one without words has an empty fingerprint."""
    space = SPACE_CLASS.replace("\\", "\\\\")

    def digest(words: str) -> str:  # digits of one width sort like the numbers they stand for
        return f"substring(md5(array_join({words}, ' ')), 1, 15)"

    return F.expr(
        f"""transform(array(array_remove(split(`{text}`, '{space}+'), '')), w ->
            transform(slice(sort_array(array_distinct(
                case when size(w) = 0 then array()
                     when size(w) < {shingle} then array({digest("w")})
                     else transform(sequence(1, size(w) - {shingle - 1}), i -> {digest(f"slice(w, i, {shingle})")}) end)), 1, {k}),
            x -> cast(conv(x, 16, 10) as bigint)))[0]"""
    )


def merged(sketches: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One fingerprint for each group of rows. Only a hash's smallest k ranks survive each step: values are
    first cut within salted parts of a group, so no task gathers a hot group's every hash. A null or empty fingerprint adds
    nothing, and a group of those only is left out, as an empty table gives no rows; ties and repeated rows count once."""
    salted = sketches.select(*by, F.explode(column).alias("h"), (F.abs(F.xxhash64(column)) % 64).alias("salt")).distinct()
    rank = F.row_number().over(W.partitionBy(*by, "salt").orderBy("h"))
    part = salted.withColumn("rank", rank).where(F.col("rank") <= k)
    return part.groupBy(*by).agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias(column))


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Share of common shingles among all: of the k smallest hashes of the union, those in both. Two empty
    fingerprints resemble by 1, an empty and a full one by 0."""
    return F.expr(
        f"""case when size(`{a}`) = 0 and size(`{b}`) = 0 then 1.0D
                 when size(`{a}`) = 0 or size(`{b}`) = 0 then 0.0D
                 else transform(array(slice(sort_array(array_union(`{a}`, `{b}`)), 1, {k})), u ->
                     cast(size(array_intersect(u, array_intersect(`{a}`, `{b}`))) as double) / size(u))[0] end"""
    )


def containment(a: str, b: str, k: int = K) -> Column:
    """Share of a's shingles that b has, from resemblance r and the numbers of shingles: r (A + B) / (1 + r) / A."""
    r, x, y = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(x == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (x + y) / (1 + r) / x))


def distinct_shingles(a: str, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) over the share of hash space up to the k-th."""
    kth = F.expr(f"(cast(get(`{a}`, {k - 1}) as double) + 1D) / {HASHES}D")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def as_text(a: str) -> Column:
    """A fingerprint as base64 of its hashes, eight bytes each."""
    return F.expr(f"replace(replace(base64(unhex(array_join(transform(`{a}`, h -> lpad(hex(h), 16, '0')), ''))), '\\r', ''), '\\n', '')")


#: Bytes of a part, parts of a task, and parts at most. Beyond, parts have more bytes each; Spark sorts a part on disk if it has to.
PART_BYTES, TASK_PARTS, MOST_PARTS = 4 << 20, 4, 200_000
#: What a row weighs besides its text.
ROW_BYTES = 64


def _bounds(rows: DataFrame, bytes_per_part: int, most_parts: int) -> list[dict[str, int]]:
    """Where parts of rows (at, h, text) begin, in order of at and h: after each eighth point of a sample of about eight points a part, chosen
    by hash in proportion to bytes. It only decides which task handles a row."""
    weight = F.octet_length("text") + F.lit(ROW_BYTES)
    size = rows.agg(F.sum(weight).alias("bytes"), F.min(F.struct("at", "h")).alias("least")).first()
    if not size["bytes"]:
        return []
    parts = min(most_parts, max(TASK_PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // bytes_per_part)))
    uniform = F.shiftrightunsigned(F.xxhash64("h", "at"), 11) / F.lit(float(1 << 53))
    drawn = rows.select("at", "h", F.floor(weight * F.lit(8 * parts / size["bytes"]) + uniform).alias("points")).where("points > 0")
    found = drawn.groupBy("at", "h").agg(F.sum("points").alias("points")).orderBy("at", "h").toArrow()
    least = size["least"].asDict()
    bounds, held = [least], 0
    for row in found.to_pylist():
        held += row.pop("points")
        if held >= 8 and row != least:
            bounds.append(row)
            held = 0
    return bounds


def edited_neighbours(docs: DataFrame, k: int = K, bytes_per_part: int = PART_BYTES, most_parts: int = MOST_PARTS) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, and how they resemble.

    The edited text has its last quarter of code points replaced by as many from the start of the next
    document, in order of doc_id and, for equal ids, of a hash of the text; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles.

    A null text counts as empty, a null doc_id sorts first and is carried. Repeated rows follow each other.
    An empty table gives no rows, a single row is its own next. Other columns are ignored.

    Rows are dealt by ranges of doc_id and that hash, so rows of one id needn't share a task; each range also gets the
    first document of the next range. So texts move once and no task sorts more than a range.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"), F.xxhash64(text).alias("h"), text.alias("text"))
    bounds = _bounds(rows, bytes_per_part, most_parts)
    n = max(1, len(bounds))
    # the part of a row: by halving, since there can be many bounds
    steps = max(1, n.bit_length())
    part = F.expr(
        f"""aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {n}), (s, i) ->
            if(s.hi - s.lo <= 1, s, if(get(bounds, (s.lo + s.hi) div 2) <= struct(at as at, h as h),
                named_struct('lo', cast((s.lo + s.hi) div 2 as int), 'hi', s.hi),
                named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)"""
    )
    table = F.from_json(F.lit(json.dumps(bounds)), "array<struct<at:bigint,h:bigint>>")
    dealt = (
        rows.withColumn("bounds", table)
        .withColumn("part", part)
        .withColumn("first", F.expr("get(bounds, part) <=> struct(at as at, h as h)"))
        .withColumn("to", F.expr(f"if(first, array(named_struct('part', part, 'extra', 0), named_struct('part', (part + {n - 1}) % {n}, 'extra', 1)), array(named_struct('part', part, 'extra', 0)))"))
        .select("doc_id", "at", "h", "text", F.explode("to").alias("to"))
        .select("doc_id", "at", "h", "text", "to.part", "to.extra")
        .repartition(max(1, n // TASK_PARTS), "part")
    )
    by = W.partitionBy("part").orderBy("extra", "at", "h", "text")
    near = (
        dealt.withColumn("sketch", sketch("text", k))
        .select("doc_id", "extra", "text", "sketch", F.lead(F.struct("text", "sketch")).over(by).alias("next"))
        .where("extra = 0")
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 4 as int)), left(next.text, cast(n_chars div 4 as int)))"))
        .select("doc_id", "n_chars", "edited", "sketch", F.col("next.sketch").alias("next_sketch"))
        .withColumn("edited_sketch", sketch("edited", k))
    )
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch", k).alias("near_edited"),
        resemblance("sketch", "next_sketch", k).alias("near_next"),
        distinct_shingles("sketch", k).alias("distinct_shingles"),
    )
