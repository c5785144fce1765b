"""Proportional stratified interleaving: rows to shards so that every shard has the corpus's mixture.

Rows are shuffled by a seeded hash within their source and ranked there; the row of rank r of n gets the fraction (r - u) / n, with an offset u in
(0, 1) of the source's own. Sorted by fraction, all sources are spread evenly over the whole order, so equal cuts of it have equal mixtures. The
offsets of sources with equally many rows are spaced evenly, in a seeded order: together these sources step as evenly as one, and sources of one row
each don't meet at one place.

No order is ever sorted in one task. Each is cut into cells by a hash, or a fraction, that is uniform whatever the data, and a rank is the cell's
offset (a running sum over the small table of cells) plus a row number within the cell. So a source with a third of all rows, or a third of
all rows that each have their own source, is spread over as many cells as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

#: A draw is the first 15 hexadecimal digits of a digest.
DRAWS = 16**15


def _draw(*parts: Column | str | int) -> Column:
    """A hash from 0 to DRAWS - 1 that any SQL engine can repeat."""
    text = F.concat_ws(":", *(F.lit(str(x)) if isinstance(x, int) else x for x in parts))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long")


def _ranked(rows: DataFrame, by: str, cell: str, order: list[str], rank: str, of: str) -> DataFrame:
    """rows with their rank, from 1, among those with equal `by`, and how many these are. Cells ascend with the order."""
    group = W.partitionBy(by)
    cells = rows.groupBy(by, cell).agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.select(by, cell, F.sum("__n").over(group).alias(of), (F.sum("__n").over(group.orderBy(cell).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    inside = rows.withColumn("__in", F.row_number().over(W.partitionBy(by, cell).orderBy(*order)))
    return inside.join(cells, [by, cell]).withColumn(rank, F.col("__before") + F.col("__in")).drop("__before", "__in")


def interleave(docs: DataFrame, n_shards: int = 16, seed: int = 7, rows_per_cell: int = 50_000) -> DataFrame:
    """Shards 0 to n_shards - 1 for all rows; counts of shards differ by one at most.

    Returns doc_id, source, size, text_crc32, fraction, position, shard, slot.
    A null source is a source of its own. A null text has size 1 and the checksum of an empty text. A null
    doc_id is carried. Repeated rows each get a slot of their own; which of two equal rows has which slot
    can't be told. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    text = text_or_empty()
    rows = materialize(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            _draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("draw"),
        ),
        "shard-rows",
    )
    n = rows.count()
    cells = max(1, -(-n // rows_per_cell), min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    width = DRAWS // cells + 1

    sources = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    sources = sources.withColumn("turn", _draw(seed, F.col("stratum"))).withColumn("cell", F.expr(f"turn div {width}L"))
    sources = _ranked(sources, "n", "cell", ["turn", "stratum"], "nth", "alike")
    start = (_draw(seed, F.col("n").cast("string")) + F.lit(0.5)) / F.lit(float(DRAWS))
    sources = materialize(sources.select("stratum", "n", ((F.col("nth") - 1 + start) / F.col("alike")).alias("offset")), "shard-sources")

    ranked = _ranked(rows.withColumn("cell", F.expr(f"draw div {width}L")), "stratum", "cell", ["draw", "doc_id", "text_crc32", "size"], "rank", "of")
    ranked = ranked.join(sources, "stratum").withColumn("fraction", (F.col("rank") - F.col("offset")) / F.col("n"))
    ranked = ranked.withColumn("band", F.floor(F.col("fraction") * cells)).select("doc_id", "source", "stratum", "size", "text_crc32", "draw", "fraction", "band")
    ranked = materialize(ranked, "shard-ranks")
    discard(rows, sources)
    bands = ranked.groupBy("band").count()
    # one row for each rows_per_cell rows: small enough for one task
    bands = bands.select("band", (F.sum("count").over(W.orderBy("band").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("band_at"))
    in_band = W.partitionBy("band").orderBy("fraction", "stratum", "draw", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("in_band", F.row_number().over(in_band)).join(bands, "band").withColumn("position", F.col("band_at") + F.col("in_band") - 1)
    total = max(1, n)
    return placed.withColumn("shard", F.expr(f"position * {n_shards} div {total}L")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        "fraction",
        "position",
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"position - (shard * {total}L + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
    )
