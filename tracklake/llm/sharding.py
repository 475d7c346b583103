"""Proportional stratified interleaving of a corpus into shards.

Rows are shuffled by a seeded hash of id and text and ranked within their source; a row's
fractional rank is (rank + 1/2) / rows of the source. In the order of fractional
ranks every run of rows has the mixture of the whole, so equal cuts of that order
give shards whose sizes differ by one row at most and which match the mixture.

Both rankings are global, yet no task sorts a whole source: rows are dealt into
many equal slices of the key's range, only the slices' counts are summed up, and
each slice is ranked by itself. A source with a third of all rows is simply spread
over the slices like any other.

Defined cases: a null source is a source of its own; a null text has no bytes; null
ids, repeated rows and ties are ranked like any other row (equal rows are
interchangeable); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interleave(
    docs: DataFrame,
    n_shards: int,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = "mix-1",
    slice_rows: int = 20_000,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, source, shard, slot."""
    spark = docs.sparkSession
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    # the text's hash spreads rows that share an id or have none
    base = base.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_tie").cast("string"))))
    n = docs.count()
    slices = max(1, -(-n // slice_rows), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    key32 = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    base = base.withColumn("_slice", F.floor(key32 * F.lit(slices) / F.lit(1 << 32)).cast("long"))
    in_source = Window.partitionBy("source").orderBy("_slice")
    counts = (
        base.groupBy("source", "_slice")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            F.col("source").alias("_source"),
            F.col("_slice").alias("_s"),
            (F.sum("_c").over(in_source.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"),
            F.sum("_c").over(Window.partitionBy("source")).alias("_total"),
        )
    )
    in_slice = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "_tie")
    ranked = (
        base.join(counts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_s")))
        .withColumn("_rank", F.col("_before") + F.row_number().over(in_slice) - 1)
        .withColumn("_frac", (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_total")).cast("double"))
        .withColumn("_cut", F.floor(F.col("_frac") * slices).cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "_key", "_tie", "_frac", "_cut")
    )
    starts = (
        ranked.groupBy("_cut")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            F.col("_cut").alias("_k"),
            (F.sum("_c").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_start"),
        )
    )
    in_cut = Window.partitionBy("_cut").orderBy("_frac", "source", "_key", "doc_id", "_tie")
    at = F.col("_at")
    shard = F.expr(f"_at * {n_shards}L div {max(n, 1)}L")
    return (
        ranked.join(starts, F.col("_cut") == F.col("_k"))
        .withColumn("_at", F.col("_start") + F.row_number().over(in_cut) - 1)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", at - F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L"))
        .select("doc_id", "size", "text_crc32", "source", "shard", "slot")
    )
