"""Sharding by extendible hashing.

A directory of 2**global_depth entries maps the first global_depth bits of a
row's hash to shards; a shard of a smaller depth has several entries in a row.
A bucket over the byte limit splits on the next bit, and only such a bucket. A bucket's bytes
shrink with its depth, so where splitting ends is the least depth at which the
bucket fits; one aggregation over fine cells of the hash gives it, and a second
one over whole hashes for the few cells that are still too large. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

#: Bits of the hash: those of 15 hex digits of an MD5.
BITS = 60
#: Bits of a fine cell beyond those that shards of the limit's size would need.
_FINER = 6


def hash_bits(key: Column) -> Column:
    """60 bits of the key's MD5 as a long; null counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _fits(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cells (cell: `high` bits, bytes, least, most: hashes) -> cell, fit (depth, bytes) for those that fit at a depth in low..high.

    A bucket of one hash can't split and counts as fitting.
    """
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("bucket", F.expr(f"shiftright(cell, {high} - depth)"))
    buckets = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.min("least").alias("l"), F.max("most").alias("m")).where(f"shard_bytes <= {limit} or l = m").drop("l", "m")
    return levels.select("cell", "depth", "bucket").join(buckets, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("fit"))


def _cells(rows: DataFrame, bits: int) -> DataFrame:
    return rows.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("h").alias("least"), F.max("h").alias("most"))


def _placed(docs: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """docs -> doc_id, h, n_bytes, fit (depth, shard_bytes), global_depth for each row."""
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes")), "sizes")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(BITS, max(1, (total // limit).bit_length() + _FINER))
    cells = stored(_cells(rows, bits), "cells")
    fits = stored(_fits(cells, 0, bits, limit), "fits")
    deepest = fits.agg(F.max("fit.depth").alias("d"))
    rows = salted_join(rows.withColumn("cell", F.shiftright("h", BITS - bits)), fits, ["cell"], F.monotonically_increasing_id(), "left", 4)
    left = cells.join(fits, "cell", "left_anti").select("cell")
    if bits < BITS and not left.isEmpty():
        rest = _cells(rows.where("fit is null"), BITS)
        deep = stored(_fits(rest, bits + 1, BITS, limit).select(F.col("cell").alias("h"), F.col("fit").alias("deep")), "deep")
        deepest = deep.agg(F.max("deep.depth").alias("d"))
        rows = salted_join(rows, deep, ["h"], F.monotonically_increasing_id(), "left", 4).withColumn("fit", F.coalesce("fit", "deep"))
    return rows.withColumn("global_depth", deepest.scalar()).select("doc_id", "h", "n_bytes", "fit", "global_depth")


def _shard() -> Column:
    return F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), F.col("fit.depth"))


def sharded(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, n_bytes, depth, shard (its prefix of bits as text), shard_bytes, fits, global_depth, entry for each row.

    Rows are placed by the hash of their id, sized by their text's UTF-8 bytes
    (null has none). entry is the row's own entry of the directory, the first
    global_depth bits of its hash as a number. Every shard holds at most `limit`
    bytes, except that rows of one hash (one long text; repeated rows; equal or
    null ids) stay together: fits is false for them if they are larger. All in
    one shard of depth 0 and an empty prefix if that fits. No rows give none;
    other columns have no part.
    """
    return _placed(docs, limit, id_col, text_col).select(
        "doc_id",
        "n_bytes",
        F.col("fit.depth").cast("long").alias("depth"),
        _shard().alias("shard"),
        F.col("fit.shard_bytes").alias("shard_bytes"),
        (F.col("fit.shard_bytes") <= limit).alias("fits"),
        F.col("global_depth").cast("long").alias("global_depth"),
        F.expr(f"shiftright(h, {BITS} - global_depth)").alias("entry"),
    )


def directory(shards: DataFrame) -> DataFrame:
    """sharded's rows -> shard, depth, first_entry, last_entry (of the directory), shard_bytes, n_rows: one row for each shard that has rows."""
    first = F.expr("shiftleft(shiftright(entry, cast(global_depth - depth as int)), cast(global_depth - depth as int))")
    entries = shards.select("shard", "depth", "shard_bytes", first.alias("first_entry"), (first + F.expr("shiftleft(1L, cast(global_depth - depth as int))") - 1).alias("last_entry"))
    return entries.groupBy("shard", "depth", "first_entry", "last_entry", "shard_bytes").agg(F.count("*").alias("n_rows"))


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet under path, a folder shard=b<prefix> for each shard; docs must not have a column named shard.

    Every row is written once, repeated ones and those of null ids too: a row
    finds its shard by its hash. Rows of a shard over the limit are dealt to
    several tasks.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard")
    place = _placed(docs, limit, id_col, text_col).groupBy("h").agg(F.first("fit").alias("fit"))
    place = place.select("h", F.concat(F.lit("b"), _shard()).alias("shard"), (F.col("fit.shard_bytes") > limit).alias("large"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), hash_bits(F.col(id_col)).alias("h"))
    whole = salted_join(rows, place, ["h"], F.monotonically_increasing_id(), salts=4)
    spread = F.when(F.col("large"), F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    whole.repartition(F.col("shard"), spread).select("row.*", "shard").write.partitionBy("shard").parquet(path)
