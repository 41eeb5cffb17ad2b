"""What several operators share: row keys, salted joins, shared folders."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST = -(1 << 63)
#: Entries of a part that a fold grows one by one.
_PART = 128
_POWERS = [1 << i for i in range(29, -1, -1)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where they are one machine and none is set, as in tests, one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: short lineage, and no second computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Set the session's Arrow batches to what whole texts need: few rows, few bytes; smaller settings stay.

    The default of 10,000 rows would hold them all twice for each running task,
    in the executor and in its Python worker.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving the memory that it has freed back to the system when its task ends.

    Python workers stay for later tasks, more of them than run at a time, and
    would each keep the most that any of their tasks took.
    """

    @functools.wraps(run)
    def leaning(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
            if trim:
                trim(0)

    return leaning


def lower_az(text: Column) -> Column:
    """A-Z in lower case, nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order_key(doc_id: Column | str = "doc_id") -> Column:
    """doc_id as a long without null; null sorts first."""
    return F.coalesce(F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id.cast("long"), F.lit(LOWEST))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row` (all columns of docs), `o` (its doc_id, null lowest), `k` (a hash of id and text), `text`.

    (o, k) names a document: repeated rows share it, rows that share only the
    doc_id don't. All of docs' columns hide in `row`, so that no name clashes.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        order_key(id_col).alias("o"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"),
        F.col(text_col).alias("text"),
    )


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """left joined to right (thin; repeated `salts` times), so that a hot key of left meets in many tasks."""
    many = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit(11)), F.lit(salts)).cast("int")).join(many, [*on, "_salt"], how).drop("_salt")


def among(keys: DataFrame, bits: int = 23, column: str = "k") -> Column:
    """Whether a row's `column` can be among keys' (k): a bitmap of 2**bits bits, whatever the number of keys.

    It keeps all rows whose key is there, and others by chance, so that a join
    behind it moves few rows more than it needs.
    """
    spark = keys.sparkSession
    bit = lambda k: F.pmod(k, F.lit(1 << bits))
    marks = keys.select(bit(F.col("k")).alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m"))
    words = spark.range(1 << bits - 6).select(F.col("id").alias("w")).join(marks, "w", "left").select("w", F.coalesce("m", F.lit(0).cast("long")).alias("m"))
    one = stored(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("words")), "bitmap")
    at = bit(F.col(column))
    return F.getbit(F.element_at(one.scalar(), F.floor(at / 64).cast("int") + 1), (at % 64).cast("int")) == 1


def collected(entries: Column, start: Column, kind: str, item: Callable[[Column, Column], Column], after: Callable[[Column, Column], Column]) -> Column:
    """A fold's items (of type kind), one for each entry: item(state, entry), where after(state, entry) is the next state.

    Items go into short parts, and parts into the whole. Still, a step seems to
    cost what the state holds: 16,000 items take six seconds whatever the part.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    zero = F.struct(start.alias("at"), none.alias("part"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("parts"))

    def step(a, x):
        full = F.size(a["part"]) >= _PART
        part = F.concat(F.when(full, none).otherwise(a["part"]), F.array(item(a["at"], x)))
        return F.struct(after(a["at"], x).alias("at"), part.alias("part"), F.when(full, F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"]).alias("parts"))

    return F.aggregate(entries, zero, step, lambda a: F.flatten(F.concat(a["parts"], F.array(a["part"]))))


def leading(a: Column, test: Callable[[Column], Column]) -> Column:
    """How many first entries of an array test holds for, where it holds for none after one that it doesn't hold for: a binary search."""
    bits = F.length(F.bin(F.size(a)))
    step = lambda at, p: F.when((at + p <= F.size(a)) & test(F.get(a, at + p - 1)), at + p).otherwise(at)
    return F.aggregate(F.slice(F.array(*[F.lit(p) for p in _POWERS]), -bits, bits), F.lit(0), step)


def meeting(spans: Column, x: Column) -> Column:
    """Those of spans (s, e; in order, none overlapping another) that overlap the span x."""
    first = leading(spans, lambda y: y["e"] <= x["s"])
    return F.slice(spans, first + 1, F.greatest(leading(spans, lambda y: y["s"] < x["e"]) - first, F.lit(0)))
