"""Where operators read their tables and keep what must outlive a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that are sent to all tasks at most.
HEAVY = 4096
#: Bits of a bitmap of keys: 16 for each key, 32 MB at most.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28


#: Bytes of an Arrow batch of texts, some more than operators work on at once.
BATCH_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Lets rows go to Python in batches of about BATCH_BYTES. Spark counts 10,000 rows, however long: whole texts of a batch stand
    in the JVM on their way there and back, and in Python as they came and as they go."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows as a written table in the shared folder: later steps read the files, so that a lost
    executor costs no recomputation and non-deterministic steps are decided once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of kept tables, once all that was made from them is kept itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def marked(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """rows with `hit`: false only where keys, which is read twice, does not have the row's values of these columns. A bitmap
    of hashed keys is sent to all tasks; if it fills up, more rows are hit that need not be, and the join behind this
    one sorts them out."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(*names), F.lit(size))
    bits = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    # eight bytes of the bitmap are one number, so that a bit is a lookup and a shift
    words = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))
    found = rows.withColumn("at", at).withColumn("bucket", F.bitmap_bucket_number("at")).join(F.broadcast(bits.select("bucket", words.alias("words"))), "bucket", "left")
    bit = F.bitmap_bit_position("at").cast("int")
    shift = (F.lit(7) - F.shiftright(bit, 3).bitwiseAND(7)) * 8 + bit.bitwiseAND(7)
    hit = F.call_function("shiftright", F.get("words", F.shiftright(bit, 6)), shift).bitwiseAND(1) == 1
    return found.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("at", "bucket", "words")


def named(rows: DataFrame, names: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with names (keys, `times`: how many rows have them, and what they bring in). Keys of more than a HEAVY-th of
    all rows that have one are at most HEAVY: they are sent to all tasks, so that no common one gathers its rows in
    one task; the others are joined by a shuffle."""
    total = names.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    heavy, light = names.where(F.col("times") * HEAVY > total).drop("times"), names.where(F.col("times") * HEAVY <= total).drop("times")
    common = F.broadcast(heavy)
    return rows.join(common, keys).unionByName(rows.join(common.select(*keys), keys, "left_anti").join(light, keys, how), allowMissingColumns=True)


class Scratch:
    """Kept tables that are deleted together."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def kept(self, df: DataFrame, what: str) -> DataFrame:
        self.tables.append(kept(df, what))
        return self.tables[-1]

    def forget(self, *tables: DataFrame) -> None:
        """Deletes some of them earlier."""
        forget(*tables)
        self.tables = [t for t in self.tables if all(t is not x for x in tables)]

    def clear(self) -> None:
        forget(*self.tables)
        self.tables.clear()


def held_out(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))
