"""Uniform sharding by a two-pass external shuffle of whole records.

Pass one scatters the records, all columns of them, over buckets that fit in memory, by a seeded hash of id, text size and
CRC, and writes them. Pass two draws a Fisher-Yates permutation for each bucket (Spark's ``shuffle`` of an array of the
bucket's places), moves each bucket's records together once, puts them in the drawn order and writes them to their shards.
The permuted buckets one after the other are a permutation of the table; cut into equal stretches, they are shards whose
row counts differ by one at most. A task writes neighbouring buckets, so its files are stretches of one or two shards.

Only built-in expressions run here. The same seed gives the same shards and slots for the same rows, whatever the number of
executors or shuffle partitions: the permutations are drawn in tasks of a fixed number in bucket order. Only rows that
repeat both id and text are told apart by their place in the input, which also spreads them over the buckets, however many
they are.

Null and repeated ids are records like any other, each with a slot of its own, and a null text counts as empty. Long texts
make small buckets. An empty table gives no rows. Records travel as one struct, so no column name can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.session import discard, fresh_path, materialise

#: Records and bytes of text of a bucket, and bytes of text of a task of pass two.
BUCKET_ROWS, BUCKET_BYTES, TASK_BYTES = 2048, 8 << 20, 32 << 20


def _records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """record (all columns), id, size (UTF-8 bytes of the text plus one) and text_crc32."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )


def scatter(docs: DataFrame, seed: int, id_col: str, text_col: str, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """Pass one: the records with their bucket, written; the number of records and their bytes."""
    records = _records(docs, id_col, text_col)
    keys = materialise(records.select("id", "size", "text_crc32"), "shard-keys")
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-n // bucket_rows), -(-total // bucket_bytes))
    often = keys.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = materialise(often.select(F.col("id").alias("i"), F.col("size").alias("s"), F.col("text_crc32").alias("c")), "shard-repeats")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("s")) & (F.col("text_crc32") == F.col("c"))
    numbered = records.withColumn("copy", F.monotonically_increasing_id()).join(often, same, "left")
    told = numbered.withColumn("copy", F.when(F.col("s").isNotNull(), F.col("copy")).otherwise(F.lit(0).cast("long")))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id", "size", "text_crc32", "copy"), F.lit(buckets))
    out = materialise(told.select("record", "id", "size", "text_crc32", "copy", bucket.alias("bucket")), "shard-buckets")
    discard(keys, often)
    return out, n, total


def write_shards(docs: DataFrame, path: str | None = None, n_shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the records under ``shard=N`` folders of ``path`` and return them: record, size, text_crc32, slot, shard.

    ``record`` has all columns of ``docs``. Slots of a shard run from 0 without gaps, in slot order within each file.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    path = path or fresh_path(docs.sparkSession, "shards")
    buckets, n, total = scatter(docs, seed, id_col, text_col, bucket_rows, bucket_bytes)
    tasks = max(1, -(-total // TASK_BYTES))
    task = F.pmod(F.hash("bucket"), F.lit(tasks))  # where repartition() sends a bucket; tasks one after the other give the order
    counted = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("task", task)
    within = Window.partitionBy("task").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.groupBy("task").agg(F.sum("n").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = counted.select("bucket", "task", "n", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("within")).join(bases, "task")
    dealt = placed.select("bucket", "n", (F.col("base") + F.col("within")).alias("base")).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    drawn = materialise(dealt.select("bucket", "base", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("drawn")), "shard-permutations")
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("id", "size", "text_crc32", "copy")) - 1
    ranked = buckets.repartition(tasks, "bucket").withColumn("turn", turn)
    place = ranked.join(drawn, "bucket").withColumn("place", F.col("base") + F.element_at("drawn", F.col("turn") + 1))
    shard = F.expr(f"cast((place * {n_shards}) div {max(1, n)} as int)")
    slot = F.expr(f"place - (shard * cast({n} as bigint) + {n_shards - 1}) div {n_shards}")
    out = place.withColumn("shard", shard).withColumn("slot", slot).select("record", "size", "text_crc32", "slot", "shard")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    discard(buckets, drawn)
    whole = T.StructType([T.StructField("record", docs.schema), T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return docs.sparkSession.read.schema(whole).parquet(path)


def assign(docs: DataFrame, n_shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per record of the shards as written: id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    written = write_shards(docs, None, n_shards, seed, id_col, text_col, bucket_rows)
    return written.select(
        F.col("record").getField(id_col).alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
