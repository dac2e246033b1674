"""Two-pass external shuffle into shards.

First pass: a seeded hash scatters the records uniformly into buckets of about ``bucket_bytes`` each,
whatever their keys or texts are. Second pass: every bucket, which fits in a task's memory, is put in
a defined order, Fisher-Yates shuffled with a generator seeded by (seed, bucket) and written. Buckets
one after another are the shuffled order; a record's place in it deals it to a shard in turn, so the
row counts of the shards differ by one at most.

The scatter hash takes in the record's place in the scan, so that equal rows, null ids or one hot key
spread like all others. A given layout of input files and a seed give the same shuffle again, also when
tasks are run anew. A null text has size 1 (no bytes, plus one) and crc32 0; an empty table gives an
empty result; other columns, of any name, travel along in one struct, ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakespark.session import discard, free_name, materialise

SEED = 20240
BUCKET_BYTES = 8 << 20
SHARDS = 16
RUN = 4096


def external_shuffle(rows: DataFrame, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, bucket, place): the rows, each as a struct, with bucket (int) and place (long, from 0 in its bucket), read from the files written."""
    size = F.coalesce(F.octet_length(F.col(f"row.`{text}`")), F.lit(0)) + 1
    held = rows.select(F.struct(*rows.columns).alias("row"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("mark"))
    total = held.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    dealt = held.withColumn("bucket", F.pmod(F.xxhash64("mark"), F.lit(buckets)).cast("int"))
    schema = T.StructType([dealt.schema["row"], dealt.schema["bucket"], T.StructField("place", T.LongType())])

    def shuffled(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("mark").to_numpy(), kind="stable")
        np.random.default_rng([seed, table.column("bucket")[0].as_py()]).shuffle(order)
        return table.select(["row", "bucket"]).take(pa.array(order)).append_column("place", pa.array(np.arange(len(order)), pa.int64()))

    return materialise(dealt.groupBy("bucket").applyInArrow(shuffled, schema), "shuffled")


def deal(shuffled: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``shard`` (int) and ``slot`` (long, gapless from 0 in the shard) in place of bucket and place of external_shuffle.

    The table of bucket sizes has a row for every ``bucket_bytes`` of input. It is summed up in runs of RUN buckets, and
    the sums of the runs in one window, of a row for every RUN * ``bucket_bytes``.
    """
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN))
    sums = counts.groupBy("run").agg(F.sum("n").alias("sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("run", F.coalesce(F.sum("sum").over(before(Window.orderBy("run"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("run").orderBy("bucket"))), F.lit(0))
    starts = counts.withColumn("own", own).join(bases, "run").select("bucket", (F.col("base") + F.col("own")).alias("start"))
    place = F.col("start") + F.col("place")
    others = [c for c in shuffled.columns if c not in ("bucket", "place")]
    return shuffled.join(starts, "bucket").select(*others, (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, **options) -> str:
    """Writes the shuffled rows as one folder for each shard, and returns the column that names it: "shard", or a free name like it.

    Within a shard the rows of a bucket stand in their shuffled order, and buckets are parts of files.
    """
    name = free_name("shard", rows)
    shuffled = external_shuffle(rows, **options)
    deal(shuffled, shards).sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    discard(shuffled)
    return name


def shard_report(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    value = F.col(f"row.`{text}`")
    digests = external_shuffle(docs.select(doc_id, text), text, **options).select(
        F.col(f"row.`{doc_id}`").alias(doc_id),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit(""))).cast("long").alias("text_crc32"),
        "bucket",
        "place",
    )
    return deal(digests, shards).select(
        doc_id, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
