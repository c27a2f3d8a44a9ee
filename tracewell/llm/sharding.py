"""Two-pass external shuffle into equal shards.

Pass one scatters records uniformly into buckets of a size that one task holds in memory, by a seeded
hash of the record's key.  Pass two puts each bucket into key order and permutes it by Fisher-Yates with
a generator seeded by the bucket, so the order depends only on the rows and the seed, never on how the
input was partitioned or which attempt of a task survived.  The buckets in their order form one global
random order, which is cut into shards whose row counts differ by one at most.

Defined results: null keys and null texts are ordinary values; rows with equal keys are told apart by
their text; rows equal in both are interchangeable and share a bucket; texts of any length stay whole; an empty
table gives no rows.  Columns of the input
named ``shard`` or ``slot`` are replaced; one named ``__bucket`` is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BYTES = 24 << 20
#: Buckets at least; the number depends on the rows alone, so that a seed gives one order on any cluster.
FEW = 32
_BUCKET, _START = "__bucket", "__start"


def bucket_count(df: DataFrame, text: str, bucket_bytes: int) -> tuple[int, int]:
    """Buckets so that each holds about ``bucket_bytes``, whatever the cluster; and the number of rows."""
    total, rows = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64), F.count("*")).first()
    return max(math.ceil((total or 0) / bucket_bytes), FEW), rows


def two_pass_shuffle(df: DataFrame, shards: int, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot``, their place in the shard."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    if _BUCKET in df.columns:
        raise ValueError(f"{_BUCKET} is the name of a column that the shuffle adds")
    df = df.drop("shard", "slot")
    buckets, total = bucket_count(df, text, bucket_bytes)
    scattered = df.withColumn(_BUCKET, F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text).cast("binary"))), F.lit(buckets)).cast("int"))
    # A small row for each bucket_bytes of the input: few enough for one window over all buckets.
    before = F.sum("count").over(Window.orderBy(_BUCKET)) - F.col("count")
    offsets = scattered.groupBy(_BUCKET).count().select(_BUCKET, before.cast("long").alias(_START))
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def permuted(_key: tuple, rows: pa.Table, start: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[(key, "ascending"), (text, "ascending")]).to_numpy().copy()
        np.random.Generator(np.random.PCG64([seed, _key[0].as_py()])).shuffle(order)  # Fisher-Yates
        place = start[_START][0].as_py() + np.arange(len(order))
        shard = place * shards // total
        slot = place + (-shard * total // shards)  # the shard starts at ceil(shard * total / shards)
        rows = rows.drop_columns([_BUCKET]).take(order)
        return rows.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    return scattered.groupBy(_BUCKET).cogroup(offsets.groupBy(_BUCKET)).applyInArrow(permuted, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes each shard to a folder of its own, rows in the order of their slots."""
    (shuffled.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path))
