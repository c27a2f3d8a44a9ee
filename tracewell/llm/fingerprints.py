"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the ascending array of the ``k`` smallest 64-bit hashes of a text's distinct shingles of
``WIDTH`` words.  Sketches of parts merge into the sketch of the whole.  Two sketches estimate resemblance
(the shared share of their union), containment (the share of one found in the other) and one sketch the
number of distinct shingles; all are exact while the sets have at most ``k`` shingles.

Defined results: a null text is empty; a text of fewer than ``WIDTH`` words has the one shingle of all its
words, one without words has an empty sketch; two empty sketches resemble each other fully, and an empty
one is contained in any; equal texts have equal sketches, so repeated rows do; a text of any length is taken
whole; an empty table gives no rows; ``with_sketch`` replaces a column of the name it is given, ``with_next``
keeps no other columns, so that none can clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WIDTH = 5
#: Documents to a block of ids, and blocks at most: beyond, blocks grow.
BLOCK_ROWS, MAX_BLOCKS = 1000, 1 << 16
SPACES = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))


def shingles(hashes: Column, width: int = WIDTH) -> Column:
    """Hashes of each ``width`` consecutive elements.  ``hashes`` must be a column of its own, not an expression."""
    each = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width)))
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), each)).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of ``text`` as column ``name``."""
    hashed = df.withColumn("__hashes", word_hashes(F.col(text)))
    return hashed.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles(F.col("__hashes"), width))), 1, k)).drop("__hashes")


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    union = merge(a, b, k)
    return union, F.size(F.array_intersect(union, F.array_intersect(a, b)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union, shared = _shared(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of ``a``'s shingles that ``b`` has too."""
    union, shared = _shared(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.coalesce(F.try_divide(shared, F.size(F.array_intersect(union, a))), F.lit(0.0)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), " ")


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Callable[[str], Column]]:
    """``doc_id, text`` in blocks of ascending ids, each closed by a copy of the first document of the next one.

    Returns the rows and a function that makes the window expression for a column's value in the next
    document (after the last document: the first).  Rows of equal id follow by a hash of their text, null
    ids come first.  The copies, one for each block, have ``tail`` 1 and must be dropped when the values have
    been taken.  Blocks end at quantiles of the ids, null ids at equal ranges of their texts' hashes, so that
    clustered ids fill blocks evenly; only rows of one id, or of one text without id, can't be parted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    first_real = min(max(1, -(-nulls // block_rows)), MAX_BLOCKS)  # blocks of null ids
    real = min(max(1, -(-(n - nulls) // block_rows)), MAX_BLOCKS)
    shares = [k / real for k in range(1, real)]
    # The bounds come from about 64 ids a block, chosen by a hash: they decide how even blocks are and nothing else.
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (64 * real)))) == 0)
    found = sorted(set(some.agg(F.percentile_approx("doc_id", shares, 8 * real)).first()[0] or [])) if shares else []
    bounds = F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>") if found else F.array().cast("array<bigint>")
    # How many bounds lie below an id, by halving steps.
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(real.bit_length()))))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    place = F.floor((F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * first_real).cast("int")
    docs = docs.withColumn("block", F.when(F.col("doc_id").isNull(), F.least(place, F.lit(first_real - 1))).otherwise(first_real + below))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("real"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie")))
    firsts = sorted((r[0], r[1].id, r[1].tie) for r in docs.groupBy("block").agg(least).toLocalIterator())  # a row for each block
    heads = docs.sparkSession.createDataFrame([(b, i, t, firsts[k - 1][0]) for k, (b, i, t) in enumerate(firsts)], "block int, first_id long, first_tie long, into int")
    is_head = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_tie"))
    tails = docs.join(F.broadcast(heads), "block").where(is_head)  # at most 2 * MAX_BLOCKS small rows
    tails = tails.select("doc_id", "text", F.col("into").alias("block"), F.lit(1).alias("tail"))
    rows = docs.select("doc_id", "text", "block", F.lit(0).alias("tail")).unionByName(tails).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("block").orderBy("tail", F.col("doc_id").asc_nulls_first(), "tie")
    return rows, lambda column: F.lead(column).over(order)
