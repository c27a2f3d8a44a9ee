"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, divided by its quality weight, from a uniform number that depends
on its id, its text and the seed alone.  Within a source the documents in key order fill the
source's budget of words: complete epochs over all documents first, then the front of the order, where
the document that crosses the budget is taken in part.

The order within a source is never made in one task.  The range of a source's keys, in logarithms, is cut into cells, the
cells are summed, and the one that the budget falls into is cut again until it has ``CELL_ROWS`` rows or a single key;
only that one is put in order.  So cells don't depend on what weights there are.

Targets share the budget by source weight; a target stops at ``max_epochs`` times its source's size and
the excess goes to the others by weight.  The table of sources (a row for each) goes through the driver;
so the number of sources must stay in the thousands, as it does where weights are given by hand.

Defined results: null texts have size 0; null sources form one source, last in order; documents of size 0
are taken 0 times; documents with equal id and text share a key and are taken in one step up to the
budget; texts of any length count whole; an empty table gives no rows.  ``mix`` keeps no other columns, so none can
clash.  In ``apply_mix`` rows of equal id and text get equal shares, rounded up to a word each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._tables import written

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
#: Rows that one task puts in order.
CELL_ROWS = 20_000
#: Up to so many sources the table of their limits is broadcast; beyond, Spark joins it as it sees fit.
BROADCAST_SOURCES = 10_000


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets_of(sizes: Sequence[int], weights: Sequence[float], budget: float, max_epochs: float) -> list[float]:
    """Shares ``budget`` by weight; a share stops at ``max_epochs`` times its size, its excess is reshared."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(budget, max_epochs * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= max_epochs * sizes[i]]
        for i in full or open_:
            targets[i] = float(max_epochs * sizes[i]) if full else unit * weights[i]
            left -= targets[i] if full else 0
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return targets


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), quality: DataFrame | None = None, budget: float | None = None, max_epochs: int = 3, seed: int = 29, cells: int = CELLS) -> DataFrame:
    """``doc_id, text_crc, size, source, source_size, target, taken`` for each row of ``docs``.

    ``quality`` has ``doc_id`` and a positive ``weight``; a document without one has weight 1.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(text), F.lit(str(seed))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select("doc_id", "source", F.crc32(text).alias("text_crc"), word_count("text").alias("size"), uniform.alias("uniform"))
    if quality is not None:
        rows = rows.join(quality.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    key = -F.log("uniform") / F.coalesce("weight", F.lit(1.0))
    rows = rows.withColumn("key", key).withColumn("place", F.log("key"))
    rows = written(rows.drop("weight", "uniform"), "mix-rows")

    totals = [tuple(r) for r in rows.groupBy("source").agg(F.sum("size"), F.min("place"), F.max("place")).collect()]  # a row for each source
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in totals]
    shares = [float(weights[i % len(weights)]) for i in range(len(totals))]
    targets = targets_of(sizes, shares, sum(sizes) if budget is None else budget, max_epochs)
    plan: list[tuple] = []
    for (source, size, low, high), target in zip(totals, targets, strict=True):
        epochs = int(target // size) if size else 0
        rest = round(target - epochs * size)
        if size and rest == size:
            epochs, rest = epochs + 1, 0
        plan.append((source, size, target, epochs, rest, *((low, high, 0) if rest else (None, None, None))))
    limits = _limits(rows, plan, cells)

    limits = F.broadcast(limits) if len(plan) <= BROADCAST_SOURCES else limits
    joined = rows.join(limits.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    inside = F.coalesce(F.col("place").between(F.col("low"), F.col("high")), F.lit(False))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "text_crc").rowsBetween(Window.unboundedPreceding, -1)
    inner = joined.where(inside).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    outer = joined.where(~inside).withColumn("part", F.when(F.col("place") < F.col("low"), F.col("size")).otherwise(0))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return outer.unionByName(inner).select("doc_id", "text_crc", "size", "source", "source_size", "target", taken)


LIMITS = "source string, source_size long, target double, epochs int, rest long, low double, high double, before long"


def _limits(rows: DataFrame, plan: list[tuple], cells: int) -> DataFrame:
    """The plan with the keys between which a source's budget ends: ``low`` and ``high``, and the size ``before`` them."""
    spark, open_ = rows.sparkSession, {i for i, p in enumerate(plan) if p[5] is not None}
    while open_:
        found = spark.createDataFrame([(i, plan[i][0], *plan[i][4:]) for i in open_], "number int, of string, rest long, low double, high double, before long")
        found = F.broadcast(found) if len(open_) <= BROADCAST_SOURCES else found
        some = rows.join(found, F.col("source").eqNullSafe(F.col("of"))).where(F.col("place").between(F.col("low"), F.col("high")))
        cell = F.least(F.lit(cells - 1), F.floor(F.try_divide(F.col("place") - F.col("low"), F.col("high") - F.col("low")) * cells))
        some = some.withColumn("cell", F.coalesce(cell, F.lit(0)).cast("int"))
        sums = some.groupBy("number", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.max("rest").alias("rest"), F.max("before").alias("start"))
        upto = F.col("start") + F.sum("size").over(Window.partitionBy("number").orderBy("cell")) - F.col("size")
        hit = sums.withColumn("upto", upto).where("upto <= rest and rest < upto + size").collect()  # a row for each source
        for r in hit:
            plan[r.number] = (*plan[r.number][:5], r.low, r.high, r.upto)
        open_ = {r.number for r in hit if r.n > CELL_ROWS and r.low < r.high}
    return spark.createDataFrame(plan, LIMITS)


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; a part of a copy is a copy of its first words."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    how = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("text_crc").alias("__crc")).agg(F.max("size").alias("__size"), F.sum("taken").alias("__taken"), F.count("*").alias("__rows"))
    joined = docs.withColumn("__own", crc).join(how, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__crc")))
    share = F.ceil(F.col("__taken") / F.col("__rows"))
    copies = F.when(F.col("__size") > 0, F.ceil(share / F.greatest("__size", F.lit(1)))).otherwise(0)
    out = joined.withColumn("__copies", copies.cast("int")).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    words = F.least(F.col("__size"), share - (F.col("__copy") - 1) * F.col("__size")).cast("int")
    cut = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "), F.lit(1), words), " ")
    return out.withColumn("text", F.when(words < F.col("__size"), cut).otherwise(F.col("text"))).select(*docs.columns)
