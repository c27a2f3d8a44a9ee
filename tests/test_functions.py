from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracewell.functions import band_windows, eq3_grid, from_db, hash_normal, hash_uniform, l2_normalize, linear_grid, shunt_voltage, to_bin, to_db


def test_grid_ends_and_halves(spark):
    rows = {r.k: r.bin for r in eq3_grid(spark).collect()}
    assert len(rows) == 129 and rows[1] == 62 and rows[2] == 63 and rows[65] == 4000 and rows[66] == 8000 and rows[129] == 260000
    assert {r.k: r.bin for r in eq3_grid(spark, index_base=1).collect()}[65] == 4001
    lin = {r.k: r for r in linear_grid(spark).collect()}
    assert lin[65].freq_hz == 10e6 and lin[65].bin == 4000 and lin[66].freq_hz == 15e6 and abs(lin[129].freq_hz - 640e6) < 1e-3
    assert {r.k: r.bin for r in linear_grid(spark, rule="trunc").collect()}[65] == 3999


def test_windows_are_clipped(spark):
    grid = spark.createDataFrame([(1, 0), (2, 99)], "k int, bin int")
    assert [(r.lo, r.hi) for r in band_windows(grid, 5, 100).orderBy("k").collect()] == [(0, 6), (94, 100)]


def test_scalars(spark):
    df = spark.createDataFrame([([3.0, 4.0], 100.0, 0.0), ([0.0, 0.0], 1.0, 5.0)], "v array<double>, a double, b double")
    rows = df.select(l2_normalize(F.col("v")).alias("u"), to_db(F.col("a"), F.lit(10.0)).alias("db"), to_db(F.col("b"), F.lit(1.0)).alias("none"), from_db(F.lit(20.0), F.lit(2.0)).alias("amp")).collect()
    assert [round(x, 9) for x in rows[0].u] == [0.6, 0.8] and rows[1].u == [0.0, 0.0]
    assert rows[0].db == 20.0 and rows[0].none is None and rows[0].amp == 20.0
    one = df.limit(1).select(shunt_voltage(F.lit(10), F.lit(True), F.lit(True)).alias("x"), shunt_voltage(F.lit(10), F.lit(False), F.lit(True)).alias("y"), to_bin(F.lit(2e9), 2.5e9, 1000).alias("z")).first()
    assert math.isclose(one.x, 10.35) and math.isclose(one.y, 10.0) and one.z == 999


def test_hash_randoms_ignore_partitions(spark):
    df = spark.range(2000)
    draw = lambda n: {r.id: (r.u, r.z) for r in df.repartition(n).select("id", hash_uniform(F.col("id")).alias("u"), hash_normal(F.col("id")).alias("z")).collect()}
    a, b = draw(1), draw(7)
    assert a == b and all(0 < u < 1 for u, _ in a.values())
    z = [z for _, z in a.values()]
    assert abs(sum(z) / len(z)) < 0.1 and abs(sum(x * x for x in z) / len(z) - 1) < 0.1
