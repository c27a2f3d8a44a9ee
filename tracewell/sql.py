"""SQL text that several queries share: the trace fixture, its spectrum and its features."""

from __future__ import annotations

from tracewell.plans.fixture import BINS, HI, LO


def uniform(key: str, place: int = 0) -> str:
    return f"((CAST(CAST('0x' || substr(md5({key}), {1 + 8 * place}, 8) AS BIGINT) AS DOUBLE) + 0.5e0) / 4294967296e0)"


def normal(key: str) -> str:
    return f"(sqrt(-2e0 * ln({uniform(key, 0)})) * cos(2e0 * pi() * {uniform(key, 1)}))"


def angle(k: str) -> str:
    return f"(2e0 * pi() * (({k} * i) % 720) / 720e0)"


TRACE = f"""
evp AS (
  SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + extract(hour FROM ts) AS BIGINT) AS h, value
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
),
evh AS MATERIALIZED (
  SELECT user_id + CAST(floor(h / 720e0) AS BIGINT) * 1000000000 AS chip, ((h % 720) + 720) % 720 AS i, sum(value) AS v FROM evp GROUP BY 1, 2
),
hrs AS (SELECT CAST(range AS BIGINT) AS i FROM range(720)),
tg AS (SELECT chip, i FROM (SELECT DISTINCT chip FROM evh) c CROSS JOIN hrs),
tr AS MATERIALIZED (
  SELECT tg.chip AS chip, CAST(tg.chip % 2 AS INTEGER) AS label, tg.i AS i,
    coalesce(v, 0e0) + 80e0 * sin{angle("40").replace(" i)", " tg.i)")} + 40e0 * sin{angle("80").replace(" i)", " tg.i)")}
    + 20e0 * sin{angle("120").replace(" i)", " tg.i)")} + 10e0 * sin{angle("160").replace(" i)", " tg.i)")}
    + (tg.chip % 2) * (25e0 * sin{angle("60").replace(" i)", " tg.i)")} + 18e0 * cos{angle("100").replace(" i)", " tg.i)")} + 12e0 * sin{angle("140").replace(" i)", " tg.i)")}) AS d
  FROM tg LEFT JOIN evh ON evh.chip = tg.chip AND evh.i = tg.i
)"""


def spectrum(bins: list[int]) -> str:
    values = ", ".join(f"({b})" for b in sorted(set(bins)))
    return f"""
bn AS (SELECT * FROM (VALUES {values}) AS t(bin)),
sp AS (
  SELECT chip, label, CAST(bin AS INTEGER) AS bin, sum(d * cos{angle("bin")}) AS re, -sum(d * sin{angle("bin")}) AS im,
    sqrt(pow(sum(d * cos{angle("bin")}), 2) + pow(sum(d * sin{angle("bin")}), 2)) AS mag
  FROM tr CROSS JOIN bn GROUP BY chip, label, bin
)"""


_MEMBERS = [(k, b) for k, (lo, hi) in enumerate(zip(LO, HI, strict=True), 1) for b in range(lo, hi)]
FEATURES = f"""{TRACE}, {spectrum([b for _, b in _MEMBERS])},
wm AS (SELECT * FROM (VALUES {", ".join(f"({k}, {b})" for k, b in _MEMBERS)}) AS t(k, bin)),
rms AS (SELECT chip, label, k, sqrt(avg(mag * mag)) AS r FROM sp JOIN wm ON sp.bin = wm.bin GROUP BY chip, label, k),
ft AS (SELECT chip, label, k, r / (sqrt(sum(r * r) OVER (PARTITION BY chip)) + 1e-12) AS v FROM rms)"""
BIN_FEATURES = f"""{TRACE}, {spectrum(BINS)},
nb AS (SELECT * FROM (VALUES {", ".join(f"({k}, {b})" for k, b in enumerate(BINS, 1))}) AS t(k, bin)),
fb AS (SELECT chip, label, k, mag / (sqrt(sum(mag * mag) OVER (PARTITION BY chip)) + 1e-12) AS v FROM sp JOIN nb ON sp.bin = nb.bin)"""
EMBEDDED = "em AS (SELECT vec_id, label, CAST(k - 1 AS INTEGER) AS k, CAST(embedding[k] AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS k FROM embeddings) z)"
