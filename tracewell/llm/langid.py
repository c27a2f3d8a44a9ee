"""Language identification by interpolated Kneser-Ney character models.

Words are maximal runs of letters in lower case.  Each word, opened by ``ORDER - 1`` start marks and closed
by an end mark, is a sequence of characters; a language's model gives each character a probability from the
``ORDER - 1`` before it.  The counts of the longest n-grams are gathered from all training rows by Spark;
lower orders count the distinct characters seen before an n-gram.  The models are sorted arrays of hashes, a pair for
each order: discounted shares by n-gram and back-off weights by context, an entry for each language that has the n-gram.
A text gets the language with the lowest cross-entropy per character.

A tenth of the training texts, chosen by a hash of the text, is never counted, unless its language would have
no other text; it calibrates the rest: the temperature that turns cross-entropies into a probability (the score), and for each language the
cross-entropy above which a text of ``MIN_CHARS`` or more characters is rejected as none of the languages.
The limit lies three quarters of the way from the median of the language's own texts to the median of the
same texts with the letters of each word in sorted order, so that mixed and unusual texts stay.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; training rows
without language or letter teach nothing; without any training row every text is ``und``; equal
cross-entropies go to the language first in code-point order; null ids and repeated rows are rows like others;
texts of any length are taken whole; columns named like results are replaced; an empty table gives no rows.

The models keep every n-gram of every order.  Spark derives and sorts them; the driver streams them into three
files of 14 bytes for each n-gram of a language, which Spark sends to the executors and tasks map into memory, so that only
the pages they look at take any.  Words are scored in parts of ``CELLS`` probabilities, whatever the number of languages,
and go to the sums of their texts at once.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import _words
from tracewell.llm._tables import written

ORDER = 4
START, END = "\x02", "\x03"
MIN_CHARS = 40
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: Characters of a text that count towards its score at most: later ones repeat the evidence.
EVIDENCE = 200
SLICE = 8 << 20
#: Probabilities (characters times languages) that are held at a time, which bounds a worker's memory.
CELLS = 2 << 20
PREDICTION = "lang_pred string, score double, cross_entropy double, n_letters long, rejected boolean"


def letter_words(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    lower = pc.utf8_lower(_words.one_array(texts))
    return _words.split_words(pc.replace_substring_regex(lower, r"[^\p{L}\p{M}]+", " "))


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with their marks as code points, the places of predicted characters, and each word's number of them."""
    pad = START * (ORDER - 1)
    text = "".join(f"{pad}{w}{END}" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return points, np.flatnonzero(points != ord(START)), np.fromiter((len(w) + 1 for w in words), np.int64, len(words))


def gram_keys(points: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at ``places``."""
    return _words.roll(points, n, _words.MULTIPLIERS[0])[places - n + 1] if n else np.zeros(len(places), np.uint64)


def key_of(grams: list[str]) -> np.ndarray:
    if not grams or not grams[0]:
        return np.zeros(len(grams), np.uint64)
    n = len(grams[0])
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return _words.roll(points, n, _words.MULTIPLIERS[0])[::n]


def count_ngrams(train: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, gram, n``: how often each n-gram of order ``ORDER`` occurs in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words.take_over("langid")
        for batch in batches:
            for rows in _words.slices(batch, "text", SLICE):
                bounds, codes, vocabulary = letter_words(rows["text"])
                langs = rows["lang"].combine_chunks().dictionary_encode()
                if isinstance(langs, pa.ChunkedArray):
                    langs = langs.combine_chunks()
                names, v = langs.dictionary.to_pylist(), max(len(vocabulary), 1)
                of = np.repeat(langs.indices.to_numpy(), np.diff(bounds)).astype(np.int64)
                found: dict[tuple[str, str], int] = defaultdict(int)
                words = vocabulary.to_pylist()
                pairs, times = np.unique(of * v + codes, return_counts=True)
                for k, name in enumerate(names):
                    own = pairs // v == k
                    points, places, sizes = characters([words[i] for i in pairs[own] % v])
                    if not len(places):
                        continue
                    weight = np.repeat(times[own], sizes)
                    keys, first, inverse = np.unique(gram_keys(points, places, ORDER), return_index=True, return_inverse=True)
                    total = np.bincount(inverse, weights=weight).astype(np.int64)
                    ends = places[first]
                    for e, n in zip(ends.tolist(), total.tolist(), strict=True):
                        found[name, "".join(map(chr, points[e - ORDER + 1 : e + 1].tolist()))] += n
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


#: The arrays of a model, each a list with an entry for each order, and their kinds in the files.
TABLES = ("grams", "gram_langs", "shares", "contexts", "context_langs", "backoffs")
KINDS = (np.uint64, np.uint16, np.float32)


@dataclass
class Models:
    """The models of all languages: for each order an entry for each language and n-gram, and for each language and context.

    Entries are in the order of the hashes and then of the languages; a language without an entry has the share 0, or the
    back-off weight 1.  With ``files`` the arrays lie in Spark files of these names (hashes, languages, values), ``sizes``
    entries to a table; a pickled model has only the names and maps the files again where it is read.
    """

    langs: list[str]
    floor: float
    grams: list[np.ndarray] = field(default_factory=list)
    gram_langs: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    context_langs: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    temperature: float = 0.1
    limits: dict[str, float] = field(default_factory=dict)
    files: tuple[str, ...] | None = None
    sizes: list[int] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | (dict.fromkeys(TABLES, []) if self.files else {})

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.files:
            self.map_files()

    def map_files(self) -> None:
        columns = [np.asarray(np.memmap(SparkFiles.get(name), kind, "r")) for name, kind in zip(self.files, KINDS, strict=True)]
        ends = np.cumsum(self.sizes)
        spans = [slice(end - size, end) for end, size in zip(ends, self.sizes, strict=True)]
        self.grams, self.gram_langs, self.shares = ([x[s] for s in spans[::2]] for x in columns)
        self.contexts, self.context_langs, self.backoffs = ([x[s] for s in spans[1::2]] for x in columns)

    def word_costs(self, words: list[str]) -> np.ndarray:
        """The negative log probability of each word in each language."""
        points, places, sizes = characters(words)
        costs = -np.log(self.character_probabilities(points, places), dtype=np.float64)
        return np.add.reduceat(costs, np.cumsum(sizes) - sizes, axis=0)

    def character_probabilities(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        p = np.full((len(places), len(self.langs)), self.floor, np.float32)
        for n in range(1, len(self.grams) + 1):
            k = n - 1
            p *= _rows(self.contexts[k], self.context_langs[k], self.backoffs[k], gram_keys(points, places - 1, k), 1.0, len(self.langs))
            p += _rows(self.grams[k], self.gram_langs[k], self.shares[k], gram_keys(points, places, n), 0.0, len(self.langs))
        return p

    def cross_entropies(self, texts: pa.ChunkedArray | pa.Array, scrambled: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Nats per predicted character for each text and language, and the number of characters."""
        bounds, codes, vocabulary = letter_words(texts)
        words = vocabulary.to_pylist()
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.argsort(codes, kind="stable")  # the places of each word side by side
        of, codes = of[order], codes[order]
        total = np.zeros((len(bounds) - 1, len(self.langs)))
        limit, upto = max(1, CELLS // len(self.langs)), np.cumsum(sizes)
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, side="right")))
            costs = self.word_costs(["".join(sorted(w)) for w in words[a:b]] if scrambled else words[a:b])
            x, y = np.searchsorted(codes, [a, b])
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(of[x:y], weights=costs[codes[x:y] - a, k], minlength=len(total))
            a = b
        n = np.bincount(of, weights=sizes[codes], minlength=len(total)).astype(np.int64)
        return total / np.maximum(n, 1)[:, None], n


def _rows(keys: np.ndarray, langs: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float, n_langs: int) -> np.ndarray:
    """The values of all languages for each wanted hash."""
    if not len(keys):
        return np.full((len(wanted), n_langs), missing, np.float32)
    distinct, inverse = np.unique(wanted, return_inverse=True)  # sorted probes walk the arrays in order
    start, stop = np.searchsorted(keys, distinct), np.searchsorted(keys, distinct, side="right")
    n = stop - start
    entry = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    out = np.full((len(distinct), n_langs), missing, np.float32)
    out[np.repeat(np.arange(len(distinct)), n), langs[entry]] = values[entry]
    return out[inverse]


def build_models(rows: list[tuple[str, str, int]]) -> Models:
    """Interpolated Kneser-Ney models from ``(lang, n-gram, count)``, in the memory of one process; for small tables."""
    langs = sorted({r[0] for r in rows})
    counts: list[dict[str, Counter]] = [{name: Counter() for name in langs} for _ in range(ORDER + 1)]
    for name, gram, n in rows:
        counts[ORDER][name][gram] += n
    for n in range(ORDER - 1, 0, -1):
        for name in langs:
            counts[n][name].update(g[1:] for g in counts[n + 1][name])
    alphabet = {g for name in langs for g in counts[1][name]}
    models = Models(langs, 1.0 / (len(alphabet) + 1))
    for n in range(1, ORDER + 1):
        shares: dict[tuple[str, int], float] = {}
        backoffs: dict[tuple[str, int], float] = {}
        for k, name in enumerate(langs):
            own = counts[n][name]
            n1, n2 = (sum(1 for c in own.values() if c == t) for t in (1, 2))
            discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
            totals, types = Counter(), Counter()
            for g, c in own.items():
                totals[g[:-1]] += c
                types[g[:-1]] += 1
            for g, c in own.items():
                shares[g, k] = (c - discount if c > discount else 0.0) / totals[g[:-1]]
            for context, total in totals.items():
                backoffs[context, k] = discount * types[context] / total
        for found, keys, numbers, values in ((shares, models.grams, models.gram_langs, models.shares), (backoffs, models.contexts, models.context_langs, models.backoffs)):
            hashes, of = key_of([g for g, _ in found]), np.array([k for _, k in found], np.uint16)
            order = np.lexsort((of, hashes))
            keys.append(hashes[order])
            numbers.append(of[order])
            values.append(np.array(list(found.values()), np.float32)[order])
    return models


def model_tables(counts: DataFrame) -> DataFrame:
    """``part, gram, lang, v``: the share of each n-gram (part ``2 n - 2``), and the back-off weight of each context (``2 n - 1``)."""
    parts, level = [], counts
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            level = written(level.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n")), f"grams-{n}")
        n1, n2 = (F.count(F.when(F.col("n") == t, 1)) for t in (1, 2))
        discount = F.when(n1 > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), n1 / (n1 + 2 * n2)))).otherwise(0.5)
        discounts = F.broadcast(level.groupBy("lang").agg(discount.alias("discount")))  # a row for each language
        rows = level.withColumn("context", F.substring("gram", 1, n - 1))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(discounts, "lang")
        share = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        shares = rows.join(contexts, ["lang", "context"])
        parts.append(shares.select(F.lit(2 * n - 2).alias("part"), "gram", "lang", share.alias("v")))
        parts.append(contexts.select(F.lit(2 * n - 1), "context", "lang", F.col("discount") * F.col("types") / F.col("total")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    return rows


def stored_models(counts: DataFrame) -> Models:
    """The models of ``build_models`` from a table ``lang, gram, n`` of any size, in files that tasks map."""
    spark = counts.sparkSession
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # a row for each language
    alphabet = counts.select(F.substring("gram", ORDER, 1)).distinct().count()
    models = Models(langs, 1.0 / (alphabet + 1))
    if not langs:
        return models
    number = {name: k for k, name in enumerate(langs)}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, grams = batch["part"].to_numpy(), np.array(batch["gram"].to_pylist(), object)
            keys = np.zeros(len(part), np.uint64)
            for p in np.unique(part):
                keys[part == p] = key_of(grams[part == p].tolist())
            place = (keys ^ np.uint64(1 << 63)).view(np.int64)  # signed, in the order of the hashes
            of = np.array([number[x] for x in batch["lang"].to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch["part"], pa.array(place), pa.array(of), batch["v"].cast(pa.float32())], names=["part", "place", "lang", "v"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, place, of, v = (batch[c].to_numpy() for c in ("part", "place", "lang", "v"))
            for a, b in _words.spans(part):
                columns = [place[a:b].view(np.uint64) ^ np.uint64(1 << 63), of[a:b].astype(np.uint16), v[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 1], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["part", "keys", "langs", "values"])

    rows = written(model_tables(counts).mapInArrow(keyed, "part int, place long, lang int, v float"), "model")
    folder, name = tempfile.mkdtemp(prefix="spark-"), uuid.uuid4().hex
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    models.files, models.sizes = tuple(f"{name}.{x}" for x in ("keys", "langs", "values")), [0] * (2 * ORDER)
    paths = [os.path.join(folder, file) for file in models.files]
    with open(paths[0], "wb") as keys, open(paths[1], "wb") as numbers, open(paths[2], "wb") as values:
        for r in rows.orderBy("part", "place", "lang").mapInArrow(blocks, "part int, keys binary, langs binary, values binary").toLocalIterator():  # a batch of rows at a time
            models.sizes[r.part] += len(r["keys"]) // 8
            keys.write(r["keys"])
            numbers.write(r["langs"])
            values.write(r["values"])
    for path in paths:
        spark.sparkContext.addFile(path)
    models.map_files()
    return models


def probabilities(h: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    logits = -h * temperature * np.minimum(n, EVIDENCE)[:, None]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_models(train: DataFrame, text: str = "text", lang: str = "lang") -> Models:
    """Models from the rows of ``train`` with a language; a tenth of the texts calibrates and isn't counted."""
    spark = train.sparkSession
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").withColumn("held", F.pmod(F.xxhash64("text"), F.lit(10)) == 0)
    # One pass over the texts counts both parts: the flag travels as the first character of the language.
    flagged = rows.withColumn("lang", F.concat(F.when(F.col("held"), "1").otherwise("0"), "lang"))
    both = written(count_ngrams(flagged, "text", "lang"), "grams").withColumn("held", F.substring("lang", 1, 1) == "1").withColumn("lang", F.expr("substring(lang, 2)"))
    counted = both.where("not held").select("lang", "gram", "n")
    only_held = both.where("held").join(F.broadcast(counted.select("lang").distinct()), "lang", "left_anti")  # languages: a row each
    models = stored_models(written(counted.unionByName(only_held.select("lang", "gram", "n")), "counted"))
    if not models.langs:
        return models
    shared = spark.sparkContext.broadcast(models)
    columns = [f"loss{i}" for i in range(len(TEMPERATURES))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for part in _words.slices(batch, "text", SLICE):
                h, n = found.cross_entropies(part["text"])
                truth = np.array([found.langs.index(x) if x in found.langs else -1 for x in part["lang"].to_pylist()], np.int64)
                use = (n > 0) & (truth >= 0)
                none = found.cross_entropies(part["text"], scrambled=True)[0].min(axis=1)[use]
                h, n, truth = h[use], n[use], truth[use]
                losses = [-np.log(np.maximum(probabilities(h, n, t)[np.arange(len(n)), truth], 1e-9)) if len(n) else np.empty(0) for t in TEMPERATURES]
                yield pa.RecordBatch.from_arrays([pa.array([found.langs[i] for i in truth], pa.string()), pa.array(h[np.arange(len(n)), truth]), pa.array(none), pa.array(n), *map(pa.array, losses)], names=["lang", "h", "none", "n", *columns])

    judged = rows.where("held").select("text", "lang").mapInArrow(judge, "lang string, h double, none double, n long, " + ", ".join(f"{c} double" for c in columns))
    median = lambda c: F.percentile_approx(F.when(F.col("n") >= MIN_CHARS, F.col(c)), 0.5, 10000)
    summary = judged.groupBy("lang").agg(median("h").alias("own"), median("none").alias("none"), *(F.sum(c).alias(c) for c in columns)).collect()  # a row for each language
    models.limits = {r.lang: r.own + 0.75 * max(r.none - r.own, 0.0) for r in summary if r.own is not None}
    if summary:
        models.temperature = TEMPERATURES[int(np.argmin([sum(r[c] for r in summary) for c in columns]))]
    return models


def predict(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``cross_entropy``, ``n_letters`` and ``rejected``, which replace columns of those names."""
    new = [f.split()[0] for f in PREDICTION.split(", ")]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        names = np.array([*found.langs, "und"], object)
        limits = np.array([found.limits.get(x, np.inf) for x in found.langs])
        for batch in batches:
            for part in _words.slices(batch, text, SLICE):
                if found.langs:
                    h, n = found.cross_entropies(part[text])
                    best = h.argmin(axis=1)
                    score, least = probabilities(h, n, found.temperature)[np.arange(len(n)), best], h[np.arange(len(n)), best]
                    rejected = (n >= MIN_CHARS) & (least > limits[best])
                else:
                    n = np.zeros(part.num_rows, np.int64)
                    best, score, least, rejected = n, n.astype(float), n.astype(float), n > 0
                none = n == 0
                best, score = np.where(none, len(found.langs), best), np.where(none, 0.0, score)
                table = part
                for name, values in zip(new, (pa.array(names[best], pa.string()), pa.array(score), pa.array(np.where(none, np.nan, least), mask=none), pa.array(n), pa.array(rejected | none)), strict=True):
                    table = table.append_column(name, values)
                yield from table.combine_chunks().to_batches()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(judge, ", ".join([*fields, PREDICTION]))
