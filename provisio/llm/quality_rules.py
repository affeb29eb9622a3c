"""Quality rules: plain counts of a text, and bands of n-gram perplexity for its language.

The model is a modified Kneser-Ney model of letters, by their UTF-8 bytes: every byte is a symbol of
its own, so no two letters, digits, signs or kinds of white space are taken for each other.  Spark
counts the runs of four symbols by language, over all texts; UTF-8 and a language's letters bound how
many there are, not the corpus.  The model holds, for each length of run, sorted arrays of codes with
log probabilities and of contexts with back-off weights, which are searched.  The shortest runs back
off to those of all languages together, so a passage in another language is unlikely, but not unheard of.

A document is rejected if one of its log perplexities lies outside its language's band: for a
symbol, for a word, and for the first symbols of words, which tells a text whose words stand in
their order from a list of them.  Bands come from exact quartiles over all documents, so what is
usual in a corpus is kept; how much wider they are for short texts, whose perplexity varies more,
is measured on the documents of each length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from provisio.llm import spread, storage
from provisio.llm.words import Texts, inside, mix, slices, windows

#: Bits of a kind, and symbols of a run.
BITS, ORDER = 6, 4

SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """Kinds of bytes: a coarser alphabet, which ``codes`` and ``KneserNey`` take by default; the rules don't use it."""
    out = np.full(256, 35, np.uint8)
    out[[0x20, 9, 11, 12, 13]] = 0
    out[10] = 1
    out[97:123] = np.arange(2, 28)
    out[65:91] = 28
    out[48:58] = 29
    out[list(SYMBOLS)] = 30
    out[list(b"|")] = 31
    out[list(b".")] = 32
    out[list(b",;:")] = 33
    out[list(b"!?")] = 34
    out[128:192] = 36 + np.arange(64) % 16
    out[192:] = 52 + np.arange(64) % 8
    return out


_CLASS = _classes()
#: The model's own symbols: every byte is one, so no two letters, digits or signs are alike.  At most 8 bits, so that ORDER of them are a 32-bit code.
BYTES, BYTE_BITS = np.arange(256, dtype=np.uint8), 8
_IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def codes(texts: Texts, symbol: np.ndarray = _CLASS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of symbols of each text, between leading spaces and a closing one; where each text's begin."""
    n = np.diff(texts.at)
    out = np.full(len(texts.data) + ORDER * len(n), symbol[0x20], np.uint32)
    out[np.arange(len(texts.data)) + np.repeat(ORDER * np.arange(len(n)) + ORDER - 1, n)] = symbol[texts.data]
    size = max(0, len(out) - ORDER + 1)
    runs = np.zeros(size, np.uint32)
    for k in range(ORDER):
        runs = runs << np.uint32(bits) | out[k : k + size]
    # runs that reach into the next text are left out: the last ones of each text
    whole = np.ones(size, bool)
    ends = texts.at[1:] + ORDER * np.arange(1, len(n) + 1)
    for d in range(1, ORDER):
        whole[(ends - d)[ends - d < size]] = False
    return runs[whole], texts.at + np.arange(len(n) + 1)


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(n, first) if len(key) else n


#: Runs that a task counts before it passes them on, about.
HELD = 1 << 21


def counted(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, code, n) of runs of bytes over all texts, combined in each task before it is shuffled; a null language is one of its own."""
    width = np.uint64(BYTE_BITS * ORDER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: dict[str | None, int] = {}
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, fresh = none, []

        def whole() -> tuple[np.ndarray, np.ndarray]:
            return _added(*(np.concatenate(x) for x in zip(held, *fresh, strict=True)))

        def told(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(name), pa.string())
            for low in range(0, len(key), 1 << 16):
                k = key[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array((k >> width).astype(np.int64))), pa.array((k & np.uint64((1 << BYTE_BITS * ORDER) - 1)).astype(np.int64)), pa.array(n[low : low + len(k)])], names=["lang", "code", "n"])

        for batch in batches:
            for part, texts in slices(batch, "text"):
                runs, at = codes(texts, BYTES, BYTE_BITS)
                lang = np.array([name.setdefault(x, len(name)) for x in part.column(0).to_pylist()], np.uint64)
                fresh.append(np.unique(np.repeat(lang << width, np.diff(at)) | runs, return_counts=True))
                if len(fresh) == 16:
                    held, fresh = whole(), []
                    if len(held[0]) > HELD:  # what is told in parts is added up by Spark
                        yield from told(*held)
                        held = none
        yield from told(*whole())

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _find(held: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and which of them are there."""
    if not len(held):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.searchsorted(held, key)
    at[at == len(held)] = 0
    return at, held[at] == key


class KneserNey:
    """Modified Kneser-Ney over symbols.  ``levels[k]``: of the runs of k + 1 symbols that were seen, the sorted
    codes and their log probabilities; of the contexts of k symbols, the sorted codes and their log back-off weights.

    ``base``: log probabilities of single symbols that the shortest runs back off to; equal ones by default.
    ``bits``: of a symbol.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, base: np.ndarray | None = None, bits: int = BITS):
        self.bits = bits
        held = [_added(code.astype(np.uint32), n.astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # shorter runs count the different symbols before them
            shorter = held[-1][0] & np.uint32((1 << bits * k) - 1)
            held.append(_added(shorter, np.ones(len(shorter))))
        self.base = np.full(1 << bits, -bits * np.log(2)) if base is None else base
        self.levels: list[tuple[np.ndarray, ...]] = []
        for k, (seen, c) in enumerate(reversed(held)):
            of = [max(1, int((c == j).sum())) for j in (1, 2, 3, 4)]
            y = of[0] / (of[0] + 2 * of[1])
            discount = np.array([0.0, *(min(j - 0.05, max(0.05, j - (j + 1) * y * of[j] / of[j - 1])) for j in (1, 2, 3))])
            taken = discount[np.minimum(c, 3).astype(int)]
            context, total = _added(seen >> np.uint32(bits), c)
            weight = _added(seen >> np.uint32(bits), taken)[1] / total
            at = np.searchsorted(context, seen >> np.uint32(bits))
            less = np.exp(self._logp(seen & np.uint32((1 << bits * k) - 1), k - 1))
            p = (c - taken) / total[at] + weight[at] * less
            self.levels.append((seen, np.log(p).astype(np.float32), context, np.log(weight).astype(np.float32)))

    def _logp(self, code: np.ndarray, k: int) -> np.ndarray:
        if k < 0:
            return self.base[code & np.uint32(len(self.base) - 1)] if len(code) else np.zeros(0)
        seen, logp, context, weight = self.levels[k]
        at, has = _find(seen, code)
        out = np.zeros(len(code))
        out[has] = logp[at[has]]
        if not has.all():
            rest = code[~has]
            back, known = _find(context, rest >> np.uint32(self.bits))
            shorter = rest & np.uint32((1 << self.bits * k) - 1) if k else rest
            out[~has] = np.where(known, weight[back] if len(weight) else 0.0, 0.0) + self._logp(shorter, k - 1)
        return out

    def logp(self, code: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each run, after the others."""
        return self._logp(code.astype(np.uint32), ORDER - 1)

    def singles(self) -> np.ndarray:
        """Log probabilities of single symbols."""
        return self._logp(np.arange(len(self.base), dtype=np.uint32), 0)


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end, first = texts.split()
    n, data = len(texts), texts.data
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    word = np.zeros(len(data) + 1, np.int8)
    word[start] += 1
    word[end] -= 1
    chars = upto((np.cumsum(word[:-1]) > 0) & ((data & 0xC0) != 0x80))
    symbols = upto(_IS_SYMBOL[data])

    # lines: between newlines and the texts' ends
    cut = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((texts.at[:-1], cut + 1)))
    of = np.searchsorted(texts.at, line_start, "right") - 1
    stops = np.sort(np.concatenate((texts.at[1:], cut)))
    # a text's last newline at its end opens an empty line that starts where the next text does
    real = np.searchsorted(start, stops) > np.searchsorted(start, line_start)
    line_start, stops, of = line_start[real], stops[real], of[real]
    key = mix(texts.hashes(line_start, stops) + mix(of.astype(np.uint64)))
    _, nth = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[nth] = False
    dup = np.bincount(of[again], minlength=n)

    at, runs = inside(first, 5)
    repeated = np.zeros(len(start) + 1, np.int64)
    if len(at):
        text_of = np.repeat(np.arange(n), runs)
        key = mix(windows(texts.hashes(start, end), 5)[at] + mix(text_of.astype(np.uint64)))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[times[back] > 1]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + 5, -1)
    covered = upto(np.cumsum(repeated[:-1]) > 0)
    return {
        "n_words": np.diff(first), "word_chars": np.diff(chars[texts.at]), "n_symbols": np.diff(symbols[texts.at]),
        "n_dup_lines": dup, "n_repeat_words": np.diff(covered[first]),
    }


MEASURES = ("symbol_log_perplexity", "log_perplexity", "start_log_perplexity")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Steps of a nat, and of a sigma, by which quartiles are told; larger numbers count as this many nats or sigmas.
STEP, MOST = 1024, 256.0


def quartiles(rows: DataFrame, by: list[str], values: dict[str, Column], step: int = STEP) -> DataFrame:
    """(by, n, and of each value a struct low, mid, high): each group's number of rows, and each value's quartiles to the step; the smallest that enough rows don't exceed."""
    told = {k: F.round(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), v)) * step).cast("int") for k, v in values.items()}
    rows = rows.select(*by, *(v.alias(k) for k, v in told.items()))
    at = lambda k, q: (F.expr(f"percentile_disc({q}) within group (order by {k})") / step)
    of = [F.struct(at(k, 0.25).alias("low"), at(k, 0.5).alias("mid"), at(k, 0.75).alias("high")).alias(k) for k in values]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *of)


def _chosen(column: Column, told: dict, of, otherwise: float) -> Column:
    """For the few lengths that there are."""
    out = F.lit(float(otherwise))
    for key, x in told.items():
        out = F.when(column.eqNullSafe(F.lit(key)), F.lit(float(of(x)))).otherwise(out)
    return out


#: Languages whose bands are sent to all tasks; more are joined by their languages.
MOST_SENT = 10_000
#: A language with one in so many of all symbols has its model sent to all tasks; texts of the others are dealt to theirs.
SHARE = 64
#: Runs of all models together that are sent to all tasks; the largest models that fit are, languages in order of their size.
SENT = 1 << 21
#: Symbols of a light language that a task scores, about.
DEALT = 1 << 28


def _with_bands(rows: DataFrame, bands: DataFrame, languages: int, total: int) -> DataFrame:
    """``rows`` with the struct ``band`` of their language."""
    key = lambda df: df.withColumns({"__none": F.col("lang").isNull(), "__lang": F.coalesce("lang", F.lit(""))})
    own = key(bands).select("__none", "__lang", F.col("n").alias("__n"), F.struct(*MEASURES).alias("band"))
    if languages <= MOST_SENT:
        out = key(rows).join(F.broadcast(own.drop("__n")), ["__none", "__lang"], "left")
    else:
        out = spread.joined(key(rows), own, ["__none", "__lang"], "__n", total, F.monotonically_increasing_id() + 1)
    return out.select(*rows.columns, "band")


class _Models(NamedTuple):
    """``base``: log probabilities of single symbols in all languages; ``heavy``: a condition on ``lang``; ``shared``: the heavy languages' models; ``large``: (lang, salts) of the light ones whose texts more than one task scores; None where all are heavy."""

    base: np.ndarray | None
    heavy: Column
    shared: Broadcast
    large: DataFrame | None


def _model(code: np.ndarray, n: np.ndarray, base: np.ndarray | None) -> KneserNey:
    return KneserNey(code, n, base, BYTE_BITS)


def _singles(pairs: pa.Table) -> pa.Table:
    """Log probabilities of single symbols, from the distinct pairs."""
    code = pairs["pair"].to_numpy()
    return pa.table({"base": pa.array([_model(code, np.ones(len(code)), None).singles().astype(np.float64).tobytes()], pa.binary())})


def _made(runs: pa.Table, base: np.ndarray | None) -> pa.Table:
    """A language's model, pickled."""
    own = _model(runs["code"].to_numpy(), runs["n"].to_numpy(), base)
    return pa.table({"lang": runs["lang"].slice(0, 1), "model": pa.array([pickle.dumps(own, pickle.HIGHEST_PROTOCOL)], pa.binary())})


def _models(runs: DataFrame) -> _Models:
    """From runs (lang, code, n)."""
    # single symbols are counted by the different ones before them: at most 256**2 pairs
    pairs = runs.select((F.col("code") % (1 << 2 * BYTE_BITS)).alias("pair")).distinct()
    found = pairs.groupBy().applyInArrow(_singles, "base binary").first()
    base = np.frombuffer(found["base"], np.float64) if found else None
    sizes = storage.written(runs.groupBy("lang").agg(F.sum("n").alias("size"), F.count("*").alias("runs")), "language-sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    heavy, room = [], SENT
    for r in sizes.where(F.col("size") * SHARE >= total).orderBy(F.desc("size"), "lang").collect():  # SHARE at most
        if r["runs"] <= room:
            heavy.append(r["lang"])
            room -= r["runs"]
    is_heavy = F.coalesce(F.col("lang").isin(*[x for x in heavy if x is not None]), F.lit(False)) | (F.col("lang").isNull() & F.lit(None in heavy))
    # made by tasks, so that the driver gets arrays for at most SENT runs, and no rows
    made = runs.where(is_heavy).groupBy("lang").applyInArrow(lambda table: _made(table, base), "lang string, model binary")
    models = {r["lang"]: pickle.loads(r["model"]) for r in made.toLocalIterator()}
    light = sizes.where(~is_heavy)
    large = light.where(F.col("size") > DEALT).select("lang", (1 + F.floor(F.col("size") / DEALT)).cast("int").alias("salts"))
    return _Models(base, is_heavy, runs.sparkSession.sparkContext.broadcast(models), None if light.isEmpty() else large)


def _scored(rows: DataFrame, runs: DataFrame, models: _Models, schema: StructType) -> DataFrame:
    """The measures of rows (id, lang, text and more), each by the model of its language.

    Models of heavy languages, of which there are SHARE at most with SENT runs, reach every task.  Those of
    light ones are sent to the tasks that hold their texts: a light language's texts are dealt to as many
    tasks as its size asks for, and each of them reads the model, then its texts, as a stream.
    """
    base, is_heavy, shared, large = models
    spark = rows.sparkSession

    def measured(part: pa.RecordBatch, texts: Texts, of: dict) -> pa.RecordBatch:
        found, (seen, at) = base_counts(texts), codes(texts, BYTES, BYTE_BITS)
        lang = part.column(1).to_pylist()
        logp = np.zeros(len(seen))
        for x in set(lang):
            its = np.repeat(np.array([y == x for y in lang]), np.diff(at))
            code, back = np.unique(seen[its], return_inverse=True)
            logp[its] = of[x].logp(code)[back]
        upto = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))[at])
        total = upto(logp)
        # first symbols of words: after white space, and none themselves
        starts = _IS_SPACE[(seen >> np.uint32(BYTE_BITS)) & np.uint32(255)] & ~_IS_SPACE[seen & np.uint32(255)]
        words = np.maximum(found["n_words"], 1)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), *(pa.array(found[k].astype(np.int64)) for k in BASE), pa.array(-total / np.maximum(np.diff(at), 1)), pa.array(-total / words), pa.array(-upto(logp * starts) / np.maximum(upto(starts), 1)), *part.columns[3:]],
            names=["id", "lang", *BASE, *MEASURES, *part.schema.names[3:]],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield measured(part, texts, shared.value)

    out = rows.where(is_heavy).mapInArrow(score, schema)
    if large is None:
        return out

    names = rows.columns

    def score_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, own = object(), None
        for batch in batches:
            kinds, langs = batch.column(batch.schema.get_field_index("kind")).to_numpy(), batch.column(batch.schema.get_field_index("lang")).to_pylist()
            texts_only = batch.select(names)
            low = 0
            for i in range(1, len(langs) + 1):
                if i < len(langs) and kinds[i] and kinds[low] and langs[i] == langs[low]:
                    continue
                if kinds[low]:
                    for part, texts in slices(texts_only.slice(low, i - low), "text"):
                        yield measured(part, texts, {lang: own})
                else:  # a model comes before its texts
                    lang = langs[low]
                    own = None  # one model at a time
                    own = _model(*(np.frombuffer(batch.column(batch.schema.get_field_index(c))[low].as_py(), k) for c, k in (("codes", np.uint32), ("counts", np.int64))), base)
                low = i

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "codes": [frame["code"].to_numpy(np.uint32).tobytes()], "counts": [frame["n"].to_numpy(np.int64).tobytes()]})

    def salted(df: DataFrame) -> DataFrame:
        """With the number of tasks that a language's texts are dealt to; DEALT symbols go to one, so few languages have more."""
        many = large.select(F.col("lang").alias("__lang"), "salts")
        return df.join(F.broadcast(many), F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang").withColumn("salts", F.coalesce("salts", F.lit(1)))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = runs.where(~is_heavy).groupBy("lang").applyInPandas(packed, "lang string, codes binary, counts binary")
    sent = salted(sent).withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "kind": F.lit(0)}).drop("salts")
    light = salted(rows.where(~is_heavy)).withColumns({"salt": F.pmod(F.xxhash64("text", "id"), F.col("salts")).cast("int"), "kind": F.lit(1)}).drop("salts")
    dealt = light.unionByName(sent, allowMissingColumns=True).repartition(parts, "lang", "salt").sortWithinPartitions("lang", "salt", "kind")
    return out.unionByName(dealt.mapInArrow(score_dealt, schema))


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False, width: float = 4.0, short: float = 18.0, least_sigma: float = 0.005, least_docs: int = 30, least_room: float = 0.2) -> DataFrame:
    """The results of ``apply_rules``; with ``whole``, also the input's rows as a struct ``row``."""
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    told = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    runs = storage.written(counted(told), "symbol-runs")
    models = _models(runs)
    schema = StructType.fromDDL(f"id {kind}, lang string, {', '.join(f'{k} long' for k in BASE)}, {', '.join(f'{k} double' for k in MEASURES)}")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = storage.written(_scored(told, runs, models, schema).withColumn("base_failed", failed), "quality-scores")
    bands = storage.written(quartiles(scored.where(~F.col("base_failed")), ["lang"], {k: F.col(k) for k in MEASURES}), "quality-bands")
    languages, total = bands.count(), scored.count()
    octave = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int")
    away, sigma = {}, {}
    for k in MEASURES:
        q = F.col("band")[k]
        sigma[k] = F.coalesce(F.greatest(least_sigma * q["mid"], (q["high"] - q["low"]) / 1.349, F.lit(1e-6)), F.lit(1.0))
        away[k] = F.col(k) - F.coalesce(q["mid"], F.lit(0.0))
    banded = _with_bands(scored, bands, languages, total)
    spreads = quartiles(banded.where(~F.col("base_failed")).withColumn("octave", octave), ["octave"], {k: away[k] / sigma[k] for k in MEASURES}, 64)
    at_length = {r["octave"]: {k: tuple(r[k]) for k in MEASURES} for r in spreads.where(F.col("n") >= least_docs).collect()}  # a row for each doubling of a length
    usual = ~F.col("base_failed")
    for k in MEASURES:
        mid, room = F.lit(0.0), F.sqrt(1 + short**2 / F.greatest(F.col("n_words"), F.lit(1)))
        if at_length:
            nearest = {o: at_length[min(at_length, key=lambda x, o=o: (abs(x - o), x))][k] for o in range(max(at_length) + 1)}
            last = nearest[max(at_length)]
            mid = _chosen(octave, nearest, lambda q: q[1], last[1])
            room = _chosen(octave, nearest, lambda q: max((q[2] - q[0]) / 1.349, least_room), max((last[2] - last[0]) / 1.349, least_room))
        usual &= F.abs(away[k] - mid * sigma[k]) <= width * sigma[k] * room
    columns = [F.col("id").alias(id_col), *BASE, "base_failed", *MEASURES, usual.alias("kept")]
    if not whole:
        return banded.select(*columns)
    # whole rows are scored again instead of being written
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    again = _scored(rows, runs, models, StructType([*schema.fields, StructField("row", rows.schema["row"].dataType)])).withColumn("base_failed", failed)
    return _with_bands(again, bands, languages, total).select(*columns, "row")


def apply_rules(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, the log perplexities (for a symbol, a word, and a word's first symbol), kept.

    A null text has no words and fails; an empty one too.  A null language is one of its own.
    Repeated rows are judged alike; an empty table gives an empty one; other columns, whatever
    their names, are not read.

    The band of a language is median +- ``width`` * sigma, sigma from the quartiles over all its
    documents that pass the base rules, and at least ``least_sigma`` times the median.  It is then
    moved and scaled for the text's length: by the median and the quartiles, in sigmas of their
    languages, of all documents of as many words up to a doubling (or of the nearest such lengths
    that have ``least_docs`` documents).  Where no length has as many, the band is wider by
    sqrt(1 + ``short``**2 / n) for a text of n words.
    """
    return judged(docs, **options)


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each judged by its own text: repeated, differing and null ids make no difference.

    The columns are those of ``docs``, whatever their names.  Of few languages nothing is shuffled for it.
    """
    return judged(docs, whole=True, **options).where("kept").select("row.*")
