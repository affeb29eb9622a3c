"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Statistics are computed for every whole text in one read.  The trees are grown on the driver
from a bounded sample of labelled rows (``most_rows``, a documented parameter) and are stored
flattened, as arrays of features, thresholds and values, so that a batch of rows walks down all
trees with a few numpy lookups per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm import storage
from provisio.llm.quality_rules import base_counts
from provisio.llm.words import Texts, mix, slices

FEATURES = (
    "bytes", "words", "lines", "chars_per_word", "words_per_line", "symbols", "upper", "digits", "marks", "bars", "shouts", "wide",
    "duplicate_lines", "repeated_words", "distinct_words", "same_as_previous", "capital_words", "single_letters", "longest_word", "most_common",
    "marked_words", "bar_words", "upper_words",
)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGITS = _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
_MARKS, _SYMBOLS = _flags(b".,;:!?"), _flags(b"#*$%&|<>")


def statistics(texts: Texts) -> np.ndarray:
    """One row per text and one column for each of ``FEATURES``; texts without words have zeros but for their size."""
    n, data = len(texts), texts.data
    start, end, first = texts.split()
    base = base_counts(texts)
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    of_text = lambda flags: np.diff(upto(flags)[texts.at])
    of_words = lambda flags: np.diff(upto(flags)[first])
    words = base["n_words"]
    per_byte = lambda x: x / np.maximum(np.diff(texts.at), 1)
    per_word = lambda x: x / np.maximum(words, 1)
    h = texts.hashes(start, end)
    text_of = np.repeat(np.arange(n), words)
    distinct, common, longest = np.zeros(n), np.zeros(n), np.zeros(n)
    same = np.zeros(len(h), bool)
    if len(h):
        _, at, times = np.unique(mix(h + mix(text_of.astype(np.uint64))), return_index=True, return_counts=True)
        distinct = np.bincount(text_of[at], minlength=n)
        np.maximum.at(common, text_of[at], times)
        np.maximum.at(longest, text_of, end - start)
        same[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    upper = upto(_UPPER[data])
    symbol = upto(_SYMBOLS[data])
    all_upper = (upper[end] - upper[start] >= 2) & (upper[np.minimum(start + 2, len(data))] - upper[start] >= 2)
    bar = (end - start == 1) & (data[start] == ord("|")) if len(start) else np.zeros(0, bool)
    lines = of_text(data == 10) + 1
    out = (
        np.log1p(np.diff(texts.at)), np.log1p(words), np.log1p(lines), per_word(base["word_chars"]), words / lines,
        per_byte(base["n_symbols"]), per_byte(of_text(_UPPER[data])), per_byte(of_text(_DIGITS[data])), per_byte(of_text(_MARKS[data])),
        per_byte(of_text(data == ord("|"))), per_byte(of_text(data == ord("!"))), per_byte(of_text(data >= 0xC0)),
        base["n_dup_lines"] / lines, per_word(base["n_repeat_words"]), per_word(distinct), per_word(of_words(same)),
        per_word(of_words(_UPPER[data[start]])), per_word(of_words(end - start == 1)), np.log1p(longest), per_word(common),
        per_word(of_words(symbol[end] - symbol[start] >= 3)), per_word(of_words(bar)), per_word(of_words(all_upper)),
    )
    return np.column_stack(out).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth, one row each; node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, row = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for the log loss; splits are searched on histograms of ``bins`` quantile bins."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    inner = 2**depth - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            at = node - low
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                key = at * size + binned[:, j]
                hg = np.bincount(key, g, width * size).reshape(width, size).cumsum(1)
                hh = np.bincount(key, h, width * size).reshape(width, size).cumsum(1)
                gl, hl, ga, ha = hg[:, :-1], hh[:, :-1], hg[:, -1:], hh[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                for k in np.flatnonzero(top > best):
                    best[k], feature[t, low + k], threshold[t, low + k] = top[k], j, e[cut[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[t][leaf]
    return Trees(feature, threshold, value, base)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, most_rows: int = 40_000, threshold: float = 0.7) -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 if score >= threshold).

    Learns from labelled rows whose crc32(id as text) mod ``folds`` is not ``held``: those
    ``most_rows`` with the smallest hashes of their ids, all if there are fewer.  A null text is
    empty and gets a score too; a row without an id counts as held out; repeated rows get equal
    scores; rows with a null label, or an id labelled more than once (which counts once, with its
    smallest label), never fail; without any usable label every score is 0.5.  An empty table
    gives an empty one; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                x = statistics(texts)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["id", "x"])

    measured = storage.written(docs.mapInArrow(measure, f"id {kind}, x array<float>"), "text-statistics")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    sample = measured.join(own, "id").where(fold != held).orderBy(F.xxhash64("id"), "id").select("x", "y").limit(most_rows).toPandas()
    if len(sample):
        model = fit(np.stack(sample["x"].to_numpy()).astype(np.float32), sample["y"].to_numpy(np.float64))
    else:
        model = Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["id", "score"])

    return measured.mapInArrow(score, f"id {kind}, score double").select(
        F.col("id").alias(id_col), F.coalesce(fold == held, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
