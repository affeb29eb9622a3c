"""Substring dedup by super-k-mers: words covered by a window of words that also starts earlier are removed.

The minimiser of a window is its run of ``mer`` words with the smallest hash.  Consecutive
windows that share one travel together, as one packed string, to the bucket of the minimiser;
equal windows have equal minimisers, so they meet in one bucket, where sorting finds the first
of each.

A task sends an equal super-k-mer again only if it starts before the one it has sent; the others
are decided where they are read.  So a passage that stands in a third of all texts reaches its
bucket about once for each task.  A task's strings for one bucket are compressed together.

Texts are read three times and are shuffled only if something may have to be removed from them:
those texts are recognised by a bitmap of fixed size, and joined exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm import storage
from provisio.llm.bitmap import bitmap
from provisio.llm.words import Texts, _powers, inside, mix, slices, windows

_FIELDS = (("doc", np.int64), ("text", np.int64), ("start", np.int32), ("words", np.int32), ("bytes", np.int32))


def _pack(columns: dict[str, np.ndarray], data: bytes) -> bytes:
    held = b"".join(columns[k].astype(t).tobytes() for k, t in _FIELDS)
    return len(columns["doc"]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(held + data)


def _unpack(blob: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    n, held = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:])
    out, at = {}, 0
    for k, t in _FIELDS:
        out[k] = np.frombuffer(held, t, n, at)
        at += n * np.dtype(t).itemsize
    return out, held[at:]


def packed_words(texts: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, a space after each, and where each begins."""
    n = end - start + 1
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.append(texts.data, np.uint8(32))[np.repeat(start - at[:-1], n) + np.arange(at[-1])]
    out[at[1:] - 1] = 32
    return out, at


def super_kmers(h: np.ndarray, first: np.ndarray, size: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window (by their first words) of each super-k-mer, and the minimiser's hash."""
    at, n = inside(first, size)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    mers = windows(h, mer)
    best, place = mers[at], at.copy()
    for j in range(1, size - mer + 1):
        other = mers[at + j]
        less = other < best
        best, place = np.where(less, other, best), np.where(less, at + j, place)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return at[begin], at[np.append(begin[1:], len(at)) - 1], best[begin]


class _Sent:
    """Digests of 128 bits of the super-k-mers that a task has sent, with their first places.

    They are held as sorted runs whose sizes at least double, so a new batch is looked up in few runs
    and each digest is merged a logarithmic number of times.  One whose first half is taken by another
    is sent again, which costs its bytes only.
    """

    def __init__(self):
        self.runs: list[tuple[np.ndarray, ...]] = []  # (digest, second, doc, start) by digest

    def later(self, digest: np.ndarray, second: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of these start after an equal one that was sent, or is among them; the others count as sent."""
        order = np.lexsort((start, doc, second, digest))
        new = np.ones(len(order), bool)
        new[1:] = (digest[order][1:] != digest[order][:-1]) | (second[order][1:] != second[order][:-1])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        late = np.zeros(len(order), bool)
        late[order] = (doc[head] < doc[order]) | ((doc[head] == doc[order]) & (start[head] < start[order]))
        for run in self.runs:
            at = np.searchsorted(run[0], digest)
            at[at == len(run[0])] = 0
            same = (run[0][at] == digest) & (run[1][at] == second)
            late |= same & ((run[2][at] < doc) | ((run[2][at] == doc) & (run[3][at] < start)))
        first = order[new]
        first = first[~late[first]]
        first = first[np.argsort(digest[first], kind="stable")]
        if len(first):
            self.runs.append(tuple(x[first] for x in (digest, second, doc, start)))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            last, before = self.runs.pop(), self.runs.pop()
            both = [np.concatenate(x) for x in zip(before, last, strict=True)]
            order = np.lexsort((both[3], both[2], both[1], both[0]))
            new = np.ones(len(order), bool)
            new[1:] = (both[0][order][1:] != both[0][order][:-1]) | (both[1][order][1:] != both[1][order][:-1])
            self.runs.append(tuple(x[order[new]] for x in both))
        return late


def _sent(docs: DataFrame, size: int, mer: int, buckets: int) -> DataFrame:
    """(bucket, decided, blob) of all super-k-mers."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sent, decided_to = _Sent(), TaskContext.get().partitionId() % buckets
        for batch in batches:
            for part, texts in slices(batch, "words"):
                start, end, first = texts.split()
                h = texts.hashes(start, end)
                a, z, best = super_kmers(h, first, size, mer)
                if not len(a):
                    continue
                of = np.searchsorted(first, a, "right") - 1
                doc, text = part.column(0).to_numpy()[of], part.column(1).to_numpy()[of]
                inner, words = a - first[of], z - a + size
                power, inverse = _powers(1 << max(16, int(len(h)).bit_length()))
                digests = []
                for salt in (0, 0x632BE59BD9B4E019):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)) * power[: len(h)])))
                    digests.append(mix((total[z + size] - total[a]) * inverse[a] + words.astype(np.uint64)))
                late = sent.later(*digests, doc, inner)
                rows = [(decided_to, True, _pack({"doc": doc[late], "text": text[late], "start": inner[late], "words": words[late], "bytes": words[late]}, b""))] if late.any() else []
                keep = np.flatnonzero(~late)
                bucket = (best[keep] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keep, bucket = keep[order], bucket[order]
                data, at = packed_words(texts, start, end)
                low, n = at[a[keep]], at[z[keep] + size] - at[a[keep]]
                cut = np.concatenate(([0], np.cumsum(n)))
                held = data[np.repeat(low - cut[:-1], n) + np.arange(cut[-1])].tobytes()
                for i, j in zip(b := np.flatnonzero(np.diff(bucket, prepend=-1)), np.append(b[1:], len(keep)), strict=True):
                    k = keep[i:j]
                    rows.append((int(bucket[i]), False, _pack({"doc": doc[k], "text": text[k], "start": inner[k], "words": words[k], "bytes": n[i:j]}, held[cut[i] : cut[j]])))
                if rows:
                    bucket, decided, blob = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(decided), pa.array(blob, pa.binary())], names=["bucket", "decided", "blob"])

    return docs.mapInArrow(send, "bucket int, decided boolean, blob binary")


def _word_hashes(texts: Texts, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and where each text's begin, about ``most`` bytes at a time: hashing needs many times their size."""
    hashes, counts, i = [], [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(texts.at, texts.at[i] + most, "right")) - 1)
        part = Texts(texts.data[texts.at[i] : texts.at[j]], texts.at[i : j + 1] - texts.at[i])
        start, end, first = part.split()
        hashes.append(part.hashes(start, end))
        counts.append(np.diff(first))
        i = j
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def later_windows(held: list[tuple[dict[str, np.ndarray], bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, text, start) of the windows in a bucket that also start earlier."""
    own = {k: np.concatenate([c[k] for c, _ in held]) for k, _ in _FIELDS}
    texts = Texts(np.frombuffer(b"".join(d for _, d in held), np.uint8), np.concatenate(([0], np.cumsum(own["bytes"], dtype=np.int64))))
    h, first = _word_hashes(texts)
    at, n = inside(first, size)
    of = np.repeat(np.arange(len(texts)), n)
    key = windows(h, size)[at]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    place = np.searchsorted(twice, key)
    place[place == len(twice)] = 0
    some = np.flatnonzero(twice[place] == key) if len(twice) else np.zeros(0, np.int64)
    # a second hash makes 128 bits
    key, second = key[some], windows(mix(h + np.uint64(0x632BE59BD9B4E019)), size)[at[some]]
    doc, text, start = own["doc"][of[some]], own["text"][of[some]], (own["start"][of[some]] + at[some] - first[of[some]]).astype(np.int64)
    order = np.lexsort((start, doc, second, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (second[order][1:] != second[order][:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    late = (doc[head] < doc[order]) | ((doc[head] == doc[order]) & (start[head] < start[order]))
    order = order[late]
    return doc[order], text[order], start[order]


def _spans(sent: DataFrame, size: int) -> DataFrame:
    """(doc, text, a, b): words a to b (exclusive) of a text are covered by windows that also start earlier."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def spans() -> pa.RecordBatch:
            doc, text, start = later_windows(held, size)
            order = np.lexsort((start, text, doc))
            doc, text, start = doc[order], text[order], start[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(doc))[: len(a)] - 1
            return batch_of(doc[a], text[a], start[a], start[z] + size)

        def batch_of(doc, text, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc", "text", "a", "b"])

        for batch in batches:
            for bucket, decided, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns, data = _unpack(blob)
                if decided:
                    yield batch_of(columns["doc"], columns["text"], columns["start"], columns["start"] + columns["words"])
                    continue
                if bucket != now and held:
                    yield spans()
                    held = []
                now = bucket
                held.append((columns, data))
        if held:
            yield spans()

    return sent.mapInArrow(decide, "doc long, text long, a int, b int")


def _doc(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _words(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _changed(docs: DataFrame, id_col: str, text_col: str, size: int, mer: int) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc, text, words, own_id), and (doc, text, n_removed, sha, kept) of those that lose words."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = docs.select(_doc(id_col).alias("doc"), F.xxhash64(_words(text_col)).alias("text"), _words(text_col).alias("words"), F.col(id_col).alias("own_id"))
    sent = _sent(named.select("doc", "text", "words"), size, mer, 8 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket")
    spans = storage.written(_spans(sent, size), "removed-spans")
    has = bitmap(spans, "text")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(batch.column(1).to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, last, out = text.encode("utf-8", "surrogatepass").split(), 0, []
                for a, b in sorted((x["a"], x["b"]) for x in spans):
                    if a > last:
                        out += words[last:a]
                    last = max(last, b)
                out += words[last:]
                kept.append(b" ".join(out))
                removed.append(len(words) - len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], names=["doc", "text", "n_removed", "sha", "kept"])

    by_text = spans.groupBy("doc", "text").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = named.select("doc", "text", "words").mapInArrow(some, "doc long, text long, words string").dropDuplicates(["doc", "text"])
    changed = texts.join(by_text, ["doc", "text"]).select("doc", "text", "words", "spans").mapInArrow(cut, "doc long, text long, n_removed long, sha string, kept binary")
    return named, changed


def removed_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 20, mer: int = 4) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256.

    A null text has no words; texts of fewer than ``size`` words lose nothing; a null id counts
    as smaller than any other.  Equal rows (same id and text) are one document and get equal
    results; rows of one id with different texts are told apart.  An empty table gives an empty
    one; other columns, whatever their names, are not read.
    """
    named, changed = _changed(docs, id_col, text_col, size, mer)
    kind = docs.schema[id_col].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in slices(batch, "words"):
                words = [x.as_py().split() for x in part.column(2).cast(pa.binary())]
                sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([len(w) for w in words], pa.int64()), pa.array(sha)], names=["doc", "text", "id", "n_words", "sha"])

    every = named.select("doc", "text", "words", F.col("own_id").alias("id")).mapInArrow(whole, f"doc long, text long, id {kind}, n_words long, sha string")
    return every.join(changed.select("doc", "text", "n_removed", F.col("sha").alias("new_sha")), ["doc", "text"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new_sha", "sha").alias("kept_sha256")
    )


def shortened(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 20, mer: int = 4) -> DataFrame:
    """``docs`` with shortened texts: those that lose words have the others joined by one space; all rows and columns stay, whatever their names.

    Null texts stay null, emptied ones are empty; rows that repeat an id and a text are one document
    and get the same text; a null id counts as smaller than any other.  An empty table gives an empty one.
    """
    _, changed = _changed(docs, id_col, text_col, size, mer)
    short = changed.select("doc", "text", F.col("kept").cast("string").alias("kept"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _doc(id_col).alias("doc"), F.xxhash64(_words(text_col)).alias("text"))
    rows = rows.join(short, ["doc", "text"], "left")
    own = lambda c: F.col("row").getField(c)
    return rows.select(*((F.coalesce("kept", own(c).cast("string")) if c == text_col else own(c)).alias(c) for c in docs.columns))
