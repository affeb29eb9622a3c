"""SentencePiece encoding and decoding by suffix-array matching.

A batch's new chunks are concatenated and indexed by a suffix array; each piece is searched for
by binary search, and its range gives all places where it occurs.  These edges (start, end, piece)
are sorted by position and relaxed.

What a file asks for is read from it; its normaliser is the library's, as a table of characters.

* Unigram files: texts are indexed whole.  Edges are relaxed from left to right: a path's score is
  the sum of its pieces' scores, in single precision as the library adds them, and the first best
  path to each place stays.  A character that no piece covers alone is an unknown edge.
* BPE files: their result is not the path with the best sum of scores, so relaxing follows the
  merges: in each round the best edge that spans two neighbouring symbols of a chunk joins them,
  the leftmost of equals, until none is left.  Chunks (a word with the spaces before it) never join,
  as no piece has a space after another character; so a batch's text is indexed as its distinct
  chunks, and equal chunks are encoded once and remembered.  Long chunks, such as texts without
  spaces, join their symbols from a queue instead of in rounds over all of them.

Refused, with an error: other kinds of model, user-defined or unused pieces, white space as a
suffix or not escaped, a denormaliser, and BPE files with a space inside a piece.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm.words import slices, strings, trim

SPACE = "▁"
#: Bytes of chunks indexed at once, leading bytes that suffixes are sorted by, chunks remembered.
INDEX_BYTES, KEY, MOST_CHUNKS = 1 << 18, 8, 600_000
#: Symbols of a chunk from which on its joins wait in queues; the result is the same.
LONG_CHUNK = 400


def _keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 16 bytes as two numbers that sort like them."""
    halves = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    return halves[:, 0], halves[:, 1]


class Pieces:
    """Byte strings to search for: the least and greatest first key of what starts with each, and what its second key must be."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.length = texts, np.array([len(t) for t in texts])
        bytes_of = lambda fill: np.frombuffer(b"".join(t[: 2 * KEY].ljust(2 * KEY, fill) for t in texts), np.uint8).reshape(-1, 2 * KEY)
        self.low, self.second = _keys(bytes_of(b"\0"))
        self.high = _keys(bytes_of(b"\xff"))[0]
        # bits of the second key that the piece fills
        inner = np.arange(KEY, 2 * KEY)[None, :] < self.length[:, None]
        self.mask = _keys(np.where(np.concatenate((inner, inner), 1), 255, 0).astype(np.uint8))[1]


class SuffixArray:
    """Suffixes in the order of their first ``KEY`` bytes; what is longer is compared where it matters."""

    def __init__(self, data: bytes):
        self.data = data
        padded = np.frombuffer(data + b"\0" * 2 * KEY, np.uint8)
        first, self.second = _keys(np.lib.stride_tricks.sliding_window_view(padded, 2 * KEY)[: len(data)])
        self.order = np.argsort(first)
        self.keys = first[self.order]

    def edges(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(start << 32 | end, piece) of all occurrences, by position."""
        low, high = np.searchsorted(self.keys, pieces.low, "left"), np.searchsorted(self.keys, pieces.high, "right")
        n = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(n)), n)
        at = self.order[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        length = pieces.length[piece]
        fine = (length <= KEY) | (self.second[at] & pieces.mask[piece] == pieces.second[piece])
        for i in np.flatnonzero(fine & (length > 2 * KEY)):
            fine[i] = self.data[at[i] : at[i] + length[i]] == pieces.texts[piece[i]]
        edge, piece = (at << 32 | (at + length))[fine], piece[fine]
        order = np.argsort(edge)
        return edge[order], piece[order]


class Codec:
    """A model file's pieces, ``encode`` for many texts and ``decode``."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        kind, norm, trained = sentencepiece_model_pb2.ModelProto.SentencePiece, proto.normalizer_spec, proto.trainer_spec
        types = [p.type for p in proto.pieces]
        self.pieces = [p.piece for p in proto.pieces]
        ids = range(len(self.pieces))
        self.unigram = trained.model_type == sentencepiece_model_pb2.TrainerSpec.UNIGRAM
        if not self.unigram and trained.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
            raise ValueError("only Unigram and BPE models are supported")
        if {kind.USER_DEFINED, kind.UNUSED} & set(types):
            raise ValueError("user-defined and unused pieces are not supported")
        if trained.treat_whitespace_as_suffix or not norm.escape_whitespaces or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("white space as a suffix or not escaped, and denormalisers, are not supported")
        self.unknown = next((i for i in ids if types[i] == kind.UNKNOWN), None)
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in ids if types[i] == kind.BYTE}
        if self.byte_id and len(self.byte_id) != 256:
            raise ValueError("some bytes have no piece")
        self.prefix = norm.add_dummy_prefix or norm.remove_extra_whitespaces
        plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        self.normalised = (lambda t: SPACE + t.replace(" ", SPACE) if t else "") if plain else model.normalize
        normal = [i for i in ids if types[i] == kind.NORMAL]
        scores = {i: proto.pieces[i].score for i in normal}
        if not self.unigram:
            if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
                raise ValueError("BPE models with a space inside a piece are not supported")
            # by merge rank; characters come last in such files and are found like all others
            normal.sort(key=lambda i: (-scores[i], i))
        self.ids, self.texts = np.array(normal, np.int64), [self.pieces[i].encode() for i in normal]
        self.scores = np.array([scores[i] for i in normal], np.float32)
        # merges of equal scores have one rank, and the leftmost goes first
        self.rank = np.append(np.unique(-self.scores, return_inverse=True)[1], len(normal))
        self.search = Pieces(self.texts)
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], "<u4") if self.byte_id else None
        # what each id decodes to
        self.hidden = {i for i in ids if types[i] == kind.CONTROL}
        self.plain = [b"" if i in self.hidden else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        if self.unknown is not None:
            self.plain[self.unknown] = trained.unk_surface.encode()
        for byte, i in self.byte_id.items():
            self.plain[i] = bytes([byte])
        self.seen: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", self.normalised(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        if self.unigram:
            return self._encode_paths([self.normalised(t) for t in texts])
        parts = [self.chunks(t) for t in texts]
        if len(self.seen) > MOST_CHUNKS:
            self.seen = {}
        new = list(set().union(*parts).difference(self.seen))
        i = 0
        while i < len(new):
            j, size = i, 0
            while j < len(new) and (j == i or size < INDEX_BYTES):
                size += len(new[j]) + 4
                j += 1
            self.seen |= self._encode_chunks(new[i:j])
            i = j
        out = [b"".join(map(self.seen.__getitem__, p)) for p in parts]
        return out if self.byte_id else [self._one_unknown(x) for x in out]

    def _one_unknown(self, ids: bytes) -> bytes:
        """Neighbouring unknown ids are one."""
        x = np.frombuffer(ids, "<u4")
        again = np.zeros(len(x), bool)
        again[1:] = (x[1:] == self.unknown) & (x[:-1] == self.unknown)
        return x[~again].tobytes()

    def _encode_paths(self, texts: list[str]) -> list[bytes]:
        """Best paths of normalised texts, some at a time."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < INDEX_BYTES):
                size += len(texts[j]) + 4
                j += 1
            out += self._best_paths(texts[i:j])
            i = j
        return out

    def _best_paths(self, texts: list[str]) -> list[bytes]:
        held = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\0".join(held)
        size = np.array([len(h) for h in held])
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        if not size.sum():
            return [b""] * len(texts)
        edge, piece = SuffixArray(data).edges(self.search)
        raw = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(data) + 1, bool)
        inside[np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] = True
        char = np.flatnonzero(inside[:-1] & ((raw & 0xC0) != 0x80))
        # a character's end is the next one's start, or the text's end
        stop = np.append(char[1:], 0)
        last = np.searchsorted(char, begin + size) - 1
        last = last[size > 0]
        stop[last] = (begin + size)[size > 0]
        key = char << 32 | stop
        at = np.searchsorted(edge, key)
        at[at == len(edge)] = 0
        alone = char[edge[at] != key] if len(edge) else char
        unknown = (alone << 32 | stop[np.searchsorted(char, alone)])
        # unknown edges are sorted in, with no piece
        order = np.argsort(np.concatenate((edge, unknown)), kind="stable")
        edge, piece = np.concatenate((edge, unknown))[order], np.concatenate((piece, np.full(len(unknown), -1)))[order]
        start, end = edge >> 32, edge & 0xFFFFFFFF
        least = np.float32(self.scores.min() - np.float32(10)) if len(self.scores) else np.float32(-10)
        score = np.where(piece >= 0, self.scores[piece], least).astype(np.float32)
        best, back = np.full(len(data) + 1, -np.inf, np.float32), np.full(len(data) + 1, -1)
        best[begin] = 0
        # relaxed by their starts' distances from the texts' starts, all texts at once
        away = start - begin[np.searchsorted(begin, start, "right") - 1]
        order = np.argsort(away, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(away[order]) != 0))
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            e = order[a:b]
            told = best[start[e]] + score[e]
            better = told > best[end[e]]
            best[end[e[better]]] = told[better]
            back[end[e[better]]] = e[better]
        out = []
        for t in range(len(texts)):
            path, place = [], int(begin[t] + size[t])
            while place > begin[t]:
                e = int(back[place])
                path.append(e)
                place = int(start[e])
            path = np.array(path[::-1], np.int64)
            own = piece[path] if len(path) else np.zeros(0, np.int64)
            if self.byte_ids is None:
                found = np.where(own >= 0, self.ids[own], self.unknown if self.unknown is not None else 0).astype("<u4") if len(own) else np.zeros(0, "<u4")
                out.append(self._one_unknown(found.tobytes()))
            else:
                out.append(b"".join(self.byte_ids[raw[start[e] : end[e]]].tobytes() if p < 0 else self.ids[p].astype("<u4").tobytes() for e, p in zip(path, own, strict=True)))
        return out

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        held = [c.encode("utf-8", "surrogatepass") for c in chunks]
        data = b"\0".join(held)
        edge, piece = SuffixArray(data).edges(self.search)
        # symbols: characters at first; ``stop`` is a chunk's end
        size = np.array([len(h) for h in held])
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        raw = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(data), bool)
        inside[np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] = True
        start = np.flatnonzero(inside & ((raw & 0xC0) != 0x80))
        stop = np.zeros(len(start), np.int64)
        chunk = np.searchsorted(begin, start, "right") - 1
        stop[:-1] = start[1:]
        last = np.append(chunk[1:] != chunk[:-1], True)
        stop[last] = (begin + size)[chunk[last]]
        no = len(self.texts)

        def piece_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << 32 | b
            i = np.searchsorted(edge, key)
            i[i == len(edge)] = 0
            return np.where(edge[i] == key, piece[i], no) if len(edge) else np.full(len(key), no)

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return self.rank[piece_of(a, b)]

        done = [(start[:0], stop[:0], chunk[:0])]
        joined = np.append(rank_of(start[:-1], stop[1:]), no) if len(start) else np.zeros(0, int)
        joined[last] = no
        n_symbols = np.bincount(chunk, minlength=len(chunks))
        for c in np.flatnonzero(n_symbols > LONG_CHUNK):
            own = slice(*np.searchsorted(chunk, (c, c + 1)))
            left, right = self._join_long(start[own], stop[own], joined[own], edge, piece)
            done.append((left, right, np.full(len(left), c)))
        if (n_symbols > LONG_CHUNK).any():
            short = n_symbols[chunk] <= LONG_CHUNK
            start, stop, chunk, joined = start[short], stop[short], chunk[short], joined[short]
        while len(start):
            # the best join of each chunk; chunks without one are done
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            best = np.minimum.reduceat(joined << 32 | np.arange(len(start)), first)
            live = (best >> 32) < no
            keep = np.repeat(live, np.diff(first, append=len(start)))
            if not live.all():
                done.append((start[~keep], stop[~keep], chunk[~keep]))
            # the place of the best join moves as symbols of finished chunks leave
            where = np.cumsum(keep) - 1
            i = where[best[live] & 0xFFFFFFFF]
            start, stop, chunk, joined = start[keep], stop[keep], chunk[keep], joined[keep]
            if not len(start):
                break
            stop[i] = stop[i + 1]
            stays = np.ones(len(start), bool)
            stays[i + 1] = False
            where = np.cumsum(stays) - 1
            i = where[i]
            start, stop, chunk, joined = start[stays], stop[stays], chunk[stays], joined[stays]
            for k in (i - 1, i):
                k = k[k >= 0]
                ok = np.minimum(k + 1, len(start) - 1)
                both = (chunk[k] == chunk[ok]) & (ok > k)
                joined[k] = np.where(both, rank_of(start[k], stop[ok]), no)
        start, stop, chunk = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((start, chunk))
        start, stop, chunk = start[order], stop[order], chunk[order]
        found = piece_of(start, stop)
        # characters that are no pieces become their bytes, or unknown
        missing = found == no
        n = np.where(missing & bool(self.byte_id), stop - start, 1)
        place = np.concatenate(([0], np.cumsum(n)))
        flat = np.repeat(self.ids[np.minimum(found, no - 1)].astype("<u4"), n)
        if missing.any() and not self.byte_id:
            flat[missing] = self.unknown
        elif missing.any():
            m = n[missing]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            flat[np.repeat(place[:-1][missing], m) + inner] = self.byte_ids[raw[np.repeat(start[missing], m) + inner]]
        cut = (4 * place[np.searchsorted(chunk, np.arange(len(chunks) + 1))]).tolist()
        whole = flat.tobytes()
        return {c: whole[cut[k] : cut[k + 1]] for k, c in enumerate(chunks)}

    def _join_long(self, start: np.ndarray, stop: np.ndarray, joined: np.ndarray, edge: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) of the symbols of one long chunk: joins by rank, then place, from a queue for each rank, over linked symbols; a join costs what its queue does, whatever the chunk's length."""
        n, no = len(start), len(self.texts)
        low, high = np.searchsorted(edge, start << 32), np.searchsorted(edge, start + 1 << 32)
        first = int(low[0])
        own = edge[first : int(high[-1])]
        ends, ranks = memoryview(own & 0xFFFFFFFF), memoryview(np.ascontiguousarray(self.rank[piece[first : int(high[-1])]], np.int64))
        lows, highs = (low - first).tolist(), (high - first).tolist()
        end, now = stop.tolist(), joined.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        order = np.argsort(joined, kind="stable")
        order = order[joined[order] < no]
        cut = np.flatnonzero(np.diff(joined[order], prepend=-1)).tolist()
        queues = {now[order[a]]: order[a:b].tolist() for a, b in zip(cut, [*cut, len(order)][1:], strict=True)}
        waiting = sorted(queues)
        stays = np.ones(n, bool)

        def told(i: int, until: int) -> None:
            k = bisect_left(ends, until, lows[i], highs[i])
            now[i] = rank = ranks[k] if k < highs[i] and ends[k] == until else no
            if rank < no:
                if rank in queues:
                    heappush(queues[rank], i)
                else:
                    queues[rank] = [i]
                    heappush(waiting, rank)

        while waiting:
            rank = waiting[0]
            queue = queues[rank]
            if not queue:
                heappop(waiting)
                del queues[rank]
                continue
            i = heappop(queue)
            if now[i] != rank:
                continue
            gone = after[i]
            end[i], after[i], now[gone], stays[gone] = end[gone], after[gone], no, False
            if after[i] < n:
                before[after[i]] = i
                told(i, end[after[i]])
            else:
                now[i] = no
            if before[i] >= 0:
                told(before[i], end[i])
        return start[stays], np.array(end)[stays]

    def decode(self, ids: bytes) -> str:
        """The text of some ids; invalid bytes become U+FFFD, one for each byte."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            text = b"".join(map(self.plain.__getitem__, numbers)).decode()
        except UnicodeDecodeError:
            return self._decode_invalid(numbers)
        # the space that encoding put before the text; one that stands for a byte is the text's own
        first = next((i for i in numbers if self.plain[i]), None)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else text

    def _decode_invalid(self, numbers: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        byte_of = self._byte_of()

        def flush() -> None:
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()

        for i in numbers:
            if i in byte_of:
                run.append(byte_of[i])
            else:
                flush()
                if i not in self.hidden:
                    piece = self.plain[i].decode()
                    # the space that encoding put before the text
                    out.append(piece.removeprefix(" ") if not out and self.prefix and i != self.unknown else piece)
        flush()
        return "".join(out)

    @lru_cache(maxsize=1)  # noqa: B019
    def _byte_of(self) -> dict[int, int]:
        return {i: b for b, i in self.byte_id.items()}


def _utf8(run: bytes) -> str:
    """Valid characters, and U+FFFD for each byte that belongs to none."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """The codec of a file, made once in each worker."""
    return Codec(path)


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each whole text's ids, without begin, end or other added ones.

    A null text is empty and has no ids; a null id stays null; repeated rows are encoded alike and
    returned as often as they come; an empty table gives an empty one; other columns, whatever their
    names, are not read.  Nothing is shuffled.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part, _ in slices(batch, "text"):
                held = own.encode(strings(part, "text"))
                n = np.concatenate(([0], np.cumsum([len(h) // 4 for h in held]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(n), pa.array(np.frombuffer(b"".join(held), "<u4").astype(np.int32)))], names=["id", "ids"])
        own.seen = {}
        trim()

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids are empty, and an id that the model does not have is an error."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def checked(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, is_same): each whole text encoded, decoded again and compared."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part, _ in slices(batch, "text"):
                texts = strings(part, "text")
                held = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(h) // 4 for h in held], pa.int64()), pa.array([zlib.crc32(h) for h in held], pa.int64()), pa.array([own.decode(h) == t for h, t in zip(held, texts, strict=True)])],
                    names=["id", "n_ids", "ids_crc32", "is_same"],
                )
        own.seen = {}
        trim()

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_ids long, ids_crc32 long, is_same boolean").withColumnRenamed("id", id_col)
