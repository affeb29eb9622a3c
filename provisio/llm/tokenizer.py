"""Token ids of whole texts, as the library that belongs to a tokenizer file gives them.

A ``.json`` file belongs to *tokenizers*, a ``.model`` file to *sentencepiece*; no begin,
end or other tokens are added and nothing is cut or padded.

For byte-level BPE files the ids come from an equivalent encoder over the file's own
vocabulary, which remembers chunks: such a tokenizer never joins what stands before a
single space between two other characters with what follows it, so a text may be encoded
chunk by chunk.  Texts in which a space touches other white space are encoded whole.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import sys
from functools import lru_cache

import numpy as np

#: The split pattern of byte-level BPE (a fixed value of the file format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks remembered by a worker; beyond it starts anew.
MOST_CHUNKS = 250_000


def digest(path: str) -> str:
    """A version of the tokenizer: its file's bytes and its library's version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _byte_of() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: its own, or one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """Chunk -> its ids' bytes; None for a chunk that can't be encoded on its own."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, chunk: str) -> bytes | None:
        ids = None
        if chunk and not chunk[0].isspace() and not chunk[-1].isspace():
            ids = self.encode(self.prefix + chunk)
        if len(self) >= MOST_CHUNKS:
            self.clear()
        self[chunk] = ids
        return ids


class ByteLevelEncoder:
    """``encode(text)``: ids as bytes, each a little-endian unsigned 32-bit number."""

    def __init__(self, spec: dict):
        import tiktoken

        byte_of = _byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.whole = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        # ids as bytes at once, where the library has it and numbers are little-endian
        core = getattr(self.whole, "_core_bpe", None)
        self.buffer = getattr(core, "encode_to_tiktoken_buffer", None) if sys.byteorder == "little" else None
        self.first, self.later = _Chunks(self.encode_whole, ""), _Chunks(self.encode_whole, " ")

    def encode_whole(self, text: str) -> bytes:
        if self.buffer:
            return bytes(self.buffer(text, self.special))
        return self.whole.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def forget(self) -> None:
        """Chunks are remembered for one task, so that idle workers hold none."""
        self.first.clear()
        self.later.clear()

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        if len(parts) < 2:
            return self.encode_whole(text)
        head = self.first[parts[0]]
        if head is None:
            return self.encode_whole(text)
        try:
            return head + b"".join(map(self.later.__getitem__, parts[1:]))
        except TypeError:  # a chunk that must not stand alone
            return self.encode_whole(text)

    @staticmethod
    def fits(spec: dict) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        return (
            pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
            and model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
            and _ranked(spec)
        )


def _ranked(spec: dict) -> bool:
    """Whether ids stand in the order of the merges, so that an id is a merge's rank."""
    vocab, last = spec["model"]["vocab"], -1
    for m in spec["model"]["merges"]:
        i = vocab["".join(m.split(" ") if isinstance(m, str) else m)]
        if i <= last:
            return False
        last = i
    return True


class LibraryEncoder:
    """Any other file, by its library."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.ids = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self.ids = lambda text: own.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        pass

    def encode(self, text: str) -> bytes:
        return np.asarray(self.ids(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevelEncoder | LibraryEncoder:
    """The encoder of a file, made once in each worker."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if ByteLevelEncoder.fits(spec):
            return ByteLevelEncoder(spec)
    return LibraryEncoder(path)
