"""Byte-level BPE ids with a cache of space-delimited chunks.

A boundary before a single space is also a boundary of pre-tokens whenever the
character before it or the one after it isn't white space. Text cut at such
places can be encoded chunk by chunk, and natural text repeats its chunks.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: the pre-token pattern of this public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks that a worker remembers before it starts over.
CACHED = 400_000
#: Longer chunks are encoded anew each time.
LONGEST = 64
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        value = self.make(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = value
        return value


class Encoder:
    """Ids equal to those of ``tokenizers`` for the file at ``path``, special tokens as ordinary text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        # Special tokens come after the vocabulary that merges can make.
        last = 256 + len(model["merges"])
        ranks = {raw[t]: i for t, i in model["vocab"].items() if t in raw and i < last}
        self.bpe = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ids = _Chunks(lambda chunk: np.array(self.bpe.encode_ordinary(" " + chunk), "<u4").tobytes())
        self._counts = _Chunks(lambda chunk: len(self.bpe.encode_ordinary(" " + chunk)))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        head, *rest = chunks(text)
        return np.array(self.bpe.encode_ordinary(head), "<u4").tobytes() + b"".join(map(self._ids.__getitem__, rest))

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """The chunks, each but the first without its leading space, and the number of ids of each."""
        head, *rest = parts = chunks(text)
        return parts, [len(self.bpe.encode_ordinary(head)), *map(self._counts.__getitem__, rest)]

    def count(self, text: str) -> int:
        return sum(self.counts(text)[1])


def chunks(text: str) -> list[str]:
    """Text cut before spaces where pre-tokens end; each but the first lacks its leading space."""
    parts = text.split(" ")
    if not _UNSAFE.search(text):
        return parts
    out = [parts[0]]
    for i, part in enumerate(parts[1:], 1):
        before = parts[i - 1][-1:]
        # Before an empty part stands a space, but for the first.
        spaced = before.isspace() if before else i > 1
        if spaced and not part[:1].strip():
            out[-1] += " " + part
        else:
            out.append(part)
    return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
