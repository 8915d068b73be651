"""Token ids of whole texts by a public tokenizer, each distinct chunk being tokenized once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from gridloom.llm._base import release, strings
from gridloom.llm.textcut import cut

#: Bytes of text encoded at once: the distinct chunks of a slice that are not remembered are encoded again in the next.
SLICE_BYTES = 4 << 20
#: Bytes that remembered chunks may take, and what one takes besides its signs and ids (string, dictionary entry, places).
REMEMBERED_BYTES, _EACH = 64 << 20, 200
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Encodes columns of texts; ids equal those of ``encode(text, add_special_tokens=False)``.

    Words of Latin letters go straight to the BPE model, other chunks through the whole
    tokenizer, and odd texts (see :func:`gridloom.llm.textcut.cut`) are encoded whole. Distinct
    chunks stay in memory up to ``remembered`` bytes; later ones are encoded once per batch. Each
    task opens its own encoder by :meth:`opened`, which gives the memory back.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        self.signs, self.remembered = _byte_signs(), remembered
        self.slot: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.bytes = 0

    @classmethod
    @contextmanager
    def opened(cls, path: str) -> Iterator[Encoder]:
        """An encoder for one task; nothing of it stays in the worker process."""
        encoder = cls(path)
        try:
            yield encoder
        finally:
            encoder.__dict__.clear()
            release()

    def ids(self, chunks: list[str]) -> list[list[int]]:
        out: list = [None] * len(chunks)
        rest, model = [], self.tokenizer.model.tokenize
        for i, chunk in enumerate(chunks):
            if _WORD.fullmatch(chunk):
                word = chunk.lstrip().lower() if self.lower else chunk
                out[i] = [t.id for t in model(word.encode().decode("latin-1").translate(self.signs))]
            else:
                rest.append(i)
        for i, x in zip(rest, self.tokenizer.encode_batch([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text followed by ``end_id``; ids per text, the end included."""
        texts = strings(texts)
        codes, distinct, firsts, odd = cut(texts)
        words = distinct.to_pylist()
        slot = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(slot < 0)
        flat, first, count = self.flat, self.first, self.count
        if len(fresh):
            unknown = [words[i] for i in fresh]
            new = self.ids(unknown)
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            ids = np.fromiter(chain.from_iterable(new), np.uint32, int(lengths.sum()))
            del new
            n = len(self.slot)
            flat, first, count = (self._put(a, k, v) for a, k, v in ((flat, self.used, ids), (first, n, self.used + np.cumsum(lengths) - lengths), (count, n, lengths)))
            slot[fresh] = n + np.arange(len(fresh))
            size = _EACH * len(fresh) + sum(map(len, unknown)) + 4 * len(ids)
            if self.bytes + size <= self.remembered:
                self.bytes += size
                self.flat, self.first, self.count = flat, first, count
                self.used += len(ids)
                self.slot.update(zip(unknown, range(n, n + len(fresh)), strict=True))
        each = count[slot][codes] if len(codes) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(each)])
        tokens = flat[np.arange(before[-1]) + np.repeat(first[slot][codes] - before[:-1], each)] if len(codes) else np.zeros(0, np.uint32)
        per = np.diff(before[firsts]) + 1
        out = np.full(int(per.sum()), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(per) - 1] = False
        out[inner] = tokens
        if not len(odd):
            return out, per
        parts = np.split(out, np.cumsum(per)[:-1])
        for i in odd:
            parts[i] = np.array([*self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, end_id], np.uint32)
            per[i] = len(parts[i])
        return np.concatenate(parts), per

    @staticmethod
    def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        if at + len(values) > len(array):
            array = np.concatenate([array, np.zeros(max(len(array), len(values)), array.dtype)])
        array[at : at + len(values)] = values
        return array
