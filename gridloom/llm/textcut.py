"""Cuts a column of texts into chunks at places where any public BPE pre-tokenizer also cuts.

A chunk is a few bytes of the column's own buffer; Arrow's dictionary encoding then finds the
distinct chunks, so that costly work (tokenizing, hashing) is done once per distinct chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.llm._base import strings

_WHITE, _CUT, _PUNCT, _LETTER, _LEAD = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] |= _WHITE
_CLASS[[9, 10, 13, 32]] |= _CUT
_CLASS[list(b"!#$%&*,.?;:()|")] |= _PUNCT
_CLASS[65:91] |= _LETTER
_CLASS[97:123] |= _LETTER
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] |= _LEAD


def cut(texts: pa.StringArray, words: bool = False) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
    """Codes of all chunks, the distinct chunks, each text's first chunk (and the end), odd texts.

    Cuts lie before a single blank between two other signs, and between a letter A-Z and a
    punctuation mark. Texts with white space outside ASCII or with ``<|`` (which may start a
    special token) are listed as odd: their chunks must not be used for tokenizing.
    Null counts as empty; an empty text has no chunk. With ``words``, cuts lie between ASCII blanks
    and other signs instead, so each chunk is a word or a run of blanks.
    """
    texts = strings(texts)
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return np.zeros(0, np.int32), pa.array([], pa.string()), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    base, last = int(ends[0]), int(ends[-1])
    ends = ends.astype(np.int64) - base
    data = texts.buffers()[2].slice(base, last - base)
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int32), pa.array([], pa.string()), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[raw]
    at = np.zeros(len(raw) + 1, bool)
    white = (kind & _WHITE).astype(bool)
    if words:
        white &= (raw < 28) | (raw == 32)
        at[1:-1] = white[1:] != white[:-1]
        kind = np.zeros_like(kind)  # no other cuts, and no text is odd
    at[1:-2] |= ((kind[1:-1] & _CUT) != 0) & ~white[:-2] & ~white[2:]
    at[1:-1] |= ((kind[1:] & _PUNCT) != 0) & ((kind[:-1] & _LETTER) != 0)
    at[ends] = True
    cuts = np.flatnonzero(at)
    chunks = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), data)
    coded = chunks.dictionary_encode()
    lead = np.flatnonzero(kind & _LEAD)
    lead = lead[lead < len(raw) - 1]
    one, two = raw[lead], raw[lead + 1]
    three = raw[np.minimum(lead + 2, len(raw) - 1)]
    wide = lead[((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) | ((one == 0xE1) & (two == 0x9A)) | ((one == 0xE2) & (((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))) | (two == 0x81))) | ((one == 0xE3) & (two == 0x80) & (three == 0x80))]
    odd = np.searchsorted(ends, wide, side="right") - 1
    if pc.any(marked := pc.match_substring(texts, "<|")).as_py():
        odd = np.concatenate([odd, np.flatnonzero(marked.to_numpy(zero_copy_only=False))])
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(cuts, ends), np.unique(odd)
