"""Token counts of documents under a unigram model, computed once per distinct prefix of words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._base import bounded, release, slices
from gridloom.llm.textcut import cut

#: Log probability that a byte outside the vocabulary costs beyond the rarest piece.
UNKNOWN = 10.0
#: Nodes of a task's trie, of about 200 bytes each, from which on it begins anew.
MOST_NODES = 800_000


def unigram_pieces(model_file: str) -> dict[str, float]:
    """A synthetic unigram model: the pieces of a public sentencepiece file with log probabilities by Zipf's law of their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {x: -math.log(k + 1) - total for k, x in enumerate(pieces)}


class Trie:
    """Pre-tokens in a trie whose nodes hold the forward score and the tokens of their prefix on its best path.

    A node is scored when it's made, from the nodes on its path, so a prefix that words share is
    scored once; the count of a word is that of its last node. Pieces are tried from a place
    backwards, along a trie of the reversed pieces, as far as one can end there. Among equal
    scores the fewest tokens win. A sign without piece counts its UTF-8 bytes.
    """

    def __init__(self, pieces: dict[str, float], mark: str = "▁", most: int = MOST_NODES):
        self.mark, self.most, self.made = mark, most, 0
        self.least = min(pieces.values(), default=0.0) - UNKNOWN
        self.backwards: dict = {}
        for piece, p in pieces.items():
            at = self.backwards
            for sign in reversed(piece):
                at = at.setdefault(sign, {})
            at[""] = p
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and sign
        self.score, self.tokens = [0.0], [0]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, inserted in sorted order. The trie is kept for later words until it has too many nodes."""
        out = np.empty(len(words), np.int64)
        for i in sorted(range(len(words)), key=words.__getitem__):
            out[i] = self.tokens[self._insert(self.mark + words[i])]
            if len(self.score) > self.most:
                self.clear()
        return out

    def _insert(self, text: str) -> int:
        """The node of a text; new nodes are made where it leaves the trie."""
        child, scores, tokens = self.child, self.score, self.tokens
        node, n, path, before = 0, len(text), [0], [0.0]
        for sign in text:
            found = child.get(node << 21 | ord(sign))
            if found is None:
                break
            node = found
            path.append(node)
            before.append(scores[node])
        first, least, backwards = len(path), self.least, self.backwards
        for last in range(first - 1, n):
            sign = text[last]
            size = 1 if sign < "\x80" else len(sign.encode())
            best, fewest = before[last] + least * size, tokens[path[last]] + size
            at, start = backwards.get(sign), last
            while at is not None:
                if "" in at:
                    s = before[start] + at[""]
                    if s >= best:
                        t = tokens[path[start]] + 1
                        if s > best or t < fewest:
                            best, fewest = s, t
                if not start:
                    break
                start -= 1
                at = at.get(text[start])
            child[node << 21 | ord(sign)] = node = len(scores)
            scores.append(best)
            tokens.append(fewest)
            path.append(node)
            before.append(best)
        self.made += n + 1 - first
        return node


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row, over whole texts, under the unigram model of ``pieces``.

    A pre-token is a run of signs other than ASCII blanks, with a word mark before it. Each task
    keeps a trie of the pre-tokens it has met and looks up each distinct one of a slice in it; nothing is
    shuffled, and the pieces are sent to all tasks, so they should be a vocabulary and no corpus. A
    null, empty or blank text has 0 of both; null ids and repeated rows stay; an empty table gives no
    row; other columns aren't read. A task holds one text and a node for each sign of its
    longest word at least.
    """
    given = docs.sparkSession.sparkContext.broadcast(dict(pieces))

    def run(batches):
        trie = Trie(given.value)
        for batch in batches:
            for part in slices(batch, "t"):
                codes, distinct, firsts, _ = cut(part.column("t"), words=True)
                found = distinct.to_pylist()
                is_word = np.fromiter((x[0] not in " \t\n\r\x0b\x0c" for x in found), bool, len(found))
                each = np.zeros(len(found), np.int64)
                each[is_word] = trie.count([x for x, w in zip(found, is_word, strict=True) if w])
                tokens, words = (np.diff(np.concatenate([[0], np.cumsum(x[codes])])[firsts]) if len(codes) else np.zeros(len(firsts) - 1, np.int64) for x in (each, is_word.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])
        del trie
        release()

    return bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
