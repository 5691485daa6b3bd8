"""Token counts by a linear longest-match automaton.

The vocabulary's pieces are a trie. Where no edge goes on from a node, its failure link leads to the node of what is left
after the pieces that greedy matching would have cut off, and the node holds how many those are. So a word is read once,
left to right, and only a count is kept; no piece is built. Characters that no piece holds count as their UTF-8 bytes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.llm import _text

VOCABULARY = "piece_bpe_32k.model"
WORD_START = "▁"
_TEXT_LIMIT = 4 << 20
_WORDS_HELD = 1 << 20


def read_pieces(name: str = VOCABULARY) -> list[str]:
    """Pieces of a public vocabulary file, without control, unknown and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in plain]


class LongestMatch:
    """Counts greedy longest-match pieces of a word in time linear in its length."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                follow = self.next[node].get(c)
                if follow is None:
                    follow = self.next[node][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = follow
            whole[node] = whole[node] or node != 0
        self.failure, self.popped = [0] * len(self.next), [0] * len(self.next)
        todo = deque()
        for c, node in self.next[0].items():
            self.popped[node] = 1 if whole[node] else len(c.encode())
            todo.append(node)
        while todo:
            parent = todo.popleft()
            for c, node in self.next[parent].items():
                todo.append(node)
                if whole[node]:
                    self.popped[node] = 1
                    continue
                at, count = self.failure[parent], self.popped[parent]
                while at and c not in self.next[at]:
                    at, count = self.failure[at], count + self.popped[at]
                self.failure[node], self.popped[node] = self.next[at][c] if c in self.next[at] else 0, count
                if c not in self.next[at]:
                    self.popped[node] += len(c.encode())

    def count(self, word: str) -> int:
        """Number of pieces of `word`."""
        follow, failure, popped, node, total = self.next, self.failure, self.popped, 0, 0
        for c in word:
            while True:
                to = follow[node].get(c)
                if to is not None:
                    node = to
                    break
                if not node:
                    total += len(c.encode())
                    break
                total += popped[node]
                node = failure[node]
        while node:
            total += popped[node]
            node = failure[node]
        return total


def _counts(pieces: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = LongestMatch(pieces)
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for whole in batches:
            for batch in _text.sub_batches(whole, "text", _TEXT_LIMIT):
                data, bounds = _text.raw(batch.column("text"))
                starts, ends, first = _text.spans(data, bounds)
                unique, example, inverse = np.unique(_text.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                if len(hashes) > _WORDS_HELD:
                    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                new = np.flatnonzero(~np.isin(unique, hashes, assume_unique=True))
                fresh = [matcher.count(WORD_START + data[starts[i] : ends[i]].tobytes().decode()) for i in example[new].tolist()]
                hashes, counts = np.concatenate([hashes, unique[new]]), np.concatenate([counts, np.array(fresh, np.int64)])
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order]
                sums = np.concatenate([[0], np.cumsum(counts[np.searchsorted(hashes, unique)][inverse])]) if len(unique) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(sums[first]), pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of `docs` (doc_id, text).

    Words are parted by white space, and each is matched with the word-start mark before it. Null and empty texts have
    no words and no tokens. Rows that repeat and null ids come back as they are. Other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_counts(pieces), "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_pieces())
