"""Token counts of a unigram tokenizer without building tokens.

Aho-Corasick lists all vocabulary pieces of a word by where they end. The dynamic program keeps for each end only the best
score and the number of pieces that reach it. Ties go as in the tokenizer: candidates come in order of their start and only
a better score replaces one, so the longer last piece wins; a character that is no piece counts as unknown, at ten below the
least score; neighbouring unknowns are one token.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import columnar as c

#: The word mark, the penalty below the least score, and the characters that the whitespace split removes.
MARK, PENALTY = "\u2581", 10.0
_SPLIT = re.compile(r"[\u0009-\u000D \u0085   -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
_CACHED = 1 << 20


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a public sentencepiece file in its order; a piece's score is -log(rank + 2). The unknown piece is the first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    last = -math.log(len(kept) + 2)
    return [("<unk>", last), *((p, -math.log(rank + 2)) for rank, p in enumerate(kept))]


class CountOnlyViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for at, (piece, score) in enumerate(vocabulary):
            self.pieces.add_word(piece, (len(piece), score, at == 0))
        self.pieces.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - PENALTY
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of one word, mark included."""
        n = len(word)
        by_end: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
        for end, piece in self.pieces.iter(word):
            by_end[end].append(piece)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, whole = None, False
            for length, gain, is_unknown in sorted(by_end[end - 1], key=lambda p: -p[0]):
                whole |= length == 1
                total = gain + score[end - length]
                if best is None or total > best[0]:
                    best = (total, end - length, is_unknown)
            if not whole:
                total = self.unknown + score[end - 1]
                if best is None or total > best[0]:
                    best = (total, end - 1, True)
            score[end], start, unknown[end] = best
            pieces[end] = pieces[start] + (not (unknown[end] and unknown[start] and start > 0))
        return pieces[n]

    def total(self, text: str) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = [w for w in _SPLIT.split(text) if w] if _ODD.search(text) else text.split()
        known = self.known
        try:
            return len(words), sum(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > _CACHED:
            known.clear()  # bounded memory
        for w in [w for w in set(words) if w not in known]:
            known[w] = self.count(MARK + w)
        return len(words), sum(map(known.__getitem__, words))


def _counter(path: str, _made: dict = {}) -> CountOnlyViterbi:  # noqa: B006  one for each worker
    if path not in _made:
        _made[path] = CountOnlyViterbi(unigram_vocabulary(path))
    return _made[path]


def token_counts(docs: DataFrame, *, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text, row by row. Null and blank texts have none; nothing is shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in c.slices(batches, "_x"):
            both = np.array([counter.total(x or "") for x in batch.column("_x").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    return docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_x")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
