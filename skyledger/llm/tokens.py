"""Counts of unigram pieces: Viterbi that carries only the best score and its number of pieces.

An Aho-Corasick automaton finds all vocabulary pieces in a chunk of text. No
piece crosses from other characters to the word mark, so the best path of a text
is that of its chunks, cut before each run of marks; every distinct chunk of a
slice of texts is solved once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CHUNK = f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+"
#: Solved chunks that a worker keeps, and the longest it keeps.
KEPT, LONGEST = 200_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``unknown`` is the score of one character that no piece covers."""

    pieces: list[tuple[str, float]]
    unknown: float


def read_vocabulary(path: str) -> Vocabulary:
    """The normal pieces of a sentencepiece file. Raises if a piece has a mark after another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    pieces = [
        (model.id_to_piece(i), model.get_score(i))
        for i in every
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    if any(MARK in piece.lstrip(MARK) for piece, _ in pieces):
        raise ValueError("a piece crosses the word mark")
    return Vocabulary(pieces, min(model.get_score(i) for i in every) - UNKNOWN_PENALTY)


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


class Counter:
    """Best score and number of pieces of a chunk.

    Of paths with equal scores the one whose last piece is longest wins, which is
    what tokenizers do that try starts from left to right and replace only by a
    greater score. A character without a piece of its own may also stand alone at
    the unknown score; it counts one piece for each byte.
    """

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary.pieces if len(piece) == 1}
        self.unknown = vocabulary.unknown
        self.kept: dict[str, tuple[float, int]] = {}

    def solve(self, chunk: str) -> tuple[float, int]:
        known = self.kept.get(chunk)
        if known is not None:
            return known
        best, count = [0.0], [0]
        found = self.automaton.iter(chunk)
        end, piece = next(found, (-1, None))
        for k, char in enumerate(chunk):
            score, pieces = -np.inf, 0
            while end == k:  # from the longest piece to the shortest
                length, value = piece
                value += best[k + 1 - length]
                if value > score:
                    score, pieces = value, count[k + 1 - length] + 1
                end, piece = next(found, (-1, None))
            if char not in self.single and best[k] + self.unknown > score:
                score, pieces = best[k] + self.unknown, count[k] + len(char.encode("utf-8", "surrogatepass"))
            best.append(score)
            count.append(pieces)
        result = best[-1], count[-1]
        if len(chunk) <= LONGEST:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[chunk] = result
        return result


def chunks(text: Column) -> Column:
    """The text's chunks in order, its first one marked; spaces stand for marks. Null and empty texts have none."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(CHUNK), F.lit(0))).otherwise(F.array().cast("array<string>"))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens long, score double (the best path's).

    Null and empty texts have no tokens and score 0. Repeated rows repeat; an
    empty table gives an empty result; other columns are ignored. Nothing is
    shuffled. The vocabulary, of a fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or default_vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lists = part.column("chunks")
                coded = lists.flatten().dictionary_encode()
                solved = [counter.solve(x.replace(" ", MARK)) for x in coded.dictionary.to_pylist()]
                which = coded.indices.to_numpy(zero_copy_only=False)
                stop = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                totals = []
                for k, kind in ((1, np.int64), (0, float)):
                    value = np.array([x[k] for x in solved], kind)[which]
                    totals.append(np.diff(np.concatenate([[0], np.cumsum(value)])[np.concatenate([[0], stop])]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(totals[0]), pa.array(totals[1])], ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", chunks(F.col("text")).alias("chunks")).mapInArrow(count, "doc_id long, n_tokens long, score double")
