"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary matches in a word, and dynamic programming carries the best score
and its number of pieces to every position. Ties follow the tokenizer: matches are tried by their start, and a later
one replaces an earlier one only if its score is strictly higher. Where no piece of one character starts, the
unknown piece (10 below the lowest score) may. Runs of unknown characters count as one piece or, with
``byte_fallback``, as a piece for each of their UTF-8 bytes; control and byte pieces then never match text.

The model is a piece file's pieces and scores, read as a unigram model: counts equal those of the ``tokenizers``
library's Unigram model with a Metaspace pre-tokenizer over them. For a file of merges, whose scores are ranks, that is
a tokenizer of its own and not the file's merge encoding.

Words are what the pre-tokenizer splits at spaces, each with its leading mark, so their counts are remembered and summed.
Only as many positions are held as the longest piece has characters, whatever the length of a word.
Defined results: null and empty texts have no tokens; very long texts are read word by word, very long words aren't
remembered; repeated rows are counted alike; an empty table gives no rows; columns other than doc_id and text, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from terralex.llm.arrow import mapped

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker remembers at a time, and their largest length: together a bound in bytes.
REMEMBERED = 400_000
LONGEST = 64


class UnigramCounter(dict):
    """Word -> number of pieces on its best path."""

    def __init__(self, pieces: Iterable[tuple[str, float]], unknown: int, apart: Iterable[int] = (), byte_fallback: bool = False):
        """``apart`` lists the ids of control and byte pieces, which no text matches with ``byte_fallback``."""
        super().__init__()
        pieces, left_out = list(pieces), {unknown, *(apart if byte_fallback else ())}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        kept = [(piece, score) for i, (piece, score) in enumerate(pieces) if piece and i not in left_out]
        for piece, score in kept:
            self.automaton.add_word(piece, (len(piece), score))
        self.longest = max((len(piece) for piece, _ in kept), default=1)
        self.automaton.make_automaton()

    def count(self, word: str) -> int:
        size = min(len(word), self.longest) + 1
        best, count, unk = [0.0] * size, [0] * size, [False] * size  # by position modulo size
        matches = iter(self.automaton.iter(word)) if len(self.automaton) else iter(())
        last, match = next(matches, (-1, None))
        for i, char in enumerate(word):
            here, pieces, open_, single = None, 0, False, False
            # those that end at one place come by length, longest first
            while last == i:
                length, score = match
                at = (i + 1 - length) % size
                total = best[at] + score
                if here is None or total > here:
                    here, pieces = total, count[at] + 1
                single |= length == 1
                last, match = next(matches, (-1, None))
            if not single:
                at = i % size
                total = best[at] + self.unknown
                if here is None or total > here:
                    here, open_ = total, True
                    pieces = count[at] + (len(char.encode()) if self.byte_fallback else not unk[at])
            at = (i + 1) % size
            best[at], count[at], unk[at] = here, pieces, open_
        return count[len(word) % size]

    def __missing__(self, word: str) -> int:
        out = self.count(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out

    def tokens(self, text: str) -> int:
        """Spaces become marks, one is put in front, and every mark begins a word."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        marked = marked if marked.startswith(MARK) else MARK + marked
        return sum(map(self.__getitem__, [MARK + w for w in marked.split(MARK)[1:]]))


def load_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces and scores of a SentencePiece model file, and the unknown piece's id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


def apart(path: str) -> tuple[int, ...]:
    """Ids of a model file's control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_byte(i))


@lru_cache(2)
def _counter(pieces: tuple, unknown: int, left_out: tuple, byte_fallback: bool) -> UnigramCounter:
    return UnigramCounter(pieces, unknown, left_out, byte_fallback)


def counted(docs: DataFrame, model: str, byte_fallback: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_chars) of every whole text."""
    pieces, unknown = load_pieces(model)
    pieces, left_out = tuple(pieces), apart(model)

    def fn(batch: pa.RecordBatch) -> list:
        counter = _counter(pieces, unknown, left_out, byte_fallback)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        return [[counter.tokens(t) for t in texts], [len(t) for t in texts]]

    return mapped(docs.select("doc_id", "text"), ["doc_id"], "n_tokens long, n_chars long", fn, lambda: _counter(pieces, unknown, left_out, byte_fallback).clear())
