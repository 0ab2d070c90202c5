"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character of a word. The
search carries two numbers per character, the best score and its piece count, and no back pointers.
Ties follow the tokenizer: the first path found stands, that is the longest last piece. A character
without a piece of its own costs ten less than the lowest score and counts as its UTF-8 bytes.

A word's count does not depend on its neighbours, so counts of short words are kept per worker
process in a table of bounded size. Documents are never shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

#: A public vocabulary with scores; the path holds on every worker.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_COST = 10.0
#: Words remembered per worker process, and the longest of them.
REMEMBERED, LONGEST = 1_000_000, 48


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores in the order of their ids; the two sentence marks are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    marks = {model.bos_id(), model.eos_id()}
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if i not in marks]


class Counter(dict):
    """Pieces of a word, by word; a word starts with a space that is not written."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_COST

    def __missing__(self, word: str) -> int:
        count = self.search(SPACE + word)
        if len(word) <= LONGEST:
            self[word] = count
        return count

    def search(self, word: str) -> int:
        """Pieces of the best path through the whole word."""
        scores: list[float | None] = [0.0] + [None] * len(word)
        counts = [0] * (len(word) + 1)
        done = 0
        for last, (size, score) in self.automaton.iter(word):
            if last > done:
                self._close(word, scores, counts, done, last)
                done = last
            start = last + 1 - size
            total = scores[start] + score
            held = scores[last + 1]
            # Longer pieces come first, so an equal score never replaces one.
            if held is None or total > held:
                scores[last + 1] = total
                counts[last + 1] = counts[start] + 1
        self._close(word, scores, counts, done, len(word))
        return counts[-1]

    def _close(self, word: str, scores: list, counts: list, low: int, high: int) -> None:
        """Offers the unknown piece at every character of ``word[low:high]``."""
        for k in range(low, high):
            if word[k] not in self.single:
                total = scores[k] + self.unknown
                if scores[k + 1] is None or total > scores[k + 1]:
                    scores[k + 1] = total
                    counts[k + 1] = counts[k] + len(word[k].encode("utf-8", "surrogatepass"))

    def tokens(self, text: str | None) -> int:
        """Spaces are the space piece and begin a word; a space is put before a text that has none."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        return sum(map(self.__getitem__, (text[1:] if text[0] == " " else text).split(" ")))

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        table = counter(path)
        out = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            out[k] = table.tokens(text)
            table.trim()
        return pd.Series(out)

    return count(text)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row; a null or empty text has none. Null ids and repeated rows are rows like others."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
