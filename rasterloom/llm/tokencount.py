"""Token counts of a unigram tokenizer without its tokens.

A text is split at white space and each word, led by the mark U+2581, is segmented on its own. An Aho-Corasick automaton lists
the vocabulary's pieces that end at each place; dynamic programming carries the best score and its number of pieces. Tie rule of
the public implementation (tokenizers.models.Unigram): starts are tried from left to right and only a strictly better score
replaces one, so of equal scores the longest last piece stays. A character that no piece covers alone may be an unknown piece
at the lowest score less 10; unknown pieces next to each other are one.

The vocabulary is a parameter: pieces with scores. From a file of the public SentencePiece format the pieces are read, and a
file whose scores are only ranks (BPE) gets the score -ln(rank + 2). Counts of a task's words are kept while it runs, up to
CACHE of them, of at most CACHED characters each. Defined results: null and empty texts have no tokens; repeated rows and rows without an id are
counted each; a very long word takes memory for its longest piece only; an empty table has no rows; a column named n_tokens is
replaced, all others are carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE, CACHED = 400_000, 64  # words, and characters of a word that is kept
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Ordinary pieces (not control, unknown or byte pieces) of a SentencePiece file, each with its score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            pieces.append(model.id_to_piece(i))
            scores.append(model.get_score(i))
    if all(s <= 0 and s == int(s) for s in scores):
        scores = [-math.log(rank + 2) for rank in range(len(scores))]
    return list(zip(pieces, scores))


class PieceCounter:
    """Counts pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            self.machine.add_word(piece, (len(piece), score))
        if pieces:
            self.machine.make_automaton()
        self.empty = not pieces
        self.reach = max([1, *(len(p) for p, _ in pieces)]) + 1
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        """Of one marked word."""
        reach = self.reach  # no piece goes further back: a ring of the last places is all that is kept of a long word
        best: list[float | None] = [0.0] + [None] * (reach - 1)
        count, unknown = [0] * reach, [False] * reach
        matches = iter(()) if self.empty else self.machine.iter(word)
        at = next(matches, None)
        last = 0
        for end in range(1, len(word) + 1):
            here, prev = end % reach, (end - 1) % reach
            top, pieces, lone = None, 0, False
            while at is not None and at[0] == end - 1:  # from the longest to the shortest: from left to right
                length, score = at[1]
                start = (end - length) % reach
                before = best[start]
                if before is not None:
                    if length == 1:
                        lone = True
                    if top is None or before + score > top:
                        top, pieces = before + score, count[start] + 1
                at = next(matches, None)
            odd = False
            if not lone and best[prev] is not None and (top is None or best[prev] + self.unknown > top):
                top, odd = best[prev] + self.unknown, True
                pieces = count[prev] + (not unknown[prev])
            best[here], count[here], unknown[here] = top, pieces, odd
            last = pieces
        return last

    def text(self, text: str) -> int:
        total, cache = 0, self.cache
        for word, times in Counter(_split(text)).items():
            n = cache.get(word)
            if n is None:
                if len(cache) >= CACHE:
                    cache.clear()
                n = self.pieces(MARK + word)
                if len(word) <= CACHED:
                    cache[word] = n
            total += n * times
        return total


def _split(text: str) -> list[str]:
    """At ASCII white space only, which also U+001C to U+001F are not."""
    return [w for w in SPLIT.split(text) if w]


def counted(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """docs with n_tokens. The vocabulary (tens of thousands of pieces, fixed by its file) is broadcast."""
    kept = [c for c in docs.columns if c != "n_tokens"]
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        counter = PieceCounter(shared.value)
        for batch in common.sliced(batches):
            n = [counter.text(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add("n_tokens", "long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, vocabulary()).select("doc_id", "n_tokens")
