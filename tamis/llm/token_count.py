"""Token counts by a Viterbi pass that keeps scores and counts but no path.

An Aho-Corasick automaton of the unigram vocabulary yields, for each end position, all
pieces that end there, longest first.  Each position carries the best score and the
number of tokens of the best segmentation up to it.  The tie rules are those of the
unigram tokenizers: a later candidate must score strictly more, and candidates come in
the order of their start, so on a tie the longest last piece wins; a character that is
no piece itself may be taken as unknown, at the least score of the vocabulary less 10,
after all pieces.  Neighbouring unknown characters form one token, or one token for
each of their UTF-8 bytes where the vocabulary has all byte pieces.

A text becomes ``▁`` followed by the text with each space as ``▁``.  No piece may hold
``▁`` after another character, so a text's best segmentation is that of its runs of
spaces with the word that follows, each of which is solved once and remembered.  (Runs can be cut
apart because every run begins with ``▁`` and no piece goes over that start: the vocabulary must hold ``▁`` itself, so that
an unknown ``▁`` never joins the unknown end of the run before.)

Null and empty texts have no tokens (score 0).  Rows are counted alone: repeated rows
agree, an empty table gives an empty result, and other columns are never read.  Very long texts are taken whole, run by run.

A worker keeps the automaton for its next task, and what it remembers of runs, which is bounded in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.llm.batches import releasing, slices
from tamis.shared import col

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
_RUNS = re.compile(r" *[^ ]+| +")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts for one vocabulary, with a memory of runs that it has solved, bounded in bytes.

    Runs are remembered in two generations: when the young one is full, it becomes the old one, and what is not met again until the
    next time is forgotten.  A run's score and tokens are the parts of one complex number, so that sums are taken at once.
    """

    def __init__(self, pieces: list[tuple[str, float]], most_bytes: int = 80 << 20) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in reversed(pieces):  # of equal pieces the first counts
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        if any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece, _ in pieces):
            raise ValueError(f"a piece holds {SPACE_MARK} after another character")
        known = {piece for piece, _ in pieces}
        if SPACE_MARK not in known:
            raise ValueError(f"the vocabulary has no {SPACE_MARK}")
        self.single = {piece for piece in known if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        self.solved: dict[str, complex] = {}
        self.old: dict[str, complex] = {}
        self.held = 0

    def solve(self, run: str) -> tuple[int, float]:
        """Tokens and score of the best segmentation of a string."""
        n = len(run)
        low = float("-inf")
        best, count = [0.0] + [low] * n, [0] * (n + 1)
        if self.single.issuperset(run):  # no character can be unknown
            for last, (length, score) in self.automaton.iter(run):
                start = last + 1 - length
                score += best[start]
                if score > best[last + 1]:
                    best[last + 1] = score
                    count[last + 1] = count[start] + 1
            return count[n], best[n]
        unknown = [False] * (n + 1)  # the best segmentation ends in an unknown character
        single, penalty = self.single, self.unknown
        closed = 0

        def close(upto: int) -> None:
            for end in range(closed + 1, upto + 1):
                char = run[end - 1]
                if char not in single and best[end - 1] + penalty > best[end]:
                    best[end] = best[end - 1] + penalty
                    unknown[end] = True
                    width = len(char.encode()) if self.bytes else 0 if unknown[end - 1] else 1
                    count[end] = count[end - 1] + width

        for last, (length, score) in self.automaton.iter(run):
            if last > closed:
                close(last)
                closed = last
            start = last + 1 - length
            if best[start] + score > best[last + 1]:
                best[last + 1] = best[start] + score
                count[last + 1] = count[start] + 1
        close(n)
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a whole text."""
        if not text:
            return 0, 0.0
        runs = _RUNS.findall(" " + text.replace(SPACE_MARK, " "))
        if self.held > self.most_bytes // 2:
            self.solved, self.old, self.held = {}, self.solved, 0
        solved, old = self.solved, self.old
        for run in set(runs).difference(solved):
            known = old.get(run)
            if known is None:
                tokens, score = self.solve(run.replace(" ", SPACE_MARK))
                known = complex(score, tokens)
            solved[run] = known
            self.held += 150 + len(run)
        total = sum(map(solved.__getitem__, runs))
        return int(total.imag), total.real


_counters: dict[int, Counter] = {}


def counter_of(pieces: list[tuple[str, float]]) -> Counter:
    """This worker's counter for a vocabulary; its automaton outlives the task."""
    key = hash(tuple(pieces))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(pieces)
    return _counters[key]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and the ``score`` of the best segmentation, for each row of ``docs``."""
    if sum(len(p) for p, _ in pieces) > 64 << 20:
        raise ValueError("a vocabulary of over 64 M characters is too large to send")
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    key_type = source.schema["doc_id"].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(sent.value)
        for part in slices(batches):
            found = [counter.count(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([t for t, _ in found], pa.int64()),
                    "score": pa.array([s for _, s in found], pa.float64()),
                }
            )

    return source.mapInArrow(run, f"doc_id {key_type}, n_tokens bigint, score double")
