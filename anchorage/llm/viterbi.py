"""Token counts by Viterbi, without building tokens.

The vocabulary is a list of pieces with scores.  An Aho-Corasick automaton
lists all pieces that end at each position; dynamic programming carries, per
position, the best score and the number of pieces of the path that has it.

Tie rules are those of the unigram tokenizer of the tokenizers library: a path
replaces another only if its score is higher, and candidates are tried in the
order of where their last piece starts, so of equal scores the longest last
piece wins.  A character that is no piece of its own takes the unknown score,
ten below the least, and counts as one piece per UTF-8 byte.

White space: blanks become the mark U+2581 and one is put before the text, as
the vocabulary expects.  No piece has a mark after another character, nor a
line end, so the best path of a text is that of its parts cut there; scores of
the shipped vocabulary are whole numbers, so sums are exact in any order.  A
vocabulary for which this doesn't hold is not cut.  Parts are counted once per
worker, which keeps them from task to task, in a bounded table.

Defined results: a null or empty text has no tokens and score 0; a null
``doc_id`` is passed through; repeated rows are counted row by row; texts of
any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from anchorage.llm.common import releasing, vocabulary_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
PARTS_KEPT, LONGEST_KEPT_PART = 1_000_000, 64


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a sentencepiece file with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in ordinary]


class Counter(dict):
    """Counts pieces; as a dict, a part of a text and its (pieces, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        cut = all(MARK not in p.lstrip(MARK) and "\n" not in p and s == int(s) for p, s in pieces)
        self._parts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall if cut else lambda text: [text] if text else []

    def _best(self, text: str) -> tuple[int, float]:
        size = len(text)
        scores: list[float | None] = [None] * (size + 1)
        counts = [0] * (size + 1)
        scores[0] = 0.0
        single = [False] * size
        ends = self._automaton.iter(text)
        found = next(ends, None)
        for at in range(size):
            best, count = None, 0
            while found is not None and found[0] == at:
                length, score = found[1]  # longest first, that is by ascending start
                total = scores[at + 1 - length] + score
                if length == 1:
                    single[at] = True
                if best is None or total > best:
                    best, count = total, counts[at + 1 - length] + 1
                found = next(ends, None)
            if not single[at]:
                total = scores[at] + self._unknown
                if best is None or total > best:
                    best, count = total, counts[at] + len(text[at].encode("utf-8", "surrogatepass"))
            scores[at + 1], counts[at + 1] = best, count
        return counts[size], scores[size]

    def __missing__(self, part: str) -> tuple[int, float]:
        value = self._best(part)
        if len(part) <= LONGEST_KEPT_PART:
            if len(self) >= PARTS_KEPT:
                self.clear()
            self[part] = value
        return value

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        found = list(map(self.__getitem__, self._parts(MARK + text.replace(" ", MARK))))
        return sum(n for n, _ in found), sum(s for _, s in found)


@functools.lru_cache(maxsize=1)
def _counter(file: str) -> Counter:
    """One per worker, with the parts it has met."""
    return Counter(read_pieces(vocabulary_path(file)))


def count_tokens(docs: DataFrame, file: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_tokens, score`` of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(file)
        for batch in batches:
            found = [counter.count(cell.as_py()) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lambda batches: releasing(run(batches)), "doc_id long, n_tokens long, score double")
