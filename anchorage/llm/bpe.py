"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The merge ranks are compiled into a trie of token bytes and a test of which
two tokens may stand next to each other.  The transducer reads bytes.  Its
state holds every start from which a longer token could still come: the last
token before that start and the trie node of the bytes since it.  Each byte
gives the last token of the prefix that it ends.  Followed back from the open
starts, these tokens meet at some place; whatever comes, the encoding runs
through it, so all that precedes is settled and is emitted.  No start is open
for longer than the longest token, and back-traces meet soon before: on runs of
equal or repeated characters too, output lags the input by less than three times
the longest token and ``SETTLE`` bytes (tests hold this bound).  States and
transitions are built the first time they are met and kept in a bounded table,
as a lazy DFA does.

Why that is right: let ``last(i)`` be the last token of the encoding of the
first ``i`` bytes.  Byte-pair merging is prefix consistent, so that encoding
is the one of the first ``i - len(last(i))`` bytes followed by ``last(i)``,
and a token can follow another exactly if merging their joined bytes gives
back these two.  Of all tokens that end at ``i`` exactly one fits.

Defined results: a null text counts as empty; an empty text has no ids; a text
of any length is read once; a null ``doc_id`` is passed through; repeated rows
are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from anchorage.llm.common import releasing, vocabulary_path

#: Entries kept for whole pieces, states kept in the lazy table, and pairs of tokens known to stand together or not.
PIECES_KEPT, STATES_KEPT, FITS_KEPT = 300_000, 120_000, 400_000
#: How many times as many a worker keeps that goes from task to task with the same tables.
WARM = 3
#: Documents whose ids are held at a time.
SLICE = 250
#: Longer pieces are encoded each time, so that one odd text can't fill memory.
LONGEST_KEPT_PIECE = 48
#: After so many bytes of a piece, settled tokens are looked for and emitted.
SETTLE = 64
#: Tokens handed to the decoder at a time.
DECODE_STEP = 8192
#: Room for the number of a token or trie node within a larger number.
_BITS = 24
_MASK = (1 << _BITS) - 1


#: Latin letters, and texts of these, printing ASCII characters, blanks and line ends alone.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_COMMON = re.compile(f"[\n -~{LATIN[6:]}]*").fullmatch


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging as defined: join the leftmost pair of least rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece in, token ids out.  ``room``: how many times the usual entries to keep."""

    def __init__(self, ranks: dict[bytes, int], room: int = 1):
        self.ranks, self.room = ranks, room
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length_of = {i: len(b) for b, i in ranks.items()}
        #: The trie: by node and byte in one number the next node; by node its token, depth and whether it has more below it.
        self._child: dict[int, int] = {}
        self._token: list[int] = [-1]
        self._depth: list[int] = [0]
        self._open: list[bool] = [True]
        #: Most bytes of a piece that were read and not yet emitted, so far.
        self.most_held = 0
        for token, number in ranks.items():
            node = 0
            for byte in token:
                after = self._child.get(node << 8 | byte)
                if after is None:
                    after = self._child[node << 8 | byte] = len(self._token)
                    self._token.append(-1)
                    self._depth.append(self._depth[node] + 1)
                    self._open.append(False)
                    self._open[node] = True
                node = after
            self._token[node] = number
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # Each open start in one number: the last token before it plus one, and the trie node since it.
        start = (0,)
        self._states = [start]
        self._number = {start: 0}
        # By state and byte in one number: the next state, moved to make room for a byte, and the token that ends there in another.
        self._next: dict[int, int] = {}

    def _made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes this one; itself twice for a byte; None if merging never makes it."""
        if token not in self._halves:
            data = self.bytes_of[token]
            if len(data) == 1:
                self._halves[token] = (token, token)
            else:
                below = {k: v for k, v in ((data[i:j], self.ranks.get(data[i:j])) for i in range(len(data)) for j in range(i + 1, len(data) + 1)) if v is not None and k != data}
                parts = merge_by_rank(data, below)
                self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 and merge_by_rank(data, self.ranks) == [token] else None
        return self._halves[token]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes leaves the boundary between the two alone.

        Undo the merges on both sides of the boundary, the latest first.  A
        token across it would have won if its rank is lower than that of the
        merge that was undone last.
        """
        if self._made_of(right) is None:
            return False
        if left < 0:
            return True
        known = self._fits.get(left + 1 << _BITS | right)
        if known is not None:
            return known
        if len(self._fits) > FITS_KEPT * self.room:
            self._fits.clear()
        a, b, bound = left, right, len(self.ranks) + 1
        fits = True
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < bound:
                fits = False
                break
            single_a, single_b = len(self.bytes_of[a]) == 1, len(self.bytes_of[b]) == 1
            if single_a and single_b:
                break
            if not single_a and (single_b or a > b):
                bound, a = a, self._made_of(a)[1]
            else:
                # Of equal ranks the leftmost pair is joined first, so one across the boundary wins.
                bound, b = b + 1, self._made_of(b)[0]
        self._fits[left + 1 << _BITS | right] = fits
        return fits

    def _step(self, base: int, byte: int) -> int:
        """Build the transition of a state on ``byte``."""
        going, ended = [], -1
        child, tokens, open_, fits = self._child.get, self._token, self._open, self._fits.get
        for start in self._states[base >> 8]:
            after = child((start & _MASK) << 8 | byte)
            if after is not None:
                before = start & ~_MASK
                token = tokens[after]
                if ended < 0 <= token:
                    fit = fits(before | token)
                    if self._may_follow((start >> _BITS) - 1, token) if fit is None else fit:
                        ended = token
                if open_[after]:
                    going.append(before | after)
        if ended < 0:
            raise ValueError(f"no token for byte {byte}")
        going.append(ended + 1 << _BITS)
        made = tuple(going)
        number = self._number.get(made)
        if number is None:
            number = self._number[made] = len(self._states)
            self._states.append(made)
        found = self._next[base | byte] = number << _BITS + 8 | ended
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > STATES_KEPT * self.room:
            self._reset()
        base, ids, ends = 0, [], []
        known, step, add = self._next.get, self._step, ends.append
        for at in range(0, len(piece), SETTLE):
            for byte in piece[at : at + SETTLE]:
                found = known(base | byte)
                if found is None:
                    found = step(base, byte)
                base = found >> _BITS
                add(found)
            if at + SETTLE < len(piece):
                self._settle(self._states[base >> 8], ends, ids)
        self._emit(ends, len(ends), ids)
        return ids

    def _settle(self, state: tuple[int, ...], ends: list[int], ids: list[int]) -> None:
        """Emit what precedes the place where the back-traces of all open starts meet."""
        self.most_held = max(self.most_held, len(ends))
        places = {len(ends) - self._depth[start & _MASK] for start in state}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.length_of[ends[last - 1] & _MASK])
        at = places.pop()
        self._emit(ends, at, ids)
        del ends[:at]

    def _emit(self, ends: list[int], at: int, ids: list[int]) -> None:
        """Follow the last tokens, which ``ends`` holds beside the states, back from ``at``."""
        found, length_of = [], self.length_of
        while at > 0:
            token = ends[at - 1] & _MASK
            found.append(token)
            at -= length_of[token]
        ids.extend(reversed(found))


class Encoder(dict):
    """Text to ids.  As a dict: a piece and its ids in decimal, joined by spaces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 1):
        import regex

        super().__init__()
        self.transducer = Transducer(ranks, room)
        self._decimal = {i: str(i) for i in ranks.values()}
        # The white space of Unicode, without the four separators that Python adds to \s.
        self._pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # In texts of common characters alone the classes are short lists, which the plainer library searches faster.
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^ \n{LATIN}0-9]").replace(r"\p{L}", f"[{LATIN}]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[ \n]").replace(r"\S", r"[^ \n]")
        self._narrow_pieces = None if r"\p" in narrow else re.compile(narrow).findall

    def __missing__(self, piece: str) -> str:
        ids = " ".join(map(self._decimal.__getitem__, self.transducer.encode(piece.encode("utf-8", "surrogatepass"))))
        if len(piece) <= LONGEST_KEPT_PIECE:
            if len(self) >= PIECES_KEPT * self.transducer.room:
                self.clear()
            self[piece] = ids
        return ids

    def decimal(self, text: str) -> str:
        pieces = self._narrow_pieces if self._narrow_pieces and _COMMON(text) else self._pieces
        return " ".join(map(self.__getitem__, pieces(text)))


class Utf8Stream:
    """Incremental UTF-8: feed bytes as they come, get the text that is complete.

    The state is the unfinished sequence.  A byte that can't go on becomes
    U+FFFD, as in a lenient decoder.
    """

    def __init__(self) -> None:
        self._open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end may still become one character."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                wanted = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0
                if wanted <= back:
                    return 0
                if back > 1:
                    second = data[-back + 1]
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                    if not low <= second <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self._open + data
        keep = self._unfinished(data)
        self._open = data[len(data) - keep :] if keep else b""
        return (data[: len(data) - keep] if keep else data).decode("utf-8", "replace")

    def close(self) -> str:
        left, self._open = self._open, b""
        return left.decode("utf-8", "replace")


class Decoder:
    """Ids to bytes and text, a step at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self._bytes = {str(i): b for b, i in ranks.items()}

    def steps(self, ids: str) -> Iterator[bytes]:
        numbers = ids.split(" ") if ids else []
        for at in range(0, len(numbers), DECODE_STEP):
            yield b"".join(map(self._bytes.__getitem__, numbers[at : at + DECODE_STEP]))

    def text(self, ids: str) -> str:
        stream = Utf8Stream()
        return "".join([*(stream.feed(b) for b in self.steps(ids)), stream.close()])


def encode(docs: DataFrame, file: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: ids in decimal joined by one space, and what they decode to.

    Tables are given back at the end of a task, as other steps may follow.
    """
    return _mapped(docs, file, pattern, digests=False)


def encode_digests(docs: DataFrame, file: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of the ids and the decoded text; workers keep their tables from task to task."""
    return _mapped(docs, file, pattern, digests=True)


def _tables(file: str, pattern: str, room: int = 1) -> tuple[Encoder, Decoder]:
    ranks = read_ranks(vocabulary_path(file))
    return Encoder(ranks, pattern, room), Decoder(ranks)


@functools.lru_cache(maxsize=1)
def _warm_tables(file: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One pair per worker."""
    return _tables(file, pattern, WARM)


def _mapped(docs: DataFrame, file: str, pattern: str | None, digests: bool) -> DataFrame:
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder, decoder = (_warm_tables if digests else _tables)(file, pattern or public_tokenizers.PATTERN)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                counts, first, second = [], [], []
                for cell in part.column(1):
                    ids = encoder.decimal(cell.as_py() or "")
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    if digests:
                        first.append(hashlib.sha256(ids.encode()).hexdigest())
                        sha = hashlib.sha256()
                        stream = Utf8Stream()
                        for data in decoder.steps(ids):
                            sha.update(stream.feed(data).encode())
                        sha.update(stream.close().encode())
                        second.append(sha.hexdigest())
                    else:
                        first.append(ids)
                        second.append(decoder.text(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=["doc_id", "n_tokens", *names],
                )

    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return kept.mapInArrow(lambda batches: releasing(run(batches)), f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")
