"""Secret scans: fixed rules, and probabilistic automata inferred from labelled credentials.

For each kind of credential the labelled examples form a prefix tree with
counts.  States whose outgoing and ending frequencies do not differ beyond a
Hoeffding bound, here and in all states below, are merged (the test of
ALERGIA), which gives a small probabilistic automaton of the format.  First
states in the same part (between marks that every example has equally often)
and as far from its start are merged, so that all examples vouch for the length
of a part; then states of a part at any distance, so that a part whose length
the examples don't fix becomes a loop and has no greatest length.
Symbols are the literal characters as far as all examples share them and
character classes after that; the characters of a class are equally likely, so
a credential of many digits is no less likely than one of many letters.

In every long run of credential characters, each place outside the rules' spans
where the literal start of a format stands is a candidate, whatever other text
is glued to it.  The format's automaton reads on from there: of the ends where
labelled examples end and where the mean log-likelihood per character reaches
the limit, the last one counts.  The least score of held-back labelled examples
is the limit of a format, so a limit is learnt and not set.  Examples are drawn
from public formats of tokens, or given as a table of labelled credentials.  A credential that
starts before a rule's span and runs into it is a span of its own.

Rules (kept as they are, whatever the automata say): ``assign``, ``access`` and
``hex``, leftmost and non-overlapping per kind.  Positions are code points, the
end exclusive.

Defined results: a null or empty text has no spans; a null ``doc_id`` is passed
through; repeated rows are scanned row by row; spans that start together are
ordered by kind; texts of any length are scanned whole; other columns are
ignored by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.common import releasing

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.-]{20,}")
#: Labelled examples per format, of which the held-back share sets the limit.
EXAMPLES, HELD_BACK, ALPHA, SLACK, SEED = 240, 60, 0.05, 0.1, 7

_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = _DIGIT + _LOWER + _UPPER


def _some(r: random.Random, letters: str, n: int) -> str:
    return "".join(r.choice(letters) for _ in range(n))


#: Labelled credentials: kind and how an example of it is drawn.  Public formats of access tokens.
FORMATS: dict[str, Callable[[random.Random], str]] = {
    "code_host": lambda r: "gh" + r.choice("pousr") + "_" + _some(r, _ALNUM, 36),
    "code_host_pat": lambda r: "glpat-" + _some(r, _ALNUM + "_-", 20),
    "chat": lambda r: "xox" + r.choice("bpas") + "-" + _some(r, _DIGIT, r.randint(10, 12)) + "-" + _some(r, _DIGIT, r.randint(10, 12)) + "-" + _some(r, _ALNUM, 24),
    "map_key": lambda r: "AIza" + _some(r, _ALNUM + "_-", 35),
    "payment": lambda r: "sk_" + r.choice(("live", "test")) + "_" + _some(r, _ALNUM, r.choice((24, r.randint(25, 120)))),
    "package": lambda r: "npm_" + _some(r, _ALNUM, 36),
    "mail": lambda r: "SG." + _some(r, _ALNUM + "_-", 22) + "." + _some(r, _ALNUM + "_-", 43),
    # The least signature is that of HS256.
    "web_token": lambda r: "eyJ" + _some(r, _ALNUM + "_-", r.randint(17, 80)) + ".eyJ" + _some(r, _ALNUM + "_-", r.randint(17, 300)) + "." + _some(r, _ALNUM + "_-", r.choice((43, r.randint(44, 400)))),
}
RULES = ("assign", "access", "hex")


def _class(c: str) -> str:
    return "d" if c in _DIGIT else "l" if c in _LOWER else "U" if c in _UPPER else c


#: How many characters a class has, each as likely as the others; a literal or mark is one.
_SIZES = {"d": len(_DIGIT), "l": len(_LOWER), "U": len(_UPPER)}


class Automaton:
    """A probabilistic deterministic automaton merged from the prefix tree of ``examples``."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        first, last = min(examples), max(examples)
        self.literal = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
        self.prefix = first[: self.literal]
        self.alpha = alpha
        #: Symbols met at all, and marks that all examples have equally often: another symbol, or one mark more, is not of the format.
        self.alphabet = {_class(c) for text in examples for c in text}
        self.marks = {c for c in self.alphabet if not c.isalnum() and len({text.count(c) for text in examples}) == 1}
        self._ends: list[int] = [0]
        self._seen: list[int] = [0]
        self._next: list[dict[str, tuple[int, int]]] = [{}]  # symbol: state, count
        for text in examples:
            state = 0
            for symbol in self.symbols(text):
                self._seen[state] += 1
                to, count = self._next[state].get(symbol, (len(self._next), 0))
                if not count:
                    self._ends.append(0)
                    self._seen.append(0)
                    self._next.append({})
                self._next[state][symbol] = (to, count + 1)
                state = to
            self._seen[state] += 1
            self._ends[state] += 1
        self._merge_all()

    def symbols(self, text: str) -> Iterator[str]:
        for i, c in enumerate(text):
            yield "=" + c if i < self.literal else _class(c)

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        open_, met = [(a, b)], {(a, b)}
        while open_:
            a, b = open_.pop()
            n, m = self._seen[a], self._seen[b]
            if self._differ(self._ends[a], n, self._ends[b], m):
                return False
            for symbol in {*self._next[a], *self._next[b]}:
                (x, i), (y, j) = self._next[a].get(symbol, (-1, 0)), self._next[b].get(symbol, (-1, 0))
                if self._differ(i, n, j, m):
                    return False
                if x >= 0 and y >= 0 and x != y and (x, y) not in met:
                    met.add((x, y))
                    open_.append((x, y))
        return True

    def _find(self, state: int) -> int:
        """The state that ``state`` was merged into."""
        while self._into[state] != state:
            self._into[state] = state = self._into[self._into[state]]
        return state

    def _fold(self, a: int, b: int) -> None:
        """Merge ``b`` into ``a``, and what the same symbols then lead to."""
        open_ = [(a, b)]
        while open_:
            a, b = map(self._find, open_.pop())
            if a == b:
                continue
            self._into[b] = a
            self._seen[a] += self._seen[b]
            self._ends[a] += self._ends[b]
            for symbol, (y, j) in self._next[b].items():
                x, i = self._next[a].get(symbol, (y, 0))
                self._next[a][symbol] = (x, i + j)
                open_.append((x, y))

    def _follow(self) -> None:
        """Let all transitions of the states that are left lead to states that are left."""
        for state, into in enumerate(self._into):
            if state == into:
                self._next[state] = {symbol: (self._find(to), count) for symbol, (to, count) in self._next[state].items()}

    def _merge_all(self) -> None:
        """States as far from the start of the same part, in order, and then those of a part at any distance."""
        self._into = list(range(len(self._next)))
        levels: dict[tuple[int, int], list[int]] = {(0, 0): [0]}
        todo = [(0, 0)]
        while todo:
            part, far = here = heapq.heappop(todo)
            blue, red = [*dict.fromkeys(map(self._find, levels[here]))], []
            for state in blue:
                if self._find(state) != state:
                    continue
                same = next((r for r in red if self._compatible(r, state)), None)
                if same is None:
                    red.append(state)
                else:
                    self._fold(same, state)
            levels[here] = red
            for state in red:
                for symbol in sorted(self._next[state]):
                    after = (part + 1, 0) if symbol.lstrip("=") in self.marks else (part, far + 1)
                    if after not in levels:
                        levels[after] = []
                        heapq.heappush(todo, after)
                    levels[after].append(self._next[state][symbol][0])
        self._follow()
        red, at = [], -1
        for (part, _), states in sorted(levels.items()):
            if part != at:
                red, at = [], part
            for state in states:
                if self._find(state) != state:
                    continue
                same = next((r for r in red if self._compatible(r, state)), None)
                if same is None:
                    red.append(state)
                else:
                    self._fold(same, state)
                    self._follow()
        self.states = sum(state == into for state, into in enumerate(self._into))

    def score(self, text: str) -> float:
        """Mean log-likelihood per symbol; minus infinity if a literal or mark differs or the text goes on or ends where no example does."""
        state, total, n = 0, 0.0, 1
        for symbol in self.symbols(text):
            found = self._next[state].get(symbol)
            if found is None:
                if symbol.startswith("=") or symbol in self.marks or symbol not in self.alphabet or not self._next[state]:
                    return -math.inf
                found = (max(self._next[state].values(), key=lambda x: x[1])[0], 0.5)  # a class not met here
            total += math.log(found[1] / (self._seen[state] + 0.5) / _SIZES.get(symbol, 1))
            state, n = found[0], n + 1
        return (total + math.log(self._ends[state] / (self._seen[state] + 0.5))) / n if self._ends[state] else -math.inf


    def last_end(self, text: str, start: int, stop: int, limit: float, barren: set[tuple[int, int]]) -> int:
        """The last place up to ``stop`` where what begins at ``start`` may end as examples do with a score of ``limit``; -1 if there is none.

        ``barren`` holds places and states from which no end follows, and gets
        those met here, so that many starts in one run don't each read all of it.
        """
        state, total, end, ends, path = 0, 0.0, -1, False, []
        for at in range(start, stop):
            c, n = text[at], at - start + 1
            symbol = "=" + c if n <= self.literal else _class(c)
            found = self._next[state].get(symbol)
            if found is None:
                if n <= self.literal or symbol in self.marks or symbol not in self.alphabet or not self._next[state]:
                    break
                found = (max(self._next[state].values(), key=lambda x: x[1])[0], 0.5)  # a class not met here
            total += math.log(found[1] / (self._seen[state] + 0.5) / _SIZES.get(symbol, 1))
            state = found[0]
            if (at, state) in barren:
                break
            if self._ends[state]:
                ends = True
                if (total + math.log(self._ends[state] / (self._seen[state] + 0.5))) / (n + 1) >= limit:
                    end = at + 1
            path.append((at, state))
        if not ends:
            barren.update(path)
        return end


def drawn_examples(seed: int = SEED, count: int = EXAMPLES) -> dict[str, list[str]]:
    """Labelled credentials of the public formats, by kind."""
    made = {}
    for kind, draw in FORMATS.items():
        r = random.Random(f"{seed} {kind}")
        made[kind] = [draw(r) for _ in range(count)]
    return made


def labelled_examples(rows: DataFrame, most: int = EXAMPLES) -> dict[str, list[str]]:
    """Labelled credentials from a table ``kind, text``: at most ``most`` of a kind, the bound of what reaches the driver, chosen by a hash.

    Nulls and rows that repeat are left out.
    """
    whole = rows.select(rows["kind"].cast("string").alias("kind"), rows["text"].cast("string").alias("text")).dropna().distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64(F.lit(SEED), "text"), "text")
    picked = whole.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    made: dict[str, list[str]] = {}
    for r in picked.orderBy("kind", "place").collect():
        made.setdefault(r["kind"], []).append(r["text"])
    return made


def learn(labelled: dict[str, list[str]]) -> list[tuple[str, Automaton, float]]:
    """Kind, automaton and limit of each format; a quarter of the examples is held back for the limit."""
    formats = []
    for kind, examples in labelled.items():
        held_back = len(examples) * HELD_BACK // EXAMPLES
        automaton = Automaton(examples[held_back:])
        held = [s for s in map(automaton.score, examples[:held_back] or examples) if s > -math.inf]
        if automaton.prefix and held:
            formats.append((kind, automaton, min(held) - SLACK))
    return formats


@functools.cache
def _learnt() -> list[tuple[str, Automaton, float]]:
    """What the drawn examples teach; once per worker."""
    return learn(drawn_examples())


class Scanner:
    """Finds spans in a text."""

    def __init__(self, labelled: dict[str, list[str]] | None = None) -> None:
        self._formats = _learnt() if labelled is None else learn(labelled)
        self._kinds = {kind: k for k, kind in enumerate(dict.fromkeys((*RULES, *(kind for kind, _, _ in self._formats))))}
        self._starts = re.compile("|".join(re.escape(automaton.prefix) for _, automaton, _ in self._formats) or r"(?!)")

    def _order(self, span: tuple[int, int, str]) -> tuple[int, int, int]:
        return span[0], self._kinds[span[2]], span[1]

    def credentials(self, text: str, start: int, stop: int, taken: tuple[list[int], list[int]]) -> Iterator[tuple[int, int, str]]:
        """Credentials in a run of credential characters, leftmost and non-overlapping, that don't start in what is ``taken`` (starts and ends, apart and in order)."""
        at, barren = start, {kind: set() for kind, _, _ in self._formats}
        while m := self._starts.search(text, at, stop):
            a = m.start()
            k = bisect_right(taken[0], a) - 1
            if k >= 0 and a < taken[1][k]:
                at = taken[1][k]
                continue
            end, kind = max(((automaton.last_end(text, a, stop, limit, barren[kind]), kind) for kind, automaton, limit in self._formats if text.startswith(automaton.prefix, a)), key=lambda x: x[0])
            if end > a:
                yield a, end, kind
            at = max(end, a + 1)

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        if "AKIA" in text:
            found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
        return sorted(found, key=self._order)

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """The rules' spans, and all spans."""
        base = self.base(text)
        starts: list[int] = []
        ends: list[int] = []
        for a, b, _ in base:  # stretches of rules' spans that overlap
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        more = []
        for m in CANDIDATE.finditer(text):
            more += self.credentials(text, *m.span(), (starts, ends))
        return base, sorted(base + more, key=self._order) if more else base


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, labelled: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id``, the rules' counts, ``base`` and ``spans`` of every document; spans as ``kind:start:end``, comma-joined.

    ``labelled``: credentials by kind to learn formats from; without it, examples drawn from public formats.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(labelled)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for cell in batch.column(1):
                base, spans = scanner.spans(cell.as_py() or "")
                kinds = [kind for _, _, kind in base]
                for column, value in zip(columns, (*(kinds.count(k) for k in RULES), listed(base), listed(spans)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    view = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return view.mapInArrow(lambda batches: releasing(run(batches)), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """``text`` with every stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", labelled: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, and ``n_chars``, if there, counted anew; no row is dropped."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever dots or repeats the names hold
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(labelled)
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None else redacted(t, scanner.spans(t)[1], mark) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            if chars is not None:
                columns[chars] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[chars].to_pylist(), old, new, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return plain.mapInArrow(lambda batches: releasing(run(batches)), plain.schema).toDF(*docs.columns)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
