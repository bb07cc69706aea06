"""Language identification with averaged hashed subword embeddings.

The subwords of a text are its byte runs of two to four bytes, lower-cased,
with white space as one blank; each is hashed to a row of an embedding table.
The mean of the rows goes through a linear softmax.  Both tables are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows.

After training, embedding and softmax are multiplied into one small table of
logits per subword, so prediction adds up table rows.  A temperature, fitted
on a part of the sample that was not trained on, makes scores probabilities;
a threshold, fitted there too, marks predictions to reject (``accepted``).

About ``PER_LANGUAGE`` labelled rows are taken of each language, at most twice as
many, chosen by a hash of the row among those of at most ``LONGEST_EXAMPLE``
bytes; that is the documented bound of what reaches the driver.  Learning and
prediction read texts whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a null ``doc_id`` is held out or not as the crc32 of the empty text says; ties
go to the language that sorts first; repeated rows are predicted row by row;
without a labelled row every prediction is ``und``; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import releasing

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
PER_LANGUAGE, LONGEST_EXAMPLE = 600, 1 << 16
EPOCHS, BATCH, RATE, SEED = 8, 32, 4.0, 2024
#: Bytes whose subwords are looked up at a time.
BLOCK = 1 << 18
UNKNOWN = "und"
#: A letter by Unicode's category; the plainer pattern is faster and finds no fewer.
_LETTER, _WORDLIKE = regex.compile(r"\p{L}"), re.compile(r"[^\W\d_]")
_MULTIPLIERS = (0x01000193, 0x5BD1E995, 0x2C1B3C6D, 0x297A2D39)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of all runs of each size."""
    wide = _FOLD[data].astype(np.uint32) + np.uint32(1)
    found = []
    for size in SIZES:
        count = len(wide) - size + 1
        if count > 0:
            value = np.full(count, size, np.uint32)
            for k in range(size):
                value = value * np.uint32(_MULTIPLIERS[k]) ^ wide[k : k + count]
            value ^= value >> np.uint32(15)
            found.append((value * np.uint32(0x9E3779B1)) >> np.uint32(17))
    return found


def has_letter(text: str) -> bool:
    found = _WORDLIKE.search(text)
    return found is not None and _LETTER.search(text, found.start()) is not None


def _padded(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, text: str) -> np.ndarray:
        data, total, count = _padded(text), np.zeros(len(self.languages)), 0
        for at in range(0, len(data), BLOCK):
            for rows in subwords(data[at : at + BLOCK + max(SIZES) - 1]):
                rows = rows[:BLOCK]  # runs that start in this block
                if len(rows) < BUCKETS:
                    total += self.logits[rows].sum(axis=0)
                else:
                    total += np.bincount(rows, minlength=BUCKETS) @ self.logits
                count += len(rows)
        return total / max(count, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.scores(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, max(0.0, p[best])))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit on (text, language) pairs."""
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    held = max(1, len(rows) // 5) if len(rows) >= 20 else 0
    number = {lang: k for k, lang in enumerate(languages)}
    target = np.array([number[rows[i][1]] for i in order])
    features = []
    for i in order:
        counts = np.bincount(np.concatenate([*subwords(_padded(rows[i][0])), np.empty(0, np.uint32)]), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        features.append((used, (counts[used] / counts.sum()).astype(np.float32)))
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 1 / DIM, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    share = np.bincount(target[held:], minlength=len(languages))
    cost = (len(target) - held) / np.maximum(share, 1) / len(languages)  # rare languages count as much as frequent ones
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        mixed = held + rng.permutation(len(rows) - held)
        for at in range(0, len(mixed), BATCH):
            part = mixed[at : at + BATCH]
            mean = np.stack([f @ embed[u] for u, f in (features[i] for i in part)])
            error = _softmax(mean @ weight + bias)
            error[np.arange(len(part)), target[part]] -= 1
            error *= (cost[target[part]] / len(part))[:, None]
            back = error @ weight.T
            weight -= (rate * (mean.T @ error)).astype(np.float32)
            bias -= (rate * error.sum(axis=0)).astype(np.float32)
            for k, i in enumerate(part):
                used, f = features[i]
                embed[used] -= (rate * len(used) ** 0.5) * f[:, None] * back[k].astype(np.float32)
    logits = (embed @ weight).astype(np.float64)
    model = Model(languages, logits, bias.astype(np.float64), 1.0, 0.0)
    if held:
        raw = np.stack([f @ logits[u] for u, f in features[:held]]) + bias
        grid = np.geomspace(0.02, 20, 60)
        loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(held), target[:held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(raw / model.temperature)
        right = p.argmax(axis=1) == target[:held]
        # The least score from which on at least 99 of 100 held-out predictions are right.
        best = np.sort(p.max(axis=1))
        model.threshold = float(next((s for s in best if right[p.max(axis=1) >= s].mean() >= 0.99), best[-1]))
    return model


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most about ``per_language`` labelled rows of each language, chosen by a hash and spread over all input."""
    view = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    labelled = view.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST_EXAMPLE) & ~held_out())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1_000_000))
    cuts = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1_000_000, 1 + 1_000_000 * per_language // n))) for lang, n in sorted(counts.items())])
    picked = labelled.where(draw < cuts).orderBy(draw, "doc_id", "text").limit(2 * per_language * len(counts))
    rows = picked.select("text", "lang").collect()
    return [(r["text"], r["lang"]) for r in rows if has_letter(r["text"])]


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every document."""
    model = model or train(sample(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(cell.as_py()) for cell in batch.column(2)]
            lang, score = [x for x, _ in found], [s for _, s in found]
            accepted = [x != UNKNOWN and s >= model.threshold for x, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    view = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return view.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lambda batches: releasing(run(batches)), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
