"""Quality rules as a bitmask ledger, in DataFrame expressions only.

:func:`ledger` evaluates every rule once per document and stores what was
measured and one failure bit per rule.  A policy is a versioned set of rules;
:func:`apply_policy` decides with one bitwise AND, so a new policy needs no
second look at the texts.  :func:`ablations` counts, from the bits alone, what
each rule rejects and what would come back without it.

No row leaves its partition while rules are evaluated: all measurements come
from the row's own text.  The ablation aggregates by bit pattern first, of
which there are at most ``2 ** len(RULES)``.

Defined results: a null or empty text has no words and fails ``few_words``;
a null ``doc_id`` is passed through; repeated rows are judged row by row;
texts are never cut; other columns are ignored; an empty table gives an empty
ledger and zero counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import quoted, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Scripts that are written without a space between words.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
#: Words in a window that counts as a repetition when found again.
WINDOW = 3

#: Bit by bit, the rules in order.  Bits are never given a new meaning; append new rules.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "word_length": "word_chars > 10 * n_words or word_chars < 3 * n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
    # As word_length, but not for texts mostly in scripts that put no space between words.
    "spaced_word_length": "2 * n_unspaced <= word_chars and (word_chars > 10 * n_words or word_chars < 3 * n_words)",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


#: Published policies.  A version keeps its meaning; change by adding a version.
POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, (*BASE, "symbols", "repeated_lines", "word_length", "capitals")),
    3: Policy(3, (*BASE, "symbols", "repeated_lines", "spaced_word_length", "capitals")),
}
CURRENT = 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three found twice or more."""

    def of_words(w: Column) -> Column:
        grams = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
        return _let(grams, of_grams)

    def of_grams(g: Column) -> Column:
        found = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(found, of_sorted))

    def of_sorted(s: Column) -> Column:
        def same(x: Column, at: Column) -> Column:
            return F.coalesce(F.get(s, at)["g"] == x["g"], F.lit(False))

        again = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    return _let(words, of_words)


def _measured(view: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``view`` and the measurements of its column ``text``."""
    text = text_or_empty()
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return view.select(
        *kept,
        _let(words, of_words).alias("_w"),
        _let(lines, of_lines).alias("_l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        # These take three bytes or more; the rest needs no second look.
        F.when(F.octet_length(text) >= 2 * F.length(text), F.regexp_count(text, F.lit("[" + "".join(rf"\p{{Is{name}}}" for name in UNSPACED) + "]"))).otherwise(0).cast("long").alias("n_unspaced"),
    ).select(*kept, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_capitals", "n_unspaced")


def _with_bits(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return measured.withColumn("fail_bits", bits)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the measurements and ``fail_bits``, bit k for the k-th rule."""
    view = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return _with_bits(_measured(view, ["doc_id"]))


def apply_policy(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``policy_version`` and ``kept``."""
    return entries.withColumn("policy_version", F.lit(version)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version].mask)) == 0)


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of the policy: documents, those that fail it, those that fail no other rule of the policy, those rejected in all."""
    policy = POLICIES[version]
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])
    one = patterns.select("bits", "n", F.explode(rules).alias("r"))
    n = F.col("n")
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(n).alias("n_docs"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), n).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits") != 0, n).otherwise(0)).alias("n_rejected"),
    )


def judge(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with the base verdict and the policy's."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE))) != 0
    out = apply_policy(ledger(docs), version).withColumn("base_failed", base).withColumn("kept", F.col("kept") & ~F.col("base_failed"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy_version")


def kept_documents(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the base rules and the policy keep, with all their columns, row by row."""
    view = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("_row"), docs["text"].cast("string").alias("text"))
    mask = POLICIES[version].mask | mask_of(BASE)
    return _with_bits(_measured(view, ["_row"])).where(F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0).select("_row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
g AS (SELECT doc_id, gram FROM p GROUP BY doc_id, gram HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (
    SELECT p.doc_id, p.i, unnest([0, 1, 2]) AS k FROM p JOIN g ON p.doc_id = g.doc_id AND p.gram = g.gram) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(regexp_extract_all(w.text, '\p{Lu}'))::BIGINT AS n_capitals,
    CASE WHEN strlen(w.text) >= 2 * length(w.text) THEN len(regexp_extract_all(w.text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')) ELSE 0 END::BIGINT AS n_unspaced
    FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 16 * (word_chars > 10 * n_words OR word_chars < 3 * n_words)::BIGINT
    + 32 * (100 * n_capitals > 40 * word_chars)::BIGINT
    + 64 * (2 * n_unspaced <= word_chars AND (word_chars > 10 * n_words OR word_chars < 3 * n_words))::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits & 111 = 0 AS kept, fail_bits, 3 AS policy_version FROM b
"""
