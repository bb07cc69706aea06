"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame expressions only.

A paragraph is a block that ends at a line end, after a clause mark and a
blank, or after ``BLOCK`` code points.  A section ends after a paragraph whose
digest begins below ``SECTION_END``, so where sections end depends on content
and an edit moves no border but its own.  A section's digest covers those of
its paragraphs, the root those of the sections.

A fingerprint is a string of three levels, ``root:sections:paragraphs``, the
lower two as short digests joined by full stops.  Equal texts have equal
roots; where roots differ, the branches that differ locate the edit
(:func:`edits`): sections are compared first, from both ends, and paragraphs
only within the sections between.  :func:`likeness` is the share of paragraphs
that two fingerprints have in common (Dice, over distinct paragraphs), 1 if and
only if the roots are equal.

Neighbours by ``doc_id`` (:func:`with_next`) are found without bringing the
table together: ids alone are dealt out by ranges and written down, each range
finds its own neighbours, and the last ids of the ranges, one row per range,
join the ranges.  A text is then sent on only as far as its receiver needs it.

Defined results: a null text counts as empty; an empty text has no paragraphs,
and two of these are alike (1); a null ``doc_id`` comes before all others; of
rows that repeat ``doc_id`` and text one is kept, or with ``repeated`` all are,
each with the same next document; rows that repeat ``doc_id`` with other texts
follow each other by a hash of the text; a single document is its own next;
other columns are ignored; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.common import cut, ranges_for

BLOCK = 40
PARAGRAPH = rf"(?s).{{1,{BLOCK}}}?(?:[.,;:!?] |\n|\z)|.{{1,{BLOCK}}}"
#: Hexadecimal digit from which on a paragraph doesn't end a section: one in eight does.
SECTION_END = "2"
SHORT = 8
#: What tells documents apart, in order: whether there is an id, the id, a hash of the text.
KEY = ["given", "id", "tie"]


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string."""

    def short(digests: Column) -> Column:
        return F.array_join(F.transform(digests, lambda d: F.substring(d, 1, SHORT)), ".")

    def of_paragraphs(p: Column) -> Column:
        lines = F.array_join(F.transform(p, lambda d: F.concat(d, F.when(d < SECTION_END, F.lit(";")).otherwise(F.lit(",")))), "")
        sections = F.transform(F.array_remove(F.split(lines, ";"), ""), lambda s: F.md5(s.cast("binary")))
        return _let(sections, lambda s: F.concat_ws(":", F.sha2(F.array_join(s, ""), 256), short(s), short(p)))

    paragraphs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return _let(F.transform(paragraphs, lambda p: F.md5(p.cast("binary"))), of_paragraphs)


def _level(print_: Column, level: int) -> Column:
    return F.array_remove(F.split(F.split_part(print_, F.lit(":"), F.lit(level)), r"\."), "")


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1; below 1 where the roots differ."""

    def dice(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        both = F.nullif(F.size(x) + F.size(y), F.lit(0))
        return F.coalesce(F.least(2.0 * F.size(F.array_intersect(x, y)) / both, 1.0 - 1.0 / both), F.lit(0.0))

    both = F.struct(F.array_distinct(_level(a, 3)).alias("x"), F.array_distinct(_level(b, 3)).alias("y"))
    return F.when(F.split_part(a, F.lit(":"), F.lit(1)) == F.split_part(b, F.lit(":"), F.lit(1)), F.lit(1.0)).otherwise(_let(both, dice))


def _same_at_start(x: Column, y: Column) -> Column:
    """How many items two arrays have in common from the start."""
    return F.aggregate(
        F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, same: F.struct((s["on"] & same).alias("on"), (s["n"] + (s["on"] & same).cast("int")).alias("n")), lambda s: s["n"]
    )


def _between(pair: Column, of) -> Column:
    """What lies in arrays ``x`` and ``y`` of a struct between what both start and end with, ``of`` telling items apart."""

    def cut_ends(p: Column) -> Column:
        least = F.least(F.size(p["x"]), F.size(p["y"]))
        tail = F.least(_same_at_start(F.reverse(F.transform(p["x"], of)), F.reverse(F.transform(p["y"], of))), least - p["head"])
        return F.struct(*[F.slice(p[side], p["head"] + 1, F.size(p[side]) - p["head"] - tail).alias(side) for side in "xy"])

    headed = F.struct(pair["x"].alias("x"), pair["y"].alias("y"), _same_at_start(F.transform(pair["x"], of), F.transform(pair["y"], of)).alias("head"))
    return _let(headed, cut_ends)


def edits(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: zero-based numbers of the paragraphs ``gone`` from the first and ``new`` in the second.

    Of the stretch from the first difference to the last, these are the
    paragraphs that the other's stretch lacks, or, if it lacks none (as where
    paragraphs change places), all of the stretch.  None if the roots are equal.
    """

    def sections(print_: Column) -> Column:
        # Each section as its short digest and its paragraphs with their numbers.
        lines = F.array_join(F.transform(_level(print_, 3), lambda d, i: F.concat(d, F.lit("@"), i.cast("string"), F.when(d < SECTION_END, F.lit(";")).otherwise(F.lit(",")))), "")
        return F.arrays_zip(_level(print_, 2).alias("digest"), F.array_remove(F.split(lines, ";"), "").alias("leaves"))

    def leaves(differing_sections: Column) -> Column:
        return F.flatten(F.transform(differing_sections, lambda s: F.array_remove(F.split(s["leaves"], ","), "")))

    def digest(leaf: Column) -> Column:
        return F.split_part(leaf, F.lit("@"), F.lit(1))

    def numbers(own: Column, other: Column) -> Column:
        def of(lacking: Column) -> Column:
            return F.transform(F.filter(own, lambda leaf: (F.size(lacking) == 0) | F.array_contains(lacking, digest(leaf))), lambda leaf: F.split_part(leaf, F.lit("@"), F.lit(2)).cast("int"))

        return _let(F.array_except(F.transform(own, digest), F.transform(other, digest)), of)

    stretch = _let(F.struct(sections(a).alias("x"), sections(b).alias("y")), lambda pair: _between(pair, lambda s: s["digest"]))
    inner = _let(stretch, lambda s: _between(F.struct(leaves(s["x"]).alias("x"), leaves(s["y"]).alias("y")), digest))
    return _let(inner, lambda s: F.struct(numbers(s["x"], s["y"]).alias("gone"), numbers(s["y"], s["x"]).alias("new")))


def differing(a: Column, b: Column) -> Column:
    """Zero-based numbers of the paragraphs of ``b`` where it differs from ``a`` (see :func:`edits`)."""
    return edits(a, b)["new"]


def _next_keys(keys: DataFrame, parts: int) -> DataFrame:
    """``keys`` (distinct ``KEY`` and ``n``) with the key that precedes each, the last one preceding the first."""
    ranged = cut(keys.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()), "order")
    key = F.struct(*KEY)
    inside = ranged.withColumn("before", F.lag(key).over(Window.partitionBy("part").orderBy(*KEY)))
    # One row per range.
    ends = ranged.groupBy("part").agg(F.max(key).alias("end")).groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "end"))).alias("ends"))
    ends = ends.select(F.posexplode("ends").alias("at", "e"), F.col("ends")[F.size("ends") - 1]["end"].alias("last"), "ends")
    ends = ends.select(F.col("e.part").alias("part"), F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1)["end"]).otherwise(F.col("last")).alias("earlier"))
    joined = inside.join(ends, "part").withColumn("before", F.coalesce("before", "earlier"))
    return joined.select(*KEY, "n", "before")


def with_next(docs: DataFrame, repeated: bool = False) -> DataFrame:
    """``doc_id, text, fingerprint``, the first third (of one's own length) of the next text by descending id, and that text's fingerprint."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    ident = docs["doc_id"].cast("long")
    parts = ranges_for(docs)
    # Two joins below read the same columns by the same key, so that the texts are dealt out once.
    view = docs.select(ident.isNotNull().alias("given"), F.coalesce(ident, F.lit(0)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    keys = cut(view.select(*KEY, F.length("text").alias("n")).groupBy(*KEY).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")), "keys")
    once = view.dropDuplicates(KEY) if keys.where("rows > 1").head(1) else view
    view = view if repeated else once
    order = _next_keys(keys.drop("rows"), parts)
    # To the next document: who asks, and for how many code points.
    asked = order.select(*[F.col(f"before.{k}").alias(k) for k in KEY], F.struct(*KEY).alias("asker"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    given = once.join(asked, KEY).select(*[F.col(f"asker.{k}").alias(k) for k in KEY], F.substring(F.col("text"), F.lit(1), F.col("need")).alias("next_head"), fingerprint(F.col("text")).alias("next_fingerprint"))
    return view.join(given, KEY).select(F.when(F.col("given"), F.col("id")).alias("doc_id"), "text", fingerprint(F.col("text")).alias("fingerprint"), "next_head", "next_fingerprint")


def edited_digests(docs: DataFrame, repeated: bool = False) -> DataFrame:
    """Per document: its fingerprint, that of its text with the last third replaced by the head of the next, and likenesses."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    made = with_next(docs, repeated).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.col("next_head"))).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    # Each fingerprint is used more than once below; an array of one row keeps them from being computed again.
    once = made.select(F.explode(F.array(F.struct("*"))).alias("m")).select("m.*")
    return once.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lag(text) OVER (ORDER BY doc_id), last_value(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text FROM d),
e AS (SELECT doc_id, text, next_text, substring(text, 1, length(text) - length(text) // 3) || substring(next_text, 1, length(text) // 3) AS edited FROM o),
t AS (SELECT doc_id, 1 AS which, text FROM e UNION ALL SELECT doc_id, 2, edited FROM e UNION ALL SELECT doc_id, 3, next_text FROM e),
p AS (SELECT doc_id, which, list_transform(regexp_extract_all(text, '{PARAGRAPH}'), lambda x: md5(x)) AS ps FROM t),
s AS (SELECT doc_id, which, ps, list_transform(list_filter(string_split(coalesce(array_to_string(list_transform(ps, lambda d: d || CASE WHEN d < '{SECTION_END}' THEN ';' ELSE ',' END), ''), ''), ';'), lambda x: x <> ''), lambda x: md5(x)) AS ss FROM p),
f AS (SELECT doc_id, which, sha256(coalesce(array_to_string(ss, ''), '')) AS root, coalesce(array_to_string(list_transform(ss, lambda x: substring(x, 1, {SHORT})), '.'), '') AS sections,
    list_transform(ps, lambda x: substring(x, 1, {SHORT})) AS leaves FROM s),
g AS (SELECT doc_id, which, root, root || ':' || sections || ':' || coalesce(array_to_string(leaves, '.'), '') AS print, list_distinct(leaves) AS leaves FROM f)
SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
    CASE WHEN a.root = b.root THEN 1.0 ELSE coalesce(least(2.0 * len(list_intersect(a.leaves, b.leaves)) / nullif(len(a.leaves) + len(b.leaves), 0), 1.0 - 1.0 / nullif(len(a.leaves) + len(b.leaves), 0)), 0.0) END::DOUBLE AS near_edited,
    CASE WHEN a.root = c.root THEN 1.0 ELSE coalesce(least(2.0 * len(list_intersect(a.leaves, c.leaves)) / nullif(len(a.leaves) + len(c.leaves), 0), 1.0 - 1.0 / nullif(len(a.leaves) + len(c.leaves), 0)), 0.0) END::DOUBLE AS near_next
FROM e JOIN g a ON a.doc_id = e.doc_id AND a.which = 1 JOIN g b ON b.doc_id = e.doc_id AND b.which = 2 JOIN g c ON c.doc_id = e.doc_id AND c.which = 3
"""
