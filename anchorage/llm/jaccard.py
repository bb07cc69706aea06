"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes.  It is cut into
fragments twice:

*Finding candidates.*  Two sets of at most ``r`` n-grams whose similarity
reaches the threshold differ in at most ``D = 2 r (1 - t) / (1 + t)`` n-grams.
Cut the order into more than ``D`` fragments and at least one fragment holds
the same n-grams in both, so equal fragments find every link.  The number of
fragments follows from the size class of a set; a set is cut for its own class
and the next, as a partner may lie there.  A fragment that is empty in both
says nothing: there are some more fragments than needed, and only a set whose
empty fragments could be all that it shares with a partner publishes those too.
The same count tells how many fragments a set shares with any partner at least
(``least``).  So a set that shares fewer fragments with others is in no link,
and of those it shares it may leave out the ``least - 1`` that most sets have:
in one order of all fragments by how common they are, the rarest that two
linked sets share is among what both keep.

*Counting.*  The sets of the candidates are cut into a few fragments; the
overlap of each pair is counted fragment by fragment and summed per pair.

Equal sets are one class from the start, represented by its least document.
Fragments that the same sets share are one group, with a weight.
To know who is connected it is not necessary to emit the pairs inside a group:
each group first sends its members to its least one (as many rows as members).
Links found that way are contracted, and only groups that still hold more than
one component are joined with themselves, for pairs across components.  Such a
group is dealt out in blocks of about ``BLOCK`` members, each pair of blocks by
itself, and a pair is made in the first group it shares as far as the ``FIRST``
least groups of both tell.  A
512-bit parity map per document refutes most pairs inside the join, a finer one
most of the rest before sets are moved: two sets differ in at least as many
n-grams as their maps differ in bits.  No pair is lost: sizes, counts and maps
only drop pairs that cannot link.

Defined results: A-Z is lower-cased, a word is a run without ASCII white space;
fewer words than an n-gram has make one n-gram of all of them; a null, empty or
blank text has the empty set, links with nothing and is its own component; a
row with a null ``doc_id`` is linked with nothing and has a null component;
rows that repeat a ``doc_id`` count as documents of their own; other columns
are ignored; an empty table gives an empty table.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.common import cut, drop_scratch, releasing
from anchorage.llm.components import connected_components

#: Longs in a parity map, fragments in which overlaps are counted.
MAP_LONGS, COUNT_FRAGMENTS = 8, 4
#: Word hashes kept by a worker.
WORDS_KEPT = 200_000
#: Tables of ids are broadcast up to this number of rows, which are counted first; larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of a signature.  Two that are equal by chance make a pair that is refuted later.
SIGNATURE_BITS = 48
#: Members of a group that are joined with each other in one place, and groups of a set that its rows name.
BLOCK, FIRST = 500, 8
MAPS = [f"map{i}" for i in range(MAP_LONGS)]
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of a well-known generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Text to the sorted array of its distinct n-gram hashes."""

    def __init__(self, width: int):
        self.width = width
        self._hash = _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
        if not words:
            return np.empty(0, _U)
        hashes = np.fromiter(map(self._hash.__getitem__, words), _U, len(words))
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, width, _U)
        with np.errstate(over="ignore"):
            for k in range(width):
                out = _mixed(out * _U(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
        return np.unique(out)


class Plan:
    """Size classes and fragment numbers for a threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be over 0 and at most 1")
        self.num, self.den = num, den
        self._from = [1]

    def size_class(self, n: int) -> int:
        while self._from[-1] <= n:
            self._from.append(self._from[-1] * self.den // self.num + 1)
        return bisect_right(self._from, n) - 1

    def fragments(self, size_class: int) -> int:
        """Number of fragments of a class; 1 if only equal sets link."""
        while len(self._from) <= size_class + 1:
            self._from.append(self._from[-1] * self.den // self.num + 1)
        differ = self._differ(2 * (self._from[size_class + 1] - 1))
        return differ + 3 + differ // 16 if differ else 1

    def _differ(self, together: int) -> int:
        """In how many n-grams two linked sets differ at most that have so many together."""
        return together * (self.den - self.num) // (self.den + self.num)

    def signatures(self, items: np.ndarray) -> tuple[np.ndarray, int]:
        """Hashes of the fragments of a set, for its class and the next; and how many of them any partner shares at least."""
        made, least = [], None
        n = len(items)
        own = self.size_class(n)
        for k in (own, own + 1):
            count = self.fragments(k)
            # The largest partner that shares this class.
            partner = min(self._from[k + 1] - 1, n * self.den // self.num)
            if count == 1 or partner < self._from[k]:
                continue
            at = ((items >> _U(32)) * _U(count)) >> _U(32)
            starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
            equal = len(starts) - self._differ(n + partner)
            with np.errstate(over="ignore"):
                label = _mixed(at[starts] + _U(k << 32))
                made.append(_mixed(np.add.reduceat(_mixed(items + _U(1)), starts) ^ label))
                if equal < 1:
                    gaps = np.setdiff1d(np.arange(count, dtype=_U), at[starts], assume_unique=True)
                    made.append(_mixed(gaps + _U((k << 32) | (1 << 62))))
            least = max(1, equal if least is None else min(least, equal))
        return (np.concatenate(made), least) if made else (np.empty(0, _U), 1)


def parity_map(items: np.ndarray) -> np.ndarray:
    """Per bucket of hashes whether an odd number of items fall in it; four to eight buckets an item.

    Two halves of a map, XORed, are the map of half the length.
    """
    size = 64 * MAP_LONGS
    while size < 4 * len(items):
        size *= 2
    bits = np.bincount((items & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def folded(fine: np.ndarray) -> np.ndarray:
    """The map of the common length."""
    while len(fine) > MAP_LONGS:
        fine = fine[: len(fine) // 2] ^ fine[len(fine) // 2 :]
    return fine


def set_key(items: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _view(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _prints(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per document: size and key of its set, its signatures and its parity map."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, plan = Shingler(width), Plan(num, den)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, high, low, signatures, offsets, fine, places, least = [], [], [], [], [0], [], [0], []
                for cell in part.column(1):
                    items = shingles(cell.as_py())
                    sizes.append(len(items))
                    h, l = set_key(items)
                    high.append(h)
                    low.append(l)
                    found, needed = plan.signatures(items) if len(items) else (items, 1)
                    made = len(found)
                    found = np.unique(found & _U((1 << SIGNATURE_BITS) - 1))
                    signatures.append(found)
                    least.append(max(1, needed - (made - len(found))))  # two that are equal by chance count once
                    offsets.append(offsets[-1] + len(found))
                    fine.append(parity_map(items))
                    places.append(places[-1] + len(fine[-1]))
                flat = np.concatenate(signatures).view(np.int64)
                table = np.stack([folded(f) for f in fine])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(least, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(fine)))]
                    + [pa.array(table[:, i].copy()) for i in range(MAP_LONGS)],
                    names=["doc_id", "n", "key1", "key2", "least", "signatures", "fine", *MAPS],
                )

    schema = "doc_id long, n long, key1 long, key2 long, least long, signatures array<long>, fine array<long>, " + ", ".join(f"{m} long" for m in MAPS)
    return _view(docs).mapInArrow(lambda batches: releasing(run(batches)), schema)


def _fragments(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, key1, key2, fragment, items``: the sets, cut for counting."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, high, low, number, arrays, offsets = [], [], [], [], [], [0]
                for doc, cell in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    items = shingles(cell.as_py())
                    h, l = set_key(items)
                    cuts = np.searchsorted(items, np.arange(1, COUNT_FRAGMENTS, dtype=_U) * _U((1 << 64) // COUNT_FRAGMENTS))
                    for k, piece in enumerate(np.split(items, cuts)):
                        if len(piece):
                            ids.append(doc)
                            high.append(h)
                            low.append(l)
                            number.append(k)
                            arrays.append(piece)
                            offsets.append(offsets[-1] + len(piece))
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (ids, high, low)]
                        + [pa.array(number, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))],
                        names=["doc_id", "key1", "key2", "fragment", "items"],
                    )

    return _view(docs).mapInArrow(lambda batches: releasing(run(batches)), "doc_id long, key1 long, key2 long, fragment int, items array<long>")


def by_ids(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """A semi or anti join with a written table of ids, which is broadcast if its rows are counted to be few."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, how)


class _Join:
    """The state shared by the steps of one join."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs, width, num, den
        # Numbers are given once, in a written table, and so stay the same in every later step.
        full = cut(_prints(docs, width, num, den).withColumn("node", F.monotonically_increasing_id()), "signatures")
        self.prints = cut(full.drop("signatures"), "prints")
        linkable = self.prints.where("n > 0 and doc_id is not null")
        self.classes = cut(
            linkable.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "node")).alias("least")).select("key1", "key2", F.col("least.doc_id").alias("class_doc"), F.col("least.node").alias("class_node")), "classes"
        )
        copies = cut(linkable.select("key1", "key2", "node").join(self.classes, ["key1", "key2"]).where("node <> class_node").select("node"), "copies")
        representatives = by_ids(linkable, copies, "node", "left_anti")
        self.traits = representatives.select("node", "n", *MAPS)
        signed = full.where("n > 0 and doc_id is not null").select("node", "signatures")
        rows = by_ids(signed, copies, "node", "left_anti").select("node", F.explode("signatures").alias("signature"))
        # Nearly all signatures are of one set, and of those that are not nearly all of two, which the aggregate names
        # itself.  Only members of larger groups are looked up among the rows again.
        groups = cut(rows.groupBy("signature").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi"), "groups")
        two = groups.where("members = 2").groupBy("lo", "hi").agg(F.min("signature").alias("signature"), F.count(F.lit(1)).alias("weight"))
        two = two.select("signature", F.explode(F.array("lo", "hi")).alias("node"), F.lit(2).cast("long").alias("members"), "weight")
        larger = cut(by_ids(rows, cut(groups.where("members > 2").select("signature"), "larger"), "signature", "left_semi").select("signature", "node"), "larger-rows")
        marked = larger.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("mark1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("mark2"))
        alike = cut(marked.groupBy("members", "mark1", "mark2").agg(F.min("signature").alias("signature"), F.count(F.lit(1)).alias("weight")).select("signature", "members", "weight"), "alike")
        shared = cut(two.unionByName(larger.join(alike, "signature").select("signature", "node", "members", "weight")), "shared")
        for done in (full, groups, larger, alike):
            drop_scratch(done)
        # Of the signatures that a set shares, the least - 1 that most sets have may go; if these are all, so does the set.
        commonest = Window.partitionBy("node").orderBy(F.desc("members"), F.desc("signature")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rare = shared.join(representatives.select("node", "least"), "node").withColumn("before", F.sum("weight").over(commonest)).where("before >= least").select("signature", "node")
        rare = cut(rare, "rare")
        drop_scratch(shared)
        leaders = cut(rare.groupBy("signature").agg(F.min("node").alias("leader"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("members")).where("leader < hi").drop("hi"), "leaders")
        self.members = cut(rare.join(leaders, "signature").select("signature", "node", "leader", "members"), "members")
        drop_scratch(rare)

    def _may_link(self, x: str, y: str) -> Column:
        """Necessary for a link: sizes, and the number of bits in which the parity maps differ."""
        small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
        bits = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in MAPS[1:]), F.bit_count(F.col(f"{x}.{MAPS[0]}").bitwiseXOR(F.col(f"{y}.{MAPS[0]}"))))
        return (self.den * small >= self.num * large) & (bits * (self.den + self.num) <= (small + large) * (self.den - self.num))

    def star_pairs(self) -> DataFrame:
        """Members with the least of their group."""
        pairs = self.members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        x, y = self.traits.alias("x"), self.traits.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(self._may_link("x", "y")).select("a", "b")

    def cross_pairs(self, components: DataFrame) -> DataFrame:
        """Pairs of one group in different components."""
        labelled = self.members.join(components, "node", "left").select("signature", "node", "members", F.coalesce("component", "node").alias("component"))
        unfinished = cut(labelled.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("signature"), "unfinished")
        return self._pairs(labelled.join(unfinished, "signature"))

    def all_pairs(self) -> DataFrame:
        """Every candidate pair of representatives."""
        return self._pairs(self.members.select("signature", "node", "members", F.col("node").alias("component")))

    def _pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of rows of one group and different components that may link."""
        rows = cut(rows, "open")
        # A set has no more signatures than n-grams, so these arrays are bounded by its text.
        first = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("signature")), 1, FIRST).alias("first"))
        blocks = F.ceil(F.col("members") / BLOCK)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        dealt = (
            rows.join(first, "node")
            .join(self.traits, "node")
            .withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
            .select("signature", "node", "component", "first", "n", *MAPS, "block", other)
            .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
            .drop("other")
        )
        dealt = cut(dealt, "dealt")
        x, y = dealt.alias("x"), dealt.alias("y")
        on = (F.col("x.signature") == F.col("y.signature")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        on = on & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & ((F.col("x.i") == F.col("x.j")) | (F.col("x.block") != F.col("y.block")))
        # Not if the pair is made in a lesser group that both name.
        met = F.array_min(F.array_intersect("x.first", "y.first"))
        here = F.coalesce(met, F.col("x.signature")) >= F.col("x.signature")
        return x.join(y, on & self._may_link("x", "y") & here).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Of written pairs those whose fine parity maps leave a link open, written.  Of maps of two lengths the longer is folded."""
        ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        maps = cut(ids.join(self.prints.select("node", "n", "fine"), "node"), "maps")
        x, y = (maps.select(F.col("node").alias(f"{c}"), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}")) for c in "ab")

        def fold(m: Column, other: Column) -> Column:
            half = (F.size(m) / 2).cast("int")
            halves = F.zip_with(F.slice(m, F.lit(1), half), F.slice(m, half + 1, half), lambda p, q: p.bitwiseXOR(q))
            return F.when(F.size(m) == 2 * F.size(other), halves).otherwise(m)

        joined = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", fold(F.col("fine_a"), F.col("fine_b")).alias("p"), fold(F.col("fine_b"), F.col("fine_a")).alias("q"))
        bits = F.when(F.size("p") == F.size("q"), F.aggregate(F.zip_with("p", "q", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)).otherwise(0)
        near = cut(joined.where(bits * (self.den + self.num) <= (F.col("n_a") + F.col("n_b")) * (self.den - self.num)).select("a", "b"), "pairs")
        drop_scratch(maps)
        return near

    def links(self, pairs: DataFrame) -> DataFrame:
        """``a, b, overlap, union`` of the pairs that reach the threshold, counted on the sets; a written table."""
        candidates = cut(pairs, "candidates")
        pairs = self._near(candidates)
        wanted = cut(
            pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(self.prints.select("node", "doc_id", "key1", "key2", "n"), "node"),
            "wanted",
        )
        picked = by_ids(self.docs, cut(wanted.select("doc_id").distinct(), "ids"), "doc_id", "left_semi")
        parts = cut(_fragments(picked, self.width).join(wanted.drop("n"), ["doc_id", "key1", "key2"]).dropDuplicates(["doc_id", "key1", "key2", "fragment"]).select("node", "fragment", "items"), "fragments")
        sizes = wanted.select("node", "n")
        # Both joins read the fragments by the same keys, so that they are dealt out once.
        x, y = (parts.select(F.col("node").alias(c), "fragment", F.col("items").alias(f"items_{c}")) for c in "ab")
        asked = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(COUNT_FRAGMENTS - 1))).alias("fragment"))
        partial = asked.join(x, ["a", "fragment"]).join(y, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("shared"))
        counted = partial.groupBy("a", "b").agg(F.sum("shared").alias("overlap"))
        sized = counted.join(sizes.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
        found = cut(sized.withColumn("union", F.col("na") + F.col("nb") - F.col("overlap")).where(self.den * F.col("overlap") >= self.num * F.col("union")).select("a", "b", "overlap", "union"), "links")
        for done in (candidates, pairs, wanted, parts):
            drop_scratch(done)
        return found


def link_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; links need a similarity of ``num / den``."""
    join = _Join(docs, width, num, den)
    star = join.links(join.star_pairs()).select("a", "b")
    first = cut(connected_components(star), "components")
    more = join.links(join.cross_pairs(first)).select("a", "b")
    components = cut(connected_components(star.unionByName(more)), "components") if more.head(1) else first
    drop_scratch(join.members)
    by_class = join.classes.join(components.withColumnRenamed("node", "class_node"), "class_node", "left").withColumn("component", F.coalesce("component", "class_node"))
    named = by_class.groupBy("component").agg(F.min("class_doc").alias("component_id"))
    placed = cut(by_class.join(named, "component").select("key1", "key2", "component_id"), "placed")
    keyed = join.prints.select("doc_id", "n", "key1", "key2")
    return keyed.join(placed, ["key1", "key2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def similar_pairs(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and the membership of the classes of equal sets.

    Pairs: ``doc_a < doc_b``-free class documents with ``overlap, union``; members: ``doc_id, class_id``.
    """
    join = _Join(docs, width, num, den)
    names = join.classes.select(F.col("class_node").alias("node"), F.col("class_doc").alias("doc"))
    found = join.links(join.all_pairs())
    pairs = found.join(names.withColumnsRenamed({"node": "a", "doc": "doc_a"}), "a").join(names.withColumnsRenamed({"node": "b", "doc": "doc_b"}), "b").select("doc_a", "doc_b", "overlap", "union")
    members = join.prints.where("n > 0 and doc_id is not null").join(join.classes, ["key1", "key2"]).select("doc_id", F.col("class_doc").alias("class_id"))
    return pairs, members
