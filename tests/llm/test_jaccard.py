import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, empty_documents, odd_documents

from anchorage.llm import jaccard
from anchorage.llm.components import connected_components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(texts, width, num, den):
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = set()
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                links.add((j, i))
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))], links, sets


def family(r, words=None, size=40):
    """A text and copies with ever more edits."""
    base = words or [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(1, size))]
    made = []
    for _ in range(r.randint(1, 7)):
        own = list(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            at = r.randrange(len(own))
            own[at : at + r.choice([0, 1, 1])] = [f"e{r.randint(0, 10**6)}"]
        made.append(r.choice([" ", "\n", "  "]).join(own).upper() if r.random() < 0.1 else " ".join(own))
    return made


@pytest.mark.parametrize(("width", "num", "den", "size"), [(3, 90, 100, 160), (5, 80, 100, 120), (2, 1, 2, 30)])
def test_components_are_those_of_brute_force(spark, width, num, den, size):
    r = random.Random(size)
    common = [f"c{i}" for i in range(60)]
    texts = [t for _ in range(35) for t in family(r, size=size)] + [t for _ in range(4) for t in family(r, common)] + [" ".join(common + [f"z{i}"]) for i in range(12)]
    r.shuffle(texts)
    sizes, components, _, _ = brute(texts, width, num, den)
    got = {x["doc_id"]: x for x in jaccard.link_components(documents(spark, texts), width, num, den).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == components


def test_all_pairs(spark):
    r = random.Random(3)
    texts = [t for _ in range(25) for t in family(r, size=90)]
    _, _, links, sets = brute(texts, 3, 80, 100)
    pairs, members = jaccard.similar_pairs(documents(spark, texts), 3, 80, 100)
    cls = {x["doc_id"]: x["class_id"] for x in members.collect()}
    assert all((sets[a] == sets[b]) == (cls[a] == cls[b]) for a in cls for b in cls)
    want = {tuple(sorted((cls[a], cls[b]))) for a, b in links if cls[a] != cls[b]}
    assert {tuple(sorted((x["doc_a"], x["doc_b"]))) for x in pairs.collect()} == want


def test_equal_fragments_find_every_link():
    r = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100), (1, 2)):
        plan = jaccard.Plan(num, den)
        for _ in range(400):
            n = int(r.integers(1, 260))
            x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = int(r.integers(0, max(1, n // 5) + 1))
            y = np.unique(np.concatenate([x[drop:], r.integers(0, 2**63, int(r.integers(0, max(1, n // 8) + 1))).astype(np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if len(y) and den * shared >= num * (len(x) + len(y) - shared) and not np.array_equal(x, y):
                (a, need_x), (b, need_y) = plan.signatures(x), plan.signatures(y)
                assert len(np.intersect1d(a, b)) >= max(need_x, need_y)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 301), (301, 300)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = jaccard.link_components(odd_documents(spark)).collect()
    assert len(rows) == 15
    by_id = {}
    for x in rows:
        by_id.setdefault(x["doc_id"], []).append((x["n_shingles"], x["component_id"]))
    assert by_id[0] == by_id[1][:0] + [(0, 0)] and by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)]
    assert by_id[4] == [(1, 4)] and sorted(by_id[5]) == [(1, 4), (1, 4), (1, 5)]
    assert by_id[None] == [(1, None)]
    assert jaccard.link_components(empty_documents(spark)).count() == 0


def test_many_near_but_unequal_sets(spark, monkeypatch):
    """One group of 500 sets, near but not equal, that links only in part; dealt out in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 60)
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(500):
        own = list(base)
        for at in r.sample(range(len(own)), r.choice([1, 2, 4, 6, 9])):
            own[at] = f"e{k}-{at}"
        texts.append(" ".join(own))
    sizes, components, links, _ = brute(texts, 5, 80, 100)
    got = {x["doc_id"]: x for x in jaccard.link_components(documents(spark, texts), 5, 80, 100).collect()}
    assert [got[i]["n_shingles"] for i in range(500)] == sizes
    assert [got[i]["component_id"] for i in range(500)] == components
    pairs, _ = jaccard.similar_pairs(documents(spark, texts[:200]), 5, 80, 100)
    assert {tuple(sorted((x["doc_a"], x["doc_b"]))) for x in pairs.collect()} == {(a, b) for a, b in links if b < 200}


def test_a_passage_that_many_share(spark):
    """Sets that share half of their n-grams with all others are found apart, and near ones among them linked."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"o{k}-{i}" for i in range(r.randint(50, 90))) for k in range(120)]
    texts += [t + " more" for t in texts[:20]] + [t.replace("p30", "q30") for t in texts[20:40]]
    _, components, _, _ = brute(texts, 5, 80, 100)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.link_components(documents(spark, texts), 5, 80, 100).collect()}
    assert [got[i] for i in range(len(texts))] == components
