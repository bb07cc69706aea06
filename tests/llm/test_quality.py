import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from collections import Counter

from helpers import ODD, documents, empty_documents, odd_documents

from anchorage.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["a ", "b ", "a b ", "# ", "\n", "Zé ", "x|y ", "\t", "long word here\n", "\x1c", "  "]) for _ in range(r.randint(0, 120))) for _ in range(150)]
    for row in quality.judge(documents(spark, texts)).collect():
        n, chars, symbols, dup, repeat = want = brute(texts[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        assert row["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (row["kept"] and row["base_failed"])


def test_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [good, "few words", good + " #" * 40, good.upper(), "same three words " * 30, ("again and more\n" * 40) + good]
    entries = quality.ledger(documents(spark, texts)).cache()
    bits = {x["doc_id"]: x["fail_bits"] for x in entries.collect()}
    assert bits[0] == 0 and bits[1] & 1 and bits[2] & 4 and bits[3] & 32 and bits[4] & 2
    for version, policy in quality.POLICIES.items():
        kept = {x["doc_id"] for x in quality.apply_policy(entries, version).where("kept").collect()}
        assert kept == {d for d, b in bits.items() if not b & policy.mask}
        for x in quality.ablations(entries, version).collect():
            bit = 1 << list(quality.RULES).index(x["rule"])
            assert x["n_docs"] == len(texts)
            assert x["n_failed"] == sum(bool(b & bit) for b in bits.values())
            assert x["n_only_this"] == sum(b & policy.mask == bit for b in bits.values())
            assert x["n_rejected"] == sum(bool(b & policy.mask) for b in bits.values())


def test_scripts_without_spaces_are_kept(spark):
    r = random.Random(5)
    chinese = "。 ".join("".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(24)) for _ in range(60))
    german = " ".join("".join(r.choice("abcdefgh") for _ in range(24)) for _ in range(60))
    got = {x["doc_id"]: x for x in quality.judge(documents(spark, [chinese, german])).collect()}
    assert got[0]["kept"] and got[0]["fail_bits"] & 16 and not got[1]["kept"]
    assert not quality.POLICIES[3].mask & 16 and quality.POLICIES[3].mask == 111


def test_dotted_columns_are_kept(spark):
    docs = documents(spark, [" ".join(f"word{i}" for i in range(60)), None]).selectExpr("*", "1 as `a.b`", "2 as `c``d`")
    assert quality.kept_documents(docs).collect() == docs.where("doc_id = 0").collect()


def test_kept_rows_are_unchanged(spark):
    docs = odd_documents(spark).withColumnRenamed("kept", "fail_bits")
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 0
    good = documents(spark, [" ".join(f"word{i}" for i in range(60)), None])
    assert quality.kept_documents(good).collect() == good.where("doc_id = 0").collect()


def test_odd_rows(spark):
    rows = quality.judge(odd_documents(spark)).collect()
    assert len(rows) == len(ODD) + 3
    by_id = {x["doc_id"]: x for x in rows}
    for i, text in enumerate(ODD):
        if i != 5:
            assert by_id[i]["n_repeat_words"] == brute(text)[4] and by_id[i]["n_words"] == brute(text)[0]
    assert quality.judge(empty_documents(spark)).count() == 0 and quality.ablations(quality.ledger(empty_documents(spark))).count() == 0


def test_plan_is_native(spark):
    plan = quality.judge(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
