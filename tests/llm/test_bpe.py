import hashlib
import random
import sys
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents, empty_documents, odd_documents

from anchorage.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(ranks, library):
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    r = random.Random(5)
    parts = ["a", "b", "the ", " ", "\n", "é", "日本", "🙂", "'s", "'LL", "  ", "\x1c", "\x85", "　", "xy" * 20, "1234", "..", "ñ", "\t", "ing", "tion", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        ids = encoder.decimal(text)
        assert ids == " ".join(map(str, library.encode_ordinary(text)))
        assert decoder.text(ids) == text


def test_small_tables_agree_with_merging(ranks):
    r = random.Random(6)
    small = {bytes([b]): i for i, b in enumerate(b"abc")}
    for _ in range(60):
        merges = dict(small)
        while len(merges) < 14:
            new = r.choice(list(merges)) + r.choice(list(merges))
            if len(new) < 7:
                merges.setdefault(new, len(merges))
        machine = bpe.Transducer(merges)
        for _ in range(60):
            piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            assert machine.encode(piece) == ([merges[piece]] if piece in merges else bpe.merge_by_rank(piece, merges))


def test_table_reset_changes_nothing(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "STATES_KEPT", 5)
    machine = bpe.Transducer(ranks)
    for word in (b"unquestionably", b"zzzzqqqq", "naïveté".encode()):
        assert machine.encode(word) == ([ranks[word]] if word in ranks else bpe.merge_by_rank(word, ranks))


def test_tokens_are_emitted_after_bounded_lookahead(ranks):
    longest = max(map(len, ranks))
    whole = tiktoken.Encoding("whole", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(7)
    runs = ["a" * 20_000, "ab" * 10_000, "-" * 20_000, "=" * 20_000, "abcdefghij" * 2_000, " " * 20_000, "é" * 9_000, "日本" * 4_000, "\n" * 20_000, "".join(r.choice("ab") for _ in range(20_000)), "".join(r.choice("=-") for _ in range(20_000)), "ACGT" * 5_000]
    for run in runs:
        machine = bpe.Transducer(ranks)
        piece = run.encode()
        ids = machine.encode(piece)
        assert b"".join(map(machine.bytes_of.__getitem__, ids)) == piece
        assert machine.most_held < 3 * longest + bpe.SETTLE
        assert ids == whole.encode_ordinary(run)


def test_utf8_stream_at_any_cut():
    data = "aé日🙂".encode() + b"\xff\xe2\x82" + b"z\xf0\x9f"
    for step in (1, 2, 3, 5):
        stream = bpe.Utf8Stream()
        text = "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.close()
        assert text == data.decode("utf-8", "replace")


def test_odd_rows(spark, library):
    rows = bpe.encode_digests(odd_documents(spark)).collect()
    assert len(rows) == len(ODD) + 3
    by_id = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(ODD):
        if i == 5:
            continue
        ids = library.encode_ordinary(text or "")
        assert by_id[i]["n_tokens"] == len(ids)
        assert by_id[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by_id[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert None in by_id
    assert bpe.encode_digests(empty_documents(spark)).count() == 0


def test_texts_come_back(spark):
    rows = bpe.encode(documents(spark, ["hello there", None])).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == ["hello there", ""]
