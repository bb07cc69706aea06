import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents, empty_documents, odd_documents
from tokenizers import Tokenizer, models

from anchorage.llm import queries, tokenfiles, viterbi

PARTS = ["a", "B", "The ", " ", "\n", "é", "É", "日本", "🙂", "'s", "'S", "  ", "\x1c", "\x85", "　", "é", "İ", "Σ", "ΣΑΣ", "xy" * 20, "1234", "..", "ñ", "\t", "ing", "<|endoftext|>", "ß", "̸", "ﬁ", "×", "Éa.!", "b'", "q@"]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.encode_special_tokens = True
    return found


def test_words_encode_as_whole_texts_do(library):
    words = tokenfiles.WordIds("word_bpe_49k.json", "<u2")
    r = random.Random(8)
    for _ in range(1500):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(words.ids(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def brute_files(rows, library):
    out, start = [], 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark, library):
    r = random.Random(9)
    texts = [None, "", *("".join(r.choice(PARTS) for _ in range(r.randint(0, 400))) for _ in range(60)), "word " * 9000]
    got = tokenfiles.write_and_read(documents(spark, texts).repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute_files(enumerate(texts), library)


def test_query_gives_what_the_plain_library_gives(spark, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = tokenfiles.WordIds("word_bpe_49k.json", "<u2", added=True)
    r = random.Random(12)
    parts = [*PARTS, "<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext"]
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", *("".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(800))]
    for text in texts:
        assert np.frombuffer(words.ids(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    documents(spark, texts[:100]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op5_token_files"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == brute_files(enumerate(texts[:100]), plain)


def test_odd_rows(spark, library):
    got = tokenfiles.write_and_read(odd_documents(spark)).collect()
    assert len(got) == len(ODD) + 3
    first = next(x for x in got if x["doc_id"] is None)
    assert first["start"] == 0 and first["n_tokens"] == len(library.encode("no id").ids) + 1
    spans = sorted((x["start"], x["n_tokens"]) for x in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert tokenfiles.write_and_read(empty_documents(spark)).count() == 0


def test_sequences_and_masks_are_random_access():
    sink = pa.BufferOutputStream()
    writer = tokenfiles.SequenceWriter(sink, np.dtype("<u2"), 8, 3)
    data = np.arange(1, 75, dtype="<u2")
    for at in range(0, 74, 5):
        writer.add(data[at : at + 5])
    writer.close()
    file = tokenfiles.SequenceFile(pa.py_buffer(sink.getvalue()), 8, 3)
    for n in range(9):
        assert file.sequence(n).tolist() == data[8 * n : 8 * n + 8].tolist() and file.mask(n).all()
    assert file.sequence(9).tolist() == [73, 74, 0, 0, 0, 0, 0, 0] and file.mask(9).tolist() == [True] * 2 + [False] * 6
    assert file.span(20, 40).tolist() == data[20:60].tolist() and file.span(3, 2).tolist() == [4, 5]


def test_mapped_files_are_read_without_a_copy(spark, tmp_path, monkeypatch):
    texts = ["word " * 700, None, *(f"text {i}" for i in range(40))]
    (path, total), *rest = tokenfiles.write(documents(spark, texts), tmp_path.as_uri(), parts=1)
    assert not rest
    with tokenfiles.opened(f"{path}.arrow") as source:
        whole = source.read_buffer()
        start, end = whole.address, whole.address + whole.size
        file = tokenfiles.SequenceFile(source)
        for view in (file.sequence(0), file.mask(0)):
            assert len(view) == tokenfiles.LENGTH and start <= view.__array_interface__["data"][0] < end
        assert sum(int(file.mask(k).sum()) for k in range(-(-total // tokenfiles.LENGTH))) == total
    assert tokenfiles.read(spark, [(path, total)]).count() == len(texts)
    monkeypatch.setattr(tokenfiles, "INDEX_ROWS", 7)
    sink = pa.BufferOutputStream()
    index = tokenfiles.IndexWriter(sink)
    for k in range(20):
        index.add(None if k == 0 else k, 10 * k, 10)
    index.close()
    saved = pa.ipc.open_file(sink.getvalue())
    assert saved.num_record_batches == 3 and saved.read_all()["start"].to_pylist() == list(range(0, 200, 10)) and saved.read_all()["doc_id"][0].as_py() is None


def test_counts_follow_the_unigram_library():
    pieces = viterbi.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    least = min(s for _, s in pieces)
    oracle = Tokenizer(models.Unigram([("<unk>", least), *((f"<0x{i:02X}>", least) for i in range(256)), *pieces], 0, True))
    counter = viterbi.Counter(pieces)
    r = random.Random(10)
    for _ in range(1200):
        text = "".join(r.choice([*PARTS, "▁", "   "]) for _ in range(r.randint(1, 25)))
        assert counter.count(text)[0] == len(oracle.encode(viterbi.MARK + text.replace(" ", viterbi.MARK), add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(20))
def test_counts_by_all_paths(seed):
    """Small vocabularies with many ties and no cut: the library's rule by full enumeration of ends."""
    r = random.Random(seed)
    pieces = {c: -float(r.randint(1, 3)) for c in "ab"}
    while len(pieces) < 9:
        pieces["".join(r.choice("abc▁") for _ in range(r.randint(2, 4)))] = -float(r.randint(1, 4)) / r.choice([1, 2])
    least = min(pieces.values())
    oracle = Tokenizer(models.Unigram([("<unk>", least), *((f"<0x{i:02X}>", least) for i in range(256)), *pieces.items()], 0, True))
    counter = viterbi.Counter(list(pieces.items()))
    for _ in range(60):
        text = "".join(r.choice("aabbc ") for _ in range(r.randint(1, 12)))
        assert counter.count(text)[0] == len(oracle.encode(viterbi.MARK + text.replace(" ", viterbi.MARK), add_special_tokens=False).ids)


def test_count_odd_rows(spark):
    rows = viterbi.count_tokens(odd_documents(spark)).collect()
    assert len(rows) == len(ODD) + 3
    by_id = {x["doc_id"]: x for x in rows}
    assert by_id[0]["n_tokens"] == by_id[1]["n_tokens"] == 0 and by_id[7]["n_tokens"] > 0
    assert viterbi.count_tokens(empty_documents(spark)).count() == 0
