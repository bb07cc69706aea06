"""Token ids in Arrow files with fixed-size-list batches.

A file is an Arrow IPC file.  Its columns are ``ids``, a fixed-size list of
``LENGTH`` ids, and ``mask``, a fixed-size list of as many bytes that are 0 on
padding and 1 elsewhere.  All batches but the last hold ``ROWS`` sequences, so
the n-th sequence and its mask are found by arithmetic and, in a file that the
system can map, are views of it (:func:`opened`).  Ids fit 16 bits where the
vocabulary does.  Beside each file lies an index, an Arrow file with ``doc_id,
start, n_tokens`` per document, where ``start`` counts the ids before it in
that file.

Documents are encoded where they lie, dealt out by ranges of ``doc_id`` as
compressed ids, sorted within a range and streamed to one file per range, the
index along with it, so no task holds more than one batch of each and one
document.  The number of ranges follows from the bytes of the input.  A file
appears under its name only when complete: a lost task leaves nothing behind
and is run again.
The totals of the files (one number each) give the offset of each range.

Words are encoded by the tokenizers library, each distinct word once while a
worker remembers it: the tokenizer's own rules never join text across white
space.  With ``added``, the vocabulary's added tokens are found in texts and
get their ids, as the library does unless told otherwise; without it they are
text like any other (the library's ``encode_special_tokens``).

Defined results: a null or empty text has the end id alone; a null ``doc_id``
comes first; rows that repeat a ``doc_id`` follow each other by their text;
texts of any length are written whole; other columns are ignored; an empty
table gives no file and no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.llm.common import ranges_for, releasing, vocabulary_path
from anchorage.staging import scratch_path

LENGTH, ROWS = 1024, 256
#: Documents in a batch of an index.
INDEX_ROWS = 10_000
END_ID = 1
#: Words, and parts of words, that a worker remembers from one task to the next.
WORDS_KEPT = 1_500_000
LONGEST_KEPT_WORD = 64


#: Latin letters that are single, composed and lower-cased one by one, and ASCII punctuation but the apostrophe.
_COMMON = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letters by which a byte-level model names bytes that don't print: the byte's place among these, from U+0100."""
    odd = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return {b: chr(256 + i) for i, b in enumerate(odd)}


_BYTE_LETTERS = _byte_letters()


class WordIds(dict):
    """A word in UTF-8 and the bytes of its ids, little-endian, of numpy type ``kind``.

    A word goes through the library's normaliser, pre-tokenizer and model one
    after the other, so that parts that words share are encoded once.  For
    words of common letters and a tail of punctuation the first two are known:
    lower case and two parts.
    """

    def __init__(self, file: str, kind: str, added: bool = False):
        super().__init__()
        self._library = _library(file)
        self._model, self._normal, self._split = self._library.model, self._library.normalizer, self._library.pre_tokenizer
        self._code = "H" if kind == "<u2" else "I"
        self._parts: dict[str, bytes] = {}
        tokens = self._library.get_added_tokens_decoder() if added else {}
        #: Added tokens that stand in a text as they are; with any other kind the library itself encodes every text.
        self._added = {t.content: struct.pack(f"<{self._code}", i) for i, t in tokens.items()}
        self._plain = not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in tokens.values())
        self._cuts = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")").split
        if added:
            self._library.encode_special_tokens = False

    def _part(self, part: str) -> bytes:
        data = self._parts.get(part)
        if data is None:
            ids = [t.id for t in self._model.tokenize(part)]
            data = struct.pack(f"<{len(ids)}{self._code}", *ids)
            if len(part) <= LONGEST_KEPT_WORD:
                if len(self._parts) >= WORDS_KEPT:
                    self._parts.clear()
                self._parts[part] = data
        return data

    def __missing__(self, data: bytes) -> bytes:
        word, key = data.decode("utf-8", "surrogatepass"), data
        common = _COMMON(word)
        if common:
            letters, tail = common.groups()
            letters = letters.lower()
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
            data = self._part(letters) + self._part(tail) if tail else self._part(letters)
        else:
            data = b"".join(self._part(part) for part, _ in self._split.pre_tokenize_str(self._normal.normalize_str(word)))
        if len(word) <= LONGEST_KEPT_WORD:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[key] = data
        return data

    def _of(self, text: str) -> bytes:
        # Splitting bytes splits at ASCII white space alone.
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def ids(self, text: str) -> bytes:
        if not self._plain:
            ids = self._library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}{self._code}", *ids)
        for token in self._added:
            if token in text:
                return b"".join(self._added[part] if k % 2 else self._of(part) for k, part in enumerate(self._cuts(text)))
        return self._of(text)


@functools.lru_cache(maxsize=1)
def _words(file: str, kind: str, added: bool) -> WordIds:
    """One per worker: rare words make up much of a text's work, and tasks share most of them."""
    return WordIds(file, kind, added)


def _library(file: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(file))
    library.encode_special_tokens = True
    return library


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class SequenceWriter:
    """Streams documents into equal-length sequences; memory holds one batch."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int):
        self.kind, self.length, self.rows = kind, length, rows
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self._ids = pa.list_(value, length)
        self._mask = pa.list_(pa.uint8(), length)
        self._file = pa.ipc.new_file(sink, pa.schema([("ids", self._ids), ("mask", self._mask)]))
        self._open: list[np.ndarray] = []
        self._held = 0
        self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self._open.append(ids)
        self._held += len(ids)
        self.total += len(ids)
        full = self.length * self.rows
        if self._held >= full:
            flat = np.concatenate(self._open)
            whole = len(flat) // full * full
            for at in range(0, whole, full):
                self._batch(flat[at : at + full], full)
            self._open, self._held = [flat[whole:]], len(flat) - whole

    def _batch(self, flat: np.ndarray, used: int) -> None:
        mask = (np.arange(len(flat)) < used).view(np.uint8)
        self._file.write_batch(
            pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), type=self._ids), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self._mask)], names=["ids", "mask"])
        )

    def close(self) -> None:
        if self._held:
            flat = np.concatenate(self._open)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self._file.close()


class IndexWriter:
    """Streams the index of a file, ``INDEX_ROWS`` documents at a time."""

    NAMES = ("doc_id", "start", "n_tokens")

    def __init__(self, sink):
        self._file = pa.ipc.new_file(sink, pa.schema([(name, pa.int64()) for name in self.NAMES]))
        self._rows: list[tuple[int | None, int, int]] = []

    def add(self, doc: int | None, start: int, count: int) -> None:
        self._rows.append((doc, start, count))
        if len(self._rows) >= INDEX_ROWS:
            self._write()

    def _write(self) -> None:
        self._file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self._rows, strict=True)], names=[*self.NAMES]))
        self._rows.clear()

    def close(self) -> None:
        if self._rows:
            self._write()
        self._file.close()


def opened(uri: str):
    """A file to read from: mapped where it is local, so that what is read are views of it, or else opened."""
    system, path = _filesystem(uri)
    return pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)


class SequenceFile:
    """Random access to the sequences of a file; of a mapped one, without a copy."""

    def __init__(self, source, length: int = LENGTH, rows: int = ROWS):
        self._file = pa.ipc.open_file(source)
        self.length, self.rows = length, rows
        self._at, self._flat, self._mask = -1, None, None

    def _batch(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if number != self._at:
            batch = self._file.get_batch(number)
            self._flat, self._mask = (c.flatten().to_numpy(zero_copy_only=True) for c in batch.columns)
            self._at = number
        return self._flat, self._mask

    def sequence(self, number: int) -> np.ndarray:
        flat, at = self._batch(number // self.rows)[0], number % self.rows * self.length
        return flat[at : at + self.length]

    def mask(self, number: int) -> np.ndarray:
        flat, at = self._batch(number // self.rows)[1], number % self.rows * self.length
        return flat[at : at + self.length]

    def span(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the file, without the mask."""
        full, parts = self.length * self.rows, []
        while count > 0:
            flat, at = self._batch(start // full)[0], start % full
            part = flat[at : at + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write(docs: DataFrame, folder: str, file: str = "word_bpe_49k.json", end_id: int = END_ID, parts: int | None = None, added: bool = False) -> list[tuple[str, int]]:
    """Write the files; their URIs in document order, with the ids that each holds."""
    kind = "<u2" if _library(file).get_vocab_size() <= 1 << 16 else "<u4"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        words, press = _words(file, kind, added), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            packed, marks = [], []
            ids = batch.column(0)
            parts_of = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            parts_of[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            for cell in batch.column(1):
                text = cell.as_py() or ""
                packed.append(press.compress(words.ids(text) + end))
                marks.append(zlib.crc32(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(parts_of), ids, pa.array(marks, pa.int64()), pa.array(packed, pa.binary())], names=["part", "doc_id", "mark", "ids"])

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard
        from pyspark import TaskContext

        unpack = zstandard.ZstdDecompressor()
        number = TaskContext.get().partitionId()
        system, path = _filesystem(f"{folder}/part-{number:05d}")
        own = f"{path}.{uuid.uuid4().hex}"
        writer = index = sink = beside = None
        for batch in batches:
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    sink, beside = system.open_output_stream(f"{own}.open"), system.open_output_stream(f"{own}.index.open")
                    writer, index = SequenceWriter(sink, np.dtype(kind), LENGTH, ROWS), IndexWriter(beside)
                ids = np.frombuffer(unpack.decompress(cell.as_py()), kind)
                index.add(doc, writer.total, len(ids))
                writer.add(ids)
        if writer is None:
            return
        for done in (writer, index, sink, beside):
            done.close()
        system.move(f"{own}.index.open", f"{path}.index.arrow")
        system.move(f"{own}.open", f"{path}.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([writer.total], pa.int64())], names=["number", "total"])

    view = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    parts = parts or ranges_for(docs)
    # Borders of the ranges from the ids alone, one number a range; dealing out by range itself would encode twice, once to find the borders.
    found = view.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("b")).first()["b"]
    bounds = np.unique(np.array(found or [], np.int64)) if parts > 1 else np.empty(0, np.int64)
    encoded = view.mapInArrow(lambda batches: releasing(encode(batches)), "part int, doc_id long, mark long, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mark").select("doc_id", "ids")
    saved = dealt.mapInArrow(lambda batches: releasing(save(batches)), "number long, total long").collect()  # one row per file
    return [(f"{folder}/part-{r['number']:05d}", r["total"]) for r in sorted(saved)]


def read(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    rows, before = [], 0
    for number, (path, total) in enumerate(files):
        rows.append((path, before, number))
        before += total

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(f"{path}.index.arrow") as places, opened(f"{path}.arrow") as source:
                    index, data = pa.ipc.open_file(places), SequenceFile(source)
                    for number in range(index.num_record_batches):
                        part = index.get_batch(number)
                        starts, counts = part.column(1).to_pylist(), part.column(2).to_pylist()
                        sums = [zlib.crc32(data.span(s, n).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([before + s for s in starts], pa.int64()), part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, before long, number long").repartition(max(1, len(rows)), "number") if rows else spark.createDataFrame([], "path string, before long, number long")
    return listed.select("path", "before").mapInArrow(lambda batches: releasing(load(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, file: str = "word_bpe_49k.json", end_id: int = END_ID, added: bool = False) -> DataFrame:
    """Write ``docs`` to a folder beside the cluster's checkpoints and read the files back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch_path(spark, "token-files"), file, end_id, added=added))
