"""Token ids in Arrow's file format, in equal-length sequences.

Documents are dealt by ranges of doc_id and each task writes one file: record batches with a fixed-size list of
ids (two bytes each where the vocabulary allows it) and one of mask bits (1: an id, 0: filling behind the last), eight
to a byte, lowest first. Fixed-size lists lie back to back in memory,
so a reader maps a file and takes any sequence, or any document, as a slice without copying or parsing. The index, a
Parquet table, says where each document is. A file counts only once its rows are in the index, so tasks that are run
again leave nothing wrong behind.
"""

from __future__ import annotations

import string
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momenta.llm.common import saved, scratch

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 64
#: Ids that a task reads back.
READ = 64 << 20
END_ID = 2
#: Words and other pieces whose ids a task remembers, and texts whose ids are put together at once.
MEMORY = 1_000_000
TOGETHER = 64

#: What may stand behind a word without touching its tokens: ASCII marks but the apostrophe, which begins endings.
_STOPS = string.punctuation.replace("'", "")
#: Byte-level vocabularies name a byte by a character: printable ones by themselves, the others by 256, 257, ... in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_INDEX = "file string, part long, doc_id long, place long, n_tokens long"


class Encoder:
    """ids of whole texts as the tokenizer gives them, through its own ids of the pieces between spaces.

    The tokenizer drops white space and lets no token cross it, and its special strings hold none, so a text's ids are
    those of its pieces, one after the other; pieces seen before are looked up. New pieces go to the tokenizer as one
    text, but for words of Latin letters, which its model takes as they are, and stops behind such.
    Only for tokenizers of which that holds.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Two bytes an id where the vocabulary allows it.
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

        self.model, self.words = self.tokenizer.model, {}
        #: Whether words of letters may go to the model itself and stops behind them apart: tried on a sample of both.
        sample = ["Hello", "straße", "Éléphant", "zzyzxqv", "niño", "thndhely", "ÀÉÎ", "a"]
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.direct = all(ids(w + t) == self._word(w.lower()).tolist() + ids(t) for w in sample for t in (*_STOPS, "?!", "...", "***"))

    def _word(self, word: str) -> array:
        """ids of a word of lower-case Latin letters, from the model behind the tokenizer's normalizer and splitter."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_NAMES)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(mapped)])

    def _look_up(self, pieces: Iterable[str]) -> list[bytes]:
        """ids of every piece. Words are remembered by their lower-case letters alone, other pieces as they are."""
        out: list[bytes | None] = []
        words, known, others = self.words, self.known, []
        for piece in pieces:
            word = piece.rstrip(_STOPS) if self.direct else ""
            if word.isalpha() and (word.isascii() or max(word) < "Ā"):
                low = word.lower()
                ids = words.get(low)
                if ids is None:
                    ids = words[low] = self._word(low).tobytes()
                out.append(ids if len(word) == len(piece) else ids + self._tail(piece[len(word) :]))
            else:
                out.append(known.get(piece))
                if out[-1] is None:
                    others.append((len(out) - 1, piece))
        if others:
            self._learn_together([*{p for _, p in others}])
            for k, piece in others:
                out[k] = known[piece]
        return out

    def _tail(self, stops: str) -> bytes:
        if stops not in self.tails:
            self.tails[stops] = np.array(self.tokenizer.encode(stops, add_special_tokens=False).ids, self.dtype).tobytes()
        return self.tails[stops]

    def _learn_together(self, pieces: list[str]) -> None:
        """Several pieces as one text; the ids' places tell which are whose."""
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        ids = np.array(found.ids, self.dtype).tobytes()
        starts = np.fromiter((s for s, _ in found.offsets), np.int64, len(found.ids))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        at = 0
        for piece, end in zip(pieces, (np.searchsorted(starts, ends) * self.dtype.itemsize).tolist(), strict=True):
            self.known[piece] = ids[at:end]
            at = end

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text its ids, as dtype; the distinct pieces of the texts are looked up, and their ids taken by place."""
        if not len(texts):
            return
        pieces = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        del pieces, coded
        for memory in (self.words, self.known, self.tails):
            if len(memory) > MEMORY:
                memory.clear()
        found = self._look_up(distinct)
        ids = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        for k in range(0, len(texts), TOGETHER):
            ends = bounds[k : k + TOGETHER + 1] - bounds[k]
            block = at[bounds[k] : bounds[min(k + TOGETHER, len(texts))]]
            n = size[block]
            upto = np.r_[0, np.cumsum(n)]
            out = ids[np.repeat(first[block] - upto[:-1], n) + np.arange(upto[-1])]
            for s, e in zip(upto[ends[:-1]].tolist(), upto[ends[1:]].tolist(), strict=True):
                yield out[s:e].tobytes()


class SequenceWriter:
    """One file of equal-length sequences; ids are written on as full batches come together."""

    def __init__(self, folder: str, name: str, sequence: int, dtype: np.dtype):
        if sequence % 8:
            raise ValueError("mask bits are packed: sequences have a multiple of 8 ids")
        self.sequence, self.dtype = sequence, dtype
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.stream = self.fs.open_output_stream(f"{root}/{name}")
        kind = lambda t, n: pa.list_(pa.field("item", t, nullable=False), n)
        self.schema = pa.schema([pa.field("ids", kind(pa.from_numpy_dtype(dtype), sequence), nullable=False), pa.field("mask", kind(pa.uint8(), sequence // 8), nullable=False)])
        self.file = pa.ipc.new_file(self.stream, self.schema)
        self.waiting: list[bytes] = []
        self.size = self.total = 0

    def add(self, ids: bytes) -> int:
        """Appends the ids and returns the place of the first."""
        at, n = self.total, len(ids) // self.dtype.itemsize
        self.waiting.append(ids)
        self.size += n
        self.total += n
        if self.size >= self.sequence * BATCH:
            self._write(self.size // (self.sequence * BATCH) * BATCH)
        return at

    def _write(self, sequences: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        whole, n = sequences * self.sequence, len(ids)
        mask = np.packbits(np.arange(whole) < n, bitorder="little")
        rest = ids[whole:].tobytes()
        ids = np.pad(ids[:whole], (0, max(0, whole - n)))
        for k in range(0, sequences, BATCH):
            first, last = k * self.sequence, min(k + BATCH, sequences) * self.sequence
            parts = ids[first:last], mask[first // 8 : last // 8]
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip(parts, self.schema, strict=True)]
            self.file.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.waiting, self.size = [rest], len(rest) // self.dtype.itemsize

    def close(self) -> None:
        if self.size:
            self._write(-(-self.size // self.sequence))
        self.file.close()
        self.stream.close()


class SequenceReader:
    """Random access to one file: mapped into memory where it is local, else read by batches."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.at, self.now = 0, self.file.get_batch(0)
        # all batches but the last are of one length
        self.ids = self.now.num_rows * self.sequence

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.at != k:
            self.at, self.now = k, self.file.get_batch(k)
        return self.now

    def slices(self, place: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from place on, as views of the file; more than one where they lie in several batches."""
        k, at = divmod(place, self.ids)
        while n > 0:
            ids = self._batch(k)["ids"].flatten().to_numpy(zero_copy_only=True)[at : at + n]
            yield ids
            k, at, n = k + 1, 0, n - len(ids)

    def sequence_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the packed mask of the i-th sequence, without copying."""
        k, at = divmod(i, self.ids // self.sequence)
        flat = (self._batch(k)[c].flatten().to_numpy(zero_copy_only=True) for c in ("ids", "mask"))
        return tuple(x[at * n : (at + 1) * n] for x, n in zip(flat, (self.sequence, self.sequence // 8), strict=True))


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the ids of every row of docs (doc_id, text), in ascending doc_id order, and returns the index.

    The index has file, part (files in order), doc_id, place (in the file) and n_tokens (with end_id). A null or empty
    text gives the end id alone. A null doc_id comes first; rows that repeat a doc_id follow each other in any order.
    Sequences go on over the ends of documents; only the last of a file is filled. An empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.arrow"
        encoder, out = Encoder(tokenizer), None
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            if not len(batch):
                continue
            out = out or SequenceWriter(folder, name, sequence, encoder.dtype)
            place, size = [], []
            for ids in encoder.encode(batch["text"]):
                place.append(out.add(ids + end))
                size.append(len(ids) // encoder.dtype.itemsize + 1)
            n = len(batch)
            yield pa.record_batch([pa.array([f"{folder}/{name}"] * n), pa.array([part] * n, pa.int64()), batch["doc_id"], pa.array(place, pa.int64()), pa.array(size, pa.int64())], ["file", "part", "doc_id", "place", "n_tokens"])
        if out:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return saved(rows.mapInArrow(run, _INDEX), "index")


def read(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, place) from the files: start is the number of ids of all documents before.

    A task reads the documents of its part of the index, each from its place in its file. Parts are ranges of files and
    places, as many as files or, where these are larger, as blocks of READ ids: the index's own size says nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            crc = []
            for file, place, n in zip(batch["file"].to_pylist(), batch["place"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
                if file != name:
                    name, reader = file, SequenceReader(file)
                value = 0
                for ids in reader.slices(place, n):
                    value = zlib.crc32(ids.astype("<u4"), value)
                crc.append(value)
            yield pa.record_batch([*batch.columns, pa.array(crc, pa.int64())], [*batch.schema.names, "ids_crc32"])

    # a row for each file, and running sums over files
    files = index.groupBy("file", "part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = saved(files.select("file", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before")), "files")
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    parts = index.repartitionByRange(max(1, n, -(-total // READ)), "part", "place").sortWithinPartitions("part", "place")
    found = parts.select("file", "doc_id", "place", "n_tokens").mapInArrow(run, "file string, doc_id long, place long, n_tokens long, ids_crc32 long")
    return found.join(files.drop("ids"), "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file", "place")


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """write() to the cluster's shared folder, then read()."""
    return read(write(docs, tokenizer, scratch(docs.sparkSession, "tokens"), end_id, sequence))
