"""Token ids in Arrow stream files of equal-length sequences and masks."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import materialize, shared_dir
from vigilframe.llm.common import small_side

END_ID = 1
SEQUENCE = 2048
BATCH = 128
# Words kept with their ids per worker (some 400 MB at most); when full, all are forgotten.
CACHE_WORDS = 2_000_000


class WordIds(dict):
    """Ids of a text by its words: a word's ids come from the tokenizer once and are looked up afterwards.

    The tokenizer drops white space and never joins what it separates, so a text's ids are its words' ids in order.
    Lower case is set before the look-up where the tokenizer would set it anyway, and full stops and commas between
    other characters and a space are words of their own, as they are for the tokenizer. Texts in which one of these
    could matter are given to the tokenizer as they are.
    """

    # Bytes of letters, digits, white space, full stops, commas, and of characters beyond ASCII.
    _plain = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b) in " \t\n\r\x0b\x0c.,")
    _odd = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]|İ")
    _whole = re.compile("[\x1c-\x1f]")
    _as_is = re.compile("<\\||[İɐ-\U0010ffff]")
    _joined = re.compile(r"(?:[^\w\s]|_)[.,]|[.,](?:[^\w\s]|_)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat = np.empty(1 << 16, self.dtype)
        self.ends = np.zeros(1 << 15, np.int64)
        self.known = 0

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def _learn(self) -> None:
        model = self.tokenizer.model
        # For a word of ASCII letters in lower case, the steps before the model change nothing.
        plain = [w.isascii() and w.isalpha() and w.islower() for w in self.new]
        others = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(self.new, plain) if not p], add_special_tokens=False))
        ids = [[t.id for t in model.tokenize(w)] if p else next(others).ids for w, p in zip(self.new, plain)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        start = self.ends[self.known - 1] if self.known else 0
        need, count = int(start + lengths.sum()), self.known + len(ids)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while count > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[start:need] = np.fromiter((x for e in ids for x in e), self.dtype, need - int(start))
        self.ends[self.known : count] = start + np.cumsum(lengths)
        self.known, self.new = count, []

    def of(self, text: str) -> np.ndarray:
        if not text.encode("utf-8", "replace").translate(None, self._plain) and (text.isascii() or not self._odd.search(text)):
            text = text.lower()
            if not any(pair in text for pair in ("..", ",,", ".,", ",.")):
                text = text.replace(".", " .").replace(",", " ,")
        elif self._whole.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        elif not self._as_is.search(text):
            text = text.lower()
            if not self._joined.search(text):
                text = text.replace(".", " .").replace(",", " ,")
        words = text.split()
        if not words:
            return np.empty(0, self.dtype)
        if len(self) + len(words) > CACHE_WORDS and self.known:
            self._forget()
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self._learn()
        ends = self.ends[places]
        starts = np.where(places > 0, self.ends[places - 1], 0)
        lengths = ends - starts
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own look-up, kept between its tasks."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def _schema(width: int, sequence: int) -> pa.Schema:
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class SequenceWriter:
    """Packs ids behind each other into sequences of one length; batches hold equally many of them.

    The last sequence is padded with zeros under a false mask, the last batch with such sequences, so every batch of a
    file has the same number of bytes and a place in the file follows from a position.
    """

    def __init__(self, url: str, width: int, sequence: int = SEQUENCE, batch: int = BATCH):
        system, path = fs.FileSystem.from_uri(url)
        self.sequence, self.batch, self.schema = sequence, batch, _schema(width, sequence)
        self.out = system.open_output_stream(path)
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.dtype = np.dtype(f"<u{width}")
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        size = self.sequence * self.batch
        if self.held >= size:
            flat = np.concatenate(self.rest)
            whole = len(flat) // size * size
            for start in range(0, whole, size):
                self._write(flat[start : start + size], size)
            self.rest, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.zeros(self.sequence * self.batch, self.dtype)
            flat[: self.held] = np.concatenate(self.rest)
            self._write(flat, self.held)
        self.writer.close()
        self.out.close()


class SequenceReader:
    """Random access to the ids of a file: a batch is read where it lies, without those before it."""

    def __init__(self, url: str):
        system, path = fs.FileSystem.from_uri(url)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.source)
        self.first = self.source.tell()
        self.sequence = self.schema.field("ids").type.list_size
        self.batches: dict[int, pa.RecordBatch] = {}
        head = pa.ipc.read_message(self.source)
        self.step = self.source.tell() - self.first
        self.per_batch = pa.ipc.read_record_batch(head, self.schema).num_rows * self.sequence

    def _batch(self, k: int) -> pa.RecordBatch:
        if k not in self.batches:
            self.source.seek(self.first + k * self.step)
            if len(self.batches) > 4:
                self.batches.clear()
            self.batches[k] = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return self.batches[k]

    def sequences(self, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequences, as (count, length) arrays."""
        at = first * self.sequence
        kinds = [self._take(at, count * self.sequence, c).reshape(count, self.sequence) for c in ("ids", "mask")]
        return kinds[0], kinds[1]

    def ids(self, start: int, count: int) -> np.ndarray:
        return self._take(start, count, "ids")

    def _take(self, start: int, count: int, column: str) -> np.ndarray:
        parts = []
        while count > 0:
            k, inside = divmod(start, self.per_batch)
            n = min(count, self.per_batch - inside)
            values = self._batch(k).column(column).values.slice(inside, n)
            parts.append(values.to_numpy(zero_copy_only=column == "ids"))
            start, count = start + n, count - n
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, batch: int = BATCH
) -> DataFrame:
    """Encode whole texts into Arrow stream files below ``folder`` (a URL that all executors reach), by ascending id.

    Documents are dealt out by ranges of their id; a task encodes its range and writes one file of fixed-size-list
    batches ``ids`` and ``mask``. An id of 1 ends each document. A file's name is new for each attempt of a task and
    the index names only files of attempts that ended well, so lost executors leave an unused file at most.

    Returns the index: doc_id, file, at (the document's first position in the file), start (ids of all documents
    before it), n_tokens, materialised. Null texts are empty and have the end id only. Null ids come last; rows of
    equal ids follow each other. Repeated rows are written repeatedly. An empty table gives no files and no rows.
    Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, url, look = None, "", word_ids(tokenizer)
        end = np.array([END_ID], look.dtype)
        for frame in frames:
            places, counts = [], []
            for value in frame.column("t"):
                if writer is None:
                    url = f"{folder}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrows"
                    writer = SequenceWriter(url, look.width, sequence, batch)
                ids = look.of(value.as_py() or "")
                places.append(writer.total)
                counts.append(len(ids) + 1)
                writer.add(ids)
                writer.add(end)
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array([url] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "file", "at", "n_tokens"],
            )
        if writer is not None:
            writer.close()

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    order = F.col("doc_id").asc_nulls_last()
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).repartitionByRange(order).sortWithinPartitions(order)
    written = materialize(dealt.mapInArrow(write, f"doc_id {kind}, file string, at long, n_tokens long"), "token-index")
    files = written.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row per file; files are numbered by the range that they hold.
    before = Window.orderBy(F.substring_index("file", "/", -1)).rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return written.join(small_side(materialize(base, "token-files")), "file").select(
        "doc_id", "file", "at", (F.col("base") + F.col("at")).alias("start"), "n_tokens"
    )


def read_tokens(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of an index, from its files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, opened = None, None
        for frame in frames:
            sums = []
            for file, at, n in zip(frame["file"], frame["at"], frame["n_tokens"]):
                if file != opened:
                    reader, opened = SequenceReader(file), file
                sums.append(zlib.crc32(reader.ids(at, n).astype("<u4").tobytes()))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "start": frame["start"], "n_tokens": frame["n_tokens"], "ids_crc32": sums})

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.mapInPandas(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to a new shared folder and return what is read back from them."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = shared_dir(docs.sparkSession, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_tokens(write_tokens(docs, folder, tokenizer, doc_id, text))
