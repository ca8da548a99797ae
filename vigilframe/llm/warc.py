"""WARC files of pages and a Merkle audit of their fixity."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import materialize, shared_dir

# Children of a node, and records of a shard on average.
FANOUT = 16
SHARD_ROWS = 1024
# A file ends with the record that takes it to this size.
FILE_BYTES = 64 << 20
# Records of a task whose copies are not written again, and bytes read at once.
RECENT = 10_000
CHUNK = 1 << 20
PIECE = 1 << 14
DATE = "1970-01-01T00:00:00Z"
_PLACE = "page_id string, url string, file string, offset long, length long, n_bytes long, digest string, copies long"
_READ = "file string, offset long, length long, record_id string, n_bytes long, digest string"


def warc_record(page_id: str | None, url: str | None, content: bytes, date: str = DATE) -> bytes:
    """A resource record with the two line ends that close it."""
    uri = (url or "about:blank").replace("\r", " ").replace("\n", " ")
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>\r\nWARC-Date: {date}\r\n"
        f"WARC-Target-URI: {uri}\r\nContent-Type: text/html\r\nContent-Length: {len(content)}\r\n\r\n"
    )
    return head.encode() + content + b"\r\n\r\n"


def _batch(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    names, types = zip(*(k.split() for k in kinds.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(columns, types)], list(names))


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", content: str = "html", date: str = DATE
) -> DataFrame:
    """WARC files below ``folder`` (a URL that all executors reach), one gzip member for each record, as readers expect.

    Each task writes the pages that it holds, in files of FILE_BYTES and one record at most, so no page is shuffled. A file's name
    is new for each attempt of a task, and the index names only files of attempts that ended well. Pages of equal id,
    address and content near each other in a task are written once and counted.

    Returns the index, materialised: page_id and url as text, file, offset and length of the packed record, n_bytes and
    sha256 of the unpacked one, copies. A null content is an empty one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, recent = None, "", {}
        for batch in batches:
            found: dict[tuple, list] = {}
            for i, u, t in zip(batch.column("i").to_pylist(), batch.column("u").to_pylist(), batch.column("t")):
                t = t.as_buffer()
                record = warc_record(i, u, bytes(t) if t else b"", date)
                key = (i, u, hashlib.sha256(record).hexdigest())
                if key in found:
                    found[key][-1] += 1
                    continue
                place = recent.get(key)
                if place is None:
                    if out is None:
                        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        system, path = fs.FileSystem.from_uri(name)
                        out = system.open_output_stream(path, compression=None)
                    pack = zlib.compressobj(6, wbits=31)
                    packed = pack.compress(record) + pack.flush()
                    place = (name, out.tell(), len(packed), len(record))
                    out.write(packed)
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent[key] = place
                    if out.tell() >= FILE_BYTES:
                        out.close()
                        out = None
                found[key] = [*place, 1]
            yield _batch([(i, u, *p[:4], digest, p[4]) for (i, u, digest), p in found.items()], _PLACE)
        if out is not None:
            out.close()

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(F.col(page_id).cast("string").alias("i"), F.col(url).cast("string").alias("u"), F.col(content).cast("binary").alias("t"))
    return materialize(rows.mapInArrow(write, _PLACE), "warc-index")


def read_record(file: str, offset: int, length: int) -> bytes:
    """The unpacked record at a place of a file, read without those before it."""
    system, path = fs.FileSystem.from_uri(file)
    with system.open_input_file(path) as source:
        source.seek(offset)
        return zlib.decompress(source.read(length), wbits=31)


class _Bytes:
    """A window on a stream's bytes, from the start of the member at hand."""

    def __init__(self, source):
        self.source, self.held, self.base, self.ended = source, b"", 0, False

    def more(self, keep: int) -> bool:
        """Let go of what lies before ``keep`` and read on."""
        chunk = b"" if self.ended else self.source.read(CHUNK)
        self.held, self.base, self.ended = self.held[keep:] + chunk, self.base + keep, not chunk
        return not self.ended


def _members(source) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, record) of a file's members; of what cannot be unpacked, up to the next member, the record is None."""
    data, at = _Bytes(source), 0
    while True:
        if at == len(data.held):
            if not data.more(at):
                return
            at = 0
        unpack, parts, end = zlib.decompressobj(wbits=31), [], at
        try:
            while not unpack.eof:
                if end == len(data.held):
                    going = data.more(at)
                    at, end = 0, end - at
                    if not going:
                        break
                piece = data.held[end : end + PIECE]
                parts.append(unpack.decompress(piece))
                end += len(piece) - len(unpack.unused_data)
        except zlib.error:
            pass
        if unpack.eof:
            yield data.base + at, end - at, b"".join(parts)
            at = end
            continue
        start, scan = data.base + at, at + 1
        while True:
            found = data.held.find(b"\x1f\x8b\x08", scan)
            if found >= 0 and (data.ended or len(data.held) - found >= PIECE):
                if _begins(data.held[found : found + PIECE]):
                    yield start, data.base + found - start, None
                    at = found
                    break
                scan = found + 1
                continue
            if data.ended:
                yield start, data.base + len(data.held) - start, None
                return
            data.more(found if found >= 0 else max(scan, len(data.held) - 2))
            scan = 0


def _begins(data: bytes) -> bool:
    try:
        return zlib.decompressobj(wbits=31).decompress(data, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def read_warc(files: DataFrame) -> DataFrame:
    """(file, offset, length, record_id, n_bytes, digest) of every record of the named files.

    A file is read in pieces; a task holds one record. A damaged member is one record without an id and with the digest
    of nothing; a lost file has no records.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, path = fs.FileSystem.from_uri(file)
                if system.get_file_info(path).type != fs.FileType.File:
                    continue
                rows = []
                with system.open_input_stream(path, compression=None) as source:
                    for offset, length, record in _members(source):
                        head = (record or b"").partition(b"\r\n\r\n")[0]
                        name = next((x[15:].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"warc-record-id:")), b"")
                        digest = None if record is None else hashlib.sha256(record).hexdigest()
                        rows.append((file, offset, length, name.decode("utf-8", "replace"), len(record or b""), digest))
                        if len(rows) >= RECENT:
                            yield _batch(rows, _READ)
                            rows = []
                yield _batch(rows, _READ)

    return files.mapInArrow(read, _READ)


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level: each parent hashes its at most FANOUT children's hashes and the lengths of their offset ranges, in order."""
    child = F.concat_ws(":", "node", F.col("high") - F.col("low"), "hash")
    return nodes.groupBy("shard", F.floor(F.col("node") / FANOUT).alias("node")).agg(
        F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("node", child.alias("text")))), lambda c: c["text"])), 256).alias("hash"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def merkle_tree(records: DataFrame) -> list[DataFrame]:
    """Levels, leaves first: (shard, node, hash, low, high), up to one root per shard.

    A leaf is a record with its offset range; a node above covers FANOUT neighbouring ones. Shards' trees
    grow side by side, and a level has a FANOUTth of the rows below it.
    """
    leaves = records.select("shard", F.col("seq").alias("node"), F.col("digest").alias("hash"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"))
    levels = [materialize(leaves, "leaves")]
    while levels[-1].where("node > 0").limit(1).count():
        levels.append(materialize(_parents(levels[-1]), "level"))
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Locate differing records of two replicas: shard, seq, offset, length, status.

    Replicas are records (shard, seq, offset, length, digest). The roots of the shards are compared, then only children
    of nodes that differ, level by level; a shard or node that only one replica has differs. Status is ``damaged`` where
    both have the record, else ``missing`` or ``extra``; equal replicas give no rows. A record that is lost from the
    middle of a shard moves those behind it, which are then reported at their places.
    """
    a, b = merkle_tree(primary), merkle_tree(replica)
    top = max(len(a), len(b))
    suspects = None
    for depth in range(top - 1, -1, -1):
        left = (a[depth] if depth < len(a) else _parents_of(a[-1], depth - len(a) + 1)).alias("a")
        right = (b[depth] if depth < len(b) else _parents_of(b[-1], depth - len(b) + 1)).alias("b")
        if suspects is not None:
            up = F.floor(F.col("node") / FANOUT)
            left, right = (
                x.withColumn("up", up).join(suspects, ["shard", "up"], "left_semi").alias(name) for x, name in ((left, "a"), (right, "b"))
            )
        joined = left.join(right, (F.col("a.shard") == F.col("b.shard")) & (F.col("a.node") == F.col("b.node")), "full")
        spans = [F.col(f"{x}.high") - F.col(f"{x}.low") for x in "ab"]
        same = F.col("a.hash").eqNullSafe(F.col("b.hash")) & spans[0].eqNullSafe(spans[1])
        differ = joined.where(~same)
        if depth:
            suspects = materialize(differ.select(F.coalesce("a.shard", "b.shard").alias("shard"), F.coalesce("a.node", "b.node").alias("up")), "suspects")
    low, high = F.coalesce("a.low", "b.low"), F.coalesce("a.high", "b.high")
    return differ.select(
        F.coalesce("a.shard", "b.shard").alias("shard"), F.coalesce("a.node", "b.node").alias("seq"), low.alias("offset"), (high - low).alias("length"),
        F.when(F.col("b.hash").isNull(), "missing").when(F.col("a.hash").isNull(), "extra").otherwise("damaged").alias("status"),
    )


def _parents_of(nodes: DataFrame, levels: int) -> DataFrame:
    for _ in range(levels):
        nodes = _parents(nodes)
    return nodes


def leaves(records: DataFrame, shards: int) -> DataFrame:
    """(shard, seq, offset, length, digest, page_id, url, content) of the different records, by shards of their ids and addresses.

    Equal records are one leaf with their count in the digest. Pages without an id are dealt out by their size too.
    """
    by = F.xxhash64("page_id", "url", F.when(F.col("page_id").isNull(), F.col("n_bytes")))
    different = records.groupBy(F.pmod(by, F.lit(shards)).cast("string").alias("shard"), "page_id", "url", "digest", "n_bytes").agg(F.sum("copies").alias("k"))
    order = Window.partitionBy("shard").orderBy("page_id", "url", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return different.select(
        "shard", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum(F.col("n_bytes") * F.col("k")).over(before), F.lit(0)).alias("offset"), (F.col("n_bytes") * F.col("k")).alias("length"),
        F.concat_ws("*", F.coalesce("digest", F.lit("lost")), "k").alias("digest"), "page_id", "url", F.col("digest").alias("content"),
    )


def read_back(index: DataFrame) -> DataFrame:
    """The index with size and digest of each record as its file holds it now; null where it is lost."""
    now = read_warc(index.select("file").distinct()).select("file", "offset", F.col("n_bytes").alias("n"), F.col("digest").alias("d"))
    joined = index.join(materialize(now, "records"), ["file", "offset"], "left")
    return materialize(joined.select("page_id", "url", "file", "offset", "length", F.coalesce("n", F.lit(0)).alias("n_bytes"), F.col("d").alias("digest"), "copies"), "held")


def fixity(pages: DataFrame, replica: DataFrame, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """Write two page tables as WARC files, read them back and audit one against the other.

    Returns every record of the first table's files: page_id, shard, seq, file, offset, length (of the packed record, for
    ``read_record``), digest, status (``intact``, ``damaged`` or ``missing``), a row per page. Null pages are records with
    empty content, null urls stand as about:blank, repeated pages share a record or have their own; empty tables
    give no rows. Pages of any size are records; other columns are not read.
    """
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType.simpleString()
    sides = []
    for name, table in (("primary", pages), ("replica", replica)):
        folder = shared_dir(spark, name)
        folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        sides.append(read_back(write_warc(table, folder, page_id, url, content)))
    count = max(1, -(-max(s.count() for s in sides) // SHARD_ROWS))
    first, second = (materialize(leaves(s, count), "leaves") for s in sides)
    found = materialize(audit(first, second), "found")
    here = first.alias("r").join(found.where("status <> 'extra'").alias("f"), (F.col("r.shard") == F.col("f.shard")) & (F.col("r.seq") == F.col("f.seq")), "left")
    here = here.select("r.shard", "r.seq", F.col("r.page_id").alias("i"), F.col("r.url").alias("u"), "r.content", F.coalesce("f.status", F.lit("intact")).alias("status"))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("page_id", "i"), ("url", "u"), ("digest", "content"))]
    rows = sides[0].join(here, same[0] & same[1] & same[2])
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return rows.select(
        F.col("page_id").cast(kind).alias("page_id"), "shard", "seq", "file", "offset", "length", "digest", "status", each.alias("copy")
    ).drop("copy")
