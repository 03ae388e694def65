"""Web archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC/1.1 records, followed by the
seek table of the public seekable format in a skippable frame: for each frame its compressed and its plain size,
then the number of frames, a descriptor byte and the magic number.  Any Zstandard reader can read the whole file;
a reader of the seek table can get one frame alone.  An index table maps each record identifier to its bundle,
frame and place inside the frame.

Executors write bundles under names of their own attempt; only names that reach the committed index count, so a
lost or repeated task leaves at most an unread file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, save

SKIPPABLE = 0x184D2A5E  # fixed values of the seekable format
SEEKABLE = 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
READ_TASKS = 100_000
BROADCAST_ROWS = 200_000  # about 60 bytes each
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

INDEX = "record_id string, page_id long, bundle string, frame long, frame_start long, frame_size long, at long, size long"
RECORDS = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --------------------------------------------------------------------------- bundles
class BundleWriter:
    """Groups records into frames of about ``frame_bytes`` plain bytes."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.start, self.held, self.held_bytes = 0, [], 0

    def add(self, record: bytes) -> list[tuple[int, int, int, list]]:
        """Hold a record; returns the frames this closed as (number, start, compressed size, records' places)."""
        self.held.append(record)
        self.held_bytes += len(record)
        return self.flush() if self.held_bytes >= self.frame_bytes else []

    def flush(self) -> list[tuple[int, int, int, list]]:
        if not self.held:
            return []
        packed = self.codec.compress(b"".join(self.held))
        self.out.write(packed)
        places, at = [], 0
        for r in self.held:
            places.append((at, len(r)))
            at += len(r)
        done = (len(self.frames), self.start, len(packed), places)
        self.frames.append((len(packed), self.held_bytes))
        self.start += len(packed)
        self.held, self.held_bytes = [], 0
        return [done]

    def close(self) -> list[tuple[int, int, int, list]]:
        done = self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        return done


def seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame of an open bundle."""
    end = f.seek(0, io.SEEK_END)
    f.seek(end - 9)
    n, descriptor, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    entry = 12 if descriptor & 0x80 else 8
    f.seek(end - 9 - n * entry)
    table, start, raw = [], 0, f.read(n * entry)
    for k in range(n):
        packed, plain = struct.unpack_from("<II", raw, k * entry)
        table.append((start, packed, plain))
        start += packed
    return table


def read_frame(f, start: int, packed: int) -> bytes:
    f.seek(start)
    return zstandard.ZstdDecompressor().decompress(f.read(packed))


# --------------------------------------------------------------------------- records
def _line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def record_id(page_id: int | None, digest: str, place: str | None = None) -> str:
    """By page and payload; where several records have both in common, by their place in the archive too."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}' + (f':{place}' if place else ''))}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str | None = None, name_target: bool = True) -> tuple[str, bytes]:
    """(record identifier, the record's bytes).  A revisit has the HTTP head with the full length and no payload; it names
    the record it refers to unless several records of that page have the payload (``name_target``)."""
    rid = record_id(page_id, digest, place)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
        if name_target:
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
    head.append(f"Content-Length: {len(block)}")
    return rid, ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """The records in a frame's plain bytes.  A response's digest and length are those of the bytes read."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:cut].decode().split("\r\n")[1:] if ": " in x)
        start = cut + 4
        block = data[start : start + int(head["Content-Length"])]
        at = start + len(block) + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        number = lambda k: int(head[k]) if k in head else None
        if head["WARC-Type"] == "response":
            length = len(payload)
            if digest32(payload) != digest:
                raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        else:
            length, payload = int(re.search(rb"Content-Length: (\d+)", http)[1]), None
        yield {"page_id": number("X-Page-Id"), "record_id": head["WARC-Record-ID"], "url": head.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": payload}


# --------------------------------------------------------------------------- Spark
def _open(path: str):
    """(file system, path in it) of a URI, on executors too; any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in path and path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _attached(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, by ``keys``, null-safe.  A table of at most ``BROADCAST_ROWS`` rows goes to
    where the payloads are; a larger one is joined by shuffle, where Spark splits hot keys."""
    table = save(table, "warc-keys")
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    on = [rows[k].eqNullSafe(table[k]) for k in keys]
    return rows.join(table, reduce(lambda x, y: x & y, on), "left").select(rows["*"], *[table[c] for c in table.columns if c not in keys])


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (UTF-8 of html, null: empty), refers_to (the smallest page_id of the records with an equal
    payload of at least ``least_bytes`` bytes, null where that is the page itself), repeated (several rows have this
    page_id and payload, or there is no page_id) and target_repeated (the same of what it refers to).

    Digests alone are shuffled to find the groups, with partial counts; what is then attached to the payloads is a row
    for each payload that occurs more than once.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    counted = full.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("payload")).alias("size"))
    several = counted.groupBy("sha").agg(F.sum("n").alias("rows"), F.min("page_id").alias("first"), F.max("size").alias("size"), F.min_by("n", F.when(F.col("page_id").isNotNull(), F.col("page_id"))).alias("firsts")).where("rows > 1")
    several = several.select("sha", F.when(F.col("size") >= least_bytes, F.col("first")).alias("first"), (F.col("firsts") > 1).alias("target_repeated"))
    again = counted.where("n > 1 and page_id is not null").select("sha", "page_id", F.lit(True).alias("again"))
    out = _attached(_attached(full, several, ["sha"]), again, ["sha", "page_id"])
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    own = F.col("page_id").isNull() | F.coalesce("again", F.lit(False))
    return out.select("page_id", "url", "payload", refers.alias("refers_to"), own.alias("repeated"), F.coalesce("target_repeated", F.lit(False)).alias("target_repeated"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one WARC record per row of ``pages`` (page_id, url, html) to bundles in ``folder`` and return the
    index, a table in the shared folder.

    Null html is an empty payload, a null url leaves out the target, a null page_id leaves out the page number
    (such a row can be a revisit but is never referred to); rows repeated with the smallest page_id of their
    payload are each a response, and every repeated row is a record with an identifier of its own.  A record longer
    than a frame is a frame by itself; one over 2 GiB is beyond Spark's rows.  An empty table gives no bundle.  Other
    columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        store.create_dir(top, recursive=True)
        out = name = writer = None
        written = 0
        ids: list = []
        rows: list = []

        def note(closed):
            for number, start, packed, places in closed:
                for (at, size), (rid, page) in zip(places, ids, strict=True):
                    rows.append({"record_id": rid, "page_id": page, "bundle": f"{folder}/{name}", "frame": number, "frame_start": start, "frame_size": packed, "at": at, "size": size})
                ids.clear()

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "refers_to", "repeated", "target_repeated")]
            for row in zip(*cols, strict=True):
                page, url, payload, refers, repeated, target_repeated = (x.as_py() for x in row)
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                    writer = BundleWriter(out, frame_bytes)
                written += 1
                rid, record = make_record(page, url, payload, digest32(payload), refers, f"{name}:{written}" if repeated else None, not target_repeated)
                ids.append((rid, page))
                note(writer.add(record))
                if writer.start >= bundle_bytes:
                    note(writer.close())
                    out.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                rows.clear()
        if writer is not None:
            note(writer.close())
            out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    return save(mark_revisits(pages, least_bytes).mapInArrow(write, INDEX), "warc-index")


_INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("frame_start", pa.int64()), ("frame_size", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles named in ``bundles`` (bundle string), frame by frame along each seek table.

    Each bundle is a task, up to ``READ_TASKS`` of them; names are dealt evenly, as their number is known.  A bundle
    named repeatedly is read once, null names are left out, an empty table gives no records; other columns are ignored.
    A frame is held in memory at a time, so a very long record needs its own size.
    """
    names = save(bundles.select("bundle").where("bundle is not null").distinct(), "warc-bundles")
    tasks = max(1, min(names.count(), READ_TASKS))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _open(path)
                with store.open_input_file(name) as f:
                    for start, packed, _ in seek_table(f):
                        rows = list(parse_records(read_frame(f, start, packed)))
                        if not payloads:
                            rows = [r | {"payload": None} for r in rows]
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return names.repartition(tasks).mapInArrow(read, RECORDS)


def lookup(index: DataFrame, record_ids: DataFrame, frames_a_task: int = 64) -> DataFrame:
    """The records named in ``record_ids`` (record_id), each frame opened alone at its place in the index and read once.

    Unknown and null identifiers find nothing; repeated ones count once; other columns are ignored."""
    order = ["bundle", "frame_start", "frame_size", "at", "size"]
    wanted = save(index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi").select(*order), "warc-wanted")
    tasks = max(1, min(-(-wanted.select("bundle", "frame_start").distinct().count() // frames_a_task), READ_TASKS))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data = None, b""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if (r["bundle"], r["frame_start"]) != last:
                    store, name = _open(r["bundle"])
                    with store.open_input_file(name) as f:
                        data = read_frame(f, r["frame_start"], r["frame_size"])
                    last = (r["bundle"], r["frame_start"])
                rows += parse_records(data[r["at"] : r["at"] + r["size"]])
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return wanted.repartition(tasks, "bundle", "frame_start").sortWithinPartitions(*order).mapInArrow(read, RECORDS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT h, min(page_id) AS m FROM d GROUP BY h)
SELECT d.page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((strpos('0123456789abcdef', substr(d.h, (i * 5 // 4)::INT + 1, 1)) - 1) * 16
             + strpos('0123456789abcdef', substr(d.h, (i * 5 // 4)::INT + 2, 1)) - 1) >> (3 - (i * 5) % 4)::INT) % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to
FROM d JOIN f ON d.h = f.h
"""
