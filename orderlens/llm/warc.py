"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a footer in a skippable frame lists the frames' sizes
(the public seekable format, so any zstd reader can also read a bundle from end to end). The index, a Spark table, maps
each record identifier to its bundle, its frame and the record's offset inside the decompressed frame.

A bundle is written by one task from the rows as they are read; the pages themselves are only shuffled when the table of
copies is too large to broadcast. The index is committed by Spark: what a lost or repeated task attempt left behind is
named by no row of it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage

#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the WARC 1.1 profile of revisit records by payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, offset long, length long"
RECORDS = "record_id string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long"
_SPLIT = 10_000


def file_system(uri: str):
    """(file system, path) of a folder that Spark names by URI or by an absolute path."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


class BundleWriter:
    """Appends records to one bundle; memory holds one frame."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frame, self.sizes, self.written = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset inside it). A record that is larger than a frame has one of its own."""
        if self.frame and len(self.frame) + len(record) > self.frame_bytes:
            self._end_frame()
        place = len(self.sizes), len(self.frame)
        self.frame += record
        return place

    def _end_frame(self) -> None:
        packed = self.compress(bytes(self.frame))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._end_frame()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        width = 12 if flags & 0x80 else 8                       # with a checksum per frame or without
        table = self._at(size - 9 - frames * width, frames * width)
        entries = [struct.unpack_from("<II", table, k * width) for k in range(frames)]
        self.starts = [0, *accumulate(packed for packed, _ in entries)]
        self.plain = [0, *accumulate(full for _, full in entries)]

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        packed = self._at(self.starts[k], self.starts[k + 1] - self.starts[k])
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.plain[k + 1] - self.plain[k])

    def read(self, offset: int, length: int) -> bytes:
        """Bytes of the decompressed bundle, from the frames that hold them."""
        out, k = b"", bisect_right(self.plain, offset) - 1
        while len(out) < length and k + 1 < len(self.plain):
            begin = offset + len(out) - self.plain[k]
            out += self.frame(k)[begin:begin + length - len(out)]
            k += 1
        return out


def record_bytes(kind: str, record_id: str, url: str, digest: str, size: int, payload: bytes | None,
                 refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
            ("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Payload-Length", str(size))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    else:
        block += payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload: the body of the HTTP message in the block)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _row_key(*parts: Column) -> list[Column]:
    """128 bits that stand for a row; nulls are told apart from texts."""
    cells = [F.struct(p.isNull(), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return [F.xxhash64(*cells).alias("r1"), F.xxhash64(F.lit("row"), *cells).alias("r2")]


def _record_id(page: Column, r1: Column, r2: Column, copy: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex(r1)), F.lower(F.hex(r2)),
                    F.lit(":"), copy.cast("string"))


def plan_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """``record_id, page_id, url, sha1, size, payload, refers_to``, one row per row of ``pages``; a revisit has the record
    identifier of its response in ``refers_to`` and no payload.

    Equal payloads of at least ``min_bytes`` bytes (equal SHA-1, xxhash64 and length) have one response: the smallest page id
    (a null id last), of equal ids the smallest url. Rows equal in id, url and payload are counted before anything is shuffled;
    one of them is written with its payload.
    """
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")) \
        .withColumns({"size": F.length("payload").cast("long"), "sha1": F.sha1("payload"), "x": F.xxhash64("payload")})
    page = page.select("*", *_row_key(F.col("page_id"), F.col("url"), F.col("sha1"), F.col("x"), F.col("size")))
    rows = stage(page.groupBy("r1", "r2", "page_id", "url", "sha1", "x", "size").agg(F.count("*").alias("n")), "warc-rows")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url", "r1", "r2"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("sha1", "x", "size").agg(first.alias("first"), F.sum("n").alias("copies")) \
        .where("copies > 1")
    same = (F.col("r1") == F.col("first.r1")) & (F.col("r2") == F.col("first.r2"))
    target = _record_id(F.col("first.page_id"), F.col("first.r1"), F.col("first.r2"), F.lit(0))
    copies = stage(rows.join(groups.drop("copies"), ["sha1", "x", "size"])
                   .select("r1", "r2", "page_id", "url", "sha1", "size", "n", same.alias("is_first"), target.alias("target")), "warc-copies")
    # rows of small payloads, below min_bytes, can repeat too: all of them are responses, each from its own row
    known = copies.select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), "n", "is_first", "target")
    marked = page.join(known, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")), "left")
    columns = ["record_id", "page_id", "url", "sha1", "size", "payload", "refers_to"]
    rid = _record_id(F.col("page_id"), F.col("r1"), F.col("r2"), F.lit(0))
    revisit = F.col("is_first") == F.lit(False)
    single = marked.where("n is null or n = 1") \
        .select(F.when(F.col("n").isNull() & (F.col("size") < min_bytes), F.concat(rid, F.lit("-"), F.monotonically_increasing_id().cast("string")))
                .otherwise(rid).alias("record_id"), "page_id", "url", "sha1", "size",
                F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
                F.when(revisit, F.col("target")).alias("refers_to"))
    repeated = copies.where("n > 1")
    if repeated.isEmpty():
        return single.select(*columns)
    responses = marked.where("n > 1 and is_first").groupBy("r1", "r2") \
        .agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("sha1").alias("sha1"), F.first("size").alias("size"),
             F.first("payload").alias("payload")) \
        .select(rid.alias("record_id"), "page_id", "url", "sha1", "size", "payload", F.lit(None).cast("string").alias("refers_to"))
    # n can be any number: dealt out in runs before each run becomes rows
    runs = repeated.withColumn("from", F.explode(F.sequence(F.when(F.col("is_first"), 1).otherwise(0).cast("long"), F.col("n"), F.lit(_SPLIT).cast("long")))) \
        .where(F.col("from") < F.col("n")).repartition("r1", "r2", "from")
    others = runs.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + _SPLIT, F.col("n")) - 1))) \
        .select(_record_id(F.col("page_id"), F.col("r1"), F.col("r2"), F.col("copy")).alias("record_id"), "page_id", "url", "sha1", "size",
                F.lit(None).cast("binary").alias("payload"), F.col("target").alias("refers_to"))
    return single.select(*columns).unionByName(responses).unionByName(others)


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3,
                  date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the records of ``plan_records`` and return the index (staged): ``record_id, page_id, record_type, bundle, frame,
    offset, length``. Every task writes bundles of its own, each of about ``bundle_bytes`` compressed bytes. WARC wants
    a date in each record; the pages have none, so it is a parameter and reruns write equal records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        writer, name = None, ""
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string()),
                            ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            rows = []
            for rid, page, url, sha1, size, payload, target in zip(*(batch.column(c) for c in
                                                                     ("record_id", "page_id", "url", "sha1", "size", "payload", "refers_to"))):
                if writer is None or writer.written >= bundle_bytes:
                    if writer:
                        writer.close()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes, level)
                kind = "response" if target.as_py() is None else "revisit"
                record = record_bytes(kind, rid.as_py(), url.as_py() or "", base32(bytes.fromhex(sha1.as_py())), size.as_py(), payload.as_py(),
                                      target.as_py(), date)
                rows.append((rid.as_py(), page.as_py(), kind, name, *writer.add(record), len(record)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if writer:
            writer.close()

    return stage(records.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = False, task_bytes: int = 64 << 20) -> DataFrame:
    """The records that the rows of ``index`` name (filter or join it first to look some up): ``record_id, page_id, record_type,
    url, payload_bytes, payload_digest, refers_to`` and, if asked for, ``payload``.

    Each frame is read and decompressed once, by the seek table of its bundle; the frames are dealt over as many tasks as hold
    about ``task_bytes`` of records each, which the small rows of the index would not tell Spark. A response whose payload differs from its
    digest is an error. ``payload_bytes`` and the digest of a revisit are those of the full payload, from its header.
    """
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places")) \
        .repartition(tasks, "bundle", F.floor(F.col("frame") / 8)).sortWithinPartitions("bundle", "frame")
    schema = RECORDS + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        name, reader = None, None
        for batch in batches:
            for bundle, k, places in zip(*(batch.column(c) for c in ("bundle", "frame", "places"))):
                if bundle.as_py() != name:
                    name = bundle.as_py()
                    reader = BundleReader(fs.open_input_file(f"{root}/{name}"))
                plain, rows = reader.frame(k.as_py()), []
                for place in places.as_py():
                    rows.append(_record_row(plain[place["offset"]:place["offset"] + place["length"]], with_payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return frames.mapInArrow(run, schema)


def _page_of(record_id: str) -> int | None:
    number = record_id.strip("<>").split(":")[2]
    return int(number) if number else None


def _record_row(record: bytes, with_payload: bool) -> tuple:
    fields, payload = parse_record(record)
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: payload does not match its digest")
    target = fields.get("WARC-Refers-To")
    rid = fields["WARC-Record-ID"].strip("<>")
    row = (rid, _page_of(rid), kind, fields["WARC-Target-URI"], int(fields["Payload-Length"]), digest, _page_of(target) if target else None)
    return (*row, payload if kind == "response" else None) if with_payload else row


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, **names) -> tuple[DataFrame, str]:
    """(index, folder) of the archive of ``pages``: one WARC record per row, in bundles in a folder of the shared storage.

    Null html counts as empty, a null url as the empty text; a null page id is kept (its response is referred to with a null id).
    Repeated rows are one response and revisits of it (below ``min_bytes`` all responses). Payloads of any size are whole
    records. An empty table gives an empty index. Other columns are not read.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/llm/warc-{uuid.uuid4().hex}"
    return write_bundles(plan_records(pages, min_bytes, **names), folder), folder
