r"""WARC records in seekable Zstandard bundles.

Each page becomes a record: a `response` with its payload, or, where another
page has the same payload, a `revisit` that names it.  The page with the
smallest id among equal payloads is the response.  Records of a task are put in
frames of about `frame_bytes`, each compressed on its own; frames make up
bundles of about `bundle_bytes`.  A bundle ends with a seek table in a skippable
frame (compressed and plain size of every frame), so any Zstandard reader reads
the whole and a seeking one finds a frame by its number.  The index beside each
bundle maps record ids to frames and to offsets within the plain frame.

Bundles are rows of a table (bundle, data, index): Spark's committer makes them
whole or absent, wherever the folder is, and a lost executor's are written
again.  The data column of a row is the archive file, byte for byte.

Which page is the response is settled on thin rows: the smallest id for each
digest is a partial minimum, so a payload that a third of all pages share is one
row per task; pages join it by digest (a skewed join that Spark may split), and
payloads move once, by page.  Revisits carry none.

Defined results: a null html is an empty payload; payloads smaller than
min_bytes are all responses; rows that repeat page and payload are written each,
the first as the response; a null id is never a response to others.  No pages
give no bundles.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm.scratch import Scratch

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 32 << 20, 3
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2020-01-01T00:00:00Z"
BUNDLE = ("bundle string, records int, data binary, "
          "index array<struct<record_id:string,frame:int,offset:int,length:int>>")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(number: int, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str) -> tuple[str, bytes]:
    """A WARC record and its id."""
    name = f"<urn:page:{page_id}:{number}>"
    head = {
        "WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    body = payload
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}:0>"
        body = b""
    head["Content-Type"] = "text/html; charset=utf-8"
    head["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return name, b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body):] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return fields, body


class Bundle:
    """Collects records into frames; `close` gives the bundle's bytes and index."""

    def __init__(self, frame_bytes: int, level: int) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.sizes, self.index, self.now, self.held = [], [], [], [], 0

    def add(self, name: str, data: bytes) -> None:
        if self.held and self.held + len(data) > self.frame_bytes:
            self._end_frame()
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.held, "length": len(data)})
        self.now.append(data)
        self.held += len(data)

    def _end_frame(self) -> None:
        if self.now:
            self.frames.append(self.packer.compress(b"".join(self.now)))
            self.sizes.append((len(self.frames[-1]), self.held))
            self.now, self.held = [], 0

    @property
    def size(self) -> int:
        return sum(c for c, _ in self.sizes)

    def close(self) -> tuple[bytes, list[dict]]:
        self._end_frame()
        table = b"".join(struct.pack("<II", c, p) for c, p in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table, self.index


class Reader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, data: bytes) -> None:
        frames, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        start = len(data) - 9 - frames * entry
        self.data, self.places, at = data, [], 0
        for i in range(frames):
            packed, plain = struct.unpack_from("<II", data, start + i * entry)
            self.places.append((at, packed, plain))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            at, packed, plain = self.places[number]
            self.last = number, self.unpacker.decompress(self.data[at: at + packed], max_output_size=plain)
        return self.last[1]

    def at(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset: offset + length]


def _write(batches, frame_bytes: int, bundle_bytes: int, level: int, min_bytes: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
    bundle, last, repeat = Bundle(frame_bytes, level), None, 0

    def done(b: Bundle) -> pa.RecordBatch:
        data, index = b.close()
        return pa.RecordBatch.from_arrays([
            pa.array([f"bundle-{digest(data)}"]), pa.array([len(index)], pa.int32()), pa.array([data], pa.binary()),
            pa.array([index], kind)], names=["bundle", "records", "data", "index"])

    for batch in batches:
        cols = (batch.column(c) for c in ("page_id", "url", "html", "digest", "first", "dup"))
        for page, url, html, sha, first, dup in zip(*(c for c in cols)):
            page, url, sha, first = page.as_py(), url.as_py(), sha.as_py(), first.as_py()
            payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
            repeat = repeat + 1 if last == (page, sha) else 0
            last = page, sha
            again = dup.as_py() and len(payload) >= min_bytes and first is not None and (page != first or repeat > 0)
            bundle.add(*record(repeat, page, url, payload, first, "revisit" if again else "response"))
            if bundle.size >= bundle_bytes:
                yield done(bundle)
                bundle = Bundle(frame_bytes, level)
    if bundle.index:
        yield done(bundle)


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, min_bytes: int = 0) -> DataFrame:
    """Writes the archives and gives their table (see BUNDLE)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    thin = scratch.keep(rows.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")))
    first = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("pages")).where("pages > 1")
    roles = scratch.keep(thin.join(first, "digest").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first"))
    placed = (rows.join(roles, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
              .select("page_id", "url", "html", "digest", "first", F.col("d").isNotNull().alias("dup"))
              .repartition("page_id", "digest").sortWithinPartitions("page_id", "digest", "url"))
    return scratch.keep(placed.mapInArrow(lambda it: _write(it, frame_bytes, bundle_bytes, level, min_bytes), BUNDLE))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(bundles: DataFrame) -> DataFrame:
    """Every record of the archives, found through index and seek table (see READ).

    A response's digest and length are taken anew from its payload and must agree with its header.
    """
    def rows(batches):
        for batch in batches:
            for data, index in zip(batch.column("data"), batch.column("index")):
                reader, got = Reader(data.as_py()), []
                for x in index.as_py():
                    head, body = parse(reader.at(x["frame"], x["offset"], x["length"]))
                    named = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Record-ID"] != x["record_id"]:
                        raise ValueError("the index names another record")
                    if head["WARC-Type"] == "response" and (digest(body) != named or len(body) != int(head["X-Payload-Length"])):
                        raise ValueError("payload and header disagree")
                    to = head.get("WARC-Refers-To")
                    got.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, int(head["X-Payload-Length"]), named,
                                head["WARC-Type"], int(to.split(":")[2]) if to else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)],
                                                 names=[c.split()[0] for c in READ.split(", ")])

    return bundles.select("data", "index").mapInArrow(rows, READ)


def lookup(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (record_id) -> (record_id, record): only the frames that hold those records are unpacked."""
    places = bundles.select("bundle", F.explode("index").alias("x")).select("bundle", "x.*").join(wanted, "record_id")
    grouped = places.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("x"))

    def rows(batches):
        for batch in batches:
            for data, places in zip(batch.column("data"), batch.column("x")):
                reader = Reader(data.as_py())
                got = sorted(places.as_py(), key=lambda x: (x["frame"], x["offset"]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["record_id"] for x in got], pa.string()),
                    pa.array([reader.at(x["frame"], x["offset"], x["length"]) for x in got], pa.binary())],
                    names=["record_id", "record"])

    return bundles.select("bundle", "data").join(grouped, "bundle").select("data", "x").mapInArrow(
        rows, "record_id string, record binary")
