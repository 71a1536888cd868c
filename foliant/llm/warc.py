"""A deterministic sharded WARC writer, and its reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import partitions, range_of, sampled_splitters, written

DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6b1f2a34-93c1-4e0d-9a55-0a6f8a1c7d10")
NONE = "null"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{NONE if page_id is None else page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with its headers and digests made anew; a revisit has no payload block."""
    own = digest(payload)
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_urn(page_id, "page")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", record_urn(refers_to, "page") if revisit else None),
        ("X-Page-Id", NONE if page_id is None else str(page_id)),
        ("X-Refers-To-Page-Id", str(refers_to) if revisit else None),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file that is read in order."""
    held = b""

    def need(n: int) -> bool:
        nonlocal held
        parts = [held]
        have = len(held)
        while have < n and (more := next(data, b"")):
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        return have >= n

    while need(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                raise ValueError("a WARC header is cut off")
        lines = held[:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        if not need(end + 4 + n + 4) or held[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a WARC block is cut off")
        yield head, held[end + 4 : end + 4 + n]
        held = held[end + 8 + n :]


class _Roll:
    """Writes records to gzip members, one file after the other; a file counts once it has its own name."""

    def __init__(self, folder: str, bucket: int, limit: int, level: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.bucket, self.limit, self.level, self.seq, self.out = bucket, limit, level, 0, None

    def add(self, data: bytes) -> dict | None:
        if self.out is None:
            self.name = f"part-{self.bucket:06d}-{self.seq:04d}.warc.gz"
            self.temp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.sum, self.bytes, self.records = self.store.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.out.write(member)
        self.sum.update(member)
        self.bytes += len(member)
        self.records += 1
        return self.close() if self.bytes >= self.limit else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.store.move(self.temp, f"{self.folder}/{self.name}")
        self.seq += 1
        return {"name": self.name, "bytes": self.bytes, "records": self.records, "sha256": self.sum.hexdigest()}


MANIFEST = "name string, bytes long, records long, sha256 string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [digest((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string()), pa.array([len((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()], pa.int64())], ["page_id", "digest", "n"])


def write_warc(pages: DataFrame, folder: str, file_bytes: int = 64 << 20, range_bytes: int = 128 << 20, level: int = 6, dedup_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes one record per row and returns the manifest (name, bytes, records, sha256), one row per file.

    Rows are range-partitioned by splitters of a sample of page_id, about `range_bytes` of payload
    to a range and one range to a task, and sorted, so a file
    holds a run of ids and the layout depends on the rows alone; files roll once their compressed size reaches `file_bytes`. Of
    equal payloads of at least `dedup_bytes` bytes the one with the least page_id is the
    response, the others are revisits that name it. Each file is written under a temporary
    name and renamed; a task that runs again writes the same bytes to the same name. The
    manifest is committed last, also through a temporary name: files it does not list
    are not part of the archive.

    A null payload counts as empty, a null url has no target header, a null page_id sorts
    first and is always a response. Rows with equal id and payload: one is the response,
    and all the others revisit that id. No rows give an empty manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    facts = written(rows.select("page_id", "payload").mapInArrow(_facts, "page_id long, digest string, n long").where("page_id is not null"), "digests")
    first = facts.where(F.col("n") >= dedup_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = facts.join(first.select("digest", "first"), "digest").groupBy("page_id", "digest").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("rows"))
    revisits = revisits.where("page_id <> first or rows > 1")
    key = F.coalesce("page_id", F.lit(-(1 << 63)))
    sized = rows.select(key.alias("key"), (F.coalesce(F.octet_length("payload"), F.lit(0)) + 300).alias("size"))
    total = int(sized.agg(F.sum("size")).first()[0] or 0)
    ranges = max(1, -(-total // range_bytes), min(64, -(-total * 32 // range_bytes)))  # a small table still takes several tasks
    bucket = range_of([key], sampled_splitters(sized, ["key"], "size", ranges))
    none = F.lit(None)
    told = revisits.select(bucket.alias("bucket"), "page_id", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("payload"), "digest", "first")
    full = rows.select(bucket.alias("bucket"), "page_id", F.lit(1).alias("kind"), "url", "payload", none.cast("string").alias("digest"), none.cast("long").alias("first"))
    order = ["bucket", F.col("page_id").asc_nulls_first(), "kind", "url", "payload"]
    dealt = told.unionByName(full).repartitionById(ranges, F.col("bucket")).sortWithinPartitions(*order)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
        roll, done, at, refers, seen = None, [], None, {}, set()
        for batch in batches:
            for r in batch.to_pylist():
                if roll is None or roll.bucket != r["bucket"]:
                    done.append(roll and roll.close())
                    roll, at = _Roll(folder, r["bucket"], file_bytes, level), None
                if at != (r["bucket"], r["page_id"]):
                    at, refers, seen = (r["bucket"], r["page_id"]), {}, set()
                if r["kind"] == 0:
                    refers[r["digest"]] = r["first"]
                    continue
                data = (r["payload"] or "").encode("utf-8", "surrogatepass")
                own = digest(data)
                to = refers.get(own)
                if to == r["page_id"] and own not in seen:
                    to = None
                seen.add(own)
                done.append(roll.add(record(r["page_id"], r["url"], data, to)))
        done.append(roll and roll.close())
        files = [x for x in done if x]
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=schema)

    manifest = written(dealt.mapInArrow(run, MANIFEST), "manifest")
    temp = f"{root}/.manifest.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as out:
        for r in manifest.orderBy("name").toLocalIterator():
            out.write((json.dumps(r.asDict()) + "\n").encode())
    store.move(temp, f"{root}/manifest.jsonl")
    return manifest


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """The records of an archive, from its committed manifest; every digest and file sum is checked.

    A file that is missing, cut off or changed is an error, not fewer rows. An empty
    manifest gives no rows.
    """
    files = spark.read.schema(MANIFEST).json(f"{folder}/manifest.jsonl") if manifest is None else manifest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        schema = pa.schema(list(zip(names, types)))
        for batch in batches:
            for f in batch.to_pylist():
                rows, total = [], hashlib.sha256()

                def chunks() -> Iterator[bytes]:
                    unpack = zlib.decompressobj(31)
                    with store.open_input_stream(f"{root}/{f['name']}", compression=None) as src:
                        while data := src.read(1 << 18):
                            total.update(data)
                            while data:
                                yield unpack.decompress(data)
                                data = unpack.unused_data
                                if unpack.eof:
                                    unpack = zlib.decompressobj(31)

                count = 0
                for head, block in parse(x for x in chunks() if x):
                    count += 1
                    if head["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"{f['name']}: a block does not have its digest")
                    n, own = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        n, own = len(body), digest(body)
                        if head["WARC-Payload-Digest"] != f"sha1:{own}":
                            raise ValueError(f"{f['name']}: a payload does not have its digest")
                    page, to = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
                    rows.append((None if page == NONE else int(page), n, own, head["WARC-Type"], None if to is None else int(to), head.get("WARC-Target-URI"), f["name"]))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], schema=schema)
                        rows = []
                if count != f["records"] or total.hexdigest() != f["sha256"]:
                    raise ValueError(f"{f['name']} is not the file of the manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], schema=schema)

    return files.repartition(max(partitions(spark), files.count())).mapInArrow(run, READ)  # dealt in turn: a file or two to a task
