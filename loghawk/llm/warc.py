"""WARC archives: a deterministic sharded writer with a manifest, and its reader.

Writing, in order:

1. One pass over the payloads keeps (page_id, digest, bytes). Of records with equal
   payloads the smallest page_id is the response; the others will be revisits. A digest
   that holds over a thousandth of all rows (at most a thousand such digests) is joined by
   broadcast, all others by shuffle, so that no task gets the copies of a common payload.
2. The slim rows are range-sorted by (page_id, digest) and their bytes summed up in that
   order. A shard begins every ``shard_bytes``; shards follow from the rows alone, not from
   partitions or samples. The driver holds one bound a shard.
3. Pages and revisit decisions go to their shard in one shuffle and are sorted there; a
   decision comes just before its page. A task writes its shard as a stream: one gzip member
   a record, headers and digests made anew, a new file once the compressed size reaches
   ``file_bytes``. Files get temporary names; a second attempt of a task writes others.
4. The names that finished tasks report are renamed to ``shard-SSSSS-FFF.warc.gz``; last, the
   manifest appears by one rename. Readers trust the manifest alone; an archive without
   one isn't there yet, and files of lost attempts are removed with their folder.

The same rows and parameters give the same files, byte for byte, in any number of partitions.
Workers open files through ``pyarrow.fs`` (local and mounted folders, HDFS, S3, GCS).

Edge cases: a null payload is empty; null ids come last; a null url gives no target field;
control characters and spaces of a url are percent-encoded; of rows with one id and payload the
first in order of url is the response, if any; extra columns are ignored; an empty table gives a
manifest without files. A record that doesn't match its digests or lengths is an error on reading.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk.session import scratch_path

VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHARD_BYTES, FILE_BYTES, LEVEL = 64 << 20, 16 << 20, 6
#: Bytes of a record beside its payload, for the balance of shards only.
RECORD_BYTES = 600
#: A digest with more than 1 / HOT_SHARE of all rows is joined by broadcast: fewer than HOT_SHARE digests.
HOT_SHARE = 1000
CHUNK = 1 << 20

MANIFEST = ("shard int, name string, temporary string, records long, responses long, bytes long, sha256 string, "
            "first_page long, last_page long")


def _order() -> list:
    return [F.col("page_id").isNull(), F.col("page_id"), F.col("digest")]


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(kind: str, page_id, digest: bytes, nth: int) -> str:
    key = hashlib.sha256(f"{kind} {page_id} {digest.hex()} {nth}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=key[:16])}>"


_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def safe_url(url: str) -> str:
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


def header(fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


class _File:
    """One archive file, written as a stream under a temporary name."""

    def __init__(self, fs, folder: str, name: str, level: int):
        self.name, self.level, self.temporary = name, level, f"{name}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(f"{folder}/{self.temporary}")
        self.bytes = self.records = self.responses = 0
        self.sum, self.first, self.last = hashlib.sha256(), None, None
        body = b"software: loghawk\r\nformat: WARC File Format 1.1\r\n"
        self._member(header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name, b"", 0)),
                             ("WARC-Date", DATE), ("WARC-Filename", name),
                             ("Content-Type", "application/warc-fields")], len(body)), body)

    def _member(self, *parts: bytes) -> None:
        gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        for part in (*parts, b"\r\n\r\n"):
            for at in range(0, len(part), CHUNK):
                self._write(gz.compress(part[at:at + CHUNK]))
        self._write(gz.flush())

    def _write(self, raw: bytes) -> None:
        if raw:
            self.out.write(raw)
            self.sum.update(raw)
            self.bytes += len(raw)

    def add(self, page_id, url, payload: bytes, nth: int, revisit: bool, refers_to) -> None:
        digest, head = hashlib.sha1(payload).digest(), http_head(len(payload))
        block = hashlib.sha1(head)
        if not revisit:
            block.update(payload)
        kind = "revisit" if revisit else "response"
        fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page_id, digest, nth)), ("WARC-Date", DATE),
                  ("WARC-Target-URI", None if url is None else safe_url(url)),
                  ("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("WARC-Block-Digest", f"sha1:{base32(block.digest())}"),
                  ("Content-Type", "application/http;msgtype=response"),
                  ("X-Page-ID", None if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
        if revisit:
            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", refers_to, digest, 0)),
                       ("X-Refers-To-Page-ID", None if refers_to is None else str(refers_to))]
            self._member(header(fields, len(head)), head)
        else:
            self._member(header(fields, len(head) + len(payload)), head, payload)
        self.first = page_id if self.records == 0 else self.first
        self.last, self.records, self.responses = page_id, self.records + 1, self.responses + (not revisit)

    def close(self, shard: int) -> tuple:
        self.out.close()
        return (shard, self.name, self.temporary, self.records, self.responses, self.bytes, self.sum.hexdigest(),
                self.first, self.last)


def _write_shards(batches, folder: str, file_bytes: int, level: int):
    """Rows of one or more shards in order -> manifest rows."""
    fs, path = open_fs(folder)
    now, shard, seq, done = None, None, 0, []
    key, revisit, first, nth = None, False, None, 0
    for batch in batches:
        for at, page_id, digest, is_page, refers_to, url, html in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (page_id, digest):
                key, revisit, first, nth = (page_id, digest), False, None, 0
            if not is_page:  # the decision on the rows that follow
                revisit, first = True, refers_to
                continue
            if now is not None and (at != shard or now.bytes >= file_bytes):
                done.append(now.close(shard))
                now = None
            if at != shard:
                shard, seq = at, 0
            if now is None:
                now = _File(fs, path, f"shard-{shard:05d}-{seq:03d}.warc.gz", level)
                seq += 1
            again = revisit and not (first == page_id and nth == 0)
            now.add(page_id, url, (html or "").encode(), nth, again, first if again else None)
            nth += 1
    if now is not None:
        done.append(now.close(shard))
    yield _batch(done, MANIFEST)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[kind]) for k, kind in enumerate(kinds)],
                                      names=names)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shard_starts(keys: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (is null, page_id, digest) of each shard, ascending."""
    def running(batches):
        from pyspark import TaskContext
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, before = [], total
            for size in batch.column("bytes").to_pylist():
                out.append(total)
                total += size + RECORD_BYTES
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("digest"), pa.array([part] * len(out), pa.int32()),
                 pa.array(out, pa.int64()), pa.array([total - before] + [0] * (len(out) - 1) if out else [], pa.int64())],
                names=["page_id", "digest", "part", "before", "added"])

    ranged = _stored(keys.repartitionByRange(*_order()).sortWithinPartitions(*_order()).mapInArrow(
        running, "page_id long, digest binary, part int, before long, added long"), "warc-order")
    total, start = 0, {}
    for row in ranged.groupBy("part").agg(F.sum("added").alias("added")).orderBy("part").collect():  # one row a partition
        start[row["part"]], total = total, total + row["added"]
    if not start:
        return []
    offsets = keys.sparkSession.createDataFrame(list(start.items()), "part int, offset long")
    shard = F.floor((F.col("offset") + F.col("before")) / F.lit(shard_bytes))
    firsts = ranged.join(F.broadcast(offsets), "part").groupBy(shard.alias("shard")).agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.hex("digest").alias("digest"))).alias("at"))
    return [(r["at"]["none"], r["at"]["page_id"] or 0, r["at"]["digest"]) for r in firsts.orderBy("shard").collect()]


def _revisits(keys: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of all rows whose payload occurs more than once."""
    rows = keys.where(F.col("bytes") >= least)
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = F.col("n") * HOT_SHARE > keys.count()
    hot_groups = F.broadcast(groups.where(hot).drop("n"))
    cold = rows.join(hot_groups.select("digest"), "digest", "left_anti").join(groups.where(~hot).drop("n"), "digest")
    return rows.join(hot_groups, "digest").unionByName(cold).select("page_id", "digest", "refers_to")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write an archive into a folder that has none yet; returns its manifest.

    Equal payloads of at least ``least`` bytes are stored once.
    """
    spark = pages.sparkSession
    if _exists(spark, f"{folder}/manifest"):
        raise ValueError(f"{folder} already holds an archive")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    digest = F.unhex(F.sha1(payload.cast("binary"))).alias("digest")
    page_id = F.col(id_col).cast("long").alias("page_id")
    keys = _stored(pages.select(page_id, digest, F.octet_length(payload).cast("long").alias("bytes")), "warc-keys")
    starts = _shard_starts(keys, shard_bytes)
    shard_of = _shard_of(starts)
    none = lambda kind: F.lit(None).cast(kind)
    at = shard_of(F.col("page_id"), F.col("digest")).alias("shard")
    decided = _revisits(keys, least).select(at, "page_id", "digest", F.lit(False).alias("is_page"), "refers_to",
                                            none("string").alias("url"), none("string").alias("html"))
    rows = pages.select(page_id, digest, F.col(url_col).alias("url"), F.col(payload_col).alias("html")).select(
        at, "page_id", "digest", F.lit(True).alias("is_page"), none("long").alias("refers_to"), "url", "html")
    attempt = f"{folder}/_attempt-{uuid.uuid4().hex}"
    _mkdirs(spark, f"{attempt}/data")
    written = rows.unionByName(decided).repartitionById(max(1, len(starts)), F.col("shard")) \
        .sortWithinPartitions("shard", *_order(), "is_page", F.asc_nulls_last("url")) \
        .mapInArrow(lambda batches: _write_shards(batches, f"{attempt}/data", file_bytes, level), MANIFEST)
    written.write.parquet(f"{attempt}/manifest")
    return _commit(spark, attempt, folder)


def _shard_of(starts: list[tuple]):
    def find(page_ids: pa.Array, digests: pa.Array) -> pa.Array:
        return pa.array([max(0, bisect.bisect_right(starts, (i is None, i or 0, d.hex().upper())) - 1)
                         for i, d in zip(page_ids.to_pylist(), digests.to_pylist())], pa.int32())

    return F.arrow_udf(find, "int")


def _commit(spark: SparkSession, attempt: str, folder: str) -> DataFrame:
    """Final names for the files that the finished tasks report, then the manifest by one rename."""
    def rename(batches):
        fs, path = open_fs(folder)
        _, temporary = open_fs(f"{attempt}/data")
        for batch in batches:
            for old, new in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                old = f"{temporary}/{old}"
                if fs.get_file_info(old).type != arrow_fs.FileType.NotFound:  # else an earlier try has done it
                    fs.move(old, f"{path}/{new}")
            yield _batch([], "name string")

    files = spark.read.schema(MANIFEST).parquet(f"{attempt}/manifest")
    files.select("temporary", "name").mapInArrow(rename, "name string").count()
    _rename(spark, f"{attempt}/manifest", f"{folder}/manifest")
    _delete(spark, attempt)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file of a committed archive."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").drop("temporary")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _mkdirs(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    p, fs = _path(spark, old)
    if fs.exists(_path(spark, new)[0]) or not fs.rename(p, _path(spark, new)[0]):
        raise ValueError(f"can't commit {new}: another writer has done so")


RECORD = ("page_id long, url string, record_type string, record_id string, refers_to_record string, refers_to long, "
          "payload_bytes long, payload_digest string, payload binary")


def records(stream, keep_payload: bool):
    """(fields, payload or None) of every record but warcinfo; checks lengths and digests."""
    body = gzip.GzipFile(fileobj=stream)
    while line := body.readline():
        if line.rstrip() != VERSION:
            raise ValueError("not a record's first line")
        fields = {}
        while (line := body.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        left, block, payload, kept = int(fields["Content-Length"]), hashlib.sha1(), hashlib.sha1(), []
        kind, size = fields["WARC-Type"], 0
        if kind != "warcinfo":
            while True:  # the HTTP head
                line = body.readline()
                block.update(line)
                left -= len(line)
                if line in (b"\r\n", b""):
                    break
        while left > 0:
            raw = body.read(min(left, CHUNK))
            if not raw:
                raise ValueError("a record ends early")
            left, size = left - len(raw), size + len(raw)
            block.update(raw)
            payload.update(raw)
            if keep_payload:
                kept.append(raw)
        if left or body.read(4) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        if kind == "warcinfo":
            continue
        if fields["WARC-Block-Digest"] != f"sha1:{base32(block.digest())}" or kind == "response" and (
                fields["WARC-Payload-Digest"] != f"sha1:{base32(payload.digest())}" or size != int(fields["X-Payload-Length"])):
            raise ValueError(f"a record doesn't match its digests: {fields['WARC-Record-ID']}")
        yield fields, b"".join(kept) if kind == "response" and keep_payload else None


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of a committed archive, read as streams, one task a shard; without payloads if not asked for."""
    def run(batches):
        fs, path = open_fs(folder)
        as_int = lambda v: None if v is None else int(v)
        out, held = [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None, buffer_size=CHUNK) as stream:
                    for f, body in records(stream, payload):
                        out.append((as_int(f.get("X-Page-ID")), f.get("WARC-Target-URI"), f["WARC-Type"], f["WARC-Record-ID"],
                                    f.get("WARC-Refers-To"), as_int(f.get("X-Refers-To-Page-ID")), int(f["X-Payload-Length"]),
                                    f["WARC-Payload-Digest"].removeprefix("sha1:"), body))
                        held += 500 + len(body or b"")
                        if held > 4 * CHUNK:
                            yield _batch(out, RECORD)
                            out, held = [], 0
        yield _batch(out, RECORD)

    files = manifest(spark, folder)
    shards = files.agg(F.max("shard")).first()[0]
    ordered = files.select("shard", "name").repartitionById((shards or 0) + 1, F.col("shard")).sortWithinPartitions("name")
    return ordered.mapInArrow(run, RECORD)
