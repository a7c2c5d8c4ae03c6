"""WARC archives with a two-level capture index.

Records are range-partitioned by their reversed-host URL keys and written in that order, each a gzip member. Beside its
archive every task writes its part of the index: sorted lines of key, page and place, in compressed blocks of BLOCK
lines. A sparse directory, one row for each block, holds the first and last key and the place of the block; it is a
sorted Parquet table of small row groups. A lookup deals the keys by range, so that a task reads only the row groups of
the directory that its keys fall into, binary-searches these, reads the block, binary-searches that, and then reads the
range of each record.

Of records with equal payloads the one with the largest page_id is a response and the others revisit it. Digests alone
are grouped; what they tell is sorted in front of the payloads, which are shuffled once, by key.

The files lie in the shared folder and are reached through pyarrow's file systems, so any executor reads them. Their
names hold the task's attempt, and only the directory rows of tasks that succeed are kept, so lost executors and
repeated attempts leave no wrong rows.

Defined cases: a null html is an empty payload; a null url has the key "-"; repeated page_ids are written each, and
equal payloads of one page_id are told apart by order: the first is the response; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._shared import scratch_path, small_batches, written

#: Lines of an index block.
BLOCK = 512
#: Records of about so many bytes are read at once where they lie side by side.
RANGE = 1 << 22
#: Bytes of a row group of the directory.
GROUP_BYTES = 1 << 18
LEVEL = 3
_DIRECTORY = "first string, first_page long, last string, last_page long, path string, offset long, length long, n long"


def surt(url: str | None) -> str:
    """A URL with its host's labels reversed, lower-cased, without scheme, www and default port."""
    if not url:
        return "-"
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)(?::([0-9]*))?([^#]*)", url)
    if not m:
        return url
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (m[3] or "/")


def _record(kind: str, url: str, page: int | None, payload: bytes, digest: str, of: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>", f"WARC-Target-URI: {url}", f"X-Page-ID: {page}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{of}')}>", f"X-Refers-To-Page: {of}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict[str, str | bytes | int | None]:
    """The named fields of a record, its payload (None for a revisit) and the payload's size."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields | {"payload": payload if fields["WARC-Type"] == "response" else None, "size": size}


def _flags(rows: DataFrame) -> DataFrame:
    """url, page_id, digest of rows, with response (whether it has the payload) and of (the page that it revisits else).

    Of equal payloads the row with the largest page_id, and of its rows that with the smallest url, is the response."""
    known = rows.select("url", "page_id", F.sha1("payload").alias("digest")).distinct()
    first = known.groupBy("digest", "page_id").agg(F.min("url").alias("url"))
    best = first.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"))
    out = known.join(best, "digest")
    response = F.col("page_id").eqNullSafe(F.col("best.page_id")) & (F.col("url") == F.col("best.url"))
    return out.select("url", "page_id", "digest", response.alias("response"), F.col("best.page_id").alias("of"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns the directory of the index."""
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    key = F.udf(surt, "string", useArrow=True)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    # what is known of a record sorts before its payload, so one shuffle brings both to where they are written
    known = _flags(rows).select("url", "page_id", "digest", "response", "of", F.lit(None).cast("binary").alias("payload"))
    bodies = rows.select("url", "page_id", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("boolean").alias("response"), F.lit(None).cast("long").alias("of"), "payload")
    both = known.unionByName(bodies).withColumn("key", key("url"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = both.repartitionByRange(n, F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id", F.col("payload").isNotNull())

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name = f"{root}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        archive = index = None
        at = written_index = 0
        lines: list[tuple[str, int | None, str]] = []
        here, told = None, {}  # of the current key and page: what is known by url and digest
        rows_out: list[tuple] = []

        def close_block() -> None:
            nonlocal written_index
            data = gzip.compress("\n".join(x for _, _, x in lines).encode(), LEVEL, mtime=0)
            index.write(data)
            rows_out.append((lines[0][0], lines[0][1], lines[-1][0], lines[-1][1], f"{name}.idx.gz", written_index, len(data), len(lines)))
            written_index += len(data)
            lines.clear()

        for rows in it:
            if archive is None and len(rows):
                archive, index = (where.open_output_stream(f"{name}{end}", compression=None) for end in (".warc.gz", ".idx.gz"))
            for row in rows.to_pylist():
                if (row["key"], row["page_id"]) != here:
                    here, told = (row["key"], row["page_id"]), {}
                if row["payload"] is None:
                    told[row["url"], row["digest"]] = row["response"], row["of"]
                    continue
                payload = bytes(row["payload"])
                sha1 = hashlib.sha1(payload)
                response, of = told[row["url"], sha1.hexdigest()]
                told[row["url"], sha1.hexdigest()] = False, of  # a repeated row revisits
                url = row["url"].replace("\r", "%0D").replace("\n", "%0A")
                digest = base64.b32encode(sha1.digest()).decode()
                data = gzip.compress(_record("response" if response else "revisit", url, row["page_id"], payload, digest, of), LEVEL, mtime=0)
                archive.write(data)
                place = json.dumps({"key": row["key"], "page": row["page_id"], "file": f"{name}.warc.gz", "offset": at, "length": len(data)})
                lines.append((row["key"], row["page_id"], place))
                at += len(data)
                if len(lines) == BLOCK:
                    close_block()
        if lines:
            close_block()
        if archive is not None:
            archive.close()
            index.close()
        columns = list(zip(*rows_out, strict=True)) or [()] * 8
        names = [f.split()[0] for f in _DIRECTORY.split(", ")]
        kinds = [pa.string() if "string" in f else pa.int64() for f in _DIRECTORY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    made = ordered.mapInArrow(emit, _DIRECTORY)
    return written(made, "directory").withColumn("folder", F.lit(folder))


def _sparse(spark: SparkSession, directory: DataFrame) -> str:
    """The directory as one sorted Parquet table in the shared folder, in row groups of GROUP_BYTES: a row for each BLOCK records."""
    path = scratch_path(spark, "sparse")
    directory.orderBy("first", "first_page").write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return path


def lookup(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the wanted (url, page_id): key, page_id, record (its bytes). What is not in the index has no row."""
    spark = directory.sparkSession
    path = _sparse(spark, directory)
    key = F.udf(surt, "string", useArrow=True)

    def to_block(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        where, root = fs.FileSystem.from_uri(path)
        sparse_files = ds.dataset(sorted(f.path for f in where.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")), filesystem=where)
        page = lambda p: -1 if p is None else p
        for rows in it:
            if not len(rows):
                continue
            reached = (ds.field("last") >= rows.column("key")[0].as_py()) & (ds.field("first") <= rows.column("key")[len(rows) - 1].as_py())
            sparse = sparse_files.to_table(filter=reached, columns=["first", "first_page", "last", "last_page", "path", "offset", "length"])
            firsts, lasts = (list(zip(sparse.column(c).to_pylist(), map(page, sparse.column(f"{c}_page").to_pylist()), strict=True)) for c in ("first", "last"))
            asked = list(zip(rows.column("key").to_pylist(), map(page, rows.column("page_id").to_pylist()), strict=True))
            at = []  # repeated keys may lie across blocks
            for i, k in enumerate(asked):
                first, last = max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)
                at += [(i, b) for b in range(first, last) if lasts[b] >= k]
            taken = sparse.take(pa.array([b for _, b in at], pa.int64()))
            got = rows.take(pa.array([i for i, _ in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column("key"), got.column("page_id"), *(taken.column(c).combine_chunks() for c in ("path", "offset", "length"))], names=["key", "page_id", "path", "offset", "length"])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        block = keys = places = None
        archive = archive_name = None
        for rows in it:
            out_key, out_page, out_record, held = [], [], [], 0
            for row in rows.to_pylist():
                if (row["path"], row["offset"]) != block:
                    block = (row["path"], row["offset"])
                    with where.open_input_file(row["path"]) as f:
                        f.seek(row["offset"])
                        places = [json.loads(x) for x in gzip.decompress(f.read(row["length"])).decode().split("\n")]
                    keys = [(p["key"], -1 if p["page"] is None else p["page"]) for p in places]
                asked = (row["key"], -1 if row["page_id"] is None else row["page_id"])
                for i in range(bisect.bisect_left(keys, asked), bisect.bisect_right(keys, asked)):
                    p = places[i]
                    if p["file"] != archive_name:
                        if archive is not None:
                            archive.close()
                        archive, archive_name = where.open_input_file(p["file"]), p["file"]
                    archive.seek(p["offset"])
                    out_key.append(row["key"])
                    out_page.append(row["page_id"])
                    out_record.append(zlib.decompress(archive.read(p["length"]), 31))
                    held += len(out_record[-1])
                    if held > RANGE:
                        yield pa.RecordBatch.from_pydict({"key": pa.array(out_key, pa.string()), "page_id": pa.array(out_page, pa.int64()), "record": pa.array(out_record, pa.binary())})
                        out_key, out_page, out_record, held = [], [], [], 0
            yield pa.RecordBatch.from_pydict({"key": pa.array(out_key, pa.string()), "page_id": pa.array(out_page, pa.int64()), "record": pa.array(out_record, pa.binary())})

    asked = wanted.select(F.col("url").cast("string"), F.col("page_id").cast("long")).withColumn("key", key("url")).select("key", "page_id").distinct()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = asked.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    placed = ranged.mapInArrow(to_block, "key string, page_id long, path string, offset long, length long")
    return placed.repartition("path", "offset").sortWithinPartitions("path", "offset", "key", "page_id").mapInArrow(read, "key string, page_id long, record binary")


def digest(pages: DataFrame) -> DataFrame:
    """Writes all pages, looks all of them up, and tells of each record: payload_bytes, payload_digest, record_type, refers_to."""
    records = lookup(write(pages), pages)

    def fields(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            found = [parse(r) for r in rows.column("record").to_pylist()]
            sums = [base64.b32encode(hashlib.sha1(f["payload"]).digest()).decode() if f["payload"] is not None else f["WARC-Payload-Digest"].removeprefix("sha1:") for f in found]
            of = [int(f["X-Refers-To-Page"]) if f.get("X-Refers-To-Page", "None") != "None" else None for f in found]
            yield pa.RecordBatch.from_pydict({
                "page_id": rows.column("page_id"),
                "payload_bytes": pa.array([len(f["payload"]) if f["payload"] is not None else f["size"] for f in found], pa.int64()),
                "payload_digest": pa.array(sums, pa.string()),
                "record_type": pa.array([f["WARC-Type"] for f in found], pa.string()),
                "refers_to": pa.array(of, pa.int64()),
            })

    return records.mapInArrow(fields, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
