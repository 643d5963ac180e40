"""WARC archives with a two-level capture index.

Writing: every task writes one archive of gzip members, one record per member, and returns where
each record lies. Of equal payloads of at least ``revisit_from`` bytes the one with the smallest id
is a response and the others are revisits that name it. The returned rows are stored by Spark's
committer, so the file of a task attempt that was lost is simply never referred to.

Index: captures are range-sorted by reversed-host URL key (and id, so that one host or URL may hold
any share of them). Each range becomes one index file of compressed blocks; its tail is a sparse
block directory (first key, offset and length of each block). Above it stands one row per file. A
lookup binary-searches the files' key ranges, then the file's directory, reads the blocks in
question by range, and then the records by range.

Everything is written below one folder that driver and executors share, through Arrow's file systems
(local, HDFS, S3 and GCS URIs).

Defined results: a null html is an empty payload; a null url or id is kept as such; repeated rows
are records of their own. Of equal payloads exactly one is the response: the one with the smallest
id (null comes last), and among rows with that id the first stored one; where all ids are null, the
revisits refer to null. Payloads of any length are one record. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.sources.shared import fresh_path, written

#: Copies from which a payload's digest is broadcast, so that no digest sends its pages to one task.
MANY, SHARE = 10_000, 512
CRLF = b"\r\n"
ENTRY = "key string, id long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Reversed host labels, then path and query: ``org,example,www)/a?b``; empty for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*(.*)", 1), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def _member(data: bytes, level: int = 5) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _header_value(value: str) -> bytes:
    return value.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "replace")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header alone."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=UTF-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id), b"WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _header_value(url))
    if revisit:
        lines += [b"WARC-Refers-To: <urn:page:%s>" % (b"none" if refers_to is None else b"%d" % refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def parse_record(data: bytes) -> dict:
    """Fields of one record; ``payload`` is None for revisits. A payload that doesn't match its digest is an error."""
    head, _, rest = data.partition(CRLF + CRLF)
    fields = dict(line.split(b": ", 1) for line in head.split(CRLF)[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(dict(line.split(b": ", 1) for line in http.split(CRLF)[1:])[b"Content-Length"])
    digest, kind = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"), fields[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda name: None if name not in fields or fields[name] == b"<urn:page:none>" else int(fields[name][10:-1])
    return {"id": number(b"WARC-Record-ID"), "url": fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None, "type": kind, "bytes": size, "digest": digest, "refers_to": number(b"WARC-Refers-To"), "payload": payload if kind == "response" else None}


def with_first_copies(hashed: DataFrame, revisit_from: int) -> DataFrame:
    """``hashed`` (id, url, payload, digest) with first (id of the response, for copied payloads) and revisit.

    Only ids and digests are aggregated. Digests with ``MANY`` copies or more, and more than one in
    ``SHARE`` of all copies, are broadcast to their pages; there are fewer than ``SHARE`` of them, whatever
    the size. Pages of the others meet them in groups.
    """
    long = hashed.where(F.octet_length("payload") >= revisit_from)
    by_id = long.groupBy("digest", "id").agg(F.count("*").alias("same"))
    tops = by_id.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "same")).alias("top"), F.sum("same").alias("n"))
    copied = written(tops.where("n > 1").select("digest", F.col("top.id").alias("first"), F.col("top.same").alias("firsts"), "n"), "warc-copies")
    bound = max(MANY, (copied.agg(F.sum("n")).first()[0] or 0) // SHARE + 1)
    common = F.broadcast(copied.where(F.col("n") >= bound))
    met = hashed.join(common, "digest", "left_anti").join(copied.where(F.col("n") < bound), "digest", "left").unionByName(hashed.join(common, "digest"))
    is_first = F.col("id").eqNullSafe(F.col("first")) & F.col("n").isNotNull()
    met = met.withColumns({"tied": is_first & (F.col("firsts") > 1), "revisit": F.col("n").isNotNull() & ~is_first})
    if copied.where("firsts > 1").isEmpty():
        return met
    # Rows that share the response's id: the first of them as stored is the response.
    tied = written(met.where("tied").withColumn("rid", F.monotonically_increasing_id()), "warc-tied")
    winners = tied.groupBy("digest").agg(F.min("rid").alias("rid"))
    return met.where("not tied").unionByName(tied.join(winners, "rid", "left_anti").withColumn("revisit", F.lit(True)).drop("rid")).unionByName(tied.join(winners.select("rid"), "rid", "left_semi").drop("rid"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 100) -> DataFrame:
    """Write archives below ``folder``; one stored row per record: key, id, file, offset, length."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    hashed = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marked = with_first_copies(hashed, revisit_from)
    records = marked.select(url_key(F.col("url")).alias("key"), "id", "url", "payload", "digest", F.coalesce("revisit", F.lit(False)).alias("revisit"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                offsets, lengths = [], []
                for row in batch.to_pylist():
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    data = _member(record_bytes(row["id"], row["url"], row["payload"], row["digest"], row["revisit"], row["refers_to"]))
                    out.write(data)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return written(records.mapInArrow(write, ENTRY), "warc-captures")


def build_index(captures: DataFrame, folder: str, files: int, block_entries: int = 1000) -> DataFrame:
    """Write index files below ``folder``; one stored row per file: first_key, last_key, index_file, tail_offset, tail_length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, at, out, held, tail, last = f"{uuid.uuid4().hex}.idx", 0, None, [], [], None

        def flush() -> None:
            nonlocal at, held, last
            data = zlib.compress("\n".join(json.dumps(e) for e in held).encode())
            out.write(data)
            tail.append([held[0][0], at, len(data)])
            at, last, held = at + len(data), held[-1][0], []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                held.append(row)
                if len(held) == block_entries:
                    flush()
        if out is not None:
            if held:
                flush()
            data = zlib.compress(json.dumps(tail).encode())
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pydict({"first_key": [tail[0][0]], "last_key": [last], "index_file": [name], "tail_offset": [at], "tail_length": [len(data)]})

    # Archive and offset divide what one key and id hold, be it a third of all captures.
    order = ["key", "id", "file", "offset"]
    ordered = captures.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(write, "first_key string, last_key string, index_file string, tail_offset long, tail_length long"), "warc-index")


def _range(store, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def blocks_for(directory: list, key: str) -> list:
    """The directory rows [first key, offset, length] whose blocks may hold ``key``."""
    first = lambda row: row[0]
    # A key equal to a block's first key may also end the block before it.
    return directory[max(0, bisect.bisect_left(directory, key, key=first) - 1) : bisect.bisect_right(directory, key, key=first)]


def files_for(firsts: list[str], lasts: list[str], key: str) -> range:
    """Which of the files, in order of their key ranges, may hold ``key``; neighbours may share a key."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def find_captures(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Captures (key, id, file, offset, length) of the ``wanted`` keys (column key).

    The index has one row a file, and there are as many files as were asked for when it was built;
    their key ranges go to every task, which finds a key's files by binary search. Keys are then dealt
    to tasks by ranges of (file, key), so that a block, found by binary search in its file's
    directory, is read by one task or by neighbours, and a file with many wanted keys by several.
    """
    spark = index.sparkSession
    files = [tuple(r) for r in index.select("first_key", "last_key", "index_file", "tail_offset", "tail_length").orderBy("first_key", "last_key").collect()]
    shared = spark.sparkContext.broadcast(files)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [f[0] for f in shared.value], [f[1] for f in shared.value]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            spans = [files_for(firsts, lasts, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, span in zip(keys, spans) for _ in span], pa.string()), pa.array([i for span in spans for i in span], pa.int32())], names=["key", "place"])

    routed = wanted.select("key").distinct().mapInArrow(route, "key string, place int")
    tasks = max(len(files), 2 * spark.sparkContext.defaultParallelism)
    work = routed.repartitionByRange(tasks, "place", "key").sortWithinPartitions("place", "key").select("place", "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            by_place: dict[int, list] = {}
            for place, key in zip(*(c.to_pylist() for c in batch.columns)):
                by_place.setdefault(place, []).append(key)
            for place, keys in by_place.items():
                name, tail_offset, tail_length = shared.value[place][2:]
                path, sought = f"{base}/{name}", set(keys)
                directory = json.loads(zlib.decompress(_range(store, path, tail_offset, tail_length)))
                blocks = {b[1]: b for k in keys for b in blocks_for(directory, k)}.values()
                for _, offset, length in blocks:
                    entries = [json.loads(x) for x in zlib.decompress(_range(store, path, offset, length)).split(b"\n")]
                    if entries := [e for e in entries if e[0] in sought]:
                        yield pa.RecordBatch.from_pydict(dict(zip(("key", "id", "file", "offset", "length"), map(list, zip(*entries)))), schema=pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return work.mapInArrow(read, ENTRY)


def read_records(captures: DataFrame, folder: str, with_payload: bool = False, slices: int = 64, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """Records of captures: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload.

    Captures are brought together by archive and slice and read in offset order; neighbours less
    than ``gap`` bytes apart share one range read of up to ``most`` bytes.
    """
    names = ["id", "url", "type", "bytes", "digest", "refers_to"] + ["payload"] * with_payload
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    fields = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)

        def load(run: list) -> pa.RecordBatch:
            start = run[0][1]
            data = _range(store, f"{base}/{run[0][0]}", start, run[-1][1] + run[-1][2] - start)
            found = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in run]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in zip(names, types)], names=fields)

        run: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if run and (row[0] != run[0][0] or row[1] - run[-1][1] - run[-1][2] > gap or row[1] + row[2] - run[0][1] > most):
                    yield load(run)
                    run = []
                run.append(row)
        if run:
            yield load(run)

    placed = captures.select("file", "offset", "length")
    return placed.repartition(slices, "file", F.floor(F.col("offset") / F.lit(1 << 25))).sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", files: int | None = None) -> DataFrame:
    """Write all pages as WARC archives, index them, and look every page's URL key up in the index to read its records back."""
    spark: SparkSession = pages.sparkSession
    archives, indexes = fresh_path(spark, "warc-archives"), fresh_path(spark, "warc-index-files")
    captures = write_archives(pages, archives, id_col, url_col, html_col)
    index = build_index(captures, indexes, files or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_records(find_captures(index, indexes, pages.select(url_key(F.col(url_col)).alias("key"))), archives)
