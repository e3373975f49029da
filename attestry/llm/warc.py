"""Deterministic sharded WARC writer, and a reader that checks digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .common import running_total, small_batches
from .files import Committed, opened

#: Record ids are name-based UUIDs in this space, so that they are the same in every run.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shards at most (their first keys, under 100 bytes each, are sent to every task), groups of copies that are broadcast,
#: and bytes that a record takes besides its payload.
SHARDS, BROADCAST_GROUPS, HEAD_BYTES = 1 << 18, 100_000, 600
LAST = (1 << 63) - 1


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int, site: str, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{site}:{digest}:{copy}')}>"


def _one_line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as one gzip member without a time stamp."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int, url: str | None, site: str, payload: bytes, digest: str, first: tuple[int, str] | None, copy: int, date: str, level: int) -> bytes:
    """The response record of a page, or the revisit record of the first one, (page_id, MD5 of the URL)."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if first is None else b""
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Target-URI", _one_line(url) if url else f"urn:page:{page_id}"), ("WARC-Date", date), ("WARC-Record-ID", record_id(page_id, site, digest, copy)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("WARC-Payload-Digest", "sha1:" + digest), ("X-Page-ID", str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if first is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(*first, digest, 0)), ("X-Refers-To-Page", str(first[0]))]
    return record(fields, block, level)


def _key(p: str, *rest: str) -> Column:
    """Text that sorts as (p, rest) do; p is a long."""
    return F.concat(F.lpad(F.hex(F.col(p).bitwiseXOR(F.lit(-1 << 63))), 16, "0"), *rest)


def _shards(keys: DataFrame, shard_bytes: int) -> Column:
    """The shard of a row's key: consecutive ranges of ``shard_bytes`` in the order of keys, the same in every run.

    A range begins with the first row that starts in it, so a shard has less than shard_bytes and a row more.
    Beyond SHARDS shards these grow.
    """
    keys = keys.groupBy("key").agg(F.sum("n").alias("n"))
    keys = running_total(keys, ["key"], F.col("n"), "upto")
    total = _size(keys)
    each = max(shard_bytes, -(-total // SHARDS))
    firsts = keys.groupBy(F.floor((F.col("upto") - F.col("n")) / each).alias("i")).agg(F.min("key").alias("key"))
    sent = keys.sparkSession.sparkContext.broadcast(sorted(r.key for r in firsts.select("key").toLocalIterator())[1:])

    @F.pandas_udf("int")
    def shard(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in keys:
            yield pd.Series([bisect_right(sent.value, k) for k in batch], dtype="int32")

    return shard("key")


def _size(keys: DataFrame) -> int:
    return keys.agg(F.sum("n")).first()[0] or 0


def write_archives(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = 16 << 20, roll_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into folder; returns the manifest.

    The payload is html in UTF-8 (null: empty). Of equal payloads of ``least`` bytes or more the one with
    the smallest page_id (then the least digest of the URL) becomes a response and the others revisits of
    it, also where it is a repeated row. Rows are range-sorted by page_id, digest and URL: shards are
    ranges of ``shard_bytes`` of records before compression whose bounds depend on the data only, so rows
    of one page_id, or of none, are split as well unless they are wholly equal. Each shard's file is
    rolled once it has ``roll_bytes`` compressed bytes. Headers and digests are made anew. Files
    appear under their names when whole, and manifest.json, written last, lists all of them with their
    records, bytes and SHA-256. Running again gives the same bytes. A null page_id comes last, as 2^63 - 1.

    Returns shard, file, records, bytes, sha256.
    """
    spark = pages.sparkSession
    small_batches(spark, 256)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.coalesce("page_id", F.lit(LAST)).cast("long").alias("p"), "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    rows = rows.withColumn("site", F.md5(F.coalesce("url", F.lit("")))).withColumn("key", _key("p", "sha1", "site"))
    keys = written(rows.select("key", "p", "sha1", "site", (F.octet_length("payload") + HEAD_BYTES).cast("long").alias("n")), "pages")
    copies = keys.filter(F.col("n") >= least + HEAD_BYTES).groupBy("sha1").agg(F.min(F.struct("p", "site")).alias("first"), F.count("*").alias("k")).filter("k > 1")
    copies = written(copies.select("sha1", F.col("first.p").alias("first"), F.col("first.site").alias("first_site")), "copies")
    rows = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_GROUPS else copies, "sha1", "left").withColumn("shard", _shards(keys.select("key", "n"), shard_bytes))
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        at, roll, out, before, copy = None, 0, None, None, 0

        def closed() -> pa.RecordBatch:
            out["file"].commit()
            return pa.RecordBatch.from_pylist([{"shard": at, "file": out["name"], "records": out["records"], "bytes": out["bytes"], "sha256": out["sha256"].hexdigest()}], schema=schema)

        def put(data: bytes) -> None:
            out["file"].write(data)
            out["sha256"].update(data)
            out["bytes"] += len(data)

        for batch in batches:
            for r in batch.to_pylist():
                if out and (r["shard"] != at or out["bytes"] >= roll_bytes):
                    yield closed()
                    out = None
                if r["shard"] != at:
                    at, roll = r["shard"], 0
                if out is None:
                    name = f"part-{at:06d}-{roll:05d}.warc.gz"
                    roll, out = roll + 1, {"name": name, "file": Committed(store, path, name), "records": 0, "bytes": 0, "sha256": hashlib.sha256()}
                    put(record([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                copy = copy + 1 if before == r["key"] else 0
                before = r["key"]
                first = (r["first"], r["first_site"]) if r["first"] is not None and ((r["first"], r["first_site"]) != (r["p"], r["site"]) or copy) else None
                put(page_record(r["p"], r["url"], r["site"], r["payload"], base32(bytes.fromhex(r["sha1"])), first, copy, date, level))
                out["records"] += 1
        if out:
            yield closed()

    n = min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), _size(keys) // shard_bytes + 1))
    ordered = rows.repartitionByRange(n, "shard").sortWithinPartitions("shard", "key")
    manifest = written(ordered.select("shard", "key", "p", "url", "site", "payload", "sha1", "first", "first_site").mapInArrow(write, "shard int, file string, records long, bytes long, sha256 string"), "manifest")
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    whole = Committed(store, path, "manifest.json")
    for r in manifest.orderBy("file").toLocalIterator():
        whole.write((json.dumps(r.asDict()) + "\n").encode())
    whole.commit()
    store.delete_dir(f"{path}/_temporary")
    return manifest


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an open .warc.gz stream."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as f:
        while line := f.readline():
            if line == b"\r\n":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().partition(":")
                fields[k.strip().lower()] = v.strip()
            block = f.read(int(fields["content-length"]))
            if (want := fields.get("warc-block-digest")) and want != "sha1:" + base32(hashlib.sha1(block).digest()):
                raise ValueError(f"block of {fields['warc-record-id']} does not have its digest")
            yield fields, block


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The pages of all archives that the folder's manifest lists, with digests checked.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload (null for
    revisits) if asked for.
    """
    if manifest is None:
        store, path = opened(folder)
        with store.open_input_stream(f"{path}/manifest.json", compression=None) as f:
            files = [json.loads(x)["file"] for x in f.read().splitlines()]
        manifest = spark.createDataFrame([(x,) for x in files], "file string")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if payloads else [])
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out: list[dict] = []
                size = 0
                with store.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as f:
                    for h, block in records(f):
                        if "x-page-id" not in h:
                            continue
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if h["warc-type"] == "response" else None
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and digest != base32(hashlib.sha1(payload).digest()):
                            raise ValueError(f"payload of {h['warc-record-id']} does not have its digest")
                        refers = h.get("x-refers-to-page")
                        out.append({"page_id": int(h["x-page-id"]), "url": h["warc-target-uri"], "payload_bytes": int(h["x-payload-length"]), "payload_digest": digest, "record_type": h["warc-type"], "refers_to": int(refers) if refers else None} | ({"payload": payload} if payloads else {}))
                        size += len(block) if payloads else 200
                        if len(out) >= 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spec = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    return manifest.select("file").repartition(n, "file").mapInArrow(read, spec)
