"""Deterministic sharded WARC archives, and reading them back.

Records are sorted by key range: shard bounds come from a sample of rows chosen by a hash of the key and so
depend on the data alone; a key that fills several shards is spread over them by digest. A task sorts its
shards, writes one gzip member a record and starts a new file when a file has ``file_bytes`` compressed. Every
header, length and digest is made anew from the payload. A file is written under a temporary name and renamed
when it is whole; its content and name depend on the data alone, so a task that runs again, or twice at once,
leaves the same file. Archives count once the manifest, written last, lists them.

Among records with equal payloads of at least ``least_bytes``, the one with the largest key is a response; the
others are revisits that refer to it and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from weirgate.llm.common import stored

SHARD_BYTES = 16 << 20
FILE_BYTES = 4 << 20
SAMPLE = 20_000
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, sha256 string"


def _base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode()


def _clean(value: str) -> str:
    return "".join(c for c in value if c >= " ")


def _member(kind: str, pairs: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1\r\n" + _headers([("WARC-Type", kind), *pairs, ("WARC-Block-Digest", "sha1:" + _base32(block)), ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without time or name
    return packer.compress(head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def record(key: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit when it refers to another record."""
    digest = "sha1:" + _base32(payload)
    name = "none" if key is None else str(key)
    pairs = [
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url} {digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", digest),
        ("WARC-Source-Key", name),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    if refers_to is None:
        return _member("response", pairs, http + payload)
    pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Source-Key", str(refers_to))]
    return _member("revisit", pairs, http)


class _File:
    """An archive under a temporary name until it is closed."""

    def __init__(self, folder: str, name: str):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.store.create_dir(base, recursive=True)
        self.name, self.final, self.part = name, f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
        self.out, self.sha, self.bytes, self.records = self.store.open_output_stream(self.part, compression=None), hashlib.sha256(), 0, 0
        info = _headers([("software", "weirgate"), ("format", "WARC File Format 1.1")])
        ident = uuid.uuid5(uuid.NAMESPACE_URL, name)
        self._put(_member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def add(self, member: bytes) -> None:
        self._put(member)
        self.records += 1

    def close(self) -> tuple[str, int, int, str]:
        self.out.close()
        self.store.move(self.part, self.final)
        return self.name, self.records, self.bytes, self.sha.hexdigest()


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, shard, number, done = None, None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if file is not None and (row["shard"] != shard or file.bytes >= file_bytes):
                    done.append(file.close())
                    file = None
                if row["shard"] != shard:
                    shard, number = row["shard"], 0
                if file is None:
                    file = _File(folder, f"shard-{shard:06d}-{number:05d}.warc.gz")
                    number += 1
                file.add(record(row["key"], row["url"] or "", row["payload"] or b"", row["refers_to"]))
        if file is not None:
            done.append(file.close())
        columns = list(zip(*done)) if done else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "records", "bytes", "sha256"])

    return run


def shard_bounds(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """Keys between shards of about ``shard_bytes``, from a sample that depends on the data alone."""
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = -(-total // shard_bytes)
    if shards < 2:
        return np.zeros(0, dtype=np.int64)
    sample = rows.where("key is not null").select("key", "n").orderBy(F.xxhash64("key", "n"), "key", "n").limit(SAMPLE).toPandas().sort_values(["key", "n"])
    if not len(sample):
        return np.zeros(0, dtype=np.int64)
    filled = np.cumsum(sample["n"].to_numpy() + 1)
    at = np.searchsorted(filled, filled[-1] * np.arange(1, shards) / shards)
    return sample["key"].to_numpy()[np.minimum(at, len(sample) - 1)]


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write a record for each row below ``folder`` (a URI that all executors share) and return the manifest.

    A null html is an empty payload, a null URL an empty one. A row without a key is written with the key
    "none"; it is a revisit where a row with a key has its payload, else a response. Rows that repeat the
    largest key of a payload are all responses. Other columns are ignored. No rows give no files.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest")
    )
    light = stored(rows.select("key", "n", "digest"), "digests")
    bounds = shard_bounds(light, shard_bytes)
    last = stored(light.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "last")
    refers = F.when((F.col("key") < F.col("last")) | F.col("key").isNull(), F.col("last"))

    @F.pandas_udf(IntegerType())
    def shard_of(keys: pd.Series, spread: pd.Series) -> pd.Series:
        known = keys.fillna(-(1 << 62)).to_numpy().astype(np.int64)
        low, high = np.searchsorted(bounds, known, side="left"), np.searchsorted(bounds, known, side="right")
        return pd.Series((low + spread.to_numpy() % (high - low + 1)).astype(np.int32))

    placed = rows.join(last, ["digest", "n"], "left").select(
        shard_of("key", F.pmod(F.hash("digest"), F.lit(1 << 20))).alias("shard"), "key", "digest", "url", "payload", refers.alias("refers_to")
    )
    ordered = placed.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "key", "digest", "url")
    return stored(ordered.drop("digest").mapInArrow(_write(folder, file_bytes), MANIFEST), "manifest")


def _records(stream, size: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of a stream."""
    pending = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending:
                pending = stream.read(size)
                if not pending:
                    if parts:
                        raise ValueError("an archive ends inside a record")
                    return
            parts.append(unpack.decompress(pending))
            pending = unpack.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + _base32(block):
            raise ValueError(f"a record is damaged: {headers.get('WARC-Record-ID')}")
        yield headers, block


def _read(folder: str):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, found = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in _records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        found += 1
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        if response and (_base32(payload) != digest or len(payload) != length):
                            raise ValueError(f"a payload is damaged: {headers['WARC-Record-ID']}")
                        source, other = headers["WARC-Source-Key"], headers.get("WARC-Refers-To-Source-Key")
                        rows.append((None if source == "none" else int(source), headers["WARC-Target-URI"], length, digest, headers["WARC-Type"], None if other is None else int(other), payload if response else None))
                        size += len(block)
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if found != expected:
                    raise ValueError(f"{name} holds {found} records of {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that a manifest lists, one file at a time in each task; digests are checked."""
    files = manifest.count()
    spread = manifest.select("file", "records").repartition(max(1, files))
    return spread.mapInArrow(
        _read(folder), "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared scratch space, as a URI."""
    from weirgate.session import scratch_path

    path = scratch_path(spark, "archives")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
