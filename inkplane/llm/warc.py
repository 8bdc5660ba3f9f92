"""Deterministic sharded WARC archives: writer and reader (operator 9).

Writer. Rows get a shard from a histogram of their keys, so shards are ranges of
keys of about ``shard_bytes``, the same whatever the partitions. A cell of the histogram
that holds more than a shard and more than a thousandth of all is cut anew, between its
own first and last key, until it does not or has one key only; so keys far off, however
many, leave the shards of the others as they are. What then holds several shards is cut
evenly by key. A task sorts its shards by key, writes one gzip member for each record and starts a new file once
``roll_bytes`` compressed bytes are reached. Headers, ids and digests are made anew
from the row. A file is written under a temporary name and renamed when it is
whole; the manifest, written last, lists the files that count. A task that runs
again after an executor was lost writes the same bytes under the same names.

Of records with equal payloads of ``min_bytes`` or more, the one of the largest key
is the response, the others revisit it. Null payloads count as empty. Rows without
key are responses, since nothing could name them; of rows that repeat key and
payload, one is the response and the others revisit it. Null targets are named by
the key. An empty table gives an archive without files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkplane.llm.common import crowded, cut, fresh_path

SHARD_BYTES, ROLL_BYTES, CELLS = 4 << 20, 2 << 20, 1 << 14
#: Shares of all bytes above which a cell is crowded (so that there are no more crowded ones than that), and the parts it is cut into.
SHARES, PARTS = 1024, 64
#: What a record costs besides its payload, when shards are filled.
HEADER_BYTES = 512
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record_id(key: int | None, digest: str, copy: int) -> str:
    name = f"urn:page:{key}" if key is not None else f"urn:page:none:{digest}"
    return f"<{name}:{copy}>" if copy else f"<{name}>"


def _clean(target: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in target)


def record(key: int | None, target: str | None, payload: bytes, digest: str, copy: int, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(target) if target else f'urn:page:{key}'}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roll:
    """The files of one shard, in order."""

    def __init__(self, root: str, shard: int, limit: int):
        self.files, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.limit, self.number = shard, limit, 0
        self.out, self.temporary, self.entry = None, "", None

    def add(self, data: bytes, key: int | None) -> Iterator[dict]:
        if self.out is not None and self.entry["bytes"] and self.entry["bytes"] + len(data) > self.limit:
            yield self.close()
        if self.out is None:
            name = f"part-{self.shard:07d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/.{name}.{uuid.uuid4().hex}.tmp"
            self.out = self.files.open_output_stream(self.temporary)
            self.entry = {"file": name, "shard": self.shard, "records": 0, "bytes": 0, "first_key": key, "last_key": key}
            self.number += 1
        self.out.write(data)
        self.entry["records"] += 1
        self.entry["bytes"] += len(data)
        self.entry["last_key"] = key

    def close(self) -> dict:
        self.out.close()
        self.out = None
        final = f"{self.root}/{self.entry['file']}"
        self.files.move(self.temporary, final)  # replaces what an earlier try of the same task left
        return self.entry


MANIFEST = "file string, shard int, records long, bytes long, first_key long, last_key long"
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _entries(rows: list[dict]) -> pa.RecordBatch:
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, _KINDS, strict=True)], names)


def _write(batches: Iterator[pa.RecordBatch], root: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, key, digest, kind): before the rows of a repeated payload comes one that names its response."""
    roll, done, noted, last, copy = None, [], (None, None, None), None, 0
    for batch in batches:
        for row in batch.to_pylist():
            shard, key, sha = row["shard"], row["key"], row["sha"]
            if row["kind"] == 0:
                noted = (key, sha, row["winner"])
                continue
            if roll is None or roll.shard != shard:
                if roll is not None and roll.out is not None:
                    done.append(roll.close())
                roll, last = _Roll(root, shard, limit), None
            copy = copy + 1 if last == (key, sha) else 0
            last = (key, sha)
            digest, refers_to = base32_sha1(sha), None
            if key is not None and noted[:2] == (key, sha) and (noted[2] != key or copy):
                refers_to = record_id(noted[2], digest, 0)
            data = record(key, row["target"], (row["payload"] or "").encode(), digest, copy, refers_to)
            done.extend(roll.add(gzip.compress(data, LEVEL, mtime=0), key))
    if roll is not None and roll.out is not None:
        done.append(roll.close())
    yield _entries(done)


def _cells(facts: DataFrame, shard_bytes: int) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """A function that gives rows of (key, sha) their cell, and the shards of every cell: (cell, low, high, first, parts).

    The number of cells is bounded whatever the table holds: CELLS of equal width over
    the range of keys, and PARTS for each of at most SHARES crowded ones in every round.
    A round narrows a crowded cell to a PARTS-th, so 64-bit keys take nine at most.
    """
    ends = facts.agg(F.min("key").cast("double").alias("_low"), F.max("key").cast("double").alias("_high"), F.sum(F.col("n") + HEADER_BYTES).alias("all"))
    ends = cut(ends)
    rounds: list[DataFrame] = []

    def celled(x: DataFrame) -> DataFrame:
        place = F.floor((F.col("key") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * CELLS)
        none = -1 - F.pmod(F.crc32("sha"), F.lit(64))  # rows without key
        x = x.crossJoin(F.broadcast(ends.drop("all"))).withColumn("cell", F.coalesce(place, none).cast("string")).drop("_low", "_high")
        for crowd in rounds:
            part = F.floor((F.col("key") - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low") + 1) * PARTS)
            x = x.join(F.broadcast(crowd), "cell", "left").withColumn("cell", F.coalesce(F.concat("cell", F.lit("."), part.cast("string")), "cell")).drop("_low", "_high")
        return x

    while True:
        cells = cut(celled(facts).groupBy("cell").agg(F.sum(F.col("n") + HEADER_BYTES).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")))
        crowd = cells.crossJoin(F.broadcast(ends.select("all"))).filter((F.col("n") > shard_bytes) & (F.col("n") * SHARES > F.col("all")) & (F.col("low") < F.col("high")))
        if crowd.isEmpty():
            break
        rounds.append(crowd.select("cell", F.col("low").alias("_low"), F.col("high").alias("_high")))
    before = F.sum("n").over(Window.orderBy(F.col("low").asc_nulls_first(), "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return celled, cells.select("cell", "low", "high", F.floor(before / F.lit(shard_bytes)).alias("first"), F.ceil(F.col("n") / F.lit(shard_bytes)).alias("parts"))


def write(df: DataFrame, root: str, key: str = "page_id", target: str = "url", payload: str = "html", min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archive below the URI ``root`` and returns its manifest, which is also kept there."""
    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(target).cast("string").alias("target"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    facts = cut(rows.select("key", "sha", F.octet_length("payload").cast("long").alias("n")))
    celled, shards = _cells(facts, shard_bytes)
    within = F.coalesce(F.floor((F.col("key") - F.col("low")).cast("double") / (F.col("high") - F.col("low") + 1) * F.col("parts")), F.lit(0))
    # repeated payloads: (key, sha) of their rows with the key that wins
    repeated = facts.filter(F.col("n") >= min_bytes).groupBy("sha").agg(F.count("*").alias("c"), F.max("key").alias("winner")).filter("c > 1")
    notes = facts.join(repeated.select("sha", "winner"), "sha").filter(F.col("key").isNotNull()).select("key", "sha", "winner").distinct()
    columns = ["shard", "key", "sha", "kind", "winner", "target", "payload"]
    noted = notes.withColumn("kind", F.lit(0)).withColumn("target", F.lit(None).cast("string")).withColumn("payload", F.lit(None).cast("string"))
    both = noted.unionByName(rows.withColumn("kind", F.lit(1)).withColumn("winner", F.lit(None).cast("long")))
    both = celled(both).join(F.broadcast(shards), "cell").withColumn("shard", (F.col("first") + within).cast("int")).select(*columns)
    dealt = both.repartition(crowded(df.sparkSession), "shard").sortWithinPartitions("shard", "key", "sha", "kind", "target")
    dealt.mapInArrow(lambda it: _write(it, root, roll_bytes), MANIFEST).write.mode("overwrite").parquet(f"{root}/_manifest")
    return df.sparkSession.read.parquet(f"{root}/_manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends too early")
        yield headers, block


RECORD = "file string, record_id string, record_type string, target string, refers_to string, payload_digest string, payload_bytes long"


def _read(batches: Iterator[pa.RecordBatch], root: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    files, path = fs.FileSystem.from_uri(root)
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for name in batch.column("file").to_pylist():
            rows: list[tuple] = []
            payloads: list[bytes | None] = []
            with files.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.open(raw) as unzipped:
                for headers, block in parse(io.BufferedReader(unzipped)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    response = headers["warc-type"] == "response"
                    if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}: the payload of {headers['warc-record-id']} does not match its digest")
                    rows.append((name, headers["warc-record-id"], headers["warc-type"], headers["warc-target-uri"], headers.get("warc-refers-to"), digest, size))
                    payloads.append(payload if response else None)
                    if len(rows) >= 500:
                        yield _records(rows, payloads, names, with_payload)
                        rows, payloads = [], []
            if rows:
                yield _records(rows, payloads, names, with_payload)


def _records(rows: list[tuple], payloads: list, names: list[str], with_payload: bool) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(columns + [pa.array(payloads, pa.binary())] * with_payload, names + ["payload"] * with_payload)


def read(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest lists; digests of payloads are checked."""
    files = spark.read.parquet(f"{root}/_manifest").select("file")
    schema = RECORD + (", payload binary" if with_payload else "")
    return files.repartition(crowded(spark), "file").mapInArrow(lambda it: _read(it, root, with_payload), schema)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written to an archive and read back: one row for each record."""
    root = fresh_path(pages.sparkSession, "warc")
    write(pages, root, min_bytes=min_bytes)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)", 1)
    key = number("record_id")
    records = read(pages.sparkSession, root, with_payload=False)
    return records.select(
        F.when(key != "", key.cast("long")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").cast("long").alias("refers_to")
    )
