"""WARC archives: writing with revisit records, reading back, and an index merged from sorted capture runs.

Writing. Pages with the same payload of at least ``MIN_REVISIT`` bytes are one group: the page with the largest id is
stored as a response, the others as revisits that point to it. Each task writes gzip-compressed WARC 1.1 files, one member
per record, under names of their own in the shared folder; the manifest, written as Parquet, lists the files of the
attempts that counted, so files of lost attempts are never read.

Reading. One task streams an archive at a time, member by member, checks lengths and digests, and emits its records sorted
by URL key, time and id: a capture run.

Merging. Runs are cut at common key splitters (a range partitioning by URL key, time and id, which also cuts a hot URL),
and each range merges its slices of all runs with a loser tree. Ranges follow one another, so (range, position) is a
global order and each URL's captures form its history.

Null html is an empty payload, a null url an empty one. A null id never wins a group and is kept null. Rows that repeat
the largest id of their group are responses all. An empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.llm.tokens import lean
from placeframe.session import discard, fresh_path, materialise, ship_package

#: Payloads below this many bytes are never revisits.
MIN_REVISIT = 1000
#: A task starts another archive file beyond this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Groups of equal payloads that are broadcast (some 30 bytes each).
MAX_BROADCAST_GROUPS = 1_000_000
#: Captures of a merge range, and the most tasks that read archives.
RANGE_ROWS, MAX_TASKS = 100_000, 20_000
#: Capture time of a page without one: this instant plus its id in seconds.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_MANIFEST = "file string, records long, bytes long"
_RUN = T.StructType([T.StructField(n, k) for n, k in (("url_key", T.StringType()), ("captured", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("archive", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("run_seq", T.LongType()))])


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path and ordered query; scheme, www, default port and fragment go."""
    try:
        u = urlsplit(url if "//" in url else f"//{url}")
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (u.path.lower() or "/") + (f"?{query.lower()}" if query else "")


def capture_time(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m.group()):02X}', url)}",
        f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Record-ID: {_urn(page_id, digest)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest and refers_to of every page.

    The groups of equal payloads are found on digests alone and written; up to ``MAX_BROADCAST_GROUPS`` of them are
    broadcast, so payloads stay where they are, and more are joined by a shuffle.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= MIN_REVISIT
    tops = base.where(large).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.unhex("digest").alias("d"), "top")
    tops = materialise(tops, "warc-groups")
    if tops.count() <= MAX_BROADCAST_GROUPS:
        tops = F.broadcast(tops)
    refers = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top"))), F.col("top"))
    return base.join(tops, F.unhex("digest") == F.col("d"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives; returns the manifest (file, records, bytes)."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    leaf, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    name = f"{folder.rstrip('/')}/{leaf}"
                    out = fs.open_output_stream(f"{root}/{leaf}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(*row)) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialise(resolve(pages, id_col, url_col, html_col).mapInArrow(lean(run), _MANIFEST), "warc-manifest")


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path, compression=None)


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, read a megabyte at a time."""
    at, start, got, pending, unzip = 0, 0, [], b"", zlib.decompressobj(31)
    while True:
        data = pending or stream.read(1 << 20)
        pending = b""
        if not data:
            if got:
                raise ValueError(f"the archive ends within the member at {start}")
            return
        got.append(unzip.decompress(data))
        at += len(data) - len(unzip.unused_data)
        if unzip.eof:
            pending = unzip.unused_data
            yield start, at - start, b"".join(got)
            start, got, unzip = at, [], zlib.decompressobj(31)


def parse(content: bytes) -> dict:
    """Headers of a record and what its block says of the payload; a broken record raises."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != told):
        raise ValueError("the payload differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    stamp = re.sub(r"\D", "", fields["WARC-Date"])
    return {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "captured": stamp, "record_type": kind, "payload_bytes": size, "payload_digest": told, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload}


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def read_runs(manifest: DataFrame) -> DataFrame:
    """The capture runs of the archives, each sorted by URL key, time and id."""
    ship_package(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with _open(name) as stream:
                    for offset, length, content in members(stream):
                        r = parse(content)
                        rows.append((url_key(r["url"]), r["captured"], r["page_id"], r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], name, offset, length))
                rows.sort(key=_order)
                yield _batch([(*r, i) for i, r in enumerate(rows)])

    return _by_file(manifest).mapInArrow(lean(run), _RUN)


def _by_file(manifest: DataFrame) -> DataFrame:
    """The archives' names, dealt out by number: rows are few and short, but each is an archive to read."""
    return manifest.select("file").repartition(max(1, min(manifest.count(), MAX_TASKS)), "file")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _RUN.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[type(f.dataType)]) for c, f in zip(columns, _RUN.fields, strict=True)], names=_RUN.names)


class LoserTree:
    """Merge of k sorted iterables: the inner nodes hold the losers of their matches, so each step replays one path."""

    def __init__(self, runs: list[Iterable], key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k else -1

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) <= (y[0], b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures with their place in the global order: merge_range, position.

    A range holds some ``RANGE_ROWS`` captures, kept as Arrow columns; rows are made of them a few at a time.
    """
    ship_package(runs.sparkSession)
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    cut = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "offset").sortWithinPartitions("archive", "run_seq")
    ranged = cut.withColumn("merge_range", F.spark_partition_id())
    schema = T.StructType([*_RUN.fields, T.StructField("merge_range", T.IntegerType()), T.StructField("position", T.LongType())])

    def rows(parts: list[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
        for part in parts:
            for i in range(0, part.num_rows, size):
                yield from zip(*(c.to_pylist() for c in part.slice(i, size).columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[pa.RecordBatch]] = {}
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(b.num_columns - 1)[0].as_py()
            b = b.select(_RUN.names)
            ends = pc.run_end_encode(b.column("archive"))
            start = 0
            for name, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                slices.setdefault(name, []).append(b.slice(start, end - start))
                start = end
        merged, i = iter(LoserTree([rows(parts) for parts in slices.values()], _order)), 0
        while held := list(islice(merged, 10_000)):
            n = len(held)
            yield pa.RecordBatch.from_arrays([*_batch(held).columns, pa.array([at] * n, pa.int32()), pa.array(range(i, i + n), pa.int64())], names=schema.names)
            i += n

    return ranged.mapInArrow(lean(run), schema)


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives, read them back and return the merged index, one row per page."""
    manifest = write(pages, None, id_col, url_col, html_col)
    runs = materialise(read_runs(manifest), "warc-runs")
    discard(manifest)
    return merge_runs(runs)


def payloads(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id and payload (binary) of every response in the archives."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with _open(name) as stream:
                    for _, _, content in members(stream):
                        r = parse(content)
                        if r["record_type"] == "response":
                            yield pa.RecordBatch.from_arrays([pa.array([r["page_id"]], pa.int64()), pa.array([r["payload"]], pa.binary())], names=["page_id", "payload"])

    return _by_file(manifest).mapInArrow(lean(run), "page_id long, payload binary")
