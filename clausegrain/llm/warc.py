"""WARC archives with revisit records, and their index in global order by an external merge.

Write: of the captures with equal payloads (SHA-1, found by an aggregation) the one with the largest page_id is a response,
the others are revisits that refer to it. Tasks write gzip members into archives of bounded size under a shared
folder, each under a name of its own try, and hand back the names; the names of tries that failed are handed back by none,
so their files are never read. Names travel as a table.

Read: archives are streamed, record by record, and give captures. A task sorts those of some RUN_BYTES of archives by URL key, timestamp
and page_id and writes them as a run: a file of small batches under the shared folder. Batches are dealt by ranges of these keys, so that a popular
URL or host spans several ranges. For each range a loser tree merges streams over the runs' files, of which it holds one batch each; beyond FAN runs,
groups of them are merged to longer runs first. So no task's memory grows with the corpus, and capture histories come in global order.

Defined results: null html is an empty payload and null urls are written as unknown:; repeated rows are captures of
their own (with the largest page_id of a payload, all of them are responses); an empty table gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from clausegrain.llm.common import materialize, shared_dir, sliced

#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Compressed archives in a run, rows of a run's batch and, about, of a range, and runs that are merged at once.
RUN_BYTES, BATCH_ROWS, RANGE_ROWS, FAN = 128 << 20, 512, 1 << 18, 256
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
CRLF = b"\r\n"
NAMES = "archive string, records long, bytes long"
CAPTURES = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
FIELDS = [f.split()[0] for f in CAPTURES.split(", ")]
KINDS = [pa.int64() if " long" in f else pa.string() for f in CAPTURES.split(", ")]
#: A batch of a run: where it lies, and its first and last key.
PIECES = "run string, file string, batch int, rows long, url_key string, timestamp string, page_id long, last_url_key string, last_timestamp string, last_page_id long"
PIECE_FIELDS = [f.split()[0] for f in PIECES.split(", ")]
PIECE_KINDS = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in PIECES.split(", ")]


# ---------------------------------------------------------------- records


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then the rest, so that a domain's captures lie together."""
    scheme, found, rest = url.partition("://")
    if not found:
        return url.lower()
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:].partition("#")[0]


def moment(page_id: int | None) -> datetime:
    """Captures have no time of their own: one a second, by page_id."""
    return EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": moment(page_id).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": quote(url, safe="!#$%&'()*+,-./:;<=>?@[]^_`{|}~\\\"") if url else "unknown:",
        "WARC-Payload-Digest": "sha1:" + digest32(payload),
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + CRLF + block + CRLF + CRLF


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream, one at a time."""
    buffer, offset, ended = b"", 0, False
    while True:
        if not buffer:
            buffer = stream.read(1 << 20)
            if not buffer:
                return
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not buffer:
                buffer = stream.read(1 << 20)
                if not buffer:
                    raise ValueError("an archive that ends within a record")
            parts.append(inflate.decompress(buffer))
            used += len(buffer) - len(inflate.unused_data)
            buffer = inflate.unused_data
        yield offset, b"".join(parts)
        offset += used


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def capture(raw: bytes, archive: str, offset: int) -> tuple:
    """The index entry of a record, its payload checked against the digest."""
    fields, block = parsed(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(CRLF) if x.startswith(b"Content-Length: "))[16:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError(f"a damaged record at {offset} of {archive}")
    page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
    return url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], int(page) if page else None, length, digest, kind, int(refers) if refers else None, archive, offset


# ---------------------------------------------------------------- merging


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner costs one comparison a level."""

    def __init__(self, runs: list[Iterable], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.rows: list = [None] * self.k
        self.keys: list = [None] * self.k  # None: the run is over, and loses to all
        for i in range(self.k):
            self._next(i)
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int) -> None:
        self.rows[i] = next(self.runs[i], None)
        self.keys[i] = None if self.rows[i] is None else (self.key(self.rows[i]), i)

    def _beats(self, a: int, b: int) -> bool:
        return self.keys[a] is not None and (self.keys[b] is None or self.keys[a] < self.keys[b])

    def _play(self, i: int) -> None:
        """Run i climbs from its leaf; at an empty node it waits for its match."""
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.k and self.keys[w := self.losers[0]] is not None:
            yield self.rows[w]
            self._next(w)
            self._play(w)


def order(row: tuple) -> tuple:
    """Of an index entry: by URL key, timestamp, page_id."""
    return row[0], row[1], row[2] is not None, row[2] or 0


# ---------------------------------------------------------------- on Spark


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives into the folder, a URI that all executors reach; archive, records, bytes of each."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    # Payloads that occur once need no look-up; the others' table is written first, so that Spark knows its size before it joins.
    several = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "payloads")
    marked = rows.join(several, "digest", "left").select("page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, made, name = None, [], ""

        def close() -> None:
            nonlocal out
            if out is not None:
                made[-1][2] = out.tell()
                out.close()
                out = None

        for batch in sliced(batches, 500):
            for page_id, url, payload, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "revisit")), strict=True):
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(name, compression=None)
                    made.append([f"{folder}/{name.rsplit('/', 1)[1]}", 0, 0])
                deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
                out.write(deflate.compress(record(page_id, url, payload, first, revisit)) + deflate.flush())
                made[-1][1] += 1
                if out.tell() >= archive_bytes:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "bytes"])

    return materialize(marked.mapInArrow(run, NAMES), "archives")


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _batches(rows: Iterable[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _table(held, FIELDS, KINDS)
            held = []
    if held:
        yield _table(held, FIELDS, KINDS)


def _written(rows: Iterable[tuple], folder: str, run: str | None) -> list[tuple]:
    """Writes sorted captures as a file of a run (a run of its own, if None) and gives its PIECES."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    name, made = uuid.uuid4().hex, []
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out, pa.ipc.new_file(out, pa.schema(list(zip(FIELDS, KINDS, strict=True)))) as file:
        for batch in _batches(rows, BATCH_ROWS):
            file.write_batch(batch)
            first, last = (tuple(batch.column(k)[at].as_py() for k in range(3)) for at in (0, batch.num_rows - 1))
            made.append((run or name, f"{folder}/{name}", len(made), batch.num_rows, *first, *last))
    return made


def _read(pieces: list[tuple[str, int]], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The captures of a run's batches (file, number) from the key low to below high, one batch at a time."""
    opened = None
    for path, number in pieces:
        if opened is None or opened[0] != path:
            fs, place = filesystem(path)
            opened = path, pa.ipc.open_file(fs.open_input_file(place))
        for row in zip(*(c.to_pylist() for c in opened[1].get_batch(number).columns), strict=True):
            key = order(row)
            if (low is None or key >= low) and (high is None or key < high):
                yield row


def runs(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """PIECES of sorted runs of the archives' captures (archive, bytes), one run a task, in files under the folder."""
    spark = archives.sparkSession
    folder = folder or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    n, size = archives.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-size // RUN_BYTES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = filesystem(archive)
                with fs.open_input_stream(path, compression=None) as stream:
                    parts.append(sorted((capture(raw, archive, offset) for offset, raw in members(stream)), key=order))
        if parts:
            yield _table(_written(LoserTree(parts, order), folder, None), PIECE_FIELDS, PIECE_KINDS)

    return materialize(archives.select("archive").repartition(tasks).mapInArrow(run, PIECES), "pieces")


def _merge(pieces: DataFrame, groups: int, edges: list[tuple], folder: str | None) -> DataFrame:
    """The runs of each group merged, by ranges between edges (keys): PIECES of longer runs in files under the folder, or, without one, the captures."""
    wide = -(-(len(edges) + 1) // max(1, (len(edges) + 1) // groups))  # as many neighbouring ranges are one as keep its rows about the same

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for piece in zip(*(batch.column(c).to_pylist() for c in PIECE_FIELDS), strict=True):
                run, file, number, _, *keys = piece
                group = zlib.crc32(run.encode()) % groups
                for k in range(bisect_right(edges, order(keys[:3])) // wide, bisect_right(edges, order(keys[3:])) // wide + 1):
                    rows.append((k, group, run, file, number, *keys[:3]))
            if rows:
                yield _table(rows, ["range", "group", "run", "file", "batch", "url_key", "timestamp", "page_id"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            k, group = unit
            low = edges[k * wide - 1] if k else None
            high = edges[(k + 1) * wide - 1] if (k + 1) * wide <= len(edges) else None
            merged = LoserTree([_read(x, low, high) for x in of_run.values()], order)
            if folder is None:
                yield from _batches(merged)
            elif made := _written(merged, folder, f"{folder}/{group}"):
                yield _table(made, PIECE_FIELDS, PIECE_KINDS)

        unit, of_run = None, {}
        for batch in batches:
            for k, group, name, file, number in zip(*(batch.column(c).to_pylist() for c in ("range", "group", "run", "file", "batch")), strict=True):
                if unit != (k, group):
                    if unit:
                        yield from done()
                    unit, of_run = (k, group), {}
                of_run.setdefault(name, []).append((file, number))
        if unit:
            yield from done()

    each = pieces.mapInArrow(dealt, "range long, group long, run string, file string, batch int, url_key string, timestamp string, page_id long")
    met = each.repartitionByRange(len(edges) + 1, "range", "group").sortWithinPartitions("range", "group", "run", "url_key", "timestamp", "page_id", "file", "batch")
    return met.mapInArrow(run, CAPTURES if folder is None else PIECES)


def history(pieces: DataFrame) -> DataFrame:
    """Captures of sorted runs in global order of URL key, timestamp and page_id: partition after partition, and within each."""
    spark = pieces.sparkSession
    n, k = pieces.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_distinct("run")).first()
    ranges = max(1, -(-n // RANGE_ROWS))
    keys = ["url_key", "timestamp", "page_id"]
    edges: list[tuple] = []
    if ranges > 1:  # a key for each range: the first of Spark's ranges of the batches' first keys
        first = pieces.select(*keys).repartitionByRange(ranges, *keys).withColumn("part", F.spark_partition_id())
        edges = sorted({order(r[0]) for r in first.groupBy("part").agg(F.min(F.struct(*keys)).alias("m")).select("m").collect()})[1:]
    while k > FAN:
        groups = -(-k // FAN)
        pieces = materialize(_merge(pieces, groups, edges, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"), "pieces")
        k = groups
    return _merge(pieces, 1, edges, None)


def captures(pages: DataFrame) -> DataFrame:
    """Writes the archives, reads them back, and gives their index in global order."""
    return history(runs(write(pages)))
