"""WARC archives of landed responses: a writer, and a reader that salvages damaged files.

The writer is Spark's text sink: each row is one record, and the sink's line separator is the pair of line ends that
closes a WARC record. Files appear only when a task's output is committed, so a lost executor leaves none behind.
The writer bounds files by bytes. The reader parses each in Python, as a whole or, if it is long, as a stream of its lines. A record counts when its version
line, its length, its closing line ends and its digest are right; after a failed check the reader looks for the next
version line, or the next gzip member that opens, and logs the bytes it passed over as a gap. Inside a member it does the same
with version lines.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm.common import col
from crosstide.session import settle

END = "\r\n\r\n"
ID_PREFIX = "urn:landed:"
FILE_BYTES = 1 << 26
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = (
    "path string, offset bigint, length bigint, gap string, record_type string, record_id string, refers_to string, "
    "url string, payload_digest string, payload_bytes bigint, payload binary"
)
_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("gap", pa.string()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to", pa.string()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


# ---- writer


def _decided(responses: DataFrame, key: str, url: str, body: str, min_revisit_bytes: int, revisit_unnamed: bool) -> DataFrame:
    """id, url, body, bytes, digest, refers_to. Of equal bodies that are long enough the largest id is the response.

    Bodies cross one join on their digest, where adaptive execution can split a digest that many responses share.
    """
    text = F.coalesce(col(body), F.lit(""))
    rows = responses.select(col(key).alias("id"), col(url).alias("url"), text.alias("body"), F.octet_length(text).cast("bigint").alias("bytes"), F.sha1(text).alias("digest"))
    long = rows.where(F.col("bytes") >= min_revisit_bytes).select("id", "digest")
    first = settle(long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("original")).where("n > 1").drop("n"), "originals")
    met = rows.join(first, "digest", "left").withColumn("original", F.when(F.col("bytes") >= min_revisit_bytes, F.col("original")))
    again = ~F.col("original").eqNullSafe(F.col("id")) if revisit_unnamed else F.col("original") != F.col("id")
    return met.withColumn("refers_to", F.when(again, F.col("original"))).drop("original")


def _header(name: str, value: Column) -> Column:
    safe = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]+", " ")
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), safe), F.lit(""))


def _record(date: str) -> Column:
    """The whole record but for its closing line ends."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    name = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        _header("WARC-Record-ID", name(F.coalesce(F.col("id").cast("string"), F.lit("")))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Refers-To", name(F.col("refers_to"))),
        _header("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block)),
        F.lit(END),
    )
    return F.concat(head, block).alias("value")


def _numbers(file_bytes: int) -> Callable[[Column], Column]:
    """The number, within its task, of the file that a record of so many bytes goes to. Only sizes reach Python."""

    @F.arrow_udf("int")
    def number(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        file, held = 0, 0
        for sizes in parts:
            out = []
            for size in sizes.to_pylist():
                size += len(END)
                if held and held + size > file_bytes:
                    file, held = file + 1, 0
                held += size
                out.append(file)
            yield pa.array(out, pa.int32())

    return number


def write_archives(
    responses: DataFrame,
    path: str,
    key: str = "response_id",
    url: str = "url",
    body: str = "body",
    date: str = "1970-01-01T00:00:00Z",
    min_revisit_bytes: int = 1000,
    records_per_file: int = 4000,
    revisit_unnamed: bool = True,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write one record per landed response under `path`, a folder that does not exist yet.

    Of equal bodies of at least `min_revisit_bytes` bytes, the one with the largest key is a response and the others are
    revisits that refer to it; shorter ones are all responses. A null body is empty; a null key has an empty record name and is
    never the largest, and without `revisit_unnamed` always a response; rows equal in key and body are both responses. Control characters in an address become blanks.
    An empty table gives a folder without records. A file holds at most `records_per_file` records and `file_bytes` bytes; a longer
    record has one for itself.
    """
    decided = _decided(responses, key, url, body, min_revisit_bytes, revisit_unnamed)
    numbered = decided.select(_record(date)).withColumn("file", _numbers(file_bytes)(F.octet_length("value")))
    numbered.write.partitionBy("file").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


# ---- reader

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
PIECE = 1 << 16
EOL, BOM = b"\r\n", b"\xef\xbb\xbf"
BATCH_BYTES = 1 << 22
HOLD = 1 << 26  # bytes of a member kept at hand
LONGEST = (1 << 31) - 1  # bytes of a row


class Damaged(ValueError):
    """A record that fails a check."""


class Short(Damaged):
    """A record that may only want more bytes than are held: `need` of them from its start, or 0 where that is unknown."""

    def __init__(self, why: str, need: int = 0):
        super().__init__(why)
        self.need = need


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict, int]:
    """(record, end) of the record at `at`; raises Damaged."""
    start = VERSION.match(data, at)
    if not start:
        raise Short("no version line", 10) if len(data) - at < 10 else Damaged("no version line")
    close = data.find(b"\r\n\r\n", start.end() - 2)
    if close < 0:
        raise Short("header does not end")
    head = {}
    for line in data[start.end() : close].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        if (name := name.strip().lower()) in head and name != b"warc-concurrent-to":
            raise Damaged("a header field stands twice")
        head[name] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", head.get(b"content-length", "")):
        raise Damaged("no length")
    body = close + 4
    end = body + int(head[b"content-length"])
    if len(data) < end + 4:
        raise Short("record does not end where its length says", end + 4 - at)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[body:end]
    told = head.get(b"warc-block-digest", "")
    if told.startswith("sha1:") and len(told) == 45 and hashlib.sha1(block).hexdigest() != told[5:]:
        raise Damaged("block digest differs")
    kind = head.get(b"warc-type", "")
    payload, size = block, len(block)
    if head.get(b"content-type", "").startswith("application/http"):
        front, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        told = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", front)
        if kind == "revisit" and told:
            size = int(told[1])
    digest = head.get(b"warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit":
        own = hashlib.sha1(payload).hexdigest()
        if len(digest) == 40 and digest != own:
            raise Damaged("payload digest differs")
        digest = own
    bare = lambda v: v.strip("<>").removeprefix(ID_PREFIX) if v is not None else None
    return {
        "record_type": kind,
        "record_id": bare(head.get(b"warc-record-id")),
        "refers_to": bare(head.get(b"warc-refers-to")),
        "url": head.get(b"warc-target-uri"),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload,
    }, end + 4


class _Tape:
    """Bytes that come in pieces; only those from the present place on are held."""

    def __init__(self, pieces: Iterable[bytes], size: int = LONGEST):
        self.pieces, self.size = iter(pieces), size
        self.held, self.pos, self.base = b"", 0, 0

    @property
    def at(self) -> int:
        return self.base + self.pos

    def fill(self, n: int) -> bool:
        """Hold at least `n` bytes from the present place on; whether there are as many."""
        have = len(self.held) - self.pos
        if have < n:
            parts = [self.held[self.pos :]] if have else []
            while have < n and (piece := next(self.pieces, None)) is not None:
                parts.append(piece)
                have += len(piece)
            self.base, self.pos, self.held = self.at, 0, parts[0] if len(parts) == 1 else b"".join(parts)
        return have >= n

    def more(self) -> bool:
        """Hold about twice as many bytes; whether any came."""
        have = len(self.held) - self.pos
        self.fill(max(PIECE, 2 * have))
        return len(self.held) - self.pos > have

    def peek(self, place: int, n: int) -> bytes:
        self.fill(place - self.at + n)
        return self.held[place - self.base : place - self.base + n]

    def to(self, place: int) -> None:
        if place > self.at:
            self.fill(place - self.at)
            self.pos = min(place - self.base, len(self.held))

    def to_start(self, place: int, members: bool) -> None:
        """Go to the next version line or gzip member from `place` on, or to the end."""
        self.to(place)
        while True:
            line = VERSION.search(self.held, self.pos)
            member = self.held.find(MEMBER, self.pos) if members else -1
            starts = [line.start()] if line else []
            if starts := starts + [member] * (member >= 0):
                self.pos = min(starts)
                return
            self.pos = max(self.pos, len(self.held) - 9)
            if not self.more():
                self.pos = len(self.held)
                return


def _plain(tape: _Tape) -> Iterator[dict]:
    """The record at the tape's place."""
    at = tape.at
    while True:
        try:
            record, end = parse_record(tape.held, tape.pos)
            break
        except Short as e:
            if e.need > min(tape.size - at, LONGEST) or not (tape.more() if not e.need else tape.fill(e.need)):
                raise
    tape.pos = end
    yield record | {"gap": None, "offset": at, "length": tape.at - at}


def _member(tape: _Tape) -> Iterator[dict]:
    """Records of the gzip member at the tape's place, and gaps inside it; a member that is cut or broken gives those before
    the damage and raises Damaged, as does one that holds bytes but no record. A member of one record, after which no other
    begins, fails whole with its checksum."""
    at, fed, failure, opened, out = tape.at, 0, "", zlib.decompressobj(31), 0

    def text() -> Iterator[bytes]:
        nonlocal fed, failure, out
        while not opened.eof:
            tape.to(at + fed - HOLD)
            if not (piece := tape.peek(at + fed, PIECE)):
                failure = "member is cut"
                return
            before = opened.copy()
            try:
                part = opened.decompress(piece)
            except zlib.error:
                failure = "member does not open"
                for i in range(len(piece)):  # what the piece still holds before the damage
                    try:
                        part = before.decompress(piece[i : i + 1])
                    except zlib.error:
                        return
                    fed, out = fed + 1, out + len(part)
                    yield part
                return
            fed, out = fed + len(piece), out + len(part)
            yield part

    rows, size, found, last, end = [], 0, 0, None, 0
    for row in _salvage(_Tape(text()), members=False):
        if row["gap"]:
            last = row
            rows.append({"gap": f"{row['gap']}, {row['length']} bytes from {row['offset']} inside the member", "offset": at})
        else:
            found, size, end = found + 1, size + len(row["payload"]), row["offset"] + row["length"]
            rows.append(row | {"offset": at})
        if found and size > HOLD:
            yield from (r | {"length": None} for r in rows)
            rows, size = [], 0
    alone = found == 1 and failure == "member does not open" and (end == out or rows[0]["gap"] is None and last["gap"] == "no version line")
    if alone or not found and (failure or out):
        raise Damaged(failure or last["gap"])
    whole = fed - len(opened.unused_data)
    inside = out
    if failure and last and last["offset"] + last["length"] == out and rows and rows[-1]["gap"]:
        inside = last["offset"]
        rows.pop()
    yield from (r | {"length": whole} for r in rows)
    if failure:
        raise Damaged(f"{failure}, from byte {inside} inside the member")
    tape.to(at + whole)


def _salvage(tape: _Tape, members: bool = True) -> Iterator[dict]:
    lost, why = None, ""
    while tape.fill(1):
        at = tape.at
        try:
            for row in _member(tape) if members and tape.peek(at, 3) == MEMBER else _plain(tape):
                if lost is not None:
                    yield {"gap": why, "offset": lost, "length": at - lost}
                    lost = None
                yield row
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
            tape.to_start(at + 1, members)
            continue
        if lost is not None:  # before an empty member
            yield {"gap": why, "offset": lost, "length": at - lost}
            lost = None
    if lost is not None:
        yield {"gap": why, "offset": lost, "length": tape.at - lost}


def salvage(data: bytes) -> Iterator[dict]:
    """Records of one file in order, each with offset and length, and gaps with the reason in `gap`.

    What stands in a gzip member has the member's offset and length; a gap inside names the bytes of the opened member.
    """
    return _salvage(_Tape([data], len(data)))


def _long_files(spark: SparkSession, files: list[tuple[str, int]]) -> tuple[DataFrame, dict[int, tuple[str, int, bytes, bytes]]]:
    """(number, start, row, line) of the lines of long files, and per number the path, the size and the bytes that stand before
    the first and after the last line.

    Lines end in CR LF, are read in byte ranges and hold any bytes. The files are mounted under names without a suffix, as
    Spark would open compressed ones by their suffix.
    """
    name, uri = f"archives-{uuid.uuid4().hex}", lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).toUri().toString()
    links = {f"fs.viewfs.mounttable.{name}.link./{i}": uri(path) for i, (path, _) in enumerate(files)}
    text = spark.read.options(**links).option("lineSep", EOL.decode()).text([f"viewfs://{name}/{i}" for i in range(len(files))])
    lines = text.select(
        F.col("_metadata.file_name").cast("int").alias("number"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line")
    )
    told = {r["number"]: r["n"] for r in lines.groupBy("number").agg((F.sum(F.octet_length("line") + F.lit(2).cast("bigint")) - 2).alias("n")).collect()}
    ends = {}
    for i, (path, size) in enumerate(files):
        more = size - told.get(i, 0)  # what the reader of lines drops: a byte order mark and the last line end
        if more not in (0, 2, 3, 5):
            raise ValueError(f"{path} can't be read in ranges: {more} bytes are missing")
        ends[i] = (path, size, BOM if more in (3, 5) else b"", EOL if more in (2, 5) else b"")
    return lines.repartition(len(files), "number").sortWithinPartitions("number", "start", "row"), ends


def _rows(path: str, found: Iterable[dict], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1000 rows and about BATCH_BYTES bytes of payload."""
    rows, size = [], 0
    for row in found:
        row["path"] = path
        if not with_payload:
            row["payload"] = None
        rows.append(row)
        size += len(row.get("payload") or b"")
        if len(rows) == 1000 or size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, whole_bytes: int = 2 * FILE_BYTES) -> DataFrame:
    """Records and gaps of the archives under `path`.

    A row has path, offset and length in the file; a record has record_type, record_id, refers_to, url, payload_digest
    (hex SHA-1, checked), payload_bytes and payload; a gap has its reason in `gap` and null in the rest. A gzip file may
    hold any number of records per member: what a damaged member gives before the damage is kept, and records after one that
    fails a check are. Their length is the member's (to the damage; null once over 64 MB of payloads). A folder without
    records gives no rows. Files of more than `whole_bytes` bytes are read in ranges and parsed as a stream, one task per file, so
    that a task holds a record at a time; a record of 2 GiB or more is a gap.
    """

    def parse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for name, content in zip(frame.column("path").to_pylist(), frame.column("content"), strict=True):
                yield from _rows(name, salvage(content.as_py()), with_payload)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(parse, FIELDS)
    long = sorted(map(tuple, files.where(F.col("length") > whole_bytes).select("path", "length").collect()))
    if not long:
        return found
    lines, ends = _long_files(spark, long)

    def stream(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_lines = ((n, x.as_py()) for f in frames for n, x in zip(f.column(0).to_pylist(), f.column(1), strict=True))
        for n, own in groupby(all_lines, lambda r: r[0]):
            name, size, before, after = ends[n]
            yield from _rows(name, _salvage(_Tape(_pieces(before, (x for _, x in own), after), size)), with_payload)

    return found.unionAll(lines.select("number", "line").mapInArrow(stream, FIELDS))


def _pieces(before: bytes, lines: Iterable[bytes], after: bytes) -> Iterator[bytes]:
    """The bytes of a file from its lines, in pieces of about PIECE bytes."""
    part, size, join = [before], 0, b""
    for line in lines:
        part += [join, line]
        size, join = size + len(line) + 2, EOL
        if size > PIECE:
            yield b"".join(part)
            part, size = [], 0
    yield b"".join([*part, after])
