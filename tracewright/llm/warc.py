"""WARC archives, and one capture index of all of them by an external merge.

Captures are written as gzip members of .warc.gz files. Of captures with equal
payloads the first by (id, date, url) is stored as a response; the others are
revisits, which hold its HTTP head, the digest and a reference. Beside its
archives every task writes runs: at most RUN lines of the index, sorted by URL
key and timestamp, with a fence (offset and first line) every FENCE lines.

Runs are merged at most FAN_IN at a time, level by level, until one is left.
A merge is cut into pieces of about PIECE fences, each a task that reads one
range of bytes of each run and passes the lines through a loser tree: it holds
a buffer for each run and nothing else. The last level gives the captures in
the order of the whole, so that a URL's captures are its history.

Reading goes by the index, archive by archive in the order of offsets. The
digest of every stored payload is reckoned anew and must be the record's.

Defined cases: a null payload is empty, and empty ones are equal like others; a
null url is empty; a null date is the epoch; a null id comes after all others;
of rows that share id, date, url and payload one is the response, the others
revisit it; an empty table gives an empty result; other columns aren't read.
Tasks that run twice leave files that no index names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import dedup, urls
from tracewright.llm.common import cut, running, scratch, slices
from tracewright.operators.ranges import numbered
from tracewright.sources.files import opened

#: Bytes of an archive, lines of a run, lines between fences, runs merged at once, fences of a piece.
ARCHIVE, RUN, FENCE, FAN_IN, PIECE = 1 << 30, 200_000, 1024, 64, 256
#: Groups of copies that are broadcast at most; bytes read at a time from a run; records packed or read at a time.
BROADCAST, BUFFER, RECORDS = 100_000, 1 << 18, 256
#: Above any line: no byte of UTF-8 is this.
END = b"\xff"

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def url_key(url: Column) -> Column:
    """Host labels in reverse, `)`, then path and query: captures of a host, and of a folder in it, are neighbours. Signs that would end a field are escaped."""
    host, _ = urls.split_url(url)
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3 + F.length(host), F.length(url))).otherwise(F.coalesce(url, F.lit("")))
    whole = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), F.regexp_replace(rest, r"(?s)#.*", ""))
    return escaped(whole)


def escaped(text: Column) -> Column:
    """Blanks and control signs as %XX; few texts have any."""
    codes = F.transform(F.split(text, ""), lambda c: F.when((F.ascii(c) <= 32) | (F.ascii(c) == 127), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(F.regexp_like(text, F.lit(r"[\x00-\x20\x7F]")), F.array_join(codes, "")).otherwise(text)


# which captures are stored, and what the others refer to


def resolved(captures: DataFrame) -> DataFrame:
    """captures (id, url, date, payload) as records: copy, record_type, refers_id, refers_date, refers_url, payload_bytes; a revisit has no payload.

    Copies are found by narrow rows. Their groups are broadcast up to BROADCAST;
    with more, a filter of their digests picks the rows that may have one, groups
    of many rows are broadcast all the same (there are few), and the rest meet by
    digest. Rows without copies stay where they are.
    """
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("date"), F.col("url"))
    rows = captures.select("id", "url", "date", "payload", F.unhex(F.sha2("payload", 256)).alias("digest"), first.alias("first"))
    same = rows.groupBy("digest", "first").agg(F.count("*").alias("times"))
    groups = same.groupBy("digest").agg(F.min(F.struct("first", "times")).alias("least"), F.sum("times").alias("n"))
    groups = cut(groups.filter("n > 1").select(F.col("digest").alias("group"), F.col("least.first").alias("original"), F.col("least.times").alias("times"), "n"), "groups")
    found = groups.agg(F.count("*").alias("groups"), F.max("times").alias("times"), F.sum("n").alias("rows")).first()
    by = F.col("digest") == F.col("group")
    if found["groups"] <= BROADCAST:
        joined = rows.join(F.broadcast(groups), by, "left")
    else:
        bits = dedup.filter_bits(found["groups"])
        seen = dedup.probed(rows, cut(dedup.digest_filter(groups.select(F.col("group").alias("digest")), bits), "filter"), bits)
        hot = F.col("n") > max(dedup.HOT, found["rows"] // dedup.HOT_SHARE)
        maybe = seen.filter("maybe").drop("maybe").join(F.broadcast(groups.filter(hot)), by, "left")
        rest = maybe.filter("group IS NULL").drop(*groups.columns).join(groups.filter(~hot), by, "left")
        single = seen.filter("NOT maybe").select("id", "url", "date", "payload", "digest", "first", *(F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in groups.columns))
        joined = maybe.filter("group IS NOT NULL").unionByName(rest).unionByName(single)
    stored = F.col("group").isNull() | ((F.col("first") == F.col("original")) & (F.col("times") == 1))
    shared = (F.col("first") == F.col("original")) & (F.col("times") > 1)
    bytes_ = F.octet_length("payload").cast("long")
    record = lambda kept, copy: ("id", "url", "date", copy.alias("copy"), F.when(kept, "response").otherwise("revisit").alias("record_type"), F.when(kept, F.col("payload")).alias("payload"), bytes_.alias("payload_bytes"), F.unhex(F.sha1("payload")).alias("sha1"), *(F.when(~kept, F.col(f"original.{c}")).alias(f"refers_{c}") for c in ("id", "date", "url")))
    one = F.lit(1).cast("long")
    if (found["times"] or 1) == 1:
        return joined.select(*record(stored, one))
    several = joined.filter(shared).groupBy("digest", "original", "times").agg(F.min("payload").alias("payload"))
    several = several.select("original", "payload", F.explode(F.sequence(one, "times")).alias("copy")).select("original.id", "original.url", "original.date", "original", "copy", "payload")
    return joined.filter(F.coalesce(~shared, F.lit(True))).select(*record(stored, one)).unionByName(several.select(*record(F.col("copy") == 1, F.col("copy"))))


# records


def moment(micros: int) -> datetime:
    return EPOCH + timedelta(microseconds=micros)


def record_id(id_: int | None, micros: int, url: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{id_} {micros} {copy} {url}')}>"


def plain_uri(url: str) -> str:
    """A url that may stand in a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def packed_record(row: dict) -> bytes:
    """A record of WARC 1.1 as a gzip member of its own. A revisit has the head of the response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    digest = base32(row["sha1"])
    stamp = lambda micros: f"{moment(micros):%Y-%m-%dT%H:%M:%S.%fZ}".rjust(27, "0")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['id'], row['date'], row['url'], row['copy'])}", f"WARC-Date: {stamp(row['date'])}", f"WARC-Target-URI: {plain_uri(row['url'])}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if row["id"] is not None:
        lines.append(f"Capture-Id: {row['id']}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_id'], row['refers_date'], row['refers_url'], 1)}", f"WARC-Refers-To-Target-URI: {plain_uri(row['refers_url'])}", f"WARC-Refers-To-Date: {stamp(row['refers_date'])}"]
        if row["refers_id"] is not None:
            lines.append(f"Refers-To-Capture-Id: {row['refers_id']}")
    lines.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parsed_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record and of its HTTP block, names in lower case, and the payload."""
    inflate = zlib.decompressobj(31)
    raw = inflate.decompress(data) + inflate.flush()
    if not inflate.eof or inflate.unused_data or not raw.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not one whole record")
    fields = lambda head: {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = fields(head)
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    http, _, body = rest[:length].partition(b"\r\n\r\n")
    return headers, fields(http), body


def index_line(row: dict, archive: str, offset: int, length: int) -> bytes:
    """A line of the index. As bytes lines sort by URL key, timestamp, id (null last), copy."""
    id_ = "g" if row["id"] is None else f"{row['id'] + 2**63:016x}"
    stamp = f"{moment(row['date']):%Y%m%d%H%M%S%f}".rjust(20, "0")
    return f"{row['url_key']} {stamp} {id_} {row['copy']:016x} {row['record_type']} {base32(row['sha1'])} {length} {offset} {archive}\n".encode()


MANIFEST = "run string, file string, fence long, offset long, length long, first binary"
MANIFEST_ARROW = pa.schema([("run", pa.string()), ("file", pa.string()), ("fence", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("first", pa.binary())])


class RunWriter:
    """A file of sorted lines with its fences. The last fence is the last line and has no bytes: it says where the run ends."""

    def __init__(self, folder: str, run: str | None = None):
        self.fs, self.path = opened(folder)
        self.file = f"{uuid.uuid4().hex}.cdx"
        self.run, self.fences, self.lines, self.at, self.start, self.last = run or self.file, [], 0, 0, 0, b""
        self.out = self.fs.open_output_stream(f"{self.path}/{self.file}", compression=None)
        self.held: list[bytes] = []

    def add(self, line: bytes) -> None:
        if self.lines % FENCE == 0:
            self._flush()
            self.first = line
        self.held.append(line)
        self.lines += 1

    def _flush(self) -> None:
        if self.held:
            data = b"".join(self.held)
            self.out.write(data)
            self.fences.append((self.start, len(data), self.first))
            self.start += len(data)
            self.last, self.held = self.held[-1], []

    def close(self) -> pa.RecordBatch:
        self._flush()
        self.out.close()
        rows = [*self.fences, (self.start, 0, self.last)] if self.fences else []
        return pa.RecordBatch.from_pylist([{"run": self.run, "file": self.file, "fence": i, "offset": o, "length": n, "first": f} for i, (o, n, f) in enumerate(rows)], MANIFEST_ARROW)


class ArchiveWriter:
    """Archives of one task: add() gives the archive, offset and length of a record."""

    def __init__(self, folder: str, most: int):
        self.fs, self.path = opened(folder)
        self.most, self.out = most, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at + len(data) > self.most:
            self.close()
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def written(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE, run_lines: int = RUN) -> DataFrame:
    """The manifest of the runs, as a table; archives and runs are in folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, lines = ArchiveWriter(folder, archive_bytes), []

        def flushed() -> pa.RecordBatch:
            writer = RunWriter(folder)
            for line in sorted(lines):
                writer.add(line)
            lines.clear()
            return writer.close()

        for batch in slices(batches, RECORDS):
            for row in batch.to_pylist():
                lines.append(index_line(row, *archives.add(packed_record(row))))
            if len(lines) >= run_lines:
                yield flushed()
        archives.close()
        if lines:
            yield flushed()

    made_folder(folder)
    rows = records.withColumn("date", F.unix_micros("date")).withColumn("refers_date", F.unix_micros("refers_date")).withColumn("url_key", url_key(F.col("url")))
    return cut(rows.mapInArrow(run, MANIFEST), "runs")


def made_folder(folder: str) -> None:
    filesystem, path = opened(folder)
    filesystem.create_dir(path, recursive=True)


# merging


def loser_tree(streams: list[Iterator[bytes]]) -> Iterator[bytes]:
    """The lines of sorted streams in order. An inner node holds the stream that lost there, so that a line is compared once on each level on its way up."""
    k = len(streams)
    heads = [next(s, END) for s in streams]
    if k < 2:
        if k:
            yield from (heads if heads[0] != END else ())
            yield from streams[0]
        return
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    winner = winners[1]
    while (line := heads[winner]) != END:
        yield line
        heads[winner] = next(streams[winner], END)
        node = (winner + k) >> 1
        while node:
            if heads[losers[node]] < heads[winner]:
                losers[node], winner = winner, losers[node]
            node >>= 1


def lines_of(filesystem, path: str, ranges: list[dict], low: bytes | None, high: bytes | None) -> Iterator[bytes]:
    """Lines of a run's ranges from low on and below high, with one buffer."""
    for r in ranges:
        with filesystem.open_input_file(f"{path}/{r['file']}") as source:
            at, rest = r["offset"], b""
            while at < r["end"]:
                data = rest + source.read_at(min(BUFFER, r["end"] - at), at)
                at = min(at + BUFFER, r["end"])
                *whole, rest = data.split(b"\n")
                for line in whole:
                    line += b"\n"
                    if high is not None and line >= high:
                        return
                    if low is None or line >= low:
                        yield line


def pieces(manifest: DataFrame, fan_in: int, piece: int) -> DataFrame:
    """Merge tasks: group, piece, low, high, and the byte ranges of each run that hold lines between.

    The fences of a group are numbered in order and every piece-th starts a piece,
    so pieces of about equal size follow from the data, whatever its keys. A fence
    goes to the pieces from its own to that of the next fence of its file.
    """
    runs = numbered(manifest.select("run").distinct(), "run", "run_no").select(F.col("run").alias("of"), F.floor(F.col("run_no") / fan_in).alias("group"))
    fences = manifest.join(runs, F.col("run") == F.col("of")).select("group", "run", "file", "fence", "offset", "length", "first")
    order = numbered(fences.withColumn("at", F.struct("group", "first", "file", "fence")), "at", "no")
    order = cut(order, "fences")
    starts = order.groupBy("group").agg(F.min("no").alias("base")).withColumnRenamed("group", "g")
    placed = order.join(starts, F.col("group") == F.col("g")).withColumn("piece", F.floor((F.col("no") - F.col("base")) / piece)).drop("at", "no", "base", "g")
    upto = placed.select(F.col("file").alias("f"), (F.col("fence") - 1).alias("k"), F.col("piece").alias("last"))
    spans = placed.join(upto, (F.col("file") == F.col("f")) & (F.col("fence") == F.col("k"))).select("group", F.explode(F.sequence("piece", "last")).alias("piece"), "run", "file", "offset", "length", "first")
    ranges = spans.groupBy("group", "piece", "run", "file").agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("first").alias("first"))
    by_run = ranges.groupBy("group", "piece", "run").agg(F.sort_array(F.collect_list(F.struct("first", "file", "offset", "end"))).alias("ranges"))
    tasks = by_run.groupBy("group", "piece").agg(F.collect_list("ranges").alias("runs"))
    bounds = placed.groupBy("group", "piece").agg(F.min("first").alias("low"))
    nexts = bounds.select("group", (F.col("piece") - 1).alias("piece"), F.col("low").alias("high"))
    return tasks.join(bounds, ["group", "piece"]).join(nexts, ["group", "piece"], "left")


def dealt_pieces(tasks: DataFrame) -> tuple[DataFrame, int]:
    """Tasks as a table of one partition each, about, and their groups."""
    tasks = cut(tasks, "pieces")
    size = tasks.agg(F.count("*").alias("n"), F.countDistinct("group").alias("groups")).first()
    return tasks.repartition(max(1, size["n"]), "group", "piece"), size["groups"]


def merged(tasks: DataFrame, folder: str, level: int) -> DataFrame:
    """The manifest of the next level: a run for each group, a file for each of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                writer = RunWriter(folder, f"{level}-{row['group']}")
                for line in loser_tree([lines_of(filesystem, path, r, row["low"] if row["piece"] else None, row["high"]) for r in row["runs"]]):
                    writer.add(line)
                yield writer.close()

    return cut(tasks.mapInArrow(run, MANIFEST), "runs")


HISTORY = "piece long, seq long, url_key string, stamp string, record_type string, payload_digest string, length long, offset long, archive string"


def last_merge(tasks: DataFrame, folder: str) -> DataFrame:
    """The lines of the last level as rows; seq counts in a piece."""
    names = [c.split()[0] for c in HISTORY.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in HISTORY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = opened(folder)

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for seq, line in enumerate(loser_tree([lines_of(filesystem, path, r, row["low"] if row["piece"] else None, row["high"]) for r in row["runs"]])):
                    key, stamp, _, _, kind, digest, length, offset, archive = line.decode().rstrip("\n").split(" ")
                    rows.append((row["piece"], seq, key, stamp, kind, digest, int(length), int(offset), archive))
                    if len(rows) == 4096:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return cut(tasks.mapInArrow(run, HISTORY), "histories")


def histories(manifest: DataFrame, folder: str, fan_in: int = FAN_IN, piece: int = PIECE) -> DataFrame:
    """All captures, with `position`: their places, from 0, in the order of URL key, timestamp and id."""
    level = 0
    while True:
        tasks, groups = dealt_pieces(pieces(manifest, fan_in, piece))
        if groups <= 1:
            break
        level += 1
        manifest = merged(tasks, folder, level)
    rows = last_merge(tasks, folder)
    sizes = rows.groupBy("piece").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    before = running(sizes, "all", ["piece"], F.floor(F.col("piece") / 1024), F.col("n"), "base").select("piece", "base")
    return rows.join(before, "piece").withColumn("position", F.col("base") + F.col("seq")).drop("piece", "seq", "base")


# reading


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to, and what the index says (position, url_key, archive, offset), read from the archives; payload too where asked for."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("position", "url_key", "archive", "offset", "length", F.col("payload_digest").alias("said")).repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, position long, url_key string, archive string, offset long" + ", payload binary" * payloads
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = opened(folder)
        name, source = None, None
        for batch in slices(batches, RECORDS):
            rows = []
            for place in batch.to_pylist():
                if place["archive"] != name:
                    if source is not None:
                        source.close()
                    name, source = place["archive"], filesystem.open_input_file(f"{path}/{place['archive']}")
                headers, http, body = parsed_record(source.read_at(place["length"], place["offset"]))
                digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                if digest != place["said"] or (kind == "response" and (digest != base32(hashlib.sha1(body).digest()) or len(body) != int(http["content-length"]))):
                    raise ValueError(f"the payload at {place['offset']} of {name} isn't that of its digest")
                number = lambda x, headers=headers: int(headers[x]) if x in headers else None
                row = {k: place[k] for k in ("position", "url_key", "archive", "offset")} | {"id": number("capture-id"), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number("refers-to-capture-id")}
                rows.append(row | ({"payload": body if kind == "response" else None} if payloads else {}))
            yield pa.RecordBatch.from_pylist(rows, arrow)
        if source is not None:
            source.close()

    return places.mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, date: Column | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", **sizes: int) -> tuple[DataFrame, str]:
    """Writes every row of pages; the merged index of all captures, and the folder."""
    folder = folder or scratch(pages.sparkSession, "warc")
    captures = pages.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(date if date is not None else F.lit(None), F.timestamp_seconds(F.lit(0))).alias("date"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    manifest = written(resolved(captures), folder, **{k: v for k, v in sizes.items() if k in ("archive_bytes", "run_lines")})
    return cut(histories(manifest, folder, **{k: v for k, v in sizes.items() if k in ("fan_in", "piece")}), "capture-index"), folder
