"""WARC archives: written as whole-file gzip, normalised to one member a record, read back by offset.

Spark's text writer makes the monolithic archives: a row is a record, the line separator is the pair of
line breaks that ends one, and the codec wraps the file in a single gzip stream. Such a file can only be
read from its start. The normaliser inflates each of them once as a stream, writes every record as a
gzip member of its own and notes in a sidecar index where each member lies, so that readers go straight
to ranges of records.

Archives lie in a folder that driver and executors share; tasks open them through ``pyarrow.fs``, which
knows local and mounted paths, HDFS, S3, GCS and Azure.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.store import scratch, stored

LEAST_BYTES = 1000  # equal payloads of so many bytes are stored once
RECORDS = 20_000  # in a monolithic archive, at most
CHUNK = 1 << 20  # bytes read, inflated or copied at once
RANGE = 4 << 20  # bytes of an archive that a reading task takes in one go
LEVEL = 6  # of the members' compression
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "archive string, start long, length long, record_type string, record_id string, page_id long, uri string"
_RECORD = "record_type string, record_id string, page_id long, uri string, refers_to_id string, payload_bytes long, payload_digest string, declared_digest string, sound boolean"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _uri(url: Column) -> Column:
    """A URL that can stand in a header line: blanks and control characters are percent-encoded."""
    out = F.replace(url, F.lit("\r"), F.lit("%0D"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))


def record_id(*parts: Column) -> Column:
    """A name derived from what the record holds: a rerun gives the same."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Add payload, payload_key, payload_bytes, payload_digest and keep_id: the page_id of the response that a revisit refers to, else null.

    Of equal payloads of ``least_bytes`` or more the row with the largest page_id is the response (all
    such rows, if it is repeated; a null page_id is least). The groups are aggregates of digests, so a
    payload on a third of all pages costs its rows and nothing more.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_key"))
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("payload_key").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1").select("payload_key", "keep_id"))
    found = rows.join(groups, "payload_key", "left")
    again = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    return found.select(
        "page_id", "url", "payload", "payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.when(again, F.col("keep_id")).alias("keep_id"),
    )


def records(found: DataFrame, date: str = DATE) -> DataFrame:
    """One column ``value``: the whole record of each row of ``revisits``, but for the two line breaks that end it."""
    again = F.col("keep_id").isNotNull()
    uri = _uri(F.coalesce("url", F.lit("urn:x-unknown:")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    of = lambda page_id: record_id(F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("-")), F.col("payload_key"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", of(F.col("page_id"))),
        F.when(F.col("page_id").isNull(), "").otherwise(_line("WARC-Page-ID", F.col("page_id").cast("string"))),
        _line("WARC-Target-URI", uri),
        _line("WARC-Date", F.lit(date)),
        F.when(again, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", of(F.col("keep_id"))))).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return found.select(F.concat(head, block).alias("value"))


def write_monolithic(found: DataFrame, path: str, records_per_file: int = RECORDS) -> None:
    """Archives of one gzip stream each, committed by Spark's own protocol."""
    writer = records(found).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    writer.text(path)


class Header(NamedTuple):
    fields: dict[str, str]
    size: int  # bytes of the block

    @classmethod
    def parse(cls, raw: bytes) -> Header:
        lines = raw.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:60]!r}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        return cls(fields, int(fields["content-length"]))

    def page_id(self) -> int | None:
        return int(self.fields["warc-page-id"]) if "warc-page-id" in self.fields else None


class _Inflated:
    """A gzip stream of one or more members, inflated piece by piece."""

    def __init__(self, source):
        self.source, self.inflater, self.pending, self.ended = source, zlib.decompressobj(31), b"", False

    def read(self) -> bytes:
        """Some more bytes, none at the end."""
        while not self.ended:
            raw = self.pending or self.source.read(CHUNK)
            self.pending = b""
            if not raw:
                self.ended = True
                break
            out = self.inflater.decompress(raw, CHUNK)
            if self.inflater.eof:
                self.pending, self.inflater = self.inflater.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            else:
                self.pending = self.inflater.unconsumed_tail
            if out:
                return out
        return b""


def split_stream(source) -> Iterator[tuple[Header, bytes, Iterator[bytes]]]:
    """(header, its bytes, pieces of the block) of each record. The pieces must be used up before the next record; no record is held whole."""
    stream, buffer = _Inflated(source), bytearray()
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            piece = stream.read()
            if not piece:
                if buffer.strip(b"\r\n"):
                    raise ValueError("the archive ends inside a header")
                return
            buffer += piece
            while buffer.startswith(b"\r\n"):
                del buffer[:2]
        head = bytes(buffer[: end + 4])
        del buffer[: end + 4]
        header = Header.parse(head[:-4])

        def block(left: int = header.size) -> Iterator[bytes]:
            while left:
                if not buffer:
                    piece = stream.read()
                    if not piece:
                        raise ValueError("the archive ends inside a record")
                    buffer.extend(piece)
                out = bytes(buffer[:left])
                del buffer[: len(out)]
                left -= len(out)
                yield out

        yield header, head, block()
        while len(buffer) < 4 and (piece := stream.read()):
            buffer += piece
        if buffer[:4] != b"\r\n\r\n":
            raise ValueError("a record does not end with two line breaks")
        del buffer[:4]


def _normaliser(folder: str, level: int):
    """Arrow task: rewrite each archive of a batch with a member a record; yields the index rows.

    The name of a rewritten archive holds a fresh token: what a lost or repeated attempt has left is in
    no index, and the index is committed by Spark.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source_fs, source_path = fs.FileSystem.from_uri(path)
                target_fs, target_path = fs.FileSystem.from_uri(folder)
                target_fs.create_dir(target_path, recursive=True)
                name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt")
                target = f"{target_path}/{name}-{uuid.uuid4().hex[:12]}.warc.gz"
                index, start = [], 0
                with source_fs.open_input_stream(source_path, compression=None) as source, target_fs.open_output_stream(target, compression=None) as out:
                    for header, head, block in split_stream(source):
                        member, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                        for piece in (head, *()):
                            length += out.write(member.compress(piece)) or 0
                        for piece in block:
                            length += out.write(member.compress(piece)) or 0
                        length += out.write(member.compress(b"\r\n\r\n") + member.flush()) or 0
                        f = header.fields
                        index.append((f"{folder}/{target.rsplit('/', 1)[-1]}", start, length, f["warc-type"], f["warc-record-id"], header.page_id(), f.get("warc-target-uri")))
                        start += length
                        if len(index) >= 10_000:
                            yield _index_rows(index)
                            index = []
                if index:
                    yield _index_rows(index)

    return run


def _index_rows(index: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["archive", "start", "length", "record_type", "record_id", "page_id", "uri"]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*index), kinds)], names)


def normalise(spark: SparkSession, monolithic: str, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite the archives under ``monolithic`` into ``folder``/archives; returns the sidecar index, a table in ``folder``/index.

    archive, start, length (of the member, in bytes), record_type, record_id, page_id, uri. Files are
    dealt to tasks by their sizes; a task streams one after the other and holds a piece of one record.
    """
    files = spark.read.format("binaryFile").load(monolithic).select("path", "length")  # names only, no content is read
    index = files.filter("length > 0").select("path").mapInArrow(_normaliser(f"{folder}/archives", level), _INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def _read_member(raw: bytes) -> tuple:
    """What one member holds, its payload measured anew."""
    (header, _, block), = _one(raw)
    f, body = header.fields, block
    http, _, payload = body.partition(b"\r\n\r\n")
    declared = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if f["warc-type"] == "revisit":  # the payload lies with another record; the block tells its length
        size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        digest, sound = declared, True
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        sound = digest == declared
    return f["warc-type"], f["warc-record-id"], header.page_id(), f.get("warc-target-uri"), f.get("warc-refers-to"), size, digest, declared, sound


def _one(raw: bytes) -> list[tuple[Header, bytes, bytes]]:
    return [(header, head, b"".join(block)) for header, head, block in split_stream(pa.BufferReader(raw))]


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: the records at the indexed places, rows sorted by place."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in _RECORD.split(", ")]
    open_uri, source = None, None
    for batch in batches:
        out = []
        for uri, start, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "length"))):
            if uri != open_uri:
                if source:
                    source.close()
                of, path = fs.FileSystem.from_uri(uri)
                source, open_uri = of.open_input_file(path), uri
            out.append(_read_member(source.read_at(length, start)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names)
    if source:
        source.close()


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index, each from its own member: type, ids, uri, payload size and digest, whether the digest holds.

    An archive is read in ranges of some megabytes by many tasks; each moves forward only.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = index.select("archive", "start", "length").repartition(tasks, "archive", F.floor(F.col("start") / RANGE))
    return ranges.sortWithinPartitions("archive", "start").mapInArrow(_reader, _RECORD)


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, sound.

    A null html is an empty payload; a null url is written as ``urn:x-unknown:`` and a null page_id
    has no number of its own. Repeated rows are records of their own. Line breaks in a url are
    percent-encoded. A revisit is ``sound`` if the record it refers to is there and has the digest that
    it names; a response if its payload has. No rows give no archives and no rows.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark)
    write_monolithic(revisits(pages, least_bytes), f"{folder}/monolithic")
    read = stored(read_records(normalise(spark, f"{folder}/monolithic", folder)))
    responses = read.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_digest").alias("held"), F.max("payload_bytes").alias("held_bytes")
    )
    # only those that revisits name, so the join stays as small as they are
    linked = read.filter("record_type = 'revisit'").join(responses, "refers_to_id", "left")
    sound = (F.col("held") == F.col("declared_digest")) & (F.col("held_bytes") == F.col("payload_bytes"))
    columns = ["page_id", F.col("uri").alias("url"), "payload_bytes", "payload_digest", "record_type"]
    return read.filter("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to"), "sound").union(
        linked.select(*columns, "refers_to", F.coalesce(sound, F.lit(False)).alias("sound"))
    )
