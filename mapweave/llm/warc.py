"""Operator 8, WARC: writing, a normaliser for monolithic gzip, and reading back by offset.

Archives are first written the way many tools do: a whole file is one gzip stream, which can only be read
from its start. The normaliser inflates each such stream once, piece by piece, writes every record as a gzip member of its own
and a sidecar index (offset and length of each member) beside it. Records are then read by their offsets.
Files are written by the tasks through Arrow's file systems, to a name of the task's own first and then moved,
so that a task that runs again replaces what an earlier attempt left.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.runtime import materialize, shared_path

INDEX = "file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
#: The upper half of every record id; the lower half is the page id.
_SPACE = 0x6D61707765617665
_DATE = "2024-01-01T00:00:00Z"
_READ = 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(_SPACE << 64) | (page & (1 << 64) - 1))}>"


def _page_of(record_id: str) -> int:
    low = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response record, or a revisit record without the payload where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = "".join(c for c in url or "" if c > " ")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page) if page is not None else f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(payload).digest())}>",
        "WARC-Date": _DATE,
        **({"WARC-Target-URI": clean} if clean else {}),
        **({} if page is not None else {"X-No-Id": "1"}),
        **({"WARC-Refers-To": _record_id(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if refers_to is not None else {}),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece."""
    left, member = b"", zlib.decompressobj(31)
    while chunk := left or stream.read(_READ):
        left = b""
        if out := member.decompress(chunk, _READ):
            yield out
        if member.eof:
            left, member = member.unused_data, zlib.decompressobj(31)
        else:
            left = member.unconsumed_tail
    if out := member.flush():
        yield out


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, each with its trailing blank lines."""
    held = bytearray()
    size = 0
    for piece in pieces:
        held += piece
        while True:
            if not size:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
                size = end + 4 + int(fields["Content-Length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
            size = 0
    if held:
        raise ValueError("the archive ends inside a record")


def _moved(path: str, write) -> None:
    """Write a file under a name of its own, then give it its name."""
    system, place = _open(path)
    own = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as out:
        write(out)
    system.move(own, place)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, digest, refers_to) as WARC files that are one gzip stream each; (file, records) of each."""
    folder = _uri(folder)

    def run(batches):
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        count = 0

        def write(out):
            nonlocal count
            stream = zlib.compressobj(6, zlib.DEFLATED, 31)
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(stream.compress(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"])))
                    count += 1
            out.write(stream.flush())

        _make(folder)
        _moved(name, write)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], ["file", "records"])

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "file string, records long")


def _uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else path


def _make(folder: str) -> None:
    system, place = _open(folder)
    system.create_dir(place, recursive=True)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each file of files.file with a member for each record; the index rows (file, offset, length).

    Beside each file lies its index as lines of JSON, name.idx. Members of the input may hold any number of records. Names begin with a
    hash of the input's path, so that files of one name in several folders stay apart. No files give no rows.
    """
    folder = _uri(folder)

    def one(file: str):
        name = f"{folder}/{hashlib.sha1(file.encode()).hexdigest()[:12]}-{file.rpartition('/')[2]}"
        rows: list[tuple[int, int]] = []
        system, place = _open(file)

        def write(out):
            at = 0
            with system.open_input_stream(place, compression=None) as stream:
                for data in records(inflated(stream)):
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = member.compress(data) + member.flush()
                    out.write(packed)
                    rows.append((at, len(packed)))
                    at += len(packed)

        _make(folder)
        _moved(name, write)
        _moved(f"{name}.idx", lambda out: out.write("".join(json.dumps({"offset": o, "length": n}) + "\n" for o, n in rows).encode()))
        return name, rows

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                name, rows = one(file)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))], ["file", "offset", "length"])

    return files.select("file").mapInArrow(run, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """The records at the places of an index; html is null for revisits."""

    def run(batches):
        for batch in batches:
            held, stream, out = None, None, []
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != held:
                    system, place = _open(file)
                    held, stream = file, system.open_input_file(place)
                stream.seek(offset)
                fields, block = parse(zlib.decompress(stream.read(length), 31))
                head, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))
                first = fields["WARC-Type"] == "response"
                refers = None if first else _page_of(fields["WARC-Refers-To"])
                page = None if "X-No-Id" in fields else _page_of(fields["WARC-Record-ID"])
                if first and payload_digest(payload) != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"{file} at {offset}: the payload isn't what its digest says")
                out.append((page, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], refers, payload.decode() if first else None))
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return index.select("file", "offset", "length").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): which pages repeat the payload of another.

    Of pages with equal payloads of at least least_bytes bytes the one with the largest id has a null refers_to, the others
    refer to it. A null html is an empty payload. Rows that repeat that page's id and payload stay responses too, and so do
    pages with a null id, which nothing can refer to. Extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests = [payload_digest((x.as_py() or "").encode()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(digests, pa.string())], ["page_id", "url", "html", "digest"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    own = own.mapInArrow(run, "page_id long, url string, html string, digest string")
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    often = own.filter(size >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("rows")).filter("rows > 1").select("digest", "last")
    joined = own.join(often, "digest", "left")
    refers = F.when((size >= least_bytes) & (F.col("page_id") < F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Index rows of the normalised archives of pages, written to the shared folder.

    Every row is a record: null and empty html, null ids and repeated rows as with_revisits() says. Without pages there are no records.
    """
    spark: SparkSession = pages.sparkSession
    folder = shared_path(spark, "warc")
    written = materialize(write_monolithic(with_revisits(pages, least_bytes), f"{folder}/whole"), "written")
    files = written.filter("records > 0").repartition(max(1, written.count()), "file")
    return materialize(normalise(files, f"{folder}/members"), "index")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages, normalise the archives, and read every record back by its offset: a row for each page, odd ones as in with_revisits()."""
    index = archive(pages, least_bytes)
    return read_records(index.sortWithinPartitions("file", "offset")).drop("html")
