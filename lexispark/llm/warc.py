"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

Each archive's dictionary is trained from its own records and embedded in a leading
skippable frame, so an archive is self-contained; every record is a frame of its own,
so any record can be read alone from its offset. Archives are rows of a
binary column, which any store that Spark can write takes; export() puts one in a local file.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches

#: Fixed values of the format: the skippable frame that holds a dictionary.
SKIPPABLE_MAGIC = 0x184D2A5D
#: Fixed values of the format: revisits by equal payloads.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
#: Uncompressed bytes of records in an archive, about; a larger record has an archive of its own.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: A dictionary is trained on records spread evenly over the archive, of so many bytes together.
TRAINING_BYTES = 2 << 20
#: Shorter equal payloads aren't replaced by revisits.
LEAST_REVISIT = 100


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """A record's own name: rows that are equal otherwise are told apart by their number."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {copy} {digest} {url}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int = 0, refers_to: tuple[int, str | None] | None = None) -> bytes:
    """One record: version, named fields, blank line, block, two line ends. A revisit refers to the record of a page and its url."""
    block = payload if refers_to is None else b""
    target = lambda url: (url or "").replace("\r", "%0D").replace("\n", "%0A") or "urn:none"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, digest, copy)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Page-ID", "" if page_id is None else f"{ID_PREFIX}{page_id}"),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        page, at = refers_to
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(page, at, digest, 0)), ("WARC-Refers-To-Target-URI", target(at)), ("WARC-Refers-To-Page-ID", f"{ID_PREFIX}{page}")]
    fields.append(("Content-Length", str(len(block))))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread evenly over the archive; of too few or too short ones, their own content, as far as it fits; empty if there are none."""
    step = max(1, -(-sum(map(len, records)) // TRAINING_BYTES))
    ends = itertools.accumulate(map(len, records[::step]))
    samples = [r for r, end in zip(records[::step], ends, strict=True) if end <= TRAINING_BYTES] or [records[0][:TRAINING_BYTES]] if records else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def archive_bytes(records: list[bytes]) -> tuple[bytes, list[int]]:
    """The archive of records, and each record's offset in it."""
    raw = train_dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(raw)
    parts, offsets = [struct.pack("<II", SKIPPABLE_MAGIC, len(packed)), packed], []
    at = sum(map(len, parts))
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
    for r in records:
        parts.append(writer.compress(r))
        offsets.append(at)
        at += len(parts[-1])
    return b"".join(parts), offsets


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    left = data[8 + n :]
    view = memoryview(left)
    while len(view):
        one = reader.decompressobj()
        # A frame's end isn't stored: it is found by feeding pieces, larger ones for larger frames.
        size, fed, out = zstandard.frame_content_size(view[:32].tobytes()), 0, []
        step = max(4096, size // 2)
        while not one.eof and fed < len(view):
            out.append(one.decompress(view[fed : fed + step]))
            fed += step
        view = view[min(fed, len(view)) - len(one.unused_data) :]
        record = b"".join(out)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def revisit_plan(slim: DataFrame) -> DataFrame:
    """(digest, first, first_url): of each payload that several rows (page_id, url, digest, size, rows) share and that is long enough, the smallest page_id, and its smallest url."""
    long_enough = slim.where(F.col("size") >= LEAST_REVISIT)
    found = long_enough.groupBy("digest").agg(F.sum("rows").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    return found.where("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, records, offsets), a row per archive, read from the shared folder.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, the smallest page_id's is a response, and so are
    repeated rows of that id; others, those without an id too, revisit it. If none has an id, all are responses. Null html
    is an empty payload. Each record has a name of its own, also where rows are equal, and a revisit's reference is the name of a response. Other columns are ignored. Pages may be of any length. An empty table gives no archive.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    scratch = Scratch(pages.sparkSession, "warc")
    slim = scratch.table(rows.groupBy("page_id", "url", "digest").agg(F.first(F.octet_length("html")).alias("size"), F.count("*").alias("rows")), "slim", keep=True)
    first = scratch.table(revisit_plan(slim), "first", keep=True)
    # Rows that are equal are one row here, and as many again, with numbers, when they are written.
    repeated = scratch.table(slim.where("rows > 1").select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("digest").alias("d"), F.col("rows").alias("n")), "repeated", keep=True)
    same = F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("digest") == F.col("d"))
    if repeated.limit(1).count():
        again = rows.join(repeated, same, "left_semi").groupBy("page_id", "url", "digest").agg(F.first("html").alias("html")).join(repeated, same)
        again = again.select("page_id", "url", "html", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
        rows = rows.join(repeated, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(again)
    else:
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", "copy", F.when(revisit, F.col("first")).alias("refers_to"), "first_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0

        def archive() -> pa.RecordBatch:
            data, offsets = archive_bytes(records)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([len(records)], pa.int64()), pa.array([offsets], pa.list_(pa.int64()))], names=["archive", "records", "offsets"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                for r in whole.slice(lo, 256).to_pylist():
                    records.append(record_bytes(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["copy"], None if r["refers_to"] is None else (r["refers_to"], r["first_url"])))
                    size += len(records[-1])
                    if size >= ARCHIVE_BYTES:
                        yield archive()
                        records, size = [], 0
        if records:
            yield archive()

    return scratch.table(map_batches(marked, write, "archive binary, records long, offsets array<long>"), "archives", keep=True)


def read_records(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, html, record_id, refers_to_record) of each record; a revisit has no html here.

    A response's length and digest are computed from its block, and must be what its fields say.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("archive"):
                rows = []
                for f, block in read_archive(data.as_buffer().to_pybytes()):
                    said = (int(f["WARC-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:"))
                    response = f["WARC-Type"] == "response"
                    if response and said != (len(block), hashlib.sha256(block).hexdigest()):
                        raise ValueError(f"a record's payload isn't what its fields say: {f['WARC-Record-ID']}")
                    page = f["WARC-Page-ID"].removeprefix(ID_PREFIX)
                    rows.append((int(page) if page else None, f["WARC-Target-URI"], f["WARC-Type"], *said, None if response else int(f["WARC-Refers-To-Page-ID"].removeprefix(ID_PREFIX)), block.decode() if response else None, f["WARC-Record-ID"], f.get("WARC-Refers-To")))
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html", "record_id", "refers_to_record")
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_batches(archives.select("archive"), read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string, record_id string, refers_to_record string")


def export(archives: DataFrame, number: int, path: str) -> None:
    """Writes the archive at a place in (size, bytes) order to a local file, conventionally *.warc.zst."""
    row = archives.orderBy(F.length("archive"), F.xxhash64("archive")).select("archive").offset(number).limit(1).first()
    with open(path, "wb") as f:
        f.write(bytes(row["archive"]))
