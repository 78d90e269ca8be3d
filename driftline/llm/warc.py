"""WARC archives with dictionary-compressed records.

Every archive is a Zstandard stream whose leading skippable frame holds a
dictionary built from the archive's own records; each record is then a frame
of its own, compressed with that dictionary, so any record can be read alone.
Payloads that repeat are written once and revisited after that.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.storage import fresh_path, staged

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 100
DICTIONARY_BYTES = 64 << 10
#: The dictionary is built from an archive's first records, of about this many bytes together.
SAMPLE_BYTES = 4 << 20
#: Fewer records aren't trained on.
LEAST_TRAINED = 16
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 and Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
TRAINED_MAGIC = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NAMESPACE = uuid.UUID("6f1c4a52-2a57-4d6e-9a55-0d0f3c1f8f01")


# --- records ---


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` it is a revisit and has no payload."""
    clean = "".join(c for c in (url or "") if c not in "\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if clean:
        fields.append(("WARC-Target-URI", clean))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("WARC-Refers-To-Page-ID", str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and the full payload's length of one record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = next(int(h.split(b": ")[1]) for h in http.split(b"\r\n") if h.startswith(b"Content-Length: "))
    return fields, payload, length


# --- archives ---


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary built from records: trained on them or, where they are too few for that, their content itself."""
    samples = [x for x in samples if x]
    size = sum(map(len, samples))
    if len(samples) >= LEAST_TRAINED and size >= LEAST_TRAINED * 256:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 16)), samples)
        except zstandard.ZstdError:
            pass  # alike or unlike one another beyond what the trainer takes
    content = b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0")
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out: io.IOBase, records: Iterator[bytes]) -> tuple[int, int]:
    """Write records to a stream; returns their number and bytes before compression."""
    first: list[bytes] = []
    size = 0
    for data in records:
        first.append(data)
        size += len(data)
        if size >= SAMPLE_BYTES:
            break
    known = dictionary(first)
    content = known.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
    count = total = 0
    for part in (first, records):
        for data in part:
            out.write(compressor.compress(data))
            count, total = count + 1, total + len(data)
    return count, total


def read_archive(source: io.IOBase, chunk: int = 4 << 20) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    head = source.read(8)
    magic, length = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    content = source.read(length)
    # Trained dictionaries say what they are; any other content is used as it is.
    trained = content[:4] == struct.pack("<I", TRAINED_MAGIC)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    pending = b""
    frame, parts = decompressor.decompressobj(), []
    while True:
        if not pending:
            pending = source.read(chunk)
            if not pending:
                break
        parts.append(frame.decompress(pending))
        pending = b""
        if frame.eof:
            yield b"".join(parts)
            pending = frame.unused_data
            frame, parts = decompressor.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


# --- Spark operators ---


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a path with its scheme, as :func:`fresh_path` makes them."""
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def planned(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each page's record will be.

    Of equal payloads of ``least`` bytes or more, the smallest page_id responds
    and the others refer to it; rows that share that page_id all respond, and so
    do shorter payloads.  A null html is an empty payload.  Where all page_ids of a payload
    are null, all of them respond.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Only digests that repeat are joined, each as one row however many copies it has.
    first = (
        pages.select("page_id", payload.alias("payload"))
        .filter(F.octet_length("payload") >= least)
        .groupBy(F.sha2("payload", 256).alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one archive a task below ``folder``; returns ``path, records, bytes`` of each.

    An archive is written under a name of the attempt and then moved into
    place, so a task that is run again leaves one whole archive.  ``folder``
    names its file system (``hdfs://``, ``file:/``, ...); page_ids are whole numbers.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _file_system(folder)
        name = f"{root}/part-{context.partitionId():05d}.warc.zst"
        part = f"{root}/.attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}"

        def records() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
                for i in range(batch.num_rows):
                    page_id, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                    yield record(page_id, url, payload, digest, refers_to)

        todo = records()
        head = next(todo, None)
        if head is None:
            return

        def all_records() -> Iterator[bytes]:
            yield head
            yield from todo

        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(part, compression=None) as out:
            count, total = write_archive(out, all_records())
        fs.move(part, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([count], pa.int64()), pa.array([total], pa.int64())], ["path", "records", "bytes"]
        )

    return staged(planned(pages).mapInArrow(each, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of every archived record.

    The digest of a response is computed from its payload and must agree with the header.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as source:
                    for data in read_archive(source):
                        fields, payload, length = parsed(data)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                            raise ValueError(f"{path}: a payload doesn't agree with its digest")
                        ids = [int(fields[k]) if k in fields else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
                        rows.append((ids[0], fields.get("WARC-Target-URI"), length, digest, kind, ids[1]))
                        if len(rows) >= 5000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    spread = archives.select("path").repartition(max(1, archives.count()))
    return spread.mapInArrow(each, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the session's shared folder and read the archives back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
