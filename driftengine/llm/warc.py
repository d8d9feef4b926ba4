"""Write pages as dictionary-compressed WARC archives and read them back.

Every task cuts its pages into archives of bounded size. For each archive it trains a Zstandard
dictionary on the archive's own records, writes it as a leading skippable frame, and compresses each
record into a frame of its own, so that any record can be read alone. Copies of a payload are
written once: the others are revisit records that name the page holding it.

Files go straight to a folder that all executors share, through ``pyarrow.fs`` (local and mounted
paths, and the stores that library knows). A file's name holds the task attempt; only the files that
successful attempts report are in the manifest, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import hashlib
import io
import urllib.parse
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftengine.llm.common import shared_path, sized_join, stored

#: Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 24 << 20
#: The dictionary is trained on evenly spaced pieces of its archive's records, of about this many bytes.
TRAIN_BYTES, DICT_BYTES, PIECE_BYTES = 2 << 20, 64 << 10, 32 << 10
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Skippable frame that holds a dictionary (fixed value of the WARC Zstandard format).
DICT_MAGIC = (0x184D2A5D).to_bytes(4, "little")

MANIFEST = "file string, records long, payload_bytes long, file_bytes long"
RECORD = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to long, payload binary")


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every page.

    Of equal payloads (by SHA-256 and length) of at least ``REVISIT_BYTES`` the smallest page_id is
    the response. Rows that repeat its id are responses too; null ids are revisits of it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    copies = keyed.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = stored(copies.where("n > 1 and first is not null").select("digest", "first"), "copies")
    joined = sized_join(keyed, copies, "digest", width=120)
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest",
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first")).alias("refers_to"))


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _block(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _record(page: dict, date: str) -> bytes:
    payload, digest = page["payload"], page["digest"]
    target = urllib.parse.quote(page["url"], safe="%/:=&?~#+!$,;'@()*[]") if page["url"] else "urn:x-none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    fields = {
        "WARC-Type": page["record_type"], "WARC-Record-ID": _urn(page["page_id"], digest), "WARC-Date": date,
        "WARC-Target-URI": target, "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload))}
    if page["page_id"] is not None:
        fields["X-Page-ID"] = str(page["page_id"])
    if page["url"] is not None:
        fields["X-Page-URL"] = urllib.parse.quote(page["url"], safe="")
    if page["record_type"] == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = _urn(page["refers_to"], digest)
        fields["X-Refers-To-Page"] = str(page["refers_to"])
        return _block(fields, http.encode())
    return _block(fields, http.encode() + payload)


def _dictionary(records: list[bytes]) -> bytes:
    """Trained on evenly spaced pieces of the records, which are whole records but for long ones. Where
    there is too little to train on, the pieces themselves are the dictionary (as raw content)."""
    total = sum(map(len, records))
    size = max(64, min(PIECE_BYTES, total // 16))
    places = [(r, i) for r in records for i in range(0, len(r), size)]
    sample = [r[i:i + size] for r, i in places[::max(1, total // TRAIN_BYTES)]]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, sample)) // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICT_BYTES:]


def _write(folder: str, name: str, records: list[bytes], date: str) -> int:
    info = _block({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date,
                   "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
    raw = _dictionary(records)
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw))
    fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with fs.open_output_stream(path) as out:
        size += out.write(DICT_MAGIC + len(raw).to_bytes(4, "little") + raw)
        for record in [info, *records]:
            size += out.write(packer.compress(record))
    return size


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html); returns the manifest, stored.

    Null html is an empty payload; null ids and urls are left out of the record. Other columns are
    not archived. An empty table gives no archive.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        held, size, made = [], 0, []

        def close():
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.zst"
            made.append((f"{folder}/{name}", len(held), size, _write(folder, name, held, date)))

        for batch in batches:
            for at in range(batch.num_rows):
                page = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                held.append(_record(page, date))
                size += len(page["payload"])
                if size >= archive_bytes:
                    close()
                    held, size = [], 0
        if held:
            close()
        schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64()),
                            ("file_bytes", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], t) for i, t in enumerate(schema.types)], schema=schema)

    return stored(with_record_types(pages).mapInArrow(work, MANIFEST), "warc-manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive."""
    head = stream.read(8)
    raw = b""
    if head[:4] == DICT_MAGIC:
        raw, head = stream.read(int.from_bytes(head[4:], "little")), b""
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    source = io.BytesIO(head + stream.read()) if head else stream
    plain = io.BufferedReader(unpack.stream_reader(source, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := plain.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[key] = value
        block = plain.read(int(fields["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages of the archives in a manifest: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, and payload (null for revisits and without ``payloads``). Every payload is read and
    its digest compared with the record's; a difference raises."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

        for file in (f for b in batches for f in b.column("file").to_pylist()):
            fs, path = pafs.FileSystem.from_uri(file)
            rows, size = [], 0
            with fs.open_input_stream(path) as stream:
                for fields, block in _records(stream):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    digest = fields["WARC-Payload-Digest"].partition(":")[2]
                    payload = None
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    number = lambda k: int(fields[k]) if k in fields else None
                    url = fields.get("X-Page-URL")
                    rows.append((number("X-Page-ID"), None if url is None else urllib.parse.unquote(url),
                                 fields["WARC-Type"], number("X-Payload-Length"), digest,
                                 number("X-Refers-To-Page"), payload if payloads else None))
                    size += len(payload or b"") if payloads else 100
                    if size > 8 << 20:
                        yield flush()
                        rows, size = [], 0
            if rows:
                yield flush()

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files, "file").mapInArrow(work, RECORD)
