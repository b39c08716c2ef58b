"""WARC archives with an index of byte ranges, and reads of selected records in coalesced ranges.

Each record is a gzip member of its own. While a task writes its archive file it gives out one index
row per record: file, offset, length, address, digest. Readers select index rows first, sort them by
place and fetch neighbours in one read. Files go through ``pyarrow.fs``; a folder without a scheme is one of
Spark's default file system, as everywhere in Spark.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from passarank.llm.common import open_folder, qualified
from passarank.plans.sizing import durable, scratch_path, small

LEAST_BYTES = 1000  # smaller equal payloads are stored each
FILE_BYTES = 1 << 30  # an archive file ends after this many bytes
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10  # the longest read, and what is read over between two records
PART_BYTES = 32 << 20  # archive bytes per reading task
DATE = "2000-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def record_id(page):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page, url, payload, digest, kind, refers_to, size, date=DATE):
    """The bytes of one record before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + _END
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", record_id(refers_to)))
    head = "WARC/1.1\r\n" + "\r\n".join(f"{name}: {value}" for name, value in fields)
    return head.encode("utf-8", "surrogatepass") + _END + block + _END


def parse(data):
    """(fields, payload, payload size, payload digest) of the bytes of one record."""
    head, _, rest = data.partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_END)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "revisit":
        return fields, None, size, digest
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, payload, size, digest


_INDEX = "file string, offset bigint, length bigint, url string, digest string, size bigint, record_type string"


def _writer(folder, level, file_bytes):
    """Arrow batches of (page_id, url, payload, digest, size, record_type, refers_to) to index rows."""

    def write(batches):
        system, base = open_folder(folder)
        out, file, offset = None, None, 0
        for batch in batches:
            pages, urls, payloads, digests, sizes, kinds, refers = (c.to_pylist() for c in batch.columns)
            files, offsets, lengths = [], [], []
            for row, page in enumerate(pages):
                if out is None:
                    # A name of its own for every attempt: what a lost task wrote is in no index.
                    file, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{file}", compression=None)
                data = record(page, urls[row], payloads[row], digests[row], kinds[row], refers[row], sizes[row])
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out.write(member)
                files.append(file)
                offsets.append(offset)
                lengths.append(len(member))
                offset += len(member)
                if offset >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(6), pa.array(files, pa.string()), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64()), batch.column(1), batch.column(3), batch.column(4), batch.column(5)],
                ["page_id", "refers_to", "file", "offset", "length", "url", "digest", "size", "record_type"],
            )
        if out is not None:
            out.close()

    return write


def write_archive(
    pages, folder=None, id_col="page_id", url_col="url", payload_col="html", least_bytes=LEAST_BYTES, level=4, file_bytes=FILE_BYTES
):
    """Write a record per row and return (folder, stored index).

    The index has ``page_id``, ``refers_to``, ``file``, ``offset``, ``length``, ``url``, ``digest`` (hexadecimal
    SHA-1 of the payload), ``size`` of the payload and ``record_type``. Of rows with equal payloads of at
    least ``least_bytes`` bytes, those with the largest id are responses and the others revisits that
    refer to it; with null ids only, all are responses. Smaller payloads are all responses. A null
    payload is empty, a null address is left out of the record. Rows may repeat.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "warc"))
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    copies = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("original"))
    copies = durable(copies.filter("n > 1 AND original IS NOT NULL").select(F.col("digest").alias("of"), "original"), "copies")
    joined = rows.join(small(copies), F.col("digest") == F.col("of"), "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    kinds = joined.select(
        "page_id", "url", "payload", "digest", "size",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("original")).alias("refers_to"),
    )
    id_type = kinds.schema["page_id"].dataType.simpleString()
    index = kinds.mapInArrow(_writer(folder, level, file_bytes), f"page_id {id_type}, refers_to {id_type}, {_INDEX}")
    return folder, durable(index, "warc-index")


def ranges(rows, read_bytes, gap_bytes):
    """Lists of consecutive (offset, length, …) rows of one file that one read fetches."""
    held = []
    for row in rows:
        if held and (row[0] > stop + gap_bytes or row[0] + row[1] - held[0][0] > read_bytes):
            yield held
            held = []
        held.append(row)
        stop = row[0] + row[1]
    if held:
        yield held


def _reader(folder, read_bytes, gap_bytes):
    """Arrow batches of (file, offset, length, page_id, refers_to), sorted, to the records' contents."""

    def read(batches):
        system, base = open_folder(folder)
        name, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            order = range(batch.num_rows)
            start = 0
            while start < len(order):
                stop = start
                while stop < len(order) and files[stop] == files[start]:
                    stop += 1
                if files[start] != name:
                    if source is not None:
                        source.close()
                    name, source = files[start], system.open_input_file(f"{base}/{files[start]}")
                for group in ranges([(offsets[i], lengths[i], i) for i in range(start, stop)], read_bytes, gap_bytes):
                    first = group[0][0]
                    data = source.read_at(group[-1][0] + group[-1][1] - first, first)
                    found = [parse(zlib.decompress(data[o - first : o - first + n], 31)) for o, n, _ in group]
                    taken = batch.slice(group[0][2], len(group))
                    for (fields, *_), page in zip(found, taken.column(4).to_pylist()):
                        if fields.get("WARC-Refers-To") != (record_id(page) if fields["WARC-Type"] == "revisit" else None):
                            raise ValueError(f"{fields['WARC-Record-ID']} does not refer to the record that the index names")
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(3), taken.column(4),
                         pa.array([f[0].get("WARC-Target-URI") for f in found], pa.string()),
                         pa.array([f[0]["WARC-Type"] for f in found], pa.string()),
                         pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.int64()),
                         pa.array([f[3] for f in found], pa.string())],
                        ["page_id", "refers_to", "url", "record_type", "payload", "payload_bytes", "payload_digest"],
                    )
                start = stop
        if source is not None:
            source.close()

    return read


def read_records(index, folder, read_bytes=READ_BYTES, gap_bytes=GAP_BYTES, part_bytes=PART_BYTES):
    """The records of the given index rows (all or any selection), read by sorted byte ranges.

    Returns ``page_id``, ``refers_to``, ``url``, ``record_type``, ``payload`` (null for a revisit, which holds
    none), ``payload_bytes`` and ``payload_digest``: of a response computed from what was read and checked
    against the record, of a revisit taken from its headers. Records that lie within ``gap_bytes`` are
    fetched in one read of at most ``read_bytes``. Only index rows are shuffled.
    """
    spark, folder = index.sparkSession, qualified(index.sparkSession, folder)
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // part_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))
    id_type = index.schema["page_id"].dataType.simpleString()
    stretch = F.floor(F.col("offset") / read_bytes)
    placed = (
        index.select("file", "offset", "length", "page_id", "refers_to")
        .repartition(parts, "file", stretch).sortWithinPartitions("file", "offset")
    )
    return placed.mapInArrow(
        _reader(folder, read_bytes, gap_bytes),
        f"page_id {id_type}, refers_to {id_type}, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string",
    )
