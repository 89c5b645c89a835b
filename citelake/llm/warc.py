"""WARC archives of individually compressed records with a dictionary in a leading skippable frame.

Each archive is one Zstandard file: a skippable frame (magic 0x184D2A5D) that holds a dictionary built from this archive's own records,
then one frame for each WARC record, compressed with it. Records with equal payloads are written once, as a response; the
others are revisits that name it. Archives go through pyarrow's file systems to the folder that driver and executors share;
a file appears under its name only when it is whole, and a repeated task writes the same bytes under the same name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, blocks_for

SKIPPABLE = 0x184D2A5D
#: Bytes of a dictionary and of the records it is built from, for each archive; records are taken evenly over the archive.
DICT_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
#: Payload bytes of one archive, about.
ARCHIVE_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page {page_id}' if page_id is not None else f'row {at}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, at: int = 0) -> bytes:
    """One WARC 1.1 record; a revisit has no block. Fields named X-* are our own."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(page_id, at)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archive(records: list[bytes]) -> bytes:
    """The bytes of an archive. Without enough records for a dictionary the frame holds none."""
    import zstandard as z

    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples, used = [], 0
    for x in records[::step]:
        if used < SAMPLE_BYTES:
            samples.append(x[: 128 << 10])
            used += len(samples[-1])
    try:
        raw = z.train_dictionary(min(DICT_BYTES, max(1024, used // 8)), samples).as_bytes()
    except z.ZstdError:
        raw = b""
    c = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(raw) if raw else None)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(c.compress, records)])


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, in order. A block that does not fit its digest is an error."""
    import zstandard as z

    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = data[8 : 8 + n]
    d = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(raw) if raw else None)
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        o = d.decompressobj()
        parts, fed = [], at
        while not o.eof:
            parts.append(o.decompress(view[fed : fed + (1 << 16)]))
            fed = min(len(data), fed + (1 << 16))
        at = fed - len(o.unused_data)
        text = b"".join(parts)
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        yield fields, block


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write a record for each row of `pages` (page_id, url, html) into archives in `folder`, which must be shared.

    Null html: the empty payload; null url: no target. Of equal payloads of at least min_bytes the one with the smallest page_id is the
    response, and the others, rows without an id too, revisit it. Rows that share that id are all responses, as are rows without an id
    if no row with their payload has one. An empty table makes the folder and writes nothing.
    """
    path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"))
    total = rows.agg(F.sum(F.length("payload")).alias("n")).first()["n"]
    # Only payloads that occur twice are worth a join, and their digests come pre-aggregated.
    firsts = rows.filter(F.length("payload") >= min_bytes).groupBy(F.sha1("payload").alias("sha")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # The join keeps payloads out: it deals out ids and digests alone. Payloads are dealt out once, to their archives.
    keys = rows.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("size")).filter(F.col("size") >= min_bytes).distinct()
    refers = keys.join(firsts, "sha").filter(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()).select(F.col("page_id").alias("id_"), F.col("sha").alias("sha_"), "first")
    n = blocks_for(total, ARCHIVE_BYTES)
    at = lambda page, sha: F.pmod(F.xxhash64(page, sha), F.lit(n)).alias("archive")
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("sha")).select("*", at("page_id", "sha"))
    refers = refers.select("*", at("id_", "sha_"))

    def archive(table: pa.Table, refers: pa.Table) -> pa.Table:
        import pyarrow.fs as fs

        if not len(table):
            return pa.table({c: pa.array([], pa.int64()) for c in ("archive", "records", "bytes")})
        known = {(i, s): f for i, s, f in zip(*(refers.column(c).to_pylist() for c in ("id_", "sha_", "first")), strict=True)}

        order = table.select(["page_id", "url"]).append_column("n", pa.array(range(len(table)))).sort_by([("page_id", "ascending"), ("url", "ascending")]).column("n")
        table = table.take(order)
        data = write_archive([record(i, url, x, known.get((i, sha)), at) for at, (i, url, x, sha) in enumerate(zip(*(table.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha")), strict=True))])
        k = table.column("archive")[0].as_py()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(part := f"{root}/.{k:06d}-{uuid.uuid4().hex}") as f:
            f.write(data)
        store.move(part, f"{root}/{k:06d}.warc.zst")
        return pa.table({"archive": pa.array([k], pa.int64()), "records": pa.array([len(table)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    Stages(pages.sparkSession, "warc-manifest").put(rows.groupBy("archive").cogroup(refers.groupBy("archive")).applyInArrow(archive, "archive long, records long, bytes long"))


def read_warc(spark, folder: str) -> DataFrame:
    """Records of all archives in `folder`: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to. A folder without archives gives no rows."""
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = []
                for f, block in read_archive(data):
                    response = f["WARC-Type"] == "response"
                    rows.append((number(f.get("X-Page-ID")), f.get("WARC-Target-URI"), f["WARC-Type"], block if response else None, len(block) if response else int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), number(f.get("X-Refers-To-Page-ID"))))
                    if len(rows) == 1000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(read, schema)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = Stages(spark, "warc").path("archives")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(s, CAST((i // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
