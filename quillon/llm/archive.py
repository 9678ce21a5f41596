"""Legacy ARC archives to WARC.

ARC files start with a ``filedesc`` record that names the version and the fields of the header lines;
version 1 lines have five fields, version 2 lines ten. Records are cut by their declared lengths. Each
record gets the WARC fields it lacks: an identifier made from its address, date and payload, an ISO
timestamp, a type and a SHA-256 payload digest. Of records with equal payloads of at least
``min_revisit`` bytes the one with the least key is the response, the others are revisits of it.

Archives are written by Spark's own text writer (whose commit survives lost executors, on any file
system Spark knows): both formats end each record with a line feed, which is the writer's separator. An
archive is read as one binary file, a task each, decompressed as it is parsed.

Nulls: a null payload is an empty one, a null address is ``-``. A record without a key is a response
unless an equal payload has a key; it never stands for others that have one. Repeated rows are records
of their own: of those with the same least key all are responses. Empty tables give empty archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.storage import materialize, new_path, read_table, remove

#: The fields of ARC header lines by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY_HEADER = "X-Page-Id"
MIN_REVISIT = 100
#: An archive is read by one task, so it is closed after so many records.
FILE_RECORDS = 10_000
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quillon:archive")


def address(url: str | None) -> str:
    """A url as ARC and WARC lines can hold it: white space, controls and non-ASCII characters escaped."""
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url else "-"


def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 quillon\n{ARC_FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain " + ("" if version == 1 else f"200 - - 0 {name} ") + str(len(body))
    return line.encode() + b"\n" + body


def arc_record(version: int, name: str, url: str, ip: str, date: str, mime: str, content: bytes) -> bytes:
    """Without the line feed that ends it."""
    extra = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - 0 {name} "
    return f"{url} {ip} {date} {mime} {extra}{len(content)}\n".encode() + content


def _stream(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of one ARC file: url, ip, date, mime, content. Raises ValueError on a torn or unknown file."""
    file, fields = _stream(content), []
    while line := file.readline():
        if line in (b"\n", b"\r\n"):
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not fields:
            if not text.startswith("filedesc://"):
                raise ValueError("an ARC file starts with a filedesc record")
            head = file.read(int(text.rsplit(" ", 1)[1])).decode().splitlines()
            version = int(head[0].split()[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = (head[1] if len(head) > 1 else ARC_FIELDS[version]).split()
            continue
        # the url may hold blanks in old files: the other fields are counted from the right
        row = dict(zip(fields, text.rsplit(" ", len(fields) - 1), strict=True))
        body = file.read(n := int(row["Archive-length"]))
        if len(body) < n:
            raise ValueError("torn ARC record")
        yield {"url": row["URL"], "ip": row["IP-address"], "date": row["Archive-date"], "mime": row["Content-type"], "content": body}


def split_http(content: bytes) -> tuple[bytes, bytes]:
    head, found, payload = content.partition(b"\r\n\r\n")
    return (head, payload) if found else (b"", content)


def header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode() or None
    return None


def write_arc(pages: DataFrame, path: str, id_col: str, url_col: str, html_col: str, date: str = "20240101000000") -> None:
    """One ARC file for each partition, versions 1 and 2 by turns; the page's key is in its HTTP headers."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part}.arc"
        yield pa.RecordBatch.from_pydict({"value": pa.array([arc_head(version, name)], pa.binary())})
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                piece, out = batch.slice(k, 200), []
                for key, url, html in zip(*(piece.column(c).to_pylist() for c in ("key", "url", "html")), strict=True):
                    body = (html or "").encode()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{KEY_HEADER}: {'' if key is None else key}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    out.append(arc_record(version, name, address(url), "0.0.0.0", date, "text/html", http + body))
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.options(compression="gzip", lineSep="\n").text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records: key, url, ip, date, mime, http, payload, n_bytes, digest."""
    schema = "key bigint, url string, ip string, date string, mime string, http binary, payload binary, n_bytes bigint, digest string"

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                out, size = [], 0
                for r in parse_arc(content.as_py()):
                    http, payload = split_http(r.pop("content"))
                    key = header(http, KEY_HEADER)
                    out.append(r | {"key": key and int(key), "http": http, "payload": payload, "n_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()})
                    size += len(payload) + 1000
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, ARC_ARROW)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, ARC_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


ARC_ARROW = pa.schema(
    [("key", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string())]
    + [("http", pa.binary()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("digest", pa.string())]
)


def record_id(url: str, date: str, digest: str, key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {digest} {key}')}>"


def warc_record(r: dict) -> bytes:
    """Without the last line feed. ``first_*`` fields name the response that a revisit refers to."""
    d = r["date"]
    iso = lambda d: f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    block = r["http"] + b"\r\n\r\n" + (r["payload"] if r["first_key"] is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if r['first_key'] is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(r['url'], d, r['digest'], r['key'])}", f"WARC-Date: {iso(d)}", f"WARC-Target-URI: {r['url']}",
        f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha256:{r['digest']}",
    ]
    if r["first_key"] is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(r['first_url'], r['first_date'], r['digest'], r['first_key'])}",
            f"WARC-Refers-To-Target-URI: {r['first_url']}", f"WARC-Refers-To-Date: {iso(r['first_date'])}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def convert(records: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """ARC records (``read_arc``) to WARC files of at most ``FILE_RECORDS`` records each."""
    firsts = records.filter(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.count("*").alias("n"), F.min_by(F.struct("key", "url", "date"), F.struct(F.col("key").isNull(), "key", "url")).alias("first"))
    # a table of its own, so that the join below can split a payload that many records share
    firsts = materialize(firsts.filter("n > 1 and first.key is not null").select(F.col("digest").alias("its_digest"), "first"), "arc-firsts")
    # short payloads, however many are equal, are dealt by their records and meet nothing
    wanted = F.when(F.col("n_bytes") >= min_revisit, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("key", "url", "date")))
    joined = records.join(firsts, wanted == F.col("its_digest"), "left").select(
        "key", "url", "ip", "date", "mime", "http", "payload", "digest",
        *[F.when(~F.col("first.key").eqNullSafe(F.col("key")), F.col(f"first.{c}")).alias(f"first_{c}") for c in ("key", "url", "date")],
    )

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                yield pa.RecordBatch.from_pydict({"value": pa.array([warc_record(r) for r in batch.slice(k, 200).to_pylist()], pa.binary())})

    lines = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.options(compression="gzip", lineSep="\n", maxRecordsPerFile=str(FILE_RECORDS)).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of one WARC file."""
    file = _stream(content)
    while line := file.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip()] = value.strip()
        block = file.read(n := int(fields["Content-Length"]))
        if len(block) < n:
            raise ValueError("torn WARC record")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records: key, record_id, record_type, refers_id, url, date, n_bytes and digest of the full payload, payload
    (null for revisits). A response whose payload doesn't have its declared digest raises ValueError."""
    names = ["key", "record_id", "record_type", "refers_id", "url", "date", "n_bytes", "digest", "payload"]
    types = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                out, size = [], 0
                for fields, block in parse_warc(content.as_py()):
                    http, payload = split_http(block)
                    key, digest, kind = header(http, KEY_HEADER), fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: payload digest differs")
                    n = len(payload) if kind == "response" else int(header(http, "Content-Length"))
                    values = [key and int(key), fields["WARC-Record-ID"], kind, fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], fields["WARC-Date"], n, digest, payload if kind == "response" else None]
                    out.append(dict(zip(names, values, strict=True)))
                    size += len(payload) + 1000
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, types, strict=True))))
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, types, strict=True))))

    schema = "key bigint, record_id string, record_type string, refers_id string, url string, date string, n_bytes bigint, digest string, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, "page_id", "url", "html")
    convert(read_arc(spark, arc), warc)
    remove(spark, arc)
    rows = materialize(read_warc(spark, warc).drop("payload"), "warc-rows")
    remove(spark, warc)
    heads = rows.filter("record_type = 'response'").select(F.col("record_id").alias("its_id"), F.col("key").alias("refers_to")).distinct()
    # a table of its own, so that the join can split a response that many revisits refer to
    heads = materialize(heads, "warc-heads")
    return rows.join(heads, F.col("refers_id") == F.col("its_id"), "left").select(
        F.col("key").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
