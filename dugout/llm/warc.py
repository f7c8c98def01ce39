"""Web archives: write records with an index, read selected records back by byte ranges.

Every record is a gzip member of its own, so that any byte range from the index is readable
alone. Tasks write archive files to the shared folder under names that no other attempt uses;
the index holds only what successful attempts returned, so a task that ran twice leaves an
unreferenced file and no double record. The index is written before anything is read.

Reading sorts the selected index rows by file and offset, joins ranges that lie close together
up to a size limit, and fetches each joined range in one request.

Defined results: a null payload is empty, a null address is written as an empty one. Of records
with equal payloads the one with the largest page_id is the response; null ids come last, and
rows that repeat the id of the response are responses too. Payloads are equal where SHA-256 and
length agree; the SHA-1 digest that the format asks for decides nothing. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.llm.common import SLICE_BYTES, arrow_schema, quoted, slices
from dugout.sources.shared import materialize, new_path

#: rolls over to a new archive file; reads at most so much at once; reads over gaps up to this size
FILE_BYTES, RANGE_BYTES, GAP_BYTES = 64 << 20, 4 << 20, 64 << 10
#: compressed bytes that one reading task takes
TASK_BYTES = 16 << 20
INDEX = (
    "page_id long, url string, file string, offset long, length long, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long"
)
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and path[6:7] != "/" else path
    return fs.FileSystem.from_uri(uri)


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, record_type: str, refers_to, digest: str, n_bytes: int) -> bytes:
    """One WARC record. A revisit has the HTTP head of the response and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    block = head.encode() + (payload if record_type == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {_DATE}",
        # Control characters and spaces would break the header line.
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if record_type == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines)}


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _headers(lines)
    block = rest[:int(headers["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, _headers(http.split(b"\r\n")[1:]), payload


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload (null for revisits), n_bytes, sha, record_type, refers_to.

    Equal payloads meet by SHA-256 and length on rows without payload. The decisions go back to the pages by page and
    digest, so that a payload that very many pages share is no key of a shuffle that carries payloads.
    """
    body = F.coalesce(quoted(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), body.alias("payload"),
    ).withColumns({"sha": F.unhex(F.sha1("payload")), "strong": F.unhex(F.sha2("payload", 256)),
                   "n_bytes": F.octet_length("payload").cast("long")})
    narrow = rows.groupBy("page_id", "strong", "n_bytes").agg(F.lit(1))
    heads = narrow.groupBy("strong", "n_bytes").agg(F.max("page_id").alias("head"))
    decided = narrow.join(heads, ["strong", "n_bytes"]).select(
        F.col("page_id").alias("__page"), F.col("strong").alias("__strong"), "head")
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("strong") == F.col("__strong"))
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("head"))
    return rows.join(decided, same).select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n_bytes", "sha",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("head")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records below ``folder``; lazy, returns the index rows. Run it once (materialise it)."""

    def run(batches):
        schema = arrow_schema(INDEX)
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for part in slices(batch, "payload"):
                    rows = []
                    for r in part.to_pylist():
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{base}/{name}", compression=None)
                        digest = base64.b32encode(r["sha"]).decode()
                        raw = gzip.compress(
                            record_bytes(r["page_id"], r["url"], r["payload"] or b"", r["record_type"],
                                         r["refers_to"], digest, r["n_bytes"]), mtime=0)
                        out.write(raw)
                        rows.append({**r, "file": name, "offset": at, "length": len(raw),
                                     "payload_digest": digest, "payload_bytes": r["n_bytes"]})
                        at += len(raw)
                    yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in rows], schema=schema)
        finally:
            if out is not None:
                out.close()

    return records.mapInArrow(run, INDEX)


def byte_ranges(index: DataFrame, gap_bytes: int = GAP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Joined reads: file, from, to, parts (offset and length of each record). Files bound the windows."""
    along = W.partitionBy("file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    apart = F.col("offset") - F.lag(end).over(along) > gap_bytes
    # A new range starts after a gap, and wherever the file enters the next block of range_bytes.
    block = F.floor(F.col("offset") / F.lit(range_bytes))
    starts = F.coalesce(apart | (block != F.lag(block).over(along)), F.lit(True))
    marked = index.select("file", "offset", "length", starts.cast("int").alias("starts"))
    numbered = marked.withColumn("range", F.sum("starts").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("file", "range").agg(
        F.min("offset").alias("from"), F.max(end).alias("to"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"),
    )


def records_of(raw: bytes, parts, start: int, name: str, limit: int = SLICE_BYTES):
    """Rows of the records at ``parts`` of a range, in lists of about ``limit`` payload bytes.

    A range of few bytes may hold very many: pages shrink many times over in compression.
    """
    rows, held = [], 0
    for p in parts:
        at = p["offset"] - start
        headers, http, payload = parse_record(zlib.decompress(raw[at:at + p["length"]], wbits=31))
        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
        n_bytes = int(http["content-length"])
        if kind == "response" and (len(payload) != n_bytes or digest_of(payload) != digest):
            raise ValueError(f"damaged record in {name} at {p['offset']}")
        refers = _page_of(headers["warc-refers-to"]) if kind == "revisit" else None
        if rows and held + len(payload) > limit:
            yield rows
            rows, held = [], 0
        rows.append((_page_of(headers["warc-record-id"]), n_bytes, digest, kind, refers,
                     headers["warc-target-uri"], payload if kind == "response" else None))
        held += len(payload)
    if rows:
        yield rows


def read_records(index: DataFrame, folder: str, **limits) -> DataFrame:
    """Read the records that ``index`` lists; checks the digest of every payload read."""

    def run(batches):
        schema = arrow_schema(RECORD + ", url string, payload binary")
        system, base = _open(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                with system.open_input_file(f"{base}/{r['file']}") as f:
                    f.seek(r["from"])
                    raw = f.read(r["to"] - r["from"])
                for rows in records_of(raw, r["parts"], r["from"], r["file"]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # Range rows are tiny and what they stand for is not: deal them out by the bytes to read.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    ranges = byte_ranges(index, **limits).repartition(tasks, "file", "range")
    return ranges.mapInArrow(run, RECORD + ", url string, payload binary")


def archive_pages(
    spark: SparkSession,
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
) -> tuple[DataFrame, str]:
    """Write all pages; the index table and the folder of the archives."""
    folder = new_path(spark, "warc")
    planned = plan_records(pages, id_col, url_col, payload_col, min_bytes)
    return materialize(write_archives(planned, folder), "warc-index"), folder
