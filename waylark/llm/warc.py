"""WARC archives, written and read as chunked record tables.

`write` makes a record of each page in gzip members of WARC files, an identical payload of LEAST bytes or more as a revisit of the
record that holds it. Payloads are cut into rows of (record, chunk number) of CHUNK bytes before they reach a writer, which takes them
one after the other and checks their running digest against the one that the record's head has told. `read` streams archives, these or
others, and yields rows of (record, chunk number): each chunk has CHUNK bytes at most and carries the digest and size of the payload up
to and with it, so no whole record is held, and a record's last chunk has its digest.

Tasks write files of their own names; only files that a finished task names in the manifest count, so a task that is run again, or lost
with its executor, leaves nothing that is read.

Defined results: a null html is an empty payload, a null url an empty target; rows without a page_id have records without one; rows
that repeat a page_id each have a record, and of equal payloads all rows with the largest page_id are responses; an empty table makes
no archive. Columns other than page_id, url and html are not read, so none can clash. Of archives made elsewhere, plain or in gzip
members, records that aren't responses, revisits or resources are passed over; without a page id that is null, without a HTTP head the
whole block is the payload, and a revisit whose digest isn't a SHA-1 has a null one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import BROADCAST_MOST, HOT_ROWS, new_path, settled, small_batches, staged

LEAST = 1000
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Types of records that are read; bytes of a line of a head at most.
READ, LINE = ("response", "revisit", "resource"), 1 << 20
RECORD = "archive string, record_no long, record_id string, target_uri string, page_id long, record_type string, refers_to long, refers_to_id string, chunk_no long, last boolean, payload_bytes long, payload_digest string, data binary"


def _open(path: str, write: bool):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_stream(at, compression=None)


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _number(page_id: int | None) -> str:
    return "-" if page_id is None else str(page_id)


def _head(page: int | None, url: str | None, digest: str, size: int, keep: int | None) -> bytes:
    """The heads of a record, its own and HTTP's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if keep is None else 'revisit'}", f"WARC-Record-ID: {_urn(page, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    head += ["Content-Type: application/http;msgtype=response", f"X-Page-Id: {_number(page)}"]
    if keep is not None:
        head += [f"WARC-Refers-To: {_urn(keep, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {keep}"]
    head.append(f"Content-Length: {len(http) + (size if keep is None else 0)}")
    return "\r\n".join([*head, "", ""]).encode() + http


def _write(folder: str):
    """Rows of a record come on end, in the order of its chunks; a revisit has one, without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n, member, sha = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("page_id", "url", "digest", "size", "keep", "chunk_no", "last", "data")}
                out = out or _open(path, True)
                if r["chunk_no"] == 0:
                    member, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    out.write(member.compress(_head(r["page_id"], r["url"], r["digest"], r["size"], r["keep"])))
                sha.update(r["data"] or b"")
                out.write(member.compress(r["data"] or b""))
                if r["last"]:
                    if r["keep"] is None and sha.hexdigest() != r["digest"]:
                        raise ValueError(f"chunks of page {r['page_id']} don't make up its payload")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["archive", "records"])

    return run


def kept_payloads(pages: DataFrame) -> DataFrame:
    """pages (page_id, digest, size and more) with `keep`: the page whose record holds the payload of a page that is a revisit, else null."""
    found = pages.where(F.col("size") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    keep = staged(found.where("n > 1 and keep is not null"), "kept-payloads")
    again = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("keep")), F.col("keep"))
    if keep.count() <= BROADCAST_MOST:
        return pages.join(F.broadcast(keep.drop("n")), "digest", "left").withColumn("keep", again)
    # payloads of many pages are few: they are broadcast; the others go by digest, and pages that can't have one by what they are
    hot = keep.where(F.col("n") >= HOT_ROWS).select(F.col("digest").alias("hot"), F.col("keep").alias("hot_keep"))
    rest = keep.where(F.col("n") < HOT_ROWS).select(F.col("digest").alias("rest"), F.col("keep").alias("rest_keep"))
    out = pages.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    meets = F.when(F.col("hot").isNull() & (F.col("size") >= LEAST), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    out = out.withColumn("meets", meets).join(rest, F.col("meets") == F.col("rest"), "left").withColumn("keep", F.coalesce("hot_keep", "rest_keep"))
    return out.withColumn("keep", again).drop("hot", "hot_keep", "rest", "rest_keep", "meets")


def write(pages: DataFrame) -> DataFrame:
    """Writes archives to the shared folder. Returns their manifest: archive, records."""
    spark = pages.sparkSession
    small_batches(spark, 64, 16 << 20)
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select("page_id", "url", raw.alias("raw")).withColumn("digest", F.sha1("raw")).withColumn("size", F.octet_length("raw").cast("long"))
    rows = kept_payloads(pages)
    # a record's chunks are cut from its payload at once and follow it, so its task writes them one after the other
    last = F.when(F.col("keep").isNull(), F.greatest(F.lit(0).cast("long"), F.expr(f"(size - 1) div {CHUNK}"))).otherwise(0).cast("int")
    part = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_no"), (i == last).alias("last"), F.when(F.col("keep").isNull(),
        F.substring("raw", i * CHUNK + 1, F.lit(CHUNK))).alias("data")))
    chunks = rows.select("page_id", "url", "digest", "size", "keep", F.explode(part).alias("x")).select("page_id", "url", "digest", "size", "keep", "x.*")
    return staged(chunks.mapInArrow(_write(new_path(spark, "warc")), "archive string, records long"), "manifest")


def _line(stream) -> bytes:
    line = stream.readline(LINE)
    if len(line) == LINE:
        raise ValueError(f"a line of {LINE} bytes or more in a head")
    return line


def _records(stream) -> Iterator[tuple[dict, int]]:
    """Of each record its headers (names in lower case) and the size of its block, at whose start the stream is."""
    while line := _line(stream):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := _line(stream).rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.lower()] = value.strip()
        yield head, int(head["content-length"])


def _sha1(told: str) -> str | None:
    """The hexadecimal digits of a digest as WARC has it: sha1, in base 32 or 16."""
    kind, _, value = told.partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _stream(raw):
    """The archive's bytes, of gzip members or plain."""
    plain = io.BufferedReader(raw, 1 << 20)
    if plain.peek(2)[:2] == b"\x1f\x8b":
        return io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 18)
    return plain


def _rows(archive: str, with_data: bool) -> Iterator[tuple]:
    with _open(archive, False) as raw:
        stream = _stream(raw)
        for no, (head, left) in enumerate(_records(stream)):
            kind, told = head.get("warc-type", ""), None
            if kind in READ and "application/http" in head.get("content-type", ""):
                while left and (line := _line(stream)):
                    left -= len(line)
                    if not line.strip():
                        break
                    if line.lower().startswith(b"content-length:"):
                        told = int(line.partition(b":")[2])
            page, refers = head.get("x-page-id", "-"), head.get("x-refers-to-page-id")
            known = (archive, no, head.get("warc-record-id"), head.get("warc-target-uri"), None if page == "-" else int(page), kind,
                refers and int(refers), head.get("warc-refers-to"))
            if kind == "revisit":
                yield *known, 0, True, told, _sha1(head.get("warc-payload-digest", "")), None
            sha, size, chunk = hashlib.sha1(), 0, 0
            while True:
                data = stream.read(min(CHUNK, left))
                if left and not data:
                    raise EOFError(f"{archive} ends within record {no}")
                left -= len(data)
                if kind in READ and kind != "revisit":
                    size += len(data)
                    sha.update(data)
                    yield *known, chunk, left == 0, size, sha.hexdigest(), data if with_data else None
                    chunk += 1
                if left == 0:
                    break


def _read(with_data: bool, rows: int):
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, kinds = zip(*((x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")), strict=True)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for archive in given.column("archive").to_pylist():
                held: list[tuple] = []
                for row in _rows(archive, with_data):
                    held.append(row)
                    if len(held) >= rows:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    return run


def read(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives of a manifest, or any table of their paths (archive): RECORD. with_data: with the chunks' bytes."""
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n, "archive").mapInArrow(_read(with_data, 16 if with_data else 2000), RECORD)


@settled
def op8_warc(spark, sf_dir: str) -> DataFrame:
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(archives, with_data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
