"""WARC archives: a writer, a normaliser of monolithic gzip, and a reader by offset index.

Crawlers sometimes gzip a whole WARC file as one stream, which can only be read from its start. The
normaliser inflates such a file once, as a stream, and rewrites every record as a gzip member of its own
beside a sidecar index (a JSON line for each record: offset, length, type, id, digest). With the index a
reader gets any record alone.

Files are written by the executors into the shared folder under names no other attempt has, and are made known
only by the rows that their task returns: a task that runs again leaves a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, work_path

CHUNK = 1 << 18
ARCHIVE_BYTES = 64 << 20
LEAST_SHARED = 100
SPACE = uuid.UUID("6f1d5a52-0d5c-4f0e-9d57-0a6a1f0b7c11")


def record_id(page: object, own=True) -> str:
    """A response's id follows from its page, so that revisits can name it; any other record's is random."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page}') if own and page is not None else uuid.uuid4()}>"


def header_value(text: str) -> str:
    """One line of printable characters: anything else is percent-encoded."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response with its payload, or a revisit that names the response it repeats."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, not revisit)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {header_value(url or f'urn:page:{page_id}')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Broken(Exception):
    """What is wrong with an archive, from where on nothing can be read."""


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file, one member or many, read once in chunks. Zero bytes between and after members are padding. Broken: after all that could be inflated."""
    engine, begun = zlib.decompressobj(31), False
    try:
        while data := stream.read(CHUNK):
            while data:
                if not begun and not (data := data.lstrip(b"\0")):
                    break
                begun = True
                if out := engine.decompress(data, CHUNK):
                    yield out
                data = engine.unconsumed_tail
                if engine.eof:
                    data, engine, begun = engine.unused_data, zlib.decompressobj(31), False
    except zlib.error as fault:
        raise Broken(f"gzip: {fault}") from None
    if begun:
        raise Broken("gzip: cut off")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, the whole record) of each record of a stream of chunks. Broken: after the last whole record, where a record is cut off or has no length."""
    buffer, done = bytearray(), False

    def fill() -> bool:
        nonlocal done
        if not done:
            part = next(chunks, None)
            done = part is None
            buffer.extend(part or b"")
        return not done

    while True:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        seen = 0
        while (cut := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill():
                if buffer.strip():
                    raise Broken("record: cut off")
                return
        if buffer[:2] == b"\r\n":
            continue
        names = {}
        for line in bytes(buffer[:cut]).decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            names[key.strip().lower()] = value.strip()
        length = names.get("content-length", "")
        if not buffer.startswith(b"WARC/") or not (length.isascii() and length.isdigit()):
            raise Broken(f"record: no header with a length, but {bytes(buffer[: min(cut, 60)])!r}")
        size = cut + 4 + int(length)
        while len(buffer) < size + 4 and fill():
            pass
        if len(buffer) < size:
            raise Broken("record: cut off")
        whole = bytes(buffer[:size])
        yield names, whole[cut + 4 :], whole + b"\r\n\r\n"
        del buffer[: size + 4]


def member(data: bytes, level=6) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def opened(path: str):
    """(file system, path) of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(rows: DataFrame, folder: str, archive_bytes=ARCHIVE_BYTES) -> DataFrame:
    """rows: page_id, url, payload, digest, refers_to. Monolithic gzip archives of about archive_bytes before compression: path, records."""

    def run(batches):
        out, path, engine, size, n, done = None, "", None, 0, 0, []

        def close():
            out.write(engine.flush())
            out.close()
            done.append((path, n))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, at = opened(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out, engine = fs.open_output_stream(at, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record(row[0], row[1], row[2] or b"", row[3], row[4])
                out.write(engine.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["path", "records"])

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long")


def one_a_task(archives: DataFrame, most=20_000) -> DataFrame:
    """Archives dealt so that each is a task of its own, up to so many tasks: paths are random, and ranges of them are even."""
    return archives.repartitionByRange(max(1, min(most, archives.count())), "path")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """archives: path. Inflates each once and writes <name>.warc.gz, a gzip member for each record, and <name>.idx: path, index, records, source, error.

    error says what ends an archive early (a damaged or cut-off gzip stream, a record that is cut off or has no length, a missing file); the records before that are
    there all the same. It is null if the archive is whole. A null path is an error with no files.
    """

    def run(batches):
        for batch in batches:
            done = []
            for source in batch.column(0).to_pylist():
                name, offset, n, error = f"{folder}/{uuid.uuid4().hex}", 0, 0, None
                to, target = opened(name)
                to.create_dir(target.rpartition("/")[0], recursive=True)
                with to.open_output_stream(f"{target}.warc.gz", compression=None) as out, to.open_output_stream(f"{target}.idx", compression=None) as index:
                    try:
                        if source is None:
                            raise FileNotFoundError("no path")
                        fs, at = opened(source)
                        with fs.open_input_stream(at, compression=None) as stream:
                            for names, _, whole in records(inflate(stream)):
                                data = member(whole)
                                out.write(data)
                                entry = {"offset": offset, "length": len(data), "type": names.get("warc-type"), "id": names.get("warc-record-id"), "uri": names.get("warc-target-uri"), "digest": names.get("warc-payload-digest")}
                                index.write(json.dumps(entry).encode() + b"\n")
                                offset, n = offset + len(data), n + 1
                    except (Broken, FileNotFoundError) as fault:
                        error = str(fault)
                done.append((f"{name}.warc.gz", f"{name}.idx", n, source, error))
            columns = list(zip(*done, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "index", "records", "source", "error"])

    return one_a_task(archives.select("path")).mapInArrow(run, "path string, index string, records long, source string, error string")


def number(text) -> int | None:
    return int(text) if text and text.lstrip("-").isascii() and text.lstrip("-").isdigit() else None


def read(archives: DataFrame) -> DataFrame:
    """archives: path, index. Every record, by its index entry: page_id, type, uri, payload_bytes, payload_digest, refers_to, intact.

    A revisit's payload size and digest are those its header gives of the payload it repeats. intact: a response's payload has the digest its header gives;
    for a revisit see verified(). Records without the headers of a page have nulls for them, and are intact if they give no digest.
    """
    schema = "page_id long, type string, uri string, payload_bytes long, payload_digest string, refers_to long, intact boolean"
    names_ = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def row(head, block):
        payload = block.partition(b"\r\n\r\n")[2]
        revisit = head.get("warc-type") == "revisit"
        stated = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        found = stated if revisit else hashlib.sha256(payload).hexdigest()
        return (number(head.get("x-page-id")), head.get("warc-type"), head.get("warc-target-uri"), number(head.get("x-payload-length")) if revisit else len(payload), found, number(head.get("x-refers-to-page")), None if revisit else stated in (None, found))

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = opened(path)
                _, side = opened(index)
                with fs.open_input_stream(side, compression=None) as entries, fs.open_input_file(at) as archive:
                    rows, rest = [], b""
                    while (data := entries.read(CHUNK)) or rest:
                        *lines, rest = (rest + data).split(b"\n")
                        for line in lines:
                            entry = json.loads(line)
                            archive.seek(entry["offset"])
                            head, block, _ = next(records(iter([zlib.decompress(archive.read(entry["length"]), 31)])))
                            rows.append(row(head, block))
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names_)
                            rows = []
                        if not data:
                            break

    return one_a_task(archives.select("path", "index")).mapInArrow(run, schema)


def verified(found: DataFrame) -> DataFrame:
    """What read() gives, written once, with each revisit's intact: the response that it refers to is there, intact, and has the size and digest that the revisit gives.

    Responses that revisits refer to are one row each, so that a response which a third of all pages repeat is joined as a skewed join that Spark can split.
    """
    rows = materialise(found, "warc-read")
    wanted = rows.filter("type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    there = rows.filter("type = 'response'").join(wanted, "page_id").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.bool_and("intact").alias("ok"))
    same = there.groupBy("refers_to").agg(F.collect_list(F.struct("d", "b", "ok")).alias("there"))
    good = F.coalesce(F.exists("there", lambda x: x["ok"] & (x["d"] == F.col("payload_digest")) & (x["b"] == F.col("payload_bytes"))), F.lit(False))
    return rows.join(same, "refers_to", "left").withColumn("intact", F.when(F.col("type") == "revisit", good).otherwise(F.col("intact"))).select(*rows.columns)


def pages_to_records(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", least_shared=LEAST_SHARED) -> DataFrame:
    """page_id, url, payload, digest, refers_to. Among payloads of least_shared bytes or more that are equal, the least page_id's is the response.

    Digests find the response of each group by a sum of their own, so that only digests seen twice are joined, and a digest that a third of
    the pages share is split by the join. Null payloads are empty, null urls left to the writer. Rows that repeat the response's page_id are responses
    too; a null page_id never is one that others refer to.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = own.filter(F.length("payload") >= least_shared).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    shared = materialise(shared, "warc-shared")
    return own.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("least")), F.lit(None)).otherwise(F.col("least")).alias("refers_to"))


def op1_warc(spark, sf_dir):
    """Writes monolithic archives of all pages, normalises them, and reads every record back through the index. An archive that breaks is an error: its records would be missing."""
    folder = work_path(spark, "warc")
    rows = pages_to_records(table(spark, sf_dir, "pages"))
    written = materialise(write_archives(rows, f"{folder}/whole"), "warc-whole")
    members = materialise(normalise(written, f"{folder}/members"), "warc-members")
    broken = members.filter("error is not null").select("source", "error").first()
    if broken:
        raise ValueError(f"{broken['source']}: {broken['error']}")
    return verified(read(members)).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact")


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND least < page_id THEN least END AS refers_to, true AS intact
FROM g
"""
