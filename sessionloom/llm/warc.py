"""WARC archives: writing pages as records, reading archives back, and resolving revisits.

Headers are built by column expressions and written by Spark's text writer, whose line separator is
the record terminator, so archives land in whatever store Spark writes to. Only reading them back
parses bytes in Python. Payloads are never shuffled: what is shuffled is one header per record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import scratch, small_batches, stored

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"

#: Most rows that the table of repeated digests may have to be sent to every executor.
BROADCAST_ROWS = 200_000
#: Bytes of payload that an archive of average records has at most, and records of one.
FILE_BYTES, FILE_RECORDS = 64 << 20, 4096
#: Bytes of payload, and records, that a reader gathers before it passes them on.
READ_BYTES, READ_RECORDS = 8 << 20, 2048

RECORD_SCHEMA = (
    "page_id long, record_type string, record_id string, url string, refers_to_id string, "
    "stated_digest string, payload_digest string, payload_bytes long, payload binary, intact boolean"
)


def base32_of_hex(hex40: Column) -> Column:
    """Base32 (upper case) of 40 hexadecimal digits: each five digits are four letters."""
    letters = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(hex40, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 of a text's UTF-8 bytes; null counts as empty."""
    return base32_of_hex(F.sha1(F.coalesce(payload, F.lit("")).cast("binary")))


def revisit_plan(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """For each digest that occurs more than once in payloads of ``least_bytes`` or more: its response.

    ``headers``: page_id, payload_bytes, payload_digest. The grouping counts within tasks before its
    shuffle, so that a payload shared by a third of all pages moves as one row a task.
    """
    return (
        headers.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )


def _record_id(page_id: Column, otherwise: Column | None = None) -> Column:
    """A record id from the page id; ``otherwise`` names a page that has none."""
    name = page_id.cast("string")
    if otherwise is not None:
        name = F.coalesce(name, F.concat(F.lit("unnamed:"), otherwise))
    h = F.md5(F.concat(F.lit("page:"), name))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _uri(url: Column, page_id: Column) -> Column:
    """A header-safe URI: white space and control characters would end the header line."""
    safe = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    return F.when(safe == "", F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("unnamed")))).otherwise(safe)


def _record(revisit: Column, refers_to: Column, record_id: Column, date: str) -> Column:
    """The bytes of a record of page_id, url, payload, payload_bytes and payload_digest, as text.

    A revisit whose length or digest is not known (null) goes without that header line, as does a
    page without an id.
    """
    crlf = F.lit("\r\n")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, crlf)
    known = lambda text: F.coalesce(text, F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), known(line("Content-Length", F.col("payload_bytes").cast("string"))), crlf)
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(VERSION), crlf,
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"), F.col("page_id"))),
        known(line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), known(line("WARC-Refers-To", refers_to)))).otherwise(F.lit("")),
        known(line("X-Page-Id", F.col("page_id").cast("string"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        crlf, block,
    )


def _write(records: DataFrame, path: str, compression: str, records_per_file: int) -> None:
    options = {"lineSep": END, "compression": compression, "maxRecordsPerFile": records_per_file}
    records.write.options(**options).text(path)


def _sent(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan


def write_archives(
    pages: DataFrame, path: str, *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "gzip", records_per_file: int | None = None,
) -> None:
    """Writes one record per row under ``path``; of equal payloads the largest id is the response.

    A null payload is empty, a null or empty URL becomes ``urn:page:<id>``; of repeated rows with one
    id the record id is the same. A row without an id is less than any other: it revisits a page of
    the same payload that has one, and is a response where none has; its record is named by URL and
    digest. An empty table writes no record. Other columns are ignored. ``records_per_file``: as many
    as make ``FILE_BYTES`` of average payloads, ``FILE_RECORDS`` at most, where none is given.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": payload_digest(F.col("payload"))})
    plan = _sent(stored(revisit_plan(rows.select("page_id", "payload_bytes", "payload_digest"), least_bytes)))
    _write(_resolved(rows, plan, date), path, compression, records_per_file or _per_file(rows))


def _per_file(rows: DataFrame) -> int:
    average = rows.agg(F.avg("payload_bytes")).first()[0] or 0
    return max(1, min(FILE_RECORDS, int(FILE_BYTES // max(1, average))))


def _resolved(rows: DataFrame, plan: DataFrame, date: str) -> DataFrame:
    """value: a record for each row with a payload, a revisit where the plan names another page."""
    rows = rows.join(plan, ["payload_digest", "payload_bytes"], "left")
    # of several rows with the responding id, each is a response: nothing refers to itself
    revisit = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    own = _record_id(F.col("page_id"), F.concat_ws(" ", "url", "payload_digest"))
    return rows.select(_record(revisit, _record_id(F.col("response_id")), own, date).alias("value"))


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """The records of one archive, given in pieces of any size, by their stated lengths.

    Holds a record at a time; raises where the bytes don't follow the stated lengths.
    """
    pieces, held, done = iter(pieces), bytearray(), 0

    def until(enough) -> bool:
        """Reads on until ``enough`` of what is held."""
        while not enough():
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while until(lambda: len(held) > 0):
        if not until(lambda: len(held) >= 5) or not held.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {done}")
        seen = 0

        def whole_head() -> bool:
            nonlocal seen
            at = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held) if at < 0 else at
            return at >= 0

        if not until(whole_head):
            raise ValueError(f"the header at byte {done} does not end")
        body = seen + 4
        head = {k.strip().lower().decode("latin-1"): v.decode("utf-8") for k, v in _HEADER.findall(bytes(held[:body]), held.index(b"\r\n") + 2)}
        end = body + int(head["content-length"])
        if not until(lambda: len(held) >= end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {done} does not end where it states")
        block = bytes(held[body:end])
        yield {"head": head, "payload": block[block.index(b"\r\n\r\n") + 4 :]}
        del held[: end + 4]
        done += end + 4


def _unpacked(name: str, data: bytes) -> Iterator[bytes]:
    """The bytes of an archive by pieces; a gzip file may be a chain of members."""
    import zlib

    if not name.endswith(".gz"):
        yield from (data[i : i + (1 << 20)] for i in range(0, len(data), 1 << 20))
        return
    while data:
        member = zlib.decompressobj(31)
        piece = member.decompress(data, 1 << 20)
        while True:
            yield piece
            if member.eof:
                break
            piece = member.decompress(member.unconsumed_tail, 1 << 20)
            if not piece and not member.unconsumed_tail and not member.eof:
                raise ValueError(f"{name} is cut short")
        data = member.unused_data


def read_archives(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """One row per record under ``path``; digest and length are computed from the bytes read.

    A revisit's own digest and length are null until ``resolve_revisits``; ``intact`` tells whether a
    response's bytes match the digest that its header states. A task holds one packed file and
    ``READ_BYTES`` of payloads.
    """
    small_batches(spark)
    columns = [c.split(" ")[0] for c in RECORD_SCHEMA.split(", ")]

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        for c in ("page_id", "payload_bytes"):
            out[c] = out[c].astype("Int64")
        return out

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                for r in parse_records(_unpacked(name, bytes(data))):
                    head, payload = r["head"], r["payload"]
                    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    response = head["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else None
                    page = int(head["x-page-id"]) if "x-page-id" in head else None
                    rows.append((page, head["warc-type"], head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-refers-to"), stated, digest, len(payload) if response else None, payload if response and keep_payload else None, digest == stated if response else None))
                    size += len(payload) if keep_payload else 0
                    if size >= READ_BYTES or len(rows) >= READ_RECORDS:
                        yield table(rows)
                        rows, size = [], 0
        if rows:
            yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(task, RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisits get the page id, digest and length of the response that they refer to.

    Joined by record id on headers alone. A revisit whose response is absent keeps nulls. Repeated
    responses of one record id count once.
    """
    responses = (
        records.filter("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.max("page_id").alias("_page"), F.max("payload_digest").alias("_digest"), F.max("payload_bytes").alias("_bytes"))
    )
    revisits = records.filter("record_type <> 'response'")
    # a record that many others refer to is one key: those are counted per task before the shuffle,
    # and the join below may be split by Spark since nothing above needs its keys together
    joined = revisits.join(responses, "refers_to_id", "left").select("page_id", "record_type", F.col("_bytes").alias("payload_bytes"), F.coalesce("_digest", "stated_digest").alias("payload_digest"), F.col("_page").alias("refers_to"))
    own = records.filter("record_type = 'response'").select("page_id", "record_type", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(joined)


def deduplicate_archives(spark: SparkSession, source: str, target: str, *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int | None = None) -> None:
    """Reads archives, resolves equal payloads among their responses, and writes all records with fresh headers.

    A revisit of the source is joined to its response by record id and becomes a revisit to the
    response kept for that payload (the largest page id). One whose response is absent stays as it is:
    stated digest, no length, and the record id that it refers to.
    """
    heads = stored(read_archives(spark, source, keep_payload=False).drop("payload"))
    responses = heads.filter("record_type = 'response'")
    plan = _sent(stored(revisit_plan(responses, least_bytes)))
    rows = read_archives(spark, source).filter("record_type = 'response'").select("page_id", "url", F.col("payload").cast("string").alias("payload"), "payload_bytes", "payload_digest")

    kept = responses.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response_id"))
    originals = (
        responses.groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.max(F.struct("page_id", "payload_digest", "payload_bytes")).alias("_of"))
        .select("refers_to_id", "_of.payload_digest", "_of.payload_bytes")
        .join(kept, ["payload_digest", "payload_bytes"])
    )
    again = heads.filter("record_type = 'revisit'").select("page_id", "url", "refers_to_id", "stated_digest").join(originals, "refers_to_id", "left")
    again = again.withColumns({"payload": F.lit(""), "payload_digest": F.coalesce("payload_digest", "stated_digest")})
    # a page may be in the source both as a response and as a revisit to it
    own = F.when(F.col("response_id") == F.col("page_id"), F.concat(F.col("page_id").cast("string"), F.lit(":revisit"))).otherwise(F.coalesce(F.col("page_id").cast("string"), F.concat_ws(" ", F.lit("unnamed:revisit"), "url", "payload_digest")))
    refers_to = F.coalesce(_record_id(F.col("response_id")), F.col("refers_to_id"))
    revisits = again.select(_record(F.lit(True), refers_to, _record_id(own), date).alias("value"))
    _write(_resolved(rows, plan, date).unionByName(revisits), target, compression, records_per_file or _per_file(responses))


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them back and resolves the revisits."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, least_bytes=least_bytes)
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")
    return resolve_revisits(stored(read_archives(spark, path, keep_payload=False).drop("payload")))
