"""Web archives: legacy ARC files are parsed by their own version's header lines and become WARC files, which are read back.

An archive is a file of gzip members, one for each record, which ends with a member of
under 2^24 bytes, so its last byte is 0. Spark's text writer with that byte as line separator
and one line a file therefore stores archives byte for byte, by the same committer as all
else: a lost executor leaves no half-written one, and any file system of Spark's will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import salted_join, shared_path, written

#: Uncompressed bytes after which an archive ends; a larger record stands in an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Field names of the URL-record lines of ARC 1 and ARC 2.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: The HTTP header whose integer ranks records of equal payload, and the WARC field that repeats the chosen record's.
RANK_HEADER, REFERS_TO_RANK = "X-Page-Id", "Catalume-Refers-To-Rank"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = re.compile(rb"^\S.* (\S*) (\d{1,14}|-) (\S+) (?:\S+ \S+ \S+ \S+ \S+ )?(\d+)\r?\n?$")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    return gzip.compress(data, 3, mtime=0)


class _Archive:
    """Members until the archive is full."""

    def __init__(self, head: bytes):
        self.members, self.size = [member(head)], len(head)

    def add(self, record: bytes) -> None:
        self.members.append(member(record))
        self.size += len(record)

    def line(self) -> bytes:
        """All bytes but the last, which is 0 and comes from the line separator."""
        if self.members[-1][-1]:
            self.members.append(member(b""))
        return b"".join(self.members)[:-1]


def _store(df: DataFrame, path: str) -> None:
    df.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def http_records(pages: DataFrame, date: str = "20000101000000") -> DataFrame:
    """url, ip, date, content_type, block of pages: HTTP responses whose payload is the html in UTF-8 (null: empty)."""
    html = F.coalesce("html", F.lit(""))
    rank = F.coalesce(F.concat(F.lit(f"{RANK_HEADER}: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"), rank, F.lit("\r\n"))
    return pages.select("url", F.lit("0.0.0.0").alias("ip"), F.lit(date).alias("date"), F.lit("text/html").alias("content_type"), F.concat(head, html).cast("binary").alias("block"))


def write_arc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes url, ip, date (14 digits), content_type and block as ARC files, of version 1 and 2 in turn; no shuffle.

    Spaces and control characters of URLs are percent-encoded, a null URL is `unknown:`; a
    null field is `-`, a null date the year 1970 and a null block empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now = TaskContext.get().partitionId(), 0, None

        def begun() -> tuple[_Archive, int]:
            version = 1 + (part + number) % 2
            body = f"{version} 0 catalume\n{FIELDS[version]}\n".encode()
            fields = ["filedesc://part-%05d-%05d.arc" % (part, number), "0.0.0.0", "20000101000000", "text/plain", *(["200", "-", "-", "0", "-"] if version == 2 else []), str(len(body))]
            return _Archive(" ".join(fields).encode() + b"\n" + body + b"\n"), version

        for batch in batches:
            for url, ip, date, kind, block in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now.size + len(block or b"") > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([now.line()], pa.binary())], ["archive"])
                    now, number = None, number + 1
                if now is None:
                    now, version = begun()
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "unknown:")
                body = block or b""
                fields = [url, ip or "-", date or "19700101000000", (kind or "-").replace(" ", ""), *(["200", "-", "-", "0", "-"] if version == 2 else []), str(len(body))]
                now.add(" ".join(fields).encode() + b"\n" + body + b"\n")
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now.line()], pa.binary())], ["archive"])

    _store(records.select("url", "ip", "date", "content_type", "block").mapInArrow(run, "archive binary"), path)


def _opened(content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def arc_records(content: bytes) -> Iterator[dict]:
    """at (uncompressed offset), the fields by lower-case name, block and error of each record of an ARC file, plain or gzip.

    The version block's second line names the fields; without one, lines of five fields
    are version 1 and lines of ten version 2. Where a declared length doesn't lead to the next
    header line, parsing goes on at the next line that reads as one and the skipped bytes give
    a row with error; so does what follows a damaged member.
    """
    stream, names, at = _opened(content), {len(v.split()): v.lower().split() for v in FIELDS.values()}, 0
    declared = None
    try:
        while line := stream.readline():
            start, at = at, at + len(line)
            if not line.strip():
                continue
            found = _LINE.match(line)
            if not found:
                yield {"at": start, "url": "", "block": b"", "error": "no header line"}
                while (line := stream.readline()) and not _LINE.match(line):
                    at += len(line)
                if not line:
                    return
                start, at = at, at + len(line)
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            n = declared or (10 if len(text.split(" ")) >= 10 else 5)
            row = dict(zip(names[n], text.rsplit(" ", n - 1)))
            length = int(row["archive-length"])
            block = stream.read(length)
            at += len(block)
            if row["url"].startswith("filedesc:"):
                lines = block.decode("utf-8", "replace").split("\n")
                fields = lines[1].lower().split() if len(lines) > 1 else []
                if "url" in fields and "archive-length" in fields:
                    declared, names[len(fields)] = len(fields), fields
            yield {"at": start, **row, "block": block, "error": None if len(block) == length else "shorter than declared"}
    except (OSError, EOFError, zlib.error) as e:
        yield {"at": at, "url": "", "block": b"", "error": f"damaged: {e}"}


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP response's head (with the empty line) and its payload; without a head all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i, len(s)) for s in (b"\r\n\r\n", b"\n\n") if (i := block.find(s)) >= 0]
    if not ends:
        return block, b""
    cut = sum(min(ends))
    return block[:cut], block[cut:]


def header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def _integer(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text.strip()) else None


def warc_date(date: str | None) -> str:
    """An ARC date of 4 to 14 digits as a WARC date; missing parts are the earliest, what is no date is the year 1970."""
    digits = (date or "") + "00000101000000"[len(date or "") :]
    if re.fullmatch(r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])[0-5]\d[0-5]\d", digits) and len(date or "") >= 4:
        return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"
    return "1970-01-01T00:00:00Z"


def record_id(archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


def warc_type(row: dict) -> str:
    """filedesc records become warcinfo, HTTP responses response, all others resource."""
    return "warcinfo" if row["url"].startswith("filedesc:") else "response" if row["block"].startswith(b"HTTP/") else "resource"


def warc_record(archive: str, row: dict, revisit: dict | None = None) -> bytes:
    """The WARC record of an ARC record; as a revisit it keeps the HTTP head alone."""
    kind, block = warc_type(row), row["block"]
    head, payload = http_parts(block)
    fields = [("WARC-Type", "revisit" if revisit else kind), ("WARC-Record-ID", f"<{record_id(archive, row['at'])}>"), ("WARC-Date", warc_date(row.get("archive-date")))]
    if kind == "warcinfo":
        fields += [("WARC-Filename", row["url"].removeprefix("filedesc://"))]
    else:
        fields += [("WARC-Target-URI", row["url"])] + [("WARC-IP-Address", row["ip-address"])] * (row.get("ip-address", "-") not in ("-", "0.0.0.0"))
        fields += [("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if revisit:
        block = head
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{revisit['id']}>"), ("WARC-Refers-To-Target-URI", revisit["url"]), ("WARC-Refers-To-Date", revisit["date"])]
        fields += [(REFERS_TO_RANK, str(revisit["rank"]))] * (revisit["rank"] is not None)
    content = {"warcinfo": "text/plain", "response": "application/http;msgtype=response"}.get(kind, row.get("content-type") or "application/octet-stream")
    fields += [("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, type, url, date, payload_bytes, payload_digest, rank and error of all records of the ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for row in arc_records(content or b""):
                    head, payload = http_parts(row["block"])
                    rows.append((archive, row["at"], warc_type(row), row["url"], warc_date(row.get("archive-date")), len(payload), base32_sha1(payload), _integer(header(head, RANK_HEADER)), row["error"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "archive string, offset bigint, type string, url string, date string, payload_bytes bigint, payload_digest string, rank bigint, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in schema.split(", ")]
    return _archives(spark, path).mapInArrow(run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Writes the WARC files that are equivalent to the ARC files: one for each, with a record for each.

    Of responses with equal payloads of at least `least_bytes` bytes, the one of the largest
    rank (`RANK_HEADER`; without one the latest, then the one that stands last) stays a
    response and the others become revisits that refer to it. Identifiers follow from the
    archive's name and the record's offset, so a conversion run again gives the same. What
    doesn't parse has no record; `arc_index` tells where.

    The payloads are read twice and never shuffled but as whole compressed archives, which
    meet their own records' revisits. A payload of very many records meets them in a
    salted join behind an aggregation.
    """
    index = written(arc_index(spark, arc_path).where("error is null and type = 'response'"), "arc-index").where(F.col("payload_bytes") >= least_bytes)
    payload = ["payload_digest", "payload_bytes"]
    groups = index.groupBy(*payload).agg(F.count("*").alias("n"), F.max(F.struct("rank", "date", "archive", "offset", "url")).alias("to")).where("n > 1")
    revisits = salted_join(index, written(groups, "payloads"), payload, "n", ["archive", "offset"]).where("archive <> to.archive or offset <> to.offset")
    by_archive = revisits.groupBy("archive").agg(F.collect_list(F.struct("offset", "to")).alias("revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, revisits in zip(*(c.to_pylist() for c in batch.columns)):
                again = {x["offset"]: {"id": record_id(x["to"]["archive"], x["to"]["offset"]), "url": x["to"]["url"], "date": x["to"]["date"], "rank": x["to"]["rank"]} for x in revisits or []}
                now = None
                for row in arc_records(content or b""):
                    if row["error"] is None:
                        record = warc_record(archive, row, again.get(row["at"]))
                        if now is None:
                            now = _Archive(record)
                        else:
                            now.add(record)
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now.line()], pa.binary())], ["archive"])

    joined = _archives(spark, arc_path).join(by_archive.hint("merge"), "archive", "left")
    _store(joined.select("archive", "content", "revisits").mapInArrow(run, "archive binary"), warc_path)


def warc_records(content: bytes) -> Iterator[dict]:
    """The fields by lower-case name, `block` and `error` of each record of a WARC file, plain or gzip; digests are verified."""
    stream = _opened(content)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                yield {"block": b"", "error": "no version line"}
                while (line := stream.readline()) and not line.startswith(b"WARC/"):
                    pass
                if not line:
                    return
            row: dict = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                row[name.strip().lower()] = value.strip()
            length = _integer(row.get("content-length")) or 0
            row["block"] = block = stream.read(length)
            wrong = [d for d, data in (("warc-block-digest", block), ("warc-payload-digest", http_parts(block)[1])) if d in row and (d[5] == "b" or row.get("warc-type") != "revisit") and row[d] != "sha1:" + base32_sha1(data)]
            yield row | {"error": "shorter than declared" if len(block) < length else f"{wrong[0]} differs" if wrong else None}
    except (OSError, EOFError, zlib.error) as e:
        yield {"block": b"", "error": f"damaged: {e}"}


def warc_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, record_type, record_id, date, target_uri, refers_to_id, payload_bytes, payload_digest, rank, refers_to_rank and error.

    Length and digest are those of the full payload for revisits too: they stand in the
    HTTP head that a revisit keeps and in its own fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for row in warc_records(content or b""):
                    head, payload = http_parts(row["block"])
                    size = _integer(header(head, "Content-Length")) if row.get("warc-type") == "revisit" else len(payload)
                    bare = [row.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")]
                    digest = row.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((archive, row.get("warc-type"), bare[0], row.get("warc-date"), row.get("warc-target-uri"), bare[1], size, digest, _integer(header(head, RANK_HEADER)), _integer(row.get(REFERS_TO_RANK.lower())), row["error"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "archive string, record_type string, record_id string, date string, target_uri string, refers_to_id string, payload_bytes bigint, payload_digest string, rank bigint, refers_to_rank bigint, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in schema.split(", ")]
    return _archives(spark, path).mapInArrow(run, schema)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of pages that went through ARC and WARC files.

    The pages are written as ARC files to the shared folder, converted, and the WARC files read
    back. Null html is the empty payload. A null page_id ranks below all others; of rows that
    repeat page_id and html one is the response if theirs is the largest page_id, the others
    revisit it. Rows that fail to come back raise in Spark's own assertion. An empty table
    gives no rows; other columns are ignored; page_id is read as an integer.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(http_records(pages.withColumn("page_id", F.col("page_id").cast("bigint"))), arc)
    convert(spark, arc, warc, least_bytes)
    sound: Column = F.assert_true(F.col("error").isNull(), F.col("error")).isNull()
    back = warc_index(spark, warc).where(sound).where("record_type in ('response', 'revisit')")
    return back.select(F.col("rank").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_rank").alias("refers_to"))
