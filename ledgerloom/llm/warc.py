"""WARC archives: a writer with one gzip member for each record, and a splittable reader.

The writer goes through Spark's own file writer, so its output is committed task by task in any store that Spark
reaches.  The reader deals byte ranges of the files to tasks; a task looks for gzip magic in its range, takes a
place for a record when the member that begins there decodes and its content starts with a WARC header, and owns
the records that begin in its range, reading on past its end to finish the last one.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, shared_dir, stage, texts_to_python

#: Fixed value: what begins a gzip member.
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member, which stands between records because Spark's text writer ends every row with something.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + b"\x00" * 8
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are always stored.
MIN_PAYLOAD = 100
RANGE, READ = 32 << 20, 1 << 20
#: Ranges of a task, on average.
RANGES = 4


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record as a gzip member; a revisit names the record that it refers to and has no block."""
    block = payload if refers_to is None else b""
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    raw = VERSION + "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_PAYLOAD) -> None:
    """Write one record for each row of `pages` to files under `path` (which must not exist).

    The payload is the HTML in UTF-8, a null is empty.  Of rows with equal payloads of at least `least` bytes the
    one with the smallest id is a response and the others are revisits that refer to it; smaller payloads are
    all responses, and so are rows with a null id.  Rows that repeat both id and payload of a response are
    responses too.  An empty table writes no record.  Digests are counted before they meet the rows, and
    those with a large share of all rows are joined by broadcast.
    """
    rows = texts_to_python(pages).select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    key = F.when((F.col("size") >= least) & F.col("page_id").isNotNull(), F.col("digest"))
    keyed = rows.withColumn("key", key)
    first = keyed.filter("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = attach(keyed, stage(first, "digests"), "key", "n", how="left")
    met = met.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, u, h, s, d, r in zip(*(b[c] for c in ("page_id", "url", "html", "size", "digest", "refers_to"))):
                out.append(record(None if pd.isna(i) else int(i), u, h.encode("utf-8", "replace"), d, int(s), None if pd.isna(r) else int(r)))
            yield pd.DataFrame({"member": out})

    members = met.select("page_id", "url", "html", "size", "digest", "refers_to").mapInPandas(run, "member binary")
    text = members.select(F.col("member").cast("string").alias("value"))
    text.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


# --------------------------------------------------------------------------- reading
def opened(uri: str):
    """A random-access file of any store that Arrow reaches: local, HDFS, S3, GCS."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


class Range:
    """Bytes of a file from `begin` on, read in pieces as they are asked for and dropped when passed."""

    def __init__(self, file, begin: int, size: int):
        self.file, self.at, self.size, self.held = file, begin, size, b""

    def upto(self, end: int) -> None:
        """Hold bytes up to `end`, or to the end of the file; what is read at once doubles with what is held."""
        while self.at + len(self.held) < min(end, self.size):
            self.file.seek(self.at + len(self.held))
            got = self.file.read(max(READ, len(self.held), end - self.at - len(self.held)))
            if not got:
                self.size = self.at + len(self.held)
            self.held += got

    def drop(self, before: int) -> None:
        """Forget bytes before `before`; small amounts are kept, since forgetting copies what stays."""
        if before - self.at >= READ:
            self.held, self.at = self.held[before - self.at :], before

    def find(self, start: int, end: int) -> int:
        """The first magic that begins in [start, end), or -1; passed bytes are dropped."""
        while start < end:
            self.drop(start)
            self.upto(start + len(MAGIC))
            k = self.held.find(MAGIC, start - self.at)
            if k >= 0:
                return self.at + k if self.at + k < end else -1
            if self.at + len(self.held) >= self.size:
                return -1
            start = max(start, self.at + len(self.held) - len(MAGIC) + 1)
        return -1

    def member(self, start: int) -> tuple[bytes, int] | None:
        """Content and end of the gzip member that begins at `start`; None if there is none.

        Any damage shows in the header, in the deflate data or in the checksum, so bytes that only look like a
        member are refused.  A member that is not a WARC record is refused at its first bytes, unless empty.
        """
        z, out, at, checked, step = zlib.decompressobj(31), [], start, False, 4096
        try:
            while not z.eof:
                self.upto(at + step)
                part = self.held[at - self.at : at - self.at + step]
                step = min(2 * step, READ)
                if not part:
                    return None
                out.append(z.decompress(part))
                at += len(part)
                if not checked and (out[0] or z.eof):
                    checked = True
                    head = out[0][: len(VERSION)]
                    if head and not VERSION.startswith(head) and not head.startswith(b"WARC/"):
                        return None
        except zlib.error:
            return None
        return b"".join(out), at - len(z.unused_data)


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and block of a decoded record; None if it is malformed."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or int(length) > len(rest):
        return None
    return fields, rest[: int(length)]


READ_SCHEMA = "record_id string, record_type string, refers_to string, uri string, payload_digest string, payload_length long, block binary, path string, position long"


def read_warc(spark: SparkSession, path: str, step: int = RANGE, block: bool = True) -> DataFrame:
    """One row for each record of the gzipped WARC files under `path`, with its file and byte position.

    Files are dealt in ranges of `step` bytes; every record is read by the one task in whose range it begins,
    wherever ranges fall.  The files are only listed by Spark and read by tasks in pieces of 1 MiB, so memory
    is that of one record.  Bytes that are no record (other members, damage) are passed over.  Without
    `block` the payload bytes are left out (their digest is still computed from them).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("begin"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in READ_SCHEMA.split(",")]
        for b in batches:
            for path_, size, begin in zip(b["path"], b["size"].tolist(), b["begin"].tolist()):
                rows, held = [], 0
                with opened(path_) as file:
                    source, at, end = Range(file, begin, size), begin, min(begin + step, size)
                    while (at := source.find(at, end)) >= 0:
                        got = source.member(at)
                        fields = parse(got[0]) if got else None
                        if fields is None:
                            at = got[1] if got and not got[0] else at + 1
                            continue
                        f, data = fields
                        kind = f.get("warc-type", "")
                        digest = hashlib.sha256(data).hexdigest() if kind != "revisit" else f.get("warc-payload-digest", "").removeprefix("sha256:")
                        length = len(data) if kind != "revisit" else int(f.get("warc-payload-length", "0"))
                        uri = f.get("warc-target-uri")
                        uri = uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if uri is not None else None
                        rows.append((f.get("warc-record-id"), kind, f.get("warc-refers-to"), uri, digest, length, data if block else None, path_, at))
                        held += len(data) if block else 200
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                        at = got[1]
                yield pd.DataFrame(rows, columns=names)

    # by bytes: a few ranges a task, so that a lost task repeats little
    tasks = ranges.count() // RANGES + 1
    return ranges.repartition(max(tasks, spark.sparkContext.defaultParallelism), "path", "begin").mapInPandas(run, READ_SCHEMA)


def page_of(urn: str):
    """The id in <urn:page:ID>, null when there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1), F.lit("")), F.lit("S" + "9" * 19)).cast("long")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = read_warc(spark, path, block=False)
    return out.select(page_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM r
"""
