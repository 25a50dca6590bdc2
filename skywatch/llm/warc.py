"""Operator 4: WARC archives, revisit records and an externally merged index.

:func:`write_archives` writes one WARC/1.1 record per page. Of the records
with equal payloads of at least 100 bytes the one with the smallest id is the
response, the others are revisits that name it and carry no payload; smaller
payloads are always responses. The archives are written by Spark's text
writer (a record is its text, the record separator is the line separator), so
they go to whatever file system the cluster uses; each archive is one gzip
file of bounded record count.

:func:`read_archives` reads the archives back record by record (lengths from
the records' own headers) and sorts each archive's captures locally: those
are the runs, written as a table. :func:`merge_index` deals the runs out by
ranges of (URL key, timestamp, id) and merges, in each range, the slices of
the k runs with a loser tree: one pass, one comparison per tree level and
capture, and only the heads of the runs in the tree. Ranges follow each other
by partition number, so the index is ordered globally. A URL with very many
captures spans several ranges, as timestamp and id belong to the key.

Cases: a null html is an empty payload; a null url is written as
``urn:page:<id>``; white space and control characters of a url are
percent-encoded in the header (the index keeps the encoded form); rows with
equal id and payload are all responses if that id is the smallest (they are
the same capture); a null id never becomes the response while another row has
an id, and refers to nothing if none has; other columns are ignored; a record
is held whole by one task, an archive of at most RECORDS_PER_ARCHIVE records,
too; an empty table gives no archives and an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm.common import materialize, table
from skywatch.session import scratch_path

LEAST_REVISIT_BYTES = 100
RECORDS_PER_ARCHIVE = 4096
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id long, url_key string, timestamp string, url string, record_type string, payload_digest string, " \
          "payload_bytes long, refers_to long, archive string, offset long, payload_ok boolean"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            date: Column | None = None, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(record): the text of one WARC record per page, without the separator."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
        F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("url"),
        (date if date is not None else _date_of(F.col(id_col))).alias("date"))
    rows = rows.select("*", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").alias("bytes"))
    # The digests that occur more than once: partial aggregation collapses a hot payload before the shuffle.
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select(F.col("digest").alias("first_digest"), "first_id")
    rows = rows.join(first, F.col("digest") == F.col("first_digest"), "left")
    revisit = F.col("first_digest").isNotNull() & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    url = F.regexp_replace(F.regexp_replace("url", "%(?![0-9A-Fa-f]{2})", "%25"), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(SEPARATOR))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"), F.col("digest"))),
        F.concat(F.lit("WARC-Payload-Digest: "), digest),
        F.concat(F.lit("WARC-Page-ID: "), F.col("id").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id"), F.col("digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("first_id").cast("string"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    return rows.withColumn("block", block).select(F.concat(head, F.lit(SEPARATOR), F.col("block")).alias("record"))


def _date_of(page_id: Column) -> Column:
    """A capture time for tables without one: one second apart by id."""
    seconds = F.lit(1_700_000_000) + F.pmod(F.coalesce(page_id.cast("long"), F.lit(0)), F.lit(100_000_000))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE, **options) -> None:
    records(pages, **options).write.option("lineSep", SEPARATOR).option("compression", "gzip") \
        .option("maxRecordsPerFile", records_per_archive).text(path)


def surt(url: str) -> str:
    """Sort-friendly URL key: host labels reversed, scheme, ``www.``, default port and fragment dropped, lower case host."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _fields(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower()] = value.strip()
    return out


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, header fields, block) of each record of an unpacked archive."""
    at, end = 0, len(data)
    while at < end:
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = _fields(data[at:cut])
        body = cut + 4
        size = int(fields[b"content-length"])
        if body + size > end:
            raise ValueError(f"record at byte {at} is cut off")
        yield at, fields, data[body:body + size]
        at = body + size + 4


def _captures(archive: str, data: bytes) -> list[tuple]:
    rows = []
    for offset, f, block in parse_archive(data):
        kind, digest = f[b"warc-type"].decode(), f[b"warc-payload-digest"].decode().removeprefix("sha256:")
        cut = block.index(b"\r\n\r\n")
        payload, http = block[cut + 4:], _fields(block[:cut])
        n = int(http[b"content-length"])
        ok = kind == "revisit" and not payload or kind == "response" and len(payload) == n and hashlib.sha256(payload).hexdigest() == digest
        url = f[b"warc-target-uri"].decode("utf-8", "replace")
        page, refers = f.get(b"warc-page-id"), f.get(b"warc-refers-to-page-id")
        rows.append((None if page is None else int(page), surt(url), f[b"warc-date"].decode(), url, kind, digest, n,
                     None if refers is None else int(refers), archive, offset, ok))
    rows.sort(key=_key)
    return rows


def _key(row: Sequence) -> tuple:
    """URL key, timestamp, id (null last), digest."""
    return row[1], row[2], row[0] is None, row[0] or 0, row[5]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to", "payload_bytes", "offset"):
        out[c] = out[c].astype("Int64")
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, as a table whose files hold locally sorted runs (one per archive)."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = gzip.decompress(content)
                rows = _captures(name, data)
                for k in range(0, len(rows), 20_000):
                    yield _frame(rows[k:k + 20_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return materialize(files.mapInPandas(runs, CAPTURE), "warc-runs")


class LoserTree:
    """k-way merge of sorted iterators; inner nodes keep the loser of each match, so taking
    the smallest head and refilling replays one path of about log2 k comparisons."""

    def __init__(self, runs: Iterable[Iterator], key) -> None:
        self.key = key
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        self.losers = [-1] * self.k
        for i in range(len(self.runs)):
            self._refill(i)
        self.winner = self._build(1)

    def _refill(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.heads[i], self.keys[i] = row, None if row is None else self.key(row)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; an exhausted run loses, ties go to the lower run."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _build(self, node: int) -> int:
        """Plays the matches below a node (the leaves are k .. 2k - 1) and returns the winner; depth log2 k."""
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.heads and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self._refill(i)
            node = (i + self.k) // 2
            while node >= 1:
                if self._before(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge_index(runs: DataFrame) -> DataFrame:
    """The runs' captures in global order of (URL key, timestamp, id): partition after partition."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[str, list[tuple]] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                row = tuple(None if x is pd.NA or x != x else x for x in row)
                slices.setdefault(row[8], []).append(row)
        for rows in slices.values():
            rows.sort(key=_key)  # a slice comes in order but for the seams of shuffle blocks: near-linear
        out: list[tuple] = []
        for row in LoserTree([iter(slices[k]) for k in sorted(slices)], _key):
            out.append(row)
            if len(out) == 20_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return runs.repartitionByRange("url_key", "timestamp", "page_id").mapInPandas(merged, CAPTURE)


def archive_index(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes the archives of ``pages`` under ``path``, reads them back, and returns the merged index."""
    write_archives(pages, path, **options)
    return merge_index(read_archives(pages.sparkSession, path))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_index(table(spark, sf_dir, "pages"), scratch_path(spark, f"warc-{uuid.uuid4().hex}"))
    ok = F.when(F.col("payload_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record in "), F.col("archive"))))
    return index.select("page_id", "payload_bytes", ok.alias("payload_digest"), "record_type", "refers_to")


ORACLE_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
