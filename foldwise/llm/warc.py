"""WARC archives with a merged capture index.

Captures with equal payloads become one ``response`` and ``revisit`` records that name it.  Each
task writes its captures, sorted by URL key and time, as an archive: one sorted run.  Archives are
read back record by record along their stated lengths, so a payload may hold anything.  The runs'
index lines go to ranges of (URL key, time), and in every range a loser tree merges the runs,
which gives one globally ordered capture history.

Records are text with CRLF header lines, so Spark's text sink writes them: two CRLF end a record
and a file, and the commit protocol keeps a lost task's half file out.  Files are compressed as a
whole; ``offset`` counts in the uncompressed stream.

Defined results: a null page is an empty payload; a null URL has an empty key and no target line;
pages with equal ids and equal payloads are all responses if theirs is the smallest id; a null id
is never the response that others refer to unless no numbered page has the payload, and then all
are responses; an empty table gives an empty archive and an empty history.

Pages of unlike size go to archives of their own: a size class is written with as many records a
file as its mean size allows, and never more than its largest record allows, so no archive passes
``ARCHIVE_LIMIT`` unless a single record does.  Equal payloads are in one class.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.text import small_batches, whole
from foldwise.session import checkpoint_dir, materialize

REVISIT_FROM = 100
ARCHIVE_BYTES = 32 << 20
ARCHIVE_LIMIT = 256 << 20
SMALL_PAGE = 64 << 10
CLASS_FACTOR = 16
RECORD_HEAD = 1024
RANGE_ROWS = 100_000
# Field names and the revisit profile of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long"
INDEX = CAPTURE + ", archive string, offset long, length long"


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then path and query, all in lower case; no scheme, ``www``, port or fragment."""
    host = F.regexp_replace(F.regexp_extract(F.lower(whole(url)), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1), r"^www\.|:[0-9]+$", "")
    rest = F.regexp_extract(F.lower(whole(url)), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def capture_time(page_id: str = "page_id") -> Column:
    """A time for tables that hold none: one second per page number from a fixed day."""
    seconds = F.pmod(F.coalesce(F.col(page_id), F.lit(0)), F.lit(3_000_000_000))
    return F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def target(url: Column) -> Column:
    """The URL as it stands in a header line and in the index: line ends are escaped."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None,
         least: int = REVISIT_FROM) -> DataFrame:
    """One row per page with its record type, digest and what it refers to; the payload travels once."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), whole(F.col(f"`{html}`")).alias("payload"),
        (captured if captured is not None else capture_time(page_id)).alias("captured"),
    ).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", url_key(target(F.col("url"))).alias("url_key"), "captured", F.when(again, "revisit").otherwise("response").alias("record_type"),
        "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("payload")).otherwise("").alias("block"),
    )


def record() -> Column:
    """The text of a record up to, not including, the two CRLF that end it."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))

    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.coalesce(urn("page_id"), F.lit("<urn:page:>"))),
        line("WARC-Date", F.col("captured")), line("WARC-Target-URI", target(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), line("WARC-Refers-To", urn("refers_to")),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(""),
        line("Payload-Length", F.col("payload_bytes").cast("string")), F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )


def size_class(payload: Column) -> Column:
    """0 for payloads of up to ``SMALL_PAGE`` bytes, one more for each factor of ``CLASS_FACTOR``; a null page is empty."""
    bytes_ = F.octet_length(whole(payload))
    bounds = [SMALL_PAGE * CLASS_FACTOR**k for k in range(4)]
    return sum((F.when(bytes_ > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))


def records_per_archive(pages: DataFrame, url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES, limit: int = ARCHIVE_LIMIT) -> dict[int, int]:
    """Records that an archive of each size class may hold, in one pass over the sizes."""
    # a line end in a URL is written as three bytes
    size = F.octet_length(whole(F.col(f"`{html}`"))).cast("long") + 3 * F.octet_length(whole(F.col(f"`{url}`"))) + RECORD_HEAD
    sizes = pages.groupBy(size_class(F.col(f"`{html}`")).alias("k")).agg(F.avg(size).alias("mean"), F.max(size).alias("most"))
    return {r.k: int(max(1, min(archive_bytes // r.mean, limit // r.most))) for r in sizes.collect()}


def write(captures: DataFrame, path: str, records: int) -> None:
    """Add planned captures to a folder as archives of up to ``records`` records, each one sorted run."""
    captures.sortWithinPartitions("url_key", "captured", "page_id").select(record().alias("value")).write.mode("append").option(
        "lineSep", "\r\n\r\n"
    ).option("maxRecordsPerFile", records).option("compression", "gzip").text(path)


def parse(data: bytes):
    """Header fields, block, offset and length of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        head = data[at:split].decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        fields = dict(h.split(": ", 1) for h in head[1:])
        end = split + 4 + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at offset {at} has no end")
        yield fields, data[split + 4 : end], at, end + 4 - at
        at = end + 4


def _captures(name: str, content: bytes):
    import gzip
    import hashlib

    def number(urn):
        digits = urn[len("<urn:page:") : -1] if urn else ""
        return int(digits) if digits else None

    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    for f, block, offset, length in parse(data):
        digest, size = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["Payload-Length"])
        if f["WARC-Type"] == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
            raise ValueError(f"damaged payload in {name} at {offset}")
        yield (number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), "", f["WARC-Date"], f["WARC-Type"], size, digest,
               number(f.get("WARC-Refers-To")), name, offset, length)


def read(spark, path: str) -> DataFrame:
    """Index lines of all records of the archives in a folder, in the order of the runs; payloads are checked against their digests."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = spark.createDataFrame([], INDEX).schema

    def run(batches):
        import pyarrow as pa

        types = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in schema]
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                rows = list(_captures(p.as_py().rsplit("/", 1)[-1], c.as_py()))
                for k in range(0, len(rows), 8192):
                    cols = zip(*rows[k : k + 8192], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=schema.names)

    return files.mapInArrow(run, schema).withColumn("url_key", url_key(F.col("url")))


def merge_runs(runs: list, key):
    """Rows of sorted runs in one order, by a tournament of losers: one comparison per level for each row."""
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    done = object()
    now = [next(h, done) for h in heads]

    def wins(a: int, b: int) -> bool:
        if now[a] is done or now[b] is done:
            return now[b] is done and (now[a] is not done or a < b)
        x, y = key(now[a]), key(now[b])
        return x < y or (x == y and a < b)

    losers = [-1] * k
    # a run climbs until it meets an empty seat and waits there, or until it is the winner
    winner = 0
    for r in range(k):
        a, seat = r, (r + k) // 2
        while seat > 0:
            if losers[seat] < 0:
                losers[seat] = a
                break
            if wins(losers[seat], a):
                a, losers[seat] = losers[seat], a
            seat //= 2
        else:
            winner = a
    while now[winner] is not done:
        yield now[winner]
        now[winner] = next(heads[winner], done)
        a, seat = winner, (winner + k) // 2
        while seat > 0:
            if wins(losers[seat], a):
                a, losers[seat] = losers[seat], a
            seat //= 2
        winner = a


def history(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All index lines in the order of URL key, time and page; ``range`` and ``place`` give the global order.

    Lines go to ranges of about ``range_rows``; equal URL keys may be split between ranges by time
    and page, so a hot URL is no hot range.
    """
    small_batches(index.sparkSession)
    n = max(1, -(-index.count() // range_rows))
    ordered = ["url_key", "captured", F.col("page_id").isNotNull(), "page_id", "archive", "offset"]
    ranged = index.repartitionByRange(n, *ordered).sortWithinPartitions("archive", "offset")
    names = index.columns
    at = [names.index(c) for c in ("url_key", "captured", "page_id", "archive", "offset")]

    def key(row):
        number = row[at[2]]
        return (row[at[0]], row[at[1]], number is not None, number or 0)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        runs: dict[str, list] = {}
        arrow = None
        for b in batches:
            arrow = b.schema
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                runs.setdefault(row[at[3]], []).append(row)
        out: list = []
        place = 0

        def batch():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, arrow.field(i).type) for i, c in enumerate(cols)], pa.array([part] * len(out), pa.int32()),
                 pa.array(range(place - len(out), place), pa.int64())],
                names=[*names, "range", "place"],
            )

        for row in merge_runs(list(runs.values()), key):
            out.append(row)
            place += 1
            if len(out) == 8192:
                yield batch()
                out.clear()
        if out:
            yield batch()

    schema = ranged.withColumn("range", F.lit(0)).withColumn("place", F.lit(0).cast("long")).schema
    return ranged.mapInArrow(run, schema)


def archive(pages: DataFrame, path: str | None = None, **columns) -> tuple[str, DataFrame]:
    """Write all pages, read the archives back and merge their runs; the folder and the capture history."""
    spark = pages.sparkSession
    folder = path or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    html = columns.get("html", "html")
    limits = records_per_archive(pages, columns.get("url", "url"), html)
    for k, records in sorted(limits.items()) or [(0, 1)]:
        write(plan(pages.filter(size_class(F.col(f"`{html}`")) == k) if len(limits) > 1 else pages, **columns), folder, records)
    return folder, history(materialize(read(spark, folder)))
