"""Web archives: writing WARC records, and reading them back by verified record boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoptrail.session import materialize

MAGIC = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(name: str, value: Column) -> Column:
    """A header line; a NULL value gives none."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, revisit_from: int = 100,
                  compression: str = "gzip") -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) below ``path``.

    Of rows with equal payloads (the html in UTF-8, NULL as empty) of at least ``revisit_from``
    bytes, those with the smallest page_id become ``response`` records and the others ``revisit``
    records that refer to it and repeat no payload. Smaller payloads are all responses. NULL ids
    and urls give no header; control characters in urls become spaces; repeated rows with the
    smallest id are all responses; an empty table gives no records.

    The digests are counted narrow; one shuffle by digest meets the payloads with their smallest
    id, and adaptive execution splits a digest of very many rows. Spark's text writer ends each
    record with the two line ends that the format asks for.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"bytes": F.octet_length("html"), "digest": F.sha2(F.col("html").cast("binary"), 256)}
    )
    large = F.col("bytes") >= revisit_from
    # Small payloads meet nothing; keys of their own keep them apart.
    key = F.when(large, F.col("digest")).otherwise(
        F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    )
    rows = rows.withColumn("key", key)
    first = rows.where(large).groupBy("key").agg(F.min("page_id").alias("first"))
    # A small payload has no first; nor has a group whose ids are all NULL.
    joined = rows.join(first, "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    url = F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")
    text = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(again, F.lit(_REVISIT))),
        _header("WARC-Refers-To", F.when(
            again, F.concat(F.lit("<urn:page:"), F.col("first"), F.lit(">")))),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.when(again, F.lit(0)).otherwise(F.col("bytes")),
        F.lit(_END),
        F.when(again, F.lit("")).otherwise(F.col("html")),
    )
    joined.select(text.alias("value")).write.option("lineSep", _END).option(
        "compression", compression
    ).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The text after each magic, with what orders it within its file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def _field(head: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*{pattern}", 1)
    return F.when(found != "", found)


def _payload(value: Column, head: Column, length: Column) -> Column:
    start = F.octet_length(head) + len(_END) + 1
    return value.cast("binary").substr(start.cast("int"), length.cast("int"))


_CANDIDATE = (
    "file string, block long, row long, bytes long, page_id long, record_type string,"
    " uri string, stated_digest string, refers_to long, head long, length long, digest string"
)


def _candidates(segments: DataFrame) -> DataFrame:
    """Every place of the magic as if a record began there."""
    value = F.col("value")
    head = F.when(F.instr(value, _END) > 0, F.substring_index(value, _END, 1))
    length = _field(head, "Content-Length", "([0-9]{1,18})(?=\r\n|$)").cast("long")
    whole = F.octet_length(value) >= F.octet_length(head) + len(_END) + length
    return segments.select(
        "file", "block", "row",
        F.octet_length(value).cast("long").alias("bytes"),
        _field(head, "WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field(head, "WARC-Type", "([a-z]+)").alias("record_type"),
        _field(head, "WARC-Target-URI", "([^\r\n]*)").alias("uri"),
        _field(head, "WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("stated_digest"),
        _field(head, "WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        (F.octet_length(head) + len(_END)).cast("long").alias("head"),
        length.alias("length"),
        F.when(whole, F.sha2(_payload(value, head, length), 256)).alias("digest"),
    )


def reachable(starts: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 meets, by pointer jumping.

    In every round each reached record marks the one that its pointer names, and all pointers
    double; so a file of n records takes log2(n) rounds.
    """
    n = len(starts)
    jump = np.searchsorted(starts, following)
    known = (jump < n) & (starts[np.minimum(jump, n - 1)] == following)
    jump = np.append(np.where(known, jump, n), n)
    reached = np.append(starts == 0, False)
    while True:
        marked = reached.copy()
        marked[jump[reached]] = True
        marked[n] = False
        jump = jump[jump]
        if np.array_equal(marked, reached):
            return reached[:n]
        reached = marked


def _chain(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The true records of one file."""
    order = np.lexsort((rows.column("row").to_numpy(), rows.column("block").to_numpy()))
    rows = rows.take(pa.array(order))
    size = rows.column("bytes").to_numpy().astype(np.int64) + len(MAGIC)
    starts = np.cumsum(size) - size - len(MAGIC)
    head, length = (
        rows.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("head", "length")
    )
    real = (head >= 0) & (length >= 0) & (starts >= 0)
    following = np.where(real, starts + len(MAGIC) + head + length + len(_END), -1)
    kept = np.flatnonzero(reachable(starts, following) & real)
    out = rows.take(pa.array(kept)).append_column("start", pa.array(starts[kept]))
    return out.select(["file", "page_id", "record_type", "uri", "stated_digest", "refers_to",
                       "length", "digest", "start"])


_RECORD = (
    "file string, page_id long, record_type string, uri string, stated_digest string,"
    " refers_to long, length long, digest string, start long"
)


def _rebuilt(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Digests of the records that the magic in their payload cut apart: (file, start, digest).

    Only their files are read again.
    """
    cut = records.where("digest IS NULL").select("file", "start", "length")
    files = cut.select("file").distinct()
    order = Window.partitionBy("file").orderBy("block", "row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("value") + len(MAGIC)
    placed = _segments(spark, path).join(files, "file", "left_semi").withColumn(
        "at", F.coalesce(F.sum(size).over(before), F.lit(0)) - len(MAGIC)
    )
    begun = records.select("file", F.col("start").alias("at"), F.col("start").alias("begun"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = placed.join(begun, ["file", "at"], "left").withColumn(
        "start", F.last("begun", ignorenulls=True).over(upto)
    )
    wanted = owned.join(cut, ["file", "start"])
    parts = wanted.groupBy("file", "start", "length").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts")
    )
    text = F.array_join(F.col("parts.value"), MAGIC)
    head = F.substring_index(text, _END, 1)
    return parts.select(
        "file", "start", F.sha2(_payload(text, head, F.col("length")), 256).alias("rebuilt")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files below ``path``.

    Returns file, start, page_id, record_type, uri, payload_bytes, payload_digest (of the bytes
    read, bare hex), intact (it equals the stated one) and refers_to. A revisit has the size and
    digest of the response it refers to; they are NULL, and intact false, if that is missing.

    Tasks split the files at every magic, also at those inside payloads, and state for each place
    where a record beginning there would end. Offsets are sums of the lengths before, so they need
    no second look at the file; pointer jumping from the start of each file keeps the records that
    the chain reaches. A file's candidates meet in one task: they are narrow, and archive files are
    of bounded size. Damage in a chain ends its file there.
    """
    spots = _candidates(_segments(spark, path))
    records = spots.groupBy("file").applyInArrow(_chain, _RECORD)
    same = records = materialize(records, "warc-records")
    if not records.where("digest IS NULL").isEmpty():
        same = records.join(_rebuilt(spark, path, records), ["file", "start"], "left").withColumn(
            "digest", F.coalesce("digest", "rebuilt")
        )
    responses = same.where("record_type = 'response'").groupBy("digest").agg(
        F.max("length").alias("full")
    ).withColumnRenamed("digest", "known")
    revisit = F.col("record_type") == "revisit"
    key = F.when(revisit, F.col("stated_digest")).otherwise(
        F.concat(F.lit("-"), F.xxhash64("file", "start").cast("string"))
    )
    full = same.withColumn("key", key).join(responses, F.col("key") == F.col("known"), "left")
    digest = F.when(revisit, F.col("known")).otherwise(F.col("digest"))
    return full.select(
        "file", "start", "page_id", "record_type", "uri",
        F.when(revisit, F.col("full")).otherwise(F.col("length")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.coalesce(digest == F.col("stated_digest"), F.lit(False)).alias("intact"),
        "refers_to",
    )
