"""WARC archives and their capture index.

Writing: every page becomes a record. Payloads are grouped by digest; the
smallest id of a group is written as a response, the others as revisits that
refer to it. Records are text in UTF-8 and end with two line ends, so Spark's
text writer with that separator writes plain WARC files to any storage.

Reading: a file is cut into records by their Content-Length. Each file gives
one run of captures, sorted by URL key and time as it is read.

Index: runs are cut at common points of the order (Spark's range partitioning
samples them) and each range merges its pieces of the k runs with a loser tree.
Ranges in order are the captures in global order, the history of each URL key
in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

END = "\r\n\r\n"
#: Payload bytes that a file holds on average, and captures that a range does.
FILE_BYTES = 8 << 20
RANGE_ROWS = 20_000

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CAPTURE = (
    "run string, at long, url_key string, ts string, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, offset long, length long"
)


def base32(hex40: Column) -> Column:
    """40 hexadecimal digits as 32 of base 32: ten of the one are eight of the other."""
    parts = [
        F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def url_key(url: str | None) -> str:
    """The URL in the order of its parts' weight: host reversed, then path and query, no fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return (url or "").strip().lower()
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    query = "?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{host}{port}){parts.path.lower() or '/'}{query}"


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0
) -> None:
    """Writes a record per row of pages to WARC files under path.

    Rows whose payload has at least least_bytes bytes and equals that of a row
    with a smaller id are revisits. A null html is an empty payload, a null URL is
    left out of the header. Rows that repeat the smallest id of a group are
    responses as it is. A null id counts as larger than any. The capture time is the id in seconds since 2024
    (the table has none), so reruns write the same records.
    """
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), html.alias("html"))
    rows = rows.withColumns({
        "bytes": F.octet_length("html").cast("long"), "sha": F.sha1("html"), "strong": F.sha2("html", 256),
    })
    # Which rows are revisits is settled on ids and digests; payloads meet that small table once.
    digests = rows.filter(F.col("bytes") >= least_bytes).select("page_id", "strong")
    first = digests.groupBy("strong").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("f"), F.count("*").alias("n")
    )
    first = first.filter("n > 1").select(F.col("strong").alias("s"), F.col("f.page_id").alias("first_id"))
    again = digests.join(first, F.col("strong") == F.col("s")).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = written(again.select(F.col("page_id").alias("again_id"), "s", "first_id").distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("strong") == F.col("s"))
    joined = rows.join(again, same, "left")
    revisit = F.col("s").isNotNull()
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + F.lit(1704067200)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    joined = joined.withColumn("revisit", revisit).withColumn("body", F.when(F.col("revisit"), "").otherwise(F.col("html")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: "), digest),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length("body").cast("string")),
    )
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES))
    out = joined.select(F.concat(head, F.lit(END), F.col("body")).alias("value"), F.xxhash64("page_id", "url").alias("k"))
    out.repartition(int(files), "k").select("value").write.option("lineSep", END).option("compression", "gzip").text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields (lower case), payload, offset and length of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, data[start:stop], at, stop + 4 - at
        at = stop + 4


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import base64
    import gzip
    import hashlib

    number = lambda v: None if v in (None, "<urn:page:none>") else int(v[len("<urn:page:") : -1])
    names = [c.split()[0] for c in _CAPTURE.split(", ")]
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in _CAPTURE.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            run = []
            for f, payload, offset, length in records(data):
                digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                if f["warc-type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (found, len(payload)) != (digest, size):
                        raise ValueError(f"{path}: the payload at byte {offset} isn't the one that was written")
                url = f.get("warc-target-uri")
                run.append((url_key(url), f["warc-date"], number(f["warc-record-id"]), url, f["warc-type"], size, digest,
                            number(f.get("warc-refers-to")), offset, length))
            run.sort(key=_order)
            columns = [[path] * len(run), range(len(run)), *(zip(*run, strict=True) if run else [[]] * (len(names) - 2))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _order(row: tuple) -> tuple:
    return row[0].encode(), row[1], row[2] is None, row[2] or 0


def merged(runs: list[Iterable[tuple]], key=_order) -> Iterator[tuple]:
    """Merges sorted runs with a loser tree: one comparison a level for each row.

    Inner node i keeps the loser of its match; the winner of all stands at 0. Runs
    are leaves; an exhausted run loses to every other. Of equal rows that of the
    earlier run comes first.
    """
    feeds = [iter(r) for r in runs]
    k = len(feeds)
    if not k:
        return

    def pull(i: int) -> tuple:
        row = next(feeds[i], None)
        return (1, (), i, None) if row is None else (0, key(row), i, row)

    heads = [pull(i) for i in range(k)]
    tree = [-1] * k
    for leaf in range(k):  # plays each leaf up to the first place without a match
        winner, node = leaf, (leaf + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                break
            if heads[tree[node]][:3] < heads[winner][:3]:
                tree[node], winner = winner, tree[node]
            node //= 2
        else:
            tree[0] = winner
    while True:
        winner = tree[0]
        if heads[winner][0]:
            return
        yield heads[winner][3]
        heads[winner] = pull(winner)
        node = (winner + k) // 2
        while node:
            if heads[tree[node]][:3] < heads[winner][:3]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range, sorted by run and place, as one sorted sequence."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    runs: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[0], []).append(row)
    if schema is None:
        return
    nth, some = 0, []

    def out() -> pa.RecordBatch:
        n = len(some)
        columns = [pa.array(list(c), t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array(range(nth - n, nth), pa.int64()), *columns],
            ["part", "nth", *schema.names],
        )

    for row in merged(list(runs.values()), key=lambda r: _order(r[2:])):
        nth += 1
        some.append(row)
        if len(some) == 10_000:
            yield out()
            some = []
    if some:
        yield out()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures in the files under path: of each file a run, with the places of its rows.

    offset and length are in bytes of the file before compression.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(_runs, _CAPTURE)


def capture_index(captures: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """part, nth and the captures' columns: all captures by URL key, time and id.

    part and nth together are the global order. Time and id are part of the order
    that ranges are cut by, so no range grows with a URL key; one range of about
    range_rows captures is held in memory at a time. Empty input gives an empty
    index.
    """
    runs = written(captures, "runs")
    parts = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(parts, "url_key", "ts", F.col("page_id").isNull(), "page_id")
    return dealt.sortWithinPartitions("run", "at").mapInArrow(_merge_range, "part int, nth long, " + _CAPTURE)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    index = capture_index(read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
