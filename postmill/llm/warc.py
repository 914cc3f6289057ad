"""WARC archives: writing with revisits, reading back, and a merged index of captures.

Writing: payloads that occur more than once get one response record, the others refer to it. Archives are
written by Spark's text writer, one record a row, gzipped. Reading streams their lines through a task, so
neither an archive nor its compressed file is held whole: a task holds the record that it is at.

Index: every archive gives captures, which a task sorts by (URL key, timestamp, page) into a local run. Runs
are cut at global range borders; all pieces of a range meet in one task, which merges them with a loser
tree. Ranges are cut by (key, timestamp, page), so a URL with very many captures is split over ranges, and
the ranges in order are the capture history of all archives.

Null payloads are empty. Null urls have no target header and an empty key. Line breaks and control characters in a url are
percent-encoded. Rows with the same page id are separate records of one page. Null times are the epoch. An empty
table gives no records; of a table's columns only id, url, payload and time are read, whatever else there is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, _parse_datatype_string

from postmill.llm.common import staged
from postmill.session import work_folder

#: Payloads of fewer bytes are always stored as responses.
REVISIT_BYTES = 1000
CRLF = "\r\n"
#: Records of one archive file at most; a file is what one task reads at the least.
RECORDS_PER_FILE = 2000
#: Lines of an archive that are put together at a time.
LINES = 1000
#: Captures of one range of the merged index.
RANGE_ROWS = 50_000
RECORD = "page_id long, record_type string, refers_to long, url string, ts string, payload_bytes long, payload_digest string, payload binary"


def with_record_types(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """All columns with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    The largest page id of a payload is the response. Only digests are aggregated, with partial results
    before the exchange, and only digests that repeat are joined back; a hot one can be split on that side.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body)})
    keys = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max(page_id).alias("_first"), F.count("*").alias("_n"))
    keys = staged(keys.where("_n > 1").drop("_n"), "repeats")
    joined = rows.join(keys, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("_first") != F.col(page_id))
    return joined.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("_first")),
    }).drop("_first")


def _clean(c) -> F.Column:
    """Control characters percent-encoded, so that a header stays one line."""
    for code in (13, 10, 9):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return c


def records(typed: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", ts=None) -> DataFrame:
    """One text column ``value``: a WARC record per row, without the two line ends that close it.

    ``ts`` is a timestamp; without one a record's time is the epoch plus the page id in seconds. Times are in UTC with
    microseconds, so that they sort as text. A revisit holds the response's head only, with length and digest of its
    payload in the headers.
    """
    ts = F.timestamp_seconds(F.coalesce(F.col(page_id), F.lit(0)) % 4_000_000_000) if ts is None else F.coalesce(ts, F.timestamp_seconds(F.lit(0)))
    ts = F.to_utc_timestamp(ts, F.current_timezone())
    head = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, head).otherwise(F.concat(head, F.coalesce(F.col(payload), F.lit(""))))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    page = F.col(page_id).cast("string")
    headers = [
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page, F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        F.coalesce(line("WARC-Target-URI", _clean(F.col(url))), F.lit("")),
        F.coalesce(line("WARC-Page", page), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    ]
    return typed.select(F.concat(*headers, block).alias("value"))


def write_archives(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive that comes in pieces."""
    held = bytearray()
    at = 0

    def more() -> bool:
        piece = next(chunks, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while held[at : at + 2] == b"\r\n" or (len(held) - at < 2 and more()):
            if held[at : at + 2] == b"\r\n":
                at += 2
        if at >= len(held):
            return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("the archive ends within a record's headers")
        lines = held[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts here: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        while len(held) < stop:
            if not more():
                raise ValueError("the archive ends within a record's block")
        yield headers, bytes(held[end + 4 : stop])
        at = stop
        if at > 1 << 20:
            del held[:at]
            at = 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """The bytes of archives, from their lines in order; every line ends with a line feed."""
    for batch in batches:
        for i in range(0, batch.num_rows, LINES):
            yield b"".join([line + b"\n" for line in batch.column(0).slice(i, LINES).to_pylist()])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all gzipped archives under ``path``. Length and digest of a response are those of the payload read,
    those of a revisit come from its headers; a revisit has no payload.

    A gzipped file is never split, and a task's files come one after the other, each ending with a whole record.
    """

    def page_of(name: str | None) -> int | None:
        return None if name is None else int(name.removeprefix("<urn:page:").removesuffix(">"))

    fields = _parse_datatype_string(RECORD if payloads else RECORD.removesuffix(", payload binary"))
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, schema)

        for h, block in parse(_chunks(batches)):
            body = block[block.find(b"\r\n\r\n") + 4 :]
            again = h["WARC-Type"] == "revisit"
            row = {
                "page_id": int(h["WARC-Page"]) if "WARC-Page" in h else None, "record_type": h["WARC-Type"],
                "refers_to": page_of(h.get("WARC-Refers-To")), "url": h.get("WARC-Target-URI"), "ts": h["WARC-Date"],
                "payload_bytes": int(h["WARC-Payload-Length"]) if again else len(body),
                "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:") if again else hashlib.sha1(body).hexdigest(),
            }
            held.append(row | ({"payload": None if again else body} if payloads else {}))
            size += len(body) * payloads + 300
            if size > 1 << 22:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, fields)


def url_key(url) -> F.Column:
    """Host labels in reverse order, then what follows the host; empty for null."""
    c = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(c, r"(?s)^.*?://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


class LoserTree:
    """Merges sorted runs; each inner node holds the run that lost there, ``top`` the run with the least head."""

    def __init__(self, runs: list[list]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.top = -1
        for i in range(len(runs)):
            self._play(i, build=True)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a goes before run b: an ended run goes last, ties go to the smaller run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, run: int, build: bool = False) -> None:
        node = (run + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and build:
                self.losers[node] = run
                return
            if other >= 0 and self._less(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.top = run

    def __iter__(self):
        while self.top >= 0 and (head := self.heads[self.top]) is not None:
            yield head
            self.heads[self.top] = next(self.runs[self.top], None)
            self._play(self.top)


def merge_index(captures: DataFrame, order: tuple[str, ...] = ("url_key", "ts", "page_id"), range_rows: int = RANGE_ROWS) -> DataFrame:
    """All columns with ``range_no`` and ``position``, which put the captures in the order of ``order``.

    ``order`` columns must hold no nulls but in the last, where null goes first.
    """
    captures = captures.drop("range_no", "position")
    cols = captures.columns
    schema = captures.schema
    run_column = "run_" + "_".join(cols)  # no column's name
    at = [cols.index(c) for c in order]

    def key(row: tuple) -> tuple:
        last = row[at[-1]]
        return (*[row[i] for i in at[:-1]], last is not None, last if last is not None else 0)

    def rows_of(part: pa.RecordBatch) -> list[tuple]:
        return list(zip(*[c.to_pylist() for c in part.columns], strict=True)) if part.num_rows else []

    def batch_of(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    def sort_runs(batches):
        from pyspark import TaskContext

        fields = to_arrow_schema(schema).append(pa.field(run_column, pa.int64()))
        base = TaskContext.get().partitionId() << 32
        for n, b in enumerate(batches):
            rows = sorted(rows_of(b), key=key)
            if rows:
                yield batch_of([(*r, base + n) for r in rows], fields)

    def merge_runs(batches):
        from pyspark import TaskContext

        fields = to_arrow_schema(schema).append(pa.field("range_no", pa.int32())).append(pa.field("position", pa.int64()))
        part = TaskContext.get().partitionId()
        runs: dict[int, list] = {}
        for b in batches:
            for row in rows_of(b):
                runs.setdefault(row[-1], []).append((key(row), row[:-1]))
        pieces = []
        for run in sorted(runs):
            piece = runs[run]
            if any(piece[i][0] > piece[i + 1][0] for i in range(len(piece) - 1)):
                piece.sort(key=lambda r: r[0])  # the exchange does not promise a run's order
            pieces.append([(k, i, r) for i, (k, r) in enumerate(piece)])
        merged = [(*r, part, n) for n, (_, _, r) in enumerate(LoserTree(pieces))]
        for i in range(0, len(merged), 10_000):
            yield batch_of(merged[i : i + 10_000], fields)

    runs = staged(captures.mapInArrow(sort_runs, StructType([*schema.fields, StructField(run_column, LongType())])), "runs")
    n = max(1, -(-runs.count() // range_rows))
    out = StructType([*schema.fields, StructField("range_no", IntegerType()), StructField("position", LongType())])
    return runs.repartitionByRange(n, *order).mapInArrow(merge_runs, out)


def numbered(index: DataFrame) -> DataFrame:
    """A merged index with ``capture_no``, the place of a capture in the whole history, from 1.

    The ranges' sizes give each range's first number; there is one small row for every RANGE_ROWS captures.
    """
    index = staged(index, "index")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = index.groupBy("range_no").agg(F.count("*").alias("_n"))
    first = sizes.select("range_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(first, "range_no").withColumn("capture_no", F.col("_before") + F.col("position") + 1).drop("_before")


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", ts: str | None = None) -> DataFrame:
    """Write ``pages`` as archives under the shared folder, read them back and return the merged index.

    ``ts`` names the timestamp column of the captures; a table without one gets made-up times, by page id.
    """
    path = work_folder(pages.sparkSession, "warc")
    slim = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"), *([] if ts is None else [F.col(ts).cast("timestamp").alias("at")])
    )
    write_archives(records(with_record_types(slim), ts=None if ts is None else F.col("at")), path)
    read = read_archives(pages.sparkSession, path, payloads=False)
    return numbered(merge_index(read.withColumn("url_key", url_key(F.col("url")))))
