"""A splittable, fault-tolerant scan of FASTQ files of any size.

Plain files are cut into byte ranges, gzip files are one range each.  A first pass over the ranges, each in its own task,
counts lines and notes what cannot be read.  From the counts follows at which line of its file a range begins, so the
second pass knows where its records start without guessing, whatever the lines look like.  A record belongs to the range
in which its first line starts, and is read to its end.  Both passes stream: a task holds one line and one batch of rows.

A file that cannot be read to its end (cut or damaged gzip, a vanished file) has no records but an error; the other files
are not disturbed by it.

Local paths and ``file:`` are opened directly, other schemes by Arrow's file systems, which the executors must reach.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from helixspark.plans.scratch import keep

SPLIT_BYTES = TASK_BYTES = 64 << 20
ROWS = 20_000
END = 1 << 62


@dataclass
class Scan:
    """``records``: all whole records of the readable files, valid or not; ``failures``: ``file, error`` of the others."""

    records: DataFrame
    failures: DataFrame


@contextmanager
def opened(path: str):
    """A seekable binary file."""
    if path.startswith(("/", "file:")):
        with open(unquote(path.removeprefix("file:").replace("///", "/", 1)) if path.startswith("file:") else path, "rb") as f:
            yield f
    else:
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        with pa.PythonFile(store.open_input_file(inside), "r") as f:
            yield f


def file_size(path: str) -> int:
    with opened(path) as f:
        return f.seek(0, 2)


def lines_from(path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the lines that start at byte ``start`` or later; what follows the last line feed is a line, too.

    Places in gzip files count from 0 and are those of the unpacked bytes.
    """
    with opened(path) as f:
        stream = gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f
        place = 0
        if start:
            stream.seek(start - 1)
            place = start - 1 + len(stream.readline())
        raw = b"\n"
        for raw in stream:
            yield place, raw
            place += len(raw)
        if raw.endswith(b"\n"):
            yield place, b""


def _blank(raw: bytes) -> bool:
    return not raw.strip() or (raw[0] >= 0x80 and not raw.decode("utf-8", "replace").strip())


def probe(path: str, start: int, end: int, most: int) -> tuple[int, list[int], str | None]:
    """(lines that start in the range, number of the first blank one among each of every four, error)."""
    n, blank = 0, [END] * 4
    try:
        for place, raw in lines_from(path, start):
            if place >= end or n >= most:
                break
            if blank[n % 4] == END and _blank(raw):
                blank[n % 4] = n
            n += 1
    except (OSError, EOFError, zlib.error) as e:
        return n, blank, f"{type(e).__name__}: {e}"
    return n, blank, None


def records_of(path: str, start: int, end: int, first_line: int, stop_line: int) -> Iterator[tuple[int, list[str]]]:
    """(number, four lines) of the records whose first line is in the range and before line ``stop_line`` of the file."""
    held: list[bytes] = []
    line = first_line
    for place, raw in lines_from(path, start):
        if not held:
            if place >= end or line >= stop_line:
                return
            if line % 4:
                line += 1
                continue
        held.append(raw)
        line += 1
        if len(held) == 4:
            yield line // 4 - 1, [x.decode("utf-8", "replace").strip() for x in held]
            held = []


def scan(files: DataFrame, max_reads: int | None = None, split_bytes: int = SPLIT_BYTES) -> Scan:
    """Scan the files ``path`` and any other columns; records are ``READS`` of :mod:`fastq` with those columns.

    With ``max_reads`` a file's first so many records are read, in order and no further.  A blank first line of a record
    ends its file.
    """
    others = [c for c in files.columns if c != "path"]
    n_files = files.count()
    sized = _mapped(files.repartition(max(1, min(n_files, 10_000))), "size long, error string", lambda r: [_size(r["path"])], ["path"])
    whole = F.col("path").endswith(".gz") | F.lit(max_reads is not None)
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    last = whole | (F.col("start") + split_bytes >= F.col("size"))
    ranges = keep(sized.withColumn("start", F.explode(F.coalesce(starts, F.array(F.lit(0).cast("long"))))).withColumn("end", F.when(last, F.lit(END)).otherwise(F.col("start") + split_bytes)), "ranges")
    n_ranges, size = ranges.agg(F.count("*"), F.sum(F.coalesce(F.least("end", "size") - F.col("start"), F.lit(0)))).first()
    # a task for each TASK_BYTES, or as many as run at a time: small ranges share tasks
    tasks = max(1, min(n_ranges, 100_000, max(-(-(size or 0) // TASK_BYTES), 2 * files.sparkSession.sparkContext.defaultParallelism)))
    most = END if max_reads is None else 4 * max_reads

    def look(r: dict) -> list[tuple]:
        if r["error"] is not None:
            return [(0, [END] * 4, r["error"])]
        return [probe(r["path"], r["start"], r["end"], most)]

    looked = _mapped(ranges.repartition(tasks), "n_lines long, blank array<long>, failed string", look, ["path", "start", "end", "error"])
    own = Window.partitionBy("path")
    first = F.coalesce(F.sum("n_lines").over(own.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = looked.withColumn("first_line", first).withColumn("failed", F.max("failed").over(own))
    header = F.get("blank", F.pmod(-F.col("first_line"), F.lit(4)).cast("int"))
    stop = F.least(F.min(F.when(header < END, F.col("first_line") + header)).over(own), F.lit(most))
    plan = keep(placed.withColumn("stop_line", stop), "scan")

    def read(r: dict) -> Iterator[tuple]:
        for no, (head, seq, plus, qual) in records_of(r["path"], r["start"], r["end"], r["first_line"], r["stop_line"]):
            yield r["path"], no, head, seq.upper(), plus, qual

    wanted = plan.where("failed is null and first_line < stop_line and n_lines > 0")
    out = _mapped(wanted.repartition(tasks), "file string, read_no long, header string, seq string, plus string, qual string", read, ["path", "start", "end", "first_line", "stop_line"])
    failures = plan.where("failed is not null").select(F.col("path").alias("file"), F.col("failed").alias("error"), *others).distinct()
    return Scan(out.select("file", "read_no", "header", "seq", "plus", "qual", *others), failures)


def _size(path: str) -> tuple[int | None, str | None]:
    try:
        return file_size(path), None
    except OSError as e:
        return None, f"{type(e).__name__}: {e}"


def _mapped(rows: DataFrame, added: str, make, inputs: list[str]) -> DataFrame:
    """Each row once for every tuple that ``make`` gives for it, with the columns ``added``."""
    schema = rows.sparkSession.createDataFrame([], added).schema
    names, width = rows.columns, len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.select(inputs).to_pylist()
            held: list[tuple] = []
            of: list[int] = []

            def flush(batch=batch) -> pa.RecordBatch:
                kept = batch.take(pa.array(of, pa.int64()))
                made = pa.table(list(zip(*held, strict=True)) if held else [[]] * width, schema=arrow)
                return pa.RecordBatch.from_arrays([*kept.columns, *[c.combine_chunks() for c in made.columns]], [*names, *made.schema.names])

            for i, row in enumerate(given):
                for x in make(row):
                    held.append(x)
                    of.append(i)
                    if len(held) >= ROWS:
                        yield flush()
                        held.clear()
                        of.clear()
            if held:
                yield flush()

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *schema.fields]))
