"""One finished document per report, on any file system Arrow opens.

A page is ordered rows of text and may be larger than a task should hold, so
it is written in two steps:

1. the rows, sorted by (report, section, seq) in range partitions, go to a
   Python data source writer.  A task writes one part file per report it
   meets, under a name of its attempt, and a list of its parts; the job
   commit names the lists of the tasks that were committed, so parts of
   failed or repeated attempts are never read;
2. the parts of each report are put together in order by one task a report,
   copied in blocks, and the finished file is moved to its name.

The rows of a page end in a line break each but the last.  Parts lie below
``_parts-...`` beside the reports and are removed at the end.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from revlens.plans.session import shuffle_partitions
from revlens.sources.corpus_tree import open_file_system

COPY_BYTES = 4 << 20
_PART = "report string, section int, seq bigint, part string, bytes bigint"


class _Done(WriterCommitMessage):
    """The list of parts that a committed task wrote."""

    def __init__(self, parts: str | None):
        self.parts = parts


class _PartWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        fs, top = open_file_system(self.folder)
        context = TaskContext.get()
        me = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        parts, current, out, begun = [], None, None, False
        for batch in iterator:
            for r in batch.to_pylist():
                if current is None or r["report"] != current["report"]:
                    if out is not None:
                        out.close()
                    path = posixpath.join(top, f"{me}-{len(parts):06d}")
                    current = {"report": r["report"], "section": r["section"], "seq": r["seq"], "part": path, "bytes": 0}
                    parts.append(current)
                    out, begun = fs.open_output_stream(path, compression=None), False
                line = ("\n" if begun else "") + (r["html"] or "")
                current["bytes"] += out.write(line.encode())
                begun = True
        if out is None:
            return _Done(None)
        out.close()
        listed = posixpath.join(top, f"{me}.json")
        with fs.open_output_stream(listed, compression=None) as f:
            f.write("".join(json.dumps(p) + "\n" for p in parts).encode())
        return _Done(posixpath.basename(listed))

    def commit(self, messages: list[_Done | None]) -> None:
        fs, top = open_file_system(self.folder)
        with fs.open_output_stream(posixpath.join(top, "committed"), compression=None) as f:
            f.write("\n".join(m.parts for m in messages if m is not None and m.parts).encode())

    def abort(self, messages: list[_Done | None]) -> None:
        fs, top = open_file_system(self.folder)
        fs.delete_dir_contents(top)


class ReportPartSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "revlens_report_parts"

    def writer(self, schema, overwrite: bool) -> _PartWriter:
        return _PartWriter(self.options["path"])


def _assemble(folder: str, target: str):
    """Parts sorted by report and order -> one row (report, bytes) a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_file_system(folder)
        _, final = open_file_system(target)
        current, out, size, temp = None, None, 0, ""
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.close()
            fs.move(temp, posixpath.join(final, current))
            done.append((current, size))

        for b in batches:
            for r in b.to_pylist():
                if r["report"] != current:
                    if out is not None:
                        close()
                    current, size, temp = r["report"], 0, posixpath.join(top, f"page-{uuid.uuid4().hex}")
                    out = fs.open_output_stream(temp, compression=None)
                else:
                    size += out.write(b"\n")
                with fs.open_input_stream(r["part"], compression=None) as f:
                    while block := f.read(COPY_BYTES):
                        size += out.write(block)
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"report": [n for n, _ in done], "bytes": [n for _, n in done]},
                                         schema=pa.schema([("report", pa.string()), ("bytes", pa.int64())]))

    return run


def write_pages(rows: DataFrame, path: str, num_partitions: int | None = None) -> DataFrame:
    """Write rows (report, section, seq, html) as one file per report below
    ``path``; returns (report, bytes)."""
    spark: SparkSession = rows.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    target = path.rstrip("/")
    folder = f"{target}/_parts-{uuid.uuid4().hex}"
    fs, top = open_file_system(folder)
    fs.create_dir(top, recursive=True)
    spark.dataSource.register(ReportPartSource)
    order = ["report", "section", "seq"]
    (rows.select(F.col("report"), F.col("section").cast("int"), F.col("seq").cast("bigint"), "html")
     .repartitionByRange(n, *order).sortWithinPartitions(*order)
     .write.format("revlens_report_parts").mode("append").save(folder))
    with fs.open_input_stream(posixpath.join(top, "committed"), compression=None) as f:
        lists = f.read().decode().split()       # one name a task
    parts = _read_lists(spark, folder, lists)
    written = [tuple(r) for r in (parts.repartition(n, "report").sortWithinPartitions(*order)
                                  .mapInArrow(_assemble(folder, target), "report string, bytes bigint")
                                  .groupBy().agg(F.count("*"), F.sum("bytes")).collect())]
    fs.delete_dir(top)
    return spark.createDataFrame(written, "reports bigint, bytes bigint")


def _read_lists(spark: SparkSession, folder: str, lists: list[str]) -> DataFrame:
    """The parts of the committed tasks, read by tasks."""
    schema = pa.schema([("report", pa.string()), ("section", pa.int32()), ("seq", pa.int64()), ("part", pa.string()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(posixpath.join(top, name), compression=None) as f:
                    rows = [json.loads(line) for line in f.read().decode().split("\n") if line]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.createDataFrame([(x,) for x in lists], "list string").mapInArrow(run, _PART)
