"""One prompt per chunk, with the texts moved once.

The members of the chunks are numbers; their texts lie in the files.  Both go,
as one union, through one range partitioning by corpus order, so that a
member's row arrives just before its text, and the members of a chunk arrive
one after the other.  Prompts are put together where the rows arrive.  A chunk
that may go on in the next slice (the first and the last of each) is sent on
in pieces: they are joined by chunk, at most two pieces' worth of a chunk for
each bound between slices.

Texts are formed in place (``chunking.member_texts``); texts without a member
row (of chunks that are not asked for) end at the exchange's other side.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.operators.chunking import member_texts
from revlens.plans.session import ensure_checkpoint_dir, shuffle_partitions

_ORDER = ["p", "lkey", "file", "part", "tokens", "lines", "kind"]
_PIECE = ("project string, chunk_id bigint, n_chunks bigint, n_files bigint, tokens bigint, first int, body string, payload string, signature string")


def _key(project: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), project), F.lit(""))


def _file_of(relative: Column, part_no: Column, part_count: Column) -> Column:
    """The file of a member: a part's label ends in ' [part i/n]'."""
    label = F.format_string(" [part %d/%d]", part_no, part_count)
    return F.when(part_no.isNull(), relative).otherwise(F.substring(relative, F.lit(1), F.length(relative) - F.length(label)))


def _stitch(whole: bool):
    """Joins members and texts; emits the chunks that lie inside the slice
    (``whole``) or the pieces of those that may not."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_PIECE))
    names = ["p", "project", "lkey", "file", "part", "kind", "chunk_id", "n_chunks", "pos", "label", "lines", "tokens", "chars", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque = deque()
        at = key = None
        blocks: list[str] = []
        payloads: list[str] = []
        total, first_of_slice = 0, True

        def piece() -> dict:
            payload = "|".join(payloads)
            return {"project": at["project"], "chunk_id": at["chunk_id"], "n_chunks": at["n_chunks"], "n_files": len(blocks), "tokens": total,
                    "first": at["pos"], "body": "\n".join(blocks), "payload": None if whole else payload,
                    "signature": hashlib.sha256(payload.encode()).hexdigest()}

        out: list[dict] = []
        size = 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for r in map(lambda v: dict(zip(names, v)), zip(*[part.column(part.schema.get_field_index(n)).to_pylist() for n in names])):
                    here = (r["p"], r["file"], r["part"], r["tokens"], r["lines"])
                    if here != key:
                        waiting.clear()
                        key = here
                    if r["kind"] == 0:
                        waiting.append(r)
                        continue
                    if not waiting:
                        continue        # nobody asks for this text
                    m = waiting.popleft()
                    if at is None or (m["p"], m["chunk_id"]) != (at["p"], at["chunk_id"]):
                        if at is not None:
                            inside = not (first_of_slice and at["pos"] > 0)
                            first_of_slice = False
                            if inside == whole:
                                out.append(piece())
                                size += len(out[-1]["body"])
                        at, total = m, 0
                        blocks.clear()
                        payloads.clear()
                    blocks.append(K.FILE_BLOCK.format(name=m["label"], loc=m["lines"], text=r["text"]))
                    payloads.append(f"{m['label']}:{m['lines']}:{m['tokens']}:{m['chars']}")
                    total += m["tokens"]
                    if size > 1 << 22 or len(out) > 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
        if at is not None and not whole:
            out.append(piece())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def render_prompts(members: DataFrame, files: DataFrame, budget: int, num_partitions: int | None = None) -> DataFrame:
    """(project, chunk_id, n_files, tokens, signature, prompt) of the chunks in
    ``members`` (some or all of ``pack_chunks`` of the files): a header with
    the chunk's number and the number of chunks, then a block per member."""
    counts = members.groupBy(_key(F.col("project")).alias("_p")).agg(F.max("chunk_id").alias("n_chunks"))
    asked = members.join(counts, _key(F.col("project")) == F.col("_p")).drop("_p")
    file = _file_of(F.col("relative"), F.col("part_no"), F.col("part_count"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = asked.select(_key(F.col("project")).alias("p"), "project", F.lower(file).alias("lkey"), file.alias("file"),
                        F.coalesce("part_no", F.lit(0)).alias("part"), F.lit(0).alias("kind"), "chunk_id", "n_chunks", "pos",
                        F.col("relative").alias("label"), "lines", "tokens", "chars", none("string").alias("text"))
    t = member_texts(files, budget)
    own = _file_of(F.col("relative"), F.col("part_no"), F.col("part_count"))
    texts = t.select(_key(F.col("project")).alias("p"), "project", F.lower(own).alias("lkey"), own.alias("file"),
                     F.coalesce("part_no", F.lit(0)).alias("part"), F.lit(1).alias("kind"), none("bigint").alias("chunk_id"),
                     none("bigint").alias("n_chunks"), none("int").alias("pos"), none("string").alias("label"), "lines", "tokens",
                     none("bigint").alias("chars"), "text")
    n = num_partitions or shuffle_partitions(files.sparkSession)
    sliced = rows.unionByName(texts).repartitionByRange(n, *_ORDER[:-1]).sortWithinPartitions(*_ORDER)    # a text follows its member
    if files.sparkSession.conf.get("spark.sql.exchange.reuse", "true") != "true":
        ensure_checkpoint_dir(files.sparkSession)      # the bounds are sampled: read the slices once
        sliced = sliced.checkpoint(eager=True)
    done = sliced.mapInArrow(_stitch(True), _PIECE).select("project", "chunk_id", "n_chunks", "n_files", "tokens", "signature", "body")
    pieces = sliced.mapInArrow(_stitch(False), _PIECE)
    items = F.array_sort(F.collect_list(F.struct("first", "body", "payload")))      # a chunk's members fit its budget
    joined = pieces.groupBy("project", "chunk_id", "n_chunks").agg(
        F.sum("n_files").alias("n_files"), F.sum("tokens").alias("tokens"),
        F.sha2(F.array_join(F.transform(items, lambda x: x["payload"]), "|"), 256).alias("signature"),
        F.array_join(F.transform(items, lambda x: x["body"]), "\n").alias("body"))
    header = F.format_string(K.PROMPT_HEADER, F.col("project"), F.col("chunk_id"), F.col("n_chunks"))
    return done.unionByName(joined).select("project", "chunk_id", "n_files", "tokens", "signature", F.concat(header, F.col("body")).alias("prompt"))
