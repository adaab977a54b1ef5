"""Structured Streaming: request rates, bursts, finding dedup and the
resumable incremental review.

Event time is ``ts`` (TIMESTAMP_NTZ in the tables; cast to TIMESTAMP, which
``withWatermark`` needs).  Aggregates run in append mode behind a
10-minute watermark, so a window is emitted once the watermark passes its
end; an ``availableNow`` run therefore emits exactly the windows with
``end <= max(ts) - 10 minutes``.  Every run gets a new checkpoint folder
under the session's checkpoint root; results land in a parquet sink there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from revlens.functions import text as X
from revlens.operators import review as E
from revlens.plans.session import checkpoint_root
from revlens.sources.fixtures import attempts_from_events, replies_from_documents
from revlens.sources.tables import read_table

WATERMARK = "10 minutes"
TPM_LIMIT = 8_000          # README example limit (tokens per minute)
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def stream_table(spark: SparkSession, data_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A table of the data directory as a file stream (schema from the batch
    reader; a glob path because the file source wants a directory)."""
    schema = read_table(spark, data_dir, name).schema
    r = spark.readStream.schema(schema).option("basePath", data_dir.rstrip("/"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{data_dir.rstrip('/')}/{name}.parq*")


def stream_dir(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def new_run_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


_STORE = "spark.sql.streaming.stateStore"
ROCKSDB = {f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: For a run that nothing goes on from: a batch commits its changes, not a copy of the store.
CHANGES_ONLY = {f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Streams started within have these settings of the session."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into a parquet sink (own
    checkpoint folder) and return the sink as a batch DataFrame."""
    spark = df.sparkSession
    base = new_run_dir(spark, name)
    w = (df.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").outputMode(mode)
         .trigger(availableNow=True))
    # transformWithState runs on no other store
    keyed = "TransformWithState" in df._jdf.queryExecution().analyzed().toString()
    with _settings(spark, ROCKSDB | CHANGES_ONLY if keyed else {}):
        q = w.start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def _bounds(w: str = "window") -> list:
    return [F.date_format(F.col(f"{w}.start"), TS_FMT).alias("window_start"),
            F.date_format(F.col(f"{w}.end"), TS_FMT).alias("window_end")]


def rate_per_minute(attempts: DataFrame) -> DataFrame:
    """Requests and tokens per provider per minute (tumbling)."""
    a = _event_time(attempts)
    g = a.groupBy(F.window("ts", "1 minute"), "provider").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").cast("bigint").alias("tokens"))
    return g.select(*_bounds(), "provider", "requests", "tokens")


def sliding_rate(attempts: DataFrame, limit_tpm: int = TPM_LIMIT) -> DataFrame:
    """5-minute windows sliding by 1 minute; flag windows whose token
    sum exceeds 5 x the tokens-per-minute limit."""
    a = _event_time(attempts)
    g = a.groupBy(F.window("ts", "5 minutes", "1 minute"), "provider").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").cast("bigint").alias("tokens"))
    return g.select(*_bounds(), "provider", "requests", "tokens",
                    (F.col("tokens") > 5 * limit_tpm).alias("over_limit"))


def review_bursts(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """S3: bursts of activity per user: session windows with a 10-minute gap."""
    e = _event_time(events)
    g = e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("value"))
    return g.select(F.date_format("s.start", TS_FMT).alias("session_start"),
                    F.date_format("s.end", TS_FMT).alias("session_end"), "user_id", "events", "value")


#: Groups of keys that share a call of ``_Earliest``; the rows of a group go to it in blocks of so many bytes at most.
KEY_GROUPS = 1024
BLOCK_BYTES = 16 << 10
#: Bytes of rows that a task holds before it deals them out into blocks.
PACK_BYTES = 32 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each ``_group`` as blocks (Arrow streams) with their latest
    ``ts``: a stateful function in Python pays by the row, whatever its size.
    Rows without a time have blocks of their own, which are never late."""
    def written(rows: pa.RecordBatch) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_batch(rows)
        return sink.getvalue().to_pybytes()

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        of = t.column("_group").to_numpy().astype(np.int32) * 2 + t.column("ts").is_null().to_numpy()
        order = np.argsort(of, kind="stable")
        of, rows = of[order], t.drop_columns("_group").take(pa.array(order)).combine_chunks()
        ts = rows.column("ts").cast(pa.int64()).fill_null(0).to_numpy()
        step = max(1, BLOCK_BYTES * rows.num_rows // max(1, rows.nbytes))
        cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        at = np.concatenate([np.arange(a, b, step) for a, b in zip(cuts[:-1], cuts[1:])])
        latest = pa.array(np.maximum.reduceat(ts, at), mask=of[at] % 2 == 1).cast(t.schema.field("ts").type)
        (body,) = rows.to_batches()
        packed = [written(body.slice(a, b - a)) for a, b in zip(at, np.append(at[1:], len(of)))]
        out = pa.table([pa.array(of[at] // 2, pa.int32()), latest, pa.array(packed, pa.binary())], names=["_group", "ts", "block"])
        yield from out.to_batches(max_chunksize=1_000)

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size > PACK_BYTES:
            yield from dealt(held)
            held, size = [], 0
    if held:
        yield from dealt(held)


class _Earliest(StatefulProcessor):
    """The earliest row of each key among the blocks of a group, late rows left
    out before.  It keeps no state, but only a stateful operator is told the
    watermark.  ``_until`` is the event time moved by what a key is remembered
    beyond the watermark's delay; that of a row without a time is the watermark."""

    def __init__(self, keys: list[str], by: list[str], longer_us: int) -> None:
        self.keys, self.by, self.longer_us = keys, by, longer_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1_000

        def timely() -> Iterator[pa.RecordBatch]:
            for block in (x for pdf in rows for x in pdf["block"]):
                t = pa.ipc.open_stream(block).read_all()
                ts = t.column("ts").cast(pa.int64())
                # Spark may count a row at the watermark itself as late: others of its key go before it
                t = t.append_column("_edge", pc.equal(ts, mark).fill_null(False))
                yield from t.filter(pc.greater_equal(ts, mark).fill_null(True)).to_batches()

        first = _first_rows(timely(), self.keys, ["_edge", *self.by])
        if first is not None:
            until = pc.add(first.column("ts").cast(pa.int64()).fill_null(mark + 1), self.longer_us)
            first = first.drop_columns("_edge").append_column("_until", until.cast(first.schema.field("ts").type))
            # in pandas NULL integers stay integers, and NaN is not NULL
            floats = {t: pd.ArrowDtype(t) for t in (pa.float32(), pa.float64())}
            yield first.to_pandas(integer_object_nulls=True, types_mapper=floats.get, maps_as_pydicts="strict")

    def close(self) -> None:
        pass


def dedup_stream(rows: DataFrame, keys: list[str], order: list[str] | None = None, delay_minutes: int = 10) -> DataFrame:
    """The first row of each key; a key is remembered until the watermark
    passes its event time + delay (that of the watermark at least), and rows
    later than the watermark are dropped.  Of the rows of a key in one batch
    the earliest event stays (ties by ``order``).

    The keys seen are the state of Spark's ``dropDuplicatesWithinWatermark``.
    That would keep whichever row a task reads first, so a batch is cut to the
    earliest timely row of each key before: in groups of keys, since a call of
    Python for each key costs far more than its rows do."""
    longer = delay_minutes - int(WATERMARK.split()[0])
    if longer < 0:
        raise ValueError(f"a key is remembered for {WATERMARK} at least")
    src = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    dealt = src.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).cast("int"))
    blocks = dealt.mapInArrow(_blocks, "_group int, ts timestamp, block binary").withWatermark("ts", WATERMARK)
    first = blocks.groupBy("_group").transformWithStateInPandas(
        _Earliest(keys, ["ts", *(order or [])], longer * 60_000_000), T.StructType([*src.schema, T.StructField("_until", T.TimestampType())]),
        "append", "EventTime", eventTimeColumnName="_until")
    return first.dropDuplicatesWithinWatermark(keys).drop("_until")


# ---------------------------------------------------------------- S5
#: Groups of signatures that share a call of ``_Once``; a group's rows of one batch are held at once.
SIGNATURE_GROUPS = 1024


class _Once(StatefulProcessor):
    """Rows of a chunk signature until one of them completes it.  Within a
    batch rows count in the order of chunk_id (here a text: NULL or a large
    number would not pass pandas).  The completed signatures are looked up
    one by one in a map; a call for each of them costs far more than that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "signature string", "chunk_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        rows = rows.iloc[rows["chunk_id"].map(int).argsort(kind="stable")]
        ok = rows["ok"].astype(int)
        before = ok.groupby(rows["signed"], sort=False).cumsum() - ok
        rows = rows[before == 0]
        done = {s for s in rows["signed"].unique() if self.done.containsKey((s,))} if self.done.exists() else set()
        rows = rows[~rows["signed"].isin(done)] if done else rows
        for s, chunk in rows.loc[rows["ok"].astype(bool), ["signed", "chunk_id"]].itertuples(index=False):
            self.done.updateValue((s,), (chunk,))
        if len(rows):
            yield rows

    def close(self) -> None:
        pass


def _new_replies(rows: DataFrame) -> DataFrame:
    """The replies that come before, or are, the one to complete their chunk."""
    of = F.to_json(F.struct("project", "signature"))
    texts = rows.withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("signed", of)
    texts = texts.withColumn("dealt", F.pmod(F.xxhash64("signed"), F.lit(SIGNATURE_GROUPS)).cast("int"))
    new = texts.groupBy("dealt").transformWithStateInPandas(_Once(), texts.schema, "append", "None")
    return new.drop("dealt", "signed").withColumn("chunk_id", F.col("chunk_id").cast("bigint"))


#: Rows that a task takes in before it drops those that are not the least of their key.
FOLD_ROWS = 20_000


def _first_rows(batches: Iterable[pa.RecordBatch], keys: list[str], by: list[str]) -> pa.Table | None:
    """The row of least ``by`` (NULL last) of each key."""
    def folded(rows: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(rows).combine_chunks()
        order = pc.sort_indices(t, sort_keys=[(c, "ascending") for c in by]).to_numpy()
        code = np.zeros(t.num_rows, np.int64)
        for k in keys:
            d = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(), return_inverse=True)[1]
        return t.take(pa.array(order[np.unique(code[order], return_index=True)[1]])).combine_chunks()

    held, n, kept = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n > FOLD_ROWS + 2 * kept:
            t = folded(held)
            held, n, kept = t.to_batches(), t.num_rows, t.num_rows
    return folded(held) if held else None


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of least (chunk_id, pos) of each ``_key`` of a partition."""
    t = _first_rows(batches, ["_key"], ["chunk_id", "pos"])
    if t is not None:
        yield from t.to_batches(max_chunksize=10_000)


def first_arrivals(found: DataFrame) -> DataFrame:
    """The first arrival of a finding key: the first batch that has it, and in
    it the least (chunk_id, pos).  A batch is cut to one row a key where its
    rows meet, without state; the keys seen are the state of Spark's own
    deduplication, which then has no choice of rows."""
    key = F.concat_ws("\u0000", F.coalesce(F.concat(F.lit("="), "project"), F.lit("")), "dedup_key")
    keyed = found.withColumn("_key", key).repartition("_key")
    return keyed.mapInArrow(_least, keyed.schema).drop("_key").dropDuplicates(["project", "dedup_key"])


def _start(rows: DataFrame, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    """Into a parquet file sink (its log commits a batch once); keyed state
    grows with the keys seen, so it is in the RocksDB store."""
    with _settings(rows.sparkSession, ROCKSDB):
        w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (w.trigger(availableNow=True) if once else w).start()


def review_arrivals(chunks: DataFrame) -> DataFrame:
    """The stateful part of S5 (project, chunk_id, signature, file, text, raw)
    -> one row a new reply (pos NULL; ok, error) and one a finding of it.

    Replies of a completed signature go before any rule or parse of findings
    is run on them.  Findings are those of the reply (E5) and, behind them,
    those of the rules on the chunk's text (E1)."""
    judged = E.parse_replies(chunks).drop("v", "cleaned")
    new = _new_replies(judged.select("project", "signature", "chunk_id", "file", "text", "raw", "ok", "error"))
    parsed = E.parse_replies(new.drop("ok", "error"))
    told = F.coalesce(F.try_variant_get("v", "$.findings", "array<variant>"), F.array().cast("array<variant>"))
    found = F.when(F.col("ok"), F.concat(told, E.rule_objects(F.col("text"), F.col("file"))))
    # a reply without findings keeps one row: an object that is none
    rows = parsed.select("project", "signature", "chunk_id", "ok", "error", F.inline(F.concat(
        F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.parse_json(F.lit("{}")).alias("f"))),
        F.coalesce(F.transform(found, lambda f, i: F.struct(i.cast("int").alias("pos"), f.alias("f"))),
                   F.array().cast("array<struct<pos:int,f:variant>>")))))
    typed = E.typed_findings(rows)
    return typed.withColumn("dedup_key", F.when(F.col("pos").isNotNull(), E.dedup_key(*[F.col(f"k_{n}") for n in E.KEY_FIELDS])))


def incremental_review(chunks: DataFrame, out_dir: str, checkpoint: str, once: bool = True) -> list[StreamingQuery]:
    """Resumable incremental review in two queries.

    ``arrivals`` holds the new replies and all their findings; the completed
    signatures are keyed state.  ``unique`` holds the first arrival of each
    finding (E10), also keyed state, fed by the arrivals.  Nothing written is
    read again: a restarted query goes on from its checkpoint and state.  With
    ``once`` each runs over what is there."""
    out, ck = out_dir.rstrip("/"), checkpoint.rstrip("/")
    spark = chunks.sparkSession
    arrivals = review_arrivals(chunks)
    first = _start(arrivals, f"{out}/arrivals", f"{ck}/arrivals", once)
    if once:
        first.awaitTermination()
    found = stream_dir(spark, f"{out}/arrivals", arrivals.schema).where("pos is not null")
    second = _start(first_arrivals(found), f"{out}/unique", f"{ck}/unique", once)
    if once:
        second.awaitTermination()
    return [first, second]


def open_failures(arrivals: DataFrame) -> DataFrame:
    """The failed chunks that no later reply has completed."""
    replies = arrivals.where("pos is null")
    done = replies.where("ok").select("project", "signature").distinct()
    return replies.where("not ok").join(done, ["project", "signature"], "left_anti").select("project", "chunk_id", "signature", "error")


def chunks_from_documents(docs: DataFrame) -> DataFrame:
    """A stream of documents as chunks of one file each, with the reply the
    fixture gives them."""
    file = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.coalesce(F.col("text"), F.lit(""))
    replies = replies_from_documents(docs.withColumn("kept", text), "kept")
    sig = F.sha2(F.concat_ws(":", "file", X.file_loc("text").cast("string"), X.token_estimate("text").cast("string"),
                             F.length("text").cast("string")), 256)
    return (replies.select("project", "chunk_id", F.concat(F.lit("doc/"), F.col("chunk_id").cast("string"), F.lit(".txt")).alias("file"),
                           F.col("kept").alias("text"), "raw")
            .withColumn("signature", sig))


# ---------------------------------------------------------------- registry
def s1_rate_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return run_available(rate_per_minute(attempts_from_events(stream_table(spark, d, "events"))), "s1")


def s2_sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    return run_available(sliding_rate(attempts_from_events(stream_table(spark, d, "events"))), "s2")


def s3_review_bursts(spark: SparkSession, d: str) -> DataFrame:
    return run_available(review_bursts(stream_table(spark, d, "events")), "s3")


def s4_dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    a = attempts_from_events(stream_table(spark, d, "events"))
    a = a.select("ts", "event_id", "provider", "chunk_id", "attempt", "status")
    out = dedup_stream(a, ["provider", "chunk_id", "attempt"], order=["event_id"])
    return run_available(out.select("event_id", "provider", "chunk_id", "attempt", "status"), "s4")


def s5_incremental_review(spark: SparkSession, d: str) -> DataFrame:
    base = new_run_dir(spark, "s5")
    incremental_review(chunks_from_documents(stream_table(spark, d, "documents")), f"{base}/tables", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/tables/unique").select(
        "project", "dedup_key", "signature", "chunk_id", "pos", "severity", "file", "line_raw", "title")


STREAM_QUERIES = {
    "s1_rate_per_minute": s1_rate_per_minute,
    "s2_sliding_rate": s2_sliding_rate,
    "s3_review_bursts": s3_review_bursts,
    "s4_dedup_stream": s4_dedup_stream,
    "s5_incremental_review": s5_incremental_review,
}
