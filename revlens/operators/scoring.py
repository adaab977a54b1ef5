"""The plug-in points for a model call and a token encoder.

``score_chunks`` sends prompt batches to a caller-supplied function inside
Arrow batches (``mapInPandas``); a failing batch becomes error rows, never a
failed job.  ``split_by_tokens`` hard-splits texts with a supplied encoder.
Neither ships a model client or tokenizer of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("signature", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("raw", T.StringType()),
    T.StructField("usage", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("error", T.StringType()),
])

ScoreFn = Callable[[Sequence[str]], Sequence[tuple[str, dict]]]


def score_chunks(prompts: DataFrame, fn: ScoreFn, attempt: int = 1, num_partitions: int | None = None) -> DataFrame:
    """(project, chunk_id, signature, prompt) -> replies.  ``fn`` maps a
    list of prompts to a list of (raw, usage).  Rows are spread by signature
    so one project's chunks score in parallel.  Apply the pending filter
    (``attempts.pending_chunks``) before this: Catalyst cannot push joins
    through a Python batch function."""
    n = num_partitions or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = prompts.select("project", "chunk_id", "signature", "prompt").repartition(n, "signature")

    def run(batches):
        for pdf in batches:
            raws, usages, errors = [], [], []
            try:
                out = list(fn(list(pdf["prompt"])))
                if len(out) != len(pdf):
                    raise RuntimeError(f"scoring function returned {len(out)} results for {len(pdf)} prompts")
                for raw, usage in out:
                    raws.append(raw)
                    usages.append({str(k): float(v) for k, v in (usage or {}).items()
                                   if isinstance(v, (int, float))})
                    errors.append(None)
            except Exception as exc:  # noqa: BLE001 - a failure is data
                raws = [None] * len(pdf)
                usages = [None] * len(pdf)
                errors = [f"{type(exc).__name__}: {exc}"] * len(pdf)
            yield pd.DataFrame({"project": pdf["project"], "chunk_id": pdf["chunk_id"],
                                "signature": pdf["signature"], "attempt": attempt, "raw": raws,
                                "usage": usages, "error": errors})

    return src.mapInPandas(run, SCORE_SCHEMA)


def split_by_tokens(df: DataFrame, encoder, budget: int, text: str = "text") -> DataFrame:
    """Hard split with a token encoder (``encode(str) -> list[int]``,
    ``decode(list[int]) -> str``): pieces of at most ``budget`` tokens.  An
    Arrow batch function returns ARRAY<STRUCT<part_text, part_tokens>>,
    exploded with its position; empty text gives no piece."""
    out_t = "array<struct<part_text:string,part_tokens:bigint>>"

    @F.pandas_udf(out_t)
    def pieces(s: pd.Series) -> pd.Series:
        res = []
        for t in s:
            if not t:
                res.append([])
                continue
            ids = encoder.encode(t)
            res.append([{"part_text": encoder.decode(ids[i:i + budget]), "part_tokens": len(ids[i:i + budget])}
                        for i in range(0, len(ids), budget)])
        return pd.Series(res)

    ex = df.withColumn("_pieces", pieces(F.col(text)))
    return (ex.select("*", F.posexplode("_pieces").alias("_i", "_p"), F.size("_pieces").alias("part_count"))
            .select(*[c for c in df.columns], (F.col("_i") + 1).cast("int").alias("part_no"),
                    F.col("part_count").cast("int").alias("part_count"),
                    F.col("_p.part_text").alias("part_text"), F.col("_p.part_tokens").alias("part_tokens")))


class WhitespaceEncoder:
    """A tiny encoder: tokens are runs of non-blank characters with their
    leading ASCII blanks (trailing blanks form a last token), so
    decode(encode(t)) == t."""

    def encode(self, text: str) -> list[str]:
        import re
        return re.findall(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+\Z", text)

    def decode(self, ids) -> str:
        return "".join(ids)
