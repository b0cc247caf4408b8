"""Exact histogram of encoded lengths, and what its suffix sums answer for any context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ._memory import lean_batches

#: Fixed value: the usual pre-split pattern of byte-level BPE rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_built: dict[int, object] = {}


def _encoder(ranks: bytes):
    key = hash(ranks)
    if key not in _built:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _built[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _built[key]


def encoded_lengths(docs: DataFrame, ranks_path: str, *, text_col: str = "text") -> DataFrame:
    """(n_tokens) for each row: the whole text's length under the byte-level BPE of a rank file.

    The file (about 1 MB) is read once by the driver and shipped.  Null texts have no tokens."""
    with open(ranks_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            sizes = [len(encoder.encode_ordinary(t.as_py())) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(lean_batches(run), "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per encoded length that occurs, with suffix sums:

    n_tokens, n_docs, docs_up_to (documents this long or shorter), docs_from (this long or
    longer), tokens_from (their tokens), share_up_to, truncated_total (all tokens if every
    document is cut to n_tokens).  The window runs over the histogram, which has a row per
    distinct length and doesn't grow with the number of documents.  Empty input: no rows."""
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    rising = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = Window.orderBy("n_tokens").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    tokens = F.col("n_docs") * F.col("n_tokens")
    every = counts.select(
        "n_tokens", "n_docs", F.sum("n_docs").over(rising).alias("docs_up_to"), F.sum("n_docs").over(falling).alias("docs_from"),
        F.sum(tokens).over(falling).alias("tokens_from"), F.sum(tokens).over(rising).alias("_up"),
    )
    share = F.col("docs_up_to") / (F.col("docs_up_to") + F.col("docs_from") - F.col("n_docs"))
    cut = F.col("_up") + (F.col("docs_from") - F.col("n_docs")) * F.col("n_tokens")
    return every.select("n_tokens", "n_docs", "docs_up_to", "docs_from", "tokens_from", share.alias("share_up_to"), cut.alias("truncated_total"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total_tokens, docs_cut) for any limits, from the histogram alone."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    cut = F.least("n_tokens", "context_limit") * F.col("n_docs")
    met = F.broadcast(asked).join(histogram, F.lit(True), "left")
    return met.groupBy("context_limit").agg(
        F.coalesce(F.sum(cut), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs"))), F.lit(0)).alias("docs_cut")
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents doesn't exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return F.broadcast(asked).join(histogram, F.col("share_up_to") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
