"""Mixing sources to target weights (problem 7).

Every source is to contribute its target share of T, the tokens of all documents. A source with S tokens and a wanted
W = share * T is used W // S times in full, and the rest W mod S comes from the documents whose hash lies below a
threshold; both are bounded by max_repeats. A document is thus used k or k + 1 times.

The threshold is found without sorting: tokens are summed by source and hash bucket (10 bits), the bucket in which the
running sum passes the budget is the boundary bucket, and only its documents are summed again by the next 10 bits, and
so on for LEVELS levels. Selecting is then a filter on the hash. Each level's histogram is a map-side combined sum with
at most 1,024 rows a source, so a source that holds a third of all rows moves no more than a small one.

Defined cases: documents without text count 0 tokens; documents whose source is null or has no target add to T only; a
target without documents gets nothing and is short; null shares or repeats count as 0. A repeated doc_id is a document
of its own with the same hash. Empty tables give an empty mixture.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examforge.llm.tokens import count_tokens
from examforge.session import checkpointed, small

BITS, LEVELS = 10, 4


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens)."""

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count_tokens(b.column(2).to_pylist(), tokenizer), pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, wanted, passes, rest, short) of each target."""
    by_source = checkpointed(sized.groupBy("source").agg(F.sum("n_tokens").alias("available")))  # a row a source
    total = by_source.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    t = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("bigint").alias("max_repeats"))
    # total is one row; it meets every target as a constant column, so no join without a key is needed
    t = t.join(by_source, "source", "left").withColumn("total", F.lit(total.first()[0])).withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    wanted = F.col("target_share") * F.col("total")
    t = t.withColumn("wanted", wanted).withColumn("short", F.col("available") * F.col("max_repeats") < F.col("wanted"))
    used = F.when(F.col("short"), (F.col("available") * F.col("max_repeats")).cast("double")).otherwise(F.col("wanted"))
    t = t.withColumn("passes", F.when(F.col("available") > 0, F.floor(used / F.col("available"))).otherwise(F.lit(0)).cast("bigint"))
    return t.withColumn("rest", F.greatest(used - F.col("passes") * F.col("available"), F.lit(0.0))).drop("total")


def thresholds(hashed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with place < threshold hold `rest` tokens, but for the last boundary bucket."""
    # a prefix is the hash's leading bits found so far; taken: tokens below the prefix's bucket
    state = budgets.select("source", "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("taken"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = hashed.join(small(state), "source").where(F.shiftright("place", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        w = Window.partitionBy("source").orderBy("bucket")  # at most 2 ** BITS rows
        sums = sums.withColumn("upto", F.sum("n").over(w)).withColumnRenamed("source", "s")
        met = state.join(sums, F.col("s") == F.col("source"), "left").withColumn("upto", F.col("taken") + F.col("upto"))
        below = F.col("upto") <= F.col("rest")
        met = met.groupBy("source", "rest", "prefix").agg(
            F.max("taken").alias("base"), F.max(F.when(below, F.col("upto"))).alias("below"),
            F.min(F.when(~below, F.col("bucket"))).alias("boundary"),
        )
        # no boundary on level 1: the whole source fits, and the threshold lies beyond the last bucket
        end = F.shiftleft("prefix", BITS) if level > 1 else F.lit(2**BITS).cast("bigint")
        state = met.select("source", "rest", F.coalesce("boundary", end).cast("bigint").alias("prefix"), F.coalesce("below", "base").cast("bigint").alias("taken"))
        state = checkpointed(state)  # a row a source; keeps the plans of the levels apart
    return state.select("source", F.col("prefix").alias("threshold"))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: doc_id, source, n_tokens, copies of every document used; report: what each target reached."""
    sized = checkpointed(token_counts(documents, tokenizer).withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS * LEVELS)))
    budgets = checkpointed(plan(sized, targets))
    limits = budgets.join(thresholds(sized, budgets), "source", "left").select("source", "passes", "max_repeats", "threshold")
    copies = F.least(F.col("passes") + (F.col("place") < F.coalesce("threshold", F.lit(0))).cast("bigint"), F.col("max_repeats"))
    mixture = sized.join(small(limits), "source").withColumn("copies", copies).where(F.col("copies") > 0)
    mixture = mixture.select("doc_id", "source", "n_tokens", "copies")
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"), F.max("copies").alias("most_repeats"))
    report = budgets.join(reached, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = Window.partitionBy()  # a row a source
    report = report.select(
        "source", "target_share", "available", "wanted", "tokens", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (F.col("tokens") / F.nullif(F.sum("tokens").over(whole), F.lit(0))).alias("actual_share"), "short",
    )
    return mixture, report
