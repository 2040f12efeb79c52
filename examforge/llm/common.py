"""Shared helpers of the text operators: Arrow batches as code-point arrays, lookup tables, field explosion."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examforge.session import checkpointed

N_CODEPOINTS = 0x110000
#: Batches are cut into runs of at most this many characters, so that temporary arrays stay small.
CHUNK_CHARS = 2_000_000

#: Letters that look like Latin ones (fixed values).
LOOKALIKES = dict(zip(
    "АВСЕНІЈКМОРЅТХУасԁеһіјорѕԛԝхуѵ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχ",
    "ABCEHIJKMOPSTXYacdehijopsqwxyv" + "ABEZHIKMNOPTYXaikvoptux",
))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, elementwise on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the n + 1 offsets of the texts in it."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, starts


def chunks(texts: list[str], limit: int = CHUNK_CHARS):
    """(first, last) index ranges of about `limit` characters; a longer text is a range of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


@lru_cache(maxsize=1)
def digit_table() -> np.ndarray:
    """True for decimal digits (category Nd)."""
    t = np.zeros(N_CODEPOINTS, bool)
    for cp in range(N_CODEPOINTS):
        if unicodedata.category(chr(cp)) == "Nd":
            t[cp] = True
    return t


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer partitions than there are cores (a small one) is spread over them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def question_fields(questions: DataFrame) -> DataFrame:
    """(row_id, field_no, text): field 0 is the question, 1, 2, ... are the options in stored order; null texts are left out."""
    options = F.coalesce(F.col("options"), F.array().cast("array<string>"))
    return spread(questions.select("row_id", "question", "options")).select(
        F.col("row_id").cast("bigint").alias("row_id"),
        F.posexplode(F.concat(F.array(F.col("question")), options)).alias("field_no", "text"),
    ).where(F.col("text").isNotNull()).select("row_id", F.col("field_no").cast("bigint").alias("field_no"), "text")


def sampled_texts(fields: DataFrame, most: int, total: int | None = None) -> list[str]:
    """Texts of at most `most` fields, those whose (row_id, field_no) hash lowest.

    A filter on the hash leaves about 1.2 times as many before anything is ordered, so what reaches the driver doesn't
    grow with the table.
    """
    fields = fields.where(F.length("text") > 0)
    total = fields.count() if total is None else total
    place = F.pmod(F.xxhash64("row_id", "field_no"), F.lit(10**9))
    if total > 2 * most:
        fields = fields.where(place < int(1.2 * 10**9 * most / total) + 1)
    return [r[0] for r in fields.orderBy(place, "row_id", "field_no", "text").limit(most).select("text").toLocalIterator()]


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def record_batches(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def hashed_counts(df: DataFrame, buckets: int, of_texts, least: int = 2) -> np.ndarray:
    """Counts over all rows of df's only column of the hashes that of_texts gives for a batch of texts.

    Every partition sums up in an array of fixed size and sends its non-zero places once; the driver gets at most
    `buckets` rows, whatever the input. Sums below `least` are left at 0.
    """

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            for first, last in chunks(texts):
                total += np.bincount(of_texts(texts[first:last]), minlength=buckets)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 200_000].astype(np.int32)), pa.array(total[at[i : i + 200_000]])], names=["bucket", "n"])

    sums = df.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = np.zeros(buckets, np.int64)
    table = sums.toArrow()
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def hot_join(rows: DataFrame, sides: DataFrame, key: str, by: str, counted: DataFrame | None = None, hot: int = 20_000) -> DataFrame:
    """rows joined with sides (one row a key), with hot keys spread.

    A key of more than `hot` rows, and of more than a 10,000th of the rows of such keys, is hot: there are at most
    10,000 of them, so they can be broadcast. Its row in sides is repeated once for every `hot` rows, and its rows meet
    those repeats by the hash of the column `by`. counted: a frame already written that has the same keys as rows.
    """
    n = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    n = checkpointed(n)
    total = n.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if not total:
        return rows.join(sides, key)
    n = F.broadcast(n.where(F.col("_n") > total // 10_000).select(key, F.ceil(F.col("_n") / hot).cast("int").alias("_k")))
    salts = F.coalesce("_k", F.lit(1))
    rows = rows.join(n, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_k")
    sides = sides.join(n, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_k")
    return rows.join(sides, [key, "_salt"]).drop("_salt")
