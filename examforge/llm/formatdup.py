"""Duplicates hidden by formatting differences (problem 3).

Two records are copies when their questions and the multisets of their options agree in *reduced form*: lower case,
without white space and punctuation (Unicode P*), except that a full stop between two digits stays.

Every text streams once through a skip-and-fold table over its code points into two rolling polynomial hashes; the
reduced string itself is never built. An option list is the sum of its options' mixed hashes, so its order doesn't
matter. Rows whose 128-bit keys meet are then compared with two pointers that skip and fold as they go.

Defined cases: rows with a null or empty question or null options take no part. A null option counts as an empty one.
Texts that reduce to nothing are equal to each other. Rows that repeat with the same row_id are copies of themselves
and give no pair. Other columns of the table are neither read nor returned.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examforge.llm.common import N_CODEPOINTS, chunks, codepoints, digit_table, mix64
from examforge.session import checkpointed, small

_B1, _B2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_DOT = 0x2E
#: Lower-case forms that depend on the context or have two characters; texts with them are lowered first.
_IRREGULAR = ("İ", "Σ")


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> lower-case code point, 0 where white space or punctuation is skipped."""
    t = np.arange(N_CODEPOINTS, dtype=np.uint32)
    for cp in range(N_CODEPOINTS):
        c = chr(cp)
        if c.isspace() or unicodedata.category(c)[0] == "P":
            t[cp] = 0
        elif c != (low := c.lower()) and len(low) == 1:
            t[cp] = ord(low)
    return t


def _lowered(text: str) -> str:
    return text.lower() if any(c in text for c in _IRREGULAR) else text


def kept(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Folded code points, 0 where skipped; a full stop between two digits of one text stays."""
    folded = fold_table()[cps]
    dots = np.flatnonzero(cps == _DOT)
    if len(dots):
        digit = digit_table()
        inner = dots[(dots > 0) & (dots < len(cps) - 1)]
        text = np.searchsorted(starts, inner, "right")
        inner = inner[(starts[text - 1] < inner) & (inner < starts[text] - 1)]
        folded[inner[digit[cps[inner - 1]] & digit[cps[inner + 1]]]] = _DOT
    return folded


def rolling_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit polynomial hashes of each text's reduced form."""
    out1, out2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    for a, b in chunks(texts):
        cps, starts = codepoints([_lowered(t) for t in texts[a:b]])
        folded = kept(cps, starts)
        keep = folded != 0
        before = np.concatenate(([0], np.cumsum(keep)))  # kept characters up to each place
        ends = before[starts]
        symbols = mix64(folded[keep].astype(np.uint64))
        index = np.arange(len(symbols)) - np.repeat(ends[:-1], np.diff(ends))
        longest = int(np.diff(ends).max(initial=0))
        for base, out in ((_B1, out1), (_B2, out2)):
            powers = np.cumprod(np.full(max(longest, 1), base, np.uint64))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * powers[index], dtype=np.uint64)))
            out[a:b] = mix64((total[ends[1:]] - total[ends[:-1]]) ^ mix64(np.diff(ends).astype(np.uint64)))
    return out1, out2


def _keys(batches):
    """(row_id, k1, k2): the row's hashes, without its texts."""
    for batch in batches:
        questions = batch.column(1).to_pylist()
        options = batch.column(2).to_pylist()
        flat = [o or "" for os in options for o in os]
        n = np.fromiter(map(len, options), np.int64, len(options))
        ends = np.concatenate(([0], np.cumsum(n)))
        keys = []
        for q, o in zip(rolling_hashes(questions), rolling_hashes(flat)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(o), dtype=np.uint64)))
            keys.append(mix64(mix64(q) + np.uint64(3) * (total[ends[1:]] - total[ends[:-1]]) + mix64(n.astype(np.uint64))).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[0]), pa.array(keys[1])], names=["row_id", "k1", "k2"])


def same_reduced(a: str, b: str) -> bool:
    """Compares two texts with two pointers that skip what doesn't count."""
    if a == b:
        return True
    table, a, b = _small_fold(), _lowered(a), _lowered(b)
    i = j = 0
    while True:
        while i < len(a) and not (x := _step(table, a, i)):
            i += 1
        while j < len(b) and not (y := _step(table, b, j)):
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if x != y:
            return False
        i, j = i + 1, j + 1


@lru_cache(maxsize=1)
def _small_fold() -> dict[str, int]:
    return _Fold()


class _Fold(dict):
    def __missing__(self, c: str) -> int:
        self[c] = v = int(fold_table()[ord(c)])
        return v


def _step(table: dict[str, int], s: str, i: int) -> int:
    c = s[i]
    if c == "." and 0 < i < len(s) - 1 and unicodedata.category(s[i - 1]) == unicodedata.category(s[i + 1]) == "Nd":
        return _DOT
    return table[c]


def same_record(question_a: str, options_a: list, question_b: str, options_b: list) -> bool:
    """Equal reduced questions, and equal multisets of reduced options (paired off by hash, then compared)."""
    if len(options_a) != len(options_b) or not same_reduced(question_a, question_b):
        return False
    a, b = [o or "" for o in options_a], [o or "" for o in options_b]
    if a == b:
        return True
    order = [np.lexsort(rolling_hashes(x)) for x in (a, b)]
    return all(same_reduced(a[i], b[j]) for i, j in zip(*order))


def reduced(text: str) -> str:
    """The reduced form written out; for shingles and for rows whose keys met by accident."""
    cps, starts = codepoints([_lowered(text)])
    folded = kept(cps, starts)
    return folded[folded != 0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def reduced_record(question: str, options: list) -> str:
    return "\0".join([reduced(question), *sorted(reduced(o or "") for o in options)])


def _verified(batches):
    """Adds `other`: null where the row equals the first row of its key, else its reduced record written out."""
    schema = pa.schema([("row_id", pa.int64()), ("first_id", pa.int64()), ("other", pa.string())])
    for batch in batches:
        r = batch.to_pydict()
        other = [
            None if same_record(q, o, first_q, first_o) else reduced_record(q, o)
            for q, o, first_q, first_o in zip(r["question"], r["options"], r["first_question"], r["first_options"])
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(other, pa.string())], schema=schema)


def domain(questions: DataFrame) -> DataFrame:
    """The rows that take part, one for each row_id."""
    return questions.select(F.col("row_id").cast("bigint").alias("row_id"), "question", "options").where(
        F.col("row_id").isNotNull() & (F.coalesce(F.length("question"), F.lit(0)) > 0) & F.col("options").isNotNull()
    )


#: A key of more rows than this, and of more than a 10,000th of all copies, counts as hot: there are at most 10,000.
HOT = 100_000
#: Rows that meet one copy of their set's first text.
SHARE = 50_000
#: Most ids (16 bytes each) of a side that is broadcast; beyond it the side is shuffled.
MOST_IDS = 1_000_000


def keyed(questions: DataFrame) -> DataFrame:
    """(row_id, k1, k2): the 128-bit key of each row's reduced record."""
    return domain(questions).mapInArrow(_keys, "row_id bigint, k1 bigint, k2 bigint")


def _meetings(keys: DataFrame) -> DataFrame:
    """(row_id, first_id, n): rows that share a key with a smaller row_id, and the number of rows of that key.

    Only keys are shuffled, and the smallest row_id and the count of a key are combined map-side. Hot keys, at most
    10,000 since their counts add up to the number of copies at most, meet their rows by broadcast.
    """
    sets = keys.groupBy("k1", "k2").agg(F.min("row_id").alias("first_id"), F.max("row_id").alias("last"), F.count("*").alias("n"))
    sets = checkpointed(sets.where(F.col("last") > F.col("first_id")).drop("last"))
    copies = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = max(HOT, copies // 10_000)
    busy = F.broadcast(sets.where(F.col("n") > hot))
    met = keys.join(busy, ["k1", "k2"])
    met = met.unionByName(keys.join(busy, ["k1", "k2"], "left_anti").join(small(sets.where(F.col("n") <= hot), MOST_IDS), ["k1", "k2"]))
    return met.where(F.col("row_id") > F.col("first_id")).select("row_id", "first_id", "n")


def copy_pairs(questions: DataFrame) -> DataFrame:
    """(first_id, row_id): every copy with the smallest row_id of its set.

    Texts are fetched only for rows whose keys met, by their ids. The first text of a set is repeated once for every
    SHARE rows of the set, so that a set of a third of all rows is spread over as many tasks. Rows that share a key by
    accident (none is expected) are grouped by their written-out reduced form, so the result is exact.
    """
    met = checkpointed(_meetings(checkpointed(keyed(questions))).distinct())
    met = met.withColumn("salts", F.ceil(F.col("n") / SHARE).cast("int"))
    texts = domain(questions)
    firsts = met.select(F.col("first_id").alias("row_id"), "salts").distinct()
    firsts = texts.join(small(firsts, MOST_IDS), "row_id").select(
        F.col("row_id").alias("first_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("question").alias("first_question"), F.col("options").alias("first_options")
    )
    rows = texts.join(small(met.select("row_id", "first_id", "salts"), MOST_IDS), "row_id").withColumn("salt", F.pmod(F.xxhash64("row_id"), "salts").cast("int"))
    both = rows.join(firsts, ["first_id", "salt"]).select("row_id", "question", "options", "first_id", "first_question", "first_options")
    checked = checkpointed(both.mapInArrow(_verified, "row_id bigint, first_id bigint, other string").distinct())
    rest = checked.where(F.col("other").isNotNull())
    rest_firsts = rest.groupBy("first_id", "other").agg(F.min("row_id").alias("f"))
    rest = rest.join(rest_firsts, ["first_id", "other"]).where(F.col("row_id") > F.col("f")).select(F.col("f").alias("first_id"), "row_id")
    return checked.where(F.col("other").isNull()).select("first_id", "row_id").unionByName(rest)


def collapsed(questions: DataFrame) -> DataFrame:
    """One record for each question of the domain, its smallest row_id, with n_copies."""
    pairs = checkpointed(copy_pairs(questions))
    counts = pairs.groupBy(F.col("first_id").alias("row_id")).agg((F.count("*") + 1).alias("n"))
    kept_rows = domain(questions).dropDuplicates(["row_id"]).join(pairs.select("row_id"), "row_id", "left_anti")
    return kept_rows.join(counts, "row_id", "left").select("row_id", "question", "options", F.coalesce("n", F.lit(1)).cast("bigint").alias("n_copies"))
