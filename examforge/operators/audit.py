"""Amendment audit: versions, repeated stems, newer-than joins with vector top-k, rule signals, routing, sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examforge.functions.text import stem

DEFAULT_YEAR = 110


def bank_year(name: Column) -> Column:
    """First run of digits, else 110."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(DEFAULT_YEAR))


def repeated_stems(rows: DataFrame, key: str, text: str, group: str, least: int = 10, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, names): rows whose normalized stem (least characters, not in the stop list) occurs in several groups, with
    the sorted group names. Stems are aggregated first, so a hot stem is met as one row."""
    s = rows.select(key, group, stem(F.col(text)).alias("stem")).where((F.length("stem") >= least) & ~F.col("stem").isin(*stop, ""))
    named = s.groupBy("stem").agg(F.array_sort(F.collect_set(group)).alias("names")).where(F.size("names") > 1)
    return s.join(named, "stem").select(key, "names")


#: Reasons that say nothing (fixed values).
BOILERPLATE = ("修正通過。", "照協商條文通過。", "照協商條文通過。,")


def consolidated(versions: DataFrame, keys: list[str], at: str, text: str, reason: str, boilerplate: tuple[str, ...] = BOILERPLATE, order: str | None = None) -> DataFrame:
    """By keys: latest and earliest date, latest text, n_versions, dates in order, and the reasons: those that say
    something, each as `[date修正] reason`, else the latest one, a line each. Blank reasons count as none. Dates are
    compared as text, ties by `order`."""
    tie = order or at
    said = F.trim(F.coalesce(reason, F.lit("")))
    v = versions.groupBy(*keys).agg(
        F.max(at).alias("latest"), F.min(at).alias("earliest"), F.max_by(text, F.struct(at, tie)).alias("latest_text"), F.count("*").alias("n_versions"),
        F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(tie).alias("no"), said.alias("said")))).alias("_v"), F.max_by(reason, F.struct(at, tie)).alias("_last"),
    )
    kept = F.filter("_v", lambda x: (x["said"] != "") & ~x["said"].isin(*boilerplate))
    lines = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("["), x["at"].cast("string"), F.lit("修正] "), x["said"])), "\n")
    dates = F.transform("_v", lambda x: x["at"])
    reasons = F.when(F.size(kept) > 0, lines).when(F.trim("_last") != "", F.trim("_last")).otherwise(F.col("_last"))
    return v.withColumn("dates", dates).withColumn("reasons", reasons).drop("_v", "_last")


def newer_top_k(queries: DataFrame, items: DataFrame, k: int = 20, block: int = 4096, parts: int | None = None) -> DataFrame:
    """(query_id, item_id, place, similarity): of the items newer than a query (year strictly larger) the k most
    similar by dot product, ties by id.

    queries: query_id, year, vector, the stated query set; items: item_id, year, vector (unit length), any number. Queries
    are put into blocks of about `block` by hash and items into `parts`; every block meets every part in a task of its
    own, which holds one block and keeps each query's best k, and a window over those gives the answer. Nothing goes
    through the driver. Null vectors take no part.
    """
    spark = queries.sparkSession
    vector = F.col("vector").cast("array<float>").alias("vector")
    q = queries.where(F.col("vector").isNotNull() & F.col("year").isNotNull()).select(F.col("query_id").cast("bigint").alias("id"), F.col("year").cast("int").alias("year"), vector)
    i = items.where(F.col("vector").isNotNull() & F.col("year").isNotNull()).select(F.col("item_id").cast("bigint").alias("id"), F.col("year").cast("int").alias("year"), vector)
    blocks = max(1, -(-q.count() // block))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = q.select(mine(blocks).alias("b"), every(parts).alias("p"), F.lit(0).alias("kind"), "*").unionByName(i.select(every(blocks).alias("b"), mine(parts).alias("p"), F.lit(1).alias("kind"), "*"))

    def best(batches):
        at, query, year, matrix, score, item = None, [], [], [], None, None

        def done():
            if score is None:
                return
            row, col = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(query, np.int64)[row]), pa.array(item[row, col]), pa.array(score[row, col])], names=["query_id", "item_id", "similarity"])

        for batch in batches:
            b, p, kind, ids, years = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            new = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (p[1:] != p[:-1]) | (kind[1:] != kind[:-1]))) if len(b) else np.zeros(0, int)
            for first, last in zip(new, np.append(new[1:], len(b))):
                if (b[first], p[first]) != at:
                    yield from done()
                    at, query, year, matrix, score, item = (b[first], p[first]), [], [], [], None, None
                flat = batch.column(5).slice(first, last - first)
                flat = flat.flatten().to_numpy(zero_copy_only=False).reshape(last - first, -1).astype(np.float64)
                if kind[first] == 0:  # sorted before the items
                    query, year, matrix = [*query, *ids[first:last]], [*year, *years[first:last]], [*matrix, flat]
                    continue
                if not query:
                    continue
                if score is None:
                    whole, asked = np.concatenate(matrix), np.array(year)
                    score, item = np.full((len(query), 0), -np.inf), np.zeros((len(query), 0), np.int64)
                for c in range(0, len(flat), 1024):
                    s = (whole @ flat[c : c + 1024].T).round(9)
                    s[asked[:, None] >= years[first:last][None, c : c + 1024]] = -np.inf
                    score = np.concatenate([score, s], axis=1)
                    item = np.concatenate([item, np.broadcast_to(ids[first:last][c : c + 1024], s.shape)], axis=1)
                    order = np.lexsort((item, -score), axis=1)[:, :k]
                    score, item = np.take_along_axis(score, order, 1), np.take_along_axis(item, order, 1)
        yield from done()

    met = rows.repartition("b", "p").sortWithinPartitions("b", "p", "kind")
    found = met.mapInArrow(best, "query_id bigint, item_id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "item_id", "place", "similarity")


#: Old terms and what amendments call them; amounts that changed, with their article and a word of the law's name; the
#: form in which a question names an article of the two laws (fixed values).
RENAMED = {"電動自行車": "微型電動二輪車", "地方法院行政訴訟庭": "高等行政法院地方行政訴訟庭", "地方法院簡易庭": "高等行政法院地方行政訴訟庭"}
AMOUNTS = (
    ("3,600元", "45", "處罰"), ("1,000元", "31-1", "處罰"), ("1,200元", "56-1", "處罰"), ("3,600元", "56-1", "處罰"), ("180公分", "41", "安全"),
    ("50公斤", "39-2", "安全"), ("60公里", "43", "處罰"),
)
MENTION = r"(?:道路交通管理處罰條例|處罰條例|道路交通安全規則|安全規則)?\s*第\s*(\d+(?:[\-之]\d+)?)\s*條"


def rule_signals(questions: DataFrame, amendments: DataFrame) -> DataFrame:
    """(query_id, item_id, signals): amendments newer than a question that one of its words points to.

    questions: query_id, year, text; amendments: item_id, year, law, article_no, text. Signals are article_mention (the
    question names the amendment's article), deprecated_term=… (the question has an old term, the amendment its new one)
    and penalty=…→art… (an amount of the question changed with that article of a law of that name), in this order.
    What a question points to is written out as keys (article; old term; amount with article) and met by equality, so
    questions and amendments are never multiplied.
    """
    text = F.col("text")
    named = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MENTION), 1), lambda a: F.replace(a, F.lit("之"), F.lit("-"))))
    keys = [F.transform(named, lambda a: F.struct(F.lit(0).alias("rank"), a.alias("key"), F.lit("article_mention").alias("signal")))]
    old = [F.when(F.contains(text, F.lit(o)), F.struct(F.lit(1 + i).alias("rank"), F.lit(f"term {o}").alias("key"), F.lit(f"deprecated_term={o}").alias("signal"))) for i, o in enumerate(RENAMED)]
    due = [F.when(F.contains(text, F.lit(a)), F.struct(F.lit(10 + i).alias("rank"), F.lit(f"amount {i}").alias("key"), F.lit(f"penalty={a}→art{art}").alias("signal"))) for i, (a, art, _) in enumerate(AMOUNTS)]
    asked = questions.select("query_id", F.col("year").alias("_asked"), F.explode(F.concat(*keys, F.array_compact(F.array(*old, *due)))).alias("k")).select("query_id", "_asked", "k.*")
    has = [F.when(F.contains(text, F.lit(new)), F.lit(f"term {o}")) for o, new in RENAMED.items()]
    law = [F.when((F.col("article_no") == art) & F.contains("law", F.lit(word)), F.lit(f"amount {i}")) for i, (_, art, word) in enumerate(AMOUNTS)]
    offered = amendments.select("item_id", "year", F.explode(F.array_compact(F.array(F.col("article_no"), *has, *law))).alias("key"))
    met = asked.join(offered, "key").where(F.col("year") > F.col("_asked"))
    by = met.groupBy("query_id", "item_id").agg(F.array_sort(F.collect_set(F.struct("rank", "signal"))).alias("s"))
    return by.select("query_id", "item_id", F.transform("s", lambda x: x["signal"]).alias("signals"))


def candidates(similar: DataFrame, signalled: DataFrame) -> DataFrame:
    """(query_id, item_id, similarity, signals): the union of the most similar pairs and of those with a strong signal;
    similar pairs also get the signal embed=…, with three digits."""
    both = similar.select("query_id", "item_id", "similarity").join(signalled, ["query_id", "item_id"], "full")
    signals = F.coalesce("signals", F.array().cast("array<string>"))
    shown = F.concat(F.lit("embed="), F.format_string("%.3f", "similarity"))
    return both.select("query_id", "item_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.when(F.col("similarity").isNotNull(), F.array_append(signals, shown)).otherwise(signals).alias("signals"))


def matches(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, matches): of pairs (query_id, item_id, score, strong, signals) those whose score reaches `least` or that
    have a strong signal, as structs, the highest score first, ties by item_id."""
    kept = rows.where((F.col("score") >= least) | F.col("strong"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "item_id", "score", "signals")))
    return kept.groupBy("query_id").agg(order.alias("m")).select("query_id", F.transform("m", lambda x: F.struct(x["item_id"].alias("item_id"), x["score"].alias("score"), x["signals"].alias("signals"))).alias("matches"))


def place(key: str, seed: str) -> Column:
    """In 0 to 2^32 - 1, from the first 32 bits of md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")


def sample(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """About that share of the rows, those whose keys hash below a threshold: a filter, so it moves nothing at any size."""
    return rows.where(place(key, seed) < int(2**32 * share))


def exact_sample(rows: DataFrame, key: str, share: float, seed: str, most: int = 1_000_000) -> DataFrame:
    """Exactly max(1, floor(share * n)) rows in hash order. They are brought into one order, so it is for results of up to
    `most` rows; an error beyond, where sample() does."""
    n = rows.count()
    wanted = max(1, int(share * n)) if n else 0
    if wanted > most:
        raise ValueError(f"{wanted} rows; use sample()")
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(wanted)


def routed(rows: DataFrame) -> DataFrame:
    """Two-pass consensus: affected if either pass says so, the larger confidence, whether they disagree, and the batch.

    rows: p1, p2 (boolean; p2 null where the second pass wasn't needed), c1, c2 (confidences), similarity, strong."""
    second = ~F.col("p1") & (F.col("strong") | (F.col("similarity") > 0.5) | (F.col("c1") >= 30))
    p2 = F.when(second, F.coalesce("p2", F.lit(False)))
    affected = F.col("p1") | F.coalesce(p2, F.lit(False))
    confidence = F.when(second, F.greatest("c1", F.coalesce("c2", F.lit(0)))).otherwise(F.col("c1"))
    out = rows.withColumn("route", F.when(F.col("p1"), "final").when(second, "second").otherwise("done"))
    out = out.withColumn("affected", affected).withColumn("confidence", confidence).withColumn("disagreed", F.coalesce(p2 != F.col("p1"), F.lit(False)))
    return out.withColumn("batch", F.when(F.col("affected") | (F.col("confidence") >= 20), "A").otherwise("B"))


def strong_first(signals: Column, prefix: str, most: int = 8) -> Column:
    """Signals with the prefix first, the order otherwise kept, at most `most`."""
    return F.slice(F.concat(F.filter(signals, lambda s: s.startswith(prefix)), F.filter(signals, lambda s: ~s.startswith(prefix))), 1, most)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
