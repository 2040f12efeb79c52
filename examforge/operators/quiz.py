"""Quiz assembly: filters, patches, blocks of questions that stay together, seeded sampling, option permutation.

Random orders come from md5 of a seed and the row's key, so they are the same on any partitioning and in any engine.
"""

from __future__ import annotations

import bisect
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examforge.functions import grading
from examforge.operators import catalog, history
from examforge.operators.history import or_empty
from examforge.session import checkpointed


#: Modes whose pool comes from the attempt log or the tags, within the banks of `src_banks`; the others take `banks`.
SCOPED = ("wrong", "still-wrong", "stat", "key")
MODES = ("all", "random", "unseen", "retry", *SCOPED)


@dataclass(frozen=True)
class QuizSpec:
    """A request. num 0 means every question of the pool; no banks mean all banks; no user_id means everybody's attempts.

    Modes: `all` (as stored, whole blocks until num is reached or passed), `random` (weighted towards what was tried
    less), `unseen` (never answered), `wrong` and `still-wrong` (wrong once, wrong last time), `stat` (wrong at least
    max(1, min_wrong) times with an accuracy below max_accuracy), `key` (tagged), `retry` (not right in session_id).
    All but `all` take exactly num questions where whole blocks allow it; all but `all` and `random` in uniform order.
    """

    mode: str = "random"
    num: int = 50
    banks: tuple[str, ...] = ()
    src_banks: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    min_wrong: int | float | str | None = None
    max_accuracy: float | str | None = None
    track: str | None = None
    user_id: int | None = None
    session_id: int | None = None
    seed: str = "0"
    excluded_tags: tuple[str, ...] = field(default=("exclude",))

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if not isinstance(self.num, int) or self.num < 0:
            raise ValueError("num must be a count")
        if self.mode == "retry" and self.session_id is None:
            raise ValueError("retry needs a session")


def uniform(seed: str, *key: Column) -> Column:
    """In (0, 1]: from the first 32 bits of md5."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967296.0)


def with_type(questions: DataFrame) -> DataFrame:
    return questions.withColumn("qtype", grading.question_type(F.col("options"), F.col("answer")))


def patched(questions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Left join on (bank, id as text). answer and freescore apply when defined, texts and lists when not empty. Of
    several patches of a question the largest counts (by answer, warning, link, repeats), whatever the partitioning."""
    o = overrides.select("bank", F.col("qid").alias("o_qid"), F.col("answer").alias("o_answer"), F.col("warning").alias("o_warning"), F.col("amendmenturl").alias("o_url"), F.col("repeats").alias("o_repeats"), F.col("freescore").alias("o_free"))
    o = o.groupBy("bank", "o_qid").agg(F.max(F.struct("o_answer", "o_warning", "o_url", "o_repeats", "o_free")).alias("o")).select("bank", "o_qid", "o.*")
    q = questions.withColumn("o_qid", F.col("id").cast("string")).join(o, ["bank", "o_qid"], "left")
    return (
        q.withColumn("answer", F.coalesce("o_answer", "answer")).withColumn("freescore", F.coalesce("o_free", "freescore"))
        .withColumn("warning", or_empty("o_warning")).withColumn("amendmenturl", or_empty("o_url"))
        .withColumn("repeats", F.when(F.size("o_repeats") > 0, F.col("o_repeats"))).drop("o_qid", "o_answer", "o_warning", "o_url", "o_repeats", "o_free")
    )


#: Title of a reading text that several questions share (fixed value).
READING = r"^閱讀資料（第\s*\d+\s*[-－~～]\s*\d+\s*題）$"


def group_key(bank: Column, groupid: Column, materials: Column) -> Column:
    """Bank with the explicit group, else with title and content of the first text titled as a reading text; null if the
    question stands alone."""
    text = F.filter(materials, lambda m: (m["type"] == "text") & F.coalesce(m["title"], F.lit("")).rlike(READING))
    first = F.get(text, F.lit(0))
    passage = F.when(F.size(text) > 0, F.concat_ws("\x1f", first["title"], F.coalesce(first["content"], F.lit(""))))
    key = F.coalesce(F.nullif(groupid, F.lit("")), passage)
    return F.when(key.isNotNull(), F.concat_ws("\x1e", F.coalesce(bank, F.lit("")), key))


def blocks(questions: DataFrame, order: str = "row_id") -> DataFrame:
    """Adds block (the smallest order value of the question's group, its own if it stands alone) and block_size.

    Groups are aggregated first and joined back, so a group that holds a third of all rows is combined map-side and its
    rows can be split by a skew join; questions that stand alone aren't shuffled at all.
    """
    q = questions.withColumn("_key", group_key(F.col("bank"), F.col("groupid"), F.col("materials")))
    sizes = q.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min(order).alias("block"), F.count("*").alias("block_size"))
    alone = q.where(F.col("_key").isNull()).withColumn("block", F.col(order)).withColumn("block_size", F.lit(1).cast("bigint"))
    return alone.drop("_key").unionByName(q.join(sizes, "_key").drop("_key"))


def sampling_key(seed: str, times: Column, *key: Column) -> Column:
    """Exponential key of weighted sampling without replacement: -ln(u) / weight, weight 1 / (1 + times)^2."""
    return -F.log(uniform(seed, *key)) * (F.lit(1.0) + times) * (F.lit(1.0) + times)


def take_blocks(sized: DataFrame, by: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Whole blocks in order until `most` rows are reached; the last block may go over. sized has a row a block.

    A block has a row at least, so the first `most` blocks of a request are enough: a limit by rank, which is applied
    before the shuffle as well, so that a request with a third of all blocks sends few of them to its task."""
    w = Window.partitionBy(*by).orderBy(*order)
    near = sized.where(F.col(size) > 0).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return near.withColumn("taken_before", before).where(F.col("taken_before") < most)


def take_exactly(sizes: list[int], wanted: int) -> list[int]:
    """Numbers of the blocks to take, in order, for exactly `wanted` rows where that can be done.

    A block completes the quiz as soon as some of the blocks kept before it sum to what it leaves open: that is one bit
    of the set of their sums. Which of them give way then is decided by later first. A block that neither completes the
    quiz nor fits into what is open is passed over.
    """
    kept: list[int] = []
    open_, sums = wanted, 1
    for number, size in enumerate(sizes):
        if 0 < size <= wanted and sums >> (wanted - size) & 1:
            away = _giving_way([sizes[k] for k in kept], size - open_)
            return [k for place, k in enumerate(kept) if place not in away] + [number]
        if 0 < size < open_:
            kept.append(number)
            open_ -= size
            sums |= sums << size
    return kept


def _giving_way(sizes: list[int], goal: int) -> set[int]:
    """Places of blocks that sum to goal (which is known to be possible). within[j] has the sums of the j last blocks as
    bits; the first j that holds the goal names a block that is needed, and what it leaves is looked for behind it."""
    within = list(itertools.accumulate(reversed(sizes), lambda bits, n: bits | bits << n, initial=1))
    away: set[int] = set()
    while goal:
        j = bisect.bisect_left(within, True, key=lambda bits: bool(bits >> goal & 1))  # noqa: B023
        away.add(len(sizes) - j)
        goal -= sizes[len(sizes) - j]
        within = within[:j]
    return away


def exact_selection(sized: DataFrame, by: list[str], order: list[str], size: str, wanted: int, ahead: int = 10) -> DataFrame:
    """take_exactly for every request: by columns, block, size. sized has a row a block.

    The first `ahead` * wanted blocks of each request (a limit by rank, applied before the shuffle as well) nearly always
    complete it. Requests that they leave open are read on through all their blocks, in order, with the blocks taken so
    far as the only state, so that the result is exact.
    """
    usable = sized.select(*dict.fromkeys([*by, "block", size, *order])).where(F.col(size).between(1, wanted))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    near = usable.withColumn("_rank", rank).where(F.col("_rank") <= ahead * wanted).drop("_rank")
    first = checkpointed(_taken(near, by, order, size, wanted))
    request = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    n = usable.groupBy(request.alias("_r")).agg(F.count("*").alias("n")).where(F.col("n") > ahead * wanted)
    full = first.groupBy(request.alias("_r")).agg(F.sum(size).alias("n")).where(F.col("n") == wanted)
    rest = n.join(full, "_r", "left_anti").select("_r")
    late = _taken(usable.withColumn("_r", request).join(rest, "_r", "left_semi").drop("_r"), by, order, size, wanted)
    return first.withColumn("_r", request).join(rest, "_r", "left_anti").drop("_r").unionByName(late)


def _taken(usable: DataFrame, by: list[str], order: list[str], size: str, wanted: int) -> DataFrame:
    import pyarrow as pa

    keys = [*by, "block", size]
    kinds = dict(usable.dtypes)

    def fold(batches):
        request, taken = None, []  # taken: (size, block) of the request being read

        def done():
            return pa.RecordBatch.from_pylist([dict(zip(keys, (*request, block, n))) for n, block in taken], schema=schema)

        for b in batches:
            schema = pa.schema([b.schema.field(k) for k in keys])
            rows = b.select(keys).to_pydict()
            names = list(zip(*[rows[k] for k in by]))
            for name, group in itertools.groupby(range(len(names)), key=names.__getitem__):
                if name != request:
                    if taken:
                        yield done()
                    request, taken = name, []
                group = list(group)
                for start in range(0, len(group), 200):
                    if sum(n for n, _ in taken) < wanted:
                        pool = taken + [(rows[size][k], rows["block"][k]) for k in group[start : start + 200]]
                        taken = [pool[k] for k in take_exactly([n for n, _ in pool], wanted)]
        if taken:
            yield done()

    ordered = usable.repartition(*by).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in (*by, *order)])
    return ordered.mapInArrow(fold, ", ".join(f"{k} {kinds[k]}" for k in keys))


def permuted(questions: DataFrame, seed: str) -> DataFrame:
    """Options in an order by md5 of seed, row and place, and the answer's new places; locked questions (noshuffle, two
    options, null options) stay."""
    keyed = F.transform("options", lambda o, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col("row_id").cast("string"), i.cast("string"))).alias("k"), i.alias("i"), o.alias("o")))
    locked = F.coalesce(F.col("noshuffle"), F.lit(False)) | (F.size("options") <= 2) | F.col("options").isNull()
    q = questions.withColumn("_s", F.array_sort(keyed)).withColumn("locked", locked)
    places = F.transform(grading.answers(F.col("answer")), lambda a: F.array_position(F.transform("_s", lambda s: s["i"]), a).cast("int") - 1)
    shuffled = F.transform("_s", lambda s: s["o"])
    return q.withColumn("new_options", F.when(F.col("locked"), F.col("options")).otherwise(shuffled)).withColumn(
        "new_answers", F.when(F.col("locked"), grading.answers(F.col("answer"))).otherwise(F.array_sort(places))
    ).drop("_s")


def tracked(spec: QuizSpec, rows: DataFrame, index: DataFrame | None) -> DataFrame:
    """Rows of the banks of the spec's track (all without one) and of its src_banks (all without any)."""
    rows = catalog.in_track(rows, spec.track, index)
    return rows.where(F.col("bank").isin(*spec.src_banks)) if spec.src_banks else rows


def pool(spec: QuizSpec, questions: DataFrame, log: DataFrame, tags: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The questions that a request chooses from: by mode, then by type, without excluded tags."""
    q = with_type(questions)
    own = log if spec.user_id is None else log.where(F.col("user_id") == spec.user_id)
    item = ["bank", F.col("qid").cast("int").alias("id")]
    if spec.mode in SCOPED:
        if spec.mode == "key":
            items = None if tags is None else tags.where(F.col("tag") == "key")
        elif spec.mode == "stat":
            items = history.stat_filter(history.attempt_counts(own.withColumn("user_id", F.lit(spec.user_id))), *(_number(spec.min_wrong), _number(spec.max_accuracy)))
        else:
            pools = history.wrong_pools(own.withColumn("user_id", F.lit(spec.user_id)), "1970-01-01")
            items = pools.where("ever" if spec.mode == "wrong" else "still")
        q = q.limit(0) if items is None else q.join(tracked(spec, items.select(*item), index), ["bank", "id"], "left_semi")
    elif spec.mode == "retry":
        q = q.join(own.where((F.col("session_id") == spec.session_id) & ~F.col("correct")).select(*item), ["bank", "id"], "left_semi")
    elif spec.banks:
        q = q.where(F.col("bank").isin(*spec.banks))
    if spec.types:
        q = q.where(F.col("qtype").isin(*spec.types))
    if tags is not None and spec.excluded_tags:
        q = q.join(tags.where(F.col("tag").isin(*spec.excluded_tags)).select(*item), ["bank", "id"], "left_anti")
    return history.unseen(q, own) if spec.mode == "unseen" else q


def _number(x):
    return None if x is None or x == "" else x


def select(spec: QuizSpec, questions: DataFrame, log: DataFrame, overrides: DataFrame, tags: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The whole request: the pool, patches, and whole blocks in the mode's order, exactly num rows where that can be done."""
    own = log if spec.user_id is None else log.where(F.col("user_id") == spec.user_id)
    q = patched(pool(spec, questions, log, tags, index), overrides)
    counts = own.where("answered").groupBy("bank", F.col("qid").alias("id")).agg(F.count("*").alias("times"))
    q = blocks(q.join(counts, ["bank", "id"], "left").withColumn("times", F.coalesce("times", F.lit(0))))
    sized = q.groupBy("block").agg(F.count("*").cast("int").alias("size"), F.max("times").alias("times"))
    if spec.mode == "all":
        sized = sized.withColumn("key", F.col("block").cast("double"))
    else:
        sized = sized.withColumn("key", sampling_key(spec.seed, F.col("times") if spec.mode == "random" else F.lit(0), F.col("block")))
    sized = sized.withColumn("request", F.lit(0))
    if not spec.num:
        chosen = sized
    elif spec.mode == "all":
        # a quiz of n rows needs at most the n first blocks: a distributed top-k, then a window over those few rows
        chosen = take_blocks(sized.orderBy("key", "block").limit(spec.num), ["request"], ["key", "block"], "size", spec.num)
    else:
        chosen = exact_selection(sized, ["request"], ["key", "block"], "size", spec.num).join(sized.select("block", "key"), "block")
    return q.join(chosen.select("block", "key"), "block")
