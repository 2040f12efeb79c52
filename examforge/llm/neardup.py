"""Near-duplicate records with small edits (problem 4): an exact set-similarity join with set-relation skipping.

A record's set holds the runs of three characters of its reduced text (reduced question, then the reduced options sorted
by code point). Copies in the sense of problem 3 have one set: only the first of each class enters the join, and the
answers of the others are derived from its answers, with nothing to verify again.

Sets are ordered by how rare their shingles are (counts over all sets, hashed into a table whose size follows the
number of sets up to 2^23, and which only decides the order). Each set enters the index lists of its rarest shingles, as many as the threshold needs.
Of two sets of m and n shingles the overlap must reach A = t / (1 + t) * (m + n). In the list of their first common
shingle, at positions p and q, all p + q shingles in front of it differ, so at most m + n - 2 * A - p - q may differ behind
it. Each row carries a parity bitmap of what stands behind its shingle (differing bits never exceed differing shingles),
of 128 bits, and of 384 where more than about 40 shingles may differ. Lists are sorted by size; rows of sizes out of range
are skipped, the others met in tiles by one or two words of the bitmaps, and what is left by all of them and by positions.
An exact count of the shingles decides. No pair is lost, none is capped.

The rows go to their lists in packed columns, by ranges of the lists' hashes. A list longer than LIST rows (counted
exactly) is cut into parts by the sets' hash, and every pair of parts is a list of its own.

Defined cases: the domain is problem 3's; sets of texts shorter than three characters are empty and have no neighbours;
copies are no pairs of each other. A pair of classes gives one row for each pair of their members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examforge.llm.common import chunks, codepoints, hashed_counts, hot_join, mix64
from examforge.llm.formatdup import _lowered, copy_pairs, domain, kept
from examforge.session import checkpointed, small

THRESHOLD = 0.7
#: Bits of the number of buckets in the table of shingle counts, least and most.
RARITY_BITS = (20, 23)
LIST = 40_000
#: Lists up to this length are compared row by row, longer ones in tiles.
SHORT = 48
#: Pairs compared at once; more than any set has shingles.
STEP, SIZES = 1 << 20, 1 << 32


def reduced_texts(questions: list[str], options: list[list]) -> list[str]:
    """Reduced question and sorted reduced options of each row, joined."""
    flat, n = [], []
    for q, os in zip(questions, options):
        flat += [_lowered(q), *(_lowered(o or "") for o in os)]
        n.append(len(os))
    cps, starts = codepoints(flat)
    folded = kept(cps, starts)
    keep = folded != 0
    ends = np.concatenate(([0], np.cumsum(keep)))[starts]
    text = folded[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    parts = [text[a:b] for a, b in zip(ends[:-1], ends[1:])]
    out, i = [], 0
    for k in n:
        out.append(parts[i] + "".join(sorted(parts[i + 1 : i + 1 + k])))
        i += k + 1
    return out


def shingles(text: str) -> np.ndarray:
    """Sorted distinct runs of three characters, each packed into one integer without loss."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def needed(m, n, t: float):
    """Least overlap of sets of m and n shingles with similarity t."""
    return np.ceil(t / (1 + t) * (m + n) - 1e-9).astype(np.int64)


def _rarity(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(hashes.view(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


def _texts(batches):
    """Reduced texts, packed: (n, ids, ends, text) with the texts of a batch compressed, a tenth of the rows' size."""
    for b in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in reduced_texts(b.column(1).to_pylist(), b.column(2).to_pylist())]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        text = pa.compress(b"".join(texts), codec="zstd", asbytes=True) if len(texts) and ends[-1] else b""
        cols = [[len(texts)], [b.column(0).to_numpy().astype(np.int64).tobytes()], [pa.compress(_planes(ends, np.int64), codec="zstd", asbytes=True) if len(texts) else b""], [text]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["n", "ids", "ends", "text"])


def _unpacked(batches):
    for b in batches:
        for n, ids, ends, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if not n:
                continue
            ends = _from_planes(pa.decompress(ends, 8 * n, codec="zstd", asbytes=True), n, np.int64)
            text = pa.decompress(text, int(ends[-1]), codec="zstd", asbytes=True) if ends[-1] else b""
            texts = [text[i:j].decode("utf-8", "surrogatepass") for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(texts, pa.string())], names=["id", "text"])


def _planes(values: np.ndarray, kind) -> bytes:
    """The values' bytes, all first bytes first and so on: high bytes then compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).reshape(n)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three characters of all texts, and the number of the text of each."""
    cps, starts = codepoints(texts)
    c = cps.astype(np.int64)
    at = np.arange(len(c))
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    at = at[at + 2 < starts[1:][text]]
    return c[at] << 42 | c[at + 1] << 21 | c[at + 2], text[at]


def _ordered(texts: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, bucket's count): the sets of all texts, each set's shingles in the common order, rarest first."""
    grams, text = _grams(texts)
    known, at = np.unique(grams, return_inverse=True)
    often = counts[_rarity(known, len(counts))]
    order = np.lexsort((known, often))
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    key = text << 32 | rank[at]
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    which = order[key & 0xFFFFFFFF]
    return key >> 32, known[which], often[which]


#: Words of 64 bits in a bitmap: the first two hold 128 hash classes, and the six together three times as many, which only
#: rows need whose sets may differ in more than about 40 shingles.
WORDS = 6
_BITS = [f"b{i}" for i in range(WORDS)]
WIDE = 40


def _wide(size: np.ndarray, pos: np.ndarray, t: float) -> np.ndarray:
    return 2 * (1 - t) / (1 + t) * size - pos > WIDE


def _behind(tokens: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of the shingles from place `at` to the end of the set: their parity in each of 64 * WORDS hash classes. Words
    0 and 1 are folded together with the others, so that alone they are a bitmap of 128 classes."""
    h = mix64(tokens.view(np.uint64) ^ np.uint64(0x51ED)) % np.uint64(64 * WORDS)
    bit = np.uint64(1) << (h & np.uint64(63))
    word = h >> np.uint64(6)
    out = []
    for w in range(WORDS):
        mine = word % np.uint64(2) == w if w < 2 else word == w
        sums = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(mine, bit, np.uint64(0)))))
        out.append(sums[ends] ^ sums[at])
    return out


def _prefixes(texts: list[str], counts: np.ndarray, t: float) -> dict[str, np.ndarray]:
    """For each text's rarest shingles, as many as the threshold needs, that another text may have: text, token, size, pos
    and the bitmap of what stands behind."""
    text, tokens, often = _ordered(texts, counts)
    size = np.bincount(text, minlength=len(texts))
    ends = np.cumsum(size)
    pos = np.arange(len(text)) - (ends - size)[text]
    m = size[text]
    at = np.flatnonzero((pos < m - np.ceil(t * m - 1e-9) + 1) & (often > 1))  # a bucket counts at least the sets of each of its shingles
    return {"text": text[at], "token": tokens[at], "size": m[at], "pos": pos[at]} | dict(zip(_BITS, _behind(tokens, ends[text[at]], at)))


#: Rows of the index lists that are met at once, about.
GROUP = 1_000_000
_PACKED = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("bits", pa.binary())])
_COLUMNS = (("list", np.uint32), ("size", np.uint32), ("pos", np.uint32), ("id", np.int64), ("side", np.uint8))


def _packed(e: dict[str, np.ndarray], parts: int, t: float):
    """The rows by their lists' parts of the hash range: columns by planes and compressed, then the bitmaps."""
    order = np.argsort(e["list"].astype(np.uint64) << np.uint64(32) | e["size"].astype(np.uint64))
    e = {k: v[order] for k, v in e.items()}
    part = (e["list"].astype(np.int64) * parts) >> 32
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    rows, bits = [], []
    wide = _wide(e["size"], e["pos"], t)
    for a, b in zip(cuts[:-1], cuts[1:]):
        raw = b"".join(_planes(np.diff(e[c][a:b], prepend=k(0)) if c == "list" else e[c][a:b], k) for c, k in _COLUMNS)
        rows.append(pa.compress(raw, codec="zstd", asbytes=True))
        bits.append(b"".join([e["b0"][a:b].tobytes(), e["b1"][a:b].tobytes(), *(e[w][a:b][wide[a:b]].tobytes() for w in _BITS[2:])]))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((part[cuts[:-1]], np.diff(cuts), rows, bits), _PACKED)], schema=_PACKED)


def _unpacked_rows(blobs: list[tuple[int, bytes, bytes]], t: float) -> dict[str, np.ndarray]:
    """The rows of one part of the hash range, sorted by list and size."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in (*(c for c, _ in _COLUMNS), *_BITS)}
    width = sum(np.dtype(k).itemsize for _, k in _COLUMNS)
    for n, rows, bits in blobs:
        raw, first = pa.decompress(rows, width * n, codec="zstd", asbytes=True), 0
        for c, k in _COLUMNS:
            last = first + n * np.dtype(k).itemsize
            out[c].append(_from_planes(raw[first:last], n, k))
            first = last
        out["list"][-1] = np.cumsum(out["list"][-1], dtype=np.uint32)
        wide = _wide(out["size"][-1].astype(np.int64), out["pos"][-1].astype(np.int64), t)
        words = np.frombuffer(bits, np.uint64)
        few = int(wide.sum())
        for i, w in enumerate(_BITS):
            if i < 2:
                out[w].append(words[i * n : (i + 1) * n])
            else:
                full = np.zeros(n, np.uint64)
                full[wide] = words[2 * n + (i - 2) * few : 2 * n + (i - 1) * few]
                out[w].append(full)
    e = {c: np.concatenate(v) for c, v in out.items()}
    order = np.argsort(e["list"].astype(np.uint64) << np.uint64(32) | e["size"].astype(np.uint64))
    e = {c: v[order] for c, v in e.items()}
    return e | {c: e[c].astype(np.int32) for c in ("size", "pos")}


def index_entries(texts: DataFrame, rarity, t: float, parts: int, list_rows: int = LIST) -> DataFrame:
    """The index lists' rows, packed: each set under its rarest shingles. A list is known by 32 bits of its shingle's hash;
    two that meet by accident give candidates in vain. Of a list that is cut, every part's rows are repeated for each
    part that they must meet: side tells the two apart (2: a part with itself)."""

    def long_lists(batches):
        counts = rarity.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, last in chunks(texts):
                found = _prefixes(texts[first:last], counts, t)["token"]
                yield pa.RecordBatch.from_arrays([pa.array(found[counts[_rarity(found, len(counts))] > list_rows])], names=["token"])

    cut = np.zeros((2, 0), np.int64)
    if int(rarity.value.max()) > list_rows:  # else no bucket, so no list, is longer
        n = texts.mapInArrow(long_lists, "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > list_rows).toArrow()
        cut = np.stack([n.column(c).to_numpy().astype(np.int64) for c in ("token", "n")])  # at most one for list_rows rows
        cut = cut[:, np.argsort(cut[0])]
    cut = texts.sparkSession.sparkContext.broadcast(cut)

    def entries(batches):
        counts, (long, length) = rarity.value, cut.value
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for first, last in chunks(texts):
                e = _prefixes(texts[first:last], counts, t)
                e["id"] = ids[first:last][e.pop("text")]
                token = e.pop("token")
                n = np.ones(len(token), np.int64)
                if len(long):
                    at = np.minimum(np.searchsorted(long, token), len(long) - 1)
                    n = np.where(long[at] == token, -(-length[at] // list_rows), n)
                upto, begin = np.cumsum(n), 0
                while begin < len(token):
                    end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + GROUP, "right")))
                    some = np.repeat(np.arange(begin, end), n[begin:end])
                    other = np.arange(len(some)) - np.repeat(upto[begin:end] - n[begin:end] - (upto[begin - 1] if begin else 0), n[begin:end])
                    own = (mix64(e["id"][some].view(np.uint64)) % n[some].astype(np.uint64)).astype(np.int64)
                    pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).view(np.uint64)
                    rows = {c: v[some] for c, v in e.items()}
                    rows["list"] = (mix64(token[some].view(np.uint64) ^ np.where(pair > 0, mix64(pair), np.uint64(0))) >> np.uint64(32)).astype(np.uint32)
                    rows["side"] = np.where(own == other, 2, own > other).astype(np.uint8)
                    yield _packed(rows, parts, t)
                    begin = end

    return texts.mapInArrow(entries, "part int, n int, rows binary, bits binary")


def _near(e: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Where the first common shingle of two sets can be that of their list: in front of it (pos) all shingles differ, and
    behind it at least as many as the numbers left and the bitmaps do."""
    m, n = e["size"][x].astype(np.int64), e["size"][y].astype(np.int64)
    i, j = e["pos"][x], e["pos"][y]
    most = m + n - 2 * needed(m, n, t) - i - j
    d0, d1 = e["b0"][x] ^ e["b0"][y], e["b1"][x] ^ e["b1"][y]
    ok = (np.abs(m - i - n + j) <= most) & (np.bitwise_count(d0).astype(np.int64) + np.bitwise_count(d1) <= most)
    both = np.flatnonzero(ok & _wide(m, i, t) & _wide(n, j, t))
    if len(both):
        d = [e[b][x[both]] ^ e[b][y[both]] for b in _BITS[2:]]
        apart = np.bitwise_count(d0[both] ^ d[0] ^ d[2]).astype(np.int64) + np.bitwise_count(d1[both] ^ d[1] ^ d[3])
        ok[both] = apart + sum(np.bitwise_count(w) for w in d) <= most[both]
    return ok


#: Rows and columns of a tile of a long list.
TILE = (64, 2048)


def list_pairs(e: dict[str, np.ndarray], starts: np.ndarray, t: float):
    """Candidate pairs (row numbers) of the lists that begin at starts; rows are sorted by list and size."""
    ends = np.append(starts[1:], len(e["id"]))
    m = e["size"].astype(np.int64)
    share = (1 - t) / (1 + t) * m - e["pos"]  # two rows' shares are the most by which what stands behind may differ
    of = np.repeat(np.arange(len(starts)), ends - starts)  # the list of each row
    smaller = share >= -1e-6  # rows that may be the smaller side, against those behind them, up to the largest size
    last = np.searchsorted(of * SIZES + m, of * SIZES + np.floor(m / t + 1e-9).astype(np.int64), "right")
    short = (ends - starts <= SHORT)[of]
    rows = np.flatnonzero(smaller & short)
    n = last[rows] - rows - 1
    upto = np.cumsum(n)
    first = 0
    while first < len(rows):
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + STEP, "right")))
        r, k = rows[first:end], n[first:end]
        first = end
        x = np.repeat(r, k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        ok = np.flatnonzero(np.bitwise_count(e["b0"][x] ^ e["b0"][y]) <= share[x] + share[y] + 1e-6)
        x, y = x[ok], y[ok]
        ok = _near(e, x, y, t)
        yield x[ok], y[ok]
    # long lists in tiles, by one word of the bitmaps or two where sets are large, then what is left pair by pair
    up = np.ceil(np.clip(share, -8000, 8000)).astype(np.int16)
    found, size = [], 0
    for a, b in zip(starts[ends - starts > SHORT].tolist(), ends[ends - starts > SHORT].tolist()):
        rows = a + np.flatnonzero(smaller[a:b])
        for k in range(0, len(rows), TILE[0]):
            r = rows[k : k + TILE[0]]
            words = _BITS[: 1 if m[r[-1]] <= 110 else 2]
            for c in range(int(r[0]) + 1, int(last[r[-1]]), TILE[1]):
                d = min(c + TILE[1], int(last[r[-1]]))
                apart = sum(np.bitwise_count(e[w][r][:, None] ^ e[w][None, c:d]) for w in words).astype(np.int16)
                u, v = np.nonzero(apart <= up[r][:, None] + up[None, c:d])
                u, v = r[u], v + c
                ok = (u < v) & (v < last[u])
                found.append((u[ok], v[ok]))
                size += len(u)
            if size >= STEP:
                yield from _left(e, found, t)
                found, size = [], 0
    if found:
        yield from _left(e, found, t)


def _left(e: dict[str, np.ndarray], found: list, t: float):
    x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    for k in range(0, len(x), STEP):
        u, v = x[k : k + STEP], y[k : k + STEP]
        ok = _near(e, u, v, t)
        yield u[ok], v[ok]


def _candidates(t: float):
    def pairs(blobs):
        e = _unpacked_rows(blobs, t)
        starts = np.flatnonzero(np.append(True, e["list"][1:] != e["list"][:-1]))
        for x, y in list_pairs(e, starts, t):
            a, b = e["id"][x], e["id"][y]
            ok = (a != b) & ((e["side"][x] != e["side"][y]) | (e["side"][x] == 2))
            if ok.any():
                a, b = a[ok], b[ok]
                p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    def meet(batches):
        part, blobs = None, []
        for batch in batches:
            for p, *blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != part and blobs:
                    yield from pairs(blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield from pairs(blobs)

    return meet


def similar_classes(texts: DataFrame, t: float = THRESHOLD, list_rows: int = LIST) -> DataFrame:
    """(a, b, similarity): pairs of ids a < b whose texts' sets have Jaccard similarity t or more. texts: id, text.

    The ids of candidates meet their texts by joins that fetch no other texts; an id with very many partners is spread.
    """
    sets = texts.count()
    buckets = 1 << min(max(RARITY_BITS[0], (8 * sets).bit_length()), RARITY_BITS[1])
    counts = hashed_counts(texts.select("text"), buckets, lambda ts: _rarity(_grams(ts)[0], buckets))
    rarity = texts.sparkSession.sparkContext.broadcast(np.maximum(counts, 1).astype(np.int32))  # 32 MB at most
    lists = index_entries(texts, rarity, t, max(96, 40 * sets // GROUP), list_rows).repartition("part").sortWithinPartitions("part")
    candidates = checkpointed(lists.mapInArrow(_candidates(t), "a bigint, b bigint").distinct())
    needed_ids = checkpointed(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    of = texts.join(small(needed_ids, 1_000_000), "id", "left_semi")
    sides = hot_join(candidates, of.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a", "b")
    sides = hot_join(sides, of.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b", "a", candidates)

    def verify(batches):
        for batch in batches:
            known: dict[str, np.ndarray] = {}

            def of(text):
                if text not in known:
                    known[text] = shingles(text)
                return known[text]

            rows = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = of(x), of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and both >= t * (len(x) + len(y) - both) - 1e-9:
                    rows.append((a, b, both / (len(x) + len(y) - both)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], p) for k, p in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    found = sides.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))  # rows that repeat give one pair


def class_pairs(questions: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes: a, b, similarity; copies: first_id, row_id). Both are written to the checkpoint folder."""
    copies = checkpointed(copy_pairs(questions))
    firsts = domain(questions).join(small(copies.select("row_id"), 1_000_000), "row_id", "left_anti")
    texts = firsts.select("row_id", "question", "options").mapInArrow(_texts, "n bigint, ids binary, ends binary, text binary")
    texts = checkpointed(texts)
    return checkpointed(similar_classes(texts.mapInArrow(_unpacked, "id bigint, text string"), t)), copies


#: Members of a class that meet a partner in one task.
MEMBERS = 5_000


def row_pairs(questions: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(row_id_a, row_id_b, similarity): all pairs of rows of similar classes, the answers of copies derived from their class's.

    A class's members are cut into parts of about MEMBERS rows, and a pair of classes becomes a pair for every two parts,
    so that no task gets the members of a large class at once.
    """
    pairs, copies = class_pairs(questions, t)
    ids = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("first_id")).distinct())
    sizes = ids.join(copies.groupBy("first_id").agg(F.count("*").alias("n")), "first_id", "left")
    sizes = checkpointed(sizes.select("first_id", F.ceil((F.coalesce("n", F.lit(0)) + 1) / MEMBERS).cast("int").alias("parts")))
    split = small(sizes.where("parts > 1"), 1_000_000)  # at most a 5,000th of all rows
    parts = lambda df, key: df.join(split.select(F.col("first_id").alias(key), F.col("parts").alias(f"n_{key}")), key, "left").withColumn(f"n_{key}", F.coalesce(f"n_{key}", F.lit(1)))
    members = copies.join(ids, "first_id", "left_semi").unionByName(ids.select("first_id", F.col("first_id").alias("row_id")))
    members = parts(members, "first_id").select("first_id", "row_id", F.pmod(F.xxhash64("row_id"), "n_first_id").cast("int").alias("part"))
    members = checkpointed(members)
    both = parts(parts(pairs, "a"), "b")
    for key in ("a", "b"):
        both = both.withColumn(f"p_{key}", F.explode(F.sequence(F.lit(0), F.col(f"n_{key}") - 1)))
    for key, row in (("a", "x"), ("b", "y")):
        side = members.select(F.col("first_id").alias(key), F.col("part").alias(f"p_{key}"), F.col("row_id").alias(row))
        both = both.join(side, [key, f"p_{key}"])
    return both.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"), "similarity")


def groups(questions: DataFrame, t: float = THRESHOLD, rounds: int = 40) -> DataFrame:
    """(row_id, group_id, n_links): every row of the domain, the smallest row_id it is connected to, its class's links.

    Connected components of the similar classes by alternating large and small star steps over edge tables, each round
    written to the checkpoint folder; nothing but a count of changes comes to the driver.
    """
    pairs, copies = class_pairs(questions, t)
    edges = checkpointed(pairs.select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("first_id")).groupBy("first_id").agg(F.count("*").alias("n_links"))
    before = None
    for _ in range(rounds):
        edges = checkpointed(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    component = edges.groupBy(F.col("b").alias("first_id")).agg(F.min("a").alias("group_id"))
    classes = domain(questions).select("row_id").distinct().join(copies, "row_id", "left").select("row_id", F.coalesce("first_id", "row_id").alias("first_id"))
    out = classes.join(component, "first_id", "left").join(links, "first_id", "left")
    return out.select("row_id", F.coalesce("group_id", "first_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of the node and its neighbours. Edges are (a < b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where(F.col("a") < F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    met = edges.join(least, "b")
    return met.select(F.col("m").alias("a"), F.col("b")).unionByName(met.select(F.col("m").alias("a"), F.col("a").alias("b"))).where(F.col("a") < F.col("b")).distinct()
