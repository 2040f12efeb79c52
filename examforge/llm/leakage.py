"""Evaluation texts leaking into training text (problem 6).

Texts are squashed (NFKC, lower case, letters and digits only) by a table over code points. A document that shares a
run of at least R characters with an item holds, whole, one of the windows of w characters that start every R - w + 1
characters of the document; of the item every window is indexed.

Windows are embedded by the CGK random walk: symbol j of the embedding is the character under the pointer, which then
moves on by a random bit that depends on j and the character. Edit distance becomes Hamming distance, so windows that
differ by few edits agree in most symbols. Each of `repetitions` hashes samples some symbols of the embedding of one
walk; windows with the same sample are candidates. Equal windows have equal embeddings, so exact runs are found with
certainty by one repetition; with edits, a candidate is missed with probability (1 - q)^repetitions, q the chance that
one sample agrees.

Candidates are verified: exactly (the run around the window has R characters in both texts), or by the least edit
distance of the passage to any part of the document around the window.

Defined cases: null or empty texts and passages give nothing; an item whose squashed passage is shorter than its run
length can't leak; a null or other lang counts as `zh`; repeated rows give one pair. Empty tables give no rows.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examforge.llm.common import N_CODEPOINTS, chunks, codepoints, mix64

RUN = {"zh": 24, "en": 50}
WINDOW = {"zh": 12, "en": 25}
#: Symbols sampled from an embedding for one hash.
SAMPLED = 8
#: Squashed characters of the items indexed at once, some 25 MB of index a repetition; more items take several passes.
INDEX_CHARS = 1_000_000
#: Share of the leaks of the shortest passages, with as many edits as are allowed, that edited_leaks is to find.
TARGET_RECALL = 0.98


def squash(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if unicodedata.category(c)[0] in "LN")


@lru_cache(maxsize=1)
def _tables():
    """Width and place in the pool of each code point's squashed form; whether it may compose with its neighbours."""
    width, place, composes = np.zeros(N_CODEPOINTS, np.uint8), np.zeros(N_CODEPOINTS, np.int32), np.zeros(N_CODEPOINTS, bool)
    pool: list[int] = []
    for cp in range(N_CODEPOINTS):
        if 0xD800 <= cp < 0xE000 or 0xE000 <= cp < 0xF900 or cp > 0x323AF:
            continue
        c = chr(cp)
        composes[cp] = unicodedata.combining(c) != 0 or unicodedata.category(c)[0] == "M" or 0x1100 <= cp < 0x1200 or c == "Σ" or 0xFF9E <= cp <= 0xFF9F
        s = squash(c)
        if s:
            width[cp], place[cp] = len(s), len(pool)
            pool.extend(map(ord, s))
    return width, place, composes, np.array(pool, np.uint32)


def squashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the squashed texts, and the n + 1 offsets of the texts."""
    width, place, composes, pool = _tables()
    cps, starts = codepoints(texts)
    odd = composes[cps] if len(cps) else np.zeros(0, bool)
    if odd.any():  # characters that compose are squashed with their text
        hit = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
        texts = list(texts)
        for i in hit:
            texts[i] = squash(texts[i])
        cps, starts = codepoints(texts)
    w = width[cps].astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(w)))
    if len(w) and w.max() <= 1:
        out = pool[place[cps[w > 0]]]
    else:
        out = pool[np.repeat(place[cps] - ends[:-1], w) + np.arange(ends[-1])]
    return out, ends[starts]


def sample_places(window: int, repetition: int) -> np.ndarray:
    """The embedding's symbols that repetition's hash looks at, in order."""
    r = np.random.default_rng([20, window, repetition])
    return np.sort(r.choice(2 * window, SAMPLED, replace=False))


def window_hashes(cps: np.ndarray, at: np.ndarray, window: int, repetition: int) -> np.ndarray:
    """64-bit hash of the sampled CGK symbols of each window cps[at : at + window]."""
    places = sample_places(window, repetition)
    pointer = at.astype(np.int64)
    last = pointer + window
    padded = np.append(cps, np.uint32(0)).astype(np.uint32)
    h = np.zeros(len(at), np.uint64)
    symbol_salt = np.uint32(0x9E3779B1)
    take = iter(places)
    wanted = next(take)
    for j in range(places[-1] + 1):
        symbol = padded[np.minimum(pointer, len(cps))]
        symbol[pointer >= last] = 0
        if j == wanted:
            h = h * np.uint64(0x9FB21C651E98DF25) + symbol + np.uint64(1)
            wanted = next(take, -1)
        mixed = (symbol ^ np.uint32((j * 7919 + repetition * 104729) & 0xFFFFFFFF)) * symbol_salt
        pointer += ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(31)).astype(np.int64)
    return mix64(h)


class Index:
    """The windows of a block of items, sorted by hash, for each language and repetition."""

    def __init__(self, items: list[tuple[int, str, str]], repetitions: int):
        self.ids = np.array([i for i, _, _ in items], np.int64)
        self.cps, self.starts = squashed([p for _, _, p in items])
        self.lang = np.array(["en" if lang == "en" else "zh" for _, lang, _ in items])
        self.parts = []
        self.bits: dict[int, dict[int, int]] = {}
        for lang in WINDOW:
            w = WINDOW[lang]
            at = [np.arange(s, e - w + 1) for s, e, k in zip(self.starts[:-1], self.starts[1:], self.lang) if k == lang and e - s >= RUN[lang]]
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            item = np.searchsorted(self.starts, at, "right") - 1
            for r in range(repetitions):
                h = window_hashes(self.cps, at, w, r)
                order = np.argsort(h, kind="stable")
                mask = np.zeros(1 << 20, bool)
                mask[h >> np.uint64(44)] = True
                self.parts.append((lang, r, h[order], at[order], item[order], mask))


def _matches(index: Index, cps: np.ndarray, starts: np.ndarray, step_of) -> tuple[np.ndarray, ...]:
    """For each part of the index: language, document number, place in the documents, place in the items, item number."""
    lengths = np.diff(starts)
    for lang, r, hashes, at, item, mask in index.parts:
        if not len(hashes):
            continue
        w = WINDOW[lang]
        step = step_of(lang)
        n = np.where(lengths >= w, (lengths - w) // step + 1, 0)
        doc = np.repeat(np.arange(len(lengths)), n)
        place = starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
        h = window_hashes(cps, place, w, r)
        maybe = np.flatnonzero(mask[h >> np.uint64(44)])
        doc, place, h = doc[maybe], place[maybe], h[maybe]
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        k = hi - lo
        doc, place = np.repeat(doc, k), np.repeat(place, k)
        entry = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())
        yield lang, doc, place, at[entry], item[entry]


def _runs(index: Index, cps, starts, lang, doc, place, at, item) -> np.ndarray:
    """Whether the two texts share RUN[lang] characters around the window."""
    need, w = RUN[lang], WINDOW[lang]
    same = np.ones(len(doc), bool)
    for j in range(w):
        same &= cps[place + j] == index.cps[at + j]
    live = np.flatnonzero(same)
    length = np.where(same, w, 0)
    for sign, offset in ((-1, -1), (1, w)):
        go = live
        for j in range(need - w):
            p, a = place[go] + offset + sign * j, at[go] + offset + sign * j
            inside = (p >= starts[doc[go]]) & (p < starts[doc[go] + 1]) & (a >= index.starts[item[go]]) & (a < index.starts[item[go] + 1])
            go, p, a = go[inside], p[inside], a[inside]
            go = go[cps[p] == index.cps[a]]
            if not len(go):
                break
            length[go] += 1
    return length >= need


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Levenshtein distance of two code-point arrays, most + 1 if it is larger (rows of the table as vectors)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    ramp = np.arange(len(b) + 1)
    row = ramp.copy()
    for i, c in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != c))
        row = np.minimum.accumulate(np.concatenate(([i], step)) - ramp) + ramp
        if row.min() > most:
            return most + 1
    return int(min(row[-1], most + 1))


def passage_bits(passage: np.ndarray) -> dict[int, int]:
    """For each character of a passage the bits of its places in it."""
    bits: dict[int, int] = {}
    for j, c in enumerate(passage.tolist()):
        bits[c] = bits.get(c, 0) | 1 << j
    return bits


def nearest(bits: dict[int, int], length: int, text: np.ndarray) -> int:
    """Least edit distance of a passage to any part of a text: Myers' bit-parallel search, with free ends in the text."""
    if not length:
        return 0
    mask, top = (1 << length) - 1, 1 << (length - 1)
    up, down, now = mask, 0, length
    best = length
    for c in text.tolist():
        eq = bits.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | mask & ~(h | up), up & h
        if more & top:
            now += 1
        elif less & top:
            now -= 1
            if now < best:
                best = now
                if not best:
                    break
        more = more << 1 & mask
        up, down = (less << 1 | ~(v | more)) & mask, more & v
    return best


def most_edits(length, share: float):
    """Edits that a passage of so many characters may have; a product that is whole but for its rounding counts as whole."""
    return np.floor((1 - share) * length + 1e-9).astype(np.int64)


def _edited(index: Index, cps, starts, lang, doc, place, at, item, share: float):
    """Best similarity of each (document, item): 1 - edits / passage length, with free ends in the document.

    Edits before a window move the passage's ends by up to as many characters, and its sampled symbols may lie as far
    apart as the window is wide, so the stretch is widened by both on either side. Stretches that meet are one.
    """
    best: dict[tuple[int, int], float] = {}
    if not len(doc):
        return best
    length = np.diff(index.starts)[item]
    wider = most_edits(length, share) + WINDOW[lang]
    s = place - at + index.starts[item]
    lo, hi = np.maximum(s - wider, starts[doc]), np.minimum(s + length + wider, starts[doc + 1])
    order = np.lexsort((hi, lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1]))))
    last = np.append(first[1:], len(doc)) - 1
    for d, i, x, y in zip(doc[first].tolist(), item[first].tolist(), lo[first].tolist(), hi[last].tolist()):
        if best.get((d, i), 0) == 1:
            continue
        passage = index.cps[index.starts[i] : index.starts[i + 1]]
        if i not in index.bits:
            index.bits[i] = passage_bits(passage)
        e = nearest(index.bits[i], len(passage), cps[x:y])
        if e <= most_edits(len(passage), share):
            best[d, i] = max(best.get((d, i), 0), 1 - e / len(passage))
    return best


def _blocks(items: DataFrame):
    """Blocks of items whose indexes have a bounded size, fetched one partition at a time."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("bigint"), "lang", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).distinct()
    for item_id, lang, passage in rows.toLocalIterator():
        block.append((item_id, lang, passage))
        size += len(passage)
        if size > INDEX_CHARS:
            yield block
            block, size = [], 0
    yield block


def exact_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that share a run of RUN squashed characters with an item."""
    return _search(documents, items, 1, None)


@lru_cache(maxsize=8)
def repetitions_for(share: float, target: float = TARGET_RECALL, trials: int = 400, most: int = 64) -> int:
    """Least number of repetitions that finds the target share of passages of RUN characters, the shortest that count, with
    (1 - share) of them substituted, inserted or deleted at random places. Longer passages have more windows and are
    found more often. Measured on `trials` random passages a language, the same in every session."""
    r = np.random.default_rng(7)
    wanted = 1
    for lang, run in RUN.items():
        w, edits = WINDOW[lang], int(most_edits(run, share))
        symbols = 30_000 if lang == "zh" else 30
        items, docs = [], []
        for _ in range(trials):
            passage = r.integers(1, symbols, run)
            doc = passage.tolist()
            for _ in range(edits):
                k = int(r.integers(0, len(doc)))
                doc[k : k + int(r.integers(0, 2))] = r.integers(1, symbols, int(r.integers(0, 2))).tolist()
            pad = r.integers(1, symbols, w + int(r.integers(0, w))).tolist()
            items.append(passage)
            docs.append(np.array([*pad, *doc, *r.integers(1, symbols, w).tolist()]))
        starts = lambda parts: np.cumsum([0, *map(len, parts)])
        of_items = [(k, np.arange(a, b - w + 1)) for k, (a, b) in enumerate(zip(starts(items)[:-1], starts(items)[1:]))]
        of_docs = [(k, np.arange(a, b - w + 1, w // 2)) for k, (a, b) in enumerate(zip(starts(docs)[:-1], starts(docs)[1:]))]
        found = np.zeros(trials, bool)
        for n in range(1, most + 1):
            keys = []
            for parts, places in ((items, of_items), (docs, of_docs)):
                at = np.concatenate([x for _, x in places])
                trial = np.repeat([k for k, _ in places], [len(x) for _, x in places])
                keys.append((trial, window_hashes(np.concatenate(parts).astype(np.uint32), at, w, n - 1) ^ mix64(trial.astype(np.uint64))))
            found[np.unique(keys[1][0][np.isin(keys[1][1], keys[0][1])])] = True
            if found.mean() >= target:
                break
        wanted = max(wanted, n)
    return wanted


def edited_leaks(documents: DataFrame, items: DataFrame, share: float = 0.9, repetitions: int | None = None) -> DataFrame:
    """(doc_id, item_id, similarity): documents that hold an item's whole passage but for up to 1 - share of it in edits.

    A window of w characters without an edit exists in the passage for every such document if edits come in groups;
    else windows with an edit must agree in a sample. Windows start every w // 2 characters. The number of repetitions
    follows from TARGET_RECALL.
    """
    return _search(documents, items, repetitions or repetitions_for(share), share)


def _search(documents: DataFrame, items: DataFrame, repetitions: int, share: float | None) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    results = []
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(Index(block, repetitions))

        def search(batches, shared=shared):
            index = shared.value
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])
            for b in batches:
                ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
                for first, last in chunks(texts):
                    cps, starts = squashed(texts[first:last])
                    found: dict[tuple[int, int], float] = {}
                    step = (lambda lang: RUN[lang] - WINDOW[lang] + 1) if share is None else (lambda lang: WINDOW[lang] // 2)
                    for lang, doc, place, at, item in _matches(index, cps, starts, step):
                        if share is None:
                            ok = _runs(index, cps, starts, lang, doc, place, at, item)
                            found.update(dict.fromkeys(zip(doc[ok].tolist(), item[ok].tolist()), 1.0))
                        else:
                            for k, v in _edited(index, cps, starts, lang, doc, place, at, item, share).items():
                                found[k] = max(found.get(k, 0), v)
                    if found:
                        d, i = np.array(list(found)).T
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first + d]), pa.array(index.ids[i]), pa.array(list(found.values()), pa.float64())], schema=schema)

        results.append(docs.mapInArrow(search, "doc_id bigint, item_id bigint, similarity double"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    if share is None:
        return out.select("doc_id", "item_id").distinct()
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
