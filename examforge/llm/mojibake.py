"""Garbled text from wrong character encoding (problem 1).

A multinomial (naive Bayes) classifier on hashed byte bigrams has one class for clean text and one for each encoding
chain: text written in one encoding and read in another, once or twice. It is trained on a bounded sample of the table's
own fields, left as they are for the clean class and garbled synthetically for the others; a second round leaves out of
the clean class what the first round found, so that the garbled fields of the sample don't count as clean.

A bigram's score for a chain is its log-odds against clean text. Scores add up along the text, so the stretch that a
chain most likely garbled is the one of largest sum, for every chain at once by running minima. The best chain's
stretch is taken, and again until no stretch is left over the threshold. The chain is then inverted: the stretch is
encoded and decoded the other way round, strictly, its ends moved by a few characters where needed. A stretch counts as
found if it decodes strictly and reads more like clean text, or if it holds replacement characters, or private or
control characters at a high score; then what still decodes is restored and the field is marked as such.

Defined cases: null fields are no cases, empty ones are clean. If the table is empty there is no model and nothing is
found. Repeated rows are judged one by one. Fields are judged whole, however long.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examforge.llm.common import LOOKALIKES, chunks, hashed_counts, question_fields, sampled_texts

#: Fields in the training sample, and buckets of hashed byte bigrams.
SAMPLE_FIELDS = 12_000
BUCKETS = 1 << 15
#: Buckets of character pairs.
PAIRS = 1 << 19
#: Nats that a stretch must score to be looked at; nats at which a stretch that can't be inverted counts as garbled.
LOOK, SURE = 6.0, 45.0
SMOOTHING = 0.5
#: By how much the inverted stretch must read more like the sample; one ideograph alone is easily one for another.
MARGIN, MARGIN_ONE = 1.0, 3.0
ENDS = 3

_UNDEFINED = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
_CP1252 = {b: chr(b) if b in _UNDEFINED else bytes([b]).decode("cp1252") for b in range(256)}
_CP1252_BACK = {c: b for b, c in _CP1252.items()}


def _decode(raw: bytes, codec: str, errors: str = "replace") -> str:
    if codec == "windows-1252":  # as browsers do it: undefined bytes are control characters
        return "".join(map(_CP1252.__getitem__, raw))
    return raw.decode(codec, errors)


def _encode(text: str, codec: str) -> bytes:
    if codec == "windows-1252":
        return bytes(map(_CP1252_BACK.__getitem__, text))
    return text.encode(codec)


#: Chain -> steps (written as, read as). Several codec names are variants of one encoding, tried in order when inverting.
CHAINS: dict[str, tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]] = {
    "utf8_as_cp1252": ((("utf-8",), ("windows-1252",)),),
    "utf8_as_latin1": ((("utf-8",), ("latin-1",)),),
    "utf8_as_cp1252_twice": ((("utf-8",), ("windows-1252",)), (("utf-8",), ("windows-1252",))),
    "utf8_as_macroman": ((("utf-8",), ("mac_roman",)),),
    "utf8_as_gb18030": ((("utf-8",), ("gb18030", "gbk")),),
    "utf8_as_big5": ((("utf-8",), ("cp950", "big5hkscs", "big5")),),
    "utf8_as_cp932": ((("utf-8",), ("cp932", "shift_jis")),),
    "big5_as_cp1252": ((("cp950", "big5hkscs"), ("windows-1252", "latin-1")),),
    "big5_as_gb18030": ((("cp950", "big5hkscs"), ("gb18030", "gbk")),),
    "gbk_as_big5": ((("gb18030", "gbk"), ("big5hkscs", "cp950", "big5")),),
    "gbk_as_cp1252": ((("gb18030", "gbk"), ("windows-1252", "latin-1")),),
    "big5_as_cp932": ((("cp950", "big5hkscs"), ("cp932", "shift_jis")),),
}
#: Not invertible: non-ASCII bytes replaced one by one; single bytes of characters overwritten.
LOSSY = ("utf8_as_ascii", "utf8_damaged")
CLASSES = ("clean", *CHAINS, *LOSSY)


def garble(text: str, chain: str, seed: int = 0) -> str:
    if chain == "utf8_as_ascii":
        return text.encode("utf-8").decode("ascii", "replace")
    if chain == "utf8_damaged":
        raw = bytearray(text.encode("utf-8"))
        r = np.random.default_rng(seed)
        for i in np.flatnonzero(r.random(len(raw)) < 0.2):
            if raw[i] >= 0x80:
                raw[i] = 0x80
        return bytes(raw).decode("utf-8", "replace")
    for written, read in CHAINS[chain]:
        text = _decode(text.encode(written[0], "replace"), read[0])
    return text


def _buckets(raw: np.ndarray) -> np.ndarray:
    """Hashed bigram that starts at each byte but the last."""
    pair = raw[:-1].astype(np.uint32) << np.uint32(8) | raw[1:]
    return ((pair * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)


def _bytes(text: str) -> bytes:
    return b"\n" + text.encode("utf-8", "surrogatepass") + b"\n"


def _characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the characters and of the character pairs of a text."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = np.where((cps >= 48) & (cps < 58), np.uint32(48), cps)
    pair = cps[:-1] * np.uint32(0x9E3779B1) ^ cps[1:] * np.uint32(0x85EBCA77)
    return np.minimum(cps, 0xFFFF), (pair ^ pair >> np.uint32(15)) & np.uint32(PAIRS - 1)


#: Fields to whose number the counts of characters and pairs are scaled, so that the margins mean the same at every size.
SCALE = 12_000


def usage_hashes(texts: list[str]) -> np.ndarray:
    """Places of all characters and, behind them, of all character pairs of the texts in one table of counts."""
    codes, pairs = _characters("\n".join(texts))
    return np.concatenate((codes.astype(np.int64), pairs.astype(np.int64) + 0x10000))


class Model:
    """scores[chain, bucket]: log-odds against clean; characters, pairs: counts over all fields, scaled to SCALE fields.

    texts: the sample that the classifier is fitted on. usage: counts of usage_hashes over `fields` fields; without them
    the sample's own.
    """

    def __init__(self, texts: list[str], usage: np.ndarray | None = None, fields: int = 0):
        if usage is None:
            usage, fields = np.bincount(usage_hashes(texts), minlength=0x10000 + PAIRS), len(texts)
        scaled = (usage * (SCALE / max(fields, 1))).astype(np.float32)
        self.characters, self.pairs, self.kept = scaled[:0x10000], scaled[0x10000:], {}
        keep = texts
        for _ in range(2):
            counts = np.full((len(CLASSES), BUCKETS), SMOOTHING)
            for k, name in enumerate(CLASSES):
                garbled = keep if name == "clean" else [garble(t, name, i) for i, t in enumerate(keep)]
                raw = np.frombuffer(b"".join(map(_bytes, garbled)), np.uint8)
                if name != "clean":
                    # what a chain leaves as it is (ASCII) says nothing of the chain
                    high = (raw[:-1] >= 0x80) | (raw[1:] >= 0x80)
                    counts[k] += np.bincount(_buckets(raw)[high], minlength=BUCKETS)
                else:
                    counts[k] += np.bincount(_buckets(raw), minlength=BUCKETS)
            logs = np.log(counts / counts.sum(axis=1, keepdims=True))
            self.scores = np.clip(logs[1:] - logs[0], -12, 9).astype(np.float32)
            ascii_pairs = _buckets(np.array([[a, b] for a in range(128) for b in range(128)], np.uint8).reshape(-1))[::2]
            seen_high = np.zeros(BUCKETS, bool)
            seen_high[np.flatnonzero(counts[1:].max(axis=0) > SMOOTHING)] = True
            plain = np.setdiff1d(ascii_pairs, np.flatnonzero(seen_high))
            self.scores[:, plain] = -0.5
            self.best = self.scores.max(axis=0, keepdims=True)
            keep = [t for t, odd in zip(texts, self.suspicious(texts)) if not (odd and repair(self, t))]
        self.kept = {}

    def suspicious(self, texts: list[str]) -> np.ndarray:
        """Whether any stretch scores LOOK for any chain: the largest sums, for all texts at once.

        A first pass takes the best chain of every bigram, which bounds all of them; the chains are gone through one by
        one only for the texts that this bound leaves.
        """
        out = np.zeros(len(texts), bool)
        for first, last in chunks(texts):
            maybe = np.flatnonzero(self._over(texts[first:last], self.best)) + first
            out[maybe] = self._over([texts[i] for i in maybe], self.scores) if len(maybe) else False
        return out

    @staticmethod
    def _over(texts: list[str], tables: np.ndarray) -> np.ndarray:
        parts = [_bytes(t) for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        starts = np.concatenate(([0], ends[:-1]))
        buckets = _buckets(np.frombuffer(b"".join(parts) + b"\n", np.uint8))
        text = np.repeat(np.arange(len(parts), dtype=np.float64), np.diff(np.append(starts, ends[-1:])))
        out = np.zeros(len(parts), bool)
        for scores in tables:
            s = scores[buckets].astype(np.float64)
            s[ends - 1] = 0
            total = np.cumsum(s)
            drop = text * (np.abs(s).sum() + 1)  # keeps the running minimum within its text
            gain = total - drop - np.minimum.accumulate(total - s - drop)
            out |= np.maximum.reduceat(gain, starts) >= LOOK
        return out

    def stretches(self, text: str) -> list[tuple[int, int, list[str], float]]:
        """(start, end, chains, score) in characters of the stretches over LOOK; their chains over LOOK, best first."""
        raw = np.frombuffer(_bytes(text), np.uint8)
        s = self.scores[:, _buckets(raw)].astype(np.float64)
        char = np.cumsum((raw & 0xC0) != 0x80) - 2  # the character of each byte
        out = []
        parts = [(0, s.shape[1])]  # a stretch leaves the bigrams before and behind it to be searched by themselves
        while parts:
            x, y = parts.pop()
            if x >= y:
                continue
            part = s[:, x:y]
            total = np.cumsum(part, axis=1)
            low = np.minimum.accumulate(total - part, axis=1)
            gain = total - low
            k, j = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[k, j] < LOOK:
                continue
            best = float(gain[k, j])
            i = x + int(np.flatnonzero((total - part)[k, : j + 1] == low[k, j])[-1])
            j += x
            parts += [(x, i), (j + 1, y)]
            first = i + (raw[i] < 0x80)  # a bigram at an end may only touch a plain character
            last = j + (raw[j + 1] >= 0x80)
            a, b = max(int(char[first]), 0), min(int(char[last]) + 1, len(text))
            each = s[:, i : j + 1].sum(axis=1)
            names = [(*CHAINS, *LOSSY)[c] for c in np.argsort(-each) if each[c] >= LOOK] or [(*CHAINS, *LOSSY)[k]]
            out.append((a, max(b, a), names, best))
        return sorted(out, key=lambda o: -o[3])

    def likeness(self, text: str) -> float:
        """Mean log-frequency of the characters and character pairs, on the scale of SCALE fields."""
        if len(text) <= SHORT:
            if text not in self.kept:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[text] = self._likeness(text)
            return self.kept[text]
        return self._likeness(text)

    def _likeness(self, text: str) -> float:
        if len(text) < 2:
            return -9.0
        codes, pairs = _characters(text)
        single = self.characters[codes]
        pair = np.minimum(self.pairs[pairs], np.minimum(single[:-1], single[1:]))  # keeps chance hits of the hash low
        return float(np.log(single + 0.5).mean() + np.log(pair + 0.5).mean())


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, None if it can't have come from it."""
    return _invert_short(text, chain) if len(text) <= SHORT else _invert(text, chain)


def _invert(text: str, chain: str) -> str | None:
    for written, read in reversed(CHAINS[chain]):
        for r in read:
            for w in written:
                try:
                    back = _decode(_encode(text, r), w, "strict")
                except (UnicodeError, KeyError):
                    continue
                break
            else:
                continue
            break
        else:
            return None
        text = back
    return text


#: Short stretches come back again and again (units, accents); what was computed for the last of them is kept.
SHORT, KEPT = 12, 1 << 16
_invert_short = lru_cache(KEPT)(_invert)


def _partly(text: str, chain: str) -> str:
    """What still decodes of a damaged stretch, the rest as replacement characters."""
    if chain in LOSSY:
        return text
    read = CHAINS[chain][-1][1][0]
    raw = bytearray()
    for c in text:
        try:
            raw += _encode(c, read)
        except (UnicodeError, KeyError):
            raw += b"\xff" if c == "�" else b""
    for written, _ in CHAINS[chain][-1:]:
        return bytes(raw).decode(written[0], "replace")


def _broken(text: str) -> bool:
    """Whether control, private or unassigned characters show that the text can't be meant."""
    return any(unicodedata.category(c) in ("Cc", "Co", "Cn") and c not in "\t\n\r" for c in text)


_GROW = sorted(((x, y) for x in range(-ENDS, ENDS + 1) for y in range(-ENDS, ENDS + 1)), key=lambda p: (abs(p[0]) + abs(p[1]), -p[0] - p[1]))


def _inverted(model: Model, text: str, a: int, b: int, chain: str) -> tuple[int, int, str, str, bool] | None:
    """The stretch, its ends moved as little as needed, if it decodes strictly into something more like the sample."""
    for left, right in _GROW:
        x, y = a - left, b + right
        if not 0 <= x < y <= len(text):
            continue
        if all(c in LOOKALIKES or c < "\x80" or c in "\xa0\xad" for c in text[x:y]):
            continue  # letters of another script among Latin ones, soft hyphens and spaces are problem 2
        back = invert(text[x:y], chain)
        if back is None or back == text[x:y] or "�" in back:
            continue
        u, v = max(x - 1, 0), min(y + 1, len(text))  # with a neighbour, so that a single character has pairs
        one = sum(c > "\x7f" for c in text[x:y]) == 1 and any("㐀" <= c <= "鿿" for c in text[x:y])
        if model.likeness(text[u:x] + back + text[y:v]) > model.likeness(text[u:v]) + (MARGIN_ONE if one else MARGIN):
            return x, y, back, chain, True
    return None


def repair(model: Model, text: str) -> tuple[str, str, bool] | None:
    """(restored text, chains, wholly restored), None if the text isn't garbled."""
    edits: list[tuple[int, int, str, str, bool]] = []
    for a, b, chains, score in model.stretches(text):
        if any(a < y and x < b for x, y, *_ in edits):
            continue
        found = None
        if "�" not in text[a:b]:
            found = next(filter(None, (_inverted(model, text, a, b, c) for c in chains if c in CHAINS)), None)
        if not found and ("�" in text[a:b] or score >= SURE and _broken(text[a:b])):
            found = (a, b, _partly(text[a:b], chains[0]), chains[0], False)
        if found:
            edits.append(found)
    if not edits:
        return None
    out, at = [], 0
    for a, b, back, _, _ in sorted(edits):
        if a < at:
            continue
        out += [text[at:a], back]
        at = b
    return "".join(out) + text[at:], ",".join(sorted({e[3] for e in edits})), all(e[4] for e in edits)


def fit(questions: DataFrame, sample_fields: int = SAMPLE_FIELDS) -> Model | None:
    """Fits the classifier on at most sample_fields fields, those whose identity hashes lowest; what a chain's inverse is
    judged by, the characters and their pairs, is counted over all fields."""
    fields = question_fields(questions)
    total = fields.where(F.length("text") > 0).count()
    texts = sampled_texts(fields, sample_fields, total)
    return Model(texts, hashed_counts(fields.select("text"), 0x10000 + PAIRS, usage_hashes, 1), total) if texts else None


def repaired_fields(questions: DataFrame, model: Model | None = None) -> DataFrame:
    """(row_id, field_no, text, restored, chains, whole) of the garbled fields."""
    model = model or fit(questions)
    fields = question_fields(questions)
    schema = "row_id bigint, field_no bigint, text string, restored string, chains string, whole boolean"
    if model is None:
        return fields.sparkSession.createDataFrame([], schema)
    shared = fields.sparkSession.sparkContext.broadcast(model)  # fixed size: classes times buckets

    def search(batches):
        m = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            rows = []
            for i in np.flatnonzero(m.suspicious(texts)) if texts else ():
                if r := repair(m, texts[i]):
                    rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), texts[i], *r))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["row_id", "field_no", "text", "restored", "chains", "whole"])

    return fields.mapInArrow(search, schema)
