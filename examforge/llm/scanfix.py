"""Noise in text from scanned pages (problem 5).

Lines are labelled by a linear-chain conditional model: HEADER (running header, footer, page number), BODY (a line that ends where
the text ends or a listed statement begins) and BREAK (a line cut off within the running text). It looks at layout
features: how the line begins and ends, what the next one begins with, its length, its share of digits, how much its
character pairs look like page furniture, how usual the text across the line end is, and some of these in pairs. The
weights of features, starts and transitions are an averaged structured perceptron's, trained on a bounded sample of the
table's fields with line breaks and furniture put in synthetically; the best sequence of labels (Viterbi) decides, and
no rule overrides it. Headers are dropped and broken lines joined (hyphens
at the cut removed) to give continuous paragraphs.

Misread and stray characters are a noisy channel on top: a table of confusions proposes what a rare spot may have been,
and character trigrams counted over all fields (hashed, digits masked) tell whether that is far more usual.

Defined cases: null fields are no cases, empty ones have no noise; white space and line ends at the ends of a field
don't count; fields of problems 1 and 2 are left to those operators. Repeated rows are judged one by one. If the table
is empty nothing is found.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examforge.llm import confusables, mojibake
from examforge.llm.common import chunks, codepoints, hashed_counts, question_fields, sampled_texts
from examforge.session import checkpointed, small

TRIGRAMS = 1 << 21
SAMPLE_FIELDS = 12_000
#: Banks whose names give the words of synthetic page furniture.
SAMPLE_BANKS = 1_000
HEADER, BODY, BREAK = range(3)
PAIRS = 1 << 14
#: Mean log-odds of its character pairs from which a line is passed over as furniture when looking for the next one.
FURNISHED = 1.0
#: Mean gain in log-frequency at which a spot counts as misread; names of one language differ by single letters, so a
#: letter read as another letter must gain more.
GAIN, LETTER_GAIN = 2.4, 3.3

#: What a scanner's reading may stand for: misread -> meant (fixed values).
CONFUSIONS: dict[str, tuple[str, ...]] = {
    "氷": ("水",), "埋": ("理",), "撿": ("檢",), "東": ("車",), "衍": ("行",), "汕": ("油",), "曰": ("日",), "稒": ("種",),
    "沒": ("設",), "菅": ("管",), "笛": ("苗",), "潅": ("灌",), "景": ("量",), "訃": ("登", "記", "計", "訓"), "汨": ("池", "泊"),
    "閛": ("閘", "開", "關"), "士": ("土",), "土": ("士",), "溋": ("溫",), "跲": ("路",), "僑": ("橋",), "兀": ("公", "充", "元"),
    "秀": ("移",), "耜": ("租", "組"), "瀳": ("薦",), "日寺": ("時",), "曰寺": ("時",), "木": ("本",), "本": ("木",), "末": ("未",), "未": ("末",),
    "己": ("已",), "已": ("己",), "人": ("入",), "入": ("人",), "大": ("太", "犬"), "太": ("大",), "千": ("干",), "干": ("千",),
    "目": ("自", "日"), "自": ("目",), "日": ("目", "曰"), "白": ("自",), "牛": ("午",), "午": ("牛",), "冉": ("再",), "侯": ("候",),
    "候": ("侯",), "斤": ("斥",), "斥": ("斤",), "戍": ("戌",), "析": ("折",), "折": ("析",), "微": ("徵",), "徵": ("微",),
    "巿": ("市",), "力": ("刀",), "刀": ("力",), "右": ("石",), "石": ("右",), "囗": ("口",), "口": ("日",), "工": ("土",),
    "田": ("由", "甲"), "由": ("田",), "申": ("甲", "由"), "甲": ("申",), "令": ("今",), "今": ("令",), "免": ("兔",), "兔": ("免",),
    "拆": ("折", "析"), "壞": ("壤",), "壤": ("壞",), "藉": ("籍",), "籍": ("藉",), "拔": ("撥",), "儀": ("議",), "議": ("儀",),
    "O": ("0", "o"), "o": ("0",), "l": ("1", "i"), "I": ("1", "l"), "i": ("l",), "Z": ("2",), "z": ("2",), "S": ("5", "s"), "b": ("6",), "B": ("8",),
    "g": ("9", "q"), "q": ("9", "g"), "0": ("o", "O"), "1": ("l", "i", "I"), "5": ("s", "S"), "6": ("b",), "8": ("B",), "2": ("z", "Z"),
    "9": ("g",), "c": ("e", "o"), "e": ("c",), "vv": ("w",), "VV": ("W",), "rn": ("m",), "m": ("rn",), "li": ("h",), "h": ("b", "li"), "cl": ("d",), "d": ("cl",), "ii": ("u", "n"),
    "n": ("u", "ri"), "u": ("n",), "f": ("t",), "t": ("f",), "a": ("o",),
}
#: Signs that scanners add (fixed values).
STRAY = "_~|¦·^`¨´•"
#: Forms of page furniture (fixed values); n: number, s: subject, g: group.
FURNITURE = (
    "- {n} -", "－ {n} －", "{n}", "第 {n} 頁", "第 {n} 頁，共 {m} 頁", "第{n}頁/共{m}頁", "Page {n}", "Page {n} of {m}", "{n} / {m}",
    "【請接續背面】", "【請翻頁繼續作答】", "背面尚有試題", "代號：{c}　頁次：{n}", "代號：{c}", "頁次：{n}", "科目：{s}", "{y} 年度{g}甄試試題",
    "{y}年度{g}試題", "{y}-{k} {s}　{n}", "{y}-{k} {s}",
)

_MARKER = re.compile(r"[\s「」『』（）()？！。，、]*(?:[甲乙丙丁戊己庚辛壬癸]|[一二三四五六七八九十]{1,2}|[(（]?[A-Ha-h1-9①-⑨][)）]?)\s*[、，,．.。:：)）](?!\d)")
_HYPHENS = "-¬‐­"
_FINAL = "。？！?!：:"


def _masked(texts: list[str]) -> np.ndarray:
    """Code points with digits as 0, no white space, and a sign between the texts."""
    cps, _ = codepoints(["".join(t.split()) + "\x01" for t in texts])
    return np.where((cps >= 48) & (cps < 58), np.uint32(48), cps)


def _trigrams(cps: np.ndarray) -> np.ndarray:
    h = (cps[:-2] * np.uint32(0x9E3779B1)) ^ (cps[1:-1] * np.uint32(0x85EBCA77)) ^ (cps[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h ^ h >> np.uint32(13)) & np.uint32(TRIGRAMS - 1)


def trigram_hashes(texts: list[str]) -> np.ndarray:
    return _trigrams(_masked(["\x01", *texts]))


class Usage:
    """Log-frequencies of masked trigrams, scaled down to the counts of 100,000 fields. Tables with fewer fields aren't
    scaled up: a count of one is no sign of a usual spot, however small the table."""

    def __init__(self, counts: np.ndarray, fields: int):
        self.logs = np.log(counts / max(1.0, fields / 100_000) + 0.3).astype(np.float32)

    def of(self, cps: np.ndarray) -> np.ndarray:
        return self.logs[_trigrams(cps)] if len(cps) > 2 else np.zeros(0, np.float32)


#: A spot is looked at where a trigram's log-frequency is below this.
RARE = np.log(60.0)


def spots(cps: np.ndarray, usage: Usage) -> np.ndarray:
    """Places of masked code points that may be misread or stray and lie in a rare trigram."""
    if len(cps) < 3:
        return np.zeros(0, np.int64)
    rare = np.append(usage.of(cps) <= RARE, [False, False])
    near = rare.copy()
    near[1:] |= rare[:-1]
    near[2:] |= rare[:-2]
    return np.flatnonzero(near & _confusable()[np.minimum(cps, 0xFFFF)])


@lru_cache(maxsize=1)
def _confusable() -> np.ndarray:
    t = np.zeros(0x10000, bool)
    t[[ord(c[0]) for c in CONFUSIONS] + [ord(c) for c in STRAY]] = True
    t[48] = True
    return t


def misreadings(text: str, usage: Usage) -> tuple[str, int]:
    """The text with misread and stray characters corrected, and their number."""
    keep = [i for i, c in enumerate(text) if not c.isspace()]
    chars = ["\x01", *(text[i] for i in keep), "\x01"]
    found = []
    past = 0
    for i in spots(_codes(chars), usage).tolist():
        if i < max(past, 1) or i >= len(chars) - 1:
            continue
        c = chars[i]
        options = [(2, x) for x in CONFUSIONS.get(c + chars[i + 1], ())] + [(1, x) for x in CONFUSIONS.get(c, ())] + ([(1, "")] if c in STRAY else [])
        left, best = chars[max(0, i - 2) : i], None
        for width, meant in options:
            right = chars[i + width : i + width + 2]
            if not right or meant == "" and left[-1] == right[0] == "\x01":
                continue
            is_now, was = usage.of(_codes(left + chars[i : i + width] + right)), usage.of(_codes([*left, *meant, *right]))
            if not len(is_now) or not len(was) or is_now.min() > RARE:
                continue
            gain = float(was.mean() - is_now.mean())
            letters = meant.isascii() and meant.isalpha() and "".join(chars[i : i + width]).isalpha()
            if letters and any(x.isdigit() for x in chars[i + width : i + width + 4]):
                continue  # letters of a code stand for themselves
            if gain > (LETTER_GAIN if letters else GAIN) and (best is None or gain > best[0]):
                best = (gain, width, meant)
        if best:
            _, width, meant = best
            found.append((i - 1, width, meant))
            chars[i : i + width] = [meant] + [""] * (width - 1)  # later spots see the correction
            past = i + width
    if not found:
        return text, 0
    out = list(text)
    for at, width, meant in found:
        for k in range(width):
            out[keep[at + k]] = meant if k == 0 else ""
    return "".join(out), len(found)


@lru_cache(maxsize=1)
def _options() -> tuple[np.ndarray, ...]:
    """What the channel proposes, sorted by first character: it, the second one or 0, width, what is meant (two columns),
    its length."""
    rows = []
    for source, meanings in [*CONFUSIONS.items(), *((c, ("",)) for c in STRAY)]:
        for m in meanings:
            x, y = [*map(ord, source), 0][:2], [*map(ord, m), 0, 0][:2]
            rows.append((*x, len(source), *(48 if 48 <= c < 58 else c for c in y), len(m)))
    rows.sort()
    return tuple(np.array(rows, np.int64).T)


def _context_logs(usage: Usage, left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, number and least of the log-frequencies of the trigrams of two characters, the middle and two characters; those
    that reach over a text's end don't count."""
    line = np.concatenate((left, middle, right), axis=1).astype(np.uint32)
    logs = np.stack([usage.logs[_trigrams(line[:, k : k + 3].T).T[:, 0]] for k in range(line.shape[1] - 2)], axis=1)
    ok = np.ones(logs.shape, bool)
    ok[:, 0] = left[:, 1] != 1
    ok[:, -1] &= right[:, 0] != 1
    return np.where(ok, logs, 0).sum(axis=1), ok.sum(axis=1), np.where(ok, logs, np.inf).min(axis=1)


def likely_misread(raw: np.ndarray, usage: Usage) -> np.ndarray:
    """Places in the joined texts at which some proposal gains enough, all of them at once: every spot that `misreadings`
    would correct first in a text is among them, so texts without any need not be gone through."""
    masked = np.where((raw >= 48) & (raw < 58), np.uint32(48), raw)
    at = spots(masked, usage)
    at = at[(at > 1) & (at < len(raw) - 3)]
    first, second, width, m0, m1, length = _options()
    lo, hi = np.searchsorted(first, raw[at], "left"), np.searchsorted(first, raw[at], "right")
    n = hi - lo
    at = np.repeat(at, n)
    option = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    fits = (width[option] == 1) | (raw[at + 1] == second[option])
    at, option = at[fits], option[fits]
    out = []
    for w in (1, 2):
        for k in (0, 1, 2):
            pick = (width[option] == w) & (length[option] == k)
            i, o = at[pick], option[pick]
            if not len(i):
                continue
            i, o = i[i + w + 1 < len(raw)], o[i + w + 1 < len(raw)]
            left, right = np.stack((masked[i - 2], masked[i - 1]), 1), np.stack((masked[i + w], masked[i + w + 1]), 1)
            is_now, n_now, least = _context_logs(usage, left, np.stack([masked[i + x] for x in range(w)], 1), right)
            was, n_was, _ = _context_logs(usage, left, np.stack((m0[o], m1[o]), 1)[:, :k], right)
            ok = (n_now > 0) & (n_was > 0) & (least <= RARE)
            gain = np.where(ok, was / np.maximum(n_was, 1) - is_now / np.maximum(n_now, 1), -1)
            out.append(i[gain > GAIN - 1e-3])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _codes(chars: list[str]) -> np.ndarray:
    cps = np.array([ord(x) for c in chars for x in c], np.uint32)
    return np.where((cps >= 48) & (cps < 58), np.uint32(48), cps)


def _pairs(line: str) -> np.ndarray:
    cps = np.frombuffer(("\x02" + "".join(line.split()) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = np.where((cps >= 48) & (cps < 58), np.uint32(48), cps)
    h = cps[:-1] * np.uint32(0x9E3779B1) ^ cps[1:] * np.uint32(0x85EBCA77)
    return (h ^ h >> np.uint32(16)) & np.uint32(PAIRS - 1)


class Lines:
    """The line model: weights of a linear chain over HEADER, BODY and BREAK."""

    #: Values of the features, and the features that are looked at in pairs as well.
    SIZES = (2, 4, 8, 4, 6, 6, 8, 8, 8)
    TOGETHER = ((1, 2), (1, 6), (7, 4), (7, 5), (4, 5), (0, 1), (7, 6), (8, 7), (8, 5))
    #: Between the bins of a line's furniture score.
    SCORES = (-12.0, -6.0, -2.0, 2.0, 6.0, 12.0, 20.0)
    ROUNDS = 4

    def __init__(self, texts: list[str], banks: list[str], usage: Usage, seed: int = 5):
        self.usage = usage
        made = spoiled(texts, banks, seed)
        # furniture or text, by character pairs
        counts = np.full((2, PAIRS), 0.2)
        for lines, labels in made:
            for line, label in zip(lines, labels):
                np.add.at(counts[int(label == HEADER)], _pairs(line), 1)
        logs = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.furniture = np.clip(logs[1] - logs[0], -6, 6).astype(np.float32)
        sizes = [*self.SIZES, *(self.SIZES[x] * self.SIZES[y] for x, y in self.TOGETHER)]
        self.offsets = np.cumsum([0, *sizes[:-1]])
        self.weights, self.start, self.step = np.zeros((sum(sizes), 3)), np.zeros(3), np.zeros((3, 3))
        self._train([(self.places(lines), np.array(labels)) for lines, labels in made if len(lines) > 1], seed)

    def _train(self, rows: list[tuple[np.ndarray, np.ndarray]], seed: int) -> None:
        """Averaged perceptron: weights move from the sequence that wins to the right one; the mean of all states is kept."""
        r = np.random.default_rng(seed)
        state = (self.weights, self.start, self.step)
        late = [np.zeros_like(x) for x in state]  # updates weighted by when they came
        t = 1
        for _ in range(self.ROUNDS):
            for i in r.permutation(len(rows)):
                at, right = rows[i]
                if not np.array_equal(got := np.array(self._best(at)), right):
                    for labels, by in ((right, 1.0), (got, -1.0)):
                        for table, scale in ((state, by), (late, by * t)):
                            np.add.at(table[0], (at, labels[:, None]), scale)
                            table[1][labels[0]] += scale
                            np.add.at(table[2], (labels[:-1], labels[1:]), scale)
                t += 1
        for x, y in zip(state, late):
            x -= y / t

    def places(self, lines: list[str]) -> np.ndarray:
        """For each line the rows of the weights that its features and pairs of features pick."""
        f = self.features(lines)
        pairs = [f[:, x] * self.SIZES[y] + f[:, y] for x, y in self.TOGETHER]
        return np.concatenate((f, np.stack(pairs, axis=1)), axis=1) + self.offsets

    def features(self, lines: list[str]) -> np.ndarray:
        """A row of features for each line; everything that looks at a single line is computed once."""
        pairs = [_pairs(x) for x in lines]
        ends = np.cumsum([len(p) for p in pairs])
        score = np.add.reduceat(self.furniture[np.concatenate(pairs)], np.append(0, ends[:-1]))
        furnished = score / np.diff(np.append(0, ends)) >= FURNISHED
        bare = [x.strip() for x in lines]
        dense = ["".join(x.split()) for x in bare]
        marker = [int(bool(_MARKER.match(x))) for x in lines]
        out = np.zeros((len(lines), len(self.SIZES)), np.int64)
        out[:, 7] = np.searchsorted(self.SCORES, score)
        after = None  # the next line that doesn't read like furniture
        across: dict[int, list[str]] = {}
        without: dict[int, list[str]] = {}  # the line before and the line after, if this one were left out
        for k in range(len(lines) - 1, -1, -1):
            line, b, d = lines[k], bare[k], dense[k]
            end = 0 if not b else 1 if b[-1] in _FINAL else 2 if b[-1] in "，、,；;" else 3 if b[-1] in _HYPHENS else 4 if b[-1].isdigit() else 5 if b[-1] in "）)】」" else 6 if line[-1:].isspace() else 7
            follows = 0 if after is None else 1 if marker[after] else 2 if lines[after][:1].isspace() else 3
            digits = sum(c.isdigit() or c in "OlZSb" for c in d) / max(len(d), 1)
            out[k, :7] = marker[k], follows, end, min(3, int(b == "") + 2 * int(line[:1].isspace())), np.searchsorted((3, 6, 10, 16, 30), len(d)), np.searchsorted((0.01, 0.1, 0.3, 0.5, 0.8), digits), 7
            if after is not None and d:
                across[k] = ["\x01", *d[-2:], *dense[after][:2]][-4:]
                before = next((x for x in range(k - 1, -1, -1) if dense[x] and not furnished[x]), None)
                if before is not None:
                    without[k] = ["\x01", *dense[before][-2:], *dense[after][:2]][-4:]
                    without[~k] = ["\x01", *dense[before][-2:], *d[:2]][-4:]
            if b and not furnished[k]:
                after = k
        usual = lambda joined: float(logs.mean()) if len(logs := self.usage.of(_codes(joined))) else 0.0
        for k, joined in across.items():
            out[k, 6] = int(np.clip(usual(joined) + 1.2, 0, 6.9))
            out[k, 8] = int(np.clip((usual(without[k]) - usual(without[~k])) / 1.5 + 4, 1, 7.9)) if k in without else 0
        return out

    def labels(self, lines: list[str]) -> list[int]:
        """The best sequence of labels."""
        return self._best(self.places(lines))

    def _best(self, places: np.ndarray) -> list[int]:
        own = self.weights[places].sum(axis=1).tolist()
        step = self.step.tolist()
        score, back = [s + o for s, o in zip(self.start.tolist(), own[0])], []
        for row in own[1:]:
            came = [max(range(3), key=lambda x: score[x] + step[x][y]) for y in range(3)]  # noqa: B023
            score = [score[x] + step[x][y] + row[y] for y, x in enumerate(came)]
            back.append(came)
        out = [max(range(3), key=score.__getitem__)]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]


_ENDS = (" ", "  ", "」", " ！", "、")


def spoiled(texts: list[str], banks: list[str], seed: int) -> list[tuple[list[str], list[int]]]:
    """Lines and labels of the texts that are whole (one line, or statements listed on lines of their own), three in five
    of them broken and furnished."""
    r = np.random.default_rng(seed)
    whole = [t.strip() for t in texts]
    whole = [t for t in whole if len(t) > 3 and all(_MARKER.match(x) for x in t.split("\n")[1:])]
    parts = sorted({p for b in banks for p in b.rsplit("/", 1)[-1].rsplit(".", 1)[0].split("-") if len(p) > 1 and not p.isdigit()}) or ["科目"]
    out = []
    for t in whole:
        lines, labels = _spoil(t, r, parts) if r.random() < 0.6 else (t.split("\n"), [BODY] * (t.count("\n") + 1))
        # stray blanks and signs at the ends of lines are no sign of a break
        out.append(([x + _ENDS[r.integers(len(_ENDS))] if k == BODY and r.random() < 0.1 else x for x, k in zip(lines, labels)], labels))
    return out


_NOISY = {"0": "O", "1": "l", "5": "S", "2": "Z", "6": "b"}


def _furniture(r, parts: list[str]) -> str:
    form = FURNITURE[r.integers(len(FURNITURE))]
    pick = lambda: parts[r.integers(len(parts))]
    line = form.format(n=r.integers(1, 60), m=r.integers(5, 60), c=r.integers(1000, 10000), y=r.integers(90, 115), k=r.integers(1, 6), s=pick(), g=pick())
    if r.random() < 0.2:
        line = "".join(_NOISY.get(c, c) if r.random() < 0.3 else c for c in line)
    return ("　" if r.random() < 0.15 else "") + line


def _spoil(text: str, r, parts: list[str]) -> tuple[list[str], list[int]]:
    """Breaks the text's lines and puts furniture between them; the lines and their labels."""
    lines, labels = [], []
    for line in text.split("\n"):
        n = min(int(r.integers(0, 4)), max(len(line) // 4, 0))
        cuts = sorted(r.choice(np.arange(1, len(line)), n, replace=False)) if n and len(line) > 4 else []
        at = 0
        for c in [*cuts, len(line)]:
            piece = line[at:c]
            if c < len(line):
                kind = r.random()
                inword = piece[-1:].isascii() and piece[-1:].isalpha() and line[c : c + 1].isalpha()
                piece += _HYPHENS[r.integers(3)] if inword and kind < 0.8 else " " if kind < 0.3 else ""
            if at and r.random() < 0.15:
                piece = "　" + piece
            lines.append(piece)
            labels.append(BREAK if c < len(line) else BODY)
            at = c
            if c < len(line) and r.random() < 0.15:
                lines.append("")
                labels.append(BREAK)
            if r.random() < 0.3:
                lines.append(_furniture(r, parts))
                labels.append(HEADER)
    if r.random() < 0.25:
        lines.insert(0, _furniture(r, parts))
        labels.insert(0, HEADER)
    return lines, labels


class Scanner:
    def __init__(self, lines: Lines | None, usage: Usage):
        self.lines, self.usage = lines, usage

    def suspects(self, texts: list[str]) -> list[int]:
        """Numbers of the texts with several lines or with a spot that is likely misread."""
        out = {i for i, t in enumerate(texts) if "\n" in t or "\r" in t or "\x01" in t}
        plain = [i for i in range(len(texts)) if i not in out]
        for a, b in chunks([texts[i] for i in plain]):
            part = ["".join(texts[i].split()) for i in plain[a:b]]
            raw, starts = codepoints(["\x01", *(t + "\x01" for t in part)])
            hits = np.searchsorted(starts, likely_misread(raw, self.usage), "right") - 2
            out.update(plain[a + k] for k in np.unique(hits).tolist())
        return sorted(out)

    def repair(self, text: str) -> tuple[str, str] | None:
        """(repaired text, kinds of noise), None if there is none."""
        kinds = set()
        bare = text.strip()
        rows = bare.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if len(rows) > 1:
            labels = self.lines.labels(rows)
            out, joins = "", False
            for line, label in zip(rows, labels):
                if label == HEADER:
                    kinds.add("furniture")
                    continue
                piece = line.strip() if joins or label == BREAK else line
                if joins:
                    out = _joined(out, line.strip())
                else:
                    out += ("\n" if out else "") + piece
                joins = label == BREAK
                if joins:
                    kinds.add("break")
        else:
            out = bare
        fixed, n = misreadings(out, self.usage)
        if n:
            kinds.add("misread")
        return (fixed, ",".join(sorted(kinds))) if kinds else None


def _joined(a: str, b: str) -> str:
    a = a.rstrip()
    if not a or not b:
        return a + b
    if a[-1] in _HYPHENS and len(a) > 1 and a[-2].isalpha():
        return a[:-1] + b
    return a + (" " if a[-1].isascii() and b[0].isascii() and (a[-1].isalnum() or a[-1] in ",.;:") and b[0].isalnum() else "") + b


def fit(questions: DataFrame, sample_fields: int = SAMPLE_FIELDS, sample_banks: int = SAMPLE_BANKS) -> Scanner:
    """Counts trigrams over all fields, and the line model on at most sample_fields fields and the names of at most
    sample_banks banks, those that hash lowest."""
    fields = question_fields(questions)
    counts = hashed_counts(fields.select("text"), TRIGRAMS, trigram_hashes)
    total = fields.count()
    usage = Usage(counts, total)
    texts = sampled_texts(fields, sample_fields, total)
    banks = [r[0] for r in questions.where(F.col("bank").isNotNull()).groupBy("bank").count().orderBy(F.xxhash64("bank")).limit(sample_banks).select("bank").toLocalIterator()]
    return Scanner(Lines(texts, banks, usage) if texts else None, usage)


_FOUND = "row_id bigint, field_no bigint, text string, repaired string, kinds string"


def repaired_fields(questions: DataFrame, scanner: Scanner | None = None, model: mojibake.Model | None = None) -> DataFrame:
    """(row_id, field_no, text, repaired, kinds) of the fields with scanning noise, those of problems 1 and 2 left out.

    Only the fields found are given to the operators of problems 1 and 2.
    """
    scanner = scanner or fit(questions)
    model = model or mojibake.fit(questions)
    fields = question_fields(questions)
    shared = fields.sparkSession.sparkContext.broadcast((scanner, model))  # tables of fixed size

    def search(batches):
        s, m = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            rows = []
            for i in s.suspects(texts):
                text = texts[i]
                if not text.strip() or not (r := s.repair(text)) or m and mojibake.repair(m, text):
                    continue
                rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), text, *r))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["row_id", "field_no", "text", "repaired", "kinds"])

    found = checkpointed(fields.mapInArrow(search, _FOUND))
    other = confusables.normalized(found.select("row_id", "field_no", "text"), fields, model).select("row_id", "field_no")
    return found.join(other, ["row_id", "field_no"], "left_anti").select("row_id", "field_no", "text", "repaired", "kinds")
