"""Visually identical text with different characters (problem 2).

One consistent form: full-width letters and digits become ASCII, ideographs of the compatibility and radical blocks the
unified ones, no-break and fixed-width spaces plain spaces; invisible formatting characters go; letters with combining
marks are composed. Micro and ohm signs have no look-alike and stay.

Cyrillic and Greek letters are repaired by script: a token is a run of Latin, Greek and Cyrillic letters, its dominant
script the one that most of its letters have (Latin in a tie). Look-alikes are replaced, and count as cases, only

* in a token that mixes scripts with Latin dominant, if the result exists in the corpus vocabulary: as a word, or, for
  names and codes that occur once, by all its four-letter pieces;
* in a token that mixes scripts with another one dominant, if every letter of that script is a look-alike (so nothing
  shows that it is meant) and the result exists as a word;
* in a token of nothing but look-alike capitals, at least two, in front of `-` and a digit (a code of equipment), if the
  result exists as a word. Any other token of one script is left alone: Greek letters in formulas, Russian words.

Words and pieces exist if they occur at least LEAST times in all fields. Only those are asked for that some odd token
would become; they meet the counts of the corpus in a join, so nothing grows in the driver or in a broadcast.

Defined cases: null fields are no cases and stay null; empty ones stay empty. A field that only loses characters may
become empty. Repeated rows are normalized one by one. Fields that are garbled (problem 1) are left to that operator.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examforge.llm import mojibake
from examforge.llm.common import LOOKALIKES, N_CODEPOINTS, codepoints, hot_join, question_fields
from examforge.session import checkpointed, small

#: Occurrences in the corpus from which a word or a piece exists.
LEAST = 2

#: Invisible characters that aren't in category Cf (fixed values).
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_SPACES = {0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F}
_TOKEN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ]+")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
_CODE = re.compile(r"-\d")
#: Letters of a piece.
PIECE = 4

PLAIN, FULL_WIDTH, IDEOGRAPH, INVISIBLE, SPACE, MARK, LOOKALIKE = range(7)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, dict[int, str]]:
    """Kind of each code point, and what the characters of fixed meaning become."""
    kind, becomes = np.zeros(N_CODEPOINTS, np.uint8), {}
    for cp in range(N_CODEPOINTS):
        if 0xD800 <= cp < 0xF900 or 0x323B0 <= cp < 0xE0000:
            continue
        c = chr(cp)
        if 0xFF10 <= cp <= 0xFF19 or 0xFF21 <= cp <= 0xFF3A or 0xFF41 <= cp <= 0xFF5A:
            kind[cp], becomes[cp] = FULL_WIDTH, chr(cp - 0xFEE0)
        elif 0x2E80 <= cp <= 0x2FD5 or 0xF900 <= cp <= 0xFAFF or 0x2F800 <= cp <= 0x2FA1F:
            unified = unicodedata.normalize("NFKC", c)
            if unified != c or cp < 0x2F00 and unicodedata.category(c) == "So":
                kind[cp], becomes[cp] = IDEOGRAPH, unified
        elif unicodedata.category(c) == "Cf" or cp in _INVISIBLE:
            kind[cp], becomes[cp] = INVISIBLE, ""
        elif cp in _SPACES:
            kind[cp], becomes[cp] = SPACE, " "
        elif unicodedata.category(c)[0] == "M":
            kind[cp] = MARK
        elif c in LOOKALIKES:
            kind[cp] = LOOKALIKE
    return kind, becomes


def _pieces(token: str) -> list[str]:
    return ["#" + token[i : i + PIECE] for i in range(len(token) - PIECE + 1)]


class Vocabulary(frozenset):
    """Lower-case words, and pieces of words behind a #."""

    def holds(self, token: str, whole: bool) -> bool:
        token = token.lower()
        pieces = _pieces(token)
        return token in self or not whole and bool(pieces) and all(p in self for p in pieces)


def _script(c: str) -> str:
    return "latin" if _LATIN.fullmatch(c) else "greek" if "\u0370" <= c <= "\u03ff" else "cyrillic"


def latin_form(token: str, after: str) -> tuple[str, bool] | None:
    """(the token with Latin letters for its look-alikes, whether that must exist as a whole word), None if it stays."""
    scripts = [_script(c) for c in token]
    result = "".join(LOOKALIKES.get(c, c) for c in token)
    if result == token or not _LATIN.fullmatch(result):
        return None  # no look-alike, or a letter that only another script has
    if "latin" in scripts:
        dominant = max(("latin", "greek", "cyrillic"), key=scripts.count)  # the first of equals
        return result, dominant != "latin"
    return (result, True) if len(token) > 1 and token.isupper() and _CODE.match(after) else None


def normalize(text: str, known: Vocabulary) -> tuple[str, str]:
    """(consistent form, kinds of what was odd, comma-separated)."""
    out, kinds = _folded(text)

    def repaired(m: re.Match) -> str:
        form = latin_form(m[0], out[m.end() : m.end() + 2])
        if not form or not known.holds(*form):
            return m[0]
        kinds.add("lookalike")
        return form[0]

    return _TOKEN.sub(repaired, out), ",".join(sorted(kinds))


def _folded(text: str) -> tuple[str, set[str]]:
    """Everything but look-alikes in its consistent form, and what was odd."""
    kind, becomes = tables()
    kinds = set()
    marks = False
    for i, c in enumerate(text):
        k = kind[ord(c)]
        if k == MARK:
            marks |= i > 0 and unicodedata.category(text[i - 1])[0] in "LM"
        elif k in (FULL_WIDTH, IDEOGRAPH, INVISIBLE, SPACE):
            kinds.add(("", "full_width", "ideograph", "invisible", "space")[k])
    out = text.translate(becomes)
    if marks:
        kinds.add("combining")
        out = re.sub(r"\w[̀-ͯ᪰-᫿᷀-᷿⃐-⃿゙゚]+", lambda m: unicodedata.normalize("NFC", m[0]), out)
    return out, kinds


def asked(text: str) -> list[str]:
    """The words and pieces that must exist for the field's odd tokens to be replaced."""
    out = _folded(text)[0]
    words = set()
    for m in _TOKEN.finditer(out):
        if form := latin_form(m[0], out[m.end() : m.end() + 2]):
            word = form[0].lower()
            words.update((word,) if form[1] else (word, *_pieces(word)))
    return sorted(words)


def odd_fields(texts: list[str]) -> np.ndarray:
    """Numbers of the texts with any character that might be a case."""
    if not texts:
        return np.zeros(0, np.int64)
    cps, starts = codepoints(texts)
    return np.unique(np.searchsorted(starts, np.flatnonzero(tables()[0][cps]), "right") - 1)


def corpus_counts(fields: DataFrame) -> DataFrame:
    """(word, n): how often each Latin word, and behind a # each piece of words, occurs in all fields."""
    words = fields.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LATIN.pattern), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = F.length("word") - PIECE + 1
    pieces = words.where(n > 0).select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("#"), F.substring("word", i, F.lit(PIECE))))).alias("word"), "n")
    return words.unionByName(pieces.groupBy("word").agg(F.sum("n").alias("n")))


_ODD = "row_id bigint, field_no bigint, text string, asked array<string>"


def normalized(fields: DataFrame, corpus: DataFrame, model: mojibake.Model | None) -> DataFrame:
    """(row_id, field_no, text, normalized, kinds) of those of the fields that hold cases; corpus: all fields."""

    shared = fields.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def search(batches):
        m = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            at = np.array([i for i in odd_fields(texts) if not (m and mojibake.repair(m, texts[i]))], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([texts[i] for i in at], pa.string()), pa.array([asked(texts[i]) for i in at], pa.list_(pa.string()))],
                names=["row_id", "field_no", "text", "asked"],
            )

    odd = checkpointed(fields.mapInArrow(search, _ODD))
    wanted = odd.select("row_id", "field_no", F.explode("asked").alias("word"))
    words = wanted.select("word").distinct()
    exist = checkpointed(corpus_counts(corpus).where(F.col("n") >= LEAST).join(small(words), "word", "left_semi").select("word"))
    known = hot_join(wanted, exist, "word", "row_id").groupBy("row_id", "field_no").agg(F.collect_set("word").alias("known"))
    odd = odd.drop("asked").join(known, ["row_id", "field_no"], "left")

    def bring(batches):
        for b in batches:
            rows = []
            for row_id, field_no, text, words in zip(*(b.column(i).to_pylist() for i in range(4))):
                form, kinds = normalize(text, Vocabulary(words or ()))
                if kinds:
                    rows.append((row_id, field_no, text, form, kinds))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["row_id", "field_no", "text", "normalized", "kinds"])

    return odd.mapInArrow(bring, "row_id bigint, field_no bigint, text string, normalized string, kinds string")


def normalized_fields(questions: DataFrame, model: mojibake.Model | None = None) -> DataFrame:
    """(row_id, field_no, text, normalized, kinds) of the fields that changed or hold cases, garbled ones left out."""
    fields = question_fields(questions)
    return normalized(fields, fields, model or mojibake.fit(questions))
