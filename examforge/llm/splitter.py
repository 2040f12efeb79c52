"""Splitting oversized texts at natural boundaries (problem 8).

The ends of a text's tokens, in bytes, are prefix sums of the token widths. Boundaries (before an article, before a
numbered question, after a paragraph, after a sentence) are found as byte offsets and turned into token numbers, one
sorted array for each level. A piece that starts at token s may end at s + max_tokens; the last boundary up to there is
found by binary search, level by level from the strongest, as long as the piece keeps at least MIN_FILL of its size
(the strongest such boundary wins); without any the piece is cut hard at the last whole character. The next piece
starts overlap_tokens tokens before the end of the last one (a few more where a token ends within a character).

A piece may tokenize to more tokens on its own than as a part of its text, so every piece is counted again, and its end
is moved to the next earlier cut until it keeps the limit.

Defined cases: null texts and texts without a limit for their source (or a limit below 1) are not split and give no
pieces; a negative or null overlap counts as 0, an overlap of half the limit or more as just under half of it, so that
every piece moves on; where there is no room for it, some of the overlap is given up. The column overlap_tokens says
how many tokens a piece really shares with the one before it, so a smaller overlap than asked for shows. Of several
limits of a source the smallest holds, with the largest overlap given for it. A character of more tokens than the limit
stays whole. Empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examforge.llm.tokens import count_tokens, token_ends
from examforge.session import small

MIN_FILL = 0.5
#: Natural boundaries from strong to weak; a cut lies at the start of a match.
BOUNDARIES = tuple(map(re.compile, (
    r"(?m)^(?=[ \t　]*(?:第\s*[0-9０-９一二三四五六七八九十百零〇]+\s*[條条章節编編]|Article\s+\d+|Section\s+\d+|單元\s*\d+|【))",
    r"(?m)^(?=[ \t　]*(?:\d{1,4}\s*[.、．]|[一二三四五六七八九十]+、|Q\d+|問題?\s*\d+|Question\s+\d+))",
    r"(?<=\n)(?=[^\n])",
    r"(?<=[。！？!?；;])(?=[^。！？!?；;」』）)\n])|(?<=[.!?] )(?=\S)",
)))


def split(text: str, max_tokens: int, overlap_tokens: int, tokenizer: str | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, n_tokens, overlap) of each piece, in characters and tokens; a single piece if the text keeps the limit."""
    raw = text.encode("utf-8")
    ends = token_ends(text, tokenizer)
    if len(ends) <= max_tokens:
        return [(0, len(text), len(ends), 0)]
    overlap = min(max(overlap_tokens or 0, 0), (max_tokens - 1) // 2)
    tops = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # the first byte of each character
    chars = np.flatnonzero(np.append(tops, True))  # character -> byte offset
    at = np.concatenate(([0], ends))  # token number -> byte offset
    whole = np.flatnonzero(np.append(tops, True)[at])  # token numbers where a character starts
    levels = []
    for pattern in BOUNDARIES:
        offsets = chars[np.fromiter((m.start() for m in pattern.finditer(text)), np.int64)]
        tokens = np.searchsorted(at, offsets)
        levels.append(np.unique(tokens[at[tokens] == offsets]))
    after = lambda k: int(whole[np.searchsorted(whole, k, "right")])  # noqa: E731 - the next character's token
    pieces, start, last = [], 0, 0
    while True:
        limit = start + max_tokens
        while True:
            end = len(ends) if limit >= len(ends) else _cut(levels, whole, start, limit, last)
            n = count_tokens([raw[at[start] : at[end]].decode("utf-8")], tokenizer)[0]
            if n <= max_tokens or end <= after(start):
                break
            if end > after(last):
                limit = end - 1
            else:  # no room behind the last piece: give up some of the overlap
                start = after(start)
                limit = start + max_tokens
        pieces.append((int(np.searchsorted(chars, at[start])), int(np.searchsorted(chars, at[end])), n, max(last - start, 0)))
        if end == len(ends):
            return pieces
        last = end
        start = max(int(whole[np.searchsorted(whole, end - overlap, "right") - 1]), after(start))


def _cut(levels: list[np.ndarray], whole: np.ndarray, start: int, limit: int, last: int) -> int:
    """Token at which a piece from start ends: at most limit, behind the last piece's end."""
    least = max(start + max(1, int((limit - start) * MIN_FILL)), last + 1)
    for cuts in levels:
        k = np.searchsorted(cuts, limit, "right") - 1
        if k >= 0 and cuts[k] >= least:
            return int(cuts[k])
    k = int(whole[np.searchsorted(whole, limit, "right") - 1])
    return k if k > max(start, last) else int(whole[np.searchsorted(whole, max(start, last), "right")])


_OUT = "doc_id bigint, piece_no int, start_char bigint, end_char bigint, n_tokens bigint, overlap_tokens bigint, piece string, n_pieces int"
_NAMES = ["doc_id", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "piece", "n_pieces"]


def pieces(documents: DataFrame, limits: DataFrame, tokenizer: str | None = None, with_text: bool = True) -> DataFrame:
    """The pieces of every text over its source's limit, in order: offsets, tokens, text and the number of pieces.

    A byte-level token has a byte at least, so a text of at most max_tokens bytes keeps the limit and isn't tokenized.
    """
    limits = limits.select("source", F.col("max_tokens").cast("int").alias("max_tokens"), F.col("overlap_tokens").cast("int").alias("overlap_tokens"))
    limits = limits.where(F.col("max_tokens") > 0).groupBy("source").agg(F.min("max_tokens").alias("max_tokens"), F.max_by("overlap_tokens", F.struct(-F.col("max_tokens"), F.coalesce("overlap_tokens", F.lit(0)))).alias("overlap_tokens"))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").where(F.col("text").isNotNull())
    docs = docs.join(small(limits), "source").where(F.octet_length("text") > F.col("max_tokens"))

    def cut(batches):
        for b in batches:
            rows = []
            for doc_id, text, most, overlap in zip(*(b.column(i).to_pylist() for i in range(4))):
                parts = split(text, most, overlap or 0, tokenizer)
                if len(parts) > 1:
                    rows += [(doc_id, i, s, e, n, o, text[s:e] if with_text else None, len(parts)) for i, (s, e, n, o) in enumerate(parts)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=_NAMES)

    return docs.select("doc_id", "text", "max_tokens", "overlap_tokens").mapInArrow(cut, _OUT)
