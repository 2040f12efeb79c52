"""Token counts and token offsets by a public byte-level tokenizer.

The vocabulary file is a parameter (environment variable EXAMFORGE_TOKENIZER or `path`); by default it is taken from
the installed public_tokenizers package. Files are read in place and never copied.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: The pre-tokenization pattern published with the byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(path: str | None = None) -> str:
    if path := path or os.environ.get("EXAMFORGE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def count_tokens(texts: list[str | None], path: str | None = None) -> list[int]:
    """Tokens of each text, 0 for null."""
    encode = _encoding(vocabulary_path(path))[0].encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def token_ends(text: str, path: str | None = None) -> np.ndarray:
    """Byte offset of each token's end in the UTF-8 text: the prefix sums of the token widths."""
    encoding, widths = _encoding(vocabulary_path(path))
    return np.cumsum(widths[np.asarray(encoding.encode_ordinary(text), np.int64)])
