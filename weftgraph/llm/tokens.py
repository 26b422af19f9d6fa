"""Token counts and offsets by a public tokenizer whose files lie outside the repository."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Folder of the public tokenizer files; a parameter of every operator that counts tokens.
TOKENIZER_DIR = os.environ.get("WEFTGRAPH_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The split pattern that belongs to these ranks (a fixed value of the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at once; longer texts are cut at white space before, so that no run of the encoder is long.
BLOCK_CHARS = 100_000


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZER_DIR, name: str = TOKENIZER):
    """The tokenizer, loaded once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("weftgraph", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def blocks(text: str) -> list[str]:
    """Pieces of at most ``BLOCK_CHARS`` characters, cut before a blank where there's one."""
    out, at = [], 0
    while len(text) - at > BLOCK_CHARS:
        cut = text.rfind(" ", at + 1, at + BLOCK_CHARS)
        cut = cut if cut > at else at + BLOCK_CHARS
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def count_tokens(texts, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> np.ndarray:
    """Tokens of each text; null and empty texts have none. Whole texts are encoded, however long."""
    enc = encoder(folder, name)
    return np.fromiter((sum(len(enc.encode_ordinary(b)) for b in blocks(t)) if t else 0 for t in texts), np.int64, len(texts))
