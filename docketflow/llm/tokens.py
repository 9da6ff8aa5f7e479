"""Token counts by a public tokenizer; its vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("DOCKETFLOW_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The tokenizer, loaded once per worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str, piece: int = 200_000) -> list[int]:
    """Ids of a whole text; a very long one is encoded in pieces cut before a blank, where the pattern cuts too."""
    enc = encoding(vocabulary)
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    while at < len(text):
        end = min(len(text), at + piece)
        if end < len(text):
            space = text.rfind(" ", at + 1, end)
            # a blank after a non-blank starts a token of the pattern
            while space > at and text[space - 1].isspace():
                space = text.rfind(" ", at + 1, space)
            end = space if space > at else end
        ids += enc.encode_ordinary(text[at:end])
        at = end
    return ids
