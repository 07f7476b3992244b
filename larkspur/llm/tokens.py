"""Public byte-level tokenizers, shipped to the tasks as the bytes of their vocabulary file."""

from __future__ import annotations

import base64
from functools import lru_cache

# Fixed value: the pre-token pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str | None = None) -> bytes:
    """The rank file at path, about 1 MB; by default the installed 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    """The encoding of a rank file; the id after the last one is free for the end of a text."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def end_id(ranks: bytes) -> int:
    return encoder(ranks).max_token_value + 1
