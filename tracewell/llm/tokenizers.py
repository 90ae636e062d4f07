"""Public vocabularies, loaded once for each Python process."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import tiktoken


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def rank_encoder(path: str, special: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens=dict(special))


@lru_cache(maxsize=2)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_like_json(text: str, json_path: str, rank_path: str, special: tuple[tuple[str, int], ...]) -> list[int]:
    """Ids as the tokenizers library gives them for json_path.

    rank_path holds the same vocabulary as ranks, special its special tokens, and
    the rank encoder gives the same ids three times as fast. Where it gives up
    (very long runs of white space), the library itself takes over."""
    try:
        return rank_encoder(rank_path, special).encode(text, allowed_special="all")
    except BaseException as e:  # the encoder's panics are no Exceptions
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return json_tokenizer(json_path).encode(text, add_special_tokens=False).ids
