"""Byte-level BPE encoding inside tasks, shared by token counts and packing."""

from __future__ import annotations

import base64
import functools

import numpy as np

SPECIAL = "<|endoftext|>"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str):
    """Text to ids exactly as the JSON tokenizer gives them with add_special_tokens=False.

    The rank file holds the same vocabulary and encodes several times faster;
    texts with the special token's string go to the JSON tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.no_truncation()
    exact.no_padding()
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if SPECIAL in text:
            return np.asarray(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode
