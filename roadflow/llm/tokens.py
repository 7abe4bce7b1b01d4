"""Byte-level BPE ids as raw little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

#: Chunks remembered by a worker before it starts afresh (bounds its memory).
CACHE = 150_000

_encoders: dict[str, Callable[[str], bytes]] = {}


def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """An encoder for the byte-level BPE ``vocabulary`` (a ``*.json`` tokenizer file with its ``*.tiktoken`` twin beside it).

    Its ids are those of ``tokenizers.Tokenizer.from_file(vocabulary)`` with
    ``add_special_tokens=False``.  One encoder a worker and vocabulary.
    """
    if vocabulary in _encoders:
        return _encoders[vocabulary]
    import json
    import struct

    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(re.sub(r"\.json$", ".tiktoken", vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    known: dict[str, bytes] = {}

    def raw(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(text: str) -> bytes:
        return raw(bpe.encode(text, allowed_special="all"))

    def chunk(word: str) -> bytes | None:
        """Ids of a chunk with its space before it; None where the chunk can't be encoded by itself."""
        if not word or word[0].isspace() or word[-1].isspace() or "<|" in word:
            return None
        ids = raw(bpe.encode_ordinary(" " + word))
        if len(word) < 40:
            if len(known) >= CACHE:
                known.clear()
            known[word] = ids
        return ids

    def encode(text: str) -> bytes:
        # The vocabulary's splitting pattern never crosses a single space between
        # two characters that aren't white space, so the chunks between such
        # spaces are encoded alone and remembered.
        first, *rest = text.split(" ")
        if text[:1].isspace() or first[-1:].isspace() or "<|" in first:
            return whole(text)
        out = list(map(known.get, rest))
        if None in out:
            for k, x in enumerate(out):
                if x is None:
                    x = chunk(rest[k])
                    if x is None:
                        return whole(text)
                    out[k] = x
        return raw(bpe.encode_ordinary(first)) + b"".join(out)

    _encoders[vocabulary] = encode
    return encode
