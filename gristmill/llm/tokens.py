"""Token ids of the byte-level BPE vocabulary, computed on the executors.

Ids are those that ``tokenizers`` gives for ``byte_bpe_50k.json`` without special tokens added; a special token's name in a text is that token. They are
computed with ``tiktoken`` over the same vocabulary (``byte_bpe_50k.tiktoken``), which is four to five times faster; a test holds one against the other.
A worker reads the vocabulary once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

END = 0
LONGEST = 1 << 16
#: The vocabulary's one added token, and its id (fixed values).
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_encoders: dict[str | None, Callable[[str], list[int]]] = {}


def encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """Text to token ids; ``path`` is a ranks file, by default that of the installed public tokenizers."""
    if path not in _encoders:
        _encoders[path] = _made(path)
    return _encoders[path]


def _made(path: str | None) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cut = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")

    def plain(text: str) -> list[int]:
        """A very long text goes in parts; a blank between two letters always starts a word of the vocabulary's pattern."""
        if len(text) <= LONGEST:
            return encode(text)
        ids, at = [], 0
        while at < len(text):
            to = m.start() if (m := cut.search(text, at + LONGEST)) else len(text)
            ids += encode(text[at:to])
            at = to
        return ids

    def encoded(text: str) -> list[int]:
        if SPECIAL not in text:
            return plain(text)
        first, *rest = text.split(SPECIAL)
        ids = plain(first)
        for part in rest:
            ids.append(SPECIAL_ID)
            ids += plain(part)
        return ids

    return encoded
