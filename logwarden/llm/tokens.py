"""Whole texts to ids of a public byte-level vocabulary, the same as the tokenizers library gives."""

from __future__ import annotations

import json
import os
import re

import numpy as np

_TWO_SPACES = re.compile(r"\s\s")
SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str) -> str:
    """A public vocabulary's file on this machine; vocabularies are installed on every machine, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Ids (little-endian unsigned 32-bit) of pieces of text, kept until there are ``limit`` of them."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, part: str) -> bytes:
        text = part if part[:1] == "\n" else " " + part
        ids = np.array(self.encode(text), dtype="<u4").tobytes()
        if len(part) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it can be printed, else 256 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked(path: str):
    """The vocabulary at ``path`` as byte strings with ranks, for the faster library; its ids must rise with its merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte, vocabulary = _bytes_of_characters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in pairs]
    if order != sorted(order):
        raise ValueError(f"the ids of {path} don't follow its merges")
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """``encode(text)``: the ids of a text as bytes of little-endian unsigned 32-bit numbers.

    The vocabulary's splitting pattern never joins what stands before white space with it, and only runs of white space
    look further than their own part. So a text without two white-space characters in a row is the sum of its parts,
    each a space or line end with what follows, and parts repeat often; they are kept, ``limit`` of them. All other
    texts, and those that hold a special token, are encoded whole.
    """

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._encode = ranked(path)._core_bpe.encode_ordinary
        self._parts = _Ids(self._encode, limit)

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _TWO_SPACES.search(text):
            return np.array(self._encode(text), dtype="<u4").tobytes()
        first, *parts = text.replace("\n", " \n").split(" ")
        head = np.array(self._encode(first), dtype="<u4").tobytes() if first else b""
        return head + b"".join(map(self._parts.__getitem__, parts))
