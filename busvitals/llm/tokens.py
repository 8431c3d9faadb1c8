"""Token ids of whole texts by a public byte-level vocabulary.

Ids are those of the ``tokenizers`` file of the vocabulary. ``tiktoken`` reads the same vocabulary about four times
faster and makes them, except in texts that hold the text of a special token, which ``tokenizers`` encodes itself.
"""

from __future__ import annotations

import base64
import sys
from array import array

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"
_OPEN: dict[str, "Ids"] = {}


def _place(name: str, ending: str) -> str:
    return name + ending if "/" in name else public_tokenizers.path(name + ending)


class Ids:
    """Encodes texts to lists of ids."""

    def __init__(self, name: str) -> None:
        self.tokenizer = Tokenizer.from_file(_place(name, ".json"))
        with open(_place(name, ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def exactly(self, text: str) -> list[int]:
        """By the ``tokenizers`` library alone."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.exactly(text)
        return self.fast.encode_ordinary(text)


def ids(vocabulary: str = VOCABULARY) -> Ids:
    """The worker's encoder of a vocabulary: the name of a public one, or a path without its ending."""
    if vocabulary not in _OPEN:
        _OPEN[vocabulary] = Ids(vocabulary)
    return _OPEN[vocabulary]


def packed(tokens: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    found = array("I", tokens)  # four bytes on every platform that Spark runs on
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()
