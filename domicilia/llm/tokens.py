"""Byte-level BPE vocabularies as their public files state them.

A file is read once a worker process. `Vocabulary` holds what both token operators need:
ranks of byte strings, the pattern that cuts texts into pieces, and special strings.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the public pattern of byte-level BPE pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Below this code point the libraries' character classes are the same.
_SAME_BELOW = 0x530


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable bytes stand for themselves, all others for the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    tokenizer: Tokenizer
    ranks: dict[bytes, int]
    special: dict[str, int]
    fast: tiktoken.Encoding
    pieces: regex.Pattern
    cut: regex.Pattern | None
    odd: regex.Pattern

    def plain(self, text: str) -> bool:
        """Whether the library cuts the text exactly as `pieces` does.

        Libraries know different Unicode versions; each character beyond the common range is
        tried once with the vocabulary's own library.
        """
        return all(_cut_alike(self, c) for c in set(self.odd.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special strings included.

        The fast encoder gives the library's ids, but gives up on some very long runs of white
        space; the library itself encodes those.
        """
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def split(self, text: str) -> list[str]:
        """Pieces of a text that holds no special string."""
        if self.plain(text):
            return self.pieces.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


_ALIKE: dict[str, bool] = {}


def _cut_alike(vocabulary: Vocabulary, c: str) -> bool:
    if c not in _ALIKE:
        probe = f"a{c}1 {c}{c}.{c} b  {c}"
        spans = vocabulary.tokenizer.pre_tokenizer.pre_tokenize_str(probe)
        _ALIKE[c] = [probe[a:b] for _, (a, b) in spans] == vocabulary.pieces.findall(probe)
    return _ALIKE[c]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The byte-level BPE vocabulary of a tokenizers .json file."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    if described["model"]["type"] != "BPE" or described["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{path} is no byte-level BPE vocabulary")
    letters = byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
    ids = [described["model"]["vocab"].get("".join(pair)) for pair in pairs]
    if not ids or ids != list(range(ids[0], ids[0] + len(ids))):
        raise ValueError(f"entries of {path} are not numbered in the order of its merges")
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
    return Vocabulary(
        tokenizer=Tokenizer.from_file(path),
        ranks=ranks,
        special=special,
        fast=tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special),
        pieces=regex.compile(PIECES),
        cut=regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None,
        odd=regex.compile(f"[^\\x00-\\u{_SAME_BELOW - 1:04x}]"),
    )
