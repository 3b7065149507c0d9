"""Whole texts to token ids with a public tokenizer of the ``tokenizers`` library, a word at a time.

Where the tokenizer's file has the pre-tokenizer ``PIECE`` and the normalizer NFC, white space, lower case, neither ever
crosses white space, so the ids of a text are those of its words after each other.  Every word then goes through the
library once and is found in a dictionary.  Any other file's texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import regex

#: The pre-tokenizer's pattern of word_bpe_49k.json (fixed value).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHED_WORDS = 250_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where printable, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def supported(spec: dict) -> bool:
    """Whether a tokenizer's texts may be cut at white space as described above."""
    steps = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("content")) for x in (spec["normalizer"] or {}).get("normalizers", ())]
    parts = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex"))
             for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
    return (
        steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
        and parts == [("Split", PIECE.pattern, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        and not any(spec[x] for x in ("truncation", "padding", "post_processor"))
    )


class Words(dict):
    """Words' ids in two generations of CACHED_WORDS: when the young one is full it becomes the old one, from which
    words that come again return."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        self[word] = ids = self.encode(word) if ids is None else ids
        return ids

    def age(self) -> None:
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Texts as UTF-8 bytes to ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = supported(json.loads(self.tokenizer.to_str()))
        self.letters = byte_letters()
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = Words(self.word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(spelled)])

    def word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.piece(word.decode())
        if word[:-1].isalpha():  # a mark after letters, never part of a contraction
            return self.words[word[:-1]] + self.piece(word[-1:].decode()) if word.isascii() else self.latin(word)
        return self.latin(word)

    def latin(self, word: bytes) -> bytes:
        text = word.decode()
        low = text.lower()
        # Latin words need no more than this; others take the library's own normalizer
        if word.isascii() or (max(low) < "ɐ" and max(text) < "ɐ" and unicodedata.is_normalized("NFC", text)):
            return b"".join(map(self.piece, PIECE.findall(low)))
        return self.whole(text)

    def __call__(self, text: bytes) -> bytes:
        # special tokens are found before lower-casing, and marks may compose differently after it
        if not self.by_word or b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return self.whole(text.decode())
        self.words.age()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, loaded once: its words serve all of the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
