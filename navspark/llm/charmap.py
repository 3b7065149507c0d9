"""Normalisation of texts by a compiled character map, with the source place of every normalised byte.

A map is the ``precompiled_charsmap`` of a SentencePiece model: the size of a double-array trie, the trie, and the
null-ended replacements that its values point to.  At each place of a text the longest key that starts there is replaced; where
none does, a character stands for itself and an invalid byte for U+FFFD.  The trie is walked from all places of a batch of texts
at once, a byte a step, by the places whose walks go on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE, REPLACEMENT = "▁".encode(), "�".encode()


@dataclass(frozen=True)
class CharMap:
    """units: the trie; pool: replacements, each ended by a zero byte."""

    units: np.ndarray
    pool: np.ndarray

    @staticmethod
    def of(blob: bytes) -> CharMap:
        size = int.from_bytes(blob[:4], "little")
        return CharMap(np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), np.frombuffer(blob[4 + size :], np.uint8))

    def longest(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length in bytes of the longest key at each start, before its text's end (0: none), and its value."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return length, value

        def offset(unit: np.ndarray) -> np.ndarray:
            return (unit >> 10) << ((unit & 512) >> 6)

        live = np.arange(len(starts))
        node = np.full(len(starts), int(offset(self.units[:1])[0]), np.int64)
        for depth in range(1 << 30):
            on = starts[live] + depth < ends[live]
            live, node = live[on], node[on]
            byte = buf[starts[live] + depth].astype(np.int64)
            node ^= byte
            unit = self.units[node]
            on = (unit & (1 << 31 | 255)) == byte
            live, node, unit = live[on], node[on], unit[on]
            if not len(live):
                return length, value
            node ^= offset(unit)
            leaf = (unit >> 8 & 1) == 1
            length[live[leaf]] = depth + 1
            value[live[leaf]] = self.units[node[leaf]] & (1 << 31) - 1
        return length, value


@dataclass(frozen=True)
class Rules:
    """What a model's normaliser does beside its map."""

    charmap: CharMap
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def characters(text: bytes) -> tuple[list[int], list[int]]:
    """Starts of a text's characters, and those that are invalid bytes of their own."""
    starts, bad, at = [], [], 0
    while at < len(text):
        starts.append(at)
        for n in range(1, 5):
            try:
                text[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            break
        else:
            bad.append(at)
            n = 1
        at += min(n, len(text) - at)
    return starts, bad


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def chunks(texts: list[bytes], rules: Rules) -> tuple[np.ndarray, ...]:
    """Of all texts: source start, source end, place in the pool and length of the replacement, of each chunk that is replaced as
    one; the pool; and the number of chunks before each text."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.cumsum([0, *map(len, texts)])
    first, bad = (buf & 0xC0) != 0x80, np.zeros(len(buf), bool)
    for k, text in enumerate(texts):
        if not text.isascii() and not _valid(text):
            first[edges[k] : edges[k + 1]] = False
            starts, wrong = characters(text)
            first[edges[k] + np.array(starts, np.int64)] = True
            bad[edges[k] + np.array(wrong, np.int64)] = True
    start = np.flatnonzero(first)
    bad = bad[start]
    own = np.diff(start, append=len(buf))
    owner = np.searchsorted(edges, start, side="right") - 1
    length, value = rules.charmap.longest(buf, start, edges[owner + 1])
    over = np.flatnonzero(length > own)
    if len(over):  # a key of several characters swallows those behind it, unless it is swallowed itself
        keep, until = np.ones(len(start), bool), 0
        for k in over.tolist():
            if start[k] >= until:
                until = start[k] + length[k]
                keep[k + 1 : np.searchsorted(start, until)] = False
        start, own, length, value, bad = start[keep], own[keep], length[keep], value[keep], bad[keep]
    hit = length > 0
    pool = np.concatenate([buf, rules.charmap.pool, np.frombuffer(REPLACEMENT, np.uint8)])
    zeros = np.flatnonzero(rules.charmap.pool == 0)
    size, place = own.copy(), start.copy()
    place[hit] = len(buf) + value[hit]
    if hit.any():
        size[hit] = zeros[np.searchsorted(zeros, value[hit])] - value[hit]
    bad &= ~hit
    place[bad], size[bad] = len(pool) - len(REPLACEMENT), len(REPLACEMENT)
    end = start + np.where(hit, length, own)
    return start, end, place, size, pool, np.searchsorted(start, edges)


def gather(pool: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes pool[place : place + size] after each other."""
    ends = np.cumsum(size)
    return pool[np.repeat(place - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def normalize(texts: list[bytes], rules: Rules) -> list[tuple[bytes, np.ndarray]]:
    """Of each text: the normalised bytes, and the source place of each, with the place behind the last."""
    start, end, place, size, pool, of_text = chunks(texts, rules)
    edges = np.cumsum([0, *map(len, texts)])
    raw = gather(pool, place, size)
    chunk = np.repeat(np.arange(len(start)), size)
    ends = np.cumsum(size)
    out = []
    for k in range(len(texts)):
        a, b = of_text[k], of_text[k + 1]
        lo, hi = (ends[a] - size[a] if a < b else 0), (ends[b - 1] if a < b else 0)
        out.append(_spaced(raw[lo:hi], chunk[lo:hi] - a, start[a:b] - edges[k], end[a:b] - edges[k], size[a:b], rules))
    return out


def _spaced(raw: np.ndarray, chunk: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray, rules: Rules) -> tuple[bytes, np.ndarray]:
    """The white-space rules over one text's replaced bytes."""
    blank = raw == 32
    head = 0
    if rules.squeeze and len(start):
        # a chunk behind a space, or the first, loses its leading spaces
        alone = (size == 1) & (np.bincount(chunk[blank], minlength=len(start)) == 1)
        other = np.flatnonzero(~alone)
        if not len(other):
            return b"", end[-1:]
        head = int(other[0])
        inside = np.arange(len(raw)) - (np.cumsum(size) - size)[chunk]
        solid = np.full(len(start), len(raw), np.int64)
        np.minimum.at(solid, chunk[~blank], inside[~blank])
        before = np.r_[True, blank[:-1]]
        opening = np.zeros(len(start), bool)
        first = inside == 0
        opening[chunk[first]] = before[first]
        kept = ~(blank & (inside < solid[chunk]) & opening[chunk])
        raw, chunk, blank = raw[kept], chunk[kept], blank[kept]
    if not len(start):
        return b"", np.zeros(1, np.int64)
    text, places = raw.tobytes(), start[chunk]
    space = b" "
    if rules.escape:
        text, places, space = text.replace(b" ", SPACE), np.repeat(places, np.where(blank, len(SPACE), 1)), SPACE
    if rules.dummy_prefix and not rules.suffix:
        text, places = space + text, np.r_[np.full(len(space), start[head]), places]
    last = int(end[-1])
    if rules.squeeze:
        while text.endswith(space):
            last = int(places[len(text) - len(space)])
            text, places = text[: -len(space)], places[: -len(space)]
    if rules.dummy_prefix and rules.suffix:
        text, places = text + space, np.r_[places, np.full(len(space), last)]
    return text, np.r_[places, last]
