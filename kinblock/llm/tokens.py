"""Vectorised pre-tokens and cached encoding, shared by the token operators.

A batch of texts becomes one buffer; the cuts of the byte-level pre-token
pattern (contractions, runs of letters, digits or other signs with one space
before them, white space) are found by array operations on character classes.
The class of every code point is asked of the library whose ids are wanted,
as libraries know different versions of Unicode; the driver asks once and
sends the answer (a few thousand ranges) with the task.

A tokenizer's added tokens are found first and are pre-tokens of their own.
Distinct pre-tokens of a slice are then encoded once and remembered in the
worker by two 64-bit hashes and their length, in arrays, up to a bound in
entries and ids; when it is full, those that came once are forgotten.  Pre-tokens
above LONGEST bytes are encoded anew.  No step needs memory beyond a slice of
SLICE bytes and the longest text's own pieces; texts above SLICE are cut where
the pattern surely cuts as well (a space between two ASCII letters).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
#: Bounds of a worker's memory of pre-tokens: entries, their ids in all, and bytes of one.
CACHE, CACHE_IDS, LONGEST = 500_000, 4 << 20, 64
SAFE_CUT = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
#: White space of the pattern: the Unicode property White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3


#: Character classes as ranges: first code point and class of each, ascending.
Ranges = tuple[np.ndarray, np.ndarray]


def _ranges(starts_of: Callable[[str], np.ndarray], together: Callable[[list[str]], np.ndarray]) -> Ranges:
    """Classes of all code points.  ``starts_of``: the places in a string at which pre-tokens begin;
    ``together``: for strings of two characters, whether both are in one pre-token.

    Neighbours of one class are one pre-token, so the code points in order fall
    into few runs, and one of each run is tried after a letter and after a digit.
    """
    firsts: list[int] = []
    for a in range(0, 0x110000, 0x4000):
        points = [c for c in range(a, a + 0x4000) if not 0xD800 <= c < 0xE000]
        if points:
            firsts += [points[k] for k in starts_of("".join(map(chr, points))).tolist()]
    firsts = sorted({*firsts, *range(0x80), *SPACES, *(c + 1 for c in SPACES)})  # ASCII and spaces one by one
    kinds = np.full(len(firsts), OTHER, np.uint8)
    kinds[together(["a" + chr(c) for c in firsts])] = LETTER
    kinds[together(["1" + chr(c) for c in firsts])] = DIGIT
    kinds[np.isin(firsts, SPACES)] = SPACE
    return np.array(firsts, np.int64), kinds


def spread(ranges: Ranges) -> np.ndarray:
    """Class of every code point."""
    first, kind = ranges
    return np.repeat(kind, np.diff(first, append=0x110000))


@functools.cache
def library_ranges(name: str) -> Ranges:
    """Character classes of the pre-tokenizer in the tokenizer file ``name``."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(tokenizer_path(name)).pre_tokenizer.pre_tokenize_str
    starts = lambda text: np.array([a for _, (a, _) in split(text)], np.int64)
    return _ranges(starts, lambda pairs: np.fromiter((len(split(x)) == 1 for x in pairs), bool, len(pairs)))


@functools.cache
def pattern_ranges() -> Ranges:
    """Character classes of ``public_tokenizers.PATTERN`` as the tiktoken library reads it.

    The library shows no pre-tokens, so it gets a vocabulary that merges nothing
    but neighbours: the last byte of a character beyond ASCII with the first of
    the next, and ``a`` or ``1`` with any byte.  A merge means one pre-token.
    """
    import public_tokenizers
    import tiktoken

    tokens = [bytes([b]) for b in range(256)]
    tokens += [bytes([last, first]) for last in range(0x80, 0xC0) for first in range(0xC2, 0xF5)]
    tokens += [bytes([x, b]) for x in b"a1" for b in range(256)]
    encode = tiktoken.Encoding("neighbours", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={}).encode_ordinary

    def starts(text: str) -> np.ndarray:
        ids = np.array(encode(text), np.int32)
        joined = np.zeros(len(text.encode()), bool)  # a byte that the byte before it is merged with
        joined[np.cumsum(1 + (ids >= 256))[ids >= 256] - 1] = True
        lead = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return np.flatnonzero(~joined[lead])

    return _ranges(starts, lambda pairs: np.fromiter((encode(x)[0] >= 256 for x in pairs), bool, len(pairs)))


def cuts(data: bytes, doc_ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens of UTF-8 ``data`` begin, and its length; no pre-token
    crosses the byte offsets in ``doc_ends`` (ascending, the last is the length).
    ``classes``: the class of every code point."""
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(1, np.int64)
    if data.isascii():
        code = np.frombuffer(data, np.uint8)
        at = None
    else:
        code = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        at = np.empty(len(code) + 1, np.int64)
        at[0] = 0
        np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), out=at[1:])
    n = len(code)
    kind = classes[code]
    ends = doc_ends if at is None else np.searchsorted(at, doc_ends)
    fresh = np.zeros(n + 1, bool)  # a text begins here
    fresh[0] = True
    fresh[ends] = True
    begin = np.empty(n + 1, bool)
    begin[0] = begin[n] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:n])
    # The last white space before other text stands alone, or joins it if it is a plain space.
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:n])
    begin[last] = True
    plain = last[code[last] == 0x20]
    begin[plain + 1] = False
    begin |= fresh
    # Contractions, where a pre-token begins at an apostrophe followed by a letter.
    quote = np.flatnonzero((code[:-1] == 0x27) & begin[: n - 1] & (kind[1:] == LETTER) & ~fresh[1:n])
    for q in quote.tolist():
        a = code[q + 1]
        b = code[q + 2] if q + 2 < n and not fresh[q + 2] else 0
        if a in (0x73, 0x74, 0x6D, 0x64):  # s t m d
            size = 2
        elif (a, b) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):  # re ve ll
            size = 3
        else:
            continue
        begin[q + 1] = False
        begin[q + size] = True
    where = np.flatnonzero(begin)
    return where if at is None else at[where]


def _pieces(text: bytes) -> list[bytes]:
    """``text``, cut at sure pre-token ends if it is longer than a slice."""
    if len(text) <= SLICE:
        return [text]
    out, begin = [], 0
    while len(text) - begin > SLICE and (m := SAFE_CUT.search(text, begin + SLICE // 2)):
        out.append(text[begin : m.start()])
        begin = m.start()
    return [*out, text[begin:]]


def hashes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each word, and its length in bytes (of longer words only LONGEST bytes are hashed)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    length = np.diff(offsets).astype(np.int64)
    order = np.argsort(-length, kind="stable")
    start, size = offsets[:-1][order].astype(np.int64), length[order]
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g = ~h
    more = len(size) - np.searchsorted(size[::-1], np.arange(1, LONGEST + 1))  # words of at least k + 1 bytes
    for k, m in enumerate(more.tolist()):
        if not m:
            break
        c = data[start[:m] + k].astype(np.uint64)
        h[:m] = (h[:m] ^ c) * np.uint64(0x100000001B3)
        g[:m] = (g[:m] + c) * np.uint64(0xD6E8FEB86659FD93)
        g[:m] ^= g[:m] >> np.uint64(32)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return h[back], g[back], length


class Encoder:
    """Ids of texts, by ``encode(list of distinct pre-tokens) -> (number of ids of each, all ids)``;
    ``added``: literals that are never cut."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], ranges: Ranges, bound: int = CACHE, added: tuple[str, ...] = ()):
        self.encode, self.bound, self.classes = encode, bound, spread(ranges)
        longest_first = sorted((x.encode() for x in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, longest_first))) if added else None
        self._clear()

    def _clear(self, coming: int = 0) -> None:
        self.mask = (1 << (2 * self.bound + 2 * coming).bit_length()) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)  # open addressing: slot, or -1
        self.n = self.used = 0
        self.first, self.second = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.size, self.begin = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.hits = np.zeros(1024, np.int32)  # slices that have held the pre-token, since the last shrinking
        self.flat = np.zeros(4096, np.int32)

    def _find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The slot of each pair of hashes, or -1."""
        out = np.full(len(h), -1, np.int64)
        left, place = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            slot = self.table[place].astype(np.int64)
            there = slot >= 0
            left, place, slot = left[there], place[there], slot[there]
            same = (self.first[slot] == h[left]) & (self.second[slot] == g[left])
            out[left[same]] = slot[same]
            left, place = left[~same], (place[~same] + 1) & self.mask
        return out

    def _add(self, h: np.ndarray, g: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        first, n = self.n, self.n + len(h)
        if n > len(self.size):
            grown = lambda x: np.concatenate([x, np.zeros(n, x.dtype)])
            self.first, self.second, self.size, self.begin, self.hits = map(grown, (self.first, self.second, self.size, self.begin, self.hits))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(ids), np.int32)])
        self.first[first:n], self.second[first:n], self.size[first:n], self.hits[first:n] = h, g, sizes, 0
        self.begin[first:n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.n, self.used = n, self.used + len(ids)
        slot, place = np.arange(first, n, dtype=np.int32), (h & np.uint64(self.mask)).astype(np.int64)
        while len(slot):
            at = np.flatnonzero(self.table[place] < 0)
            self.table[place[at]] = slot[at]  # of several the last stays
            put = self.table[place] == slot
            slot, place = slot[~put], (place[~put] + 1) & self.mask

    def _shrink(self, coming: int) -> None:
        """Forgets the pre-tokens that came once, and more of the rare ones if half the bounds are not enough;
        makes room for ``coming`` others."""
        hits = self.hits[: self.n]
        keep = np.flatnonzero(hits > 1)
        keep = keep[np.argsort(-hits[keep], kind="stable")[: self.bound // 2]]
        keep = keep[np.cumsum(self.size[keep]) <= CACHE_IDS // 2]
        h, g, size, kept = self.first[keep], self.second[keep], self.size[keep], self._ids(keep)
        self._clear(coming)
        self._add(h, g, size, kept)

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids of ``slots`` one after another."""
        size = self.size[slots]
        end = np.cumsum(size, dtype=np.int32)
        if not len(end):
            return np.zeros(0, np.int32)
        at = np.repeat(self.begin[slots] - end + size, size)
        at += np.arange(end[-1], dtype=np.int32)
        return self.flat[at]

    def _of(self, words: pa.StringArray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``words[nth]``, and their number in each."""
        h, g, length = hashes(words)
        slots = self._find(h, g)
        slots[length > LONGEST] = -1
        new = np.flatnonzero(slots < 0)
        if len(new):
            sizes, ids = self.encode(words.take(pa.array(new)).to_pylist())
            if self.n + len(new) > self.bound or self.used + len(ids) > CACHE_IDS:
                self._shrink(len(words))
                slots = self._find(h, g)
                slots[length > LONGEST] = -1
                gone = np.flatnonzero(slots < 0)
                if len(gone) > len(new):
                    new = gone
                    sizes, ids = self.encode(words.take(pa.array(new)).to_pylist())
            slots[new] = np.arange(self.n, self.n + len(new))
            self._add(h[new], g[new], sizes, ids)
            long = new[length[new] > LONGEST]
            self.second[slots[long]] = ~self.second[slots[long]]  # found by no word
        self.hits[slots] += 1
        slots = slots[nth]
        return self._ids(slots), self.size[slots]

    def _cuts(self, data: bytes, doc_ends: np.ndarray) -> np.ndarray:
        if self.added is None or not self.added.search(data):
            return cuts(data, doc_ends, self.classes)
        docs = zip([0, *doc_ends.tolist()], doc_ends.tolist())
        spans = np.array([m.span() for a, b in docs for m in self.added.finditer(data, a, b)], np.int64).reshape(-1, 2)
        where = cuts(data, np.union1d(doc_ends, spans), self.classes)  # on both sides the text begins anew
        nth = np.searchsorted(spans[:, 0], where, side="left") - 1  # the last span that begins before
        inside = (nth >= 0) & (where < np.append(spans[:, 1], 0)[nth])
        return where[~inside]

    def _slice(self, data: bytes, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``data`` and their number in each text."""
        where = self._cuts(data, doc_ends)
        if len(where) < 2:
            return np.zeros(0, np.int32), np.zeros(len(doc_ends), np.int64)
        words = pa.StringArray.from_buffers(len(where) - 1, pa.py_buffer(where.astype(np.int32).tobytes()), pa.py_buffer(data))
        known = words.dictionary_encode()
        ids, size = self._of(known.dictionary, known.indices.to_numpy())
        total = np.zeros(len(where), np.int64)
        np.cumsum(size, out=total[1:])
        return ids, np.diff(total[np.searchsorted(where, doc_ends)], prepend=0)

    def texts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For successive runs of ``texts``: how many texts, their ids one after another, ids of each."""
        group: list[bytes] = []
        size = 0

        def flush():
            return len(group), *self._slice(b"".join(group), np.cumsum(np.fromiter(map(len, group), np.int64, len(group))))

        for t in texts:
            if group and size + len(t) > SLICE:
                yield flush()
                group, size = [], 0
            if len(t) > SLICE:
                parts = [self._slice(p, np.array([len(p)]))[0] for p in _pieces(t)]
                ids = np.concatenate(parts)
                yield 1, ids, np.array([len(ids)])
            else:
                group.append(t)
                size += len(t)
        if group:
            yield flush()


def column_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string or binary column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int32, len(lists))
    return sizes, np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))


def _by_library(tok) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Pre-tokens through the library: those of letters or digits line by line in one call, as a
    line break between two of them is a token of its own; the others one by one."""
    one = lambda text: tok.encode(text, add_special_tokens=False).ids
    ends = one("\n")
    joins = len(ends) == 1 and one("ab\n cd\nef\n12") == [*one("ab"), *ends, *one(" cd"), *ends, *one("ef"), *ends, *one("12")]

    def run(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((joins and (w[1:] if w[0] == " " else w).isalnum() for w in words), bool, len(words))
        lines = [w for w, p in zip(words, plain.tolist()) if p]
        sizes = np.zeros(len(words), np.int32)
        found = np.zeros(0, np.int32)
        if lines:
            blocks = ["\n".join(lines[k : k + 2048]) + "\n" for k in range(0, len(lines), 2048)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in tok.encode_batch_fast(blocks, add_special_tokens=False)])
            at = np.flatnonzero(ids == ends[0])
            sizes[plain] = np.diff(at, prepend=-1) - 1
            found = ids[ids != ends[0]]
        rest = [w for w, p in zip(words, plain.tolist()) if not p]
        if not rest:
            return sizes, found
        lists = [e.ids for k in range(0, len(rest), 4096) for e in tok.encode_batch_fast(rest[k : k + 4096], add_special_tokens=False)]
        sizes[~plain], other = flattened(lists)
        out = np.empty(int(sizes.sum()), np.int32)
        by_word = np.repeat(plain, sizes)
        out[by_word], out[~by_word] = found, other
        return sizes, out

    return run


_LIBRARY: dict[str, Encoder] = {}


def library_encoder(name: str, ranges: Ranges | None = None) -> Encoder:
    """Encoding by the tokenizers library with the public file ``name`` (or a path), one worker
    process; ``ranges``: its ``library_ranges``, asked for here if not given."""
    if name not in _LIBRARY:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path(name))
        added = tok.get_added_tokens_decoder().values()
        if any(a.lstrip or a.rstrip or a.single_word for a in added):
            raise ValueError(f"{name}: added tokens that depend on what is beside them")
        _LIBRARY[name] = Encoder(_by_library(tok), ranges or library_ranges(name), added=tuple(a.content for a in added))
    return _LIBRARY[name]


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
