"""Token ids of whole texts by a public tokenizer, with a piece cache in each Python worker.

A text is cut at blanks into pieces on which the tokenizer gives the same ids as inside the text. Pieces repeat
often: all of a block's pieces are hashed at once and looked up in an open-addressed table of id runs, which also holds
their bytes; what the table lacks, and every long piece, goes through the tokenizer, and so does a piece whose bytes are not
those found under its hash. Texts that hold the string of a special token go through the tokenizer whole. Where the
tokenizer lower-cases anyway, A-Z are lower-cased before the pieces are hashed, so that a word is held once.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from inkgrove.llm.hashing import slice_hashes

#: Pieces a worker's cache holds at most; it starts anew beyond. Pieces of more bytes than CACHE_BYTES are not held.
CACHE_PIECES, CACHE_BYTES = 300_000, 64
#: Pieces whose bytes are compared at once.
COMPARED = 1 << 15
#: Words joined for one call of the tokenizer; bytes of texts handled at once.
JOINED, BLOCK = 512, 1 << 20

_loaded: dict[tuple[str, bool], "PieceEncoder"] = {}
_ODD_BLANK = re.compile(r"[^\S\n ]")
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
#: Lower-case letters up to U+00FF, and the characters by which byte-level vocabularies write the bytes of such letters.
_LOWER = "".join(c for c in map(chr, range(256)) if c.isalpha() and c.islower())
_WRITTEN = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: ASCII characters that are neither letters, digits, blanks nor controls.
_SIGNS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that may begin a blank other than space and line end.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of these sizes, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class PieceCache:
    """uint64 keys to runs of ids, with the bytes that each key stands for."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.row_keys = np.zeros(1 << (bits - 1), np.uint64)
        self.starts, self.lengths = np.zeros(1 << (bits - 1), np.int64), np.zeros(1 << (bits - 1), np.int32)
        self.ids, self.used = np.zeros(1 << bits, np.uint32), 0
        self.bytes, self.bytes_used = np.zeros(1 << bits, np.uint8), 0
        self.byte_starts, self.byte_sizes = np.zeros(1 << (bits - 1), np.int64), np.zeros(1 << (bits - 1), np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        mask, shift = np.int64((1 << self.bits) - 1), np.uint64(64 - self.bits)
        at = (keys >> shift).astype(np.int64)
        rows = self.rows[at]
        out = np.where(self.keys[at] == keys, rows, -1)
        open_ = np.flatnonzero((out < 0) & (rows >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            rows = self.rows[at[open_]]
            hit = self.keys[at[open_]] == keys[open_]
            out[open_] = np.where(hit, rows, -1)
            open_ = open_[~hit & (rows >= 0)]
        return out

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        mask, at = np.int64((1 << self.bits) - 1), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.rows[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.rows[at[won]] = keys[won], rows[won]
            placed = np.zeros(len(keys), bool)
            placed[won] = True
            left = left[~placed[left]]
            at[left] = (at[left] + 1) & mask

    def add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray, pieces: list[bytes]) -> None:
        """Different keys that are not in the table yet, with their ids one after another, and their bytes."""
        n = len(keys)
        while (self.count + n) * 2 > len(self.keys):
            self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self.row_keys, self.starts, self.lengths, self.byte_starts, self.byte_sizes = (
                np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.row_keys, self.starts, self.lengths, self.byte_starts, self.byte_sizes)
            )
            self._place(self.row_keys[: self.count], np.arange(self.count, dtype=np.int32))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        while self.bytes_used + len(raw) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes), np.uint8)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.bytes[self.bytes_used : self.bytes_used + len(raw)] = raw
        new = slice(self.count, self.count + n)
        self.row_keys[new], self.lengths[new] = keys, sizes
        self.starts[new] = self.used + np.cumsum(sizes) - sizes
        self.byte_sizes[new] = [len(p) for p in pieces]
        self.byte_starts[new] = self.bytes_used + np.cumsum(self.byte_sizes[new]) - self.byte_sizes[new]
        self._place(keys, np.arange(self.count, self.count + n, dtype=np.int32))
        self.count, self.used, self.bytes_used = self.count + n, self.used + len(flat), self.bytes_used + len(raw)

    def stands_for(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Whether each row's bytes are data[start:stop]; COMPARED rows at a time, to need little memory."""
        sizes = stops - starts
        same = self.byte_sizes[rows] == sizes
        for at in range(0, len(rows), COMPARED):
            own = at + np.flatnonzero(same[at : at + COMPARED])
            if len(own):
                equal = self.bytes[_spread(self.byte_starts[rows[own]], sizes[own])] == data[_spread(starts[own], sizes[own])]
                if not equal.all():
                    same[own] = np.logical_and.reduceat(equal, np.cumsum(sizes[own]) - sizes[own])
        return same

    def gather(self, rows: np.ndarray, other: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after another, and where each row's begin (one more for the end); other has the ids of places in rows that are -1."""
        sizes = self.lengths[rows].astype(np.int64)
        for i, ids in other.items():
            sizes[i] = len(ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if not other:
            return self.ids[_spread(self.starts[rows], sizes)], ends
        out = np.zeros(ends[-1], np.uint32)
        known = np.flatnonzero(rows >= 0)
        out[_spread(ends[:-1][known], sizes[known])] = self.ids[_spread(self.starts[rows[known]], sizes[known])]
        for i, ids in other.items():
            out[ends[i] : ends[i + 1]] = ids
        return out, ends


class PieceEncoder:
    """Encodes with add_special_tokens=False. Special tokens' strings in a text become their ids, as the library does by
    default, or are ordinary text if plain_specials."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        known = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [] if plain_specials else [x.content.encode() for x in known]
        self.caseless = any(x.normalized for x in known)
        self.spaced = self.tokenizer.normalizer is None  # byte-level: a word takes the space before it
        self.lowers = not self.spaced and self.tokenizer.normalizer.normalize_str(_LOWER[:26].upper() + _LOWER) == _LOWER[:26] + _LOWER
        # Normalizer and pre-tokenizer, most of the work on a word, can be left out if they leave a word of these letters as it is.
        word = " " + _LOWER[:26].upper() + _LOWER if self.spaced else _LOWER
        self.direct = (self.spaced or self.lowers) and self._modelled([word])[0] == self.tokenizer.encode(word, add_special_tokens=False).ids
        self.cache = PieceCache()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text as unsigned 32-bit integers."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
                continue
            if self._special(text):
                out[i] = self._whole(text.decode())
                continue
            held.append(i)
            size += len(text)
            if size >= BLOCK:
                self._block(texts, held, out)
                held, size = [], 0
        if held:
            self._block(texts, held, out)
        return out

    def _special(self, text: bytes) -> bool:
        if self.caseless:
            text = text.lower()
        return any((x.lower() if self.caseless else x) in text for x in self.specials)

    def _block(self, texts: list[bytes], held: list[int], out: list) -> None:
        data = np.frombuffer(b"".join([texts[i] for i in held]), np.uint8)
        if self.lowers:
            upper = (data >= 65) & (data <= 90)
            upper[:-1] &= (data[1:] < 128) | (data[1:] == 0xC3)  # a mark that follows may make one character with its letter
            data = data + upper.astype(np.uint8) * np.uint8(32)
        sizes = np.array([len(texts[i]) for i in held])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        blank = _BLANKS[data]
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        last = np.concatenate([blank[1:], [True]]) | first[1:]
        # A sign that follows a Latin letter is always cut off by the tokenizers themselves.
        letter = _LETTERS[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # U+00C0 to U+00FF but for two signs
        mark = _SIGNS[data] & np.concatenate([[False], letter[:-1]]) & ~first[:-1]
        if self.spaced:
            begins = blank | first[:-1]
            begins[1:] |= data[:-1] == 10
            begins |= mark
            cut = np.flatnonzero(begins)
            until = np.append(cut[1:], len(data))
            odd = np.add.reduceat(_SUSPECT[data], starts, dtype=np.int64) > 0
            twin = blank.copy()
            twin[:-1] &= blank[1:] | first[1:-1]  # two blanks, or one that ends a text
            awkward = np.add.reduceat(twin, starts, dtype=np.int64) > 0
            slow = {k for k in np.flatnonzero(awkward | odd) if awkward[k] or _ODD_BLANK.search(texts[held[k]].decode())}
        else:
            before = np.concatenate([[True], blank[:-1]]) | first[:-1] | mark
            after = last | np.append(mark[1:], False)
            cut, until = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
            slow = set()
        keys = slice_hashes(data, cut, until) | np.uint64(1)
        rows = self.cache.find(keys)
        short = until - cut <= CACHE_BYTES
        missing = np.flatnonzero((rows < 0) & short)
        raw = data.tobytes()
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            if self.cache.count + len(new) > CACHE_PIECES:
                self.cache = PieceCache()
                missing = np.flatnonzero(short)
                rows[:] = -1
                new, where = np.unique(keys[missing], return_index=True)
            where = missing[where]
            pieces = [raw[a:b] for a, b in zip(cut[where].tolist(), until[where].tolist())]
            order, flat, counts = self._learn([p.decode() for p in pieces])
            self.cache.add(new[order], flat, counts, [pieces[i] for i in order.tolist()])
            rows[missing] = self.cache.find(keys[missing])
        rows[~short] = -1
        found = np.flatnonzero(rows >= 0)
        rows[found[~self.cache.stands_for(rows[found], data, cut[found], until[found])]] = -1
        other = np.flatnonzero(rows < 0).tolist()
        ids, at = self.cache.gather(rows, dict(zip(other, self._each([raw[cut[i] : until[i]].decode() for i in other]))))
        bounds = at[np.searchsorted(cut, np.append(starts, len(data)))]
        for k, i in enumerate(held):
            out[i] = self._whole(texts[i].decode()) if k in slow else ids[bounds[k] : bounds[k + 1]]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _each(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for at in range(0, len(pieces), 4096) for x in self.tokenizer.encode_batch_fast(pieces[at : at + 4096], add_special_tokens=False)]

    def _modelled(self, words: list[str]) -> list[list[int]]:
        """The ids that the tokenizer's model gives for each word of letters up to U+00FF, after a space or not."""
        tokenize, space = self.tokenizer.model.tokenize, chr(_WRITTEN[32])
        written = (x if x.isascii() else x.encode().decode("latin-1").translate(_WRITTEN) for x in words)
        return [[t.id for t in tokenize(space + x[1:] if x[0] == " " else x)] for x in written]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, their ids in that order, and how many each has. Words of Latin letters (in lower case, if
        the tokenizer lower-cases) go to the model at once, where that is the same; others are encoded many at a time: between such words the tokenizers' own splitting always cuts."""
        lead = " " if self.spaced else ""
        latin = [x.isascii() or max(x) <= "\xff" for x in pieces]
        words = [i for i, x in enumerate(pieces) if latin[i] and (x[0] == " " and x[1:].isalpha() if lead else x.isalpha())]
        bare = [i for i, x in enumerate(pieces) if lead and latin[i] and x.isalpha()]
        chosen = {*words, *bare}
        plain = [i for i in words + bare if self.spaced or pieces[i].islower()] if self.direct else []
        if self.direct:
            words, bare = [i for i in words if not self.spaced and not pieces[i].islower()], []
        others = [i for i in range(len(pieces)) if i not in chosen]
        modelled, glue = self._modelled([pieces[i] for i in plain]), "" if lead else " "
        ids, sizes = [np.fromiter(chain.from_iterable(modelled), np.uint32)], [np.array([len(x) for x in modelled], np.int64)]
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, found in zip(part, self.tokenizer.encode_batch([glue.join([pieces[i] for i in g]) for g in part], add_special_tokens=False)):
                ids.append(np.array(found.ids, np.uint32))
                sizes.append(np.bincount(found.word_ids, minlength=len(group)))
        for at in range(0, len(bare), JOINED):
            group = bare[at : at + JOINED]
            found = self.tokenizer.encode_batch(["\n".join([pieces[i] for i in group])], add_special_tokens=False)[0]
            of = np.array(found.word_ids)  # every other one is a line end
            ids.append(np.array(found.ids, np.uint32)[of % 2 == 0])
            sizes.append(np.bincount(of[of % 2 == 0] // 2, minlength=len(group)))
        for found in self._each([pieces[i] for i in others]):
            ids.append(found)
            sizes.append(np.array([len(found)]))
        return np.array(plain + words + bare + others, np.int64), np.concatenate(ids), np.concatenate(sizes).astype(np.int32)


def forget_encoders() -> None:
    """Let the worker's encoders and the pieces they hold go; the next use loads them anew."""
    _loaded.clear()


def encoder(path: str, plain_specials: bool = False) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if (path, plain_specials) not in _loaded:
        _loaded[path, plain_specials] = PieceEncoder(path, plain_specials)
    return _loaded[path, plain_specials]
