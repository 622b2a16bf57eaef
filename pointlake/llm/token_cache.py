"""Encoding by pieces of text that recur, each encoded once while it is remembered.

A text is cut before a space that follows a non-space character, and new pieces at the borders of pre-tokens. The
pre-tokenizers used here never match across such places and look no further back, so the ids of a text are those of
its pieces, one after the other. Whole columns are cut and looked up by arrays: a piece of at most SHORT bytes is two
64-bit numbers that hold all its bytes and its length, so nothing is told apart by hashes alone.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex

from pointlake.llm.bytetext import LOWER, mix
from pointlake.llm.common import text_blocks, tidy

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by a worker; beyond it the older half goes.
REMEMBERED = 600_000
_CUT = re.compile(r"(?<=\S)(?= )")
#: All that Python counts as white space, which covers what the pre-tokenizers count.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
_BEFORE_SPACE = [f"{c} " for c in _SPACES]
_BEFORE_SPACE_ASCII = [x for x in _BEFORE_SPACE if x.isascii()]


def pieces(text: str) -> list[str]:
    """The pieces of a text; joined they are the text."""
    if "\0" in text or any(x in text for x in (_BEFORE_SPACE_ASCII if text.isascii() else _BEFORE_SPACE)):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


class _Numbers(dict):
    """Gives every new key the next number and notes it."""

    def __init__(self, *a):
        super().__init__(*a)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


#: Bytes of a piece that is looked up by arrays.
SHORT = 15
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes after which a space begins a piece: all but those of white space.
_CLOSES = np.ones(256, bool)
_CLOSES[[ord(c) for c in _SPACES if c.isascii()]] = False


_LETTERS = np.zeros(256, bool)
_LETTERS[[c for c in range(128) if chr(c).isalpha()]] = True
#: Bytes of ASCII letters and of those of U+00C0 to U+00FF, whose first byte is C3.
_LATIN = _LETTERS.copy()
_LATIN[[0xC3, *(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7))]] = True
#: As _LATIN, in lower case.
_LOWER = _LATIN.copy()
_LOWER[[*range(65, 91), *range(0x80, 0x9F)]] = False
_MARK_BYTES = np.zeros(256, bool)
_MARK_BYTES[list(b",.;:!?")] = True


def spans(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts data[offsets[i]:offsets[i+1]] start; each ends where the next one starts. Beside
    the cuts of pieces() there are some before a line's end, after one that no white space is beside, and between a letter and a mark, but none after a
    character of U+1000 to U+3FFF, among which is wide white space."""
    first = (data == 32) | (data == 10)
    first[1:] &= _CLOSES[data[:-1]]
    at = np.flatnonzero(first[1:] & (data[:-1] >= 0x80)) + 1
    last = data[at - 1]
    first[at[((data[at - 2] == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((data[at - 3] >= 0xE1) & (data[at - 3] <= 0xE3))]] = False
    letter = _LETTERS[data]
    first[1:] |= letter[:-1] & _MARK_BYTES[data[1:]]
    first[2:] |= letter[2:] & (data[1:-1] == 10) & (_CLOSES[data[:-2]] & (data[:-2] < 0x80))
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


class Merges:
    """Byte pair merges of many short words by arrays. first: the id of each byte, last: that of a word's last byte;
    pairs: (left id, right id, merged id) by rank; size: ids are below it."""

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: np.ndarray, size: int):
        self.first, self.last, self.size, self.none = first, last, size, len(pairs)
        self.merged = pairs[:, 2].copy()
        self.keys, self.ranks = np.full(1 << 19, -1, np.int64), np.full(1 << 19, self.none, np.int32)
        key, rank = np.unique(pairs[:, 0] * size + pairs[:, 1], return_index=True)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            mine = self.keys[slot] == key
            self.ranks[slot[mine]] = rank[mine]
            key, rank, slot = key[~mine], rank[~mine], (slot[~mine] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left * self.size + right).ravel()
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], self.none)
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[rest]]
            equal = held == key[rest]
            out[rest[equal]] = self.ranks[slot[rest[equal]]]
            rest = rest[~equal & (held >= 0)]
        return out.reshape(left.shape)

    def encode(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words data[start:start+length], one word after the other, and how many each has."""
        sizes, parts = np.zeros(len(start), np.int64), []
        for width in np.unique(length).tolist():
            rows = np.flatnonzero(length == width)
            raw = data[start[rows][:, None] + np.arange(width)]
            ids = self.first[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            rank = self.rank(ids[:, :-1], ids[:, 1:])
            while len(rows):  # all rows have as many ids, as each gets one merge a round
                each = np.arange(len(rows))
                at = rank.argmin(1) if ids.shape[1] > 1 else each * 0
                least = rank[each, at] if ids.shape[1] > 1 else np.full(len(rows), self.none)
                ended = least == self.none
                if ended.any():
                    sizes[rows[ended]] = ids.shape[1]
                    parts.append((rows[ended], ids[ended]))
                    rows, ids, rank, at, least = rows[~ended], ids[~ended], rank[~ended], at[~ended], least[~ended]
                    each = np.arange(len(rows))
                    if not len(rows):
                        break
                new, place = self.merged[least], np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
                ids[each, at] = new
                rank = np.take_along_axis(rank, place[:-1] + (place[:-1] >= at[:, None]), 1)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
                rank[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], new[left])
                rank[right, at[right]] = self.rank(new[right], ids[right, at[right] + 1])
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int64)
        for rows, ids in parts:
            out[begin[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, sizes


class _Rows:
    """An array that rows are added to."""

    def __init__(self, kind: np.dtype | str):
        self.all, self.number = np.zeros(1024, kind), 0

    def add(self, rows: np.ndarray) -> None:
        end = self.number + len(rows)
        if end > len(self.all):
            self.all = np.concatenate([self.all[: self.number], np.zeros(max(end, 2 * len(self.all)) - self.number, self.all.dtype)])
        self.all[self.number : end] = rows
        self.number = end

    @property
    def rows(self) -> np.ndarray:
        return self.all[: self.number]


class _Table:
    """Numbers by keys of two 64-bit numbers, the second never 0: slots, each key in its own or the next free one."""

    def __init__(self, keys: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64),) * 2, numbers: np.ndarray = np.zeros(0, np.int64)):
        self.a, self.b, self.numbers = _Rows(np.uint64), _Rows(np.uint64), _Rows(np.int64)
        for rows, kind in ((self.a, np.uint64), (self.b, np.uint64), (self.numbers, np.int64)):
            rows.add(np.full(1, -1 if rows is self.numbers else 0, kind))  # what free slots lead to
        self.slots = np.zeros(1 << 12, np.int32)
        self.add(keys, numbers)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a ^ mix(b)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self._slot(a, b)
        entry = self.slots[slot]
        equal = (self.a.all[entry] == a) & (self.b.all[entry] == b)
        out = np.where(equal, self.numbers.all[entry], -1)
        left = np.flatnonzero(~equal & (entry > 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            entry = self.slots[slot[left]]
            equal = (self.a.all[entry] == a[left]) & (self.b.all[entry] == b[left])
            out[left[equal]] = self.numbers.all[entry[equal]]
            left = left[~equal & (entry > 0)]
        return out

    def add(self, keys: tuple[np.ndarray, np.ndarray], numbers: np.ndarray) -> None:
        """Distinct keys that it doesn't have."""
        begin = self.a.number
        for rows, new in zip((self.a, self.b, self.numbers), (*keys, numbers), strict=True):
            rows.add(new)
        if self.a.number * 3 > len(self.slots):
            self.slots, begin = np.zeros(1 << int(self.a.number * 6).bit_length(), np.int32), 1
        left = np.arange(begin, self.a.number, dtype=np.int32)
        slot = self._slot(self.a.rows[begin:], self.b.rows[begin:])
        while len(left):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = left[free]
            again = self.slots[slot] != left
            left, slot = left[again], (slot[again] + 1) & (len(self.slots) - 1)


class PieceEncoder:
    """cut: from a text to pieces; split: from a piece to the pre-tokens that make it up; encode_many: from distinct
    pre-tokens to packed ids, of type kind; fold: A-Z count as a-z in pieces without characters
    from U+0100 on. merges: for plain words, those of bytes in `plain` after one space or none; spaced: the space is one of the word's bytes."""

    def __init__(self, split: Callable[[str], list[str]], encode_many: Callable[[list[str]], list[bytes]], cut: Callable[[str], list[str]] = pieces, remembered: int = REMEMBERED, kind: np.dtype | str = "u1", fold: bool = False, merges: Merges | None = None, plain: np.ndarray = _LETTERS, spaced: bool = True):
        self.split, self.encode_many, self.cut, self.remembered = split, encode_many, cut, remembered
        self.fold, self.merges, self.plain, self.spaced = fold, merges, plain, spaced
        self.known, self.packed = _Numbers(), []
        self.table, self.ids, self.ends, self.placed = _Table(), _Rows(kind), _Rows(np.int64), _Rows(np.int64)

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """The packed ids of each text of a string column; null counts as empty."""
        out, collected = [], gc.isenabled()
        gc.disable()
        try:
            for _, _, data, offsets in text_blocks(column):
                out += self._encode_block(data, offsets)
                self._forget()
        finally:
            if collected:
                gc.enable()
        return out

    def _encode_block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if not len(data):
            return [b""] * (len(offsets) - 1)
        start = spans(data, offsets)
        length = np.diff(start, append=len(data))
        if self.fold:
            wide = np.add.reduceat(data >= 0xC4, start, dtype=np.int64) > 0
            data = np.where(np.repeat(wide, length), data, LOWER[data]) if wide.any() else LOWER[data]
        raw = data.tobytes() + bytes(2 * 8)
        words = np.ndarray(len(data) + 9, "<u8", raw, strides=(1,))
        short = np.flatnonzero(length <= SHORT)
        at, size = start[short], length[short]
        a = words[at] & _LOW_BYTES[np.minimum(size, 8)]
        b = (words[at + 8] & _LOW_BYTES[np.maximum(size - 8, 0)]) | (size.astype(np.uint64) << np.uint64(56))
        found = self.table.find(a, b)
        number = np.empty(len(start), np.int64)
        number[short] = found
        miss = np.flatnonzero(found < 0)
        new = odd = np.zeros(0, np.int64)
        if len(miss):
            order = miss[np.lexsort((b[miss], a[miss]))]
            first = np.concatenate([[True], (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])])
            new = order[first]
            numbers = np.empty(len(new), np.int64)
            odd = np.arange(len(new))
            if self.merges:
                begin, end = at[new], at[new] + size[new]
                begin = begin + (data[begin] == 32)
                other = np.concatenate([[0], np.cumsum(~self.plain[data])])
                is_plain = (begin < end) & (other[end] == other[begin])
                begin = at[new] if self.spaced else begin
                words_ = np.flatnonzero(is_plain)
                numbers[words_] = self._store(*self.merges.encode(data, begin[words_], (end - begin)[words_]))
                odd = np.flatnonzero(~is_plain)
        # What is no plain word goes by the library.
        long = np.flatnonzero(length > SHORT)
        asked = np.concatenate([long, short[new[odd]]])
        keys = [self.known[raw[s:e].decode()] for s, e in zip(start[asked].tolist(), (start[asked] + length[asked]).tolist(), strict=True)]
        if self.known.new:
            done = len(self.packed)
            self._learn()
            learnt = self.packed[done:]
            sizes = np.fromiter(map(len, learnt), np.int64, len(learnt)) // self.ids.all.itemsize
            self.placed.add(self._store(np.frombuffer(b"".join(learnt), self.ids.all.dtype), sizes))
        asked_at = self.placed.all[np.array(keys, np.int64)]
        number[long] = asked_at[: len(long)]
        if len(miss):
            numbers[odd] = asked_at[len(long) :]
            number[short[order]] = numbers[np.cumsum(first) - 1]
            self.table.add((a[new], b[new]), numbers)
        end, begin = self.ends.all[number], np.where(number > 0, self.ends.all[number - 1], 0)
        place = np.concatenate([[0], np.cumsum(end - begin)])
        ids = self.ids.all[np.repeat(begin - place[:-1], end - begin) + np.arange(place[-1])].tobytes()
        bounds = (place[np.searchsorted(start, offsets)] * self.ids.all.itemsize).tolist()
        return [ids[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new entries with these ids."""
        first, end = self.ends.number, self.ids.number  # entry 0 starts at 0
        self.ids.add(ids)
        self.ends.add(np.cumsum(sizes) + end)
        return np.arange(first, self.ends.number)

    def _forget(self) -> None:
        """Beyond what is remembered, the older half goes, and all that is no plain word."""
        if self.ends.number <= self.remembered:
            return
        half, ids, ends, table = self.ends.number // 2, self.ids.rows, self.ends.rows, self.table
        self.known, self.packed = _Numbers(), []
        self.ids, self.ends, self.placed = _Rows(ids.dtype), _Rows(np.int64), _Rows(np.int64)
        self._store(ids[ends[half - 1] :], np.diff(ends[half - 1 :]))
        stay = table.numbers.rows >= half
        self.table = _Table((table.a.rows[stay], table.b.rows[stay]), table.numbers.rows[stay] - half)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The packed ids of each text."""
        number, collected = self.known.__getitem__, gc.isenabled()
        gc.disable()  # many small lists and no cycles: collecting would walk all that is remembered
        try:
            rows = [list(map(number, self.cut(text))) for text in texts]
            if self.known.new:
                self._learn()
        finally:
            if collected:
                gc.enable()
        out = [b"".join(map(self.packed.__getitem__, row)) for row in rows]
        if len(self.known) > self.remembered:
            half = len(self.known) // 2
            self.known = _Numbers((k, i) for i, k in enumerate(list(self.known)[half:]))
            self.packed = self.packed[half:]
        return out

    def _learn(self) -> None:
        number, new, single, made = self.known.__getitem__, self.known.new, [], []
        at = len(self.packed)
        for n, piece in enumerate(new, at):  # grows as it goes on
            parts = self.split(piece)
            if parts == [piece]:
                single.append(n)
            else:
                made.append((n, list(map(number, parts))))
        self.packed.extend([b""] * len(new))
        for n, ids in zip(single, self.encode_many([new[n - at] for n in single]), strict=True):
            self.packed[n] = ids
        for n, parts in made:
            self.packed[n] = b"".join(map(self.packed.__getitem__, parts))
        self.known.new = []


#: Fixed value: the pre-token pattern of the byte-level vocabularies.
BYTE_LEVEL = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: How the byte-level vocabularies write a space.
_SPACE = "\u0120"
#: Fixed value: that of the vocabulary with word ends, on lower-cased text.
WORD_ENDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: Lower-casing these letters, and composing them, depends on nothing around them.
_PLAIN = re.compile("[\0-įı-ɏ]*")


_MARKS = frozenset(",.;:!?")


def byte_level_parts(piece: str) -> list[str]:
    """BYTE_LEVEL.findall(piece), quicker for a word and for a word with a mark after it."""
    if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return [piece]
    if piece[-1:] in _MARKS and piece[1:-1].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return [piece[:-1], piece[-1]]
    return BYTE_LEVEL.findall(piece)


def _word_pieces(text: str) -> list[str]:
    """Pieces without their spaces, which this kind of vocabulary drops; in lower case where that is safe."""
    return text.lower().split(" ") if text.isascii() or _PLAIN.fullmatch(text) else _CUT.split(text)


def _word_parts(piece: str) -> list[str]:
    if not piece.isascii() and not _PLAIN.fullmatch(piece):
        return [piece]
    bare = piece.lstrip(" ").lower()
    if bare.isalpha():
        return [bare]
    if bare[-1:] in _MARKS and bare[:-1].isalpha():
        return [bare[:-1], bare[-1]]
    return WORD_ENDS.findall(bare)


_encoders: dict[str, tuple[PieceEncoder, np.dtype]] = {}


def _merges(model: dict, spell: list[str], ends: str) -> Merges | None:
    """Merges of a tokenizers file; spell: how it writes each byte. None where the model does more than merge."""
    if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(c not in vocabulary or c + ends not in vocabulary for c in spell):
        return None
    first, last = (np.array([vocabulary[c + e] for c in spell], np.int64) for e in ("", ends))
    return Merges(first, last, np.array([(vocabulary[x], vocabulary[y], vocabulary[x + y]) for x, y in pairs], np.int64).reshape(-1, 3), max(vocabulary.values()) + 1)


def _byte_spelling() -> list[str]:
    """How the byte-level vocabularies write each byte: as itself where that can be seen, else from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(k) if k in seen else chr(next(hidden)) for k in range(256)]


def library_encoder(file: str, remembered: int = REMEMBERED) -> tuple[PieceEncoder, np.dtype]:
    """The encoder of a tokenizers file, special strings counting as text, and the type of its packed ids; a worker
    process keeps it from task to task, with so many pieces. Pre-tokens are known for the two kinds of file described in the tokenizers'
    README: byte-level, and with word ends; for others it raises ValueError."""
    if file in _encoders:
        _encoders[file][0].remembered = remembered
        return _encoders[file]
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.encode_special_tokens = True
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    with open(file, encoding="utf-8") as f:
        config = json.load(f)
    ends = config["model"].get("end_of_word_suffix")

    def one_by_one(new: list[str]) -> list[bytes]:
        return [np.array(x.ids, kind).tobytes() for x in tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    if ends and WORD_ENDS.pattern in str(config["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")):
        closing = np.zeros(tokenizer.get_vocab_size(), bool)
        closing[[i for token, i in tokenizer.get_vocab().items() if token.endswith(ends)]] = True

        def joined(new: list[str]) -> list[bytes]:
            """All lower-case pre-tokens in one text: each one's last id closes a word."""
            plain = [k for k, x in enumerate(new) if _PLAIN.fullmatch(x)]
            out = [b""] * len(new)
            ids = np.array(tokenizer.encode(" ".join([new[k] for k in plain]), add_special_tokens=False).ids, kind)
            end = (np.flatnonzero(closing[ids]) + 1) * kind.itemsize if len(ids) else np.zeros(0, np.int64)
            if len(end) != len(plain):
                return one_by_one(new)
            raw, start = ids.tobytes(), 0
            for k, e in zip(plain, end.tolist(), strict=True):
                out[k], start = raw[start:e], e
            other = [k for k, x in enumerate(new) if not _PLAIN.fullmatch(x)]
            for k, x in zip(other, one_by_one([new[k] for k in other]), strict=True):
                out[k] = x
            return out

        encoder = PieceEncoder(_word_parts, joined, _word_pieces, kind=kind, fold=True, merges=_merges(config["model"], _byte_spelling(), ends), plain=_LOWER, spaced=False)
    elif not ends and config["normalizer"] is None and config["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        opening = np.zeros(tokenizer.get_vocab_size(), bool)
        opening[[i for token, i in tokenizer.get_vocab().items() if token.startswith(_SPACE)]] = True

        def spaced(new: list[str]) -> list[bytes]:
            """All words after a space in one text: each one's first id, and no other, begins with the space."""
            plain = [k for k, x in enumerate(new) if x[0] == " " and x[1:].isalpha()]
            if len(plain) < 2:
                return one_by_one(new)
            text = "".join([new[k] for k in plain])
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)
            start = np.flatnonzero(opening[ids]) * kind.itemsize
            if len(start) != len(plain) or start[0]:
                return one_by_one(new)
            raw, out = ids.tobytes(), [b""] * len(new)
            for k, a, b in zip(plain, start.tolist(), [*start[1:].tolist(), len(raw)], strict=True):
                out[k] = raw[a:b]
            held = set(plain)
            other = [k for k in range(len(new)) if k not in held]
            for k, x in zip(other, one_by_one([new[k] for k in other]), strict=True):
                out[k] = x
            return out

        whole = all(x.special for x in tokenizer.get_added_tokens_decoder().values())  # others are found across words
        encoder = PieceEncoder(byte_level_parts, spaced if whole else one_by_one, kind=kind, merges=_merges(config["model"], _byte_spelling(), "") if whole else None, plain=_LATIN)
    else:
        raise ValueError(f"no rule for the pre-tokens of {file}")
    encoder.remembered = remembered
    _encoders[file] = encoder, kind
    del config
    tidy()  # reading the file takes several times what is kept of it
    return _encoders[file]


def forget(file: str) -> None:
    """Drop the encoder of a file, with all the pieces it remembers."""
    _encoders.pop(file, None)
