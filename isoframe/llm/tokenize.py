"""Tokenizer encoding with a bounded memo of units between spaces or of words, for use inside tasks."""

from __future__ import annotations

import codecs
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from isoframe.llm.arrow import release

#: Units kept per worker, and half as many words of theirs (some 230 bytes each); once full, further ones are encoded each time they occur.
MEMO_UNITS = 800_000

#: Units on whose letters, digits and marks all regular-expression engines agree.
_SIMPLE = re.compile("[ \n!-~À-ÖØ-öø-ÿ]+")
#: The pre-token patterns of the two public vocabularies, for such units.
_LETTER, _DIGIT = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
_BYTE_LEVEL_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+"
_WORD_END_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+"
#: The characters of ``_SIMPLE`` in Latin-1, and which of them are marks (neither space, letter nor digit).
_SIMPLE_BYTES = bytes(b for b in range(256) if _SIMPLE.fullmatch(chr(b)))
_MARKS = bytes(0x23 if 0x20 < b < 0x7F and not chr(b).isalnum() else 0x20 for b in range(256))
#: Classes of the characters of ``_SIMPLE`` in Latin-1: white space 0, letters 1, digits 2, marks 3; and 4 for the byte between texts.
_CLASSES = bytes(4 if b == 0 else 0 if b in b" \n" else 2 if chr(b) in "0123456789" else 1 if chr(b).isalpha() else 3 for b in range(256))
#: Letters of the longest part that is remembered when texts are looked up by distinct parts.
LONGEST_PART = 64


def byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet by its public rule: printable bytes stand for themselves, others for U+0100 onwards."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in keep else next(spare)) for b in range(256)}


_BYTE_CHARS = "".join(byte_alphabet()[b] for b in range(256))


class _UnsafeCut(Exception):
    """A space is followed by white space or the end: the text must be encoded whole."""


class _Memo(dict):
    """Ids of units; computes what is missing and keeps it while there is room."""

    def __init__(self, compute, room: int):
        super().__init__()
        self.compute, self.room = compute, room

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[0].isspace():
            raise _UnsafeCut
        ids = self.compute(unit)
        if len(self) < self.room:
            self[unit] = ids
        return ids


class UnitEncoder:
    """Encodes texts exactly as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    Both public vocabularies split a text before every single space that is followed by
    a non-space, so a text is the concatenation of its units; units repeat a lot and are
    remembered.  Texts where that cut isn't safe (a space before other white space, or the
    string of an added token, which the library takes as that token) are encoded whole, and
    so is a very long text without spaces.

    Plain Latin texts are cut further, and each distinct part of the given texts is looked up
    once.  The vocabulary with word ends drops all white space and case, so there they are
    lower-cased and cut at any white space, and at points and commas where no two marks meet.
    For the other one they are cut into its pre-tokens.
    """

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.vocab_size = self.plain.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.plain.model
        # the vocabulary with word ends lower-cases and drops white space; the other one keeps both
        self.lower = self.model.end_of_word_suffix is not None
        self.split = re.compile(_WORD_END_SPLIT if self.lower else _BYTE_LEVEL_SPLIT).findall
        # without white space and case, a word and a unit of it alone have the same ids: one memo holds both
        self.room = memo_units + memo_units // 2
        self.memo = _Memo(lambda unit: self._encode_unit(" " + unit), self.room if self.lower else memo_units)
        self.words: dict[str, bytes] = self.memo if self.lower else {}
        self.memo_words = self.room if self.lower else memo_units // 2

    def _encode_unit(self, unit: str) -> bytes:
        """One unit; plain Latin ones go to the BPE model by pre-token, all others through the whole tokenizer."""
        if not (unit.isascii() and unit.isprintable() or _SIMPLE.fullmatch(unit)):
            return self.whole(unit)
        return self._encode_plain(unit.lower() if self.lower else unit)

    def _encode_plain(self, unit: str) -> bytes:
        words = self.words
        out = []
        for word in self.split(unit):
            ids = words.get(word)
            if ids is None:
                ids = self._encode_word(word)
                if len(words) < self.memo_words:
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def _encode_word(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(codecs.charmap_decode(word.encode(), "strict", _BYTE_CHARS)[0])]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _by_units(self, text: str) -> bytes:
        first, *units = text.split(" ")
        try:
            return self._encode_unit(first) + b"".join(map(self.memo.__getitem__, units))
        except _UnsafeCut:
            return self.whole(text)

    def _by_parts(self, texts: pa.Array) -> list[bytes]:
        """Of lower-case plain Latin texts, from their parts between white space."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.values.dictionary_encode()
        parts = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        return self._joined(self._look_up(parts), coded.indices.to_numpy(), lists.offsets.to_numpy())

    def _by_pre_tokens(self, raws: list[bytes]) -> list[bytes]:
        """Of plain Latin texts, given in Latin-1, from their pre-tokens."""
        joined = b"\0" + b"\0".join(raws) + b"\0"  # the byte between texts is a part of its own, without ids
        starts = pre_token_starts(joined)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(joined)]).dictionary_encode()
        at = coded.indices.to_numpy()
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        distinct = coded.dictionary.buffers()[2].to_pybytes().decode("latin-1")
        found = self._look_up([distinct[a:b] for a, b in zip(ends[1:], ends[2:], strict=False)])
        return self._joined([b"", *found], at, np.flatnonzero(at == 0))

    def _look_up(self, parts: list[str]) -> list[bytes]:
        """Ids of each of the distinct parts."""
        words = self.words
        room = self.memo_words
        if not self.lower:  # parts may have room of units, but half of it
            room = min(2 * room, self.room - len(self.memo))
        found = list(map(words.get, parts))
        for i, ids in enumerate(found):
            if ids is None:
                part = parts[i]
                found[i] = ids = self._encode_word(part) if not self.lower or part.isalpha() else self._encode_plain(part)
                if len(words) < room and 0 < len(part) <= LONGEST_PART:
                    words[part] = ids
        if not self.lower:
            self.memo.room = min(self.memo.room, self.room - len(words))
        return found

    def _joined(self, found: list[bytes], at: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of each text, whose parts are those between two bounds: ids of all distinct parts, and the number of each part in the order of the texts."""
        width = self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], sizes[at])
        place += np.arange(len(place))
        raw = flat[place].tobytes()
        cuts = (ends[bounds] * width).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian id bytes (``self.dtype``) of each text; null gives none."""
        out = [b""] * len(texts)
        parted: dict[bool, list[int]] = {True: [], False: []}  # by whether points and commas stand alone
        plain: dict[int, bytes] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(t in text for t in self.added):
                out[i] = self.whole(text)
            elif not (raw := _latin(text)):
                out[i] = self._by_units(text)
            elif self.lower:
                parted[b"##" not in raw.translate(_MARKS)].append(i)
            else:
                plain[i] = raw
        if plain:
            for i, ids in zip(plain, self._by_pre_tokens(list(plain.values())), strict=True):
                out[i] = ids
        for alone, rows in parted.items():
            if rows:
                lower = pc.utf8_lower(pa.array([texts[i] for i in rows], pa.large_string()))
                for mark in ".," if alone else "":
                    lower = pc.replace_substring(lower, mark, f" {mark} ")
                for i, ids in zip(rows, self._by_parts(lower), strict=True):
                    out[i] = ids
        return out


def pre_token_starts(joined: bytes) -> np.ndarray:
    """Where the parts that ``_BYTE_LEVEL_SPLIT`` finds begin, in plain Latin texts with a zero byte (a part too) around each; the end is the last."""
    data = np.frombuffer(joined, np.uint8)
    kind = np.frombuffer(joined.translate(_CLASSES), np.uint8)
    blank = kind == 0
    start = np.ones(len(data) + 1, bool)
    inner = start[1:-1]  # of every byte but the first
    np.not_equal(kind[1:], kind[:-1], out=inner)
    # a single space goes with what follows it, white space before other white space or the end stays together
    inner &= blank[1:] | (data[:-1] != 0x20) | (kind[1:] == 4)
    inner[:-1] |= blank[1:-1] & ~blank[2:] & (kind[2:] != 4)
    at = np.flatnonzero((data[:-1] == 0x27) & start[:-2])
    if len(at):  # 's, 't, 'm, 'd, 're, 've and 'll are parts; a zero byte ends the last text
        one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = np.isin(one.astype(np.uint16) << 8 | two, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long] + 3] = True
    return np.flatnonzero(start)


def _latin(text: str) -> bytes | None:
    """The text in Latin-1 if it has characters of ``_SIMPLE`` only."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, _SIMPLE_BYTES) else raw


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def encoder(path: str, memo_units: int = MEMO_UNITS) -> UnitEncoder:
    """One encoder a worker, vocabulary and size of memo."""
    if (path, memo_units) not in _ENCODERS:
        _ENCODERS[path, memo_units] = UnitEncoder(path, memo_units)
    return _ENCODERS[path, memo_units]


def forget() -> None:
    """Let go of encoders that an earlier stage left in this worker, and of its freed memory."""
    _ENCODERS.clear()
    release()
