"""Byte-level BPE of many texts by the tokenizers library, each distinct word once a block.

The library merges within pre-tokens only. A block of texts is one buffer of bytes: words are
spans between certain pre-token boundaries. A 64-bit hash brings alike spans together, their bytes
decide whether they are equal, and only distinct words are cut into pre-tokens and encoded by the
library's model.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

BITS = 16
# Fixed value: the pre-tokenisation pattern of byte-level pre-tokenisers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, and pre-tokens, whose ids a worker keeps, and the longest word kept (bytes); a full store is emptied.
KEEP, KEEP_PIECES, LONGEST = 1_500_000, 400_000, 64
_RNG = np.random.default_rng(5_150)
_VALUES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
# bytes that are, or may begin, white space other than the six ASCII characters
_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").match
_POWERS: list[np.ndarray] = []
_ENCODERS: dict[str, Callable[[list[bytes]], list[bytes]]] = {}


def _powers(n: int) -> list[np.ndarray]:
    """_STEP ** i and _BACK ** i for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_STEP, _BACK):
            p = np.full(n, base)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS


def word_starts(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where words begin: at a text's start, where white space begins, after white space that does not end in a
    space, and before the last of several white-space characters when text follows. All are boundaries of
    pre-tokens, and a word alone is cut as it is in its text."""
    white = _WHITE[raw]
    before = np.empty_like(white)
    before[1:], before[:1] = white[:-1], False
    after = np.empty_like(white)  # white space, or the end of the text
    after[:-1], after[-1:] = white[1:], True
    after[stops[stops > starts] - 1] = True
    space = np.empty_like(white)
    space[1:], space[:1] = raw[:-1] == 32, False
    at = (white & (~before | ~after)) | (~white & before & ~space)
    at[starts[stops > starts]] = True
    return np.flatnonzero(at)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw on as one integer; zeros follow the end."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def same_bytes(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a on in x equal those from b on in y; x and y as eights()."""
    same = np.ones(len(a), bool)
    on = np.arange(len(a))
    done = 0
    while len(on):
        left = np.minimum(size[on] - done, 8)
        same[on] &= ((x[a[on] + done] ^ y[b[on] + done]) & _LOW[left]) == 0
        done += 8
        on = on[(size[on] > done) & same[on]]
    return same


def distinct_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One word's number for each distinct word, each word's place among these, and their hashes, ascending.

    Neighbours by hash and length are one word only if their bytes are equal; different words of
    equal hash that alternate may each stand here more than once. Words beyond LONGEST bytes stay apart.
    """
    size = np.diff(at, append=len(raw))
    forth, back = _powers(len(raw))
    h = np.add.reduceat(_VALUES[raw] * forth[: len(raw)], at) * back[at]
    order = np.argsort(h)
    a, n, from_ = h[order], size[order], at[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (n[1:] != n[:-1])]) | (n > LONGEST)
    alike = np.flatnonzero(~new)
    bytes_ = eights(raw)
    new[alike] = ~same_bytes(bytes_, from_[alike], bytes_, from_[alike - 1], n[alike])
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group, a[new]


class _Words:
    """Known words, ascending by hash: their bytes (in one array, from `place` on), sizes, and where their ids lie in another."""

    def __init__(self, h=None, size=None, place=None, begin=None, n=None, raw=None, ids=None):
        self.h = np.zeros(0, np.uint64) if h is None else h
        self.size, self.place, self.begin, self.n = (np.zeros(0, np.int64) if x is None else x for x in (size, place, begin, n))
        self.raw = np.zeros(0, np.uint8) if raw is None else raw
        self.ids = np.zeros(0, np.uint16) if ids is None else ids


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


def cuttable(path: str) -> bool:
    """Whether a tokenizer file merges byte-level pre-tokens of SPLIT and does nothing else to a text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    as_is = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    return as_is and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout")


class ByteBpe:
    """Encoder of lists of UTF-8 texts into little-endian uint16 ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << BITS:
            raise ValueError(f"ids of {path} need more than {BITS} bits")
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.cuttable, self.model = cuttable(path), self.tok.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # every pre-token comes once: the model's own store would only cost
        self.letters = _byte_letters()
        self.any_letters = regex.compile(SPLIT).findall
        # the same pattern for ASCII and Latin letters only, which the standard module cuts faster
        latin = "A-Za-zÀ-ÖØ-öø-ÿ"
        self.latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{latin}]+| ?[0-9]+| ?[^\t-\r {latin}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
        self.is_latin = re.compile(rf"[\t-\r -~{latin}]*").fullmatch
        self.words = _Words()
        self.pieces: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        return self.latin(text) if self.is_latin(text) else self.any_letters(text)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pre-tokens that are not kept yet; a line break is a separator here."""
        new = list(set(pieces).difference(self.pieces, ["\n"]))
        shown = "\n".join(new).encode().decode("latin-1").translate({**self.letters, 10: "\n"}).split("\n") if new else []
        tokenize = self.model.tokenize
        self.pieces.update([(piece, array("H", [t.id for t in tokenize(letters)]).tobytes()) for piece, letters in zip(new, shown)])

    def _alone(self, text: str) -> bytes:
        """Ids of one text by its pre-tokens, none of them kept."""
        ids = [t.id for piece in self.cut(text) for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return np.array(ids, "<u2").tobytes()

    def _encode_words(self, words: list[bytes], alone: list[bool]) -> list[bytes]:
        """Ids of distinct words; they are cut in one text, a line break between each two, but those marked alone."""
        joined = [w for w, one in zip(words, alone) if not one]
        out = []
        if joined:
            cut = self.cut(b"\n".join(joined).decode())
            self._learn(cut)
            get, held = self.pieces.__getitem__, []
            for p in cut:
                if p != "\n":
                    held.append(get(p))
                else:
                    out.append(b"".join(held))
                    held = []
            out.append(b"".join(held))
            if len(self.pieces) > KEEP_PIECES:
                self.pieces.clear()
        if len(joined) == len(words):
            return out
        rest = iter(out)
        return [self._alone(w.decode()) if one else next(rest) for w, one in zip(words, alone)]

    def _word_ids(self, raw: np.ndarray, joined: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's distinct word; where each distinct word's ids begin in an array, how many they are, and that array."""
        first, word, h = distinct_words(raw, at)
        size, from_ = np.diff(at, append=len(raw))[first], at[first]
        w = self.words
        k = np.searchsorted(w.h, h)
        near = np.minimum(k, len(w.h) - 1)
        taken = w.h[near] == h if len(w.h) else np.zeros(len(h), bool)
        hit = taken & (w.size[near] == size) if len(w.h) else taken
        alike = np.flatnonzero(hit)
        hit[alike] = same_bytes(eights(raw), from_[alike], eights(w.raw), w.place[near[alike]], size[alike])
        begin, n = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        begin[hit], n[hit] = w.begin[near[hit]], w.n[near[hit]]
        new = np.flatnonzero(~hit)
        if not len(new):
            return word, begin, n, w.ids
        lead = raw[from_[new]] == 32
        white = np.add.reduceat(_WHITE[raw], at, dtype=np.int32)[first[new]] - lead
        alone = (white > 0) | (size[new] == lead) | (size[new] > LONGEST)
        ids = self._encode_words([joined[a:b] for a, b in zip(from_[new].tolist(), (from_ + size)[new].tolist())], alone.tolist())
        n[new] = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        begin[new] = len(w.ids) + np.cumsum(n[new]) - n[new]
        flat = np.concatenate([w.ids, np.frombuffer(b"".join(ids), "<u2")])
        keep = new[(size[new] <= LONGEST) & ~taken[new]]
        if len(w.h) + len(keep) > KEEP:
            self.words = _Words()
        elif len(keep):
            stop = np.cumsum(size[keep])
            held = raw[np.repeat(from_[keep] - (stop - size[keep]), size[keep]) + np.arange(stop[-1])]
            place = np.zeros(len(first), np.int64)
            place[keep] = len(w.raw) + stop - size[keep]
            put = k[keep]
            old = ((w.h, h), (w.size, size), (w.place, place), (w.begin, begin), (w.n, n))
            self.words = _Words(*[np.insert(was, put, now[keep]) for was, now in old], np.concatenate([w.raw, held]), flat)
        return word, begin, n, flat

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        joined = b"".join(texts)
        raw, stops = np.frombuffer(joined, np.uint8), np.cumsum(size)
        slow = np.array([not self.cuttable or any(s in t for s in self.special) for t in texts], bool)
        for i in np.flatnonzero(_ODD[raw]).tolist():
            if _ODD_SPACE(joined, i):
                slow[np.searchsorted(stops, i, side="right")] = True
        for i in np.flatnonzero(slow).tolist():
            out[i] = np.array(self.tok.encode(texts[i].decode(), add_special_tokens=False).ids, "<u2").tobytes()
        fast = np.flatnonzero(~slow & (size > 0))
        if not len(fast):
            return out
        if slow.any():
            joined = b"".join([texts[i] for i in fast])
            raw = np.frombuffer(joined, np.uint8)
        stops = np.cumsum(size[fast])
        starts = stops - size[fast]
        at = word_starts(raw, starts, stops)
        word, begin, n, flat = self._word_ids(raw, joined, at)
        count = n[word]
        upto = np.cumsum(count)
        place = np.repeat(begin[word] - (upto - count), count)
        place += np.arange(len(place))
        tokens = flat[place].tobytes()
        before = np.concatenate([[0], upto])[np.searchsorted(at, np.append(starts, len(raw)))].tolist()
        for i, a, b in zip(fast.tolist(), before, before[1:]):
            out[i] = tokens[2 * a : 2 * b]
        return out


def byte_bpe(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """The worker's encoder of a tokenizer file: UTF-8 texts to little-endian uint16 ids, as the library encodes whole texts.

    A text that holds one of the file's special tokens or white space beyond ASCII, and every text
    of a file that is not `cuttable`, goes to the library whole.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]
