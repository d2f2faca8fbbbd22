"""Public tokenizers, run once per distinct piece of text.

Both vocabularies split a text before merging, and no merge crosses ASCII white
space, so a text's ids are the ids of its words in order. Texts are split and
their words numbered a batch at a time by Arrow; the library's model is asked
for each new word, and a bounded table of 64-bit hashes and packed ids keeps the
answers for as long as the Python worker lives.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beyond ASCII, which the byte-level splitter may join with a neighbouring run.
_WIDE_SPACE = tuple("\x1c\x1d\x1e\x1f\x85\xa0                　")
_CONTROL = _WIDE_SPACE[:4]
#: White space with the letters after it, up to an ASCII letter that a letter or apostrophe doesn't follow; else with all up to the next white space.
_SPACED = re.compile(rb"[\x20\x09-\x0d]*[A-Za-z\x80-\xff]*[A-Za-z](?![A-Za-z\x80-\xff'])|[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
_BARE = re.compile(rb"[A-Za-z\x80-\xff]*[A-Za-z](?![A-Za-z\x80-\xff'])|[^\x20\x09-\x0d]+")
#: Anything but single spaces and single line feeds between words, and characters that need the library's own splitter.
_IRREGULAR = f"^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x0b\x0c\x00{''.join(_WIDE_SPACE)}]"
_FIRST = "\0"  # marks the first word of a text, which has no space before it


class Kept(dict):
    """piece -> ids; asks for a piece that it doesn't have. At most ``2 * limit`` short pieces, those used last."""

    def __init__(self, learn: Callable[[bytes], bytes], limit: int):
        self.learn, self.limit, self.older = learn, limit, {}

    def __missing__(self, key: bytes) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.learn(key)
        if len(key) <= 32:  # long ones aren't worth keeping
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class WordTable:
    """Ids of words under their 64-bit hashes, in arrays: about 30 bytes a word, at most ``limit`` words or those of one batch."""

    def __init__(self, learn: Callable[[str], bytes], dtype: str, limit: int):
        self.learn, self.dtype, self.limit = learn, dtype, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat, self.used = np.empty(0, self.dtype), np.empty(0, bool)

    def _shrink(self) -> None:
        """Only what was asked for since the last time stays."""
        keep = self.used
        if keep.sum() > self.limit // 2:
            return self._clear()
        n = self.n[keep].astype(np.int64)
        self.flat = self.flat[np.repeat(self.at[keep] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        self.keys, self.n, self.at = self.keys[keep], self.n[keep], np.cumsum(n) - n
        self.used = np.zeros(len(self.keys), bool)

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first place in ``flat``, number of ids) of each of distinct words."""
        h = np.fromiter(map(hash, words), np.int64, len(words))
        if len(self.keys) + len(words) > self.limit and len(self.keys):
            self._shrink()
        place = np.searchsorted(self.keys, h)
        hit = np.zeros(len(h), bool)
        inside = place < len(self.keys)
        hit[inside] = self.keys[place[inside]] == h[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            new = new[np.argsort(h[new], kind="stable")]
            learned = [self.learn(words[i]) for i in new.tolist()]
            ids = np.frombuffer(b"".join(learned), self.dtype)
            n = np.fromiter(map(len, learned), np.int32, len(learned)) // np.dtype(self.dtype).itemsize
            where = place[new]
            self.keys = np.insert(self.keys, where, h[new])
            self.at = np.insert(self.at, where, len(self.flat) + np.cumsum(n, dtype=np.int64) - n)
            self.n = np.insert(self.n, where, n)
            self.used = np.insert(self.used, where, True)
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.keys, h)
        self.used[place] = True
        return self.at[place], self.n[place]


class PieceEncoder:
    """``encode_all(texts)``: ids of each as little-endian unsigned ints of ``width`` bytes.

    keeps_space: pieces carry their leading white space (byte-level
    vocabularies); otherwise white space separates and is dropped, and the
    vocabulary is of lower case.

    A piece that is a run of Latin letters, with one space before it at most,
    is one unit of the merge model, so it goes to the library's model directly;
    every other piece goes through the library's whole chain.
    """

    def __init__(self, path: str, width: int, keeps_space: bool, cache: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width, self.keeps_space = width, keeps_space
        self.pattern = _SPACED if keeps_space else _BARE
        self.pieces = Kept(self._learn, 20_000)
        self.words = WordTable(self._word, f"<u{width}", cache)
        self.pack = [struct.Struct(f"<{n}{'HI'[width == 4]}").pack for n in range(65)]
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.alphabet = [b if b in shown else next(hidden) for b in range(256)]
        self.space = chr(self.alphabet[32])
        self.line_feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def _learn(self, piece: bytes) -> bytes:
        spaced = self.keeps_space and piece[:1] == b" "
        word = piece[1:] if spaced else piece
        if len(piece) > 64:
            return self._whole(piece.decode())
        if word.isalpha():  # of ASCII
            unit = word.decode() if self.keeps_space else word.lower().decode()
        else:
            text = word.decode()
            unit = text if self.keeps_space else text.lower()
            # Letters below U+0250 are composed already, and of one case each but for the dotted I, which isn't all letters then.
            if not text or not unit.isalpha() or max(text) >= "ɐ":
                return self._whole(piece.decode())
            unit = unit.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(self.space + unit if spaced else unit)]
        return self.pack[len(ids)](*ids)

    def _parts(self, raw: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(raw)))

    def _word(self, word: str) -> bytes:
        """A run without spaces. Where pieces keep their white space it has one space before it, unless it begins with a line feed or _FIRST."""
        if not word:
            return b""
        raw = word.encode()
        if self.keeps_space and word[0] in "\n" + _FIRST:
            return (self.line_feed if word[0] == "\n" else b"") + self._parts(raw[1:])
        if self.keeps_space:
            raw = b" " + raw
        bare = raw.strip(b" .,!?")
        if bare.isalpha() and len(raw) <= 64 and len(raw) - len(bare) - self.keeps_space in (0, 1) and raw.startswith(bare, self.keeps_space):
            end = raw[len(bare) + self.keeps_space :]
            return self._learn(raw[: len(raw) - len(end)]) + (self.pieces[end] if end else b"")
        return self._parts(raw)

    def _split(self, texts: pa.Array) -> list[bytes]:
        """Ids of regular texts: every distinct word of the batch is looked up once."""
        if self.keeps_space:
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), texts, pa.scalar("", pa.large_string())), "\n", " \n"), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        at, n = self.words.find(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = words.indices.to_numpy(zero_copy_only=False)
        size = n[code].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.words.flat[np.repeat(at[code] - ends + size, size) + np.arange(int(size.sum()))]
        cut = np.append(0, ends)[np.append(0, np.cumsum(each))] * self.width
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        column = pa.array(texts, pa.large_string())
        if not self.keeps_space:
            return self._split(column)
        odd = pc.match_substring_regex(column, _IRREGULAR).to_numpy(zero_copy_only=False) | (pc.binary_length(column).to_numpy(zero_copy_only=False) == 0)
        found = iter(self._split(column.filter(pa.array(~odd))))
        return [self._odd(t) if o else next(found) for t, o in zip(texts, odd.tolist(), strict=True)]

    def _odd(self, text: str) -> bytes:
        wide = any(c in text for c in (_CONTROL if text.isascii() else _WIDE_SPACE))
        return (self._whole(text) if wide else self._parts(text.encode())) if text else b""

    def batches(self, texts: Iterable[str | None], most: int = 1 << 21) -> Iterator[bytes]:
        """As ``encode_all``, over about ``most`` characters at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= most or len(held) >= 5000:
                yield from self.encode_all(held)
                held, size = [], 0
        yield from self.encode_all(held)

    def column(self, texts: pa.Array, most: int = 1 << 21) -> Iterator[bytes]:
        """As ``encode_all`` for a vocabulary that drops white space, over about ``most`` bytes at a time; texts needn't become Python strings."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield from self._split(texts.slice(at, after - at))
            at = after


def _kept_encoder(path: str, width: int, keeps_space: bool) -> PieceEncoder:
    """One encoder a vocabulary for the life of a Python worker; functions may reach it by value, so it hangs on a module of its own."""
    held = sys.modules.setdefault("_attesta_encoders", types.ModuleType("_attesta_encoders")).__dict__
    key = f"{path}:{width}:{keeps_space}"
    if key not in held:
        held[key] = PieceEncoder(path, width, keeps_space)
    return held[key]


def byte_bpe(path: str) -> PieceEncoder:
    return _kept_encoder(path, 4, keeps_space=True)


def word_bpe(path: str) -> PieceEncoder:
    return _kept_encoder(path, 2, keeps_space=False)
