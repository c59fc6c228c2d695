"""Token ids of whole texts by the tokenizers library, with a table of the ids of words.

The tokenizer lower-cases, and its pattern cuts a text into runs of letters, single digits, runs of other characters
without white space, and an apostrophe with certain letters after it. For texts in Latin-1 this is done for a whole batch
with numpy: runs of one class of characters (a lone apostrophe goes with the letters after it) are looked up by their
bytes; those the table lacks go through the library (words of letters straight to its model) and into the table. Other texts, and those with "<|" (which may begin
a special token) or a control character that Python and the tokenizer see differently, go through the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from arborq.llm import bytewords

#: log2 of the table's slots, and the words after which it starts anew.
TABLE_BITS, TABLE_WORDS = 21, 1_200_000
#: The id after each document.
END_ID = 2
_ODD = re.compile("[\x00\x1c-\x1f]")
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
_CLASSES = np.array([_SPACE if chr(b).isspace() else _LETTER if chr(b).isalpha() else _NUMBER if chr(b).isnumeric() else _OTHER for b in range(256)], np.uint8)
_CLASSES[0x1F] = _END
_APOSTROPHE = ord("'")
#: Byte-level models take printable characters for bytes: those of Latin-1 that are, and 256 and on for the others in turn.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros((1 << TABLE_BITS, bytewords.KEY_BYTES // 8), np.uint64)
        self.values = np.zeros(1 << TABLE_BITS, np.int32)
        self.flat, self.starts, self.lengths = array("H", [END_ID]), array("i", [0]), array("i", [1])

    def _find(self, keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The table's index for each key, -1 where it has none."""
        out = np.full(len(keys), -1, np.int32)
        rows = self.keys.take(slots, 0)
        same = (rows == keys).all(1)
        out[same] = self.values.take(slots[same])
        open_ = np.flatnonzero(~same & (rows[:, 0] != 0))
        while len(open_):
            slots[open_] = slots[open_] + 1 & (1 << TABLE_BITS) - 1
            rows = self.keys.take(slots[open_], 0)
            same = (rows == keys[open_]).all(1)
            out[open_[same]] = self.values.take(slots[open_[same]])
            open_ = open_[~same & (rows[:, 0] != 0)]
        return out

    def _add(self, ids) -> int:
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        return len(self.starts) - 1

    def _encoded(self, words: list[str]) -> list[int]:
        """Indexes of words of lower-case letters: what the pattern leaves whole goes to the library's model as it is, in its characters for bytes."""
        first, model = len(self.starts), self.tokenizer.model
        for w in words:
            ids = [t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))]
            self.starts.append(len(self.flat))
            self.lengths.append(len(ids))
            self.flat.extend(ids)
        return list(range(first, len(self.starts)))

    def _learn(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, hashes: np.ndarray, missing: np.ndarray) -> None:
        _, first = np.unique(hashes[missing], return_index=True)  # of words that share a hash the others come in the next call
        new = missing[first]
        words = [data[a : a + n].decode("latin-1") for a, n in zip(starts[new].tolist(), sizes[new].tolist(), strict=True)]
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        found = dict(zip(letters, self._encoded([words[i] for i in letters]), strict=True))
        found |= {i: self._add(self.tokenizer.encode(words[i], add_special_tokens=False).ids) for i in rest}
        index = np.array([found[i] for i in range(len(new))], np.int32)
        slots, left = (hashes[new] >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.arange(len(new))
        while len(left):  # of those that want one empty slot the first gets it, the others go on to the next
            empty = left[self.keys[slots[left], 0] == 0]
            empty = empty[np.unique(slots[empty], return_index=True)[1]]
            self.keys[slots[empty]] = keys[new[empty]]
            self.values[slots[empty]] = index[empty]
            left = np.setdiff1d(left, empty, assume_unique=True)
            slots[left] = slots[left] + 1 & (1 << TABLE_BITS) - 1

    def _encode_plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """texts: lower-cased, in Latin-1, without zeros and U+001C to U+001F."""
        data = b"\x1f ".join(texts) + b"\x1f " + bytewords.PAD
        arr = np.frombuffer(data, np.uint8)[: len(data) - len(bytewords.PAD)]
        classes = _CLASSES[arr]
        starts, ends = bytewords.runs(classes)
        kind = classes[starts]
        lone = np.flatnonzero((kind[:-1] == _OTHER) & (kind[1:] == _LETTER) & (ends[:-1] - starts[:-1] == 1) & (arr[starts[:-1]] == _APOSTROPHE))
        keep = kind != _SPACE
        ends[lone] = ends[lone + 1]
        keep[lone + 1] = False
        starts, ends, kind = starts[keep], ends[keep], kind[keep]
        sizes = ends - starts
        parts = bytewords.keys(data, starts, sizes)
        hashes = bytewords.key_hash(parts)
        slots = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        keys = np.stack(parts, 1)
        long = np.flatnonzero(sizes > bytewords.KEY_BYTES)
        keys[long] = 0
        found = self._find(keys, slots.copy())
        found[kind == _END] = 0
        for i in long.tolist():
            found[i] = self._add(self.tokenizer.encode(data[starts[i] : ends[i]].decode("latin-1"), add_special_tokens=False).ids)
        while len(missing := np.flatnonzero(found < 0)):
            self._learn(data, starts, sizes, keys, hashes, missing)
            found[missing] = self._find(keys[missing], slots[missing])
        return self._gather(found, np.flatnonzero(kind == _END))

    def _gather(self, found: np.ndarray, ends_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths = np.frombuffer(self.starts, np.int32)[found], np.frombuffer(self.lengths, np.int32)[found]
        flat = np.frombuffer(self.flat, np.uint16)
        ends = np.cumsum(lengths, dtype=np.int32)  # a call has far fewer than 2^31 ids
        places = np.repeat(starts - (ends - lengths), lengths)
        places += np.arange(len(places), dtype=np.int32)
        ids = flat[places]
        sizes = np.diff(np.append(0, ends[ends_of_texts])).astype(np.int64)
        del starts, lengths, flat
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint16 with END_ID after each text, ids of each text with that one). Ids fit 16 bits here."""
        if len(self.starts) > TABLE_WORDS or len(self.flat) > 8 * TABLE_WORDS:
            self._reset()
        plain: list[bytes] = []
        others: list[int] = []
        for i, text in enumerate(texts):
            if "<|" in text or _ODD.search(text):
                others.append(i)
                continue
            try:
                plain.append(text.lower().encode("latin-1") if text.isascii() else text.encode("latin-1").decode("latin-1").lower().encode("latin-1"))
            except UnicodeEncodeError:
                others.append(i)
        ids, sizes = self._encode_plain(plain) if plain else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        if not others:
            return ids, sizes
        # put the two together in order
        own = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        left = set(others)
        parts = [np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, END_ID], np.uint16) if i in left else next(own) for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
