"""Token ids of whole texts, as the tokenizers library gives them, with a cache of word pieces."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Texts within these code points take the cached path; in this range the white space,
#: letter and number classes of all the libraries involved are the same.
_BEYOND = re.compile("[^\x00-ɏ]")
#: A space that does not stand before a visible character.
_UNCLEAR = re.compile("[ ](?![^\\s\x1c-\x1f])")
#: A word, the marks behind it with line ends that follow, and a word after those: in these letters each is a piece.
_ENDS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@]+\n?)(?:(?<=\n)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+))?").fullmatch
_LOADED: dict[str, "Encoder"] = {}


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level BPE vocabularies: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


class _Cache(dict):
    """Text part -> its ids as bytes, found on first use; emptied when it has ``limit`` parts."""

    def __init__(self, find, limit: int, marks: dict | None = None):
        super().__init__()
        self.find, self.limit = find, limit
        self.marks = self if marks is None else marks

    def __missing__(self, part: str) -> bytes:
        if part[:-1].isalpha() and not part[-1].isalpha():  # a word and a mark: two lookups, not kept
            return self[part[:-1]] + self.marks[part[-1]]
        ids = self.find(part)
        if len(part) <= 64:
            self.keep(part, ids)
        return ids

    def keep(self, part: str, ids: bytes) -> None:
        if len(self) >= self.limit:
            self.clear()
        self[part] = ids


class Encoder:
    """Byte-level BPE ids of a text, with no special tokens read or added.

    The library cuts a text into word pieces before it merges bytes, and merges
    never cross pieces, so the ids of a text are those of its pieces in order.  A
    space before a visible character always opens a piece, so a text is cut there
    first; parts and pieces seen before come from caches, and the library's model
    merges every other piece.  Texts with rarer scripts go to the library whole.
    """

    def __init__(self, path: str, limit: int = 300_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.blank = self.letters[ord(" ")]  # ASCII letters stand for themselves
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.first = _Cache(self._unspaced, limit)
        self.spaced = _Cache(self._spaced, 2 * limit, self.first)

    def _spaced(self, part: str) -> bytes:
        """Ids of a part with the space before it; a plain word is one piece."""
        if part.isalpha():
            return self._merged(self.blank + part) if part.isascii() else self._piece(" " + part)
        return self._joined(self.split(" " + part))

    def _unspaced(self, part: str) -> bytes:
        return self._piece(part) if part.isalpha() or len(part) == 1 else self._joined(self.split(part))

    def _joined(self, pieces: list[str]) -> bytes:
        if len(pieces) == 1:
            return self._piece(pieces[0])
        spaced, first = self.spaced, self.first
        return b"".join([spaced[p[1:]] if p[0] == " " and len(p) > 1 and p[1] not in " \n" else first[p] for p in pieces])

    def _piece(self, piece: str) -> bytes:
        return self._merged(piece.encode().decode("latin-1").translate(self.letters))

    def _merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def raw(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes (on the little-endian machines Spark runs on); a null text counts as empty."""
        if not text:
            return b""
        if not text.isascii() and _BEYOND.search(text):
            return self._whole(text)
        if _UNCLEAR.search(text):
            return self.first[text]
        parts = text.split(" ")
        parts[0], rest = self.first[parts[0]] if parts[0] else b"", parts[1:]
        return parts[0] + b"".join(map(self.spaced.__getitem__, rest))

    def all_raw(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts in one row, each text's followed by ``end``, and how many each has.

        The texts' parts are numbered in Arrow, so each different one is looked up
        once; texts that ``raw`` does not cut at spaces go through it one by one.
        """
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        edges = np.asarray(cut.offsets)
        words = cut.flatten().dictionary_encode()
        which, different = words.indices.to_numpy().copy(), words.dictionary.to_pylist()
        starts, rare, spaced, first, merge, blank = edges[:-1], np.zeros(len(different), bool), self.spaced, self.first, self.merge, self.blank
        ids = list(map(spaced.get, different))
        rest = []
        for k, known in enumerate(ids):
            if known is None:
                w = different[k]
                if w.isalpha() and w.isascii():  # most of the parts that are new: one piece
                    ids[k] = found = array("I", [t.id for t in merge(blank + w)]).tobytes()
                    if len(w) <= 64:
                        spaced.keep(w, found)
                else:
                    rest.append(k)
        for k in rest:  # words among them are known by now
            w = different[k]
            if ends := _ENDS(w):
                word, marks, after = ends.groups()
                ids[k] = spaced[word] + first[marks] + (first[after] if after else b"")
            else:
                rare[k] = not w or w[0].isspace() or not w.isascii() and _BEYOND.search(w) is not None
                ids[k] = b"" if rare[k] else spaced[w]
        opening = [different[k] for k in which[starts].tolist()]
        whole = rare[which]
        whole[starts] = [not w.isascii() and _BEYOND.search(w) is not None for w in opening]
        whole = np.logical_or.reduceat(whole, starts)
        own = [self.raw(texts[k].as_py()) if whole[k] else self.first[w] if w else b"" for k, w in enumerate(opening)]
        # opening parts stand behind the others, then what is nothing and what ends a text
        text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(edges))
        which[whole[text]] = len(ids) + len(own)
        which[starts] = len(ids) + np.arange(len(own))
        order = np.full(len(which) + len(texts), len(ids) + len(own) + 1, which.dtype)
        text += np.arange(len(which), dtype=np.int32)
        order[text] = which
        joined = pa.array([*ids, *own, b"", end], pa.large_binary()).take(pa.array(order))
        offsets = np.frombuffer(joined.buffers()[1], np.int64, len(order) + 1)
        stops = offsets[edges[1:] + np.arange(len(texts)) + 1]
        data = joined.buffers()[2]
        return np.frombuffer(data, "<u4", stops[-1] // 4) if stops[-1] else np.zeros(0, "<u4"), np.diff(stops, prepend=0) // 4


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
