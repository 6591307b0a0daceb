"""The tokenizers library behind a cache of words, so that a repeated word is encoded once per Python worker.

Both vocabularies cut a text at white space before pairs are merged: the byte-level one cuts wherever white space follows
another character (the white space goes with what comes after it), the word-level one drops white space. So a text's ids are
those of its words in turn. Arrow splits a batch into words and numbers the distinct ones; the cache maps each of those to a
slice of known ids; numpy then gathers the slices. A new word goes to the library's model when it is letters with punctuation
after them, and through the whole library otherwise. Texts in which a word's ids could depend on its neighbours (runs
of white space, the vocabulary's special markers) go to the library whole, so ids are those of the library as it stands; with
markers=False a marker in a text is text like any other.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MOST_WORDS, MOST_IDS = 300_000, 1 << 23  # kept per worker; then the cache starts anew
BATCH_BYTES = 6 << 20  # of text that is encoded at once
MARKS = ".,;:!?\"'()[]-*&$%#@/|"


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: printable Latin-1 as itself, the others from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


SPELT = "".join(_byte_letters()[b] for b in range(256))


def buffered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """The same rows in batches of about `most` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size or held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = None
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task should not keep what this one needed


class WordCache:
    def __init__(self, path: str, markers: bool = True):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not markers
        self.markers = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()] if markers else []
        self.model = self.tok.model
        self.tails: dict[str, list[int]] = {"": []}  # runs of MARKS after a word: few and short
        self.clear()

    def clear(self) -> None:
        """words: the number of each word that is known; first and size: its slice of ids. Number 0 is no ids at all."""
        self.words: dict[str, int] = {"": 0}
        self.first, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _direct(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _model(self, letters: str, lead: str = "") -> list[int]:
        if not letters.isascii():
            letters = codecs.charmap_decode(letters.encode(), "strict", SPELT)[0]
        return [x.id for x in self.model.tokenize(lead + letters)]

    def _tail(self, marks: str) -> list[int]:
        found = self.tails.get(marks)
        if found is None:
            found = self._model(marks)
            if len(marks) <= 3:
                self.tails[marks] = found
        return found

    def _word(self, word: str) -> list[int]:
        raise NotImplementedError

    def _add(self, found: list[list[int]]) -> None:
        """Appends the ids of new words, in the order of their numbers."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.first = np.append(self.first, self.used + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.used += len(flat)

    def numbers(self, words: list[str], make=None) -> np.ndarray:
        """The number of each word; new ones are encoded."""
        known, get = self.words, self.words.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = list(dict.fromkeys(words[k] for k in np.flatnonzero(out < 0).tolist()))
        if new:
            n, make = len(self.first), make or self._word
            self._add([make(w) for w in new])
            known.update(zip(new, range(n, n + len(new)), strict=True))
            miss = np.flatnonzero(out < 0)
            out[miss] = [known[words[k]] for k in miss.tolist()]
        return out

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.first[numbers] - ends + size, size) + np.arange(n)]

    def _split(self, texts: pa.Array) -> pa.ListArray:
        raise NotImplementedError

    def _fit(self, numbers: np.ndarray, begins: np.ndarray, ends: np.ndarray, code: np.ndarray, distinct: list[str], texts: pa.Array) -> None:
        """Mends the numbers of words that stand in special places."""

    def _whole(self, numbers: np.ndarray, begin: int, end: int, text: str) -> None:
        """The words from begin to end become one entry: the whole text's ids by the library."""
        self._add([self._direct(text)])
        numbers[begin:end] = 0
        numbers[begin] = len(self.first) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and each text's number of ids."""
        if len(self.words) > MOST_WORDS or self.used > MOST_IDS:
            self.clear()
        texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        split = self._split(texts)
        at = np.asarray(split.offsets).astype(np.int64)
        flat = split.values.slice(at[0], at[-1] - at[0])
        at -= at[0]
        coded = flat.dictionary_encode()
        distinct, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64)
        numbers = self.numbers(distinct)[code]
        self._fit(numbers, at[:-1], at[1:], code, distinct, texts)
        if self.markers:
            lower = pc.utf8_lower(texts)
            marked = np.logical_or.reduce([np.asarray(pc.match_substring(lower, m)) for m in self.markers])
            for k in np.flatnonzero(marked & (np.diff(at) > 0)).tolist():
                self._whole(numbers, at[k], at[k + 1], texts[k].as_py())
        ends = np.append(0, np.cumsum(self.size[numbers]))[at]
        return self.gather(numbers), np.diff(ends)


class ByteLevel(WordCache):
    """A word keeps the one space before it. Keys that start with a space are chunks of other kinds: "  x" is x itself."""

    def __init__(self, path: str, markers: bool = True):
        super().__init__(path, markers)
        self.line_end = self._direct("\n")

    def _split(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    def _chunk(self, lead: str, word: str) -> list[int]:
        letters = word.rstrip(MARKS)
        if letters.isalpha():
            tail = word[len(letters) :]
            return self._model(letters, "Ġ" if lead else "") + self._tail(tail)
        a, cut, b = word.partition("\n")
        if cut and a and b and not a[-1].isspace() and not b[0].isspace():
            return self._chunk(lead, a) + self.line_end + self._chunk("", b)
        return self._direct(lead + word)

    def _word(self, word: str) -> list[int]:
        return self._chunk(" ", word) if word and not word[-1].isspace() else []

    def _fit(self, numbers, begins, ends, code, distinct, texts) -> None:
        risky = np.fromiter((not w or w[-1].isspace() for w in distinct), bool, len(distinct))[code]  # before another word they would run into its space
        risky[begins[[not distinct[c] for c in code[begins].tolist()]]] = False  # a text may begin with one space, or be empty
        last = np.flatnonzero(risky[ends - 1] & (ends - begins > 1))
        risky[ends - 1] = False
        heads = [distinct[c] for c in code[begins].tolist()]
        numbers[begins] = self.numbers(["  " + h if h else "" for h in heads], lambda k: self._direct(k[2:]) if k[-1].isspace() else self._chunk("", k[2:]))
        if len(last):  # white space at a text's end stays with its last word
            numbers[ends[last] - 1] = self.numbers(["   " + distinct[c] for c in code[ends[last] - 1].tolist()], lambda k: self._direct(k[2:]))
        whole = np.flatnonzero(np.add.reduceat(risky, begins)) if len(begins) else []
        for k in whole:
            self._whole(numbers, begins[k], ends[k], texts[int(k)].as_py())


class WordLevel(WordCache):
    """White space is dropped; words in other than ASCII white space go through the whole library."""

    def _split(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(pc.ascii_lower(texts))

    def numbers(self, words: list[str], make=None) -> np.ndarray:
        self.fresh: dict[str, list[int]] = {}  # ids of the letters of this call's new words: many differ in the marks after them alone
        try:
            return super().numbers(words, make)
        finally:
            self.fresh = {}

    def _word(self, word: str) -> list[int]:
        plain = word.lower() if word.isascii() or max(word) < "\u0250" else self.tok.normalizer.normalize_str(word)  # Latin letters below are as they are composed, and have one lower case
        letters = plain.rstrip(MARKS)
        if letters.isalpha() and not ("'" in plain and plain[len(letters) :] != "'"):
            tail, ids = plain[len(letters) :], self.fresh.get(letters)
            if ids is None:
                known = self.words.get(letters, -1)
                ids = self.fresh[letters] = self._model(letters) if known < 0 else self.ids[self.first[known] : self.first[known] + self.size[known]].tolist()
            return ids + self._tail(tail) if tail else ids
        return self._direct(word)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every text with end_id after them, and the new sizes."""
    return np.insert(ids, np.cumsum(sizes), end_id).astype("<u4"), sizes + 1


_made: dict[tuple[type, str, bool], WordCache] = {}


def encoder(kind: type[WordCache], path: str, markers: bool = True) -> WordCache:
    """One encoder per Python worker."""
    if (kind, path, markers) not in _made:
        _made[kind, path, markers] = kind(path, markers)
    return _made[kind, path, markers]
