"""Encoding with public tokenizer files, cached by word.

The tokenizers library encodes each distinct word once per worker; a text's ids are the concatenation of its words'
ids. That equals encoding the whole text because the cuts lie where the tokenizer's own splitting must cut:

* mode ``dropped`` (white space never enters a token): at blanks and line feeds;
* mode ``leading`` (a word carries the blank before it): at a single blank between two characters that are not white
  space; around other white space the text stays in one piece, but single line feeds between such characters are cuts
  and pieces of their own where a text has no other white space;
* mode ``whole``: no cuts, for any other tokenizer.

Texts go through in batches: Arrow splits them and numbers the distinct words, the cache or the library gives each
distinct word's ids once, and NumPy gathers them. A word's entry never depends on what was met before it.

Ids are those that the library gives for the file as it is: the string of a special token in a text becomes its id, and such a
text is encoded whole. With ``plain_specials`` these strings are ordinary text.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_OTHER_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
#: In a batch blanks part the words; a head is a word without a blank before it, an inner blank belongs to its word.
_HEAD, _INNER, _ALONE = "\x01", "\x02", "\x00"
#: Latin and Cyrillic letters that stay letters, one for one, when composed and lowered. Others go to the library word by word.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-žЀ-ҁҊ-ԯ"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_LOWERED_OTHERWISE = re.compile(f"[^\\x00-\\x7f{_LETTERS}]")
#: Letters, then signs that are a piece of their own after letters.
_STEM = re.compile(f"([{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]+)")
#: What an entry of the cache takes besides its ids and as many characters.
_ENTRY = 160
#: Characters of a batch, and words that go through the library as one text.
BATCH_CHARS = 4 << 20
_TOGETHER = 4096


#: The letter that stands for each byte in byte-level models: printable ones for themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTER = dict(zip([b for b in range(256) if b not in _PRINTED], range(256, 512)))


def _byte_letters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTER)


class Encoder:
    def __init__(self, path: str, mode: str = "whole", most_bytes: int = 280 << 20, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        self.special = [] if plain_specials else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab <= 65536 else "<u4")
        self._batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.most, self.words, self.old, self.size = most_bytes, {}, {}, 0
        # tokens that begin a word tell apart the words of a text that go through the library together
        self.edge = np.zeros(self.vocab, bool)
        for token, at in self.tok.get_vocab(with_added_tokens=False).items():
            self.edge[at] = token.startswith("Ġ")
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.lowers = mode == "dropped" and ids("ABÉ Ж") == ids("abé ж") != ids("")
        self.mode, self.blank = mode, "" if mode == "dropped" else " "
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else -1  # the id of a line feed

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self._batch(texts, add_special_tokens=False)]

    def _marked(self, text: str) -> str:
        """The text with its words parted by blanks."""
        if self.mode == "whole" or any(x in text for x in self.special):
            return _HEAD + text.replace(" ", _INNER)
        if self.mode == "dropped":
            # such a tokenizer lowers its text; where that is one letter for one, fewer words are distinct
            if self.lowers and (text.isascii() or not _LOWERED_OTHERWISE.search(text)):
                low = text.lower()
                text = text if any(x in low for x in self.special) else low
            return text.replace("\n", " ")
        # is all white space single blanks and line feeds between other characters?
        pairs = "  " in text or "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text)
        other = any(x in text for x in _OTHER_ASCII) if text.isascii() else _OTHER_SPACE.search(text)
        if not (pairs or other or text[0].isspace() or text[-1].isspace()):
            return _HEAD + text.replace("\n", f" {_HEAD}\n {_HEAD}")
        return _HEAD + " ".join(x.replace(" ", _INNER) for x in _SAFE_BLANK.split(text))

    def _library(self, key: str) -> str:
        """What the library gets for a word."""
        return key[1:].replace(_INNER, " ") if key[:1] == _HEAD else self.blank + key.replace(_INNER, " ")

    def _fill(self, new: list[str]) -> None:
        """Adds distinct words that the cache lacks."""
        if self.size > self.most // 2:  # words not met since the last turn go, the others move over as they are met
            self.words, self.old, self.size = {}, self.words, 0
        before = list(map(self.old.get, new))
        if any(before):
            self._add([w for w, ids in zip(new, before) if ids], [ids for ids in before if ids])
            new = [w for w, ids in zip(new, before) if not ids]
        plain = [w for w in new if w.isalpha() and (w.isascii() or _PLAIN.fullmatch(w))]
        done = set(plain)
        others = [w for w in new if w not in done] if len(plain) < len(new) else []
        match = list(map(_STEM.fullmatch, others))
        words, stems, signs = [w for w, m in zip(others, match) if m], [m[1] for m in match if m], [m[2] for m in match if m]
        left = self._together([*plain, *set(stems).difference(self.words).difference(done)])
        left += self._heads([w for w, m in zip(others, match) if not m])
        self._add(left, self._raw([self._library(w) for w in left]))
        tails = list(set(signs))
        tail = dict(zip(tails, self._raw(tails)))
        self._add(words, [self.words[s] + tail[t] for s, t in zip(stems, signs)])

    def _add(self, words: list[str], ids: list[bytes]) -> None:
        self.words.update(zip(words, ids))
        self.size += sum(map(len, words)) + sum(map(len, ids)) + _ENTRY * len(words)

    def _heads(self, words: list[str]) -> list[str]:
        """Adds plain words that begin a line, as lines of one text; returns the words that are none or can't be told apart."""
        if self.blank != " ":
            return words
        found = [bool(w[:1] == _HEAD and (_PLAIN.fullmatch(w, 1) or _STEM.fullmatch(w, 1))) for w in words]
        heads, left = [w for w, x in zip(words, found) if x], [w for w, x in zip(words, found) if not x]
        for at in range(0, len(heads), _TOGETHER):
            some = heads[at:at + _TOGETHER]
            ids = np.frombuffer(self._raw(["\n".join(w[1:] for w in some)])[0], self.dtype)
            feed = np.flatnonzero(ids == self.feed) if self.feed >= 0 else []
            if len(feed) == len(some) - 1:
                self._add(some, [x[1 if k else 0:].tobytes() for k, x in enumerate(np.split(ids, feed))])
            else:
                left += some
        return left

    def _together(self, plain: list[str]) -> list[str]:
        """Adds words of letters, each a single piece; returns those that can't be told apart by their edges in one text."""
        if self.mode == "dropped" and not self.lowers:
            return plain
        if self.lowers:  # such a piece is the lowered word, and the library's model takes it as it is
            piece = self.tok.model.tokenize
            low = [w.lower() for w in plain]
            of = {w: np.array([t.id for t in piece(_byte_letters(w))], self.dtype).tobytes() for w in set(low)}
            self._add(plain, [of[w] for w in low])
            return []
        left = []
        for at in range(0, len(plain), _TOGETHER):
            some = plain[at:at + _TOGETHER]
            ids = np.array(self._batch([self.blank + " ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            edge = np.flatnonzero(self.edge[ids])
            raw, k = ids.tobytes(), self.dtype.itemsize
            bounds = (np.concatenate([edge, [len(ids)]]) * k).tolist()
            if len(edge) == len(some) and bounds[0] == 0 and bounds[-1] == len(raw):
                self._add(some, [raw[a:b] for a, b in zip(bounds, bounds[1:])])
            else:
                left += some
        return left

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each text's begin and end; null counts as empty."""
        rows, owner, alone = [], [], {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if _HEAD in text or _INNER in text or _ALONE in text:  # has a character that marks words here
                alone[key := f"{_HEAD}{_ALONE}{k}"] = self._raw([text])[0]
                rows.append(key), owner.append(k)
                continue
            marked, at = self._marked(text), 0
            while len(marked) - at > BATCH_CHARS and (cut := marked.find(" ", at + BATCH_CHARS)) > 0:
                rows.append(marked[at:cut]), owner.append(k)
                at = cut + 1
            rows.append(marked[at:] if at else marked), owner.append(k)
        counts = np.zeros(len(texts) + 1, np.int64)
        parts = []
        for lo, hi in _runs(rows):
            flat, n = self._some(rows[lo:hi], alone)
            parts.append(flat)
            np.add.at(counts, np.array(owner[lo:hi]) + 1, n)
        return np.concatenate(parts) if parts else np.empty(0, self.dtype), np.cumsum(counts)

    def _some(self, rows: list[str], alone: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of marked texts and how many each has."""
        split = pc.split_pattern(pa.array(rows, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.words.get, words))
        new = [w for w, ids in zip(words, got) if ids is None]
        if new:
            ahead = [w for w in new if w not in alone]
            if ahead:
                self._fill(ahead)
                # a turn of the cache may have put away words that were found before
                now = self.words
                got = [ids if ids is not None else now.get(w) for w, ids in zip(words, got)]
            got = [ids if ids is not None else alone[w] for w, ids in zip(words, got)]
        code = coded.indices.to_numpy()
        size = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(got), self.dtype)
        each = size[code]
        end = np.cumsum(each)
        total = int(end[-1]) if len(end) else 0
        at = np.repeat(start[code] - (end - each), each)
        at += np.arange(total)
        bounds = np.concatenate([[0], end])[split.offsets.to_numpy()]
        return flat[at], np.diff(bounds)

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of a text; null counts as empty."""
        return self.batch([text])[0]


def _runs(rows: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BATCH_CHARS`` characters."""
    lo, size = 0, 0
    for k, row in enumerate(rows):
        size += len(row)
        if size >= BATCH_CHARS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(rows):
        yield lo, len(rows)


def by_size(rows, text, most: int = BATCH_CHARS):
    """Lists of rows whose texts have about ``most`` characters together; ``text`` gives a row's."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(text(row) or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


@functools.lru_cache(1)
def shared(path: str, mode: str) -> Encoder:
    """The worker's encoder: the words of one task serve the next."""
    return Encoder(path, mode)


def forget() -> None:
    """Gives the worker's memory back when a job encodes no more."""
    import gc

    shared.cache_clear()
    gc.collect()  # an encoder holds its own method and so itself
    trim()


def trim() -> None:
    """Returns freed memory to the system, as workers live on beside an executor's heap, and has Arrow's do so at once."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
