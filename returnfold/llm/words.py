"""Exact token ids of whole texts, made word by word in Arrow batches.

Texts repeat their words, so each worker encodes a new word once and then looks it up: Arrow
lower-cases, splits and numbers the words of a batch, and only its distinct words reach Python.
For the tokenizers handled here white space always separates tokens, and letter case is folded,
so the ids of a text are those of its words put together.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file that the box offers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Ragged:
    """Rows of integers, one after another; grows."""

    def __init__(self, kind: str = "i"):
        self.flat, self.ends = array(kind), array("q", [0])

    def add(self, row) -> int:
        self.flat.extend(row)
        self.ends.append(len(self.flat))
        return len(self.ends) - 2

    def extend(self, flat: np.ndarray, ends: np.ndarray) -> int:
        """Adds several rows, ends being counted from flat's start; returns the first one's number."""
        first, base = len(self.ends) - 1, len(self.flat)
        self.flat.frombytes(flat.astype(np.dtype(self.flat.typecode)).tobytes())
        self.ends.frombytes((ends + base).astype(np.int64).tobytes())
        return first

    def row(self, i: int) -> list[int]:
        return self.flat[self.ends[i] : self.ends[i + 1]].tolist()

    def gather(self, rows: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """All integers of these rows, and how many each has; at_once rows are worked out together, so that places take little memory."""
        bounds, flat = (np.frombuffer(x, x.typecode) if x else np.empty(0, x.typecode) for x in (self.ends, self.flat))
        n = bounds[rows + 1] - bounds[rows]
        out, done = np.empty(n.sum(), flat.dtype), 0
        for k in range(0, len(rows), at_once):
            part = n[k : k + at_once]
            ends = np.cumsum(part)
            at = np.arange(ends[-1])
            at += np.repeat(bounds[rows[k : k + at_once]] - (ends - part), part)
            out[done : done + len(at)] = flat[at]
            done += len(at)
        return out, n


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, a code for each word of all texts, and the number of words of each text."""
    texts = pc.ascii_lower(texts) if lower else texts
    words = pc.ascii_split_whitespace(texts)
    counts = np.asarray(pc.list_value_length(words), dtype=np.int64)
    coded = words.flatten().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), counts


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class Memo:
    """Row numbers of words met before, in order; takes some ten bytes a word."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, words: pa.Array) -> None:
        self.parts.append(words)
        self.n += len(words)
        if len(self.parts) > 1 and (len(self.parts) > 64 or self.parts[-1].nbytes > self.parts[-2].nbytes):
            self.parts = [pa.concat_arrays(self.parts)]

    def find(self, words: pa.Array) -> pa.Array:
        """Row of each word, null where it is new."""
        if not self.parts:
            return pa.nulls(len(words), pa.int32())
        if len(self.parts) > 1:
            self.parts = [pa.concat_arrays(self.parts)]
        return pc.index_in(words, value_set=self.parts[0])


class WordIds:
    """Encodes with a lower-casing, white-space-dropping byte-level tokenizer file of the tokenizers library.

    Equal to encode(text, add_special_tokens=False).ids: white space matches no alternative of the
    splitting pattern, so it always ends a token; a word of Latin letters alone is one piece, and a
    full stop or comma that ends it is another. Such words go to the library joined by spaces, in lower
    case and in the byte-level alphabet, so that it only has to merge; other words go to it one by one,
    and texts with "<|", which may hold special tokens, whose case matters, whole. most_words bounds
    the memo, which starts anew when full.
    """

    #: Words of precomposed Latin letters, whose lower case no normaliser changes, and perhaps a mark.
    PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u024f]+[.,]?$"
    #: Its lower case is two characters in one library and one in another.
    UNLIKE = "\u0130"
    #: The byte-level alphabet shows bytes that Latin-1 can't print as the characters from U+0100 on, after those for 0-32 and 127.
    SHOWN = {b: 0x100 + 34 + i for i, b in enumerate([*range(0x80, 0xA1), 0xAD])}

    def __init__(self, path: str, most_words: int = 1_500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core; the library's threads each keep memory that a worker never gives back
        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer(self.tokenizer.model)  # shares the vocabulary
        self.merger.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        suffix = self.merger.model.end_of_word_suffix
        self.is_end = np.array([(self.merger.id_to_token(i) or "").endswith(suffix) for i in range(self.merger.get_vocab_size())]) if suffix else None
        self.most_words = most_words
        self.reset()

    def reset(self) -> None:
        self.memo, self.rows = Memo(), Ragged()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, words: list[str], at_once: int = 30_000) -> None:
        """Adds rows for plain words, a space before their marks; the library keeps some hundred bytes a token meanwhile."""
        if len(words) > at_once:
            for at in range(0, len(words), at_once):
                self._merge(words[at : at + at_once])
            return
        marks = np.array([" " in w for w in words], np.int64)
        ids = np.array(self.merger.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words) + marks.sum():
            raise ValueError("a word's last token has no end mark")
        self.rows.extend(ids, ends[np.cumsum(marks + 1) - 1])

    def _add(self, new: pa.Array) -> np.ndarray:
        """Adds new words; returns their rows."""
        lower = pc.utf8_lower(new)
        plain = pc.and_(pc.match_substring_regex(lower, self.PLAIN), pc.invert(pc.match_substring(new, self.UNLIKE)))
        if self.is_end is None:
            plain = pa.array(np.zeros(len(new), bool))
        cut = pc.replace_substring_regex(lower, "([.,])$", r" \1")
        ascii = pc.string_is_ascii(new)
        rows = np.empty(len(new), np.int64)
        for mask, add in ((pc.and_(plain, ascii), self._merge), (pc.and_not(plain, ascii), lambda w: self._merge(self._shown(w))), (pc.invert(plain), None)):
            if n := pc.sum(mask).as_py():
                rows[np.asarray(mask)] = np.arange(self.memo.n, self.memo.n + n)
                self.memo.add(new.filter(mask))
                if add:
                    add(strings(cut.filter(mask)))
                else:
                    words = strings(new.filter(mask))
                    for at in range(0, len(words), 5_000):
                        for ids in self.whole(words[at : at + 5_000]):
                            self.rows.add(ids)
        return rows

    def _shown(self, words: list[str]) -> list[str]:
        return "\n".join(words).encode().decode("latin-1").translate(self.SHOWN).split("\n")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another as int32, number of ids of each text); texts without nulls."""
        if self.memo.n > self.most_words:
            self.reset()
        special = np.asarray(pc.match_substring(texts, "<|"))
        words, codes, counts = word_codes(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
        rows = self.memo.find(words)
        row = np.array(pc.fill_null(rows, 0), np.int64)
        if rows.null_count:
            new = pc.is_null(rows)
            row[np.asarray(new)] = self._add(words.filter(new))
        ids, per_word = self.rows.gather(row[codes])
        ends = np.concatenate([[0], np.cumsum(per_word)])
        upto = np.concatenate([[0], np.cumsum(counts)])
        n = ends[upto[1:]] - ends[upto[:-1]]
        if special.any():
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i, more in zip(np.flatnonzero(special), self.whole([texts[int(i)].as_py() for i in np.flatnonzero(special)])):
                parts[i], n[i] = np.array(more, np.int32), len(more)
            ids = np.concatenate(parts)
        return ids.astype(np.int32, copy=False), n
