"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A word's symbols are its characters. An agenda holds every adjacent pair whose join is a piece, best
score first and then leftmost; the best pair is joined, and its new neighbours join the agenda.
What no piece covers falls back to the pieces of its UTF-8 bytes.

No piece of such a vocabulary has the space mark after another character, so a text is encoded word
by word, and each distinct word once a worker. Words of one length share their agendas: a row of
scores for each word, of which all rows' best pairs are joined at once; long words have a heap each.
The library checks every new word, and whole texts and their decoding where crc32(text) is divisible
by CHECK_EVERY; a difference raises.

Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole;
repeated rows each get a row, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import documents, sliced, table
from .words import Memo, Ragged, strings, tokenizer_path

#: Fixed value: the mark that stands for a space.
SPACE = "▁"
CHECK_EVERY = 64
#: Longer words have an agenda of their own.
ROW_LENGTH = 48


class MergeCodec:
    def __init__(self, path: str, most_words: int = 1_500_000):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.scores, self.ids, self.bytes = {}, {}, [sp.unk_id()] * 256
        for i in ids:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.scores[piece], self.ids[piece] = sp.get_score(i), i
                if sp.is_unused(i):
                    raise ValueError("vocabularies with unused pieces are not handled")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space mark inside")
        if self.bytes[0] == sp.unk_id():
            raise ValueError("vocabularies without byte fallback are not handled")
        every = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))))
        #: Texts may be cut at spaces and line ends before the library's normaliser has seen them.
        self.plain = sp.normalize(every) == SPACE + every.replace(" ", SPACE) and not any("\n" in p for p in self.ids)
        self._tables(sp)
        self.most_words = most_words
        self.reset()

    def _tables(self, sp) -> None:
        """Numbers of symbols (pieces, and after them characters that are none), joins of two of them, and the bytes that each id stands for."""
        self.n_pieces = sp.get_piece_size()
        self.symbol_of = np.arange(0x110000) + self.n_pieces
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        number = lambda x: self.ids.get(x, self.n_pieces + ord(x) if len(x) == 1 else None)
        joins = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                if (a := number(piece[:k])) is not None and (b := number(piece[k:])) is not None:
                    joins[a << 32 | b] = (i, self.scores[piece])
        keys = np.fromiter(joins, np.int64, len(joins))
        order = np.argsort(keys)
        self.join_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.join_ids = np.append(np.fromiter((i for i, _ in joins.values()), np.int64, len(joins))[order], 0)
        self.join_scores = np.append(np.fromiter((x for _, x in joins.values()), np.float64, len(joins))[order], -np.inf)
        shown = {i: piece.replace(SPACE, " ").encode() for piece, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.shown = pa.array([shown.get(i) for i in range(self.n_pieces)], pa.binary())
        self.decimal = pa.array([str(i) for i in range(self.n_pieces)])
        #: Whether a text may start with it for its decoding to be these bytes without the first, a space.
        self.starts = np.array([shown.get(i, b"")[:1] == b" " and shown[i][1:2] != b" " for i in range(self.n_pieces)])

    def reset(self) -> None:
        self.memo, self.rows = Memo(), Ragged()

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, symbol) of each join of two symbols; the score is -inf where there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.join_keys[:-1], key)
        return np.where(self.join_keys[at] == key, self.join_scores[at], -np.inf), self.join_ids[at]

    def merge_rows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols one after another, how many each word ends with, the words' order) of words of one length, a row each."""
        who, done = np.arange(len(symbols)), []
        score, joined = self._joins(symbols[:, :-1], symbols[:, 1:])
        while len(who) and score.shape[1]:
            best = score.argmax(1)
            some = score[np.arange(len(who)), best] > -np.inf
            if not some.all():
                done.append((who[~some], symbols[~some]))
                who, symbols, score, joined, best = (x[some] for x in (who, symbols, score, joined, best))
            rows, width = np.arange(len(who)), symbols.shape[1]
            symbols[rows, best] = joined[rows, best]
            column = np.arange(width - 1)
            later = column + (column > best[:, None])  # the symbol after the joined pair's first goes
            symbols = np.take_along_axis(symbols, later, 1)
            later = column[:-1] + (column[:-1] >= best[:, None])
            score, joined = (np.take_along_axis(x, later, 1) for x in (score, joined))
            for at in (best - 1, best):
                own = np.flatnonzero((at >= 0) & (at < width - 2))
                score[own, at[own]], joined[own, at[own]] = self._joins(symbols[own, at[own]], symbols[own, at[own] + 1])
        done.append((who, symbols))
        return np.concatenate([x.ravel() for _, x in done]), np.concatenate([np.full(len(w), x.shape[1]) for w, x in done]), np.concatenate([w for w, _ in done])

    def merge(self, word: str) -> list[int]:
        """Ids of normalised text, by the agenda."""
        symbols, scores = list(word), self.scores
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (s := scores.get(symbols[i] + symbols[i + 1])) is not None:
                agenda.append((-s, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != joined:
                continue  # one of the two has been joined to another since
            symbols[i], symbols[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := scores.get(joined + symbols[k])) is not None:
                    heapq.heappush(agenda, (-s, i, joined + symbols[k]))
            if (h := before[i]) >= 0 and (s := scores.get(symbols[h] + joined)) is not None:
                heapq.heappush(agenda, (-s, h, symbols[h] + joined))
        out = []
        for symbol in filter(None, symbols):
            if (i := self.ids.get(symbol)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in symbol.encode())
        return out

    def _learn(self, new: pa.Array, at_once: int = 50_000) -> np.ndarray:
        """Encodes new words; returns their rows."""
        rows = np.empty(len(new), np.int64)
        for at in range(0, len(new), at_once):
            part = new.slice(at, at_once)
            rows[at : at + len(part)] = self._encode_words(part)
        return rows

    def _encode_words(self, new: pa.Array) -> np.ndarray:
        size = np.asarray(pc.utf8_length(new)).astype(np.int64)
        text = np.frombuffer("".join(strings(new)).encode("utf-32-le"), np.uint32)
        begin, rows = np.cumsum(size) - size, np.empty(len(new), np.int64)
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            if 0 < n <= ROW_LENGTH:
                flat, many, order = self.merge_rows(self.symbol_of[text[begin[own][:, None] + np.arange(n)]])
                if (flat >= self.n_pieces).any():  # characters that are no piece
                    ids = [[i] if i < self.n_pieces else [self.bytes[b] for b in chr(i - self.n_pieces).encode()] for i in flat.tolist()]
                    upto = np.cumsum(np.concatenate([[0], [len(x) for x in ids]]))[np.concatenate([[0], np.cumsum(many)])]
                    flat, many = np.array([i for x in ids for i in x]), np.diff(upto)
                rows[own[order]] = self.rows.extend(flat, np.cumsum(many)) + np.arange(len(own))
            else:
                rows[own] = [self.rows.add(self.merge(w)) for w in new.take(pa.array(own)).to_pylist()]
        self._check(new, rows)
        return rows

    def _check(self, words: pa.Array, rows: np.ndarray) -> None:
        """Holds words that start with their only space mark against the library, which gets them as one text."""
        if not self.plain:
            return
        bare = pc.utf8_slice_codeunits(words, 1)
        own = pc.and_(pc.and_(pc.starts_with(words, SPACE), pc.not_equal(bare, "")), pc.invert(pc.match_substring(bare, SPACE)))
        bare, ids = bare.filter(own), self.rows.gather(rows[np.asarray(own)])[0]
        if self.lib.encode(" ".join(strings(bare)), num_threads=1) != ids.tolist():
            raise ValueError("words are not encoded as the library does")

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words."""
        rows = self.memo.find(words)
        row = np.array(pc.fill_null(rows, 0), np.int64)
        if rows.null_count:
            new = pc.is_null(rows)
            fresh = words.filter(new)
            learned = self._learn(fresh)
            order = np.argsort(learned)
            self.memo.add(fresh.take(pa.array(order)))
            row[np.asarray(new)] = learned
        return row

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, how many each text has); texts without nulls."""
        if self.memo.n > self.most_words:
            self.reset()
        odd = np.asarray(pc.match_substring_regex(texts, f"^ |  |{SPACE}|\x00")) if self.plain else np.ones(len(texts), bool)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        marked = pc.replace_substring(pc.replace_substring(plain, " ", f" {SPACE}"), "\n", " \n ")
        marked = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(SPACE, marked, ""))
        words = pc.split_pattern(marked, " ")
        counts = np.asarray(pc.list_value_length(words), dtype=np.int64)
        coded = words.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.empty(0, np.int64)
        if odd.any():
            each = np.split(rows, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd):
                found = pa.array(re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", self.lib.normalize(texts[int(i)].as_py())), pa.string()).dictionary_encode()
                each[i] = self._rows(found.dictionary)[np.asarray(found.indices)]
            rows, counts = np.concatenate(each), np.array([len(x) for x in each])
        ids, per_word = self.rows.gather(rows)
        ends, upto = np.concatenate([[0], np.cumsum(per_word)]), np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[upto[1:]] - ends[upto[:-1]]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids, as the library's decode() gives them; null lists give null.

        Such a text is what its ids stand for, put together, without the first space. Lists that don't
        start with just one space, and bytes that are no text, go to the library.
        """
        n = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
        flat, offsets = ids.flatten(), np.concatenate([[0], np.cumsum(n)])
        shown, some = self.shown.take(flat), np.flatnonzero(n)
        good = np.zeros(len(n), bool)
        good[some] = self.starts[np.asarray(flat)[offsets[:-1][some]]]
        good[np.searchsorted(offsets, np.flatnonzero(np.asarray(pc.is_null(shown))), side="right") - 1] = False
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.fill_null(shown, b"")), b"")
        out = []
        for k, x in enumerate(raw.to_pylist()):
            try:
                out.append(x[1:].decode() if good[k] else self.lib.decode(ids[k].as_py()) if n[k] else "" if ids[k].is_valid else None)
            except UnicodeError:
                out.append(self.lib.decode(ids[k].as_py()))
        return pa.array(out, pa.string())


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the piece ids of every text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = MergeCodec(path)
        for batch in batches:
            for part in sliced(batch, "text"):
                ids, n = codec.encode(part.column("text"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = MergeCodec(path)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), codec.decode(batch.column("ids"))], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each text: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = MergeCodec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in sliced(batch, "text"):
                ids, n = codec.encode(part.column("text"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                shown = pc.binary_join(pa.ListArray.from_arrays(offsets, codec.decimal.take(lists.values)), ",")
                back = codec.decode(lists)
                for k, raw in enumerate(part.column("text")):
                    text = raw.as_py()
                    if zlib.crc32(text.encode()) % CHECK_EVERY == 0 and (codec.lib.encode(text, num_threads=1) != lists[k].as_py() or codec.lib.decode(lists[k].as_py()) != back[k].as_py()):
                        raise ValueError("a text is not encoded or decoded as the library does")
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([sha(x) for x in c.to_pylist()]) for c in (shown, back))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of documents encoded and decoded."""
    return piece_digests(documents(table(spark, sf_dir, "documents")), tokenizer_path("piece_bpe_32k.model"))
