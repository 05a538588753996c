"""Subword ids of whole texts by a public tokenizer, for many texts at a time.

A batch of texts is split at white space, each distinct word of the batch is
encoded once, in numpy, and the ids are put together by their places. Nothing is
kept from one batch to the next.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are encoded together have about so many bytes (or there is one).
BYTES_AT_ONCE = 1 << 24
#: Longer runs of letters or signs go to the tokenizer itself.
LONGEST_UNIT = 48
LETTER, DIGIT, SIGN, REST = range(4)
NEVER = np.int32(2**31 - 1)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def flat_places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same of starts[1], and so on."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + counts, counts) + np.arange(total)


def slices(batch: pa.RecordBatch, column: int, most: int = BYTES_AT_ONCE):
    """The batch in slices whose texts have about ``most`` bytes, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def evenly(batches, column: int, most: int = BYTES_AT_ONCE):
    """The rows of all batches, in order, in batches whose texts have about ``most`` bytes, a row at least."""
    held, size = [], 0

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for big in batches:
        for b in slices(big, column, most):
            more = pc.sum(pc.binary_length(b.column(column))).as_py() or 0
            if held and size + more > most:
                yield joined()
                held, size = [], 0
            held.append(b)
            size += more
    if held:
        yield joined()


def spread(flat: np.ndarray, n: np.ndarray, which: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, how many each has): ids of distinct words lie flat, n of each; the texts' words are ``which`` of these, of_text of them in each."""
    start = np.cumsum(n) - n
    counts = n[which]
    ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(of_text)))]
    return flat[flat_places(start[which], counts)], np.diff(ends)


SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def own_memory(texts: pa.Array, lower: bool) -> pa.Array:
    """Texts (null ones as empty) that start at the beginning of their buffers, with A-Z in lower case if asked for.

    Arrow's own lower-casing gives wrong bytes for slices of an array, so none is handed on.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(SMALL[raw] if lower else raw)])


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in a row, and how many each text has; white space is ASCII's, a null text has none."""
    parts = pc.ascii_split_whitespace(own_memory(texts, lower))
    words, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    there = np.concatenate(([0], np.cumsum(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))))
    ends = ends - ends[0]
    if there[-1] < len(words):  # white space at either end of a text leaves an empty word there
        words = words.filter(pc.greater(pc.binary_length(words), 0))
        ends = there[ends]
    return words.view(pa.large_binary()).dictionary_encode(), np.diff(ends)


class WordIds:
    """Ids of words by a tokenizer that lower-cases, drops white space and never joins across it.

    Of such a tokenizer's file the merges are read; words of ASCII and Latin-1
    letters, digits and signs are parted into units (runs of letters, single
    digits, runs of signs) and all units' pairs are merged side by side, lowest
    rank first. Any other word goes to the tokenizer itself. Strings of its
    special tokens in a text are ordinary text, as its own description has it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # Bytes stand as printable characters: those that are, as themselves, the others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = dict(zip([*printable, *sorted(set(range(256)) - set(printable))], [*map(chr, printable), *map(chr, range(256, 324))], strict=True))
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[names[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.int64(2**62)), np.append(order.astype(np.int32), NEVER)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        byte = np.arange(256)
        self.first = [self._rank(self.inner[byte[:, None]], to[byte[None]]) for to in (self.inner, self.last)]  # of pairs of bytes
        kind = np.full(256, SIGN, np.int8)
        kind[[*range(65, 91), *range(97, 123)]] = LETTER
        kind[48:58] = DIGIT
        kind[128:] = REST
        kind[ord("'")] = REST  # may begin a contraction
        self.kind = kind

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NEVER)

    def _merge(self, b: np.ndarray):
        """(rows, their ids) groups of the bytes b, a row for each unit of the same length."""
        rows = np.arange(len(b))
        s = np.concatenate((self.inner[b[:, :-1]], self.last[b[:, -1:]]), 1)
        rank = np.concatenate((self.first[0][b[:, :-2], b[:, 1:-1]], self.first[1][b[:, -2:-1], b[:, -1:]][:, : b.shape[1] - 1]), 1)
        while True:
            if s.shape[1] == 1:
                yield rows, s
                return
            at = rank.argmin(1)
            best = rank[np.arange(len(s)), at]
            done = best == NEVER
            if done.any():
                yield rows[done], s[done]
                if done.all():
                    return
                rows, s, rank, at, best = (x[~done] for x in (rows, s, rank, at, best))
            width, line = s.shape[1], np.arange(len(s))
            cols = np.arange(width - 1)
            s = np.take_along_axis(s, cols + (cols > at[:, None]), 1)
            s[line, at] = self.merged[best]
            # the pair itself goes; those on either side of the new symbol are ranked anew
            rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= at[:, None]), 1)
            for shift in (-1, 0):
                k = at + shift
                some = np.flatnonzero((k >= 0) & (k < width - 2))
                rank[some, k[some]] = self._rank(s[some, k[some]], s[some, k[some] + 1])

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, how many of each) of distinct units, all at most LONGEST_UNIT bytes."""
        ends = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
        raw = np.frombuffer(units.buffers()[2], np.uint8) if units.buffers()[2] else np.empty(0, np.uint8)
        size, groups, count = np.diff(ends), [], np.zeros(len(units), np.int64)
        for n in np.unique(size).tolist():
            who = np.flatnonzero(size == n)
            for rows, ids in self._merge(raw[ends[who][:, None] + np.arange(n)]):
                groups.append((who[rows], ids))
                count[who[rows]] = ids.shape[1]
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint32)
        for who, ids in groups:
            flat[start[who][:, None] + np.arange(ids.shape[1])] = ids
        return flat, count

    def _plain(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words by the tokenizer itself."""
        out = []
        for i in range(0, len(words), 256):
            texts = [w.decode("utf-8", "replace") for w in words[i : i + 256]]
            out += [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return out

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, how many of each) of words, as a large binary array without nulls."""
        count = np.zeros(len(words), np.int64)
        if not len(words):
            return np.empty(0, np.uint32), count
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if words.buffers()[2] else np.empty(0, np.uint8)
        ends = ends - ends[0]
        kind, low = self.kind[raw], SMALL[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # Latin-1's letters: this byte and one of 80 to BF, but for two signs
        tail = raw[lead + 1]
        fits = (tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[fits], tail[fits]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = tail + np.where(tail <= 0x9E, 32, 0).astype(np.uint8)
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = True
        turn = first[:-1] | (kind == DIGIT)
        turn[1:] |= kind[1:] != kind[:-1]
        starts = np.append(np.flatnonzero(turn), len(raw))
        word_of = np.cumsum(first[:-1])[starts[:-1]] - 1 if len(raw) else np.empty(0, np.int64)
        if len(ends) > 1 and (np.diff(ends) == 0).any():  # empty words share their end with the next
            word_of = np.flatnonzero(np.diff(ends))[word_of]
        odd = np.zeros(len(words), bool)
        odd[word_of[(kind[starts[:-1]] == REST) | (np.diff(starts) > LONGEST_UNIT)]] = True
        # units of odd words are encoded for nothing, as long as they are short
        keep = ~odd[word_of]
        begin, size = starts[:-1][keep], np.diff(starts)[keep]
        data = low[flat_places(begin, size)]
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        flat, n = self._units(units.dictionary)
        which = units.indices.to_numpy()
        start = np.cumsum(n) - n
        own = flat[flat_places(start[which], n[which])]
        count += np.bincount(word_of[keep], n[which], len(words)).astype(np.int64)
        if not odd.any():
            return own, count
        other = self._plain(words.filter(pa.array(odd)).to_pylist())
        at = np.flatnonzero(odd)
        regular = np.repeat(~odd, count)  # odd words have none so far
        count[at] = [len(x) for x in other]
        out = np.empty(int(count.sum()), np.uint32)
        fill = np.repeat(odd, count)
        assert regular.all()
        out[~fill] = own
        out[fill] = np.fromiter((i for x in other for i in x), np.uint32, int(fill.sum()))
        return out, count

    def ids(self, words: pa.DictionaryArray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has), of texts as ``split_words`` gives them."""
        return spread(*self.distinct(words.dictionary), words.indices.to_numpy(), of_text)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.ids(*split_words(texts))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker and file."""
    return WordIds(path)
