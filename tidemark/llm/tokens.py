"""Token-id files: blocks packed by an adaptive context-mixing range coder.

A block holds whole documents. Its ids are dealt to lanes, stretches of equal
length that are coded side by side, one id of every lane per step, with models
that all lanes share and that start afresh in every block. Two tables predict
an id from the last one and from the last two. How far each prediction has
been right mixes them: every state of both confidences has adaptive odds of
"the order-2 id", "the order-1 id" and "another", and another id is coded by
its adaptive order-0 frequency. A range coder turns the odds into bytes.
Checksums over each block's bytes and over its ids guard it.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, ranges, slices_by_bytes, spread, stored
from tidemark.llm.files import new_folder, open_folder, unique_name

#: Ids of a block (a longer document makes a longer one), and lanes at most.
BLOCK_IDS, LANES = 1 << 22, 6144
#: Id appended to every document.
END_ID = 0
END = np.uint32(END_ID)
#: Fixed values of the format: block magic, and header (crc of what follows,
#: documents, ids, ids' crc, alphabet, lanes, bytes of documents and of words).
MAGIC = b"TIB2"
HEAD = struct.Struct("<4sIIQIIIII")

#: Words remembered by one worker before it starts afresh; bytes of texts, and
#: words of a longer text, encoded at a time.
MEMO_WORDS, SLICE, STRETCH = 1 << 20, 1 << 21, 1 << 20

_BITS2 = 20
_BOTTOM = np.uint64(1 << 40)
_16, _48 = np.uint64(16), np.uint64(48)
#: Odds of the predictions and frequencies of ids are shares of powers of two,
#: which leave a range of at least 2 ** 40 its whole numbers.
_ODDS, _SEEN = 16, 24
_ODDS_BITS, _SEEN_BITS, _SEEN_TOP = np.uint64(_ODDS), np.uint64(_SEEN), np.uint64((1 << _SEEN) - 1)
#: Bits of a frequency's place within the stretches that ``Mixer.find`` looks up.
_NEAR = 10


class Mixer:
    """The shared models of a block."""

    def __init__(self, alphabet: int):
        if alphabet >= 1 << _SEEN:
            raise ValueError("the alphabet is too large for the block's frequencies")
        # an entry is the predicted id and, in its last two bits, the confidence
        self.table1, self.table2 = np.zeros(alphabet, np.int32), np.zeros(1 << _BITS2, np.int32)
        self.odds = np.tile(np.array([8, 8, 16]), (32, 1))
        self.edges, self.widths = np.zeros((32, 4), np.uint64), np.zeros((32, 4), np.uint64)
        self.seen, self.fresh, self.step = np.ones(alphabet, np.int64), [], 0
        self._cumulate()

    def _cumulate(self) -> None:
        if self.fresh:
            self.seen += 32 * np.bincount(np.concatenate(self.fresh), minlength=len(self.seen))
        self.fresh, self.starts = [], None
        size, cum = len(self.seen), np.cumsum(self.seen)
        self.cum = np.zeros(size + 1, np.uint64)  # every id keeps a share
        self.cum[1:] = cum * ((1 << _SEEN) - size) // int(cum[-1]) + np.arange(1, size + 1)
        self.wide = np.diff(self.cum)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose shares hold the values."""
        if self.starts is None:  # the id at the start of each stretch
            ends = (self.cum[1:-1].view(np.int64) + ((1 << _NEAR) - 1)) >> _NEAR
            self.starts = np.cumsum(np.bincount(ends, minlength=(1 << _SEEN - _NEAR) + 1))
        near = (value >> np.uint64(_NEAR)).view(np.int64)
        ids = self.starts.take(near)
        several = np.flatnonzero(self.starts.take(near + 1) != ids)
        if len(several):
            among = value.take(several)
            order = np.argsort(among)  # a sorted search stays in the cache
            ids[several.take(order)] = np.searchsorted(self.cum, among.take(order), side="right") - 1
        return ids

    def look(self, last: np.ndarray, before: np.ndarray) -> None:
        """Predictions in the context of the last two ids of each lane."""
        key = (last << 20 ^ before).view(np.uint64)
        key *= np.uint64(0x9E3779B97F4A7C15)
        key >>= np.uint64(64 - _BITS2)
        self.at1, self.at2 = last, key.view(np.int64)
        self.entry1, self.entry2 = self.table1.take(last), self.table2.take(self.at2)
        self.id1, self.id2 = self.entry1 >> 2, self.entry2 >> 2
        self.sure1, self.sure2 = self.entry1 & 3, self.entry2 & 3
        base = (self.id1 == self.id2).astype(np.int32)
        base <<= 2
        base += self.sure1
        base <<= 2
        base += self.sure2
        base <<= 2
        self.base = base.astype(np.int64)
        share = self.odds[:, :2] * ((1 << _ODDS) - 3) // self.odds.sum(1, keepdims=True) + 1  # every outcome keeps a share
        self.widths[:, :2] = share
        self.edges[:, 1] = share[:, 0]
        self.edges[:, 2] = share[:, 0] + share[:, 1]
        self.widths[:, 2] = np.uint64(1 << _ODDS) - self.edges[:, 2]

    def learn(self, now: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, at: np.ndarray, others: np.ndarray) -> None:
        """Take in the ids of one step, in lane order: whether they are the
        predicted ones, their outcomes' places among the odds, and those that
        no table predicted."""
        self.odds += 24 * np.bincount(at, minlength=128).reshape(32, 4)[:, :3]
        heavy = self.odds.sum(1) > 1 << 16
        if heavy.any():
            self.odds[heavy] = self.odds[heavy] // 2 + 1
        blank = now << 2
        for table, place, hit, old, sure in ((self.table1, self.at1, hit1, self.entry1, self.sure1),
                                             (self.table2, self.at2, hit2, self.entry2, self.sure2)):
            table[place] = np.where(hit, old + (sure < 3), np.where(sure > 0, old - 1, blank))
        self.fresh.append(others)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 16 == 0:
            self._cumulate()


def _settled(low: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Lanes to shift by 16 bits, which the caller does before it asks again:
    those whose leading 16 bits are settled, or forced to be."""
    at = None
    while at is None or len(at):
        x, y = (low, size) if at is None else (low.take(at), size.take(at))
        out = (x ^ (x + y)) < np.uint64(1 << 48)
        small = y < _BOTTOM
        small &= ~out
        if small.any():
            small = np.flatnonzero(small)
            size[small if at is None else at[small]] = (~x[small] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
            out[small] = True
        at = np.flatnonzero(out) if at is None else at[out]
        if len(at):
            yield at


def _lanes_for(n: int) -> int:
    return max(1, min(LANES, n // 512))


def pack(ids: np.ndarray, alphabet: int) -> tuple[int, bytes]:
    """(lanes, coded words) of a block's ids."""
    lanes = _lanes_for(len(ids))
    steps = -(-len(ids) // lanes)
    line = np.zeros(lanes * steps, np.int32)
    line[:len(ids)] = ids
    line, grid = line.reshape(lanes, steps), np.empty((steps, lanes), np.int32)
    for k in range(0, lanes, 64):  # turned in stretches that stay in the cache
        grid[:, k:k + 64] = line[k:k + 64].T
    del line
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    who, words = [], []
    mix, last, before = Mixer(alphabet), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for now in grid:
        mix.look(last, before)
        hit1, hit2 = now == mix.id1, now == mix.id2
        outcome = (~hit2).view(np.uint8) + (~(hit1 | hit2)).view(np.uint8)
        at = mix.base + outcome
        last, before = now.astype(np.int64), last
        size >>= _ODDS_BITS
        low += size * mix.edges.take(at)
        size *= mix.widths.take(at)
        other = np.flatnonzero(outcome == 2)
        others = last.take(other)
        share = size.take(other) >> _SEEN_BITS
        low[other] += share * mix.cum.take(others)
        size[other] = share * mix.wide.take(others)
        for out in _settled(low, size):
            settled = low.take(out)
            who.append(out.astype(np.uint16))
            words.append((settled >> _48).astype(np.uint16))
            low[out] = settled << _16
            size[out] <<= _16
        mix.learn(now, hit1, hit2, at, others)
    for k in range(4):  # the rest of each lane
        who.append(np.arange(lanes, dtype=np.uint16))
        words.append((low >> _48).astype(np.uint16))
        low <<= _16
    who, words = np.concatenate(who), np.concatenate(words)
    counts = np.bincount(who, minlength=lanes).astype("<u4")
    return lanes, counts.tobytes() + words[np.argsort(who, kind="stable")].astype("<u2").tobytes()


def unpack(data: bytes, n: int, alphabet: int, lanes: int) -> np.ndarray:
    """The ids that ``pack`` coded."""
    counts = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u2", offset=4 * lanes), np.zeros(8, np.uint16)])
    nth = np.cumsum(counts) - counts  # next word of each lane
    steps = -(-n // lanes)
    # the code is kept as its distance above the low end of the range
    low, size, above = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        above = (above << _16) | words[nth]
        nth += 1
    mix, last, before = Mixer(alphabet), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    grid = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        mix.look(last, before)
        size >>= _ODDS_BITS
        outcome = (above >= size * mix.edges.take(mix.base + 1)).view(np.uint8) + (above >= size * mix.edges.take(mix.base + 2)).view(np.uint8)
        at = mix.base + outcome
        first = size * mix.edges.take(at)
        low += first
        above -= first
        size *= mix.widths.take(at)
        now = np.where(outcome == 0, mix.id2, mix.id1)
        other = np.flatnonzero(outcome == 2)
        share, rest = size.take(other) >> _SEEN_BITS, above.take(other)
        others = mix.find(np.minimum(rest // share, _SEEN_TOP))
        now[other] = others
        first = share * mix.cum.take(others)
        low[other] += first
        above[other] = rest - first
        size[other] = share * mix.wide.take(others)
        for out in _settled(low, size):
            place = nth.take(out)
            low[out] <<= _16
            size[out] <<= _16
            above[out] = (above.take(out) << _16) | words.take(place)
            nth[out] = place + 1
        mix.learn(now, now == mix.id1, now == mix.id2, at, others)
        last, before = now.astype(np.int64), last
        grid[t] = now
    line = np.empty((lanes, steps), np.uint32)
    for k in range(0, lanes, 64):
        line[k:k + 64] = grid[:, k:k + 64].T
    return line.reshape(-1)[:n]


def write_block(docs: list[tuple[int | None, np.ndarray]], alphabet: int) -> bytes:
    """A block of (document id, ids)."""
    ids = np.concatenate([x for _, x in docs]).astype("<u4") if docs else np.zeros(0, "<u4")
    if len(ids) and int(ids.max()) >= alphabet:
        raise ValueError("an id is not in the alphabet")
    names = zlib.compress(b"".join((
        np.array([d is None for d, _ in docs], np.uint8).tobytes(), np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
        np.array([len(x) for _, x in docs], "<u4").tobytes())), 1)
    lanes, coded = pack(ids, alphabet)
    rest = HEAD.pack(MAGIC, 0, len(docs), len(ids), zlib.crc32(ids.tobytes()), alphabet, lanes, len(names), len(coded))[8:] + names + coded
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def read_block(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a block; raises if a checksum does not hold."""
    magic, check, n_docs, n, ids_check, alphabet, lanes, n_names, n_coded = HEAD.unpack_from(data)
    if magic != MAGIC or zlib.crc32(data[8:]) != check or len(data) != HEAD.size + n_names + n_coded:
        raise ValueError("block is damaged")
    names = zlib.decompress(data[HEAD.size:HEAD.size + n_names])
    null, doc = np.frombuffer(names, np.uint8, n_docs), np.frombuffer(names, "<i8", n_docs, n_docs)
    lens = np.frombuffer(names, "<u4", n_docs, 9 * n_docs)
    ids = unpack(data[HEAD.size + n_names:], n, alphabet, lanes)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_check:
        raise ValueError("ids do not have the block's checksum")
    return [(None if z else d, x) for z, d, x in zip(null.tolist(), doc.tolist(), np.split(ids, np.cumsum(lens)[:-1]))] if n_docs else []


#: Kinds of characters in the vocabulary's pattern.
_LETTER, _NUMBER, _OTHER, _WHITE = range(4)


class Kinds:
    """Kinds of code points as the library has them, which knows fewer letters
    than newer modules do; asked once for each that occurs."""

    def __init__(self, library):
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.table = np.full(0x110000, 255, np.uint8)
        self.ascii = self.of(np.arange(128)).tobytes() * 2  # of bytes; those above 127 are told by the whole character

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.table[points]
        if (unseen := kinds == 255).any():
            for c in np.unique(points[unseen]).tolist():  # what it joins tells its kind
                joins = (k for k, x in ((_LETTER, "a"), (_NUMBER, "1"), (_WHITE, "\n")) if len(self.cut(x + chr(c))) == 1)
                self.table[c] = next(joins, _OTHER)
            kinds = self.table[points]
        return kinds


def word_starts(data: np.ndarray, texts: np.ndarray, kinds: Kinds) -> np.ndarray:
    """Where the words of the vocabulary's pattern begin in UTF-8 bytes of
    texts, which begin at ``texts`` and follow each other."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    head = np.zeros(n + 4, bool)  # texts begin here
    head[texts] = True
    head[n:] = True
    kind = np.frombuffer(bytearray(data).translate(kinds.ascii), np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):  # all bytes of a character are of its kind
        first = data[lead].astype(np.int64)
        length = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> length)
        for k in range(1, 4):
            more = length > k
            point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
        of = kinds.of(point)
        for k in range(4):
            more = length > k
            kind[lead[more] + k] = of[more]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= head[:n]
    # the last character of white space before a word stands alone, or begins the word if it is a space
    white = kind == _WHITE
    before = white[:-1] & ~white[1:] & ~head[1:n]
    joins = before & (data[:-1] == 32)
    start[:-1] |= joins
    start[1:] &= ~joins
    before &= ~joins
    at = np.flatnonzero(before)
    while len(at):
        inside = (data[at] & 0xC0) == 0x80
        start[at[~inside]] = True
        at = at[inside] - 1
    quote = np.flatnonzero(data == 39)
    if len(quote := quote[start[quote]]):  # 's and the like where a word begins
        text = np.r_[data, np.zeros(3, np.uint8)]
        one, two = text[quote + 1], text[quote + 2]
        short = np.isin(one, np.frombuffer(b"sdmt", np.uint8)) & ~head[quote + 1]
        long = np.isin(one.astype(np.int64) << 8 | two, [int.from_bytes(x) for x in (b"ll", b"ve", b"re")]) & ~head[quote + 1] & ~head[quote + 2]
        start[quote[short | long] + 1] = False
        ends = np.r_[quote[short] + 2, quote[long] + 3]
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Memo:
    """A value for each short word, many at a time. A word's key is exact: its
    bytes, padded to 15, and how many they are. An open table holds, a row a
    word, both halves of the key and the value."""

    LONGEST = 15
    _KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.rows = np.zeros((1 << bits, 3), np.uint64)

    @classmethod
    def keys(cls, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves of the keys of words in the bytes; 16 more bytes follow the last word."""
        at_byte = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low, high = at_byte[starts], at_byte[starts + 8]
        low &= cls._KEEP.take(np.minimum(sizes, 8))
        high &= cls._KEEP.take(np.clip(sizes - 8, 0, 7))
        return low, high | sizes.astype(np.uint64) << np.uint64(56)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The words' values, 0 where there is none."""
        slot = self._slot(low, high)
        rows = self.rows.take(slot, 0)
        values = rows[:, 2].copy()
        other = (rows[:, 0] != low) | (rows[:, 1] != high)
        values[other] = 0
        todo = np.flatnonzero(other & (rows[:, 1] > 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.rows) - 1)
            rows = self.rows.take(slot[todo], 0)
            same = (rows[:, 0] == low[todo]) & (rows[:, 1] == high[todo])
            values[todo[same]] = rows[same, 2]
            todo = todo[~same & (rows[:, 1] > 0)]
        return values

    def put(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> None:
        """Take in words that the memo does not hold, each once."""
        self.used += len(low)
        rows = np.stack([low, high, values], 1)
        if self.used * 2 > len(self.rows):
            rows = np.concatenate([self.rows[self.rows[:, 1] > 0], rows])
            self.bits = (self.used * 2).bit_length()
            self.rows = np.zeros((1 << self.bits, 3), np.uint64)
        slot = self._slot(rows[:, 0], rows[:, 1])
        while len(slot):
            free = np.flatnonzero(self.rows[slot, 1] == 0)
            self.rows[slot[free]] = rows[free]  # of words that meet in a slot one stays
            left = (self.rows[slot, :2] != rows[:, :2]).any(1)
            slot, rows = (slot[left] + 1) & (len(self.rows) - 1), rows[left]


class LibraryEncoder:
    """Encodes whole texts with the library, each distinct word once.

    All texts of a batch are cut into the words of the vocabulary's pattern at
    once, by the kinds of their bytes; Arrow numbers the words, and the library
    encodes those not met before. Texts with a special token in them go to the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.by_word = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for library in (self.library, self.by_word):
            library.no_padding()
            library.no_truncation()
        self.by_word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kinds, vocab = Kinds(self.library), self.library.get_vocab()
        self.alphabet = max(vocab.values()) + 1
        self.bytes = np.zeros(self.alphabet, np.int64)  # of each token: one for each character
        self.bytes[list(vocab.values())] = list(map(len, vocab))
        self.special = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        # of short and of long words: place << 32 | how many of the word's ids
        self.memo, self.words = Memo(), {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Have the library encode new words; where their ids are from now on."""
        ids = np.array(self.by_word.encode_batch_fast([words.to_pylist()], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        # tokens of a word hold its bytes, so byte counts tell where each word ends
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), ends, side="right")
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        starts = np.r_[0, ends[:-1]]
        places = (self.used + starts) << 32 | (ends - starts)
        self.used += len(ids)
        return places.view(np.uint64)

    def _places(self, words: pa.Array, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the ids of each word are, those of new words too."""
        low, high = Memo.keys(data, starts, np.minimum(sizes, Memo.LONGEST))
        is_long = sizes > Memo.LONGEST
        places = self.memo.find(low, high)
        if len(new := np.flatnonzero((places == 0) & ~is_long)):
            found = words.take(pa.array(new)).dictionary_encode()
            learned, nth = self._learn(found.dictionary), found.indices.to_numpy()
            first = np.empty(len(learned), np.int64)
            first[nth] = new
            self.memo.put(low[first], high[first], learned)
            places[new] = learned[nth]
        if len(long := np.flatnonzero(is_long)):
            found = words.take(pa.array(long)).dictionary_encode()
            keys = found.dictionary.to_pylist()
            if unknown := [w for w in keys if w not in self.words]:
                self.words.update(zip(unknown, self._learn(pa.array(unknown, pa.large_string())).tolist()))
            places[long] = np.fromiter(map(self.words.__getitem__, keys), np.uint64, len(keys))[found.indices.to_numpy()]
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text's end; a null text is empty."""
        if self.memo.used + len(self.words) > MEMO_WORDS:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(0, np.int64)
        if self.special:
            odd = pc.match_substring_regex(texts, self.special)
            if len(whole := np.flatnonzero(odd.to_numpy(zero_copy_only=False))):
                found = self.library.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
                texts = pc.if_else(odd, "", texts)
        _, offsets, buffer = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(buffer or b"", np.uint8)[edges[0]:edges[-1]]
        edges = edges - edges[0]
        starts = word_starts(data, edges[:-1][edges[:-1] < len(data)], self.kinds)
        bounds, data = np.r_[starts, len(data)], np.r_[data, np.zeros(16, np.uint8)]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for k in range(0, len(starts), STRETCH):  # of a long text
            some = starts[k:k + STRETCH]
            places = self._places(words.slice(k, STRETCH), data, some, np.diff(bounds[k:k + STRETCH + 1]))
            counts.append((places & np.uint64(0xFFFFFFFF)).view(np.int64))
            ids.append(self.ids[ranges((places >> np.uint64(32)).view(np.int64), counts[-1])])
        ids, ends = np.concatenate(ids), np.cumsum(np.concatenate(counts))[np.searchsorted(starts, edges[1:])]
        if len(whole):
            parts = np.split(ids, ends[:-1])
            for k, e in zip(whole.tolist(), found):
                parts[k] = np.array(e.ids, np.uint32)
            ids, ends = np.concatenate(parts), np.cumsum(list(map(len, parts)))
        return ids, ends

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of each text."""
        ids, ends = self.encode(texts)
        return np.split(ids, ends[:-1]) if len(ends) else []


@functools.lru_cache(1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(docs: DataFrame, vocab_path: str, folder: str, id_col: str = "doc_id", text: str = "text",
          block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every whole text, append ``END_ID``, and write the ids in
    ascending order of the documents; returns the blocks (part, file, nth,
    offset, bytes, documents, ids).

    A null text is empty; null ids come first; rows that share an id are in
    the order of a hash of their texts. No rows make no files.
    """
    key = [F.coalesce(F.col("_id"), F.lit(NULL_ID)), F.xxhash64("_text")]
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
            .repartitionByRange(*key).sortWithinPartitions(*key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(vocab_path)
        part, name, out, offset, done = TaskContext.get().partitionId(), None, None, 0, []
        held: list[tuple[int | None, np.ndarray]] = []

        def put() -> None:
            nonlocal offset
            data = write_block(held, enc.alphabet)
            out.write(data)
            done.append((part, name, len(done), offset, len(data), len(held), sum(len(x) for _, x in held)))
            offset += len(data)
            held.clear()

        n = 0
        for b in slices_by_bytes(batches, 1, SLICE):
            if out is None and b.num_rows:
                fs, path = open_folder(folder)
                fs.create_dir(path, recursive=True)
                name = unique_name(f"part-{part:06d}", ".tib")
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            for d, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1))):
                held.append((d, np.append(ids, END)))
                n += len(ids) + 1
                if n >= block_ids:
                    put()
                    n = 0
        if held:
            put()
        if out is not None:
            out.close()
        cols = list(zip(*done)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         ["part", "file", "nth", "offset", "bytes", "documents", "ids"])

    return stored(rows.mapInArrow(run, "part long, file string, nth long, offset long, bytes long, documents long, ids long"), "blocks")


def read(blocks: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of the
    blocks; start counts the ids of all documents before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file
    starts = blocks.groupBy("part", "file").agg(F.sum("ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = (blocks.withColumn("first", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(starts, "file")
              .select("file", "offset", "bytes", (F.col("first") + F.col("base")).alias("first")))
    placed = spread(placed, "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for b in batches:
            for file, offset, size, first in zip(*(b.column(k).to_pylist() for k in range(4))):
                with fs.open_input_file(f"{path}/{file}") as f:
                    docs = read_block(f.read_at(size, offset))
                lens = np.array([len(x) for _, x in docs], np.int64)
                cols = [pa.array([d for d, _ in docs], pa.int64()), pa.array(first + np.cumsum(lens) - lens), pa.array(lens),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for _, x in docs], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def round_trip(docs: DataFrame, vocab_path: str, **options) -> DataFrame:
    """Write the ids of ``docs`` and read the files back, without the ids."""
    folder = new_folder(docs.sparkSession, "ids")
    return read(write(docs, vocab_path, folder, **options), folder)
