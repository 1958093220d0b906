"""Byte-level BPE with a minimal acyclic transducer for frequent words.

The words that the whole corpus uses most are compiled, with their token ids
as output, into a minimal acyclic automaton: sorted insertion shares prefixes,
the register shares suffixes, and the integer outputs on the arcs add up to a
word's number, which points at its ids. The automaton is a few flat arrays in
one buffer; every Python worker maps it read-only. Words it does not hold are
merged exactly, many at a time, by the ranks of the vocabulary file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frequent, passing, ranges, slices_by_bytes

#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Most words the automaton holds; a bound on what is sent to the executors.
LEXICON_WORDS = 1 << 16
#: Longest word, in bytes, that the automaton holds.
LEXICON_BYTES = 64
#: Bytes of texts that a worker encodes at a time, and counts words of; a longer text is taken alone.
SLICE, COUNT_SLICE = 1 << 21, 1 << 23
#: Chunks remembered by one worker before it starts afresh.
MEMO_CHUNKS = 1 << 19

_NONE = np.uint32(0xFFFFFFFF)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 on, in byte order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        back, model = byte_alphabet(), spec["model"]
        ids = model["vocab"]
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for t, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.decimals = pa.array([str(i) for i in range(size)], pa.string()).cast(pa.large_binary())
        self.raw = pa.array(self.token_bytes, pa.large_binary())
        self.byte_id = np.array([ids[c] for c, _ in sorted(back.items(), key=lambda x: x[1])], np.uint32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._index([(ids[a] << 32) | ids[b] for a, b in pairs], [ids[a + b] for a, b in pairs])
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _index(self, keys: list[int], made: list[int]) -> None:
        """Open-addressing table of the merges: pair -> rank and new id."""
        self._bits = max(4, (len(keys) * 4).bit_length())
        size = 1 << self._bits
        self._keys = np.full(size, -1, np.int64)
        self._rank = np.full(size, _NONE, np.uint32)
        self._made = np.zeros(size, np.uint32)
        k = np.array(keys, np.int64)
        todo, at = np.arange(len(keys)), self._slot(k)
        self._probes = 0
        while len(todo):
            self._probes += 1
            free = self._keys[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self._keys[at[put]] = k[todo[put]]
            self._rank[at[put]] = todo[put]
            self._made[at[put]] = np.array(made, np.uint32)[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (all ones: no merge) and table slot of each pair."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(key)
        hit = self._keys[at]
        open_ = np.flatnonzero((hit != key) & (hit >= 0))
        for _ in range(self._probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self._keys) - 1)
            hit = self._keys[at[open_]]
            open_ = open_[(hit != key[open_]) & (hit >= 0)]
        rank = np.where(self._keys[at] == key, self._rank[at], _NONE)
        return rank, at

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        ids, sizes = self.merged(words)
        ids, ends = ids.tolist(), np.cumsum(sizes).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words at once: in every round each word merges all
        places of its lowest-ranked pair, left to right, until none has a pair.
        The ids of all words, and how many each has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE, np.uint32)
            slot = np.zeros(len(sym), np.int64)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same], slot[same] = self.find(sym[same], sym[same + 1])
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(sym)])
            low_each = np.repeat(low, sizes)
            live = low_each != _NONE
            hit = live & (rank == low_each)
            # of touching places (as in "aaa") every second one, from the left
            touch = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            for i in touch:  # rare: runs of one symbol
                if hit[i - 1]:
                    hit[i] = False
            at = np.flatnonzero(hit)
            sym = sym.copy()
            sym[at] = self._made[slot[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            if not live.all():
                out = keep & ~live
                done_sym.append(sym[out])
                done_word.append(word[out])
                keep &= live
            sym, word = sym[keep], word[keep]
        s, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word))
        return s[np.argsort(w, kind="stable")].astype(np.uint32), np.bincount(w.astype(np.int64), minlength=len(words))


# ------------------------------------------------------------- automaton --
def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """Minimal acyclic transducer of ``words`` as one flat buffer.

    Layout (little endian): int64 counts [nodes, arcs, words, ids], then arc
    keys int64 (node * 256 + byte, ascending), arc targets int32, arc outputs
    int32, node finals uint8, id offsets int32, ids uint32. A word's number is
    the sum of the outputs on its path: how many words sort before it.
    """
    ordered = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple]] = []  # (final, ((byte, target), ...))
    count: list[int] = []  # words below each node

    def settle(final: bool, arcs: list) -> int:
        sig = (final, tuple(arcs))
        if sig not in register:
            register[sig] = len(nodes)
            nodes.append(sig)
            count.append(final + sum(count[t] for _, t in arcs))
        return register[sig]

    path: list[list] = [[False, []]]  # open nodes from the root down
    last = b""
    for w in ordered:
        common = len(os.path.commonprefix([last, w]))
        while len(path) - 1 > common:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(*done)))
        path.extend([False, []] for _ in w[common:])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(*done)))
    root = settle(*path[0])
    keys, targets, outs = [], [], []
    for n, (final, arcs) in enumerate(nodes):
        seen = int(final)
        for b, t in arcs:
            keys.append(((0 if n == root else n + 1) << 8) | b)
            targets.append(0 if t == root else t + 1)
            outs.append(seen)
            seen += count[t]
    finals = np.zeros(len(nodes) + 1, np.uint8)
    finals[[i + 1 for i, x in enumerate(nodes) if x[0]]] = 1
    finals[0] = 0
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    offs = np.zeros(len(ordered) + 1, np.int32)
    np.cumsum([len(words[w]) for w in ordered], out=offs[1:])
    ids = np.fromiter(chain.from_iterable(words[w] for w in ordered), np.uint32)
    head = np.array([len(finals), len(keys), len(ordered), len(ids)], np.int64)
    return b"".join(x.tobytes() for x in (
        head, np.array(keys, np.int64)[order], np.array(targets, np.int32)[order],
        np.array(outs, np.int32)[order], offs, ids, finals))


class Lexicon:
    """Read-only view of a compiled automaton; looks up many words in step."""

    def __init__(self, buf):
        nodes, arcs, words, n_ids = np.frombuffer(buf, np.int64, 4)
        at = 32
        views = []
        for kind, n in ((np.int64, arcs), (np.int32, arcs), (np.int32, arcs), (np.int32, words + 1),
                        (np.uint32, n_ids), (np.uint8, nodes)):
            views.append(np.frombuffer(buf, kind, n, at))
            at += int(n) * np.dtype(kind).itemsize
        self.keys, self.targets, self.outs, self.offs, self.ids, self.finals = views

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Map the automaton from a nameless file of this machine's temp folder:
        its pages are shared and the system may drop and reload them."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where the automaton does not hold it."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        lens = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lens) - lens
        node, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((lens > 0) & (lens <= LEXICON_BYTES))
        result = np.full(n, -1, np.int64)
        depth = 0
        while len(live):
            key = (node[live] << 8) | text[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            node[live] = self.targets[arc]
            number[live] += self.outs[arc]
            depth += 1
            end = lens[live] == depth
            over = live[end]
            over = over[self.finals[node[over]] == 1]
            result[over] = number[over]
            live = live[~end]
        return result

    def output(self, number: int) -> tuple[int, ...]:
        return tuple(self.ids[self.offs[number]:self.offs[number + 1]].tolist())


# --------------------------------------------------------------- encoder --
#: White space as the pattern sees it (Unicode's), written for Arrow.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def whole_texts(special: Iterable[str]) -> str:
    """Arrow's pattern of texts that are not cut at their spaces: those with
    longer runs of white space around a space, or with a special token."""
    return "|".join([_WHITE + " (?:" + _WHITE + "|$)", *map(re.escape, special)])


def cut(texts: pa.Array, whole: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(texts that are not cut, chunks of all others, where each one's begin and end)."""
    odd = pc.match_substring_regex(texts, whole)
    lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return odd.to_numpy(zero_copy_only=False), lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


class Coded(NamedTuple):
    """Token ids of some texts: each text's, their decimals joined by commas, and the bytes they decode to."""

    ids: pa.Array
    decimals: list[bytes]
    decoded: list[bytes]


class Encoder:
    """Encodes texts exactly as the vocabulary's own library does.

    A text is cut at its spaces; a chunk and the space before it split into
    words on their own, whatever surrounds them, unless the space stands
    inside a longer run of white space. Texts with such runs are split whole.
    """

    _run = regex.compile(r"\s (?:\s|$)")

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None):
        self.vocab, self.lexicon, self.whole = vocab, lexicon, whole_texts(vocab.special)
        self._reset()

    def _reset(self) -> None:
        # numbers of chunks at the start of a text and after a space, and of words in longer chunks
        self.first, self.later, self.words = {"": 0}, {}, {}
        self.ids, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used, self.known = 0, 1

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Numbers under which the ids are found from now on."""
        first, end = self.known, self.known + len(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while end > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.ids[self.used:self.used + len(ids)] = ids
        self.at[first:end] = self.used + np.cumsum(sizes) - sizes
        self.size[first:end] = sizes
        self.used += len(ids)
        self.known = end
        return range(first, end)

    def _of(self, numbers: Iterable[int]) -> np.ndarray:
        """Ids of chunks or words, one after the other."""
        numbers = np.asarray(numbers, np.int64)
        return self.ids[ranges(self.at[numbers], self.size[numbers])]

    def _found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        if self.lexicon is None:
            return self.vocab.merged(raw)
        at, lex = self.lexicon.find(raw), self.lexicon
        rest = np.flatnonzero(at < 0)
        ids, n = self.vocab.merged([raw[k] for k in rest.tolist()])
        hit, starts, sizes = at >= 0, np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        starts[hit], sizes[hit] = lex.offs[at[hit]], lex.offs[at[hit] + 1] - lex.offs[at[hit]]
        starts[rest], sizes[rest] = len(lex.ids) + np.cumsum(n) - n, n
        return np.concatenate([lex.ids, ids])[ranges(starts, sizes)], sizes

    def _forget(self) -> None:
        if len(self.later) + len(self.first) + len(self.words) > MEMO_CHUNKS:
            self._reset()

    def _remember(self, first: Iterable[str], later: Iterable[str], words: Iterable[str] = ()) -> None:
        """Have words and the chunks at the start of texts and after spaces in the memos."""
        find = self.vocab.pattern.findall
        # ASCII letters alone are one word, as the pattern has it
        split_first = {c: [c] if c.isascii() and c.isalpha() else find(c) for c in first if c not in self.first}
        split_later = {c: [" " + c] if c.isascii() and c.isalpha() else find(" " + c) for c in later if c not in self.later}
        # a chunk that is one word is remembered as a chunk only
        one, inner = {}, dict.fromkeys(w for w in words if w not in self.words)
        for split in (split_first, split_later):
            for found in split.values():
                if len(found) == 1:
                    one[found[0]] = None
                else:
                    inner.update((w, None) for w in found if w not in self.words)
        new = list(one | inner)
        known = dict(zip(new, self._store(*self._found(new))))
        self.words.update((w, known[w]) for w in inner)
        for memo, split in ((self.first, split_first), (self.later, split_later)):
            memo.update((c, known[found[0]]) for c, found in split.items() if len(found) == 1)
            if several := [(c, found) for c, found in split.items() if len(found) != 1]:
                at = np.fromiter((self.words[w] for _, found in several for w in found), np.int64)
                n = np.fromiter((len(found) for _, found in several), np.int64, len(several))
                sizes = np.diff(np.r_[0, np.cumsum(self.size[at])][np.r_[0, np.cumsum(n)]])
                memo.update(zip((c for c, _ in several), self._store(self._of(at), sizes)))

    def batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        self._forget()
        find, v = self.vocab.pattern.findall, self.vocab
        plan: list[list] = []  # per text: pieces of (kind, list) or a special id
        first, later, words = set(), set(), set()
        for text in texts:
            pieces = []
            for k, part in enumerate(v.splitter.split(text) if v.splitter else [text]):
                if k % 2:
                    pieces.append(v.special[part])
                elif self._run.search(part):
                    found = find(part)
                    words.update(found)
                    pieces.append((2, found))
                elif part:
                    chunks = part.split(" ")
                    if chunks[0]:
                        first.add(chunks[0])
                    later.update(chunks[1:])
                    pieces.append((0, chunks))
            plan.append(pieces)
        self._remember(first, later, words)
        out = []
        for pieces in plan:
            ids: list[int] = []
            for piece in pieces:
                if isinstance(piece, int):
                    ids.append(piece)
                elif piece[0] == 2:
                    ids.extend(self._of(list(map(self.words.__getitem__, piece[1]))).tolist())
                else:
                    chunks = piece[1]
                    ids.extend(self._of([self.first[chunks[0]], *map(self.later.__getitem__, chunks[1:])]).tolist())
            out.append(ids)
        return out

    def coded(self, texts: pa.Array) -> Coded:
        """All there is to say of each text's ids; a null text is empty.

        Arrow cuts and numbers the chunks, and joins what the ids stand for;
        texts that are not cut go through ``batch``.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd, chunks, offsets = cut(texts, self.whole)
        tail = self.batch(texts.filter(pa.array(odd)).to_pylist()) if odd.any() else []
        self._forget()
        numbered, heads = chunks.dictionary_encode(), offsets[:-1]
        later = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = chunks.take(pa.array(heads)).to_pylist()
        self._remember(dict.fromkeys(first), later)
        at = np.fromiter(map(self.later.__getitem__, later), np.int64, len(later))[numbered.indices.to_numpy()]
        at[heads] = np.fromiter(map(self.first.__getitem__, first), np.int64, len(first))
        n = np.zeros(len(texts), np.int64)
        n[~odd] = np.diff(np.r_[0, np.cumsum(self.size[at])][offsets])
        n[odd] = list(map(len, tail))
        ids, inside = np.zeros(int(n.sum()), np.int32), np.repeat(~odd, n)
        ids[inside], ids[~inside] = self._of(at), list(chain.from_iterable(tail))
        ids, ends = pa.array(ids), np.r_[0, np.cumsum(n)]
        joined = (pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), shown.take(ids)), pa.scalar(by, pa.large_binary())).to_pylist()
                  for shown, by in ((self.vocab.decimals, b","), (self.vocab.raw, b"")))
        return Coded(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), *joined)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of token ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.vocab.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(1)
def worker_encoder(path: str, lexicon: bytes) -> Encoder:
    """The encoder of this Python worker; its memo outlives a task."""
    return Encoder(vocabulary(path), Lexicon.mapped(lexicon))


# -------------------------------------------------------------- operator --
def word_counts(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """(word, n) over every whole text; workers add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, empty, space = vocabulary(vocab_path).pattern.findall, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        for b in slices_by_bytes(batches, 0, COUNT_SLICE):
            lists = pc.split_pattern(b.column(0).cast(pa.large_string()).drop_null(), " ")
            chunks, n = lists.flatten().value_counts().flatten()
            letters = pc.ascii_is_alpha(chunks)
            words: Counter = Counter()
            for c, m in zip(chunks.filter(pc.invert(letters)).to_pylist(), n.filter(pc.invert(letters)).to_pylist()):
                for w in find(" " + c):
                    words[w] += m
            spaced = pc.binary_join_element_wise(empty, chunks.filter(letters), space)
            yield pa.RecordBatch.from_arrays([spaced.cast(pa.string()), n.filter(letters)], ["word", "n"])
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

    return (docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_lexicon(docs: DataFrame, vocab_path: str, words: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """Automaton of the most frequent words of the whole corpus, at most ``words``.

    Which words it holds never changes a result, only how many words are
    merged by rank instead.
    """
    often = word_counts(docs, vocab_path, text).where((F.col("n") > 1) & F.octet_length("word").between(1, LEXICON_BYTES))
    with passing(often, "words") as counts:
        raw = [r.word.encode() for r in frequent(counts, "word", "n", words)]
    return compile_lexicon(dict(zip(raw, vocabulary(vocab_path).merge(raw))))


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text",
           lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every whole text: (id, ids array<int>, decoded string).

    A null text is the empty text: no ids, decoded to ''. Rows repeat as they
    repeat in the input; a null id stays null; an empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    return _run_encoder(docs, vocab_path, id_col, text, lexicon_words, digests=False)


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text",
                   lexicon_words: int = LEXICON_WORDS, with_ids: bool = False, position: str | None = None) -> DataFrame:
    """The operator with its ids and texts reduced, inside the task, to
    (id, n_tokens, ids_sha256, decoded_sha256): bulky columns never leave it,
    but for the ids where asked for. A column ``position`` is kept, as the last."""
    return _run_encoder(docs, vocab_path, id_col, text, lexicon_words, digests=True, with_ids=with_ids, position=position)


def _run_encoder(docs, vocab_path, id_col, text, lexicon_words, digests, with_ids=False, position=None):
    held = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, vocab_path, lexicon_words, text))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(vocab_path, held.value)
        for b in slices_by_bytes(batches, 1, SLICE):
            found = enc.coded(b.column(1))
            texts = [t.decode("utf-8", "replace") for t in found.decoded]
            if digests:
                cols = [pc.list_value_length(found.ids).cast(pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in found.decimals]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(found.ids)
                    names.append("ids")
            else:
                cols = [found.ids, pa.array(texts, pa.string())]
                names = [id_col, "ids", "decoded"]
            if position:
                cols.append(b.column(2))
                names.append(position)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out += ", ids array<int>" if with_ids else ""
    out += f", `{position}` {docs.schema[position].dataType.simpleString()}" if position else ""
    return (docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("text"), *([F.col(f"`{position}`")] if position else []))
            .mapInArrow(run, f"`{id_col}` {id_type}, {out}"))
