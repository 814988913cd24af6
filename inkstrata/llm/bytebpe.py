"""Byte-level BPE encoding and decoding: padded matrices of words, bucketed by length, in which every row merges its leftmost
least-ranked pair each round.

A text is cut by the tokenizer's pattern; each match is encoded for itself. Equal matches of a worker's batches are encoded once. A match
that is an entry of the vocabulary is that entry; the others become rows of byte ids, padded to their bucket's width. Each round looks up
the ranks of the pairs that changed in a hash table, takes every row's least rank, merges the leftmost pair that has it, and closes
the gaps. Further pairs of that rank in the row are merged in the same round as long as no merge so far made a pair of lower rank, so the
outcome is that of merging one pair at a time. Rows without a pair leave the matrix.

Nothing is shuffled; a task holds a batch of rows. Long texts are matched in slices that end between matches, and long
matches are cut where no entry of the vocabulary joins the two bytes beside the cut, so memory is bounded but for the row itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, fresh, ranges, small_batches, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: No pair.
NONE = np.int32(2**31 - 1)
#: Cells of a matrix, characters that are matched at once, and the bytes from which a match is cut into independent parts.
CELLS, SLICE, LONG = 1 << 20, 1 << 20, 64
#: Words that are met together, and words that a worker keeps with their ids.
GROUP, MEMO = 1 << 19, 1 << 18


class Ranks:
    """A vocabulary of byte strings whose ids are their ranks, with the pairs that make each entry in a hash table."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.whole = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        if any(bytes([b]) not in self.whole for b in range(256)):
            raise ValueError(f"{path} lacks single bytes")
        self.byte_id = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        most = max(self.whole.values()) + 1
        texts = [b""] * most
        for token, rank in self.whole.items():
            texts[rank] = token
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(texts), np.uint8)
        pairs, ids = [], []
        #: Which byte can follow which inside an entry.
        self.joined = np.zeros((256, 256), bool)
        get = self.whole.get
        for token, rank in self.whole.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    ids.append(rank)
            if len(token) > 1:
                own = np.frombuffer(token, np.uint8)
                self.joined[own[:-1], own[1:]] = True
        self._fill(np.array(pairs, np.int64), np.array(ids, np.int32))
        self.memo = Memo(self)

    def _fill(self, pairs: np.ndarray, ids: np.ndarray) -> None:
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at = self._slot(pairs)
        while len(pairs):
            free = self.keys[at] < 0
            self.keys[at[free]] = pairs[free]  # of several in one slot one stays
            here = self.keys[at] == pairs
            self.values[at[here]] = ids[here]
            pairs, ids, at = pairs[~here], ids[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges into, NONE where they don't."""
        pairs = left.astype(np.int64) << 32 | right.astype(np.int64)  # a padding of -1 gives a negative pair, which no slot holds
        at = self._slot(pairs)
        found = self.keys[at]
        same = found == pairs
        out = np.where(same & (found >= 0), self.values[at], NONE)
        open_ = np.flatnonzero(~same & (found >= 0) & (pairs >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == pairs[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


_LOADED: dict[str, Ranks] = {}


def ranks(path: str | None = None) -> Ranks:
    """The vocabulary of a file, kept for the worker's next batch; by default the public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    if path not in _LOADED:
        _LOADED[path] = Ranks(path)
    return _LOADED[path]


def matches(pattern: regex.Pattern, text: str, most: int = SLICE) -> Iterator[list[str]]:
    """The pattern's matches over the text, in lists of about `most` characters.

    A slice's end can change its last two matches (a contraction, or a run of spaces), so they are matched again with the next slice.
    """
    at, width = 0, most
    while len(text) - at > width:
        found = pattern.findall(text, at, at + width)
        used = sum(map(len, found[:-2]))
        if used == 0:
            width *= 2
            continue
        yield found[:-2]
        at, width = at + used, most
    yield pattern.findall(text, at)


def merged(v: Ranks, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) after all merges of rows of byte ids."""
    first = np.cumsum(counts) - counts
    bucket = np.ceil(np.log2(np.maximum(counts, 2))).astype(int)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in np.unique(bucket):
        rows = np.flatnonzero(bucket == b)
        step = max(1, CELLS >> int(b))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            n = counts[some]
            inside = np.arange(int(n.max()))[None, :] < n[:, None]
            matrix = np.full(inside.shape, -1, np.int32)
            matrix[inside] = ids[np.repeat(first[some], n) + ranges(n)]
            found += [(some[at], size, flat) for at, size, flat in _rounds(v, matrix, n)]
    if not found:
        return ids[:0], counts
    rows, sizes, flat = (np.concatenate(x) for x in zip(*found, strict=True))
    start, order = np.cumsum(sizes) - sizes, np.argsort(rows, kind="stable")
    sizes, start = sizes[order], start[order]
    return flat[np.repeat(start, sizes) + ranges(sizes)], sizes


def _rounds(v: Ranks, tokens: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, counts, ids) of the rows that have no pair any more. tokens is padded with -1; n are the rows' lengths."""
    names = np.arange(len(n))
    value = np.full(tokens.shape, NONE, np.int32)  # value[r, c]: the rank of the pair at c, c + 1
    value[:, :-1] = v.rank(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(n), -1)
    while True:
        least = value.min(axis=1)
        live = least != NONE
        if not live.all():
            done = ~live
            yield names[done], n[done], tokens[done][tokens[done] >= 0]
            if not live.any():
                return
            names, n, least = names[live], n[live], least[live]
            width = int(n.max())
            tokens, value = tokens[live, :width], value[live, :width]
        width = tokens.shape[1]
        r, c = _picked(v, tokens, value, n, least)
        at = r * width + c
        tokens, value = np.ascontiguousarray(tokens), np.ascontiguousarray(value)
        tokens.ravel()[at], value.ravel()[at] = least[r], -1
        keep = tokens >= 0
        keep.ravel()[at + 1] = False
        n = n - np.bincount(r, minlength=len(n))
        width = int(n.max())
        inside = np.arange(width)[None, :] < n[:, None]
        closed, ranked = np.full(inside.shape, -1, np.int32), np.full(inside.shape, NONE, np.int32)
        closed[inside], ranked[inside] = tokens[keep], value[keep]
        tokens, value = closed, ranked
        # The pairs on both sides of what was merged.
        at = np.flatnonzero(value == -1)
        c = at % width
        one, pairs = tokens.ravel(), value.ravel()
        pairs[at] = NONE
        left, right = at[c > 0], at[c + 1 < width]
        pairs[left - 1] = v.rank(one[left - 1], one[left])
        pairs[right] = v.rank(one[right], one[right + 1])


def _picked(v: Ranks, tokens: np.ndarray, value: np.ndarray, n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the pairs that a round merges: the leftmost of least rank, and those after it which come next."""
    r, c = np.divmod(np.flatnonzero(value == least[:, None]), value.shape[1])
    # Of overlapping pairs every other one is there when its turn comes.
    head = np.ones(len(r), bool)
    head[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
    start = np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))
    turn = (np.arange(len(r)) - start) % 2 == 0
    r, c = r[turn], c[turn]
    first = np.ones(len(r), bool)
    first[1:] = r[1:] != r[:-1]
    if first.all():
        return r, c
    # A merge that makes a pair of lower rank is the round's last in its row.
    new = least[r]
    behind = np.zeros(len(r), bool)
    behind[1:] = ~first[1:] & (c[1:] == c[:-1] + 2)
    lower = np.zeros(len(r), bool)
    left, right = np.flatnonzero(c > 0), np.flatnonzero(c + 2 < n[r])
    before = np.where(behind[left], new[left], tokens[r[left], c[left] - 1])
    lower[left] = v.rank(before, new[left]) < new[left]
    lower[right] |= v.rank(new[right], tokens[r[right], c[right] + 2]) < new[right]
    total = np.cumsum(lower) - lower  # those that stopped a row before this pair
    base = np.maximum.accumulate(np.where(first, total, 0))
    go = total == base
    return r[go], c[go]


def encode_words(v: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of words, each for itself."""
    whole = np.array([v.whole.get(w, -1) for w in words], np.int64)
    rest = np.flatnonzero(whole < 0)
    sizes = np.array([len(words[i]) for i in rest], np.int64)
    body = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(rest)), sizes)
    # Long words are cut where no entry can cross.
    head = np.zeros(len(body), bool)
    head[starts[sizes > 0]] = True
    if len(body) > 1:
        head[1:] |= ~v.joined[body[:-1], body[1:]] & (sizes[word[1:]] >= LONG)
    at = np.flatnonzero(head)
    ids, counts = merged(v, v.byte_id[body], np.diff(np.append(at, len(body))))
    of_word = np.zeros(len(words), np.int64)
    np.add.at(of_word, rest[word[at]], counts)
    of_word[whole >= 0] = 1
    out = np.empty(int(of_word.sum()), np.int32)
    ends = np.cumsum(of_word)
    out[ends[whole >= 0] - 1] = whole[whole >= 0]
    out[np.repeat((ends - of_word)[rest], of_word[rest]) + ranges(of_word[rest])] = ids
    return out, of_word


class Memo:
    """Encoded words, kept for the worker's next batches until there are MEMO of them; what is kept only saves time."""

    def __init__(self, v: Ranks) -> None:
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words."""
        # Arrow tells the distinct words, so that Python's dictionary is asked once for each.
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.index]
        if len(self.index) + len(new) > MEMO:
            self.clear()
            new = distinct
        if new:
            ids, counts = encode_words(self.v, [w.encode() for w in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        which = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        first, times = np.cumsum(self.counts) - self.counts, self.counts[which]
        return self.ids[np.repeat(first[which], times) + ranges(times)], times


def encode_texts(v: Ranks, pattern: regex.Pattern, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of texts. Matches are met in groups of about GROUP."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    words: list[str] = []
    owner: list[tuple[int, int]] = []

    def flush() -> None:
        ids, times = v.memo.encode(words)
        parts.append(ids)
        who, n = np.array(owner).T
        np.add.at(counts, np.repeat(who, n), times)
        words.clear()
        owner.clear()

    for k, text in enumerate(texts):
        for found in matches(pattern, text):
            if found:
                words += found
                owner.append((k, len(found)))
            if len(words) >= GROUP:
                flush()
    if words:
        flush()
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), counts


def decode_ids(v: Ranks, ids: np.ndarray) -> np.ndarray:
    """The bytes of a run of ids."""
    n = v.lengths[ids]
    return v.pool[np.repeat(v.starts[ids], n) + ranges(n)]


def _pattern(text: str | None) -> regex.Pattern:
    if text is None:
        import public_tokenizers

        text = public_tokenizers.PATTERN
    return regex.compile(text)


def encoder(path: str | None = None, pattern: str | None = None):
    """An Arrow UDF text -> ids; a null text has null ids."""

    @F.arrow_udf("array<int>")
    def encode_(text: pa.Array) -> pa.Array:
        v, cutter = ranks(path), _pattern(pattern)
        parts, sizes, i = [], np.zeros(len(text), np.int64), 0
        lengths = np.asarray(pa.compute.binary_length(text).fill_null(0)).astype(np.int64)
        ends = np.cumsum(lengths)
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - lengths[i] + 2 * CHUNK_BYTES, side="right")))
            ids, sizes[i:j] = encode_texts(v, cutter, [t or "" for t in text[i:j].to_pylist()])
            parts.append(ids)
            i = j
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        mask = pa.array(np.asarray(text.is_null())) if text.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=mask)

    return encode_


def unpacker(path: str | None = None):
    """An Arrow UDF ids -> struct<packed, body>: the ids as little-endian unsigned 32-bit integers, and the bytes that they stand for."""

    @F.arrow_udf("struct<packed: binary, body: binary>")
    def unpack(ids: pa.Array) -> pa.Array:
        v = ranks(path)
        rows = [None if not x.is_valid else np.asarray(x.values, np.int64) for x in ids]
        packed = pa.array([None if x is None else x.astype("<u4").tobytes() for x in rows], pa.binary())
        body = pa.array([None if x is None else decode_ids(v, x).tobytes() for x in rows], pa.binary())
        return pa.StructArray.from_arrays([packed, body], ["packed", "body"])

    return unpack


def encode(docs: DataFrame, column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with token_ids array<int>, the ids of the whole text.

    `path` is a file of base64 entries and ranks, `pattern` what cuts a text into matches; None is the public vocabulary's. The file is read
    where tasks run. A null text has null ids, an empty one none. Equal texts have equal ids, repeated rows stay, other columns are carried
    and a clashing name gets underscores. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, "token_ids"), encoder(path, pattern)(text_of(docs, column)))


def decode(rows: DataFrame, ids: str | Column = "token_ids", path: str | None = None) -> DataFrame:
    """rows with token_bytes struct<packed binary, body binary>: ids as they are kept in files, and the bytes that they decode to.

    Null ids give a null struct's fields; ids must be of the vocabulary. Bytes needn't be text: a token can end within a character.
    """
    small_batches(rows.sparkSession)
    return rows.withColumn(fresh(rows, "token_bytes"), unpacker(path)(F.col(ids) if isinstance(ids, str) else ids))
