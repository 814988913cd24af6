"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text is a lattice: every way to write it as pieces of the vocabulary is a path. Forward filtering sums, at each
position, the weight of all paths that lead there; backward sampling then draws the last piece, the one before it, and so on,
each with its exact posterior probability. Random numbers are a hash of the row's key, the unit and the step, so a
row's segmentation depends on nothing but the row.

No piece crosses the start of a space run, and none holds a character outside the vocabulary, so the lattice falls
apart into units there. Units are filtered once per distinct unit of a chunk of rows; all occurrences are then sampled side
by side. Characters outside the vocabulary, and the space mark itself, become byte pieces, which keeps decoding lossless
without any normalisation.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, buffers, chunks, fresh, mix, prefix_hash, ranges, small_batches, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
#: Pieces weigh (rank + 2) ** -THETA: larger values bring the sample nearer to the single best path.
THETA = 1.5
#: Units are sampled in chunks of so many bytes of text.
SAMPLE_BYTES = 2 << 20


class Vocabulary:
    """Flat tables of a model: character codes, a hash table of pieces, and each piece's bytes."""

    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        surface: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b] = i
                surface[i] = bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                surface[i] = piece.replace("▁", " ").encode()
                normal.append((i, [ord(c) for c in piece]))
        used = sorted({c for _, cs in normal for c in cs if len(cs) > 0})
        singles = {cs[0] for _, cs in normal if len(cs) == 1}
        self.code = np.zeros(0x110000, np.uint16)  # 0: outside the vocabulary
        for k, c in enumerate((c for c in used if c in singles), 1):
            self.code[c] = k
        self.values = mix(np.arange(1, len(used) + 2, dtype=np.uint64) * GOLDEN)
        self.longest = max(len(cs) for _, cs in normal)
        order = {i: r for r, (i, _) in enumerate(sorted(normal, key=lambda x: (-model.get_score(x[0]), x[0])))}
        ids, hashes, weights = [], [], []
        for i, cs in normal:
            codes = self.code[np.array(cs)]
            if (codes == 0).any():
                continue
            h = prefix_hash(self.values[codes])
            ids.append(i)
            hashes.append(int(span_hash(h, np.array([0]), np.array([len(cs)]))[0]))
            weights.append((order[i] + 2.0) ** -theta)
        self._fill(ids, hashes, weights)
        self.lengths = np.array([len(s) for s in surface], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.pool = np.frombuffer(b"".join(surface), np.uint8)

    def _fill(self, ids, hashes, weights) -> None:
        """Open addressing with linear probing; an empty slot's key is 0."""
        self.bits = (4 * len(ids)).bit_length()
        self.key, self.id, self.weight = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits)
        for i, h, w in zip(ids, hashes, weights, strict=True):
            at = h >> (64 - self.bits)
            while self.key[at]:
                at = (at + 1) % (1 << self.bits)
            self.key[at], self.id[at], self.weight[at] = h, i, w

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.key[at]
        out = np.where(key == h, at, -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            key = self.key[at[left]]
            out[left[key == h[left]]] = at[left[key == h[left]]]
            left = left[(key != h[left]) & (key != 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL, theta: float = THETA) -> Vocabulary:
    return Vocabulary(path, theta)


def code_points(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte each starts at."""
    start = np.flatnonzero((body & 0xC0) != 0x80)
    lead = body[start].astype(np.uint32)
    if not (lead >= 0x80).any():
        return lead, start
    padded = np.concatenate((body, np.zeros(3, np.uint8)))
    out = lead.copy()
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        at = np.flatnonzero((lead >= low) & (lead < high))
        if len(at):
            value = lead[at] & mask
            for k in range(1, more + 1):
                value = (value << np.uint32(6)) | (padded[start[at] + k] & np.uint32(0x3F))
            out[at] = value
    return out, start


def _lattice(v: Vocabulary, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward filtering of units (first, length into codes): per character and piece length, the cumulative posterior
    of the piece that ends there, and its id. Weights are rescaled at each position, so long units don't underflow."""
    n, wide = len(codes), v.longest
    prefix = prefix_hash(v.values[codes])
    place = np.arange(n) - np.repeat(first, length)  # position in its unit
    piece = np.full((n, wide), -1, np.int16 if len(v.lengths) < 1 << 15 else np.int32)
    edge = np.zeros((n, wide), np.float32)
    reach = np.zeros(n, np.int8)
    ends = np.arange(n)
    for size in range(1, wide + 1):
        at = ends[place[ends] >= size - 1]
        if not len(at):
            break
        slot = v.find(span_hash(prefix, at - size + 1, at + 1))
        found = np.flatnonzero(slot >= 0)
        piece[at[found], size - 1] = v.id[slot[found]]
        edge[at[found], size - 1] = v.weight[slot[found]]
        reach[at[found]] = size
        ends = at
    # Columns beyond a unit's longest piece stay 1: no number reaches them.
    cumulative = np.ones((n, wide), np.float32)
    longest = np.maximum.reduceat(reach, first) if len(first) else reach
    done = 0
    for width in (4, 6, 8, wide):
        mine = np.flatnonzero((longest > done) & (longest <= width))
        done = width
        order = mine[np.argsort(-length[mine], kind="stable")]
        tops, starts = length[order], first[order]
        # alpha is kept relative to the position before: back[u, k] = alpha(p - 1 - k) / alpha(p - 1).
        back = np.zeros((len(order), width))
        back[:, 0] = 1.0
        for p in range(int(tops[0]) if len(tops) else 0):
            live = int(np.searchsorted(-tops, -p, side="left"))  # units longer than p
            at = starts[:live] + p
            mass = np.cumsum(edge[at, :width] * back[:live], axis=1)
            total = mass[:, -1:]
            cumulative[at, :width] = mass / total
            back = np.concatenate((np.ones((live, 1)), back[:live, :-1] / total), axis=1)
    return cumulative, piece


def _sample(v: Vocabulary, codes: np.ndarray, row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row of each) for in-vocabulary characters `codes` (0 elsewhere) with their rows, sampled by row keys.

    Returns for every character that ends a piece its id, else -1; characters outside the vocabulary get -2.
    """
    out = np.full(len(codes), -1, np.int32)
    out[codes == 0] = -2
    mark = int(v.code[MARK])
    known = codes > 0
    before = np.concatenate(([0], codes[:-1]))
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    begin = known & (new_row | (before == 0) | ((codes == mark) & (before != mark)))
    first = np.flatnonzero(begin)
    if not len(first):
        return out, row
    stop = np.flatnonzero(known & np.concatenate((begin[1:] | ~known[1:] | new_row[1:], [True]))) + 1
    length = stop - first
    name = span_hash(prefix_hash(v.values[codes]), first, stop)
    _, one, which = np.unique(name, return_index=True, return_inverse=True)
    u_length = length[one]
    u_first = np.concatenate(([0], np.cumsum(u_length)))[:-1]
    flat = codes[np.repeat(first[one], u_length) + ranges(u_length)]
    cumulative, piece = _lattice(v, flat, u_first, u_length)
    # Position of a unit in its row seeds it, so chunks of rows don't matter.
    row_start = np.maximum.accumulate(np.where(new_row, np.arange(len(codes)), 0))
    seed = mix(keys[row[first]] + (first - row_start[first]).astype(np.uint64) * GOLDEN)
    left, base, target, step = length.copy(), u_first[which], first, 0
    while len(left):
        at = base + left - 1
        u = (mix(seed + np.uint64(step)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        size = (cumulative[at] <= u[:, None]).sum(axis=1)
        # Rounding can leave the last sum a hair under u; the longest edge of that end is then meant.
        over = np.flatnonzero(size >= v.longest)
        if len(over):
            size[over] = v.longest - 1 - np.argmax(piece[at[over]][:, ::-1] >= 0, axis=1)
        out[target + left - 1] = piece[at, size]
        left = left - size - 1
        on = left > 0
        left, base, target, seed, step = left[on], base[on], target[on], seed[on], step + 1
    return out, row


def encode_rows(v: Vocabulary, body: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts per row) of rows of UTF-8 bytes."""
    points, start = code_points(body)
    codes = np.where(points == 0x20, v.code[MARK], np.where(points == MARK, 0, v.code[points])).astype(np.int64)
    row = np.searchsorted(offsets, start, side="right") - 1
    ids, row = _sample(v, codes, row, keys)
    width = np.diff(np.append(start, len(body)))
    # One entry per piece end, and one per byte of an unknown character.
    times = np.where(ids >= 0, 1, np.where(ids == -2, width, 0))
    flat = np.repeat(ids, times)
    raw = np.flatnonzero(flat == -2)
    if len(raw):
        odd = ids == -2
        flat[raw] = v.byte_id[body[np.repeat(start[odd], width[odd]) + ranges(width[odd])]]
    return flat, np.bincount(np.repeat(row, times), minlength=len(offsets) - 1)


def decode_rows(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of a run of ids."""
    n = v.lengths[ids]
    return v.pool[np.repeat(v.starts[ids], n) + ranges(n)]


def encoder(path: str = MODEL, theta: float = THETA):
    """An Arrow UDF (key, text) -> struct<ids, lossless>; a null text has null ids."""

    @F.arrow_udf("struct<ids: array<int>, lossless: boolean>")
    def encode(key: pa.Array, text: pa.Array) -> pa.Array:
        v = vocabulary(path, theta)
        body, offsets, valid = buffers(text)
        keys = mix(np.asarray(key.fill_null(0)).astype(np.int64).view(np.uint64) ^ GOLDEN)
        parts, sizes, same = [], np.zeros(len(text), np.int64), np.ones(len(text), bool)
        for i, j in chunks(offsets, SAMPLE_BYTES):
            part, at = body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            ids, count = encode_rows(v, part, at, keys[i:j])
            back = decode_rows(v, ids)
            if len(back) != len(part) or not np.array_equal(back, part):
                ends = np.concatenate(([0], np.cumsum(count)))
                for k in range(j - i):
                    same[i + k] = decode_rows(v, ids[ends[k] : ends[k + 1]]).tobytes() == part[at[k] : at[k + 1]].tobytes()
            parts.append(ids)
            sizes[i:j] = count
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array(~valid))
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_(), mask=~valid)], ["ids", "lossless"])

    return encode


def decoder(path: str = MODEL):
    """An Arrow UDF ids -> text; ids must be those of an encoding."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        v = vocabulary(path)
        out = []
        for x in ids:
            out.append(None if not x.is_valid else decode_rows(v, np.asarray(x.values, np.int64)).tobytes().decode())
        return pa.array(out, pa.string())

    return decode


def row_key(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def encode(docs: DataFrame, path: str = MODEL, theta: float = THETA) -> DataFrame:
    """docs(doc_id, text, ...) with piece_ids array<int> and lossless boolean (whether decoding gives the text's bytes back).

    A null text has null ids and null lossless; an empty one has no ids. The same doc_id and text always get the same ids;
    a null doc_id is replaced by a hash of the text. Very long texts are one chunk each. Other columns are carried;
    clashing names get more underscores. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    ids, ok, s = fresh(docs, "piece_ids"), fresh(docs, "lossless"), fresh(docs, "_encoded")
    out = docs.withColumn(s, encoder(path, theta)(row_key(docs), F.col("text").cast("string")))
    return out.withColumns({ids: F.col(s)["ids"], ok: F.col(s)["lossless"]}).drop(s)
