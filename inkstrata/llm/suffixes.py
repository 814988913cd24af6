"""Exact removal of repeated passages by suffix sorting.

A byte goes if a LENGTH-byte string around it also starts in a document with a smaller id. Strings are compared as suffixes
in a sparse suffix array: of all suffixes only those that start at a minimiser are sorted. Each window of LENGTH bytes holds
a minimiser that its bytes alone decide, so equal windows meet at equal minimisers.

1. Each batch of rows lists its minimisers, one entry per hash, to the hash's bucket; buckets return those that occur in
   other documents. Entries of a hash are one per batch, however many rows hold it, with the number of documents. Hashes of more than
   `hot` documents are collected: at most a document's minimisers / `hot`, and `hot` grows with the input so that they are 2^22 at most.
2. Rows look at the surroundings of these minimisers. In a batch, equal surroundings beyond the first document's are covered at
   once; one entry per distinct surrounding goes to its bucket, with its bytes. There, equal ones beyond the first document's are
   covered as well. The first ones of differing surroundings are suffix-sorted: multikey quicksort over 8-byte symbols to a
   shallow depth, then blind tries for groups that still agree. Runs of the array that share the minimiser are
   compared through the LCP array to the right and directly to the left; what adds up to LENGTH is covered.
   A hot hash would bring the surroundings of a common line in all its documents to one bucket. Each window of which it is the
   minimiser is sent by a hash of its own instead, once per batch: windows inside the line are as many entries as there are
   batches, and those that run over its edge go to as many buckets as there are continuations.
3. Intervals are united per row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import buffers, chunks, cut, mix, prefix_hash, ranges, small_batches, span_hash

LENGTH = 50
GRAM = 16
#: q-grams in one window of LENGTH bytes.
REACH = LENGTH - GRAM + 1
#: Bytes that multikey quicksort orders before blind tries take over.
SHALLOW = 24
#: Runs up to this length are compared pair by pair.
PAIRWISE = 24
#: Text bytes that a worker lists or looks at together.
BATCH_BYTES = 8 << 20
#: Text bytes per bucket.
BUCKET_BYTES = 8 << 20
#: Entries that a bucket resolves at once, unless one hash has more; no hash has more than a hot one's documents and places.
SLICE = 1 << 15
#: A hash in more documents than this, or than minimisers / 2^HOT_BITS, is hot.
HOT, HOT_BITS = 4096, 22


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over each n neighbours of x, by doubling."""
    done, out = 1, x
    while done * 2 <= n:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[: len(out) - (n - done)], out[n - done :]) if done < n else out


def anchors(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, hash) of minimisers of all windows inside rows, the prefix hash of body, and each window's hash (0: outside)."""
    prefix = prefix_hash(common.BYTE_VALUES[body])
    n = len(body) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < REACH:
        return none, none, np.zeros(0, np.uint64), prefix, np.zeros(0, np.uint64)
    at = np.arange(n)
    h = span_hash(prefix, at, at + GRAM) | np.uint64(1)
    least = _slide(h, REACH, np.minimum)
    row = np.searchsorted(offsets, at[: len(least)], side="right") - 1
    # A window that runs over a row's end asks for nothing.
    asked = np.where(at[: len(least)] + LENGTH <= offsets[row + 1], least, np.uint64(0))
    padded = np.concatenate((np.zeros(REACH - 1, np.uint64), asked, np.zeros(REACH - 1, np.uint64)))
    place = np.flatnonzero(h == _slide(padded, REACH, np.maximum)[:n])
    return place, np.searchsorted(offsets, place, side="right") - 1, h[place], prefix, asked


def _blind(strings: list[int], width: int) -> tuple[list[int], list[int]]:
    """Order of equally long strings (as big-endian numbers), and the LCP of each with the one before, by a blind trie.

    Inner nodes are [position, {byte: child}], leaves lists of equal strings. A string first descends by branching bytes alone;
    the leaf it meets tells its true LCP with the trie, and the branch goes in at that depth.
    """
    byte = lambda s, p: (s >> (8 * (width - 1 - p))) & 255
    root = [0]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, tuple):
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        same = (8 * width - (s ^ strings[node[0]]).bit_length()) // 8
        if same == width:
            node.append(i)
            continue
        up, key, node = None, None, root
        while isinstance(node, tuple) and node[0] < same:
            up, key = node, byte(s, node[0])
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == same:
            node[1][byte(s, same)] = [i]
            continue
        leaf = node
        while isinstance(leaf, tuple):
            leaf = next(iter(leaf[1].values()))
        new = (same, {byte(strings[leaf[0]], same): node, byte(s, same): [i]})
        if up is None:
            root = new
        else:
            up[1][key] = new
    order, lcp, stack = [], [], [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, list):
            order += node
            lcp += [before] + [width] * (len(node) - 1)
        else:
            kids = sorted(node[1].items())
            stack += [(kid, node[0]) for _, kid in kids[:0:-1]]
            stack.append((kids[0][1], before))
    return order, lcp


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of equally long byte rows, and each one's LCP with the one before it (0 for the first).

    Shallow: multikey quicksort, a symbol being 8 bytes; deep: groups that agree on SHALLOW bytes go through blind tries.
    """
    n, width = rows.shape
    lcp = np.zeros(n, np.int64)
    if not n:
        return np.zeros(0, np.int64), lcp
    words = np.ascontiguousarray(rows[:, :SHALLOW]).view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    sorted_words = words[order]
    differ = sorted_words[1:] ^ sorted_words[:-1]
    first = np.argmax(differ != 0, axis=1)
    x = differ[np.arange(n - 1), first]
    some = x != 0
    lead = np.zeros(n - 1, np.int64)
    # Whole bytes that agree at the top of the first differing symbol.
    for k in range(1, 8):
        lead += (x >> np.uint64(64 - 8 * k)) == 0
    lcp[1:] = np.where(some, first * 8 + lead, SHALLOW)
    starts = np.flatnonzero(np.concatenate(([True], some)))
    sizes = np.diff(np.append(starts, n))
    deep = rows[:, SHALLOW:]
    wide = width - SHALLOW
    # Two strings need no trie.
    pair = starts[sizes == 2]
    if len(pair):
        x, y = deep[order[pair]], deep[order[pair + 1]]
        unequal = x != y
        at = np.where(unequal.any(axis=1), np.argmax(unequal, axis=1), wide)
        place = np.minimum(at, wide - 1)
        swap = x[np.arange(len(pair)), place] > y[np.arange(len(pair)), place]
        order[pair[swap]], order[pair[swap] + 1] = order[pair[swap] + 1], order[pair[swap]]
        lcp[pair + 1] = SHALLOW + at
    many = sizes > 2
    for a, size in zip(starts[many].tolist(), sizes[many].tolist(), strict=True):
        part = order[a : a + size]
        raw = deep[part].tobytes()
        got, common_ = _blind([int.from_bytes(raw[i * wide : (i + 1) * wide], "big") for i in range(size)], wide)
        order[a : a + size] = part[got]
        lcp[a + 1 : a + size] = SHALLOW + np.array(common_[1:])
    return order, lcp


def resolve(context: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, bytes to the left, bytes to the right) covered by smaller documents, around the minimisers of entries.

    context holds each entry's `before` bytes up to its minimiser and the `after` bytes from there on, in a row, and zeros behind.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(doc):
        return none
    rows = np.arange(len(doc))[:, None]
    right = context[rows, np.minimum(before[:, None] + np.arange(LENGTH), context.shape[1] - 1)]
    right[np.arange(LENGTH) >= after[:, None]] = 0
    order, lcp = deep_shallow(right)
    run = np.cumsum(lcp < GRAM)
    size = np.bincount(run)
    out = []
    small = size[run] <= PAIRWISE
    reach = lcp.copy()
    for d in range(1, int(min(PAIRWISE, size.max()))):
        if d > 1:
            reach[d:] = np.minimum(reach[d:], lcp[1 : len(lcp) - d + 1])
        j = np.flatnonzero((np.arange(len(lcp)) >= d) & small)
        j = j[run[j] == run[j - d]]
        a, b = order[j - d], order[j]
        later, first = np.where(doc[a] > doc[b], a, b), np.where(doc[a] > doc[b], b, a)
        keep = doc[a] != doc[b]
        out.append(_covered(context, before, after, later[keep], first[keep], reach[j][keep]))
    for r in np.flatnonzero(size > PAIRWISE):
        part = order[run == r]
        # One pass for each place of the window around the minimiser: equal windows meet, the smallest document wins.
        for k in range(REACH):
            p = part[(before[part] >= k) & (after[part] >= LENGTH - k)]
            if len(p) < 2:
                continue
            window = context[p[:, None], before[p][:, None] - k + np.arange(LENGTH)]
            at, same = deep_shallow(window)
            group = np.cumsum(same < LENGTH)
            least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, doc[p[at]])
            hit = p[at][doc[p[at]] > least[group]]
            out.append((hit, np.full(len(hit), k), np.full(len(hit), LENGTH - k)))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3)) if out else none


def _covered(context, before, after, later, first, reach):
    """Of pairs whose bytes from the minimiser agree for `reach` (zeros behind a row's end included): those that share a window."""
    x, y = np.minimum(before[later], before[first]), np.minimum(after[later], after[first])
    back = np.arange(REACH - 1)
    a = context[later[:, None], np.maximum(before[later][:, None] - 1 - back, 0)]
    b = context[first[:, None], np.maximum(before[first][:, None] - 1 - back, 0)]
    off = (a != b) | (back >= x[:, None])
    lead = np.where(off.any(axis=1), np.argmax(off, axis=1), REACH - 1)
    tail = np.minimum(reach, y)
    keep = lead + tail >= LENGTH
    return later[keep], lead[keep], tail[keep]


def unite(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each row, merged where they overlap or touch."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    big = np.int64(1) << 40
    top = np.maximum.accumulate(row * big + end)
    new = np.concatenate(([True], row[1:] * big + start[1:] > top[:-1]))
    first = np.flatnonzero(new)
    return row[first], start[first], np.append(top[first[1:] - 1], top[-1]) - row[first] * big


def _portions(batches):
    """The rows of the batches in numbered batches of about BATCH_BYTES of text."""
    number, waiting, size = 0, [], 0
    for batch in batches:
        _, offsets, _ = buffers(batch.column("text"))
        for i, j in chunks(offsets, BATCH_BYTES):
            waiting.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
            if size >= BATCH_BYTES // 2:
                yield number, pa.concat_batches(waiting)
                number, waiting, size = number + 1, [], 0
    if waiting:
        yield number, pa.concat_batches(waiting)


def _rows(batch: pa.RecordBatch, doc: np.ndarray):
    return np.asarray(batch.column("doc_id")).astype(np.int64)[doc], np.asarray(batch.column("body")).astype(np.int32)[doc]


def _names(ids: np.ndarray, bodies: np.ndarray) -> np.ndarray:
    """One number per (id, body)."""
    return mix(ids.view(np.uint64) ^ mix(bodies.astype(np.int64).view(np.uint64) + common.GOLDEN))


def _split(bucket: np.ndarray, *arrays):
    """Arrays in the order of buckets, and each bucket's range."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return bucket[first], np.append(first, len(bucket)), [a[order] for a in arrays]


def lister(buckets: int):
    """Pass 1: minimisers to their buckets. Those of two documents of the batch are known to be shared; they pass through
    in buckets of their own, which the batch alone chooses."""

    def run(batches):
        for number, batch in _portions(batches):
            body, offsets, _ = buffers(batch.column("text"))
            hashes, docs = [], []
            for i, j in chunks(offsets):
                _, row, h, _, _ = anchors(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes.append(h)
                docs.append(row + i)
            h, doc = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, docs))
            if not len(h):
                continue
            doc = doc.astype(np.int64)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            one = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
            h, doc = h[one], doc[one]
            ids, bodies = _rows(batch, doc)
            begins = np.concatenate(([True], h[1:] != h[:-1]))
            head = np.flatnonzero(begins)
            which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
            low, high = np.minimum.reduceat(ids, head), np.maximum.reduceat(ids, head)
            local = low != high
            # Rows of one doc_id don't share by themselves, so each body of a hash waits for what other batches have.
            other = np.concatenate(([True], (ids[1:] != ids[:-1]) | (bodies[1:] != bodies[:-1])))
            held = np.diff(np.append(head, len(h))).astype(np.int32)
            for through in (False, True):
                pick = np.flatnonzero(local[which]) if through else np.flatnonzero(begins | other & ~local[which])
                seed = int(mix(np.array([int(bodies[0]) + number], np.int64).view(np.uint64))[0] % np.uint64(buckets))
                bucket = np.full(len(pick), buckets + seed) if through else (h[pick] % np.uint64(buckets)).astype(np.int64)
                # An entry that stands for a hash's documents of the batch tells their number; the others tell 0.
                n = np.where(begins[pick], held[which[pick]], 0).astype(np.int32)
                name, at, (hs, ids_, bodies_, known, n) = _split(bucket, h[pick], ids[pick], bodies[pick], local[which[pick]].astype(np.int8), n)
                for b, a, z in zip(name.tolist(), at[:-1], at[1:], strict=True):
                    x = np.lexsort((bodies_[a:z], ids_[a:z]))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((b, pa.int32()), *[(_packed(v[a:z][x]), pa.binary()) for v in (hs, ids_, bodies_, known, n)])], ["bucket", "h", "ids", "bodies", "known", "n"])

    return run, "bucket int, h binary, ids binary, bodies binary, known binary, n binary"


def _packed(x: np.ndarray) -> bytes:
    """The bytes of an array, compressed, after their number."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: pa.Buffer, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8].to_pybytes(), "little"), codec="zstd"), kind)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [_unpacked(x.as_buffer(), kind) for x in table[name] if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


PARTS, ROWS = "part int, ids binary, bodies binary, x binary", "doc_id bigint, body int, x binary"


def _by_part(ids: np.ndarray, bodies: np.ndarray, values: np.ndarray, parts: int) -> pa.Table:
    """Values on their way to their rows: one line for each part of the rows, packed."""
    name, at, (ids, bodies, values) = _split((_names(ids, bodies) % np.uint64(parts)).astype(np.int64), ids, bodies, values)
    lines = [(b, *[_packed(v[a:z]) for v in (ids, bodies, values)]) for b, a, z in zip(name.tolist(), at[:-1], at[1:], strict=True)]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([x[k] for x in lines], kind) for k, kind in enumerate(kinds)], ["part", "ids", "bodies", "x"])


def _arrived(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _joined(table, "ids", np.int64), _joined(table, "bodies", np.int32), _joined(table, "x", kind)


def hashes_of_rows(table: pa.Table) -> pa.Table:
    """A part's hashes, by row."""
    return _by_row(*_arrived(table, np.uint64))


def intervals_of_rows(table: pa.Table) -> pa.Table:
    """A part's intervals, united by row."""
    ids, bodies, x = _arrived(table, np.int32)
    return _by_row(*_intervals(ids, bodies, *x.reshape(-1, 2).astype(np.int64).T))


def sharer(buckets: int, hot: int):
    """The shared minimisers of a bucket, by parts of the rows: a hash is shared if it has entries of two documents. A line of no
    part holds the hashes of more than `hot` documents."""

    def run(table: pa.Table) -> pa.Table:
        h, ids, bodies = (_joined(table, c, k) for c, k in (("h", np.uint64), ("ids", np.int64), ("bodies", np.int32)))
        if table["bucket"][0].as_py() >= buckets:
            return _by_part(ids, bodies, h, buckets)
        order = np.argsort(h, kind="stable")
        h, ids, bodies = h[order], ids[order], bodies[order]
        known, n = _joined(table, "known", np.int8)[order], _joined(table, "n", np.int32)[order]
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
        many = h[head][np.add.reduceat(n.astype(np.int64), head) > hot]
        keep = (np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head))[which] & (known == 0)
        out = _by_part(ids[keep], bodies[keep], h[keep], buckets)
        if not len(many):
            return out
        line = pa.Table.from_arrays([pa.array([None], pa.int32()), *[pa.array([_packed(v)], pa.binary()) for v in (many[:0].view(np.int64), np.zeros(0, np.int32), many)]], out.column_names)
        return pa.concat_tables([out, line])

    return run, PARTS


def _by_row(ids: np.ndarray, bodies: np.ndarray, values: np.ndarray) -> pa.Table:
    """A row for each (id, body), with its values' bytes."""
    order = np.lexsort((bodies, ids))
    ids, bodies, values = ids[order], bodies[order], values[order]
    head = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (bodies[1:] != bodies[:-1])))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(head, len(ids)).astype(np.int64) * (values.nbytes // max(len(values), 1))
    raw = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
    return pa.Table.from_arrays([pa.array(ids[head]), pa.array(bodies[head]), raw.cast(pa.binary())], ["doc_id", "body", "x"])


def looker(buckets: int, hot: np.ndarray):
    """Pass 2: intervals that the batch itself covers, in buckets of their own that the batch chooses; one entry per distinct
    surrounding for the minimisers' buckets; and one entry per distinct window of hot minimisers, for the windows' buckets."""
    span = REACH - 1 + LENGTH

    def picked(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(sorted_):
            return np.zeros(len(x), bool)
        at = np.searchsorted(sorted_, x)
        at[at == len(sorted_)] = 0
        return sorted_[at] == x

    def lines(bucket: np.ndarray, *arrays: np.ndarray):
        name, at, got = _split(bucket, *arrays)
        for b, a, z in zip(name.tolist(), at[:-1], at[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([_packed(v[a:z])], pa.binary()) for v in got]], ["bucket", "ids", "bodies", "rest"])

    def firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys: where each group begins, and each entry's group."""
        new = np.zeros(len(keys[0]), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        head = np.flatnonzero(new)
        return head, np.repeat(np.arange(len(head)), np.diff(np.append(head, len(new))))

    def run(batches):
        for number, batch in _portions(batches):
            body, offsets, _ = buffers(batch.column("text"))
            wanted = batch.column("x")
            parts, wide = [], []
            for i, j in chunks(offsets):
                text, at = body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                place, row, h, prefix, least = anchors(text, at)
                lists = [np.frombuffer(wanted[k].as_buffer(), np.uint64) for k in range(i, j)]
                if not len(place):
                    continue
                owner = np.repeat(np.arange(j - i), [len(x) for x in lists])
                mine = np.unique(mix(np.concatenate(lists)) ^ mix(owner.astype(np.uint64) + common.GOLDEN))
                keep = picked(mine, mix(h) ^ mix(row.astype(np.uint64) + common.GOLDEN)) & ~picked(hot, h)
                place, row, h = place[keep], row[keep], h[keep]
                low, high = np.maximum(place - REACH + 1, at[row]), np.minimum(place + LENGTH, at[row + 1])
                before, after = place - low, high - place
                f = span_hash(prefix, low, high) ^ mix((before * 256 + after).astype(np.uint64))
                parts.append((h, f, row + i, place - at[row], before, after))
                spot = np.flatnonzero(picked(hot, least)) if len(hot) else np.zeros(0, np.int64)
                row = np.searchsorted(at, spot, side="right") - 1
                wide.append((least[spot], span_hash(prefix, spot, spot + LENGTH), row + i, spot - at[row]))
            ours = []
            h, f, row, place, before, after = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(6))
            ids, bodies = _rows(batch, row)
            order = np.lexsort((place, bodies, ids, f, h))
            h, f, row, place, before, after, ids, bodies = (a[order] for a in (h, f, row, place, before, after, ids, bodies))
            head, which = firsts(h, f)
            done = ids > ids[head][which]
            ours.append((ids[done], bodies[done], place[done] - before[done], place[done] + after[done]))
            left = np.flatnonzero(~done)
            bucket = (h[left] % np.uint64(buckets)).astype(np.int64)
            left, bucket = left[order := np.argsort(bucket, kind="stable")], bucket[order]
            # Only entries carry their surroundings, with zeros behind a row's end; some buckets' lines at a time.
            i = 0
            while i < len(left):
                j = int(np.searchsorted(bucket, bucket[min(i + SLICE, len(left)) - 1], side="right"))
                some = left[i:j]
                context = np.zeros((len(some), span), np.uint8)
                spot = (offsets[row[some]] + place[some] - before[some])[:, None] + np.arange(span)
                inside = np.arange(span) < (before + after)[some][:, None]
                context[inside] = body[spot[inside]]
                rest = np.concatenate((place[some].astype(np.int32)[:, None].view(np.uint8), np.stack((before, after), 1)[some].astype(np.uint8), context), axis=1)
                yield from lines(bucket[i:j], ids[some], bodies[some], rest)
                i = j
            h, f, row, place = (np.concatenate([p[k] for p in wide]) if wide else np.zeros(0, np.int64) for k in range(4))
            ids, bodies = _rows(batch, row)
            order = np.lexsort((place, bodies, ids, f, h))
            h, f, place, ids, bodies = (a[order] for a in (h, f, place, ids, bodies))
            head, which = firsts(h, f)
            done = ids > ids[head][which]
            ours.append((ids[done], bodies[done], place[done], place[done] + LENGTH))
            left = np.flatnonzero(~done)
            rest = np.ascontiguousarray(np.stack((h[left], f[left], place[left].astype(np.uint64)), 1)) if len(left) else np.zeros((0, 3), np.uint64)
            yield from lines((2 * buckets + f[left].astype(np.uint64) % np.uint64(buckets)).astype(np.int64), ids[left], bodies[left], rest)
            ids, bodies, start, end = (np.concatenate([x[k] for x in ours]) for k in range(4))
            if len(ids):
                got = _intervals(ids, bodies, start, end)
                seed = int(mix(np.array([int(bodies[0]) + number], np.int64).view(np.uint64))[0] % np.uint64(buckets))
                yield from lines(np.full(len(got[0]), buckets + seed), *got)

    return run, "bucket int, ids binary, bodies binary, rest binary"


def _intervals(ids: np.ndarray, bodies: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals united by row: ids, bodies and pairs of int32."""
    _, one, which = np.unique(_names(ids, bodies), return_index=True, return_inverse=True)
    row, start, end = unite(which.astype(np.int64), start.astype(np.int64), end.astype(np.int64))
    return ids[one[row]], bodies[one[row]], np.stack((start, end), 1).astype(np.int32)


def _hashes(context: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of entries' minimisers and of their whole surroundings."""
    rows = np.arange(len(context))[:, None]
    gram = np.ascontiguousarray(context[rows, before[:, None] + np.arange(GRAM)]).view(np.uint64)
    h = mix(gram[:, 0] ^ mix(gram[:, 1] + common.GOLDEN))
    wide = np.zeros((len(context), -(-context.shape[1] // 8) * 8), np.uint8)
    wide[:, : context.shape[1]] = context
    f = mix((before * 256 + after).astype(np.uint64))
    for word in wide.view(np.uint64).T:
        f = mix(f ^ word) * common.GOLDEN
    return h, f


def _settled(h: np.ndarray, f: np.ndarray, ids: np.ndarray, bodies: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray, context: np.ndarray):
    """Covered intervals of entries that are sorted by hash and surroundings, then document."""
    new_h = np.concatenate(([True], h[1:] != h[:-1]))
    head = np.flatnonzero(new_h | np.concatenate(([True], f[1:] != f[:-1])))
    which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    done = ids > ids[head][which]
    group = np.cumsum(new_h)[head]
    open_ = head[np.bincount(group)[group] > 1]
    entry, a, z = resolve(context[open_], before[open_], after[open_], ids[open_])
    # What is found for an entry holds for every place of its document with the same surroundings.
    entry = which[open_[entry]]
    size = np.diff(np.append(head, len(h)))[entry]
    at = np.repeat(head[entry], size) + ranges(size)
    a, z = np.repeat(a, size), np.repeat(z, size)
    mine = ~done[at]
    at, a, z = at[mine], a[mine], z[mine]
    return np.concatenate((ids[done], ids[at])), np.concatenate((bodies[done], bodies[at])), np.concatenate(((place - before)[done], place[at] - a)), np.concatenate(((place + after)[done], place[at] + z))


def resolver(buckets: int):
    """A bucket's entries to intervals by row, hash by hash in slices; windows of hot hashes by their least document; intervals that
    came as such pass through."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["bucket"][0].as_py() // buckets
        ids, bodies = _joined(table, "ids", np.int64), _joined(table, "bodies", np.int32)
        if kind == 1:
            return _by_part(ids, bodies, _joined(table, "rest", np.int32).reshape(-1, 2), buckets)
        if kind == 2:
            h, f, place = _joined(table, "rest", np.uint64).reshape(-1, 3).T
            order = np.lexsort((ids, f, h))
            h, f, place, ids, bodies = h[order], f[order], place[order].astype(np.int64), ids[order], bodies[order]
            head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (f[1:] != f[:-1]))))
            done = ids > np.repeat(ids[head], np.diff(np.append(head, len(h))))
            return _by_part(*_intervals(ids[done], bodies[done], place[done], place[done] + LENGTH), buckets)
        rest = _joined(table, "rest", np.uint8).reshape(len(ids), -1)
        h, f = np.empty(len(ids), np.uint64), np.empty(len(ids), np.uint64)
        for i in range(0, len(ids), SLICE):
            some = rest[i : i + SLICE]
            h[i : i + SLICE], f[i : i + SLICE] = _hashes(some[:, 6:], some[:, 4].astype(np.int64), some[:, 5].astype(np.int64))
        order = np.lexsort((bodies, ids, f, h))
        h, f, ids, bodies = h[order], f[order], ids[order], bodies[order]
        out, i = [], 0
        while i < len(h):
            j = int(np.searchsorted(h, h[min(i + SLICE, len(h)) - 1], side="right"))
            some = rest[order[i:j]]
            place, (before, after) = np.ascontiguousarray(some[:, :4]).view(np.int32).astype(np.int64)[:, 0], some[:, 4:6].astype(np.int64).T
            out.append(_intervals(*_settled(h[i:j], f[i:j], ids[i:j], bodies[i:j], place, before, after, some[:, 6:])))
            i = j
        return _by_part(*[np.concatenate([x[k] for x in out]) for k in range(3)], buckets)

    return run, PARTS


def body_of(text):
    """A number that tells rows of one doc_id apart."""
    return (F.coalesce(F.crc32(text.cast("binary")), F.lit(0)) - (1 << 31)).cast("int")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, body, x) of rows(doc_id, text) with something to remove; x holds (start, end) byte pairs of int32."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body_of(text).alias("body"), text.alias("text")).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(common.partitions(spark), int(total // BUCKET_BYTES) + 1)
    run, kind = lister(buckets)
    listed = rows.mapInArrow(run, kind).repartition(buckets, "bucket")
    # A text has about two minimisers for REACH bytes, so hashes of more than `most` documents are under 2 ** HOT_BITS.
    most = max(HOT, int(2 * total // REACH >> HOT_BITS))
    run, kind = sharer(buckets, most)
    parts = cut(listed.groupBy("bucket").applyInArrow(run, kind))
    hot = [np.frombuffer(pa.decompress(r.x[8:], int.from_bytes(r.x[:8], "little"), codec="zstd", asbytes=True), np.uint64) for r in parts.where("part is null").select("x").collect()]
    hot = np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)
    # A row per document.
    shared = parts.where("part is not null").repartition(buckets, "part").groupBy("part").applyInArrow(hashes_of_rows, ROWS)
    run, kind = looker(buckets, hot)
    looked = rows.join(shared, ["doc_id", "body"]).select("doc_id", "body", "text", "x").mapInArrow(run, kind)
    run, kind = resolver(buckets)
    covered = cut(looked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, kind))
    return cut(covered.repartition(buckets, "part").groupBy("part").applyInArrow(intervals_of_rows, ROWS))


def remover():
    """An Arrow UDF (text, packed intervals) -> struct<n_bytes, n_removed, spans, kept>."""

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, spans: array<struct<start: int, end: int>>, kept_sha256: string>")
    def remove(text: pa.Array, x: pa.Array) -> pa.Array:
        body, offsets, _ = buffers(text)
        n_removed, sha, starts, counts, ends = np.zeros(len(text), np.int64), [], [], np.zeros(len(text), np.int64), []
        for i in range(len(text)):
            raw = body[offsets[i] : offsets[i + 1]]
            if x[i].is_valid:
                a, z = np.frombuffer(x[i].as_buffer(), np.int32).reshape(-1, 2).astype(np.int64).T
                keep = np.ones(len(raw), bool)
                for s, e in zip(a.tolist(), z.tolist(), strict=True):
                    keep[s:e] = False
                n_removed[i], counts[i] = (z - a).sum(), len(a)
                starts.append(a)
                ends.append(z)
                raw = raw[keep]
            sha.append(hashlib.sha256(raw.tobytes()).hexdigest())
        flat = [np.concatenate(v).astype(np.int32) if v else np.zeros(0, np.int32) for v in (starts, ends)]
        at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(v) for v in flat], ["start", "end"]))
        return pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.array(n_removed), spans, pa.array(sha)], ["n_bytes", "n_removed", "spans", "kept_sha256"])

    return remove


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) of each row of docs(doc_id, text); spans are maximal removed byte runs.

    A null text counts as empty; texts under LENGTH bytes keep everything. Rows with one doc_id don't cover each other; each is judged
    on its own text. A row without doc_id keeps everything and covers nothing. Matches never cross rows and are judged on
    the input. An empty table gives an empty result; other columns are ignored.
    """
    found = repeats(docs)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body_of(text).alias("body"), F.coalesce(text, F.lit("")).alias("text"))
    got = rows.join(found, ["doc_id", "body"], "left").select("doc_id", remover()("text", "x").alias("r"))
    return got.select("doc_id", "r.*")
