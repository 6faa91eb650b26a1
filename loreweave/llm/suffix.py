"""Suffix sorting by hashes, and exact removal of substrings that occur in earlier documents.

Every window of ``length`` bytes names an anchor: its leftmost smallest 16-byte
hash. Equal windows name equal anchors at equal places, so windows only have to
be compared where anchors are equal.

1. Texts are dealt into bounded batches. A batch sends one entry for each
   distinct stretch of windows with one anchor: anchor, stretch, smallest id,
   and short hashes of the bytes before and behind the anchor.
2. The answer tells for each entry whether the same stretch is in an earlier
   document (then all its bytes go), and whether other stretches can share a
   window with it: 16 bytes recur by chance in any large corpus, but a common
   window also has half of its other bytes on one side of the anchor. Only
   stretches that agree there send their bytes.
3. Stretches with one anchor are cut into suffixes, sorted by a merge sort that
   compares by binary search over prefix hashes, and windows are looked up
   among neighbours in that order. Equal hashes are verified byte by byte.
   (Where asked to, the same binary search compares a few stretches two by two
   instead; the tests hold both ways against each other.) The
   windows of an anchor with very many stretches (the edges of a passage that
   a large part of all documents holds) are dealt by their own 64-bit hashes,
   one for each batch and window, so that no task has to hold them all.
4. Each batch gets its removed ranges back and applies them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import textblock as tb
from .common import batch_count, batch_of, dealt_by, text_bytes

U = np.uint64
GRAM = 16
#: Up to so many stretches of one anchor are compared two by two; 1: all are sorted.
FEW = 1
#: Over so many, their windows are dealt by their own hashes instead.
HOT = 2000
BLOCK = 1 << 20
_B = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_B), -1, 1 << 64))
NONE = np.iinfo(np.int64).max


class PrefixHash:
    """Polynomial hashes of all prefixes: the hash of any substring in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.full(n + 1, _B, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + U(1)) * power[:n])))
        power = np.full(n + 1, _INVERSE, np.uint64)
        power[0] = 1
        self.back = np.cumprod(power)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def common_length(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes a and b, at most ``most``: binary search over equal prefix hashes."""
    whole = h.of(a, a + most) == h.of(b, b + most)
    low, high = np.where(whole, most, 0), np.where(whole, most, most - 1)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = h.of(a, a + mid) == h.of(b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def _before(values: np.ndarray, h: PrefixHash, a: np.ndarray, b: np.ndarray, limit: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Whether suffix a sorts before suffix b; ``equal`` where their first ``limit`` values agree (a shorter one first)."""
    most = np.minimum(limit[a], limit[b])
    n = common_length(h, a, b, most)
    end = n >= most
    last = len(values) - 1
    less = values[np.minimum(a + n, last)] < values[np.minimum(b + n, last)]
    tie = np.where(limit[a] == limit[b], equal, limit[a] < limit[b])
    return np.where(end, tie, less)


def suffix_sort(values: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within each group, and each one's common length with the one before (-1 for a group's first).

    ``limit`` has for each place of ``values`` how far a suffix from there may
    be compared. Bottom-up merge sort, all merges of a level at once: a suffix
    moves behind those of the sibling run that sort before it, which a binary
    search counts.
    """
    order = np.argsort(group, kind="stable")
    at, g = starts[order].astype(np.int64), group[order]
    n = len(at)
    if not n:
        return order, np.zeros(0, np.int64)
    h = PrefixHash(values)
    new = np.append(True, g[1:] != g[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    begin, size = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(n)
    width = 1
    while width < size.max():
        work = np.flatnonzero(size > width)
        inside = place[work] - begin[work]
        run = inside // width * width
        right = (inside // width) % 2 == 1
        low = begin[work] + np.where(right, run - width, run + width)
        stop = begin[work] + size[work]
        high = np.minimum(low + width, stop)
        low = np.minimum(low, high)
        base = low.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            # equal suffixes keep the left run first
            goes = _before(values, h, at[mid], at[work[open_]], limit, right[open_])
            low[open_] = np.where(goes, mid + 1, low[open_])
            high[open_] = np.where(goes, high[open_], mid)
        to = begin[work] + np.where(right, run - width, run) + (inside - run) + (low - base)
        at_next, order_next = at.copy(), order.copy()
        at_next[to], order_next[to] = at[work], order[work]
        at, order = at_next, order_next
        width *= 2
    common = np.full(n, -1)
    rest = np.flatnonzero(~new)
    common[rest] = common_length(h, at[rest - 1], at[rest], np.minimum(limit[at[rest - 1]], limit[at[rest]]))
    return order, common


def _anchor_block(b: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of valid window starts that name one anchor: first start, number, anchor, its hash, hashes of the stretch and of both sides.

    Two stretches with a common window agree in the ``side`` bytes before the
    anchor or in those behind it. A side's hash is 0 where the stretch has
    fewer bytes there.
    """
    h = b.astype(np.uint64) + U(1)
    power, w = _B, 1
    while w < GRAM:
        h = h[:-w] * power + h[w:]
        power, w = power * power, w * 2
    low = tb.mix(h)
    offset, covered, want = np.zeros(len(low), np.uint8), 1, length - GRAM + 1
    while covered < want:
        s = min(covered, want - covered)
        less = low[s:] < low[:-s]
        offset = np.where(less, offset[s:] + np.uint8(s), offset[:-s])
        low = np.minimum(low[s:], low[:-s])
        covered += s
    n = len(b) - length + 1
    valid = valid[:n]
    anchor = np.arange(n) + offset
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    count = np.flatnonzero(last) - start + 1
    ph = PrefixHash(b)
    end = start + count + length - 1
    stretch = tb.mix(ph.of(start, end) + (end - start).astype(np.uint64) * tb._K[0] + (anchor[start] - start).astype(np.uint64) * tb._K[1])
    a, side = anchor[start], -(-(length - GRAM) // 2)
    left, right = a - side >= start, a + GRAM + side <= end
    left = np.where(left, _short(ph.of(np.where(left, a - side, a), a)), np.uint16(0))
    right = np.where(right, _short(ph.of(a + GRAM, np.where(right, a + GRAM + side, a + GRAM))), np.uint16(0))
    return start, count, a, low[start], stretch, left, right


def _short(h: np.ndarray) -> np.ndarray:
    """16 bits of a hash, never 0."""
    return np.maximum((tb.mix(h) >> U(48)).astype(np.uint16), np.uint16(1))


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, block: int = BLOCK) -> dict[str, np.ndarray]:
    """All stretches of all rows; a long row is handled in blocks that overlap, which may cut a stretch in two."""
    got: list[tuple[np.ndarray, ...]] = []

    def take(lo: int, hi: int, valid: np.ndarray) -> None:
        if hi - lo >= length and valid.any():
            s, n, a, *hashes = _anchor_block(buf[lo:hi], valid, length)
            got.append((s + lo, n, a + lo, *hashes))

    i = 0
    while i < len(starts):
        if ends[i] - starts[i] > 2 * block:
            for at in range(int(starts[i]), int(ends[i]) - length + 1, block):
                hi = min(at + block + length - 1, int(ends[i]))
                take(at, hi, np.ones(hi - at, bool))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        step = np.zeros(hi - lo + 1, np.int32)
        long = ends[i:j] - starts[i:j] >= length
        np.add.at(step, starts[i:j][long] - lo, 1)
        np.add.at(step, ends[i:j][long] - length + 1 - lo, -1)
        take(lo, hi, np.cumsum(step[:-1]) > 0)
        i = j
    cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.uint16)] * 2
    return dict(zip(("start", "count", "anchor", "hash", "stretch", "left", "right"), cols, strict=True)) | {"row": np.searchsorted(ends, cols[0], "right") if len(cols[0]) else np.zeros(0, np.int64)}


def _zipped(texts: pa.Array) -> pa.Array:
    """Each text's UTF-8 bytes compressed, behind their number: the text is what a shuffle writes most of."""
    codec = pa.Codec("zstd")
    return pa.array([None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _unzipped(docs: pa.Table) -> pa.Table:
    codec = pa.Codec("zstd")
    texts = [None if x is None else codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in docs.column("text").to_pylist()]
    return docs.set_column(docs.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


def _entries(docs: pa.Table, length: int, n_buckets: int) -> dict:
    """The batch's stretches with, for each, its entry: distinct (bucket, anchor, stretch) and its smallest id."""
    buf, starts, ends = tb.columns(docs.column("text"))
    rows = np.flatnonzero(ends > starts)
    f = anchors(buf, starts[rows], ends[rows], length)
    f["row"] = rows[f["row"]]
    doc = docs.column("doc_id").fill_null(NONE).to_numpy()[f["row"]]
    bucket = ((f["hash"] >> U(32)) % U(n_buckets)).astype(np.int32)
    order = np.lexsort((doc, f["stretch"], f["hash"] & U(0xFFFFFFFF), bucket))
    b, h, s = bucket[order], (f["hash"][order] & U(0xFFFFFFFF)).astype(np.uint32), f["stretch"][order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return f | {"buf": buf, "starts": starts, "ends": ends, "order": order, "entry": np.cumsum(new) - 1, "doc": doc[order], "e_bucket": b[at], "e_hash": h[at], "e_stretch": s[at], "e_doc": doc[order][at], "e_left": f["left"][order[at]], "e_right": f["right"][order[at]]}


def _ask(docs: pa.Table, length: int, n_buckets: int) -> pa.Table:
    f = _entries(_unzipped(docs), length, n_buckets)
    present, first = np.unique(f["e_bucket"], return_index=True)
    last = [*first[1:].tolist(), len(f["e_bucket"])][: len(first)]
    base = int(f["e_doc"].min()) if len(f["e_doc"]) else 0
    gap = f["e_doc"] - base
    kind = np.uint32 if len(gap) and 0 <= gap.min() and gap.max() < 1 << 32 else np.int64
    if kind is np.int64:
        base, gap = 0, f["e_doc"]
    gap = gap.astype(kind)
    narrow = kind is np.uint32 and gap.max() < 1 << 24
    data = gap.view(np.uint8).reshape(-1, gap.itemsize)[:, : 3 if narrow else None]
    cut = list(zip(first.tolist(), last, strict=True))
    batch = docs.column("batch")[0].as_py()
    return pa.table({"bucket": pa.array(present, pa.int32()), "batch": pa.array([batch] * len(cut), pa.int32()), "base": pa.array([base] * len(cut), pa.int64()), "hash": pa.array([f["e_hash"][a:z].tobytes() for a, z in cut], pa.binary()), "stretch": pa.array([f["e_stretch"][a:z].tobytes() for a, z in cut], pa.binary()), "doc": pa.array([data[a:z].tobytes() for a, z in cut], pa.binary()), "sides": pa.array([f["e_left"][a:z].tobytes() + f["e_right"][a:z].tobytes() for a, z in cut], pa.binary())})


def _gaps(data: bytes, n: int) -> np.ndarray:
    """Ids less the base, of 3, 4 or 8 bytes."""
    if len(data) == 3 * n:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, :3] = np.frombuffer(data, np.uint8).reshape(n, 3)
        return wide.view(np.uint32).ravel().astype(np.int64)
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.int64).astype(np.int64)


def _several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether rows of the same key have different documents."""
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    own = np.flatnonzero(new)
    out = np.zeros(len(key), bool)
    out[order] = (np.minimum.reduceat(doc[order], own) != np.maximum.reduceat(doc[order], own))[np.cumsum(new) - 1]
    return out


def _answer(asked: pa.Table, hot: int) -> pa.Table:
    """A byte for each entry: 1 if the stretch is in an earlier document, 2 if it is to be sent, 4 more if as windows."""
    hashes = [np.frombuffer(x, np.uint32) for x in asked.column("hash").to_pylist()]
    sizes = np.array([len(x) for x in hashes])
    stretch = np.frombuffer(b"".join(asked.column("stretch").to_pylist()), np.uint64)
    docs = np.concatenate([_gaps(x, n) + base for x, n, base in zip(asked.column("doc").to_pylist(), sizes, asked.column("base").to_pylist(), strict=True)])
    h = np.concatenate(hashes)
    sides = [np.frombuffer(x, np.uint16).reshape(2, -1) for x in asked.column("sides").to_pylist()]
    order = np.lexsort((docs, stretch, h))
    sh, ss, sd = h[order], stretch[order], docs[order]
    anchor = np.append(True, sh[1:] != sh[:-1])
    piece = anchor | np.append(True, ss[1:] != ss[:-1])
    least = sd[np.flatnonzero(piece)][np.cumsum(piece) - 1]
    own = np.flatnonzero(anchor)
    low, high = np.minimum.reduceat(least, own), np.maximum.reduceat(least, own)
    mixed = (low != high)[np.cumsum(anchor) - 1]
    code = np.zeros(len(order), np.uint8)
    sends = np.zeros(len(order), bool)
    for side in np.concatenate(sides, axis=1)[:, order]:
        some = np.flatnonzero(mixed & (side > 0))
        if len(some):
            sends[some] |= _several(sh[some].astype(np.uint64) << U(16) | side[some], least[some])
    sends &= least == sd
    many = (np.add.reduceat(sends.astype(np.int64), own) > hot)[np.cumsum(anchor) - 1]
    code[order] = (least < sd) + 2 * sends + 4 * (sends & many)
    ends = np.cumsum(sizes)
    return pa.table({"batch": asked.column("batch"), "bucket": asked.column("bucket"), "code": pa.array([code[z - n : z].tobytes() for z, n in zip(ends, sizes, strict=True)], pa.binary())})


#: route: bucket of the anchor, or of the batch; ranges: pairs of int64 (start, end) within the row's bytes.
MARKS = "route int, batch int, doc_id long, text_hash long, anchor long, at long, count int, gap int, data binary"


def _row_hashes(f: dict) -> np.ndarray:
    raw = f["buf"]
    return np.array([xxhash.xxh3_64_intdigest(raw[a:z].tobytes()) for a, z in zip(f["starts"].tolist(), f["ends"].tolist(), strict=True)], np.uint64).view(np.int64)


def _mark(docs: pa.Table, answers: pa.Table, length: int, n_buckets: int) -> pa.Table:
    """Ranges known to go (one row for each document that has any), and stretches to be compared."""
    f = _entries(_unzipped(docs), length, n_buckets)
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("code").to_pylist(), strict=True))
    code = np.frombuffer(b"".join(got[b] for b in sorted(got)), np.uint8)[f["entry"]] if len(f["entry"]) else np.zeros(0, np.uint8)
    gone = ((code & 1) > 0) | (f["doc"] > f["e_doc"][f["entry"]])
    send = ~gone & ((code & 2) > 0) & ((code & 4) == 0)
    hot = ~gone & ((code & 4) > 0)
    batch = docs.column("batch")[0].as_py()
    ids = docs.column("doc_id").to_pylist()
    hashes = _row_hashes(f)
    out: list[tuple] = []
    pick = np.sort(f["order"][gone])
    row, lo = f["row"][pick], f["start"][pick] - f["starts"][f["row"][pick]]
    hi = lo + f["count"][pick] + length - 1
    for r, a, z in _runs(row):
        out.append((batch % n_buckets, batch, ids[r], int(hashes[r]), None, None, None, None, merge_ranges(lo[a:z], hi[a:z]).tobytes()))
    for i in f["order"][send].tolist():
        r, s, n = int(f["row"][i]), int(f["start"][i]), int(f["count"][i])
        key = int(f["hash"][i])
        out.append(((key >> 32) % n_buckets, batch, ids[r], int(hashes[r]), key - (1 << 64) if key >> 63 else key, s - int(f["starts"][r]), n, int(f["anchor"][i]) - s, f["buf"][s : s + n + length - 1].tobytes()))
    if hot.any():
        out += _hot_windows(f, f["order"][hot], f["doc"][hot], length, n_buckets, batch, ids, hashes)
    return _rows(out, MARKS)


def _hot_windows(f: dict, pick: np.ndarray, doc: np.ndarray, length: int, n_buckets: int, batch: int, ids: list, hashes: np.ndarray) -> list[tuple]:
    """Each distinct window of the stretches for the smallest id that has it in this batch; other ids' windows go at once.

    A window's row has count 0, its hash as anchor and its bytes. Windows are compared by their bytes.
    """
    count, start, row = f["count"][pick], f["start"][pick], f["row"][pick]
    size = count + length - 1
    base = np.cumsum(size) - size
    ph = PrefixHash(f["buf"][np.repeat(start - base, size) + np.arange(int(size.sum()))])
    owner = np.repeat(np.arange(len(pick)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = base[owner] + step
    key = tb.mix(ph.of(at, at + length)) ^ tb.mix(f["hash"][pick][owner])
    order = np.lexsort((doc[owner], key))
    key, owner, step = key[order], owner[order], step[order]
    new = np.append(True, key[1:] != key[:-1])
    first_byte = start[owner] + step
    same = np.flatnonzero(~new)
    _verify(f["buf"], first_byte[same - 1], first_byte[same], np.full(len(same), length))
    least = doc[owner][np.flatnonzero(new)][np.cumsum(new) - 1]
    late = doc[owner] > least
    place = start[owner] + step - f["starts"][row[owner]]
    out = []
    gone = np.flatnonzero(late)[np.argsort(row[owner[late]], kind="stable")]
    for r, a, z in _runs(row[owner[gone]]):
        lo = place[gone[a:z]]
        out.append((batch % n_buckets, batch, ids[r], int(hashes[r]), None, None, None, None, merge_ranges(lo, lo + length).tobytes()))
    for i in np.flatnonzero(~late).tolist():
        r, k = int(row[owner[i]]), int(key[i])
        out.append((k % n_buckets, batch, ids[r], int(hashes[r]), k - (1 << 64) if k >> 63 else k, int(place[i]), 0, None, f["buf"][first_byte[i] : first_byte[i] + length].tobytes()))
    return out


def _rows(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, cols, strict=True)})


def _runs(sorted_keys: np.ndarray):
    if len(sorted_keys):
        first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        yield from zip(sorted_keys[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_keys)).tolist(), strict=True)


def merge_ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Union of ranges as rows (start, end); ranges that touch become one."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    return np.column_stack((lo[first], hi[np.append(first[1:] - 1, len(lo) - 1)])).astype(np.int64)


def _compare(marks: pa.Table, length: int, few: int) -> pa.Table:
    """Passes known ranges on; finds the windows of each sent stretch that an earlier document also has."""
    windows = marks.filter(pa.compute.equal(marks.column("count"), 0))
    sent = marks.filter(pa.compute.greater(marks.column("count"), 0))
    out = [marks.filter(pa.compute.is_null(marks.column("anchor"))).select(["batch", "doc_id", "text_hash", "data"]).combine_chunks()]
    if len(windows):
        out.append(_compare_windows(windows, length))
    anchor_all = sent.column("anchor").to_numpy() if len(sent) else np.zeros(0, np.int64)
    sent = sent.take(pa.array(np.argsort(anchor_all, kind="stable")))
    anchor_all = np.sort(anchor_all, kind="stable")
    edges = [a for _, a, _ in _runs(anchor_all)] + [len(anchor_all)]
    a = 0
    for z in edges[1:]:
        # whole anchors, about 30,000 stretches at a time
        if z - a >= 30_000 or z == len(anchor_all):
            if z > a:
                out.append(_compare_part(sent.slice(a, z - a), length, few))
            a = z
    return pa.concat_tables(out)


def _compare_windows(windows: pa.Table, length: int) -> pa.Table:
    """Ranges of the windows that another batch has for a smaller id."""
    windows = windows.combine_chunks()
    doc = windows.column("doc_id").fill_null(NONE).to_numpy()
    # windows are told apart by their bytes
    key = windows.column("data").combine_chunks().dictionary_encode().indices.to_numpy()
    least = np.full(int(key.max()) + 1, NONE)
    np.minimum.at(least, key, doc)
    hit = windows.filter(pa.array(doc > least[key])).select(["batch", "doc_id", "text_hash", "at"])
    found: dict[tuple, list[int]] = {}
    for *name, at in zip(*(c.to_pylist() for c in hit.columns), strict=True):
        found.setdefault(tuple(name), []).append(at)
    return _rows([(*name, merge_ranges(np.array(at), np.array(at) + length).tobytes()) for name, at in found.items()], "batch int, doc_id long, text_hash long, data binary")


def _compare_part(sent: pa.Table, length: int, few: int) -> pa.Table:
    buf, base, end = tb.columns(sent.column("data"))
    base, buf = base - base[0], buf[base[0] : end[-1]]
    count, gap = sent.column("count").to_numpy().astype(np.int64), sent.column("gap").to_numpy().astype(np.int64)
    anchor, doc = sent.column("anchor").to_numpy(), sent.column("doc_id").fill_null(NONE).to_numpy()
    new = np.append(True, anchor[1:] != anchor[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(anchor)))
    small = np.repeat(size <= few, size)
    found = [_two_by_two(buf, base + gap, gap, count + length - 1 - gap, doc, new, size, length, few)]
    many = np.flatnonzero(~small)
    if len(many):
        found.append(_sorted(buf, base[many], count[many], gap[many], anchor[many], doc[many], many, length))
    row, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    row, at = row[order], sent.column("at").to_numpy()[row[order]]
    lo, hi = lo[order] + at, hi[order] + at
    keep = pa.array(np.unique(row))
    ids, hashes, batch = (sent.column(c).take(keep).to_pylist() for c in ("doc_id", "text_hash", "batch"))
    return _rows([(batch[k], ids[k], hashes[k], merge_ranges(lo[a:z], hi[a:z]).tobytes()) for k, (_, a, z) in enumerate(_runs(row))], "batch int, doc_id long, text_hash long, data binary")


def _verify(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
    """Raises unless buf[a:a+n] equals buf[b:b+n] everywhere."""
    span, last = np.arange(int(n.max()) if len(n) else 0), len(buf) - 1
    for c in range(0, len(a), 100_000):
        x, y = a[c : c + 100_000, None] + span, b[c : c + 100_000, None] + span
        if ((buf[np.minimum(x, last)] != buf[np.minimum(y, last)]) & (span < n[c : c + 100_000, None])).any():
            raise ArithmeticError("substrings with equal hashes differ")


def _two_by_two(buf: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, new: np.ndarray, size: np.ndarray, length: int, few: int) -> tuple[np.ndarray, ...]:
    """Stretch, start and end (from the stretch's first byte) of what it shares with a stretch of an earlier document.

    ``left`` and ``right`` are the bytes of each stretch before and from its
    anchor; ``new`` and ``size`` bound the groups, of which small ones are done.
    """
    h = PrefixHash(buf)
    group = np.cumsum(new) - 1
    out = []
    for step in range(1, few):
        i = np.flatnonzero((group[:-step] == group[step:]) & (size[group[:-step]] <= few)) if len(group) > step else np.zeros(0, np.int64)
        j = i + step
        swap = doc[i] > doc[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        i, j = i[doc[i] < doc[j]], j[doc[i] < doc[j]]
        if not len(i):
            continue
        fore = common_length(h, anchor[i], anchor[j], np.minimum(right[i], right[j]))
        back = _common_before(h, anchor[i], anchor[j], np.minimum(left[i], left[j]))
        ok = fore + back >= length
        i, j, fore, back = i[ok], j[ok], fore[ok], back[ok]
        _verify(buf, anchor[i] - back, anchor[j] - back, fore + back)
        out.append((j, left[j] - back, left[j] + fore))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def _common_before(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension to the left of a and b, at most ``most``."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = h.of(a - mid, a) == h.of(b - mid, b)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def _sorted(buf: np.ndarray, base: np.ndarray, count: np.ndarray, gap: np.ndarray, anchor: np.ndarray, doc: np.ndarray, name: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """As _two_by_two for groups of any size: all windows sorted as suffixes, looked up among equal neighbours."""
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = base[row] + step
    # equal windows have their anchor at one distance: only those are sorted together
    _, ordinal = np.unique(anchor, return_inverse=True)
    group = ordinal[row].astype(np.int64) * 256 + (gap[row] - step)
    # a window whose hash no other one has can't be repeated and needs no place in the order
    h = PrefixHash(buf)
    _, which, times = np.unique(tb.mix(h.of(start, start + length)) ^ tb.mix(group.astype(np.uint64)), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    row, step, start, group = row[again], step[again], start[again], group[again]
    if not len(row):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    order, common = suffix_sort(buf, start, group, np.full(len(buf), length, np.int64))
    at = start[order]
    same = np.flatnonzero(common >= length)
    _verify(buf, at[same - 1], at[same], np.full(len(same), length))
    klass = np.cumsum(common < length) - 1
    d = doc[row[order]]
    least = np.minimum.reduceat(d, np.flatnonzero(common < length))
    pick = order[d > least[klass]]
    return name[row[pick]], step[pick], step[pick] + length


def _apply(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    docs = _unzipped(docs)
    buf, starts, ends = tb.columns(docs.column("text"))
    found: dict[tuple, list[bytes]] = {}
    for d, h, x in zip(ranges.column("doc_id").to_pylist(), ranges.column("text_hash").to_pylist(), ranges.column("data").to_pylist(), strict=True):
        found.setdefault((d, h), []).append(x)
    hashes = _row_hashes({"buf": buf, "starts": starts, "ends": ends}).tolist()
    removed, spans, sha, kept_text = [], [], [], []
    nulls = docs.column("text").is_null().to_pylist()
    for i, d in enumerate(docs.column("doc_id").to_pylist()):
        raw = buf[starts[i] : ends[i]].tobytes()
        got = found.get((d, hashes[i]))
        if got:
            pairs = np.frombuffer(b"".join(got), np.int64).reshape(-1, 2)
            cut = merge_ranges(pairs[:, 0], pairs[:, 1])
            pieces, at = [], 0
            for lo, hi in cut.tolist():
                pieces.append(raw[at:lo])
                at = hi
            pieces.append(raw[at:])
            kept = b"".join(pieces)
            spans.append(len(cut))
        else:
            kept = raw
            spans.append(0)
        removed.append(len(raw) - len(kept))
        sha.append(hashlib.sha256(kept).hexdigest())
        kept_text.append(None if nulls[i] else kept.decode("utf-8", "ignore"))
    out = docs.drop(["batch", "text"])
    for name, values, kind in (("text", kept_text, pa.string()), ("n_bytes", ends - starts, pa.int64()), ("n_removed", removed, pa.int64()), ("n_spans", spans, pa.int64()), ("kept_sha256", sha, pa.string())):
        out = out.append_column(name, pa.array(values, kind))
    return out


def dedup_substrings(docs: DataFrame, length: int = 50, few: int = FEW, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes; matches don't cross documents, strings are judged on
    the input. Returns each row of ``docs`` with ``text`` (what is left; bytes
    of a character that was cut are dropped from it), ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256`` (of
    all bytes left). A null text stays null and counts as empty; texts shorter
    than ``length`` stay whole. A null doc_id sorts after all others; rows with
    one doc_id never remove each other's bytes. Columns with the result's names
    are replaced. ``length`` is from 17 to 200. ``few`` and ``hot`` choose how stretches with
    one anchor are compared; the result doesn't depend on them.
    """
    if not GRAM < length <= 200:
        raise ValueError("length must be from 17 to 200")
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "batch").withColumn("doc_id", F.col("doc_id").cast("long"))
    n_bytes = text_bytes(docs)
    n_batches = batch_count(spark, n_bytes)
    n_buckets = batch_count(spark, n_bytes // 18, 1_000_000)
    dealt = docs.withColumn("batch", batch_of(dealt_by(), n_batches)).withColumn("text", F.arrow_udf(_zipped, BinaryType())("text"))
    by_batch = dealt.groupBy("batch")
    asked = by_batch.applyInArrow(lambda t: _ask(t, length, n_buckets), "bucket int, batch int, base long, hash binary, stretch binary, doc binary, sides binary")
    answers = asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, hot), "batch int, bucket int, code binary")
    marks = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(lambda d, a: _mark(d, a, length, n_buckets), MARKS)
    ranges = marks.groupBy("route").applyInArrow(lambda t: _compare(t, length, few), "batch int, doc_id long, text_hash long, data binary")
    rest = [f for f in dealt.schema if f.name not in ("batch", "text")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    return by_batch.cogroup(ranges.groupBy("batch")).applyInArrow(_apply, schema)
