"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton reads bytes; at each position the state's output links list all
pieces that end there, from the longest to the shortest, and each relaxes the
best score. Distinct space-led segments of a block of texts advance together,
one byte a step; a segment is divided where no piece can reach over. A model
made by merging has ranks in place of log probabilities: these follow from the
ranks by the Zipf-Mandelbrot law, so that pieces can differ from the merges'
result. What is always exact is that decoding gives the text back.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Added to a piece's rank before the logarithm is taken.
RANK_OFFSET = 100.0
#: Longer segments are looked at for places that no piece reaches over.
SEGMENT = 64


@lru_cache(maxsize=4)
def load_pieces(path: str) -> tuple[tuple[bytes, float, int], ...]:
    """(bytes, log probability, id) of every ordinary piece, and (one byte, nan, id) of the byte pieces; the file is read on the driver only.

    Scores that are whole numbers from a low rank on down are ranks of merges;
    the k-th has a probability in proportion to 1 / (k + RANK_OFFSET). Scores
    of any other model are log probabilities as they are.
    """
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer model at {path}: name one with the parameter model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append((bytes([int(sp.id_to_piece(i)[1:-1], 16)]), float("nan"), i))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            out.append((sp.id_to_piece(i).replace(SPACE, " ").encode(), sp.get_score(i), i))
    if sum(np.isnan(s) for _, s, _ in out) != 256:
        raise ValueError("the model needs 256 byte pieces")
    plain = np.array([s for _, s, _ in out if not np.isnan(s)])
    if len(plain) > 1 and (plain == np.round(plain)).all() and len(np.unique(plain)) > len(plain) // 2:
        out = [(p, s if np.isnan(s) else -float(np.log(plain.max() - s + RANK_OFFSET)), i) for p, s, i in out]
    return tuple(out)


class Automaton:
    """Byte automaton over the pieces with complete transitions and output links."""

    def __init__(self, pieces: tuple[tuple[bytes, float, int], ...]):
        plain = [(p, s, i) for p, s, i in pieces if not np.isnan(s)]
        self.byte_id = np.zeros(256, np.int32)
        for p, s, i in pieces:
            if np.isnan(s):
                self.byte_id[p[0]] = i
        #: whether a piece can reach over the start of a space run
        self.crosses = any(b" " in p.lstrip(b" ") for p, _, _ in plain)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, (p, _, _) in enumerate(plain):
            node = 0
            for b in p:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = k
        n = len(children)
        depth = np.zeros(n, np.int64)
        self.go = np.zeros((n, 256), np.int32)
        fail, self.out, self.link = np.zeros(n, np.int64), np.array(ends, np.int64), np.full(len(plain), -1, np.int64)
        queue = [0]
        for u in queue:
            f = fail[u]
            if u:
                self.go[u] = self.go[f]
                if ends[u] >= 0:
                    self.link[ends[u]] = self.out[f]
                else:
                    self.out[u] = self.out[f]
            for b, v in children[u].items():
                fail[v] = self.go[f, b] if u else 0
                depth[v] = depth[u] + 1
                self.go[u, b] = v
                queue.append(v)
        #: length of the longest start of a piece that a state stands for
        self.depth = depth
        self.length = np.array([len(p) for p, _, _ in plain], np.int64)
        self.score = np.array([s for _, s, _ in plain])
        self.ids = np.array([i for _, _, i in plain], np.int32)
        self.unknown = float(self.score.min()) - 10
        size = max(i for _, _, i in pieces) + 1
        table = [b""] * size
        for p, _, i in pieces:
            table[i] = p
        self.bytes_len = np.array([len(x) for x in table], np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def divided(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the parts of segments b[s:e], divided before bytes that no piece can hold together with the byte before; and each segment's number of parts.

        A state depends on no more bytes than the longest piece has, so that
        long segments are walked in pieces that begin that much earlier.
        """
        long = np.flatnonzero(end - start > SEGMENT)
        longest = int(self.length.max())
        cuts = [start]
        if len(long):
            n = -(-(end[long] - start[long]) // SEGMENT)
            row = np.repeat(long, n)
            at = start[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            state = np.zeros(len(row), np.int64)
            for t in range(-longest, SEGMENT):
                here = at + t
                inside = (here >= start[row]) & (here < end[row])
                state = np.where(inside, self.go[state, b[np.clip(here, 0, len(b) - 1)]], state)
                if t >= 0:
                    # a character of several bytes stays whole
                    cuts.append(here[inside & (here > start[row]) & (self.depth[state] <= 1) & ((b[np.clip(here, 0, len(b) - 1)] & 0xC0) != 0x80)])
        at = np.sort(np.concatenate(cuts))
        return at, np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(start))

    def viterbi(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best pieces of b[s:e], segment after segment, and how many each has."""
        order = np.argsort(start - end, kind="stable")
        size = (end - start)[order]
        base = np.cumsum(size + 1) - (size + 1)
        start = start[order]
        best = np.full(int((size + 1).sum()), -np.inf)
        back = np.full(len(best), -1, np.int64)
        best[base] = 0
        state = np.zeros(len(size), np.int64)
        live = len(size)
        for t in range(1, int(size[0]) + 1 if len(size) else 1):
            live = int(np.searchsorted(-size[:live], -t, "right"))
            at = base[:live] + t
            byte = b[start[:live] + t - 1]
            state[:live] = s = self.go[state[:live], byte]
            out = self.out[s]
            who = np.flatnonzero(out >= 0)
            out = out[who]
            while len(who):
                spot = at[who]
                score = best[spot - self.length[out]] + self.score[out]
                better = score > best[spot]
                best[spot[better]], back[spot[better]] = score[better], out[better]
                out = self.link[out]
                more = out >= 0
                who, out = who[more], out[more]
            # a character that no piece covers is spelled in bytes
            nxt = np.where(size[:live] > t, b[np.minimum(start[:live] + t, len(b) - 1)], 0)
            lost = np.flatnonzero(np.isinf(best[at]) & ((nxt & 0xC0) != 0x80))
            if len(lost):
                spot, width = at[lost], np.ones(len(lost), np.int64)
                for w in range(1, 4):
                    wide = (width == w) & (t > w)
                    wide &= (b[np.maximum(start[lost] + t - w, 0)] & 0xC0) == 0x80
                    width[wide] += 1
                best[spot] = best[spot - width] + self.unknown
        place, segment = size.copy(), np.arange(len(size))
        got: list[tuple[np.ndarray, np.ndarray]] = []
        while len(segment):
            p = back[base[segment] + place[segment]]
            got.append((segment, np.where(p >= 0, self.ids[p], self.byte_id[b[start[segment] + place[segment] - 1]])))
            place[segment] -= np.where(p >= 0, self.length[p], 1)
            segment = segment[place[segment] > 0]
        if not got:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        seg, ids = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        count = np.bincount(seg, minlength=len(size))
        # pieces were read from the back
        turn = np.argsort(order[seg], kind="stable")
        per = np.empty(len(size), np.int64)
        per[order] = count
        ids = ids[turn]
        first = np.cumsum(per) - per
        flip = np.repeat(2 * first + per - 1, per) - np.arange(len(ids))
        return ids[flip].astype(np.int32), per

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        raw, starts, ends = tb.columns(texts)
        size = ends - starts
        led = size + (size > 0)
        begin = np.cumsum(led) - led
        b = np.full(int(led.sum()), 32, np.uint8)
        if not len(b):
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        inside = np.ones(len(b), bool)
        inside[begin[size > 0]] = False
        b[inside] = raw[starts[0] : ends[-1]]
        new = b == 32
        new[1:] &= b[:-1] != 32
        if self.crosses:
            new[:] = False
        new[begin[size > 0]] = True
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(b))
        s, _ = self.divided(b, s, e)
        e = np.append(s[1:], len(b))
        h = tb._hash_block(b, s, e)
        _, first, at = np.unique(h, return_index=True, return_inverse=True)
        ids, per = self.viterbi(b, s[first], e[first])
        place = np.cumsum(per) - per
        count = per[at]
        flat = np.repeat(place[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        row = np.searchsorted(begin[size > 0], s, "right") - 1
        n = np.zeros(len(size), np.int64)
        n[size > 0] = np.bincount(row, count, int((size > 0).sum())).astype(np.int64)
        return ids[flat], n

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after the other, without each one's leading space; and each one's length."""
        size = self.bytes_len[ids]
        total = np.append(0, np.cumsum(size))
        b = self.bytes[np.repeat(self.bytes_at[ids] - total[:-1], size) + np.arange(int(total[-1]))]
        last = np.cumsum(count)
        n = total[last] - total[last - count]
        keep = np.ones(len(b), bool)
        keep[total[last - count][n > 0]] = False
        return b[keep], n - (n > 0)


_AUTOMATA: dict[bytes, Automaton] = {}


def automaton(pieces: tuple[tuple[bytes, float, int], ...]) -> Automaton:
    """The automaton of the pieces, built once in each worker."""
    key = hashlib.sha256(repr(pieces).encode()).digest()
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(pieces)
    return _AUTOMATA[key]


def encode_pieces(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array<int>): the pieces of each whole text. Null and empty texts have none. Nothing is shuffled."""
    pieces = load_pieces(model)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        a, out = automaton(pieces), []
        for part in tb.slices(texts, 2 << 20):
            ids, n = a.encode(part)
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn("ids", encode(F.col(text)))


def decode_pieces(docs: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of each row's ids; null and empty arrays give an empty text."""
    pieces = load_pieces(model)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        a, out = automaton(pieces), []
        for i in range(0, len(rows), 256):
            part = [np.asarray(r if r is not None else [], np.int64) for r in rows.slice(i, 256).to_pylist()]
            b, n = a.decode(np.concatenate(part), np.array([len(p) for p in part]))
            raw, at = b.tobytes(), 0
            for k in n.tolist():
                out.append(raw[at : at + k].decode("utf-8", "replace"))
                at += k
        return pa.array(out, pa.string())

    return docs.withColumn("decoded", decode(F.col(ids)))


def token_count(text: str = "text", model: str = MODEL) -> F.Column:
    """Number of pieces of each whole text; null and empty texts have none."""
    pieces = load_pieces(model)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        a = automaton(pieces)
        parts = [a.encode(part)[1] for part in tb.slices(texts, 2 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return count(F.col(text))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and whether decoding gives the bytes back."""
    pieces = load_pieces(model)

    @F.arrow_udf("struct<n_bytes: long, n_tokens: long, ids_sha256: string, same: boolean>")
    def check(texts: pa.Array) -> pa.Array:
        a, rows = automaton(pieces), []
        for part in tb.slices(texts, 2 << 20):
            ids, n = a.encode(part)
            back, size = a.decode(ids, n)
            raw, starts, ends = tb.columns(part)
            ends_back, ends_ids = np.cumsum(size), np.cumsum(n)
            for k in range(len(part)):
                own = raw[starts[k] : ends[k]]
                got = back[ends_back[k] - size[k] : ends_back[k]]
                rows.append((len(own), int(n[k]), hashlib.sha256(ids[ends_ids[k] - n[k] : ends_ids[k]].astype("<i4").tobytes()).hexdigest(), bool(np.array_equal(own, got))))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], ["n_bytes", "n_tokens", "ids_sha256", "same"])

    done = docs.select("doc_id", check(F.col("text")).alias("r"))
    return done.select("doc_id", F.col("r.n_bytes").alias("n_bytes"), F.col("r.n_tokens").alias("n_tokens"), F.col("r.ids_sha256").alias("ids_sha256"), F.col("r.same").alias("round_trip"))
