"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import stage
from .suffix import PrefixHash

LAST = (1 << 63) - 1
#: Bytes of text that are divided into sentences at a time.
SLICE = 2 << 20
#: Added to the place of a text's last span, which may start where another one starts.
TAIL = 1 << 30
#: One word in so many, by its hash, starts a new sentence inside a long stretch without a mark.
CUT = 8
#: Ends of sentences that stand between words without white space.
WIDE_STOPS = ("。", "！", "？", "।", "۔", "؟")
#: What may follow a sentence's mark before the white space.
CLOSERS = ("\"", "'", ")", "]", "}", "»", "”", "’")


def _starts_of(b: np.ndarray, mark: str) -> np.ndarray:
    """Whether the bytes from each place on are those of ``mark``."""
    raw = mark.encode()
    hit = np.zeros(len(b), bool)
    if len(b) >= len(raw):
        n = len(b) - len(raw) + 1
        hit[:n] = b[:n] == raw[0]
        for k, x in enumerate(raw[1:], 1):
            if hit.any():
                hit[:n] &= b[k : k + n] == x
    return hit


def _wide(b: np.ndarray) -> np.ndarray:
    """Bytes of the stops that need no white space."""
    out = np.zeros(len(b), bool)
    if (b >= 0xD8).any():
        for mark in WIDE_STOPS:
            at = np.flatnonzero(_starts_of(b, mark))
            for k in range(len(mark.encode())):
                out[at + k] = True
    return out


def _gap(b: np.ndarray) -> np.ndarray:
    return tb.is_space(b) | _wide(b)


def _mark_before(b: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words that end before ``end``: whether a sentence's mark, or a clause's, is their last character but closing quotes and brackets."""
    last = end - 1
    for _ in range(3):
        for c in CLOSERS:
            raw = c.encode()
            ok = last >= len(raw)
            for k, x in enumerate(raw):
                ok &= b[np.maximum(last - len(raw) + 1 + k, 0)] == x
            last = np.where(ok, last - len(raw), last)
    one = b[last]
    dots = (last >= 2) & (one == 0xA6) & (b[np.maximum(last - 1, 0)] == 0x80) & (b[np.maximum(last - 2, 0)] == 0xE2)
    return (one == 46) | (one == 33) | (one == 63) | dots, (one == 44) | (one == 59) | (one == 58) | (one == 124)


def sentences(texts: pa.Array, longest: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte within the row and word range of each sentence; and the words' hashes.

    A sentence ends at a new line, after ``.``, ``!``, ``?`` or an ellipsis
    (and closing quotes or brackets) before white space, after a wide stop, or
    at the text's end. A sentence of more than ``longest`` words is cut after
    its commas, semicolons, colons and bars; a part that is still longer is cut
    before words chosen by their hash, so that equal passages are cut alike. A
    sentence reaches to the next one's first byte; stretches without a word
    belong to the sentence before them.
    """
    buf, starts, ends = tb.columns(texts)
    places: list[np.ndarray] = []
    h, first, end = tb.words(buf, starts, ends, gap=_gap, places=places)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), h
    at = np.concatenate(places)
    lo, hi = int(starts[0]), int(ends[-1])
    b = buf[lo:hi]
    row = np.repeat(np.arange(len(starts)), end - first)
    new = np.append(True, row[1:] != row[:-1])
    gap = _gap(b)
    close = np.maximum.accumulate(np.where(gap, 0, np.arange(1, len(b) + 1)))  # end of the word at or before each byte
    mark, clause = _mark_before(b, close[at[1:] - 1 - lo])
    hard = np.cumsum((b == 10) | _wide(b))
    new[1:] |= mark | (hard[at[1:] - lo] > hard[at[:-1] - lo])
    for soft in (np.append(False, clause), h // tb.U(CUT) % tb.U(CUT) == 0):
        begin = np.flatnonzero(new)
        long = np.diff(np.append(begin, len(at))) > longest
        new |= soft & np.repeat(long, np.diff(np.append(begin, len(at))))
    word = np.flatnonzero(new)
    row = row[word]
    begin = at[word] - starts[row]
    begin[np.append(True, row[1:] != row[:-1])] = 0
    return row, begin, np.column_stack((word, np.append(word[1:], len(at)))), h


def spans(row: np.ndarray, word: np.ndarray, n_rows: int, least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, last sentence + 1 and place of each span, as numbers of sentences; a place is counted from the row's first sentence.

    A span is the shortest run from its first sentence on that has ``least``
    sentences and ``words`` words at least. The shortest such run that reaches
    the text's end is a span too; a text without any is one span.
    """
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    n = np.bincount(row, minlength=n_rows)
    stop = np.cumsum(n)
    begin, k = (stop - n)[row], np.arange(len(row))
    last = np.maximum(k + least, np.searchsorted(word[:, 1], word[:, 0] + words, "left") + 1)
    ok = last <= stop[row]
    rows = np.flatnonzero(n)
    # the last sentence from which a run reaches the text's end
    tail = np.minimum(stop[rows] - least, np.searchsorted(word[:, 0], word[stop[rows] - 1, 1] - words, "right") - 1)
    tail = np.maximum(tail, stop[rows] - n[rows])
    tail = tail[~ok[tail] | (last[tail] < stop[rows])]
    first = np.concatenate((k[ok], tail))
    return first, np.concatenate((last[ok], stop[row[tail]])), first - begin[first] + np.append(np.zeros(int(ok.sum()), np.int64), np.full(len(tail), TAIL))


def _hashed_spans(batches: Iterator[pa.RecordBatch], least: int, words: int, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = 0
        for part in tb.slices(batch.column("text"), SLICE):
            row, _, word, h = sentences(part, longest)
            ids, texts = (batch.column(c).slice(i, len(part)).to_numpy() for c in ("key", "text_hash"))
            i += len(part)
            first, last, place = spans(row, word, len(part), least, words)
            if not len(first):
                continue
            a, z = word[first, 0], word[last - 1, 1]
            value = tb.mix(PrefixHash(h).of(a, z) + (z - a).astype(np.uint64) * tb._K[0])
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids[row[first]]), pa.array(texts[row[first]]), pa.array(place.astype(np.int32))], ["span", "key", "text_hash", "place"])


def dedup_sentences(docs: DataFrame, least: int = 2, words: int = 20, longest: int = 20) -> DataFrame:
    """Remove sentences covered by a span of consecutive sentences that isn't its first occurrence.

    A span is the shortest run of at least ``least`` sentences that has
    ``words`` words, from each sentence on and up to the text's end; a text
    without such a run is one span. Sentences of more than ``longest`` words
    are divided first. The first occurrence is the one with the smallest
    (doc_id, hash of the text, place), over all rows; it may lie in the same
    text. Sentences are compared by their words, A-Z lower-cased. Returns each
    row of ``docs`` with ``text`` (what is left), ``n_sentences``,
    ``n_removed`` and ``removed`` (places from 0, rising). Null texts stay
    null, empty ones empty; rows with one doc_id and one text count as one
    document and don't remove each other at equal places, rows with one doc_id
    and different texts are different documents; null ids sort last, by the
    hash of the text. Columns of these names are replaced. Spans and texts are
    compared as 64-bit hashes.
    """
    docs = docs.drop("n_sentences", "n_removed", "removed", "key", "text_hash")
    keyed = docs.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "text_hash": F.xxhash64(F.col("doc_id").isNull(), "text")})
    found = stage(keyed.select("key", "text_hash", "text").mapInArrow(lambda it: _hashed_spans(it, least, words, longest), "span long, key long, text_hash long, place int"))
    # a span with very many occurrences is reduced to its first in each task before the shuffle
    first = found.groupBy("span").agg(F.min(F.struct("key", "text_hash", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("span", F.col("first.key").alias("first_key"), F.col("first.text_hash").alias("first_hash"), F.col("first.place").alias("first_place"))
    again = found.join(stage(first), "span").where("key <> first_key OR text_hash <> first_hash OR place <> first_place").groupBy("key", "text_hash").agg(F.collect_set("place").alias("starts"))

    @F.arrow_udf("struct<kept: string, n: int, removed: array<int>>")
    def cut(texts: pa.Array, starts: pa.Array) -> pa.Array:
        kept, counts, gone, i = [], [], [], 0
        for part in tb.slices(texts, SLICE):
            row, begin, word, _ = sentences(part, longest)
            bounds = np.searchsorted(row, np.arange(len(part) + 1))
            f, last, place = spans(row, word, len(part), least, words)
            size = {(int(row[a]), p): z - a for a, z, p in zip(f.tolist(), last.tolist(), place.tolist(), strict=True)} if starts.slice(i, len(part)).null_count < len(part) else {}
            buf, lo, hi = tb.columns(part)
            for r, marks in enumerate(starts.slice(i, len(part)).to_pylist()):
                own = begin[bounds[r] : bounds[r + 1]]
                out = np.zeros(len(own), bool)
                for m in marks or ():
                    out[m % TAIL : m % TAIL + size[r, m]] = True
                raw = buf[lo[r] : hi[r]].tobytes()
                if out.any():
                    edge = [*own.tolist(), len(raw)]
                    raw = b"".join(raw[edge[k] : edge[k + 1]] for k in np.flatnonzero(~out))
                kept.append(raw.decode() if part[r].is_valid else None)
                counts.append(len(own))
                gone.append(np.flatnonzero(out).tolist())
            i += len(part)
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(counts, pa.int32()), pa.array(gone, pa.list_(pa.int32()))], ["kept", "n", "removed"])

    done = keyed.join(again, ["key", "text_hash"], "left").withColumn("cut", cut(F.col("text"), F.col("starts")))
    rest = [c for c in docs.columns if c != "text"]
    return done.select(*rest, F.col("cut.kept").alias("text"), F.col("cut.n").alias("n_sentences"), F.size("cut.removed").alias("n_removed"), F.col("cut.removed").alias("removed"))
