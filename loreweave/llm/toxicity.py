"""Toxicity: boosted trees over dense lexical features, calibrated to probabilities.

The features of a text are densities of lexicon words, how near they stand to a
second-person word, and rates of capitals, punctuation and obfuscation. The
lexicon is a fixed list and words that stand out in toxic labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .boost import Calibrated

# Insults, and second-person words, in four languages.
INSULTS = """
asshole bastard bitch clown coward crap creep cretin disgusting dumb dumbass fool freak fuck garbage hate idiot idiotic idiots ignorant
imbecile jerk kill liar loser losers lunatic moron moronic morons pathetic pig psycho retard scum scumbag shit shut stupid suck trash ugly vermin
worthless abschaum arschloch blöd dumm dreckig hässlich idioten lügner trottel verlierer versager wertlos
abruti connard connasse crétin débile imbécile merde minable moche pourriture salaud stupide
basura cabrón estúpido estúpida gilipollas idiota imbécil inútil mierda patético perdedor pendejo
""".split()
SECOND_PERSON = "you your yours yourself u ur du dein deine dich dir ihr euch tu toi te vous votre ton ta usted tú ti tus su".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

NEAR = 6
FEATURES = 19
FOLDS = 3


def _gap(b: np.ndarray) -> np.ndarray:
    """Bytes that are neither ASCII letters or digits nor part of a longer UTF-8 sequence."""
    return ~(((b >= 97) & (b <= 122)) | ((b >= 65) & (b <= 90)) | ((b >= 48) & (b <= 57)) | (b >= 128))


def word_hashes(items: list[str]) -> np.ndarray:
    return np.sort(tb.words(*tb.columns(pa.array(items)), gap=_gap)[0])


def _in(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set) or not len(h):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)
    return sorted_set[at] == h


_LEET_TABLE = np.arange(256, dtype=np.uint8)
for _k, _v in LEET.items():
    _LEET_TABLE[ord(_k)] = ord(_v)
_DROP = np.zeros(256, bool)
_DROP[[ord(c) for c in ".,-_*!?;:'\"#%&+~^()|/"]] = True


def _sums(mask: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask)))
    return (c[end] - c[first]).astype(float)


def features(arr: pa.Array, learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text; an empty or null text gives a row of zeros but for its constants."""
    buf, starts, ends = tb.columns(arr)
    lo, hi = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    buf, starts, ends = buf[lo:hi], starts - lo, ends - lo
    h, first, end = tb.words(buf, starts, ends, gap=_gap)
    n_words = (end - first).astype(float)
    size = np.maximum(ends - starts, 1).astype(float)
    base, you = _in(h, _BASE), _in(h, _YOU)
    known = _in(h, learned)
    gain = np.zeros(len(h))
    if known.any():
        gain[known] = weights[np.searchsorted(learned, h[known])]
    hit = base | known
    row = np.repeat(np.arange(len(starts)), end - first)
    near = np.zeros(len(h), bool)
    at, to = np.flatnonzero(hit), np.flatnonzero(you)
    if len(at) and len(to):
        for side in (np.searchsorted(to, at) - 1, np.searchsorted(to, at)):
            j = to[np.clip(side, 0, len(to) - 1)]
            near[at] |= (np.abs(j - at) <= NEAR) & (row[j] == row[at])
    top = np.zeros(len(starts))
    if known.any():
        np.maximum.at(top, row[known], gain[known])
    per = np.maximum(n_words, 1)
    upper, digit, punct = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57), _gap(buf) & ~tb.is_space(buf)
    letters = upper | ((buf >= 97) & (buf <= 122))
    rate = lambda m: _sums(m, starts, ends) / size
    # obfuscation: digits and signs that stand for letters, and signs between letters
    plain = _LEET_TABLE[buf]
    kept = ~_DROP[plain]
    place = np.concatenate(([0], np.cumsum(kept)))
    oh, ofirst, oend = tb.words(plain[kept], place[starts], place[ends], gap=_gap)
    ohit = _in(oh, _BASE) | _in(oh, learned)
    hits, ohits = _sums(hit, first, end), _sums(ohit, ofirst, oend)
    signs = (buf == 35) | (buf == 36) | (buf == 37) | (buf == 38) | (buf == 42) | (buf == 64)
    same = np.zeros(len(buf), bool)
    same[2:] = letters[2:] & (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2])
    mixed = np.zeros(len(buf), bool)
    mixed[1:-1] = (digit | signs)[1:-1] & letters[:-2] & letters[2:]
    return np.column_stack([
        np.log1p(n_words), _sums(base, first, end) / per, np.log1p(hits), hits / per,
        np.add.reduceat(np.append(gain, 0), np.minimum(first, len(gain))) * (n_words > 0) / per, top,
        _sums(you, first, end) / per, _sums(near, first, end) / per, _sums(near, first, end) / np.maximum(hits, 1),
        _sums(upper, starts, ends) / np.maximum(_sums(letters, starts, ends), 1), rate(punct), rate(buf == 33), rate(buf == 63),
        np.maximum(ohits - hits, 0) / per, rate(mixed), rate(digit), rate(signs), rate(same), rate(buf >= 128),
    ])


_BASE, _YOU = word_hashes(INSULTS), word_hashes(SECOND_PERSON)


def sample_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows (doc_id, label), chosen by a hash of the id."""
    return labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").select("doc_id", F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _learn_words(rows: DataFrame, z_least: float = 6.0, most: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word hashes that occur in clearly more toxic rows than their share, with their log odds; at most ``most``.

    One pair learned without each of the FOLDS folds, and a last one from all rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
            h, first, end = tb.words(*tb.columns(batch.column("text")), gap=_gap)
            seen = [np.unique(h[a:z]) for a, z in zip(first, end, strict=True)]
            if not len(h):
                continue
            each = [len(s) for s in seen]
            u, at = np.unique(np.concatenate(seen), return_inverse=True)
            toxic, fold = np.repeat(y, each), np.repeat(fold, each)
            cols = [np.bincount(at, w * (fold == k), len(u)).astype(np.int64) for k in range(FOLDS) for w in (1, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, cols)], ["word", *names])

    names = [f"{c}{k}" for k in range(FOLDS) for c in "nk"]
    total = {r["fold"]: (r["n"], r["k"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect()}
    counts = rows.select("text", "label", "fold").mapInArrow(count, "word long, " + ", ".join(f"{c} long" for c in names)).groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    plans = []
    for out in [*range(FOLDS), None]:
        used = [k for k in range(FOLDS) if k != out]
        n, k = (sum(total.get(f, (0, 0))[i] for f in used) for i in (0, 1))
        if not n or not k:
            plans.append(None)
            continue
        p = k / n
        kw, nw = (sum((F.col(f"{c}{f}") for f in used[1:]), F.col(f"{c}{used[0]}")) for c in "kn")
        plans.append((p, kw, nw, (kw - p * nw) / F.sqrt(nw * p * (1 - p) + 1e-9)))
    # one pass: words that stand out for any of the folds; each list is bounded by ``most``
    live = [x for x in plans if x]
    if not live:
        return [(np.zeros(0, np.uint64), np.zeros(0))] * len(plans)
    near = counts.where(reduce(lambda a, b: a | b, [(kw >= 3) & (z >= z_least) for _, kw, _, z in live])).persist()
    learned = []
    for x in plans:
        best = [] if x is None else near.select("word", x[1].alias("k"), x[2].alias("n"), x[3].alias("z")).where((F.col("k") >= 3) & (F.col("z") >= z_least)).orderBy(F.desc("z"), "word").limit(most).collect()
        word = np.array([r["word"] for r in best], np.int64).view(np.uint64)
        odds = np.array([np.log((r["k"] + 0.5) / (r["n"] - r["k"] + 0.5)) - np.log(x[0] / max(1 - x[0], 1e-9)) for r in best])
        order = np.argsort(word)
        learned.append((word[order], odds[order]))
    near.unpersist()
    return learned


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000):
    """A function from a text array to scores, learned from at most ``sample`` rows whose fold isn't held out.

    Folds are dealt by a hash of the text, so that copies share one; words,
    like trees, are learned without the fold whose margins calibrate the map.
    """
    chosen = sample_labels(labels.where(~held_out()), "toxic", sample)
    # the sample has a fixed bound of rows, so its ids can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")).persist()
    learned = _learn_words(rows)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in _parts(b.column("text")):
                x = np.concatenate([features(part, *words) for words in learned], 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(part)).cast(pa.int64()), b.column("label").slice(i, len(part)).cast(pa.int32()), b.column("fold").slice(i, len(part)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "fold", "x"])

    got = rows.select("doc_id", "label", "fold", "text").mapInArrow(table, "doc_id long, label int, fold int, x array<double>").toPandas()
    rows.unpersist()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), FOLDS + 1, FEATURES)
    model = Calibrated().fit(x[:, -1], got["label"].to_numpy(float), got["fold"].to_numpy(np.int64), [x[:, k] for k in range(FOLDS)])
    return lambda arr: model.predict(features(arr, *learned[-1]))


def _parts(arr: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    i = 0
    for part in tb.slices(arr):
        yield i, part
        i += len(part)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """Every column of ``docs`` and ``toxicity`` (0 to 1), row by row; nothing is shuffled.

    A null text counts as empty; an empty text has the score of its features
    (all rates 0). Equal texts have equal scores. Without labelled rows of both
    kinds the score is the share of toxic ones. Columns of ``docs`` named
    ``toxicity`` are replaced. Labels of one id that differ count as toxic.
    ``sample`` bounds the labelled rows that the trees are fitted on.
    """
    predict = train(docs, labels, sample)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [predict(p) for p in tb.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn("toxicity", score(F.col("text")))
