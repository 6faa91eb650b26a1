"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists.

1. Texts are dealt into bounded batches. Each batch asks how many distinct
   shingle sets hold each of its shingles; equal sets count once a batch.
2. A set can only link if enough of its shingles occur in another set. Those
   that can keep their shingles, ordered from rare to frequent; equal sets
   become one class.
3. Classes that share one of their rarest shingles (enough of them that any
   link shares one) form families; a family, or a pair of blocks of a large
   one, is searched in one task: inverted lists, short ones merged by a heap
   that skips rows which can't occur often enough, long ones probed by binary
   search.
4. Links become components. Only a forest of links and each class's number of
   links leave a task, never all pairs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import batch_count, batch_of, components, dealt_by, stage, text_bytes

#: Classes of a family that one task indexes at once.
BLOCK_SETS = 500
LOW = tb.U(0xFFFFFFFF)


def overlap_needed(size_a, size_b, percent: int):
    """Least intersection for 100 * i >= percent * (a + b - i)."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for part in tb.slices(texts):
        out += tb.shingles(*tb.words(*tb.columns(part)), k)
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums over each set."""
    sig = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            sig[i] = s.sum(), tb.mix(s ^ tb._K[1]).sum()
    return sig.view(np.int64)


def _first_of_each(doc: np.ndarray, sets: list[np.ndarray], sig: np.ndarray) -> np.ndarray:
    """Rows that are the smallest id of their set in this batch; empty sets are left out."""
    order = np.lexsort((doc, sig[:, 1], sig[:, 0]))
    s = sig[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    return np.array([i for i in order[new] if len(sets[i])], np.int64)


def _asked(sets: list[np.ndarray], rows: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the rows by bucket, in how many rows each is, and the bucket of each."""
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, n = np.unique(np.concatenate([sets[i] for i in rows]), return_counts=True)
    bucket = ((u >> tb.U(32)) % tb.U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return u[order], n[order], bucket[order]


def _ask(table: pa.Table, k: int, n_buckets: int) -> pa.Table:
    sets = _sets(table.column("text").combine_chunks(), k)
    doc = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
    u, n, bucket = _asked(sets, _first_of_each(doc, sets, _signatures(sets)), n_buckets)
    key, count = (u & LOW).astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
    present, start = np.unique(bucket, return_index=True)
    ends = [*start[1:].tolist(), len(u)][: len(start)]
    batch = table.column("batch")[0].as_py()
    return pa.table({"bucket": pa.array(present.astype(np.int32)), "batch": pa.array([batch] * len(present), pa.int32()), "key": pa.array([key[a:z].tobytes() for a, z in zip(start, ends, strict=True)], pa.binary()), "n": pa.array([count[a:z].tobytes() for a, z in zip(start, ends, strict=True)], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """For each asking batch the number of sets over all batches, at most 255, key by key."""
    keys = [np.frombuffer(x, np.uint32) for x in table.column("key").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("n").to_pylist()])
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(at, counts, len(u)), 255).astype(np.uint8)[at]
    ends = np.cumsum([len(x) for x in keys])
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "df": pa.array([total[z - len(x) : z].tobytes() for x, z in zip(keys, ends, strict=True)], pa.binary())})


def _survivors(docs: pa.Table, answers: pa.Table, k: int, percent: int, n_buckets: int) -> pa.Table:
    sets = _sets(docs.column("text").combine_chunks(), k)
    sig = _signatures(sets)
    doc = docs.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
    rows = _first_of_each(doc, sets, sig)
    u, _, _ = _asked(sets, rows, n_buckets)
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("df").to_pylist(), strict=True))
    df = np.frombuffer(b"".join(got[b] for b in sorted(got)), np.uint8)
    order = np.argsort(u)
    u, df = u[order], df[order]
    tokens: list[bytes | None] = [None] * len(sets)
    prefix: list[np.ndarray | None] = [None] * len(sets)
    for i in rows:
        s = sets[i]
        d = df[np.searchsorted(u, s)]
        need = -(-percent * len(s) // 100)
        if (d > 1).sum() >= need:
            s = s[np.lexsort((s, d))]
            tokens[i], prefix[i] = s.tobytes(), s[: len(s) - need + 1].view(np.int64)
    return pa.table({"doc_id": docs.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "sig_a": pa.array(sig[:, 0]), "sig_b": pa.array(sig[:, 1]), "tokens": pa.array(tokens, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64()))})


class Lists:
    """Inverted lists of token sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        self.rows = row[order]
        self.tokens, start = np.unique(token[order], return_index=True)
        self.start = np.append(start, len(order))
        self.lists: dict[int, list[int]] = {}

    def postings(self, j: int) -> list[int]:
        """Rows of the j-th token, rising."""
        if j not in self.lists:
            self.lists[j] = self.rows[self.start[j] : self.start[j + 1]].tolist()
        return self.lists[j]

    def merge(self, lists: list[list[int]], least: int, above: int = -1) -> list[tuple[int, int]]:
        """(row, number of lists that hold it) for each row over ``above`` in at least ``least`` lists.

        A heap holds each list's next row. Where the smallest row is in too few
        lists, as many more are popped as could be missed without a loss, and
        all of these skip by binary search to the row that is then smallest.
        """
        place = [bisect_right(x, above) for x in lists] if above >= 0 else [0] * len(lists)
        heap = [(x[i], j) for j, (x, i) in enumerate(zip(lists, place, strict=True)) if i < len(x)]
        heapify(heap)
        out = []
        while len(heap) >= least:
            row, popped = heap[0][0], []
            while heap and heap[0][0] == row:
                popped.append(heappop(heap)[1])
            if len(popped) >= least:
                out.append((row, len(popped)))
                for j in popped:
                    place[j] += 1
                    if place[j] < len(lists[j]):
                        heappush(heap, (lists[j][place[j]], j))
                continue
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                break
            to = heap[0][0]
            for j in popped:
                place[j] = bisect_left(lists[j], to, place[j])
                if place[j] < len(lists[j]):
                    heappush(heap, (lists[j][place[j]], j))
        return out

    def search(self, query: np.ndarray, percent: int, above: int = -1) -> np.ndarray:
        """Rows over ``above`` whose Jaccard with ``query`` is at least ``percent``.

        DivideSkip: the longest lists are set aside; the short ones are merged
        by a heap, rows that can still reach the overlap are looked up in each
        long list by binary search and dropped as soon as they can't.
        """
        at = np.searchsorted(self.tokens, query)
        at = at[at < len(self.tokens)][self.tokens[at[at < len(self.tokens)]] == query[at < len(self.tokens)]]
        need = -(-percent * len(query) // 100)
        if len(at) < need or not len(at):
            return np.zeros(0, np.int64)
        length = self.start[at + 1] - self.start[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        n_long = min(need - 1, int(need / (0.01 * np.log2(longest + 1) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        found = self.merge([self.postings(j) for j in short.tolist()], need - n_long, above)
        rows, count = np.array(found, np.int64).reshape(-1, 2).T
        least = overlap_needed(len(query), self.sizes[rows], percent)
        smaller, larger = np.minimum(self.sizes[rows], len(query)), np.maximum(self.sizes[rows], len(query))
        ok = (count + n_long >= least) & (100 * smaller >= percent * larger)
        rows, count, least = rows[ok], count[ok], least[ok]
        for left, j in zip(range(n_long - 1, -1, -1), long.tolist(), strict=True):
            if not len(rows):
                break
            lst = self.rows[self.start[j] : self.start[j + 1]]
            place = np.minimum(np.searchsorted(lst, rows), len(lst) - 1)
            count = count + (lst[place] == rows)
            ok = count + left >= least
            if not ok.all():
                rows, count, least = rows[ok], count[ok], least[ok]
        return rows[100 * count >= percent * (len(query) + self.sizes[rows] - count)]


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _search_unit(table: pa.Table, percent: int) -> pa.Table:
    """Links among the classes (doc_id: the class) of one unit: a forest (kind 0: class, other) and numbers of links (kind 1: class, n).

    In a unit of two blocks only pairs across the blocks are searched.
    """
    out: list[tuple[int, int, int]] = []
    family = table.column("family").to_numpy()
    order = np.argsort(family, kind="stable")
    table, family = table.take(pa.array(order)), family[order]
    doc, side, copies = (table.column(c).to_numpy() for c in ("doc_id", "side", "copies"))
    bounds = np.append(np.flatnonzero(np.append(True, family[1:] != family[:-1])), len(family))
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a < 2:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").slice(a, z - a).to_pylist()]
        two = (side[a:z] == 1).any()
        left = np.flatnonzero(side[a:z] == 0)
        right = np.flatnonzero(side[a:z] == 1) if two else left
        if not len(left) or not len(right):
            continue
        lists, parent, links = Lists([sets[i] for i in left]), list(range(z - a)), np.zeros(z - a, np.int64)
        for q, i in enumerate(right.tolist()):
            for j in left[lists.search(sets[i], percent, -1 if two else q)].tolist():
                links[i] += copies[a + j]
                links[j] += copies[a + i]
                x, y = _find(parent, i), _find(parent, j)
                if x != y:
                    parent[x] = y
                    out.append((0, int(doc[a + i]), int(doc[a + j])))
        out += [(1, int(doc[a + i]), int(links[i])) for i in np.flatnonzero(links)]
    kind, d, v = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "doc_id": pa.array(d, pa.int64()), "value": pa.array(v, pa.int64())})


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard of at least ``percent`` / 100.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. One
    row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links), n_links (rows that it links to directly). Null
    and empty texts have no shingles, no links and their own id as component; a
    null doc_id has a null component and links with nothing. Equal sets link
    with each other; a repeated doc_id is one vertex whatever its texts, save
    that its rows without a shingle stay by themselves. Other columns of ``docs`` are not read.
    Shingles are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    n_batches = batch_count(spark, n_bytes)
    n_buckets = batch_count(spark, n_bytes // 6, 1_000_000)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("batch", batch_of(dealt_by(), n_batches))
    asked = dealt.groupBy("batch").applyInArrow(lambda t: _ask(t, k, n_buckets), "bucket int, batch int, key binary, n binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "batch int, bucket int, df binary")
    kept = stage(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda d, a: _survivors(d, a, k, percent, n_buckets), "doc_id long, n_shingles long, sig_a long, sig_b long, tokens binary, prefix array<long>"))

    sig = ["n_shingles", "sig_a", "sig_b"]
    # a class is a set of shingles; rows with one id may be of several classes
    kept = kept.withColumn("class", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64(*sig)))
    classes = stage(kept.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies")))
    with_tokens = kept.where("tokens IS NOT NULL AND class IS NOT NULL").select("doc_id", "class", "n_shingles", "tokens", "prefix").join(classes, "class").where("doc_id = rep")
    sets = stage(with_tokens.dropDuplicates(["class"]).select(F.col("class").alias("doc_id"), "copies", "n_shingles", "tokens", "prefix"))

    # families: classes joined by shared prefix shingles; each points to the smallest class that shares one
    listed = sets.select("doc_id", F.explode("prefix").alias("token"))
    first = listed.groupBy("token").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("token", "lead")
    families = components(listed.join(first, "token").where("doc_id <> lead").select(F.col("doc_id").alias("u"), F.col("lead").alias("v")))
    member = sets.select("doc_id", "copies", "n_shingles", "tokens").join(families.select(F.col("vertex").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    member = stage(member)
    n_units = batch_count(spark, member.count(), 300)
    sized = member.groupBy("family").agg(F.count("*").alias("members"))
    small = member.join(sized.where(F.col("members") <= block_sets), "family").withColumn("unit", F.pmod(F.xxhash64("family"), F.lit(n_units))).withColumn("side", F.lit(0))
    # a large family is dealt into blocks; every pair of blocks is a unit
    large = member.join(sized.where(F.col("members") > block_sets), "family").withColumn("blocks", F.ceil(F.col("members") / block_sets)).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    pairs = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("unit", F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", F.when(F.col("own") <= F.col("other"), 0).otherwise(1))
    cols = ["unit", "family", "side", "doc_id", "copies", "tokens"]
    found = stage(small.select(*cols).union(pairs.select(*cols)).groupBy("unit").applyInArrow(lambda t: _search_unit(t.drop(["unit"]), percent), "kind int, doc_id long, value long"))

    # an id with several sets makes them one vertex
    several = kept.where("class IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("v"), F.max("class").alias("top")).where("v <> top").select("doc_id", "v")
    same = kept.where("class IS NOT NULL").join(several, "doc_id").where("class <> v").select(F.col("class").alias("u"), "v")
    linked = components(found.where("kind = 0").select(F.col("doc_id").alias("u"), F.col("value").alias("v")).union(same))
    n_links = found.where("kind = 1").groupBy(F.col("doc_id").alias("class")).agg(F.sum("value").alias("others"))
    own = classes.join(linked.select(F.col("vertex").alias("class"), F.col("component").alias("group")), "class")
    group = own.select("class", "group").join(own.groupBy("group").agg(F.min("rep").alias("component")), "group").select("class", "component")
    by_class = classes.join(group, "class", "left").join(n_links, "class", "left").select("class", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    # staged, so that the join has an exchange on both sides and a class of very many copies can be split
    return kept.select("doc_id", "n_shingles", "class").join(stage(by_class), "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
