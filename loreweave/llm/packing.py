"""Optimal length buckets, and token-budget batches inside each bucket.

The histogram of lengths over all rows goes to the driver in a bounded number
of bins; a dynamic program picks the bucket boundaries with the least padding.
Each bucket is dealt into shards of bounded size and cut into batches there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Lengths up to EXACT have a bin each; above, each doubling is cut into FINE bins.
EXACT, FINE = 1024, 128


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space; null is empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_bin(n: Column) -> Column:
    """A number that rises with the length: each length up to EXACT by itself, then FINE numbers for each doubling."""
    exponent = F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"), F.lit(10))
    step = F.pow(F.lit(2.0), exponent - 7)
    return F.when(n <= EXACT, n).otherwise(F.lit(EXACT) + (exponent - 10).cast("long") * FINE + F.floor((n - F.pow(F.lit(2.0), exponent)) / step).cast("long") + 1)


def choose_boundaries(length: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` runs of bins (rising ``length``) with the least padded tokens.

    ``count`` and ``total`` are the rows and the tokens of each bin. Of equal
    costs the fewest, then the lowest boundaries are taken.
    """
    m = len(length)
    if not m:
        return []
    n = np.concatenate(([0], np.cumsum(count, dtype=float)))
    t = np.concatenate(([0], np.cumsum(total, dtype=float)))
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = []
    costs = []
    for _ in range(min(buckets, m)):
        nxt, frm = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            c = best[:j] + length[j - 1] * (n[j] - n[:j]) - (t[j] - t[:j])
            frm[j] = int(c.argmin())
            nxt[j] = c[frm[j]]
        back.append(frm)
        best = nxt
        costs.append(nxt[m])
    k, j, out = int(np.argmin(costs)) + 1, m, []
    while k:
        out.append(int(length[j - 1]))
        k, j = k - 1, int(back[k - 1][j])
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 12, budget: int = 65_536, shard_rows: int = 50_000, shard_tokens: int = 8_000_000, carry: bool = False) -> DataFrame:
    """Bucket and batch of each row; only ids and lengths are shuffled, and where ``carry`` is set all other columns.

    Returns doc_id, n_tokens, bucket (0 the shortest), bucket_length (every
    row of the bucket is padded to it), shard, batch_id, slot (place in the
    batch) and batch_rows; with ``carry`` the columns of ``docs`` first, of
    which those with these names are replaced. A batch holds as many rows as
    fit ``budget`` padded tokens, one at least; nothing is cut, so a row longer
    than ``budget`` is a batch of its own. ``length`` is the number of tokens
    of a row (whole text; words by default; null counts as 0), and is worked
    out once. Empty texts have length 0 and lie in the lowest bucket. Repeated
    rows are packed as often as they occur. A shard has about ``shard_rows`` rows
    or ``shard_tokens`` tokens, whichever is less. Rows are dealt into shards by their
    id and length, those without an id by their place in the staged lengths;
    within a shard they are ordered by a hash of their id, then length.
    """
    n = F.coalesce(length if length is not None else word_count(F.col("text")), F.lit(0)).cast("long")
    made = ("n_tokens", "bucket", "bucket_length", "shard", "batch_id", "slot", "batch_rows")
    rest = [c for c in docs.columns if c not in made and c != "doc_id"] if carry else []
    sized = stage(docs.withColumn("n_tokens", n).select("doc_id", *rest, "n_tokens"))
    hist = sized.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("t")).orderBy("bin").collect()
    top, count, total = (np.array([r[c] for r in hist], np.int64) for c in ("top", "n", "t"))
    bounds = choose_boundaries(top, count, total, buckets)
    own = [(top > lo) & (top <= hi) for lo, hi in zip([-1, *bounds], bounds, strict=False)]
    shards = [max(1, -(-int(count[b].sum()) // shard_rows), -(-int(total[b].sum()) // shard_tokens)) for b in own]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1) if values else F.lit(None).cast("long")
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + F.when(F.col("n_tokens") > b, 1).otherwise(0)
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "n_tokens"))
    dealt = sized.withColumn("__key", key).withColumn("bucket", bucket).withColumn("bucket_length", pick([int(b) for b in bounds])).withColumn("shard", F.pmod("__key", pick([int(s) for s in shards])).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens", "__key")) - 1
    fit = pick([max(1, budget // max(1, int(b))) for b in bounds]).cast("int")
    out = dealt.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / fit).cast("int")).withColumn("slot", (F.col("place") % fit).cast("int"))
    return out.select("doc_id", *rest, "n_tokens", "bucket", "bucket_length", "shard", F.format_string("%02d-%06d-%06d", "bucket", "shard", "batch").alias("batch_id"), "slot", F.least(fit, F.count("*").over(Window.partitionBy("bucket", "shard")) - F.col("batch") * fit).cast("int").alias("batch_rows"))


def padding(packed: DataFrame) -> DataFrame:
    """Rows, tokens and padded tokens of each bucket."""
    return packed.groupBy("bucket", "bucket_length").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("bucket_length") - F.col("n_tokens")).alias("padding"))
