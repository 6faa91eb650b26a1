"""I-Match document fingerprints in DataFrame functions only.

Terms within a band of inverse document frequency are kept, distinct and
sorted; the sorted terms, and their intersections with randomised lexicon
subsets of several sizes, are hashed. A term is in a subset by a hash of it
and the subset's lane, so subsets are the same for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A range's lexicon is an array of so many arrays, by a hash of the term: a look-up reads one short array.
SLOTS = 1 << 12
LANES = 8
#: Shares of the lexicon in a lane's subsets, each a part of the one before: 1 / 4, 1 / 16, 1 / 64, 1 / 256.
SCALES = (4, 16, 64, 256)


def terms(text: Column) -> Column:
    """Sorted distinct hashes of a text's terms: runs without ASCII white space and punctuation, lower-cased."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def slot(term: Column) -> Column:
    return F.pmod(term, F.lit(SLOTS)).cast("int")


def lexicon(rows: DataFrame, n: int, least_idf: float, most_idf: float) -> DataFrame:
    """For each range the terms of its rows whose inverse document frequency, ln(N / df), is within the band: (range, band).

    ``rows`` has range and the terms of each text (own), and those of its
    edited text and of a next one in another range (other). Frequencies are those of whole terms over all
    own texts. A range sends an entry for each of its distinct terms, so that
    a common term is one entry a range.
    """
    entry = lambda x, k: F.transform(x, lambda t: F.struct(t.alias("term"), F.lit(k).alias("own")))
    pairs = rows.select("range", F.explode(F.concat(entry(F.col("own"), 1), entry(F.array_except("other", "own"), 0))).alias("e"))
    asked = pairs.groupBy("range", F.col("e.term").alias("term")).agg(F.sum("e.own").alias("n"))
    df = F.sum("n").over(Window.partitionBy("term"))
    held = asked.withColumn("df", df).where("df > 0").where(F.log(F.lit(float(max(n, 1))) / F.col("df")).between(least_idf, most_idf)).select("range", slot(F.col("term")).alias("slot"), "term")
    # each range has every slot, if with nothing in it
    every = rows.select("range").distinct().select("range", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"), F.lit(None).cast("long").alias("term"))
    slots = held.union(every).repartition("range").groupBy("range", "slot").agg(F.collect_list("term").alias("terms"))
    return slots.groupBy("range").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "terms"))), lambda x: x["terms"]).alias("band"))


def _lane(kept: Column, lane: Column) -> Column:
    """Hashes of one lane's subsets of the kept terms, from the largest to the smallest; 0 for an empty one."""

    def step(terms_: Column, k: int, found: list[Column]) -> Column:
        if k == len(SCALES):
            return F.array(*[_hashed(x) for x in found])
        inner = F.filter(terms_, lambda t: F.pmod(F.xxhash64(t, lane), F.lit(SCALES[k])) == 0)
        return F.transform(F.array(inner), lambda x: step(x, k + 1, [*found, x]))[0]

    return step(kept, 0, [])


def _hashed(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.xxhash64(x)).otherwise(F.lit(0).cast("long"))


def in_band(terms_: Column, band: Column) -> Column:
    """The terms that the range's lexicon holds."""
    return F.filter(terms_, lambda t: F.array_contains(band[slot(t)], t))


def with_signatures(df: DataFrame, all_: str, kept: str, out: str) -> DataFrame:
    """Adds ``out``: hashes of the kept terms and of each lane's subsets, lane by lane, 0 for an empty set.

    A text without a term in the band is represented by all its terms. The
    subsets are nested functions of arrays, which keeps the generated code
    small whatever the number of lanes.
    """
    df = df.withColumn(kept, F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(all_)))
    lanes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda lane: _lane(F.col(kept), lane)))
    return df.withColumn(out, F.concat(F.array(_hashed(F.col(kept))), lanes)).drop(all_, kept)


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of lanes whose smallest subset that holds a term of either text is hashed alike; 1 for equal signatures."""

    def lane_alike(lane: Column) -> Column:
        at = lambda k: lane * len(SCALES) + k + 1
        steps = F.sequence(F.lit(0), F.lit(len(SCALES) - 1))
        return F.aggregate(steps, F.lit(-1), lambda was, k: F.when((a[at(k)] != 0) | (b[at(k)] != 0), (a[at(k)] == b[at(k)]).cast("int")).otherwise(was))

    held = F.filter(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lane_alike), lambda x: x >= 0)
    return F.when(a == b, 1.0).when(F.size(held) > 0, F.aggregate(held, F.lit(0), lambda x, y: x + y) / F.size(held)).otherwise(0.0)


def with_next(docs: DataFrame, group_rows: int = 1024) -> tuple[DataFrame, int]:
    """Each row with its range, its place there and ``next_text``, that of the row that follows in descending doc_id (after the last: the first); the number of rows.

    Rows are dealt by ranges of doc_id and look at their neighbour inside a
    range; only a range's lowest row needs another range's highest. Rows with
    one id follow each other by a hash of their text; null ids come last. The
    result is still dealt by range.
    """
    lo, hi, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    width = max(1.0, (float(hi) - float(lo) + 1) / max(1, -(-n // group_rows)))
    dealt = docs.select("doc_id", "text", F.coalesce(F.floor((F.col("doc_id").cast("double") - float(lo)) / width), F.lit(-1)).alias("range"))
    w = Window.partitionBy("range").orderBy("doc_id", F.xxhash64("text"))
    tops = dealt.withColumn("__after", F.lead(F.lit(1)).over(w)).where(F.col("__after").isNull()).select(F.col("range").alias("below"), F.col("text").alias("top_text"))
    # the range before each range, by spans of 4,096 ranges, then by the few spans
    ranges = dealt.select("range").distinct().withColumn("span", F.floor(F.col("range") / 4096))
    spans = ranges.groupBy("span").agg(F.max("range").alias("top"))
    every = Window.orderBy("span")
    spans = spans.withColumn("before", F.coalesce(F.lag("top").over(every), F.max("top").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("span", "before")
    below = ranges.join(spans, "span").select("range", F.coalesce(F.lag("range").over(Window.partitionBy("span").orderBy("range")), "before").alias("below"))
    edge = below.join(tops, "below").select("range", "top_text")
    seen = dealt.withColumns({"place": F.row_number().over(w), "next_text": F.lag("text").over(w)})
    return seen.join(edge, "range").select("doc_id", "range", "place", "text", F.coalesce("next_text", "top_text").alias("next_text")), n


def fingerprints(docs: DataFrame, least_idf: float = 1.6, most_idf: float = 12.0) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many, or all, of the next document's in descending doc_id. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. Null texts count as empty; an empty text has a
    fingerprint of zeros, and is like another empty one. Equal texts have equal
    fingerprints. Rows with one id follow each other by a hash of their text.
    Other columns are not read. The band is of natural logarithms; terms are
    compared as 64-bit hashes, and one that no text has is outside the band.
    """
    both, rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 2).cast("int"))))
    # a next text is another row's own one, save for a range's first row
    both = both.withColumn("next", F.when(F.col("place") == 1, terms(F.col("next_text"))).otherwise(F.array().cast("array<long>")))
    both = both.select("doc_id", "range", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("edited"), "next")
    bands = lexicon(both.select("range", "own", F.array_union("edited", "next").alias("other")), rows, least_idf, most_idf)
    texts = ("own", "edited", "next")
    done = both.join(bands, "range").select("doc_id", "range", "place", "n_chars", "edited_sha256", *texts, *[in_band(F.col(c), F.col("band")).alias(f"{c}_band") for c in texts])
    for c in texts:
        done = with_signatures(done, c, f"{c}_band", f"{c}_signatures")
    done = done.withColumn("next_signatures", F.coalesce(F.lag("own_signatures").over(Window.partitionBy("range").orderBy("place")), "next_signatures"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own_signatures")).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("own_signatures"), F.col("edited_signatures")).alias("near_edited"), likeness(F.col("own_signatures"), F.col("next_signatures")).alias("near_next"),
    )
