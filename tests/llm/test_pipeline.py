"""The pipeline's stages on the smallest tables: each does what its operator says, on all it gets."""

import corpus_pipeline as c
from test_operators import jaccard_truth

from loreweave.llm import suffix, toxicity
from loreweave.llm.common import stage


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, f in c.STAGES[:-1]:
        out = stage(f(spark, docs, sf))
        assert out.columns == c.COLUMNS
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {r.doc_id for r in docs.collect()}
        kept[name] = (docs, out)
        docs = out
    before, after = kept["toxicity"]
    scores = toxicity.score_toxicity(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert after.count() == scores.where("toxicity < 0.5").count()
    before, after = kept["near_duplicates"]
    truth = jaccard_truth([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {component for _, component, _ in truth.values()}
    before, after = kept["repeated_passages"]
    assert suffix.dedup_substrings(before).where("n_removed < n_bytes OR n_removed = 0").count() == after.count()
    assert c.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    assert c.run(spark, sf).count() == docs.count()


def test_quality_stage_brute_force(spark, sf):
    """What the stage keeps are the rows with the largest keys, as many as lie over the break-even weight."""
    import numpy as np

    from loreweave.llm import quality

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.resample(docs, labels).select("doc_id", "log_weight", "gumbel_key").toPandas()
    y = labels.toPandas().dropna(subset=["quality"]).groupby("doc_id").quality.max()
    own = rows.set_index("doc_id").log_weight.reindex(y.index).dropna()
    least = quality.break_even(own.to_numpy(), y.loc[own.index].to_numpy())
    cost = lambda w: int(((own >= w) & (y.loc[own.index] == 0)).sum() + ((own < w) & (y.loc[own.index] == 1)).sum())
    assert cost(least) == min(cost(w) for w in [-np.inf, *own, np.inf])
    k = int((rows.log_weight >= least).sum())
    want = set(rows.sort_values("gumbel_key", ascending=False).doc_id[:k])
    assert {r.doc_id for r in c.quality(spark, docs, sf).collect()} == want


def test_packing_stage(spark, sf):
    """Every text is in the result with its encoder's number of tokens, and no batch passes the budget."""
    from collections import Counter

    from loreweave.llm import pieces

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = c.packing(spark, docs, sf).collect()
    want = {r.doc_id: (r.text, len(r.ids)) for r in pieces.encode_pieces(docs).collect()}
    assert {r.doc_id: (r.text, r.n_tokens) for r in out} == want and len(out) == len(want)
    rows = Counter(r.batch_id for r in out)
    assert all(rows[r.batch_id] == r.batch_rows and (r.batch_rows == 1 or r.batch_rows * r.bucket_length <= 65_536) and r.n_tokens <= r.bucket_length for r in out)


def test_awkward_tables(spark, sf):
    """Null ids and texts, empty and repeated rows, and an empty table go through every stage."""
    from test_operators import AWKWARD

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame([(i, x, lang, "s", len(x or "")) for i, x, lang in AWKWARD], schema)
    for docs in (rows, rows.limit(0)):
        n = docs.count()
        for name, f in c.STAGES:
            out = stage(f(spark, docs, sf))
            assert out.count() <= n and (name == "packing" or out.columns == c.COLUMNS)
            if name != "packing":
                docs, n = out, out.count()
        assert out.count() == n
