"""Scalar functions and small operators against values worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loreweave.functions import names as N
from loreweave.functions import text as T
from loreweave.operators import entity as E
from loreweave.operators import graph as G
from loreweave.operators import retrieval as R
from loreweave.sources import tables as S

CASES = [
    (T.slug, "Meridian-Hartwell Consolidated Holdings, LP", "meridian_hartwell_consolidated_holdings_lp"),
    (T.edge_type, "acquired by!", "ACQUIRED_BY"), (T.alias_key, " The Target ", "target"),
    (T.period, "Q2 FY2024", "Q2-2024"), (T.period, "March 2024", "MAR-2024"), (T.period, "FY 2024", "FY-2024"), (T.period, "Third Quarter 2024", "Q3-2024"), (T.period, "2024", None),
    (T.section, "# A\n## B\n### C", "B"), (T.section, "# A\n## B\n# D", "D"), (T.section, "none", "General"),
    (T.is_markdown_table, "| a | b |\n|---|---|", True), (T.is_markdown_table, "| a | b |", False),
    (T.needs_math, "Calculate 213 minus 27", True), (T.needs_math, "state-of-the-art tools?", True), (T.needs_math, "What is the net revenue change from Q1 to Q2?", False), (T.needs_math, "Give the sum of 5", False),
    (T.question_type, "Supplier must file 3 forms", "predicate"), (T.question_type, "List all risk factors mentioned across all sections", "synthesis"), (T.question_type, "What is the revenue for Apple in Q1 2024?", "factual"),
    (T.is_multi_entity, "Who are the signatories?", True),
    (T.normalise_durations, "2 years", "24_months"), (T.normalise_durations, "twenty-four (24) months", "24_months"), (T.normalise_durations, "36-month", "36_months"),
    (T.is_reference, "terms are summarized in Section 5.2", True), (T.is_reference, "fee = 3", False),
    (T.contradiction, "x revised to y", "revision"), (T.contradiction, "a direct conflict between, revised to", "documented_conflict"),
    (T.mime, "a.tar.GZ", "application/octet-stream"), (T.mime, "b.PDF", "application/pdf"), (T.strip_honorific, "Mr. Raymond Voss", "Raymond Voss"), (T.strip_credentials, "Dr. Patricia Nwankwo, PhD, SHRM-SCP", "Dr. Patricia Nwankwo"),
    (N.title_case, " o'neil  mc-donald ", "O'Neil Mc-Donald"),
]


@pytest.mark.parametrize("f,given,want", CASES)
def test_scalar(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(f(F.col("x"))).first()[0] == want


def test_numbers(spark):
    one = spark.range(1)
    for score, clean, feedback, contradicted in ((-11.375, 0.05, 0.05, 0.0), (0.6, 0.6, 0.3, 0.42), (2.0, 0.95, 0.5, 0.75)):
        s, t, f = F.lit(score), F.lit(True), F.lit(False)
        got = one.select(T.confidence(s, f, f), T.confidence(s, f, t), T.confidence(s, t, f)).first()
        assert [round(x, 6) for x in got] == [clean, feedback, contradicted]
    assert [round(x) for x in one.select(*[T.node_size(F.lit(d)) for d in (0, 1, 3, 7)]).first()] == [2, 4, 8, 12]
    assert list(one.select(*[T.ttl_seconds(F.lit(s)) for s in ("processing", "completed", "failed", "cancelled", "x")]).first()) == [604800, 2592000, 604800, 172800, 2592000]
    assert list(one.select(T.proximity(F.lit("report.pdf"), F.lit("rep")), T.proximity(F.lit("report.pdf"), F.lit("zz")), T.search_score(F.lit("report.pdf"), "report")).first()) == [18, 0, 1299.0]
    assert [one.select(R.per_query_limit(F.lit(n), F.lit(m))).first()[0] for n in (1, 2, 4) for m in (False, True)] == [10, 15, 5, 7, 5, 5]


def test_names():
    for a, b, want in (("Gerald Ashford", "Gerald Fontaine", True), ("Ann Lee", "Bob Ray", True), ("Ann Lee", "Bob Lee", False), ("Lee", "Ann Lee", False)):
        assert N.blocked(a, b) is want
    assert N.token_sort_ratio("b a", "a b") == 100 and N.indel_ratio("ab", "cd") == 0


def test_clusters(spark):
    rows = [("d", n, True) for n in ("Gerald Ashford", "Gerald Fontaine", "G. Ashford", "Bob Ray")]
    got = {r["name"]: r["canonical"] for r in E.leader_clusters(spark.createDataFrame(rows, "document string, name string, person boolean"), "document", "person").collect()}
    assert got["G. Ashford"] == got["Gerald Ashford"] or got["G. Ashford"] == "G. Ashford"
    assert got["Gerald Fontaine"] != got["Gerald Ashford"] and set(got) == {r[1] for r in rows}


def test_budget_and_rerank(spark):
    rows = spark.createDataFrame([(1, 1, 60), (1, 2, 30), (1, 3, 20)], "q int, rank int, size int")
    assert R.within_budget(rows, ["q"], [F.col("rank")], F.col("size"), 100).count() == 2
    df = spark.createDataFrame([(1, 1, -9.0), (1, 2, -8.0), (2, 1, -9.0), (2, 2, 1.0)], "q int, prior int, s double")
    assert sorted((r.q, r.prior) for r in R.rerank(df, "q", "s", "prior", -5.0).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Report Q2 2024\n## Costs\n")
    (tmp_path / "b.html").write_text("<p>hi <b>you</b></p><script>x</script>")
    listing = S.list_files(spark, str(tmp_path))
    assert {(r.filename, r["size"]) for r in listing.collect()} == {("a.md", 26), ("b.html", 38)}
    assert S.file_size(listing, "zz").first()[0] == 0
    got = {r.filename: r for r in S.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.md"].section == "Costs" and got["b.html"].text.split() == ["hi", "you"]
    assert {r.filename: r.mime for r in S.read_blobs(spark, str(tmp_path)).collect()} == {"a.md": "text/markdown", "b.html": "text/html"}
    points = spark.createDataFrame([("1", "s"), ("1", "s"), ("2", "t")], "point_id string, source string")
    S.write_points(points, str(tmp_path / "points"))
    back = spark.read.parquet(str(tmp_path / "points"))
    assert back.count() == 2 and S.upsert(back, points, "point_id").count() == 2
    assert S.delete_keys(back, points.where("source = 's'"), "source").count() == 1
    S.write_csv(points, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3


def test_display_and_keys(spark):
    row = spark.range(1).select(
        *[T.simulated_progress(F.lit(ms)).alias(f"p{ms}") for ms in (0, 4999, 5000, 150_000, 900_000)], T.size_kb(F.lit(1588)).alias("kb"),
        *[T.edge_class(F.lit(x)).alias(x) for x in ("NEGATES", "REVISES", "OWNS")], T.edge_class(F.lit(None).cast("string")).alias("none"),
        T.variable_lines(F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))).alias("lines"),
        T.math_key(F.lit("c" * 3000), F.lit("Q")).alias("math"), T.constraint_key(F.lit("Q"), F.lit("c" * 3000)).alias("constraint"),
    ).first()
    assert row[:5] == (10, 10, 2, 45, 90)
    assert (row.kb, row.NEGATES, row.REVISES, row.OWNS, row.none) == (1.6, "adversarial", "revision", "plain", "plain")
    assert row.lines == "a = 2\nb = 3"
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert (row.math, row.constraint) == (md5("c" * 2000 + "::q"), md5("q::" + "c" * 1000))


def test_long_cycles(spark):
    edges = [("ring", f"v{i}", f"v{(i + 1) % 20}") for i in range(20)] + [("tail", "x", "y"), ("tail", "y", "x"), ("tail", "y", "z"), ("tail", "w", "x")]
    edges += [("chain", f"v{i}", f"v{i + 1}") for i in range(20)] + [("diamond", a, b) for a, b in ("ab", "ac", "bd", "cd")] + [("self", "a", "a")]
    got = {r.grp for r in G.transitive_cycles(spark.createDataFrame(edges, "grp string, src string, dst string")).collect()}
    assert got == {"ring", "tail", "self"}
    assert G.transitive_cycles(spark.createDataFrame([], "grp string, src string, dst string")).count() == 0
