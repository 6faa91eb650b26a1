"""Property graph on two DataFrames: nodes (type, name, ...) and edges (src, type, dst, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import stage


def upsert_nodes(nodes: DataFrame, order: str = "document_id", current: DataFrame | None = None, properties: list[str] | None = None) -> DataFrame:
    """One row for each (type, name): created by the first document to arrive (column ``order``), owned by the last.

    ``properties`` take their last value that isn't null. ``current`` is the
    table as it is: its creators stay, and what it says is older than all of ``nodes``.
    """
    given = properties or []
    rows = nodes.select("type", "name", F.col("document_id").alias("created_by"), "document_id", F.lit(1).alias("__age"), F.col(order).alias("__at"), *given)
    if current is not None:
        rows = rows.unionByName(current.select("type", "name", "created_by", "document_id", F.lit(0).alias("__age"), F.lit(None).cast(rows.schema["__at"].dataType).alias("__at"), *given))
    at = F.struct("__age", "__at")
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in given]
    return rows.groupBy("type", "name").agg(F.min_by("created_by", at).alias("created_by"), F.max_by("document_id", at).alias("document_id"), *last)


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each (src, type, dst) whose ends are names of nodes of any type; provenance of the first document."""
    named = nodes.select("name").distinct()
    ok = edges.join(named.withColumnRenamed("name", "src"), "src", "left_semi").join(named.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return ok.groupBy("src", "type", "dst").agg(F.min("document_id").alias("document_id"))


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "type", "dst")
    return e.union(e.select(F.col("dst").alias("src"), "type", F.col("src").alias("dst")))


def two_hops(seeds: DataFrame, edges: DataFrame, second: list[str], limit: int = 50) -> DataFrame:
    """Neighbours of the seeds (column name), and optionally theirs along some types; the first rows in full order."""
    e = undirected(edges)
    one = e.join(seeds.select(F.col("name").alias("src")), "src", "left_semi")
    far = e.where(F.col("type").isin(second)).select(F.col("src").alias("dst"), F.col("type").alias("type2"), F.col("dst").alias("leaf"))
    rows = one.join(far, "dst", "left").select("src", "type", "dst", "type2", "leaf").distinct()
    return rows.orderBy("src", "type", "dst", F.col("type2").asc_nulls_first(), F.col("leaf").asc_nulls_first()).limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def relation_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit("UNKNOWN")).alias("relation")).agg(F.count("*").alias("n"))


def viz(edges: DataFrame, n: int) -> DataFrame:
    """The first edges in full order, 1 to 5000 of them, each with the number of all."""
    total = edges.agg(F.count("*").alias("total"))
    first = edges.select("src", "type", "dst").orderBy("src", "type", "dst").limit(min(max(n, 1), 5000))
    return first.join(F.broadcast(total))  # one aggregate row


def delete_document(nodes: DataFrame, edges: DataFrame, document: Column) -> tuple[DataFrame, DataFrame]:
    """What is left: other documents' edges; nodes that aren't both the document's and without edges."""
    left = edges.where(~(F.col("document_id") == document))
    ends = left.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("linked", F.lit(True))
    kept = nodes.join(ends, "name", "left").where(F.col("linked").isNotNull() | (F.col("document_id") != document)).drop("linked")
    return kept, left


def validate(nodes: DataFrame, edges: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Unknown node types become Concept; edges without both ends in their chunk go, and so with them graphs without nodes."""
    n = nodes.withColumn("type", F.when(F.col("type").isin(allowed), F.col("type")).otherwise("Concept"))
    ids = n.select("chunk_id", "id").distinct()
    ok = edges.join(ids.withColumnRenamed("id", "source_id"), ["chunk_id", "source_id"], "left_semi").join(ids.withColumnRenamed("id", "target_id"), ["chunk_id", "target_id"], "left_semi")
    return n, ok


def remap(edges: DataFrame, mapping: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both ends through a map (old, new); ends without an entry stay; edges that became loops go."""
    a = mapping.select(F.col("old").alias(src), F.col("new").alias("__s"))
    b = mapping.select(F.col("old").alias(dst), F.col("new").alias("__d"))
    out = edges.join(a, src, "left").join(b, dst, "left").withColumn(src, F.coalesce("__s", src)).withColumn(dst, F.coalesce("__d", dst)).drop("__s", "__d")
    return out.where(F.col(src) != F.col(dst))


def neighbours(edges: DataFrame, name: str) -> DataFrame:
    return undirected(edges).where(F.col("src") == name).select(F.col("dst").alias("name")).distinct()


def transitive_cycles(edges: DataFrame) -> DataFrame:
    """Groups (column grp) whose definitions, edges src -> dst, contain a cycle of any length.

    Each round drops the edges whose source no edge leads to and those whose
    target leads nowhere; what remains when a round changes nothing holds a
    cycle. Rounds are staged; a chain of n edges needs n / 2 of them.
    """
    left = stage(edges.select("grp", "src", "dst").distinct())
    n = left.count()
    while n:
        ins, outs = left.select("grp", F.col("dst").alias("src")).distinct(), left.select("grp", F.col("src").alias("dst")).distinct()
        left = stage(left.join(ins, ["grp", "src"], "left_semi").join(outs, ["grp", "dst"], "left_semi").select("grp", "src", "dst"))
        now = left.count()
        if now == n:
            break
        n = now
    return left.select("grp").distinct()


def top_degree(edges: DataFrame, n: int, nodes: DataFrame | None = None) -> DataFrame:
    """The ``n`` names with the most edges; with ``nodes``, those without an edge count as 0."""
    found = degrees(edges)
    if nodes is not None:
        found = nodes.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"))
    return found.orderBy(F.desc("degree"), "name").limit(n)


def local_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between ids of a chunk as edges between names: (chunk_id, src, type, dst); those without both ends go."""
    named = nodes.groupBy("chunk_id", "id").agg(F.max("name").alias("name"))
    end = lambda c, to: named.select("chunk_id", F.col("id").alias(c), F.col("name").alias(to))
    return edges.join(end("source_id", "src"), ["chunk_id", "source_id"]).join(end("target_id", "dst"), ["chunk_id", "target_id"]).select("chunk_id", "src", "type", "dst")


def search_nodes(nodes: DataFrame, keywords: list[str], least: float = 0.3, documents: list[str] | None = None) -> DataFrame:
    """Nodes (name, document_id) whose best score for a keyword is over ``least``: name, score; of some documents only where any are named."""
    asked = [k for k in keywords if k.strip()]
    if documents:
        nodes = nodes.where(F.col("document_id").isin(list(documents)))
    if not asked:
        return nodes.select("name", F.lit(0.0).alias("score")).where(F.lit(False))
    score = F.greatest(F.lit(0.0), *[T.phrase_score(F.col("name"), F.lit(k)) for k in asked])
    return nodes.select("name", score.alias("score")).where(F.col("score") > least).groupBy("name").agg(F.max("score").alias("score"))


def search(nodes: DataFrame, edges: DataFrame, keywords: list[str], second: list[str], documents: list[str] | None = None, limit: int = 50) -> DataFrame:
    """What the graph says about keywords, as lines: seeds by score, their edges and optionally the next ones. ``nodes`` has name, document_id, aliases."""
    hops = two_hops(search_nodes(nodes, keywords, documents=documents), edges, second, limit)
    aka = nodes.groupBy(F.col("name").alias("src")).agg(F.max("aliases").alias("aliases"))
    return hops.join(aka, "src", "left").withColumn("line", T.edge_text(F.col("src"), F.col("aliases"), F.col("type"), F.col("dst"), F.col("type2"), F.col("leaf")))


def first_match(nodes: DataFrame, term: str) -> DataFrame:
    """The first node by name that holds the term, whatever its case."""
    plain = term.strip().lower()
    return nodes.where(F.lower("name").contains(plain) if plain else F.lit(False)).orderBy("name").limit(1)


def drawn(nodes: DataFrame, box: tuple[float, float, float, float], label_degree: int) -> DataFrame:
    """Nodes (x, y, degree) inside the viewport (left, top, right, bottom), and whether they are labelled."""
    left, top, right, bottom = box
    return nodes.where(F.col("x").between(left, right) & F.col("y").between(top, bottom)).withColumn("labelled", F.col("degree") > label_degree)


def shape(edges: DataFrame) -> DataFrame:
    """Number of nodes and links as one text: what tells two states of a graph apart. An empty graph is 0:0."""
    return degrees(edges).agg(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum("degree") / 2, F.lit(0.0)).cast("long").cast("string")).alias("shape"))


def duplicate_keys(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """(type, name) of the given types that occur more than once: what a uniqueness constraint would refuse."""
    return nodes.where(F.col("type").isin(labels)).groupBy("type", "name").agg(F.count("*").alias("n")).where("n > 1")


def first_in_group(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
