"""Entity resolution: alias registry, fuzzy leader clusters, merge registry and its provenance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import blocked, indel_ratios, plain_similarity, sorted_words

GRAM = 3


def resolve_aliases(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Nodes with ``canonical`` and ``new_id``: exact lookup of the normalised name in registry(alias, canonical); of several canonicals the greatest."""
    keyed = nodes.withColumn("__key", T.alias_key(F.col("name")))
    reg = registry.groupBy(F.col("alias").alias("__key")).agg(F.max("canonical").alias("__c"))
    out = keyed.join(reg, "__key", "left").withColumn("canonical", F.coalesce("__c", "name"))
    return out.withColumn("new_id", T.slug(F.col("canonical"))).drop("__key", "__c")


def _grams(text: Column) -> Column:
    """Distinct (gram, how often before) pairs: shared ones count what two texts have in common."""
    n = F.length(text) - (GRAM - 1)
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat_ws("#", g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))


def fuzzy_aliases(nodes: DataFrame, registry: DataFrame, document: str, least: float = 95.0) -> DataFrame:
    """Nodes (document, name) with ``canonical``, ``score`` and ``new_id``: their own document's alias, exact, else the best of at least ``least``.

    Similarity is the indel ratio of normalised names; ties take the smaller
    alias. Instead of all pairs only those are compared that share as many
    three-letter pieces as two names of that similarity must: an edit changes
    three pieces at most. Names too short for that bound match exactly only,
    which at 95 loses nothing.
    """
    if least < 90:
        raise ValueError("the bound on shared pieces needs a similarity of 90 at least")
    keyed = nodes.select(document, "name").distinct().withColumn("key", T.alias_key(F.col("name")))
    reg = registry.select(F.col(document), T.alias_key(F.col("alias")).alias("alias"), "canonical").groupBy(document, "alias").agg(F.max("canonical").alias("canonical"))
    exact = keyed.join(reg.withColumnRenamed("alias", "key"), [document, "key"]).select(document, "name", "canonical", F.lit(100.0).alias("score"))
    rest = keyed.join(exact.select(document, "name"), [document, "name"], "left_anti")
    left = rest.select(document, "name", "key", F.explode(_grams(F.col("key"))).alias("gram"))
    right = reg.select(document, "alias", "canonical", F.explode(_grams(F.col("alias"))).alias("gram"))
    shared = left.join(right, [document, "gram"]).groupBy(document, "name", "key", "alias", "canonical").agg(F.count("*").alias("shared"))
    edits = F.floor((1 - least / 100) * (F.length("key") + F.length("alias")))
    able = shared.where(F.col("shared") >= F.greatest(F.length("key"), F.length("alias")) - (GRAM - 1) - GRAM * edits)
    scored = able.withColumn("score", plain_similarity(F.col("key"), F.col("alias"))).where(F.col("score") >= least)
    best = scored.groupBy(document, "name").agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), F.col("alias"))).alias("b")).select(document, "name", "b.canonical", "b.score")
    found = exact.unionByName(best)
    out = nodes.join(found, [document, "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))
    return out.withColumn("new_id", T.slug(F.col("canonical")))


def merge_alias_lists(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old list and the members of the new one that it lacks, each once, in order."""
    o, n = old.select(key, F.col("aliases").alias("__o")), new.select(key, F.col("aliases").alias("__n"))
    empty = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("__o", empty), F.coalesce("__n", empty)))
    return o.join(n, key, "full_outer").select(key, both.alias("aliases"))


def names_by_type(nodes: DataFrame, document: str, order: str, types: list[str]) -> DataFrame:
    """Names of the wanted types, each once a document, with its last type and the place where it came first."""
    wanted = nodes.where(F.col("type").isin(types))
    return wanted.groupBy(document, "name").agg(F.max_by("type", order).alias("type"), F.min(order).alias(order))


def similar_pairs(names: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) with i < j of all names whose similarity is at least ``least``; lengths rule out most pairs."""
    plain = [sorted_words(x) for x in names]
    size = np.array([len(x) for x in plain])
    out: list[tuple[np.ndarray, ...]] = []
    for i in range(len(plain) - 1):
        j = np.arange(i + 1, len(plain))
        j = j[200 * np.minimum(size[i], size[j]) >= least * (size[i] + size[j])]
        ratio = indel_ratios([plain[i]] * len(j), [plain[k] for k in j])
        ok = ratio >= least
        out.append((np.full(int(ok.sum()), i), j[ok], ratio[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def leader_clusters(names: DataFrame, group: str, person: str, order: str | None = None, join_at: float = 60, auto_at: float = 85) -> DataFrame:
    """Clusters of each group's names: group, name, canonical, method (single, ambiguous, or auto from ``auto_at`` on).

    From the table of similar pairs, names in the order of arrival (column
    ``order``, by name where there is none) that no cluster has yet lead one
    with all later free names like them. Persons that the guard tells apart
    don't meet; where it tells two members apart only the leader is settled.
    The longest name is the canonical one, the earliest of several. Groups are
    single documents, so that one call holds a document's names.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "name"] if order else ["name"], kind="stable").drop_duplicates("name")
        labels, people = pdf["name"].tolist(), pdf[person].to_numpy(bool)
        n = len(labels)
        i, j, ratio = similar_pairs(labels, join_at)
        like = np.zeros((n, n))
        like[i, j] = like[j, i] = ratio
        apart = lambda a, b: bool(people[a] and people[b] and blocked(labels[a], labels[b]))
        cluster = np.full(n, -1)
        for lead in np.flatnonzero(cluster < 0):
            if cluster[lead] >= 0:
                continue
            cluster[lead] = lead
            joins = [k for k in np.flatnonzero((like[lead] > 0) & (cluster < 0)) if k > lead and not apart(lead, k)]
            if not any(apart(a, b) for at, a in enumerate(joins) for b in joins[at + 1 :]):
                cluster[joins] = lead
        rows = []
        for lead in np.unique(cluster):
            own = np.flatnonzero(cluster == lead)
            head = max(own, key=lambda k: (len(labels[k]), -k))
            best = like[np.ix_(own, own)].max()
            kind = "single" if len(own) == 1 else "auto" if best >= auto_at else "ambiguous"
            rows += [(labels[k], labels[head], kind) for k in own]
        out = pd.DataFrame(rows, columns=["name", "canonical", "method"])
        out.insert(0, group, pdf[group].iloc[0])
        return out

    kind = dict(names.dtypes)[group]
    return names.groupBy(group).applyInPandas(run, f"{group} {kind}, name string, canonical string, method string")


def merge_registries(*registries: DataFrame) -> DataFrame:
    """Registries (name, canonical) as one: a later one wins over an earlier one; ``method`` numbers them from 0."""
    every = [r.select("name", "canonical", F.lit(i).alias("method")) for i, r in enumerate(registries)]
    union = every[0]
    for r in every[1:]:
        union = union.unionByName(r)
    return union.groupBy("name").agg(F.max_by(F.struct("canonical", "method"), F.struct("method", "canonical")).alias("x")).select("name", "x.canonical", "x.method")


def apply_registry(nodes: DataFrame, edges: DataFrame, registry: DataFrame, alias_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Graphs of chunks through a registry (name, canonical): nodes (chunk_id, pos, id, type, name) and edges (chunk_id, source_id, type, target_id).

    Nodes are renamed and get new ids, each id once a chunk, the first by
    ``pos``; nodes of ``alias_types`` carry the names that their canonical
    absorbed. Edges follow; those without both ends in their chunk and loops go.
    """
    absorbed = registry.where("name <> canonical").groupBy("canonical").agg(F.array_sort(F.collect_set("name")).alias("absorbed"))
    renamed = nodes.join(registry.select("name", "canonical"), "name", "left").withColumn("new_name", F.coalesce("canonical", "name")).withColumn("new_id", T.slug(F.coalesce("canonical", "name"))).select("chunk_id", "pos", "id", "type", "new_name", "new_id")
    kept = renamed.groupBy("chunk_id", "new_id").agg(F.min_by(F.struct("type", "new_name", "pos"), "pos").alias("n")).select("chunk_id", F.col("new_id").alias("id"), "n.type", F.col("n.new_name").alias("name"), "n.pos")
    kept = kept.join(absorbed.withColumnRenamed("canonical", "name"), "name", "left").withColumn("aliases", F.when(F.col("type").isin(alias_types), F.col("absorbed"))).drop("absorbed")
    moved = renamed.groupBy("chunk_id", "id").agg(F.max_by("new_id", "pos").alias("new_id"))
    end = lambda c: moved.select("chunk_id", F.col("id").alias(c), F.col("new_id").alias(f"__{c}"))
    mapped = edges.join(end("source_id"), ["chunk_id", "source_id"], "left").join(end("target_id"), ["chunk_id", "target_id"], "left")
    mapped = mapped.select("chunk_id", F.coalesce("__source_id", "source_id").alias("source_id"), "type", F.coalesce("__target_id", "target_id").alias("target_id"))
    ids = kept.select("chunk_id", "id")
    ok = mapped.where("source_id <> target_id").join(ids.withColumnRenamed("id", "source_id"), ["chunk_id", "source_id"], "left_semi").join(ids.withColumnRenamed("id", "target_id"), ["chunk_id", "target_id"], "left_semi")
    return kept, ok


def remap_edge_types(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Edge types through a registry (type, canonical); types without an entry stay."""
    reg = registry.groupBy("type").agg(F.max("canonical").alias("__c"))
    return edges.join(reg, "type", "left").withColumn("type", F.coalesce("__c", "type")).drop("__c")


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.select("type").distinct()


def totals(nodes_before: DataFrame, edges_before: DataFrame, nodes_after: DataFrame, edges_after: DataFrame) -> DataFrame:
    """One row: numbers of nodes and edges before and after resolution."""
    one = [df.agg(F.count("*").alias(name)) for df, name in ((nodes_before, "nodes_before"), (edges_before, "edges_before"), (nodes_after, "nodes_after"), (edges_after, "edges_after"))]
    out = one[0]
    for x in one[1:]:
        out = out.join(F.broadcast(x))  # one row each
    return out


def provenance(registry: DataFrame, score: float, method: str = "fuzzy", nodes: DataFrame | None = None) -> DataFrame:
    """One row for each canonical name, with the names it absorbed as evidence; with ``nodes``, only those that are nodes."""
    named = registry.where("name <> canonical")
    if nodes is not None:
        named = named.join(nodes.select(F.col("name").alias("canonical")).distinct(), "canonical", "left_semi")
    return named.groupBy("canonical").agg(F.array_sort(F.collect_set("name")).alias("evidence")).select("canonical", "evidence", F.size("evidence").alias("n"), F.lit(score).alias("score"), F.lit(method).alias("method"))
