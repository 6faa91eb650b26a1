"""Queries on the property graph of the business tables, and on entity names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import entity as E
from ..operators import graph as G
from ..sources.tables import table

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


EDGES = """e AS (SELECT n_name AS src, 'IN_REGION' AS type, r_name AS dst, 'nation' AS document_id FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT c_name, 'IN_NATION', n_name, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, 'IN_NATION', n_name, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('Order#', o_orderkey), 'PLACED_BY', c_name, 'orders' FROM orders JOIN customer ON o_custkey = c_custkey),
deg AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM e UNION ALL SELECT dst FROM e) GROUP BY name)"""
UNDIRECTED = "u AS (SELECT src, type, dst FROM e UNION ALL SELECT dst, type, src FROM e)"


def _edges(spark, sf) -> DataFrame:
    n, r, c, s, o = (table(spark, sf, x) for x in ("nation", "region", "customer", "supplier", "orders"))
    row = lambda df, src, kind, dst, doc: df.select(F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst"), F.lit(doc).alias("document_id"))
    parts = [
        row(n.join(r, n.n_regionkey == r.r_regionkey), "n_name", "IN_REGION", "r_name", "nation"),
        row(c.join(n, c.c_nationkey == n.n_nationkey), "c_name", "IN_NATION", "n_name", "customer"),
        row(s.join(n, s.s_nationkey == n.n_nationkey), "s_name", "IN_NATION", "n_name", "supplier"),
        row(o.join(c, o.o_custkey == c.c_custkey).withColumn("o_name", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))), "o_name", "PLACED_BY", "c_name", "orders"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""SELECT type, name, min(document_id) AS created_by, max(document_id) AS document_id FROM (SELECT 'Nation' AS type, n_name AS name, 'nation' AS document_id FROM nation
UNION ALL SELECT 'Nation', n_name, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'Nation', n_name, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'Customer', c_name, 'orders' FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'Customer', c_name, 'customer' FROM customer) GROUP BY type, name""")
def graph_upsert_nodes(spark, sf):
    n, c, s, o = (table(spark, sf, x) for x in ("nation", "customer", "supplier", "orders"))
    row = lambda df, kind, name, doc: df.select(F.lit(kind).alias("type"), F.col(name).alias("name"), F.lit(doc).alias("document_id"))
    parts = row(n, "Nation", "n_name", "nation").union(row(s.join(n, s.s_nationkey == n.n_nationkey), "Nation", "n_name", "supplier")).union(row(c.join(n, c.c_nationkey == n.n_nationkey), "Nation", "n_name", "customer"))
    parts = parts.union(row(o.join(c, o.o_custkey == c.c_custkey), "Customer", "c_name", "orders")).union(row(c, "Customer", "c_name", "customer"))
    return G.upsert_nodes(parts)


@query(f"WITH {EDGES} SELECT src, type, dst, min(document_id) AS document_id FROM e WHERE src IN (SELECT n_name FROM nation UNION SELECT c_name FROM customer) AND dst IN (SELECT n_name FROM nation UNION SELECT c_name FROM customer) GROUP BY src, type, dst")
def graph_upsert_edges(spark, sf):
    """Only edges whose both ends are known nodes: nations and customers."""
    nodes = table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf, "customer").select("c_name"))
    return G.upsert_edges(_edges(spark, sf), nodes)


@query(f"""WITH {EDGES}, {UNDIRECTED} SELECT src, type, dst, type2, leaf FROM (SELECT DISTINCT a.src, a.type, a.dst, b.type AS type2, b.dst AS leaf FROM u a LEFT JOIN (SELECT * FROM u WHERE type IN ('IN_REGION', 'PLACED_BY')) b ON a.dst = b.src
WHERE a.src IN (SELECT s_name FROM supplier WHERE s_acctbal > 9000 UNION SELECT r_name FROM region)) ORDER BY src, type, dst, type2 NULLS FIRST, leaf NULLS FIRST LIMIT 50""")
def subgraph_two_hop(spark, sf):
    seeds = table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_name").alias("name")).union(table(spark, sf, "region").select("r_name"))
    return G.two_hops(seeds, _edges(spark, sf), ["IN_REGION", "PLACED_BY"], 50)


@query(f"WITH {EDGES} SELECT name, degree FROM deg ORDER BY degree DESC, name LIMIT 6")
def degree_top6(spark, sf):
    return G.top_degree(_edges(spark, sf), 6)


@query(f"WITH {EDGES} SELECT CASE WHEN type = 'IN_REGION' THEN 'UNKNOWN' ELSE type END AS relation, count(*) AS n FROM e GROUP BY 1")
def relation_histogram(spark, sf):
    return G.relation_histogram(_edges(spark, sf).withColumn("type", F.when(F.col("type") == "IN_REGION", "").otherwise(F.col("type"))))


@query(f"WITH {EDGES} SELECT src, type, dst, (SELECT count(*) FROM e) AS total FROM (SELECT src, type, dst FROM e ORDER BY src, type, dst LIMIT 1000)")
def viz_limit(spark, sf):
    return G.viz(_edges(spark, sf), 1000)


@query(f"""WITH {EDGES}, n AS (SELECT name, CASE WHEN name LIKE 'Order#%' THEN 'orders' WHEN name IN (SELECT c_name FROM customer) THEN 'customer' WHEN name IN (SELECT s_name FROM supplier) THEN 'supplier' ELSE 'nation' END AS document_id FROM deg),
k AS (SELECT * FROM e WHERE document_id <> 'orders') SELECT name, document_id FROM n WHERE NOT (document_id = 'orders' AND name NOT IN (SELECT src FROM k UNION SELECT dst FROM k))""")
def delete_document_graph(spark, sf):
    e = _edges(spark, sf)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("name"), F.col("document_id")), F.struct(F.col("dst").alias("name"), F.when(F.col("document_id") == "orders", "customer").otherwise("nation").alias("document_id")))).alias("x")).select("x.*").distinct()
    nodes, _ = G.delete_document(ends, e, F.lit("orders"))
    return nodes


@query(f"WITH {EDGES}, {UNDIRECTED} SELECT DISTINCT dst AS name FROM u WHERE src = (SELECT min(r_name) FROM region)")
def neighbor_highlight(spark, sf):
    first = table(spark, sf, "region").agg(F.min("r_name")).first()[0]
    return G.neighbours(_edges(spark, sf), first)


@query(f"WITH {EDGES} SELECT count(DISTINCT document_id) AS n_documents, count(*) AS n_edges, (SELECT count(*) FROM deg) AS n_nodes FROM e")
def distinct_docs(spark, sf):
    e = _edges(spark, sf)
    nodes = G.degrees(e).agg(F.count("*").alias("n_nodes"))
    return e.agg(F.count_distinct("document_id").alias("n_documents"), F.count("*").alias("n_edges")).join(F.broadcast(nodes))  # one row each


@query(f"WITH {EDGES} SELECT name, degree, round(greatest(2.0, log2(degree + 1) * 4), 6) AS size, CASE WHEN degree >= 8 THEN 'hub' WHEN degree >= 3 THEN 'medium' WHEN degree <= 1 THEN 'leaf' ELSE 'minor' END AS class FROM deg")
def node_size_tier(spark, sf):
    d = F.col("degree")
    return G.degrees(_edges(spark, sf)).select("name", "degree", F.round(T.node_size(d), 6).alias("size"), T.node_class(d).alias("class"))


ALIAS = "(SELECT concat('the ', lower(n_name)) AS alias, concat(n_name, ' Federation') AS canonical FROM nation WHERE n_nationkey % 2 = 0)"


@query(f"""SELECT s_suppkey, coalesce(canonical, n_name) AS canonical, regexp_replace(translate(lower(coalesce(canonical, n_name)), ' -', '__'), '[^a-z0-9_]', '', 'g') AS new_id
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN {ALIAS} ON regexp_replace(alias, '^the ', '') = lower(trim(n_name))""")
def alias_resolve_exact(spark, sf):
    n = table(spark, sf, "nation")
    nodes = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("name"))
    reg = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("the "), F.lower("n_name")).alias("a"), F.concat("n_name", F.lit(" Federation")).alias("canonical")).select(T.alias_key(F.col("a")).alias("alias"), "canonical")
    return E.resolve_aliases(nodes, reg).select("s_suppkey", "canonical", "new_id")


SLUG = "regexp_replace(translate(lower({}), ' -', '__'), '[^a-z0-9_]', '', 'g')"
GRAPHS = f"""n AS (SELECT p_brand AS chunk_id, p_partkey AS pos, concat('n', p_partkey) AS id, CASE p_partkey % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' ELSE 'Product' END AS type, p_name AS name, split_part(p_name, ' ', 1) AS canonical FROM part),
r AS (SELECT DISTINCT canonical, name FROM n), m AS (SELECT chunk_id, {SLUG.format('canonical')} AS id, arg_min(type, pos) AS type, arg_min(canonical, pos) AS name, min(pos) AS pos FROM n GROUP BY 1, 2)"""


def _graphs(spark, sf):
    """Parts as nodes of their brand's graph, each with an edge to the next one, or now and then to a node that isn't there."""
    p = table(spark, sf, "part")
    nodes = p.select(F.col("p_brand").alias("chunk_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' ELSE 'Product' END").alias("type"), F.col("p_name").alias("name"))
    next_ = F.lead("id").over(Window.partitionBy("chunk_id").orderBy("pos"))
    edges = nodes.withColumn("next", F.when(F.col("pos") % 11 == 0, "missing").otherwise(next_)).where("next IS NOT NULL").select("chunk_id", F.col("id").alias("source_id"), F.lit("NEXT").alias("type"), F.col("next").alias("target_id"))
    registry = nodes.select("name", F.split_part("name", F.lit(" "), F.lit(1)).alias("canonical")).distinct()
    return nodes, edges, registry


@query(f"""WITH {GRAPHS} SELECT chunk_id, id, type, name, CASE WHEN type IN ('Person', 'Organization') THEN (SELECT list(r.name ORDER BY r.name) FROM r WHERE r.canonical = m.name AND r.name <> r.canonical) END AS aliases FROM m""")
def registry_apply_nodes(spark, sf):
    """Nodes renamed by the registry, each new id once a chunk, with the names that were absorbed."""
    nodes, edges, registry = _graphs(spark, sf)
    return E.apply_registry(nodes, edges, registry, ["Person", "Organization"])[0].select("chunk_id", "id", "type", "name", "aliases")


@query(f"""WITH {GRAPHS}, e AS (SELECT chunk_id, id AS a, CASE WHEN pos % 11 = 0 THEN 'missing' ELSE lead(id) OVER (PARTITION BY chunk_id ORDER BY pos) END AS b FROM n)
SELECT e.chunk_id, {SLUG.format('x.canonical')} AS source_id, {SLUG.format('y.canonical')} AS target_id, count(*) AS n FROM e JOIN n x ON e.a = x.id JOIN n y ON e.b = y.id WHERE {SLUG.format('x.canonical')} <> {SLUG.format('y.canonical')} GROUP BY 1, 2, 3""")
def registry_apply_remap(spark, sf):
    """Edges between the new ids; dangling ones and loops go."""
    return E.apply_registry(*_graphs(spark, sf), ["Person", "Organization"])[1].groupBy("chunk_id", "source_id", "target_id").agg(F.count("*").alias("n"))


@query(f"""WITH {GRAPHS}, e AS (SELECT chunk_id, id AS a, CASE WHEN pos % 11 = 0 THEN 'missing' ELSE lead(id) OVER (PARTITION BY chunk_id ORDER BY pos) END AS b FROM n)
SELECT (SELECT count(*) FROM n) AS nodes_before, (SELECT count(*) FROM e WHERE b IS NOT NULL) AS edges_before, (SELECT count(*) FROM m) AS nodes_after,
(SELECT count(*) FROM e JOIN n x ON e.a = x.id JOIN n y ON e.b = y.id WHERE {SLUG.format('x.canonical')} <> {SLUG.format('y.canonical')}) AS edges_after""")
def resolution_totals(spark, sf):
    nodes, edges, registry = _graphs(spark, sf)
    return E.totals(nodes, edges, *E.apply_registry(nodes, edges, registry, ["Person"]))


@query(f"WITH {GRAPHS} SELECT x.chunk_id, x.name AS src, y.name AS dst FROM (SELECT chunk_id, id AS a, CASE WHEN pos % 11 = 0 THEN 'missing' ELSE lead(id) OVER (PARTITION BY chunk_id ORDER BY pos) END AS b FROM n) e JOIN n x ON e.a = x.id JOIN n y ON e.b = y.id")
def local_edge_names(spark, sf):
    """Edges between ids of a chunk as edges between names."""
    nodes, edges, _ = _graphs(spark, sf)
    return G.local_edges(nodes, edges).select("chunk_id", "src", "dst")


@query("SELECT p_brand, p_name AS name, arg_max(type, p_partkey) AS type, min(p_partkey) AS p_partkey FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' ELSE 'Product' END AS type FROM part) WHERE type <> 'Product' GROUP BY 1, 2")
def names_by_type(spark, sf):
    nodes = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_name").alias("name"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' ELSE 'Product' END").alias("type"))
    return E.names_by_type(nodes, "p_brand", "p_partkey", ["Person", "Organization"])


@query("""WITH r AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS canonical, 0 AS method FROM part UNION ALL SELECT DISTINCT p_name, split_part(p_name, ' ', 2), 1 FROM part WHERE p_name LIKE 's%' OR p_name LIKE 'b%')
SELECT name, arg_max(canonical, method) AS canonical, max(method) AS method FROM r GROUP BY name""")
def registry_merge(spark, sf):
    """Two registries as one: the later one wins."""
    p = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    part = lambda i: F.split_part("name", F.lit(" "), F.lit(i)).alias("canonical")
    return E.merge_registries(p.select("name", part(1)), p.where("name LIKE 's%' OR name LIKE 'b%'").select("name", part(2)))


@query(f"WITH {EDGES} SELECT CASE WHEN type = 'IN_REGION' THEN 'LOCATED_IN' WHEN type = 'IN_NATION' THEN 'LOCATED_IN' ELSE type END AS type, count(*) AS n FROM e GROUP BY 1")
def edge_type_remap(spark, sf):
    """Synonyms of edge types as one type."""
    e = _edges(spark, sf)
    registry = E.edge_types(e).where("type LIKE 'IN%'").withColumn("canonical", F.lit("LOCATED_IN"))
    return E.remap_edge_types(e, registry).groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT p_name, list(DISTINCT p_brand ORDER BY p_brand) AS l FROM part GROUP BY p_name), n AS (SELECT p_name, list(DISTINCT p_type ORDER BY p_type) AS l FROM part GROUP BY p_name)
SELECT p_name, list_concat(o.l, n.l) AS aliases FROM o JOIN n USING (p_name)""")
def alias_list_merge(spark, sf):
    p = table(spark, sf, "part")
    lists = lambda c: p.groupBy("p_name").agg(F.array_sort(F.collect_set(c)).alias("aliases"))
    new = lists("p_type").join(lists("p_brand").withColumnRenamed("aliases", "b"), "p_name").select("p_name", F.concat("b", "aliases").alias("aliases"))
    return E.merge_alias_lists(lists("p_brand"), new, "p_name")


@query("""SELECT s_suppkey, concat(n_name, ' ', 'Lee') AS a, concat(n_name, ' ', CASE WHEN s_suppkey % 2 = 0 THEN 'Lee' ELSE 'Ray' END) AS b, s_suppkey % 2 = 1 AS is_blocked
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def name_guard(spark, sf):
    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    a, b = F.concat("n_name", F.lit(" Lee")), F.concat("n_name", F.when(F.col("s_suppkey") % 2 == 0, " Lee").otherwise(" Ray"))
    return j.select("s_suppkey", a.alias("a"), b.alias("b")).withColumn("is_blocked", N.name_guard(F.col("a"), F.col("b")))


@query(None)
def fuzzy_clusters(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_brand").alias("document"), F.col("p_name").alias("name"), F.lit(False).alias("person")).distinct()
    return E.leader_clusters(names, "document", "person")


@query("""SELECT split_part(p_name, ' ', 1) AS canonical, list(DISTINCT p_name ORDER BY p_name) AS evidence, count(DISTINCT p_name) AS n, 85.0::DOUBLE AS score, 'fuzzy' AS method FROM part GROUP BY 1""")
def merge_provenance(spark, sf):
    reg = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("canonical")).distinct()
    return E.provenance(reg, 85.0).withColumn("n", F.col("n").cast("long"))


@query("""WITH n AS (SELECT o_custkey AS chunk_id, concat('o', o_orderkey) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Event' WHEN 1 THEN 'Gadget' ELSE 'Product' END AS type FROM orders),
ed AS (SELECT o_custkey AS chunk_id, concat('o', o_orderkey) AS source_id, concat('o', o_orderkey + o_orderkey % 2) AS target_id FROM orders)
SELECT count(*) AS n_edges, (SELECT count(*) FROM n WHERE type = 'Gadget') AS n_concepts FROM ed SEMI JOIN n ON ed.chunk_id = n.chunk_id AND ed.target_id = n.id""")
def graph_validate(spark, sf):
    o = table(spark, sf, "orders")
    nodes = o.select(F.col("o_custkey").alias("chunk_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Event' WHEN 1 THEN 'Gadget' ELSE 'Product' END").alias("type"))
    edges = o.select(F.col("o_custkey").alias("chunk_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("o"), (F.col("o_orderkey") + F.col("o_orderkey") % 2).cast("string")).alias("target_id"))
    n, e = G.validate(nodes, edges, ["Person", "Organization", "Location", "Technology", "Product", "Event", "Concept", "Document", "Law", "Date", "Amount"])
    return e.agg(F.count("*").alias("n_edges")).join(F.broadcast(n.agg(F.count_if(F.col("type") == "Concept").alias("n_concepts"))))  # one row each


@query("""WITH x AS (SELECT 'Customer' AS type, c_name AS name, concat('doc', o_orderkey % 7) AS document_id, o_orderkey AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT 'Customer' AS type, c_name AS name, 'base' AS created_by, 'base' AS document_id, 'old' AS status FROM customer WHERE c_custkey % 2 = 0)
SELECT type, name, coalesce(max(created_by), arg_min(x_doc, t)) AS created_by, coalesce(arg_max(x_doc, t), max(c_doc)) AS document_id, coalesce(arg_max(x_status, t) FILTER (x_status IS NOT NULL), max(c_status)) AS status
FROM (SELECT type, name, NULL AS created_by, NULL AS c_doc, NULL AS c_status, document_id AS x_doc, t, status AS x_status FROM x UNION ALL SELECT type, name, created_by, document_id, status, NULL, NULL, NULL FROM c) GROUP BY type, name""")
def graph_upsert_arrival(spark, sf):
    """Nodes merged into a table that is there: creators stay, the last document to arrive owns, properties keep their last value."""
    c = table(spark, sf, "customer")
    new = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("Customer").alias("type"), F.col("c_name").alias("name"), F.concat(F.lit("doc"), (F.col("o_orderkey") % 7).cast("string")).alias("document_id"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("status"))
    current = c.where("c_custkey % 2 = 0").select(F.lit("Customer").alias("type"), F.col("c_name").alias("name"), F.lit("base").alias("created_by"), F.lit("base").alias("document_id"), F.lit("old").alias("status"))
    return G.upsert_nodes(new, "at", current, ["status"])


WORDS_OF = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
KEYWORDS = ["Supplier#000000001", "ASIA", "united", "supplier", "  "]


def _seed_score(name: str) -> str:
    n = WORDS_OF.format(name)
    one = [f"CASE WHEN contains(' ' || {n} || ' ', ' ' || {WORDS_OF.format(repr(k))} || ' ') THEN len(string_split({WORDS_OF.format(repr(k))}, ' '))::DOUBLE / len(string_split({n}, ' ')) ELSE 0 END" for k in KEYWORDS if k.strip()]
    return f"greatest({', '.join(one)})"


@query(f"""WITH {EDGES}, {UNDIRECTED}, seed AS (SELECT name FROM (SELECT DISTINCT name FROM deg) WHERE {_seed_score('name')} > 0.3 AND name NOT LIKE 'Order#%'),
h AS (SELECT src, type, dst, type2, leaf FROM (SELECT DISTINCT a.src, a.type, a.dst, b.type AS type2, b.dst AS leaf FROM u a LEFT JOIN (SELECT * FROM u WHERE type IN ('IN_REGION', 'PLACED_BY')) b ON a.dst = b.src WHERE a.src IN (SELECT name FROM seed)) ORDER BY src, type, dst, type2 NULLS FIRST, leaf NULLS FIRST LIMIT 50)
SELECT src, '(' || src || CASE WHEN length(src) < 8 THEN ' (aka: the ' || src || ', ' || lower(src) || ')' ELSE '' END || ') -[' || type || ']-> (' || dst || ')' || CASE WHEN leaf IS NOT NULL THEN chr(10) || '  └─> [' || type2 || '] --> (' || leaf || ')' ELSE '' END AS line FROM h""")
def graph_search(spark, sf):
    """Lines on the edges around nodes that match some keywords, those of orders' documents left out."""
    e = _edges(spark, sf)
    nodes = G.degrees(e).select("name", F.when(F.col("name").startswith("Order#"), "orders").otherwise("people").alias("document_id"), F.when(F.length("name") < 8, F.array(F.concat(F.lit("the "), "name"), F.lower("name"))).alias("aliases"))
    return G.search(nodes, e, KEYWORDS, ["IN_REGION", "PLACED_BY"], ["people"]).select("src", "line")


@query(f"WITH {EDGES}, n AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT 'lonely') SELECT name, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg USING (name) ORDER BY 2 DESC, 1 LIMIT 40")
def top_nodes_with_zero(spark, sf):
    """Nodes by degree, those without an edge too."""
    nodes = table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf, "region").select("r_name")).union(spark.createDataFrame([("lonely",)], "name string"))
    return G.top_degree(_edges(spark, sf), 40, nodes)


@query("SELECT min(c_name) AS name FROM customer WHERE contains(lower(c_name), 'er#00000001')")
def node_search_first(spark, sf):
    return G.first_match(table(spark, sf, "customer").select(F.col("c_name").alias("name")), "  ER#00000001 ")


@query("SELECT p_partkey, p_size > 20 AS labelled FROM part WHERE (p_partkey * 37) % 1000 BETWEEN 100 AND 700 AND (p_partkey * 91) % 1000 BETWEEN 50 AND 600")
def label_gate(spark, sf):
    """Nodes in the viewport, and whether they are large enough for a label."""
    nodes = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 1000).alias("x"), ((F.col("p_partkey") * 91) % 1000).alias("y"), F.col("p_size").alias("degree"))
    return G.drawn(nodes, (100, 50, 700, 600), 20).select("p_partkey", "labelled")


@query(f"""WITH {EDGES}, s AS (SELECT type, count(DISTINCT name) AS nodes, count(*) // 2 AS links FROM (SELECT type, src AS name FROM e UNION ALL SELECT type, dst FROM e) GROUP BY type)
SELECT type, concat(nodes, ':', links) AS shape, CASE WHEN nodes <= 500 THEN 'small' WHEN nodes <= 2000 THEN 'medium' ELSE 'large' END AS tier, type <> 'IN_REGION' AS changed FROM s""")
def graph_change(spark, sf):
    """The shape of each kind of edges' graph, how much of it is drawn, and whether it differs from the first's."""
    e = _edges(spark, sf)
    parts = [G.shape(e.where(F.col("type") == t)).withColumn("type", F.lit(t)) for t in ("IN_REGION", "IN_NATION", "PLACED_BY")]
    first = G.shape(e.where("type = 'IN_REGION'")).select(F.col("shape").alias("was"))
    every = parts[0].union(parts[1]).union(parts[2]).join(F.broadcast(first))  # one row
    return every.select("type", "shape", T.graph_tier(F.split_part("shape", F.lit(":"), F.lit(1)).cast("long")).alias("tier"), (F.col("shape") != F.col("was")).alias("changed"))


@query("SELECT 'Part' AS type, p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return G.duplicate_keys(table(spark, sf, "part").select(F.lit("Part").alias("type"), F.col("p_name").alias("name")), ["Part"])


@query("""WITH n AS (SELECT s_suppkey, s_nationkey, concat(n_name, ' trading company ', s_nationkey) AS full_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN concat('The ', full_name) WHEN 1 THEN concat(left(full_name, 4), substr(full_name, 6)) WHEN 2 THEN concat('Old ', full_name, ' Ltd') ELSE upper(full_name) END AS name FROM n)
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 2 THEN name ELSE concat('Canon ', s_nationkey) END AS canonical FROM x""")
def alias_resolve_fuzzy(spark, sf):
    """Names with a letter missing find their alias; names with more than that don't."""
    n = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("full_name", F.concat("n_name", F.lit(" trading company "), F.col("s_nationkey").cast("string")))
    name = F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat('The ', full_name) WHEN 1 THEN concat(left(full_name, 4), substr(full_name, 6)) WHEN 2 THEN concat('Old ', full_name, ' Ltd') ELSE upper(full_name) END")
    registry = n.select(F.lit(1).alias("document"), F.col("full_name").alias("alias"), F.concat(F.lit("Canon "), F.col("s_nationkey").cast("string")).alias("canonical")).distinct()
    return E.fuzzy_aliases(n.select(F.lit(1).alias("document"), "s_suppkey", name.alias("name")), registry, "document").select("s_suppkey", "canonical")
