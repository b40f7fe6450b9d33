"""Relation graphs over the region, nation and supplier tables, written as edge lines first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans.registry import Tables, query

_EDGES = """(SELECT 'region ' || r_name || ':holds' AS src, 'CONTAINS' AS rel, 'nation ' || n_name || ':holds' AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'nation ' || n_name || ':holds', 'HAS', 'supplier ' || s_name || ':sells' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def lines(t: Tables) -> DataFrame:
    top = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.format_string("(region %s:holds) -[CONTAINS]-> (nation %s:holds)", "r_name", "n_name").alias("line"))
    low = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.format_string("  (nation %s:holds) -[HAS]-> (supplier %s:sells) ", "n_name", "s_name").alias("line"))
    return top.unionByName(low).unionByName(t.region.select(F.concat(F.lit("# "), "r_name").alias("line")))


@query(f"SELECT src, rel, dst, regexp_extract(src, '^([^:]*):', 1) AS entity, regexp_extract(src, ':(.*)$', 1) AS action FROM {_EDGES}")
def q_dag_edges(t: Tables) -> DataFrame:
    p = G.node_parts(F.col("src"))
    return G.parse_edges(lines(t)).select("src", "rel", "dst", p["entity"].alias("entity"), p["action"].alias("action"))


@query(f"SELECT DISTINCT src AS node FROM {_EDGES} WHERE src NOT IN (SELECT dst FROM {_EDGES})")
def q_dag_roots(t: Tables) -> DataFrame:
    return G.roots(G.parse_edges(lines(t)))


@query(f"SELECT DISTINCT dst AS node FROM {_EDGES} WHERE dst NOT IN (SELECT src FROM {_EDGES})")
def q_dag_leaves(t: Tables) -> DataFrame:
    return G.leaves(G.parse_edges(lines(t)))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), p AS (SELECT DISTINCT src AS last, src AS path FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, p.path || ' > ' || e.dst FROM p JOIN e ON p.last = e.src)
SELECT path FROM p WHERE last NOT IN (SELECT src FROM e)""")
def q_dag_paths(t: Tables) -> DataFrame:
    return G.paths(G.parse_edges(lines(t))).select(F.array_join("path", " > ").alias("path"))


@query(f"""WITH RECURSIVE w AS (SELECT dst, CAST(1 AS INTEGER) AS k FROM {_EDGES} UNION ALL SELECT e.dst, w.k + 1 FROM w JOIN {_EDGES} e ON w.dst = e.src)
SELECT count(*) AS n_edges, (SELECT count(*) FROM (SELECT src FROM {_EDGES} UNION SELECT dst FROM {_EDGES})) AS n_nodes, count(DISTINCT CASE WHEN rel = 'CONTAINS' THEN src END) AS n_components, (SELECT max(k) FROM w) AS longest FROM {_EDGES}""")
def q_dag_stats(t: Tables) -> DataFrame:
    e = G.parse_edges(lines(t))
    c = G.components(e).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("component").alias("n_components"))
    longest = G.depths(e).agg(F.max("depth").alias("longest"))
    return e.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(c).crossJoin(longest)


@query(f"SELECT src, string_agg('(' || src || ') -[' || rel || ']-> (' || dst || ')', chr(10) ORDER BY '(' || src || ') -[' || rel || ']-> (' || dst || ')') AS lines FROM {_EDGES} GROUP BY 1")
def q_dag_lines(t: Tables) -> DataFrame:
    return G.sorted_lines(G.parse_edges(lines(t)), "src")


@query()
def q_connected_components(t: Tables) -> DataFrame:
    """Components of the graph of all orders and the parts on their lines; too large for recursive SQL."""
    e = t.lineitem.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    node = F.col("node")
    return G.components(e).select(F.when(node % 2 == 0, "order").otherwise("part").alias("kind"), F.shiftright(node, 1).alias("key"), "component")
