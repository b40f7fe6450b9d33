"""Relation graphs: parsing edge lines, roots, leaves, paths, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.allocation import cut_lineage
from tidemark.plans.scratch import drop_files, materialize

# Fixed value: the form of an edge line.
EDGE = r"^\(([^()]+)\)\s*-\[([^\]]+)\]->\s*\(([^()]+)\)$"
NODE = r"^\(([^()]+)\)$"

# Headers of the section that holds the graph, in order of priority, and the header that ends it.
SECTION_HEADERS = (
    r"#{2,3}\s*최종\s*DAG",
    r"#{2,3}\s*4\.\s*수정된\s*DAG",
    r"#{2,3}\s*수정된\s*DAG",
    r"#{2,3}\s*2\.\s*추출된\s*DAG",
    r"#{2,3}\s*DAG",
    r"추출된\s*DAG",
    r"2\.\s*추출된\s*DAG",
)
SECTION_END = r"^#{2,3}\s*[3-9]\."


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _until(lines: Column, at: Column) -> Column:
    """The lines before position at; all of them if it is 0."""
    return F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)


def _header_rank(line: Column) -> Column:
    """The place in SECTION_HEADERS of the first header that the line has; null if it has none."""
    rank = F.lit(None).cast("int")
    for k in reversed(range(len(SECTION_HEADERS))):
        rank = F.when(line.rlike(f"(?i){SECTION_HEADERS[k]}"), k).otherwise(rank)
    return F.when(line.rlike("(?i)DAG"), rank)


def section_lines(text: Column) -> Column:
    """The lines of a text's graph section in their order, trimmed, blank ones left out.

    The first header of SECTION_HEADERS that any line has decides. A fence as the next
    line of text, at most three lines on, bounds the section; else the next numbered
    header from 3 on does, or the end. Without a header all edge, node and comment
    lines count. Null text gives null.
    """

    def fenced(rest: Column) -> Column:
        inner = F.slice(rest, F.array_position(rest, "```") + 1, F.size(rest) + 1)
        return _let(inner, lambda x: _until(x, F.array_position(x, "```")))

    def body(rest: Column) -> Column:
        fence = F.get(F.filter(F.slice(rest, 1, 3), lambda x: x != ""), F.lit(0)) == "```"
        end = F.array_position(F.transform(rest, lambda x: x.rlike(SECTION_END)), True)
        return F.when(fence, fenced(rest)).otherwise(_let(end, lambda at: _until(rest, at)))

    def section(lines: Column, head: Column) -> Column:
        loose = F.filter(lines, lambda x: x.rlike(EDGE) | x.rlike(NODE) | x.startswith("#"))
        return F.when(head > 0, _let(F.slice(lines, head + 1, F.size(lines) + 1), body)).otherwise(loose)

    first = lambda ranks: F.coalesce(F.array_position(ranks, F.array_min(ranks)), F.lit(0))
    headed = lambda lines: _let(_let(F.transform(lines, _header_rank), first), lambda head: section(lines, head))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.when(text.isNotNull(), F.filter(_let(lines, headed), lambda x: x != ""))


def depths(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, depth): the edges on the longest path from a root to each node; null on a cycle and behind one.

    Nodes whose incoming edges have all been used leave level by level, so one run gives
    the depth, the longest path and whether there is a cycle. A round a level; more than
    max_rounds levels are an error.
    """
    step = cut_lineage(edges.select("src", "dst").distinct())
    nodes = step.select(F.col("src").alias("node")).unionByName(step.select(F.col("dst").alias("node"))).distinct()
    need = step.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    state = cut_lineage(nodes.join(need, "node", "left").select("node", F.coalesce("need", F.lit(0)).alias("need"), F.lit(None).cast("int").alias("depth")))
    for level in range(max_rounds + 1):
        front = state.filter("need = 0 and depth is null").select(F.col("node").alias("src"))
        met = step.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("met"))
        new = F.when((F.col("need") == 0) & F.col("depth").isNull(), level).otherwise(F.col("depth"))
        state = cut_lineage(state.join(met, "node", "left").select("node", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), new.alias("depth")))
        if state.filter("need = 0 and depth is null").isEmpty():
            return state.select("node", "depth")
    raise RuntimeError(f"more than {max_rounds} levels; raise max_rounds")


def is_acyclic(edges: DataFrame, max_rounds: int = 1000) -> bool:
    """Whether no path returns to its start."""
    return depths(edges, max_rounds).filter("depth is null").isEmpty()


def parse_edges(lines: DataFrame, line: str = "line") -> DataFrame:
    """(src, rel, dst) of every edge line; comment lines and others give nothing."""
    c = F.trim(F.col(line))
    got = lines.filter(c.rlike(EDGE))
    return got.select(*[F.trim(F.regexp_extract(c, EDGE, k)).alias(n) for k, n in ((1, "src"), (2, "rel"), (3, "dst"))])


def parse_nodes(lines: DataFrame, line: str = "line") -> DataFrame:
    """(node,) of standalone node lines."""
    c = F.trim(F.col(line))
    return lines.filter(c.rlike(NODE)).select(F.trim(F.regexp_extract(c, NODE, 1)).alias("node"))


def node_parts(c: Column) -> Column:
    """entity, action and metric of 'entity:action:metric'; missing ones are null."""
    p = F.split(c, ":")
    return F.struct(F.trim(F.get(p, F.lit(0))).alias("entity"), F.trim(F.get(p, F.lit(1))).alias("action"), F.trim(F.get(p, F.lit(2))).alias("metric"))


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def paths(edges: DataFrame, max_depth: int = 20) -> DataFrame:
    """All simple root-to-leaf paths as arrays of nodes; paths of more than max_depth edges are an error, never cut."""
    ends = leaves(edges).withColumn("end", F.lit(True))
    step = edges.select("src", "dst").distinct()
    front = cut_lineage(roots(edges).select(F.col("node").alias("last"), F.array("node").alias("path")))
    done: DataFrame | None = None
    for _ in range(max_depth + 1):
        at_end = front.join(ends, front["last"] == ends["node"], "left_semi").select("path")
        done = at_end if done is None else done.unionByName(at_end)
        grown = front.join(step, front["last"] == step["src"]).filter(~F.array_contains("path", F.col("dst")))
        front = cut_lineage(grown.select(F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")))
        if front.isEmpty():
            return done
    raise RuntimeError(f"paths of more than {max_depth} edges; raise max_depth")


def _first_around(edges: DataFrame, seed: int) -> DataFrame:
    """(node, to): the first node among each node and its neighbours, by the nodes themselves if seed is 0, else by their hashes with it.

    After an order by hashes, the nodes that go to one and the same are named by the least of them.
    """
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
    if not seed:
        return both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to"))
    place = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("n"))
    to = both.groupBy("node").agg(F.min(place("near")).alias("near")).select("node", F.least(place("node"), "near")["n"].alias("to"))
    to = materialize(to, "components-first")
    names = to.groupBy("to").agg(F.min("node").alias("name"))
    return names.join(to, "to").select("node", F.col("name").alias("to"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): weak components, named by their least node.

    Each round every node goes over to the first node around it and the edges follow, so
    that edges inside a node vanish and equal ones become one; what is left is the graph
    of a part of the nodes. The order is that of the nodes while a round leaves less than
    half of them, else one by hashes, which shortens paths in any order of nodes. At the
    end the rounds' moves are joined from the last to the first.
    """
    now = edges.select(F.coalesce("src", "dst").alias("u"), F.coalesce("dst", "src").alias("v")).filter("u is not null")
    moves: list[DataFrame] = []
    seed, before, written = 0, None, None
    for k in range(max_rounds):
        move = materialize(_first_around(now, seed), "components-moves")
        moves.append(move)
        n = move.count()
        seed = 0 if before is None or 2 * n <= before else k
        before = n
        # the key sides of these joins are written first, so that Spark can split the edges of a node with many
        u = move.select(F.col("node").alias("u"), F.col("to").alias("a"))
        v = move.select(F.col("node").alias("v"), F.col("to").alias("b"))
        moved = now.join(u, "u").join(v, "v").filter("a <> b")
        after = materialize(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "components-edges")
        if written is not None:
            drop_files(edges.sparkSession, written)
        now = written = after
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = moves.pop()
    while moves:
        top = label.select(F.col("node").alias("to"), F.col("to").alias("c"))
        label = moves.pop().join(top, "to", "left").select("node", F.coalesce("c", "to").alias("to"))
    return label.withColumnRenamed("to", "component")


def sorted_lines(edges: DataFrame, key: str) -> DataFrame:
    """Per key the edge lines, sorted and joined by newlines."""
    line = F.format_string("(%s) -[%s]-> (%s)", "src", "rel", "dst")
    return edges.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("lines"))


