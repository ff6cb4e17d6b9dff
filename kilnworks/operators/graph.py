"""Dependency graphs, many at once (GR-1..10, SO-1, T-7).

``nodes(graph, name, project)`` and ``edges(graph, from_name, from_project, to_name,
to_project)``: an edge points from the dependent to what it depends on. A node is
the pair (name, project). Loops run on the driver; each round is one set of
distributed joins whose result is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import joined_in_place, unbroadcast, written, written_by
from .ordered import top_per_key

GRAPH = ["graph"]
# Graphs of more edges are no work of one task. A graph of so many has at most the square of
# them as pairs of connected nodes.
LARGE_GRAPH = 4_000
# Of graphs of more edges cycles are found without all pairs of connected nodes.
LARGE_CYCLES = 500


def node(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}name").alias("name"), F.col(f"{prefix}project").alias("project"))


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """SO-1."""
    return nodes.select("graph", "name", "project").distinct()


def _paired(edges: DataFrame) -> DataFrame:
    return edges.select("graph", node("from_").alias("src"), node("to_").alias("dst")).distinct()


def self_dependencies(edges: DataFrame) -> DataFrame:
    """GR-1."""
    loops = _paired(edges).where(F.col("src") == F.col("dst"))
    return loops.select("graph", "src.name", "src.project")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-1: edges with an end that is not declared."""
    pairs = _paired(edges).where(F.col("src") != F.col("dst"))
    return (
        pairs.join(_declared(nodes, "src"), ["graph", "src"], "left_anti")
        .unionByName(pairs.join(_declared(nodes, "dst"), ["graph", "dst"], "left_anti"))
        .distinct()
        .select(
            "graph",
            F.col("src.name").alias("from_name"),
            F.col("src.project").alias("from_project"),
            F.col("dst.name").alias("to_name"),
            F.col("dst.project").alias("to_project"),
        )
    )


def _declared(nodes: DataFrame, alias: str) -> DataFrame:
    return distinct_nodes(nodes).select("graph", node().alias(alias))


def edge_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SO-1: (graph, src, dst), distinct, both ends declared, no self edges."""
    pairs = _paired(edges).where(F.col("src") != F.col("dst"))
    return pairs.join(_declared(nodes, "src"), ["graph", "src"], "left_semi").join(
        _declared(nodes, "dst"), ["graph", "dst"], "left_semi"
    )


def completeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-1: per graph, whether every edge names declared targets."""
    bad = dangling_edges(nodes, edges).groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("dangling"))
    graphs = distinct_nodes(nodes).select(*GRAPH).distinct()
    dangling = F.coalesce("dangling", F.lit(0))
    return graphs.join(bad, GRAPH, "left").select(
        "graph", dangling.alias("dangling"), (dangling == 0).alias("complete")
    )


def direct(pairs: DataFrame) -> DataFrame:
    """GR-2: dependents and dependencies of each node, as rows."""
    up = pairs.select(
        "graph", F.col("dst").alias("node"), F.lit("dependent").alias("relation"),
        F.col("src").alias("other"),
    )
    down = pairs.select(
        "graph", F.col("src").alias("node"), F.lit("dependency").alias("relation"),
        F.col("dst").alias("other"),
    )
    return up.unionByName(down)


def fan_counts(edges: DataFrame) -> DataFrame:
    """GR-2: edges in and out by bare name; same-named targets are merged."""
    pairs = _paired(edges).where(F.col("src") != F.col("dst"))
    ends = pairs.select(
        "graph",
        F.explode(
            F.array(
                F.struct(F.col("src.name").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst.name").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("_e"),
    )
    return ends.groupBy("graph", "_e.name").agg(
        F.sum("_e.i").alias("fan_in"), F.sum("_e.o").alias("fan_out")
    )


def hotspots(edges: DataFrame, limit: int) -> DataFrame:
    """T-7: the names with most edges in."""
    wanted = fan_counts(edges).where(F.col("fan_in") > 0)
    order = [F.desc("fan_in"), F.asc("name")]
    return top_per_key(wanted, GRAPH, order, limit, "position")


def reverse_dependencies(edges: DataFrame) -> DataFrame:
    """GR-8: distinct dependents of each name, one per row."""
    pairs = _paired(edges).where(F.col("src") != F.col("dst"))
    return pairs.select(
        "graph", F.col("dst.name").alias("name"), F.col("src.name").alias("dependent")
    ).distinct()


def roots(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """GR-4: targets nothing depends on."""
    return _declared(nodes, "dst").join(pairs, ["graph", "dst"], "left_anti").select(
        "graph", F.col("dst").alias("node")
    )


@dataclass(frozen=True)
class Numbered:
    """A set of edges over numbers: ``nodes(id, graph, node)``, ``edges(graph, src, dst)``.

    Numbers are unique in their graph and grow with the node. Those of :func:`numbered` are
    unique over all graphs, so loops may join and compare on one long. A node of no edge
    has no number.
    """

    nodes: DataFrame
    edges: DataFrame
    n_nodes: int = 0
    n_edges: int = 0
    in_place: bool = False

    def store(self, df: DataFrame, label: str) -> DataFrame:
        return written_by(df, label, "graph", placed=True) if self.in_place else written(df, label)[0]

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """Nodes in place of numbers."""
        for name in columns:
            names = self.nodes.select("graph", F.col("id").alias(name), F.col("node").alias("_node"))
            df = df.join(names, ["graph", name]).drop(name).withColumnRenamed("_node", name)
        return df


def numbered(pairs: DataFrame) -> Numbered:
    """Of distinct pairs, as :func:`edge_set` gives them."""
    pairs = pairs.select("graph", "src", "dst")
    ends = pairs.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
    ordered = ends.repartitionByRange("graph", "node").sortWithinPartitions("graph", "node")
    nodes, n_nodes = written(
        ordered.select(F.monotonically_increasing_id().alias("id"), "graph", "node"), "graph-nodes"
    )
    edges = pairs
    for end in ("src", "dst"):
        names = nodes.select("graph", F.col("node").alias(end), F.col("id").alias(f"_{end}"))
        edges = edges.join(names, ["graph", end])
    edges, n_edges = written(edges.select("graph", F.col("_src").alias("src"), F.col("_dst").alias("dst")), "graph-edges")
    return Numbered(nodes, edges, n_nodes, n_edges)


def _numbered_in_place(pairs: DataFrame) -> Numbered:
    """Of pairs in buckets of their graph; nothing moves."""
    ends = pairs.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
    place = F.row_number().over(Window.partitionBy("graph").orderBy("node")).cast("long")
    ids = ends.select("graph", place.alias("id"), "node")
    nodes = written_by(ids, "graph-nodes", "graph", placed=True)
    edges = pairs
    for end in ("src", "dst"):
        names = nodes.select("graph", F.col("node").alias(end), F.col("id").alias(f"_{end}"))
        edges = edges.join(names, ["graph", end])
    edges = edges.select("graph", F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    return Numbered(nodes, written_by(edges, "graph-edges", "graph", placed=True), in_place=True)


def _by_size(
    pairs: DataFrame, work: Callable[[Numbered], DataFrame], large: int, placed: bool
) -> DataFrame:
    """Rows that ``work`` finds, with their graph.

    Pairs move once, to the place of their graph, and are worked on there; ``placed`` ones
    are in its bucket already. Graphs of more than ``large`` edges are worked on by node,
    with shuffles.
    """
    pairs = pairs.select("graph", "src", "dst")
    with unbroadcast(pairs.sparkSession):
        counts = pairs.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)
        many, n_many = written(counts.select("graph"), "large-graphs")
    small = pairs.join(many, GRAPH, "left_anti") if n_many else pairs
    with joined_in_place(pairs.sparkSession):
        if n_many or not placed:
            small = written_by(small, "graph-pairs", "graph", placed)
        found = work(_numbered_in_place(small))
    if not n_many:
        return found
    with unbroadcast(pairs.sparkSession):
        return found.unionByName(work(numbered(pairs.join(many, GRAPH, "left_semi"))))


def closure(pairs: DataFrame, large: int = LARGE_GRAPH, placed: bool = False) -> DataFrame:
    """GR-3: all (graph, src, dst) with a path from src to dst; src may equal dst
    when it lies on a cycle.

    Pairs carry their distance. Once all pairs of up to d edges are known, a pair of
    up to 2d is one of exactly d followed by a known one, so each round joins only the
    farthest pairs of the last round and keeps what is new. A chain of n edges takes
    log2(n) rounds. Graphs of more than ``large`` edges are closed node by node.
    """

    def reached(g: Numbered) -> DataFrame:
        rows = _reach_in_place(g) if g.in_place else _reach(g.edges)
        return g.store(g.named(rows, "src", "dst").select("graph", "src", "dst"), "closure")

    return _by_size(pairs, reached, large, placed)


def _reach_in_place(g: Numbered) -> DataFrame:
    """Like :func:`_reach`; each round stores all pairs, for a union of rounds would not
    lie in buckets any more."""
    known, step = g.store(g.edges.withColumn("distance", F.lit(1)), "reach"), 1
    while True:
        left = known.where(F.col("distance") == step).select("graph", "src", F.col("dst").alias("_via"))
        right = known.select("graph", F.col("src").alias("_via"), "dst", "distance")
        longer = left.join(right, ["graph", "_via"]).groupBy("graph", "src", "dst").agg(
            (F.min("distance") + step).alias("_longer")
        )
        both = known.join(longer, ["graph", "src", "dst"], "full")
        known = g.store(
            both.select("graph", "src", "dst", F.coalesce("distance", "_longer").alias("distance")), "reach"
        )
        if not known.where(F.col("distance") > step).limit(1).count():
            return known.select("graph", "src", "dst")
        step *= 2


def _reach(edges: DataFrame) -> DataFrame:
    known, _ = written(edges.withColumn("distance", F.lit(1)), "reach")
    far, step = known, 1
    while True:
        left = far.where(F.col("distance") == step).select("graph", "src", F.col("dst").alias("_via"))
        right = known.select(F.col("src").alias("_via"), "dst", "distance")
        longer = left.join(right, "_via").groupBy("graph", "src", "dst").agg(
            (F.min("distance") + step).alias("distance")
        )
        far, count = written(longer.join(known, ["graph", "src", "dst"], "left_anti"), "reach")
        if not count:
            return known.select("graph", "src", "dst")
        known, step = known.unionByName(far), 2 * step


def transitive(reach: DataFrame) -> DataFrame:
    """GR-3: dependents and dependencies of each node, the node itself excluded."""
    return direct(reach.where(F.col("src") != F.col("dst")))


def _core(edges: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Edges left after nodes without an edge in or out are taken off, for as long as
    that takes many of them; long ends are left to the labels."""
    while count:
        sources = edges.select(F.col("src").alias("dst")).distinct()
        sinks = edges.select(F.col("dst").alias("src")).distinct()
        edges, left = written(
            edges.join(sources, "dst", "left_semi").join(sinks, "src", "left_semi"), "trim"
        )
        if count - left <= count // 10:
            return edges, left
        count = left
    return edges, count


def _labelled(edges: DataFrame, flip: int) -> DataFrame:
    """Of each node the least number that reaches it, ``above``, and that it reaches,
    ``below``; numbers are compared after a bitwise exclusive or with ``flip``.

    Labels move along all edges, and along one pointer a node up and down that doubles
    its length every round, so that a chain or ring takes a logarithm of its length.
    """
    both = edges.select(F.col("dst").alias("id"), F.col("src").alias("up"), F.lit(None).cast("long").alias("down"))
    both = both.unionByName(
        edges.select(F.col("src").alias("id"), F.lit(None).cast("long").alias("up"), F.col("dst").alias("down"))
    )
    own = F.col("id").bitwiseXOR(F.lit(flip).cast("long"))
    state, _ = written(
        both.groupBy("id").agg(F.min("up").alias("up"), F.min("down").alias("down")).select(
            "id", F.coalesce("up", "id").alias("up"), F.coalesce("down", "id").alias("down"),
            own.alias("above"), own.alias("below"), F.lit(True).alias("moved"),
        ),
        "labels",
    )
    while True:
        none = F.lit(None).cast("long")
        tops = state.select(F.col("id").alias("src"), "above")
        ends = state.select(F.col("id").alias("dst"), "below")
        sent = edges.join(tops, "src").select(F.col("dst").alias("id"), "above", none.alias("below"))
        sent = sent.unionByName(
            edges.join(ends, "dst").select(F.col("src").alias("id"), none.alias("above"), "below")
        )
        got = sent.groupBy("id").agg(F.min("above").alias("_above"), F.min("below").alias("_below"))
        higher = state.select(
            F.col("id").alias("up"), F.col("up").alias("_up"), F.col("above").alias("_up_above")
        )
        lower = state.select(
            F.col("id").alias("down"), F.col("down").alias("_down"), F.col("below").alias("_down_below")
        )
        joined = state.join(higher, "up").join(lower, "down").join(got, "id", "left")
        above = F.least("above", "_above", "_up_above")
        below = F.least("below", "_below", "_down_below")
        moved = (above < F.col("above")) | (below < F.col("below"))
        state, _ = written(
            joined.select(
                "id", F.col("_up").alias("up"), F.col("_down").alias("down"),
                above.alias("above"), below.alias("below"), moved.alias("moved"),
            ),
            "labels",
        )
        if not state.where("moved").limit(1).count():
            return state.select("id", "above", "below")


# Orders in which labels compete, one a round and again from the first.
FLIPS = (0, -1, 0x2AAA_AAAA_AAAA_AAAA, 0x3333_3333_3333_3333, 0x0F0F_0F0F_0F0F_0F0F, 0x00FF_00FF_00FF_00FF)


# Components are read off all pairs of connected nodes where there are at most so many.
PAIRS_BOUND = 20_000_000


def _mutual(edges: DataFrame) -> DataFrame:
    """(id, component) from the closure of the edges."""
    reach, _ = written(_reach(edges), "reach")
    back = reach.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = reach.drop("graph").join(back, ["src", "dst"]).groupBy(F.col("src").alias("id"))
    return both.agg(F.min("dst").alias("component"))


def components(g: Numbered) -> DataFrame:
    """(id, component): nodes of strongly connected components of two or more.

    What is left of small graphs without their ends is closed, if a bound of the pairs
    says so. Otherwise labels decide, without pairs of nodes: a node whose least ancestor
    is also its least descendant is in the component of that node; of the other edges
    only those between equal labels can lie in a component, so each round cuts the rest
    into smaller pieces.
    """
    edges, count = _core(g.edges, g.n_edges)
    found = []
    at = 0
    while count:
        named = edges.select("graph", "src").distinct()
        sizes = named.groupBy("graph").agg(F.count(F.lit(1)).cast("double").alias("n"))
        if sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] <= PAIRS_BOUND:
            found.append(_mutual(edges))
            break
        flip = FLIPS[at % len(FLIPS)]
        labels, _ = written(_labelled(edges, flip), "components")
        same = F.col("above") == F.col("below")
        component = F.col("above").bitwiseXOR(F.lit(flip).cast("long")).alias("component")
        found.append(labels.where(same).select("id", component))
        open_ = labels.where(~same)
        src = open_.select(F.col("id").alias("src"), "above", "below")
        dst = open_.select(F.col("id").alias("dst"), "above", "below")
        rest = edges.join(src, "src").join(dst, ["dst", "above", "below"]).select("graph", "src", "dst")
        edges, count = _core(*written(rest, "rest"))
        at += 1
    if not found:
        return g.nodes.select("id", F.col("id").alias("component")).limit(0)
    all_ = reduce(DataFrame.unionByName, found)
    sizes = all_.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return all_.join(sizes.select("component"), "component", "left_semi").select("id", "component")


def _mutual_in_place(g: Numbered) -> DataFrame:
    """(graph, id, component) from the closure of what is left without the ends."""
    sources = g.edges.select("graph", F.col("src").alias("dst")).distinct()
    sinks = g.edges.select("graph", F.col("dst").alias("src")).distinct()
    core = g.store(
        g.edges.join(sources, ["graph", "dst"], "left_semi").join(sinks, ["graph", "src"], "left_semi"), "trim"
    )
    reach = _reach_in_place(replace(g, edges=core.select("graph", "src", "dst")))
    back = reach.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = reach.join(back, ["graph", "src", "dst"]).groupBy("graph", F.col("src").alias("id"))
    # A node that no other leads back to has no pair but its own.
    return both.agg(F.min("dst").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def cycle_members(pairs: DataFrame, large: int = LARGE_CYCLES, placed: bool = False) -> DataFrame:
    """GR-5: (graph, cycle, member): strongly connected targets, as
    ``project::name``; a cycle is named after its smallest member. Graphs of more than
    ``large`` edges are worked on node by node."""
    return _by_size(pairs, _cycles, large, placed)


def _cycles(g: Numbered) -> DataFrame:
    found = _mutual_in_place(g) if g.in_place else components(g).join(g.nodes.select("graph", "id"), "id")
    members = g.named(found, "id").select(
        "graph", "component", F.concat_ws("::", "id.project", "id.name").alias("member")
    )
    least = members.groupBy("graph", "component").agg(F.min("member").alias("cycle"))
    rows = members.join(least, ["graph", "component"]).select("graph", "member", "cycle")
    return g.store(rows, "cycles")


def by_name(nodes: DataFrame) -> DataFrame:
    """GR-7: candidates of each bare name; ``project`` only when there is one."""
    return distinct_nodes(nodes).groupBy("graph", "name").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.when(F.count(F.lit(1)) == 1, F.min("project")).alias("project"),
    )


def _anchored(g: Numbered) -> DataFrame:
    """(graph, id, anchor, hops): the nearest node upward that has not exactly one edge in.

    A node with one edge in has its parent's chain and one step more. Pointers to the
    parent double their length every round. Nodes on a loop of such edges, or below
    one, get no row, as no root reaches them: once the least node of a stretch is also
    the least of the next stretch above, it has been met twice.
    """
    into = g.edges.groupBy("graph", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    parents = g.nodes.select("graph", "id").join(into.withColumnRenamed("dst", "id"), ["graph", "id"], "left")
    state = parents.select(
        "graph",
        "id",
        F.when(one, F.col("src")).otherwise(F.col("id")).alias("anchor"),
        F.when(one, 1).otherwise(0).cast("long").alias("hops"),
        F.when(one, F.col("src")).alias("least"),
        F.lit(False).alias("looped"),
        one.alias("moved"),
    )
    while True:
        state = g.store(state, "anchors")
        if not state.where("moved").limit(1).count():
            break
        above = state.select(
            "graph", F.col("id").alias("anchor"), F.col("anchor").alias("_next"),
            F.col("hops").alias("_more"), F.col("least").alias("_least"), F.col("looped").alias("_looped"),
        )
        twice = F.coalesce(F.col("least") == F.col("_least"), F.lit(False))
        looped = F.col("looped") | F.col("_looped") | twice
        state = state.join(above, ["graph", "anchor"]).select(
            "graph",
            "id",
            F.when(looped, F.col("id")).otherwise(F.col("_next")).alias("anchor"),
            F.when(looped, 0).otherwise(F.col("hops") + F.col("_more")).cast("long").alias("hops"),
            F.least("least", "_least").alias("least"),
            looped.alias("looped"),
            ((F.col("_more") > 0) & ~looped).alias("moved"),
        )
    ends = state.where("hops = 0 and not looped").select("graph", F.col("id").alias("anchor"))
    return state.select("graph", "id", "anchor", "hops").join(ends, ["graph", "anchor"], "left_semi")


def _distances(g: Numbered, roots_: DataFrame) -> DataFrame:
    """(graph, id, distance, root): the nearest root of each node, the smallest of several."""
    anchors = g.store(_anchored(g), "anchored")
    heads = anchors.where("hops = 0").select("graph", F.col("id").alias("dst"))
    of_src = anchors.withColumnRenamed("id", "src")
    steps = g.store(
        g.edges.join(heads, ["graph", "dst"], "left_semi")
        .join(of_src, ["graph", "src"])
        .groupBy("graph", "anchor", F.col("dst").alias("id"))
        .agg((F.min("hops") + 1).alias("length")),
        "steps",
    )
    best = g.store(
        roots_.select("graph", "id", F.struct(F.lit(0).cast("long").alias("distance"), F.col("id").alias("root")).alias("best")),
        "nearest",
    )
    front, count = best, best.limit(1).count()
    # Each round only nodes that came nearer send on; a shorter way is found at most
    # once for every length.
    while count:
        sent = (
            front.withColumnRenamed("id", "anchor")
            .join(steps, ["graph", "anchor"])
            .groupBy("graph", "id")
            .agg(F.min(F.struct((F.col("best.distance") + F.col("length")).alias("distance"), F.col("best.root").alias("root"))).alias("_sent"))
        )
        both = best.join(sent, ["graph", "id"], "full").select(
            "graph",
            "id",
            F.least("best", "_sent").alias("best"),
            F.coalesce(F.col("_sent") < F.col("best"), F.col("best").isNull()).alias("nearer"),
        )
        both = g.store(both, "nearest")
        front = both.where("nearer").select("graph", "id", "best")
        best, count = both.select("graph", "id", "best"), front.limit(1).count()
    of_anchor = best.select("graph", F.col("id").alias("anchor"), "best")
    return anchors.join(of_anchor, ["graph", "anchor"]).select(
        "graph", "id", (F.col("best.distance") + F.col("hops")).alias("distance"), F.col("best.root").alias("root")
    )


def shortest_chains(
    nodes: DataFrame, pairs: DataFrame, large: int = LARGE_GRAPH, placed: bool = False
) -> DataFrame:
    """GR-6: for every target the shortest chain from the nearest root, root first.

    Every target gets its smallest root at the least distance, and the smallest parent
    one step nearer to that root. Among equal chains this is the one that is smallest
    when read from the target up, which is what a queue in node order gives. Targets
    that are roots, or that no root reaches, have no row.

    Only targets with several edges in are searched round by round. One table then
    holds a parent for each target, and paths double their length every round. Graphs of
    more than ``large`` edges are searched node by node.
    """
    return _by_size(pairs, _chains, large, placed)


def _chains(g: Numbered) -> DataFrame:
    ends = g.edges.select("graph", F.col("dst").alias("id"))
    tops = g.nodes.select("graph", "id").join(ends, ["graph", "id"], "left_anti")
    near = g.store(_distances(g, tops), "distances")
    above = near.select("graph", F.col("id").alias("src"), F.col("distance").alias("_above"), "root")
    here = near.select("graph", F.col("id").alias("dst"), "distance", "root")
    parents = (
        g.edges.join(here, ["graph", "dst"])
        .join(above, ["graph", "src", "root"])
        .where(F.col("distance") == F.col("_above") + 1)
        .groupBy("graph", F.col("dst").alias("id"))
        .agg(F.min("src").alias("parent"))
    )
    # path: from below the pointer down to the node itself; at a root the pointer ends.
    start = near.join(parents, ["graph", "id"], "left").select("graph", "id", "parent", F.array("id").alias("path"))
    state = g.store(start, "paths")
    while state.where(F.col("parent").isNotNull()).limit(1).count():
        upper = state.select(
            "graph", F.col("id").alias("parent"), F.col("parent").alias("_next"), F.col("path").alias("_upper")
        )
        joined = state.join(upper, ["graph", "parent"], "left")
        state = g.store(
            joined.select(
                "graph", "id", F.col("_next").alias("parent"),
                F.when(F.col("_upper").isNull(), F.col("path")).otherwise(F.concat("_upper", "path")).alias("path"),
            ),
            "paths",
        )
    rows = state.where(F.size("path") > 1).select("graph", F.col("id").alias("target"), F.posexplode("path").alias("_at", "step"))
    names = g.nodes.select("graph", F.col("id").alias("step"), F.col("node").alias("_node"))
    paths = rows.join(names, ["graph", "step"]).groupBy("graph", "target").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_node"))).alias("_steps")
    )
    named = g.named(paths, "target").select(
        "graph", "target", F.transform("_steps", lambda step: step["_node"]).alias("path")
    )
    return g.store(named, "chains")


def why_built(nodes: DataFrame, pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """GR-9: one answer per bare name: path, root, ambiguous or no path."""
    names = by_name(nodes)
    single = names.where(F.col("candidates") == 1).select(
        "graph", "name", F.struct("name", "project").alias("target")
    )
    top = roots(nodes, pairs).select(
        "graph", F.col("node").alias("target"), F.lit(True).alias("_root")
    )
    answers = (
        single.join(chains, ["graph", "target"], "left")
        .join(top, ["graph", "target"], "left")
        .select(
            "graph",
            "name",
            F.when(F.col("path").isNotNull(), F.lit("path"))
            .when(F.col("_root"), F.lit("root"))
            .otherwise(F.lit("no path"))
            .alias("verdict"),
            F.array_join(F.transform("path", lambda n: n["name"]), " > ").alias("answer"),
        )
    )
    unclear = names.where(F.col("candidates") > 1).select("graph", "name")
    listed = (
        distinct_nodes(nodes)
        .join(unclear, ["graph", "name"], "left_semi")
        .groupBy("graph", "name")
        .agg(F.array_join(F.array_sort(F.collect_list("project")), ", ").alias("answer"))
        .select("graph", "name", F.lit("ambiguous").alias("verdict"), "answer")
    )
    return answers.unionByName(listed)


def graph_summary(
    nodes: DataFrame, edges: DataFrame, declared: DataFrame, hotspot_limit: int
) -> DataFrame:
    """GR-10: targets, declared count, dependencies and hotspots per graph."""
    sized = distinct_nodes(nodes).groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("targets"))
    pairs = _paired(edges).where(F.col("src") != F.col("dst"))
    linked = pairs.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("dependencies"))
    item = F.struct("position", "name")
    hot = hotspots(edges, hotspot_limit).groupBy(*GRAPH).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(item)), lambda h: h["name"]), ", "
        ).alias("hotspots")
    )
    return (
        sized.join(declared, GRAPH, "left")
        .join(linked, GRAPH, "left")
        .join(hot, GRAPH, "left")
        .select(
            "graph",
            "targets",
            "declared_count",
            F.coalesce("dependencies", F.lit(0)).alias("dependencies"),
            F.coalesce("hotspots", F.lit("")).alias("hotspots"),
        )
    )
