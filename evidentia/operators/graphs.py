"""Graph operators as bounded loops of joins; each round is cut by a table in the shared folder.

Chains, runs of nodes with one edge in and one out, are drawn together first by pointer doubling: a chain of n nodes takes
the logarithm of n in rounds and leaves one edge that is as long as the chain. A ring of such nodes is a cycle, found by the
same doubling. What is left is walked breadth first, peeled, or parted into components: forward colours part it, small
colours are searched in tasks, large ones backward in rounds. Rounds grow with the longest path between branching nodes.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

#: Steps along edges that one plan takes, so that a round writes one table for all of them.
HOPS = 4
#: Setting by which Spark removes the shuffle files of a query when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges that one task searches whole.
GROUP = 50_000

_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; of a local session's own where it names none."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in no more partitions than a shuffle has: unions would add theirs up
    from round to round. A table, unlike a checkpoint, hands on no constraints of the plan that made it; those double
    with every join, so that planning the twentieth round of a loop would take minutes."""
    spark = df.sparkSession
    path = shared_path(spark, "round")
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # what was shuffled for a table goes with its job, not when the driver collects garbage
    try:
        df.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    # nodes are as many as the data: none of these tables goes through the driver to be broadcast, round after round
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _rounds(bound: int):
    yield from range(bound)
    raise RuntimeError("the graph did not settle within its bound of rounds")


@dataclass
class Contracted:
    """edges(src, dst, w): what is left, w being the number of edges each stands for; inner(id, start, stop, place): the
    nodes of chains with the chain's two ends and their place in it from 1; rings(id, cycle): nodes of rings with their
    smallest member; size: how many nodes were in chains and rings."""

    edges: DataFrame
    inner: DataFrame
    rings: DataFrame
    size: int


def contract(edges: DataFrame, keep: DataFrame | None = None) -> Contracted:
    """edges(src, dst), distinct, or (src, dst, w). Nodes of ``keep``(id) stay as they are."""
    e = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1).cast("long"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("a"), F.min("dst").alias("next"), F.min("w").alias("w")).filter("a = 1 and id <> next")
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("b"), F.min("src").alias("before"), F.min("w").alias("v")).filter("b = 1")
    chain = out.join(into, "id").select("id", "next", "before", "w", "v")
    chain = cut(chain if keep is None else chain.join(keep.select("id").distinct(), "id", "left_anti"))
    n, ids = chain.count(), chain.select("id")
    if not n:
        return Contracted(e.select("src", "dst", "w"), chain.select("id", F.col("before").alias("start"), F.col("next").alias("stop"), F.col("v").alias("place")), chain.select("id", F.col("id").alias("cycle")), 0)
    # where a pointer leads: its length, the last node of the chain that it passes, the least one, if it may go on, and if
    # it has gone around: two stretches in a row share their least node only on a ring that they cover together
    now = chain.select("id", F.col("next").alias("to"), F.col("w").alias("far"), F.col("id").alias("last"), F.col("id").alias("low"), F.lit(False).alias("ring"))
    now = now.join(ids.select(F.col("id").alias("to"), F.lit(True).alias("on")), "to", "left").select("id", "to", "far", "last", "low", F.coalesce("on", F.lit(False)).alias("on"), "ring")
    now = cut(now)
    for _ in range(n.bit_length() + 1):
        if now.filter("on").isEmpty():
            break
        there = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("last").alias("last2"), F.col("low").alias("low2"), F.col("on").alias("on2"), F.col("ring").alias("ring2"))
        ring = F.col("ring2") | (F.col("low") == F.col("low2"))
        step = now.filter("on").join(there, "to").select("id", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), F.col("last2").alias("last"), F.least("low", "low2").alias("low"), (F.col("on2") & ~ring).alias("on"), ring.alias("ring"))
        now = cut(now.filter("not on").unionByName(step))
    rings = now.filter("ring").select("id", F.col("low").alias("cycle"))
    ended = now.filter("not ring")
    first = chain.join(ids.select(F.col("id").alias("before")), "before", "left_anti").select("id", "before", "v")
    whole = ended.join(first, "id").select("last", F.col("before").alias("start"), F.col("to").alias("stop"), (F.col("v") + F.col("far")).alias("w"))
    inner = ended.join(whole.select("last", "start", "stop", "w"), "last").select("id", "start", "stop", (F.col("w") - F.col("far")).alias("place"))
    apart = lambda c: ids.select(F.col("id").alias(c))
    rest = e.join(apart("src"), "src", "left_anti").join(apart("dst"), "dst", "left_anti").select("src", "dst", "w")
    return Contracted(cut(rest.unionByName(whole.select(F.col("start").alias("src"), F.col("stop").alias("dst"), "w"))), cut(inner), rings, n)


def reachable(edges: DataFrame, roots: DataFrame, bound: int = 10_000) -> DataFrame:
    """edges(src, dst), roots(id) -> (id, depth): each node that a root reaches, with its least depth."""
    roots = cut(roots.select("id").distinct())
    c = contract(edges.select("src", "dst").distinct(), roots)
    seen = front = roots.withColumn("depth", F.lit(0).cast("long"))
    for _ in _rounds(bound):
        step = front.join(c.edges, front.id == c.edges.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        front = cut(step.join(seen.withColumnRenamed("depth", "had"), "id", "left").filter("had is null or depth < had").select("id", "depth"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front).groupBy("id").agg(F.min("depth").alias("depth")))
    within = c.inner.join(seen.withColumnRenamed("id", "start"), "start").select("id", (F.col("depth") + F.col("place")).alias("depth"))
    return seen.unionByName(within).select("id", F.col("depth").cast("int").alias("depth"))


def unreachable_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.select("id").distinct().join(reachable(edges, roots).select("id"), "id", "left_anti")


def execution_order(nodes: DataFrame, edges: DataFrame, bound: int = 10_000) -> DataFrame:
    """nodes(id), edges(src, dst): dst depends on src. -> (id, level): 1 + the longest path before it; null on a cycle
    or after one. (level, id) is a topological order."""
    edges = cut(edges.select("src", "dst").distinct())
    every = cut(nodes.select("id").union(edges.select("src")).union(edges.select("dst")).distinct())
    c = contract(edges)
    left = every.join(c.inner.select("id"), "id", "left_anti").join(c.rings.select("id"), "id", "left_anti").withColumn("level", F.lit(1).cast("long"))
    edges, done = c.edges, None
    for _ in _rounds(bound):
        left = cut(left)
        free = cut(left.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        gain = edges.join(free.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("level") + F.col("w")).alias("gain"))
        left = left.join(free.select("id"), "id", "left_anti").join(gain.hint("merge"), "id", "left").select("id", F.greatest("level", "gain").alias("level"))
        edges = cut(edges.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
    if done is not None:
        done = cut(done)
        done = done.unionByName(c.inner.join(done.withColumnRenamed("id", "start"), "start").select("id", (F.col("level") + F.col("place")).alias("level")))
        every = every.join(done.hint("merge"), "id", "left")
    else:
        every = every.withColumn("level", F.lit(None))
    return nodes.select("id").distinct().join(every.hint("merge"), "id").select("id", F.col("level").cast("int").alias("level"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those that no walk of HOPS edges enters, or none leaves: so many layers of sources and sinks."""
    into, out = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
    for _ in range(HOPS - 1):
        into = edges.join(into, "dst", "left_semi").select(F.col("src").alias("dst")).distinct()
        out = edges.join(out, "src", "left_semi").select(F.col("dst").alias("src")).distinct()
    return edges.join(into, "dst", "left_semi").join(out, "src", "left_semi").select("src", "dst", "w")


def _coloured(edges: DataFrame, bound: int) -> DataFrame:
    """(src, dst, w, c): the edges within one colour. A node's colour is the node of the least hash that reaches it. By
    hashes, not ids, colours part the graph however its ids are dealt."""
    nodes = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    paths = cut(edges.select("src", "dst").union(nodes.select("id", F.col("id").alias("dst"))))
    colour = nodes.withColumn("c", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id")))
    for _ in _rounds(bound):
        new = colour
        for _ in range(HOPS):
            new = paths.join(new.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c"))
        new = cut(new)
        settled = new.join(colour.withColumnRenamed("c", "had"), "id").filter("c <> had").isEmpty()
        colour = new
        if settled:
            break
    of = lambda x: colour.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}"))
    return cut(edges.join(of("src"), "src").join(of("dst"), "dst").filter("c_src = c_dst").select("src", "dst", "w", F.col("c_src.id").alias("c")))


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tarjan's components of more than one node, for edges (src, dst) that fit a task."""
    codes, ids = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
    n, half = len(ids), len(pdf)
    order = np.argsort(codes[:half], kind="stable")
    to = codes[half:][order].tolist()
    begin = np.searchsorted(codes[:half][order], np.arange(n + 1)).tolist()
    seen, low, name, at, stack, count = [0] * n, [0] * n, [-1] * n, begin[:n], [], 0
    for root in range(n):
        walk = [] if seen[root] else [root]
        while walk:
            v = walk[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                stack.append(v)
            if at[v] < begin[v + 1]:
                x = to[at[v]]
                at[v] += 1
                if not seen[x]:
                    walk.append(x)
                elif name[x] < 0:
                    low[v] = min(low[v], seen[x])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[v])
            if low[v] == seen[v]:
                while name[v] < 0:
                    name[stack.pop()] = v
    name = np.array(name, dtype=int)
    many = np.bincount(name, minlength=n)[name] > 1
    return pd.DataFrame({"id": ids[many], "cycle": ids[name[many]]})


def _small_components(inside: DataFrame, small: DataFrame, edges: int) -> DataFrame:
    """(id, cycle) of the colours of ``small``(c), some of them to a task, which gets about GROUP edges."""
    kind = inside.schema["src"].dataType.simpleString()
    slot = F.pmod(F.xxhash64("c"), F.lit(edges // GROUP + 1)).alias("slot")
    return inside.join(small, "c", "left_semi").select(slot, "src", "dst").groupBy("slot").applyInPandas(lambda pdf: _strong(pdf), f"id {kind}, cycle {kind}")


def _components(edges: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """One pass of forward colours and backward search: (id, cycle) of the components found, and the edges that may still
    hold others, if any. What of a colour reaches its namesake is one; colours of at most GROUP edges are searched whole, each in a task."""
    inside = _coloured(edges, bound)
    found = inside.select(F.col("src").alias("id"), F.col("src").alias("cycle")).limit(0)
    if isinstance(inside.schema["src"].dataType, (IntegralType, StringType)):
        sizes = cut(inside.groupBy("c").agg(F.count("*").alias("n")))
        small = sizes.filter(F.col("n") <= GROUP)
        edges_of, largest = sizes.agg(F.sum(F.when(F.col("n") <= GROUP, F.col("n"))), F.max("n")).first()
        if edges_of:
            found = cut(_small_components(inside, small.select("c"), edges_of))
        if not largest or largest <= GROUP:
            return found, None
        inside = cut(inside.join(small.select("c"), "c", "left_anti").select("src", "dst", "w", "c"))
    front = cut(inside.filter("dst = c").select(F.col("src").alias("id"), "c").distinct())
    seen = front
    for _ in _rounds(bound):
        if front.isEmpty():
            break
        front = cut(inside.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "c").distinct().join(seen, ["id", "c"], "left_anti"))
        seen = cut(seen.unionByName(front))
    gone = seen.select("id")
    rest = cut(inside.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "w"))
    return found.unionByName(seen.select("id", F.col("c").alias("cycle"))), None if rest.isEmpty() else rest


def cycle_members(edges: DataFrame, bound: int = 10_000) -> DataFrame:
    """(id, cycle): nodes on a cycle, named by the smallest member of their strongly connected component."""
    e = cut(edges.select("src", "dst").distinct().filter("src is not null and dst is not null"))
    loop, more = F.lit(True).alias("loop"), F.lit(False).alias("loop")
    comp = e.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("cycle"), loop)
    e = e.filter("src <> dst").withColumn("w", F.lit(1).cast("long"))
    n, layers = e.count(), []
    for _ in _rounds(bound):
        before = -1
        while n and (before < 0 or n < 0.5 * before):  # sources and sinks go, as long as they are many
            e, before = cut(_trimmed(e)), n
            n = e.count()
        if not n:
            break
        c = contract(e)
        if c.size:
            layers.append(c.inner)
            comp = comp.unionByName(c.rings.select("*", more)).unionByName(c.edges.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("cycle"), loop))
            e, before = cut(c.edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))), n
            n = e.count()
            if not n:
                break
        if n > 0.5 * before or not c.size:  # not many chains were left
            found, e = _components(e, bound)
            comp = comp.unionByName(found.select("*", more))
            if e is None:
                break
            n = e.count()
    # a node of a component may also stand for itself by a loop: the component counts, whichever name is smaller
    one = lambda d: cut(d.groupBy("id").agg(F.min_by("cycle", "loop").alias("cycle"), F.min("loop").alias("loop")))
    comp = one(comp)
    for inner in reversed(layers):
        of = lambda x, comp=comp: comp.select(F.col("id").alias(x), F.col("cycle").alias(f"c_{x}"))
        comp = one(comp.unionByName(inner.join(of("start"), "start").join(of("stop"), "stop").filter("c_start = c_stop").select("id", F.col("c_start").alias("cycle"), more)))
    names = comp.groupBy("cycle").agg(F.min("id").alias("name"))
    return comp.join(names, "cycle").select("id", F.col("name").alias("cycle"))


def propagate_blocks(edges: DataFrame, failed: DataFrame, bound: int = 10_000, cycles: DataFrame | None = None) -> DataFrame:
    """edges(src, dst): dst depends on src, failed(id) -> (id, cause, kind): nodes that depend, through any number of others, on
    a failed node or on a cycle, a row for each of their root causes. The cause is a failed node, or a cycle by the name that
    ``cycle_members`` gives it: its members cause as a group, but a failed one by itself. Failed nodes and those on cycles stop
    the walk and have no rows of their own. ``cycles``(id, cycle): those of ``edges``, if they are known."""
    edges = cut(edges.select("src", "dst").distinct().filter("src is not null and dst is not null"))
    failed = failed.select("id").filter("id is not null").distinct()
    cycles = (cycle_members(edges) if cycles is None else cycles).hint("merge").join(failed, "id", "left_anti")
    roots = failed.select("id", F.col("id").alias("cause"), F.lit("failed").alias("kind"))
    front = cut(roots.unionByName(cycles.select("id", F.col("cycle").alias("cause"), F.lit("cycle").alias("kind"))))
    edges = cut(edges.join(front.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    seen = front.filter("false")
    for k in _rounds(bound):
        nxt = front.join(edges, front.id == edges.src).select(F.col("dst").alias("id"), "cause", "kind").distinct()
        front = cut(nxt.join(seen.hint("merge"), ["id", "cause", "kind"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front)) if k % 5 == 4 else seen.union(front)
    return seen


def trace_lineage(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The undirected neighbourhood of ``start``."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reachable(both, start)


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    n = nodes.select("id").distinct()
    a = edges.join(n.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst")
    b = edges.join(n.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    return a.union(b).distinct()


def compile_status(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, status): failed, cycle-blocked, dependency-blocked or compiled."""
    cycles = cut(cycle_members(edges))
    cyc = cycles.select("id", F.lit(1).alias("c"))
    dep = propagate_blocks(edges, failed, cycles=cycles).select("id", F.lit(1).alias("d")).distinct()
    j = nodes.select("id").distinct().join(failed.select("id", F.lit(1).alias("f")).distinct(), "id", "left").join(cyc, "id", "left").join(dep, "id", "left")
    return j.select("id", F.when(F.col("f") == 1, "failed").when(F.col("c") == 1, "cycle-blocked").when(F.col("d") == 1, "dependency-blocked").otherwise("compiled").alias("status"))
