"""Parent-child links to full hierarchies with deterministic hash splitters.

Every node keeps a pointer and the path walked so far. Nodes whose hash falls on a splitter, and roots, stop the walk
of others, so a walk is short whatever the depth of the tree: pointers double until they rest on a splitter. The
splitters with their pointers are a reduced graph, solved in the same way down to the roots; paths are then expanded
by one join. What never rests on a splitter runs into a cycle without splitters, what never reaches a root runs into
one with splitters; of these, the nodes still hit after many steps lie on it.

Where nodes have several parents, all of them count: the closure over all links is made by doubling, loops through any
parents are found in it, and the path of a node follows the least of its parents that lead to a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import cut

EVERY = 8


def _double(state: DataFrame, stops: Column, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """state: node, cur, path, done. Doubles the pointers of open nodes until done or stuck; gives (done, stuck)."""
    state = cut(state)
    left = state.filter(~F.col("done")).count()
    for _ in range(most):
        if not left:
            break
        to = state.select(F.col("node").alias("cur"), F.col("cur").alias("cur2"), F.col("path").alias("path2"), F.col("done").alias("done2"))
        moved = state.filter(~F.col("done")).join(to, "cur", "left").select("node", F.coalesce("cur2", "cur").alias("cur"), F.concat("path", F.coalesce("path2", F.array().cast("array<string>"))).alias("path"))
        state = cut(state.filter("done").unionByName(moved.withColumn("done", stops)))
        now = state.filter(~F.col("done")).count()
        if now == left:  # nobody arrived from twice as far: nobody is farther away, the rest runs in circles
            break
        left = now
    return state.filter("done"), state.filter(~F.col("done"))


def resolve(links: DataFrame, every: int = EVERY) -> DataFrame:
    """links: node, parent (strings without NUL; null parent: a root). Gives node, kind, path (root first).

    kind is ``tree`` with a path, ``cycle`` for a node on a loop (a self-link is a loop), ``below`` for one under a loop; the path
    is null for both. A parent that is listed nowhere is a root. Repeated links count once. A node with several parents
    is on a loop if any of them leads back to it, else in a tree if any leads to a root past no loop; its path goes by
    the least such parent, ``closure`` by all. Rows with a null node are left out; an empty input gives an empty result."""
    links = cut(links.filter(F.col("node").isNotNull()).select("node", "parent").distinct())
    if not several(links):
        return _single(links, every)
    return _many(links, every)


def several(links: DataFrame) -> bool:
    """Whether a node has more than one parent."""
    return not links.groupBy("node").agg((F.min("parent") < F.max("parent")).alias("many")).filter("many").isEmpty()


def _squared(edges: DataFrame) -> DataFrame:
    """All (ancestor, node, distance) with the least distance of at least 1, for edges(node, parent), by doubling."""
    pairs = cut(edges.select(F.col("parent").alias("ancestor"), "node", F.lit(1).alias("distance")).distinct())
    n = pairs.count()
    while n:
        on = pairs.select(F.col("node").alias("mid"), "ancestor", F.col("distance").alias("d1"))
        off = pairs.select(F.col("ancestor").alias("mid"), "node", F.col("distance").alias("d2"))
        far = on.join(off, "mid").select("ancestor", "node", (F.col("d1") + F.col("d2")).alias("distance"))
        pairs = cut(pairs.unionByName(far).groupBy("ancestor", "node").agg(F.min("distance").alias("distance")))
        if pairs.count() == n:
            break
        n = pairs.count()
    return pairs


def _cycle_names(hops: DataFrame) -> DataFrame:
    """node, low: the least node of each loop of hops(node, cur), whose nodes all lie on loops."""
    both = hops.unionByName(hops.select(F.col("cur").alias("node"), F.lit(None).cast("string").alias("cur")))
    hop = cut(both.withColumn("low", F.col("node")).groupBy("node").agg(F.max("cur").alias("cur"), F.min("low").alias("low")))
    while True:
        to = hop.select(F.col("node").alias("cur"), F.col("cur").alias("cur2"), F.col("low").alias("low2"))
        ahead = hop.join(to, "cur").select("node", F.col("cur2").alias("cur"), F.col("low2").alias("low"))
        # an aggregation, as a computed column would carry its history along as a constraint
        nxt = cut(hop.select("node", F.lit(None).cast("string").alias("cur"), "low").unionByName(ahead).groupBy("node").agg(F.max("cur").alias("cur"), F.min("low").alias("low")))
        if nxt.join(hop.select("node", F.col("low").alias("was")), "node").filter("low <> was").isEmpty():
            return nxt.select("node", "low")
        hop = nxt


def _many(links: DataFrame, every: int) -> DataFrame:
    known = links.filter("parent is not null")
    least = links.groupBy("node").agg(F.min("parent").alias("parent"))
    plain = cut(_single(least, every))
    on = plain.filter("kind = 'cycle'").select("node")
    low = _cycle_names(on.join(least, "node").select("node", F.col("parent").alias("cur")))
    name = lambda c: low.select(F.col("node").alias(c), F.col("low").alias(f"{c}_low"))
    small = known.join(name("node"), "node", "left").join(name("parent"), "parent", "left").select(F.coalesce("node_low", "node").alias("node"), F.coalesce("parent_low", "parent").alias("parent"))
    loops = _squared(small.filter("node <> parent").distinct()).filter("ancestor = node").select("node")
    # a loop over a contracted one holds its name; its nodes are on a loop anyway
    looped = cut(on.unionByName(loops).unionByName(known.filter("node = parent").select("node")).distinct())
    free = known.join(looped, "node", "left_anti").join(looped.select(F.col("node").alias("parent")), "parent", "left_anti")
    nodes = links.select("node").unionByName(known.select(F.col("parent").alias("node"))).distinct()
    roots = nodes.join(known.select("node").distinct(), "node", "left_anti")
    up = _squared(free.select("node", "parent"))
    clean = cut(up.join(roots.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node").unionByName(roots).distinct())
    chosen = free.join(clean, "node", "left_semi").join(clean.select(F.col("node").alias("parent")), "parent", "left_semi").groupBy("node").agg(F.min("parent").alias("parent"))
    tree = _single(chosen.unionByName(roots.select("node", F.lit(None).cast("string").alias("parent"))), every)
    rest = nodes.join(clean, "node", "left_anti").join(looped.withColumn("on", F.lit(True)), "node", "left")
    return tree.unionByName(rest.select("node", F.when(F.col("on"), "cycle").otherwise("below").alias("kind"), F.lit(None).cast("array<string>").alias("path")))


def _single(links: DataFrame, every: int) -> DataFrame:
    """``resolve`` for links with one parent per node at most."""
    links = links.groupBy("node").agg(F.min("parent").alias("parent"))
    links = cut(links.unionByName(links.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")).filter("node is not null").distinct())
                .groupBy("node").agg(F.max("parent").alias("parent")))
    # a root has no parent; it is marked by an empty pointer prefix, so that a walk sees at once where it stands
    roots = links.filter("parent is null").select("node")
    tagged = links.filter("parent is not null").join(roots.select(F.col("node").alias("parent"), F.lit(True).alias("top")), "parent", "left")
    root_mark, split_mark = F.lit("r"), F.when(F.pmod(F.xxhash64("parent"), F.lit(every)) == 0, F.lit("s")).otherwise(F.lit("n"))
    mark = F.when(F.col("top"), root_mark).otherwise(split_mark)
    # node names carry their mark (r: root, s: splitter, n: neither) in front
    own = F.when(F.pmod(F.xxhash64("node"), F.lit(every)) == 0, F.lit("s")).otherwise(F.lit("n"))
    state = tagged.select(F.concat(own, "node").alias("node"), F.concat(mark, "parent").alias("cur"), F.array("node").alias("path"))
    rest = F.substring("cur", 1, 1) != "n"
    walked, lost = _double(state.withColumn("done", rest), rest)
    reduced = walked.filter(F.col("node").startswith("s"))
    at_root = F.col("cur").startswith("r")
    solved, circling = _double(reduced.withColumn("done", at_root), at_root)
    ends = solved.select(F.col("node").alias("cur"), F.col("cur").alias("cur2"), F.col("path").alias("path2"), F.lit(True).alias("found"))
    joined = walked.join(ends, "cur", "left")
    ok = at_root | F.coalesce("found", F.lit(False))
    up = F.concat("path", F.coalesce("path2", F.array().cast("array<string>")), F.array(F.expr("substring(coalesce(cur2, cur), 2)")))
    tree = joined.filter(ok).select(F.expr("substring(node, 2)").alias("node"), F.reverse(up).alias("path"))
    bad = cut(lost.select("node").unionByName(joined.filter(~ok).select("node")))
    kinds = _kinds(bad, state)
    tree = tree.unionByName(roots.select("node", F.array("node").alias("path")))
    return tree.select("node", F.lit("tree").alias("kind"), "path").unionByName(
        kinds.select(F.expr("substring(node, 2)").alias("node"), "kind", F.lit(None).cast("array<string>").alias("path")))


def _kinds(bad: DataFrame, state: DataFrame) -> DataFrame:
    """cycle or below for nodes that reach no root. The nodes hit after 2**k steps only get fewer; once their number
    stays, steps permute them, so all of them lie on cycles, and no node of a cycle is ever missing."""
    hop = cut(bad.join(state.select("node", "cur"), "node"))
    ends = hop.select("cur").distinct()
    left = ends.count()
    while left:
        hop = cut(hop.join(hop.select(F.col("node").alias("cur"), F.col("cur").alias("cur2")), "cur").select("node", F.col("cur2").alias("cur")))
        ends = hop.select("cur").distinct()
        now = ends.count()
        if now == left:
            break
        left = now
    on = ends.select(F.col("cur").alias("node"), F.lit(True).alias("on"))
    return bad.join(on, "node", "left").select("node", F.when(F.col("on"), F.lit("cycle")).otherwise(F.lit("below")).alias("kind"))


def closure(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """ancestor, node, distance (0: itself) for nodes of trees, over all their parents, by the shortest way.

    resolved: ``resolve`` of the links. A single parent's ancestors stand in the path; only several parents are doubled."""
    links = links.filter("node is not null").select("node", "parent").distinct()
    if not several(links):
        return descendants(resolved)
    tree = cut(resolved.filter("kind = 'tree'").select("node"))
    edges = links.filter("parent is not null").join(tree, "node", "left_semi").join(tree.select(F.col("node").alias("parent")), "parent", "left_semi")
    return _squared(edges.select("node", "parent")).unionByName(tree.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("distance")))


def descendants(resolved: DataFrame) -> DataFrame:
    """ancestor, node, distance (0: itself) along the paths of the nodes of trees."""
    up = resolved.filter("kind = 'tree'").select("node", F.posexplode(F.reverse("path")).alias("distance", "ancestor"))
    return up.select("ancestor", "node", "distance")


def summary(resolved: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """node, kind, depth (root 0) and root of its path, and the number of descendants, over all parents if given the links."""
    below = (descendants(resolved) if links is None else closure(links, resolved)).filter("distance > 0").groupBy(F.col("ancestor").alias("a_")).agg(F.count(F.lit(1)).alias("n"))
    tree = F.col("kind") == "tree"
    out = resolved.join(below, F.col("node") == F.col("a_"), "left")
    return out.select("node", "kind", F.when(tree, F.size("path") - 1).alias("depth"), F.when(tree, F.col("path")[0]).alias("root"),
                      F.when(tree, F.coalesce("n", F.lit(0)).cast("bigint")).alias("n_descendants"))
