import random

import pytest

from termloom.operators import hierarchy as T


def brute(links):
    up = {}
    for n, p in links:
        if n is not None:
            up[n] = min((x for x in (up.get(n), p) if x is not None), default=None)
    for p in list(up.values()):
        if p is not None:
            up.setdefault(p, None)
    out = set()
    for n in up:
        path, x = [n], up[n]
        while x is not None and x not in path:
            path.append(x)
            x = up[x]
        if x is None:
            out.add((n, "tree", tuple(reversed(path))))
        else:
            out.add((n, "cycle" if x == n else "below", None))
    return out


@pytest.mark.parametrize("every", [1, 3, 1000])
def test_against_brute_force(spark, every):
    random.seed(every)
    links = [(f"n{i}", f"n{random.randrange(max(0, i - 4), i)}" if i else None) for i in range(150)]
    links += [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [(f"b{i}", f"c{i % 9}" if i < 5 else f"b{i - 5}") for i in range(20)]
    links += [("self", "self"), ("under", "self"), ("lone", None), ("kid", "nowhere"), (None, "n1"), ("n9", "n8"), ("n9", "n8"), ("x", "y"), ("y", "x")]
    links += [(f"deep{i}", f"deep{i - 1}") for i in range(1, 90)]
    got = T.resolve(spark.createDataFrame(links, "node string, parent string"), every)
    assert {(r["node"], r["kind"], tuple(r["path"]) if r["path"] else None) for r in got.collect()} == brute(links)


def test_summary_and_closure(spark):
    r = T.resolve(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("z", "z")], "node string, parent string"))
    assert {tuple(x) for x in T.summary(r).collect()} == {("a", "tree", 0, "a", 3), ("b", "tree", 1, "a", 1), ("c", "tree", 2, "a", 0), ("d", "tree", 1, "a", 0), ("z", "cycle", None, None, None)}
    assert {tuple(x) for x in T.descendants(r).filter("distance > 0").collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


def brute_many(links):
    """kind and ancestors of every node over all parents."""
    up = {}
    for n, p in links:
        up.setdefault(n, set()).update({p} - {None})
        up.setdefault(p, set()) if p else None
    anc = {}
    for n in up:
        seen, todo = {}, [(p, 1) for p in up[n]]
        while todo:
            p, k = todo.pop(0)
            if p not in seen:
                seen[p] = k
                todo += [(q, k + 1) for q in up[p]]
        anc[n] = seen
    loop = {n for n in up if n in anc[n]}
    clean = set()
    while True:
        more = {n for n in up if n not in loop and n not in clean and (not up[n] or up[n] & clean)}
        if not more:
            break
        clean |= more
    kind = {n: "cycle" if n in loop else "tree" if n in clean else "below" for n in up}
    path = {}

    def walk(n):
        if n not in path:
            ps = sorted(p for p in up[n] if p in clean)
            path[n] = (*walk(ps[0]), n) if ps else (n,)
        return path[n]

    def near(n):
        seen, todo = {}, [(p, 1) for p in up[n] & clean]
        while todo:
            p, k = todo.pop(0)
            if p not in seen:
                seen[p] = k
                todo += [(q, k + 1) for q in up[p] & clean]
        return seen

    return {(n, k, walk(n) if k == "tree" else None) for n, k in kind.items()}, {(a, n, k) for n in clean for a, k in near(n).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_several_parents(spark, seed):
    random.seed(seed)
    links = [("b", None), ("a", None), ("c", "a"), ("c", "b"), ("d", "c"), ("l1", "l2"), ("l2", "l1"), ("l1", "a"), ("e", "l1"), ("e", "b"), ("f", "e"), ("g", "l2"), ("z", "l2"), ("l1", "z"), ("s", "s"), ("s", "a"), ("t", "s"),
             ("p", "a"), ("q", "p"), ("p", "q"), ("r", "q"), ("r", "b")]
    links += [(f"n{i}", f"n{random.randrange(max(0, i - 9), i)}") for i in range(1, 40) for _ in range(random.choice([1, 1, 2, 3]))] + [("n3", "n30")] * seed
    df = spark.createDataFrame(links, "node string, parent string")
    r = T.resolve(df)
    kinds, pairs = brute_many(links)
    assert {(x["node"], x["kind"], tuple(x["path"]) if x["path"] else None) for x in r.collect()} == kinds
    assert {tuple(x) for x in T.closure(df, r).filter("distance > 0").select("ancestor", "node", "distance").collect()} == pairs


def test_empty(spark):
    assert T.resolve(spark.createDataFrame([], "node string, parent string")).count() == 0
