from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.operators import hierarchy as h

SCHEMA = "scope string, node string, parent string"


def brute(links):
    up = {}
    for s, n, p in links:
        if n is not None and p is not None:
            up[s, n] = min(p, up.get((s, n), p))
    out = {}
    for s, n in up:
        path, at = [n], n
        while (s, at) in up:
            at = up[s, at]
            if at in path:
                path = None
                break
            path.append(at)
        out[s, n] = (None, -1, None) if path is None else (path[-1], len(path) - 1, tuple(reversed(path)))
    return out


def solve(spark, links):
    rows = h.contract(spark.createDataFrame(links, SCHEMA), paths=True).collect()
    assert len({(r.scope, r.node) for r in rows}) == len(rows)
    return {(r.scope, r.node): (r.root, r.depth, tuple(r.path) if r.path else None) for r in rows}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 25).map(str), st.integers(0, 25).map(str)), max_size=60))
def test_random(spark, links):
    assert solve(spark, links) == brute(links)


def test_long_chain_star_and_loops(spark):
    chain = [("c", f"{i:04d}", f"{i + 1:04d}") for i in range(150)]
    star = [("s", f"leaf{i}", "hub") for i in range(200)] + [("s", "hub", "top")]
    loops = [("l", "a", "b"), ("l", "b", "c"), ("l", "c", "a"), ("l", "x", "a"), ("l", "y", "x"), ("l", "self", "self"), ("l", "z", "self")]
    nulls = [("n", None, "a"), ("n", "a", None), (None, "a", "b"), ("", "a", "b"), ("n", "", "x")]
    links = chain + star + loops + nulls + chain[:5]
    assert solve(spark, links) == brute(links)


def test_empty_and_clashing_columns(spark):
    assert solve(spark, []) == {}
    df = spark.createDataFrame([("s", "a", "b", 1, 2, 3)], SCHEMA + ", up int, w int, act int")
    assert [(r.node, r.root, r.depth) for r in h.contract(df).collect()] == [("a", "b", 1)]


def test_closure_and_counts(spark):
    links = [("s", "b", "a"), ("s", "c", "b"), ("s", "d", "b"), ("s", "x", "y"), ("s", "y", "x")]
    got = h.contract(spark.createDataFrame(links, SCHEMA), paths=True)
    assert {(r.ancestor, r.node, r.distance) for r in h.closure(got).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}
    assert {(r.ancestor, r.n_descendants, r.n_children, r.height) for r in h.descendant_counts(got).collect()} == {("a", 3, 1, 2), ("b", 2, 2, 1)}


def test_decisions_that_stand(spark):
    rows = [("v", "k", "2", "approve", " L ", "P"), ("v", "k", "1", "approve", "L", "old"), ("v", "j", "1", "approve", " ", " Q "), ("v", "r", "1", "reject", "R", "P"), ("v", "n", None, "approve", None, " ")]
    df = spark.createDataFrame(rows, "vertical_id string, key string, event_id string, decision string, label string, broader string")
    assert {tuple(r) for r in h.decision_links(df).collect()} == {("v", "l", "p"), ("v", "j", "q")}


def test_hot_parents_are_split_off(spark, monkeypatch):
    from weftline.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 40)
    links = [("s", f"n{i}", "hub" if i % 2 else f"n{i + 1}") for i in range(200)] + [("s", "hub", "top"), ("s", "n200", "hub")]
    assert solve(spark, links) == brute(links)
