import random

from weftline.operators import snapshots as s

SCHEMA = "g string, k string, q string, v string"


def brute(rows, chain):
    sets = {}
    for g, k, q, v in rows:
        sets.setdefault(g, {}).setdefault((k, q), set()).add(v)
    out = set()
    for g, before in chain:
        if before is None:
            continue
        new, old = sets.get(g, {}), sets.get(before, {})
        for key in {*new, *old}:
            if key not in old:
                out.add((g, *key, "added"))
            elif key not in new:
                out.add((g, *key, "removed"))
            elif new[key] != old[key]:
                out.add((g, *key, "changed"))
    return out


def solve(spark, rows, chain, bits=None):
    df = spark.createDataFrame(rows, SCHEMA)
    ch = spark.createDataFrame(chain, "g string, earlier string")
    got = [tuple(r) for r in s.diff_snapshots(df, ch, "g", ["k", "q"], "v", bits).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(f"g{r.randrange(5)}", r.choice("abcdefgh") + str(r.randrange(9)), r.choice(["p", "q", None]), r.choice(["1", "2", "", None])) for _ in range(900)]
    rows += rows[:50]
    chain = [("g0", None), ("g1", "g0"), ("g2", "g1"), ("g3", "g2"), ("empty", "g3"), ("g4", "empty")]
    for bits in (None, 4, 12):
        assert solve(spark, rows, chain, bits) == brute(rows, chain)


def test_edges(spark):
    assert solve(spark, [], [("a", None), ("b", "a")]) == set()
    same = [("a", "k", "p", "1"), ("b", "k", "p", "1"), ("b", "k", "p", "1")]
    assert solve(spark, same, [("a", None), ("b", "a")]) == set()
    assert solve(spark, [("a", None, None, None)], [("a", None), ("b", "a")]) == {("b", None, None, "removed")}
    hot = [("a", "k", "p", str(i)) for i in range(500)] + [("b", "k", "p", str(i)) for i in range(1, 501)]
    assert solve(spark, hot, [("a", None), ("b", "a")]) == {("b", "k", "p", "changed")}


def test_chain(spark):
    g = spark.createDataFrame([("https://h/audit/2", "run"), ("https://h/audit/1", "run"), ("https://h/audit/1", "run"), ("https://h/x/1", "run"), (None, "run"), ("https://h/audit/3", "ontology")], "graph_id string, kind string")
    assert {(r.graph_id, r.earlier) for r in s.run_chain(g).collect()} == {("https://h/audit/1", None), ("https://h/audit/2", "https://h/audit/1")}


def test_large_snapshots_are_split_off(spark, monkeypatch):
    from weftline.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 60)
    r = random.Random(2)
    rows = [(f"g{0 if r.random() < 0.6 else r.randrange(4)}", str(r.randrange(80)), "p", str(r.randrange(3))) for _ in range(700)]
    chain = [("g0", None), ("g1", "g0"), ("g2", "g1"), ("g3", "g2")]
    monkeypatch.setattr(s, "SENT_SNAPSHOTS", 0)
    for bits in (None, 8):
        assert solve(spark, rows, chain, bits) == brute(rows, chain)
