import random
from collections import defaultdict

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.llm import groups, terms


def brute(pairs):
    seen, weight, records = set(), defaultdict(int), defaultdict(set)
    for t, r, p, w in sorted(pairs, key=str):
        if t is None:
            continue
        weight[t] += 0
        if (t, r, p) not in seen:
            seen.add((t, r, p))
            weight[t] += w or 0
        if r is not None:
            records[t].add(r)
    return {t: (w, len(records[t])) for t, w in weight.items()}


def test_terms(spark):
    r = random.Random(4)
    pairs = [("hot" if r.random() < 0.5 else f"t{r.randrange(9)}", r.choice([None, *"abcdefgh"]), str(i), r.choice([None, 1, 5])) for i in range(3000)]
    pairs += [(None, "a", "x", 1), ("", "a", "x", 2)] + pairs[:100]
    df = spark.createDataFrame(pairs, "term string, record string, part string, weight int").repartition(7)
    got = {x.term: (x.occurrences, x.records) for x in terms.term_frequencies(df).collect()}
    assert got == brute(pairs)
    assert terms.term_frequencies(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([None, "x", "y"]), st.sampled_from("pq"), st.integers(0, 3)), max_size=30), st.integers(1, 7))
def test_scan_over_batches(rows, size):
    rows = sorted({(t, r, p): w for t, r, p, w in rows}.items(), key=lambda x: (x[0][0], x[0][1] or "", x[0][2]))
    rows = [(*k, w) for k, w in rows]
    cols = lambda part: [pa.array(c, k) for c, k in zip(zip(*part), (pa.string(), pa.string(), pa.string(), pa.int64()))]
    batches = [pa.RecordBatch.from_arrays(cols(rows[i : i + size]), ["term", "record", "part", "weight"]) for i in range(0, len(rows), size)]
    got = {}
    for b in terms._scan(iter(batches)):
        for x in b.to_pylist():
            assert x["term"] not in got
            got[x["term"]] = (x["occurrences"], x["inner"] + len(x["edges"]))
    assert got == brute(rows)


def test_marks(spark):
    f = "array<struct<key: string, forms: map<string,int>, labels: map<string,int>, mentions: int, pages: int, target: string, method: string>>"
    form = lambda k, p: (k, None, None, 1, p, None, None)
    rows = [(1, "A.example", [form(" K ", 2), form("k", 3), form(" ", 9)]), (1, "A.example", [form(" K ", 2), form("k", 3), form(" ", 9)]), (2, " a.example ", [form("k", None)]), (3, None, [form("k", 1)]), (4, "b", None), (5, "c", [form("k", 1)]), (6, "d", [form("k", 1)]), (None, "d", [form("z", 1)])]
    df = spark.createDataFrame(rows, f"observation_id bigint, domain string, forms {f}")
    assert {tuple(r) for r in terms.observed_term_marks(df).collect()} == {("k", 8, 3, "common"), ("z", 1, 1, "rare")}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 40).map(str), st.integers(0, 40).map(str)), max_size=45))
def test_groups(spark, links):
    check_groups(spark, links)


def check_groups(spark, links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            up[find(a)] = find(b)
    sets = defaultdict(set)
    for x in list(up):
        sets[find(x)].add(x)
    want = {x: min(s) for s in sets.values() if len(s) > 1 for x in s}
    got = groups.connected_groups(spark.createDataFrame(links, "a string, b string")).collect()
    assert len(got) == len(want) and {r.id: r.group_id for r in got} == want


def test_chains_stars_loops(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(100)]
    star = [("zz-hub", f"s{i}") for i in range(100)]
    check_groups(spark, chain + star + [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("self", "self"), (None, "x"), ("x", None)] + chain[:3])
    check_groups(spark, [])


def test_hot_members_are_split_off(spark, monkeypatch):
    from weftline.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 40)
    check_groups(spark, [("hub", f"s{i}") for i in range(120)] + [(f"s{i}", f"t{i}") for i in range(60)] + [("x", "y")])
