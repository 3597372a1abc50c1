"""Operators under keys that hold a great share of the rows, against the plain rule."""

import json
import math
import random
import time

from pyspark.sql import GroupedData

from weftline.operators import ranking, vocabulary
from weftline.sources import rdf
from weftline.streaming import folds

QUAD = "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"


def quads(spark):
    r = random.Random(5)
    rows = [("g", "http://s/hot", "uri", f"http://p/{r.randrange(3)}", f"v {i} \"x\"\n\\", "literal", [None, "http://d"][i % 2], None) for i in range(40)]
    rows += [("g", "http://s/hot", "uri", "http://p/0", f"http://o/{i}", "uri", None, None) for i in range(20)]
    rows += [(f"h{i % 3}", f"_:b{i}", "bnode", "http://p/1", "x", "literal", None, "en") for i in range(60)]
    return rows, spark.createDataFrame(rows + rows[:30], QUAD)


def test_large_subjects_are_written_in_blocks(spark):
    rows, df = quads(spark)
    blocks = rdf.turtle(df, 7)
    assert blocks.where("s = 'http://s/hot'").count() > 3 and blocks.where("s <> 'http://s/hot'").selectExpr("max(part)").first()[0] == 0
    back = rdf.parse_turtle(blocks.select("graph_id", "text"))
    assert {tuple(r) for r in back.collect()} == set(rows)
    assert [tuple(r) for r in rdf.turtle(df).select("graph_id", "s", "part").where("part > 0").collect()] == []
    said = set()
    for r in rdf.jsonld(df, 7).collect():
        node = json.loads(r.text)
        for p, many in node.items():
            said |= set() if p == "@id" else {(r.graph_id, node["@id"], p, o.get("@value", o.get("@id"))) for o in many}
    assert said == {(q[0], q[1], q[3], q[4]) for q in rows}


def plainly(rows, budget, size):
    """The pages of one site, chosen from all of its candidates."""
    ranks = {k: i for i, k in enumerate(ranking.KIND_SHARES)}
    merit = lambda r: 3 * min(r["missing"], 3) + min(r["known"], 5) + min(math.log2(1 + r["inlinks"]), 3.0)
    left, taken, out = list(rows), {}, []
    room = {k: max(1, int(budget * s)) for k, s in ranking.KIND_SHARES.items()}
    while left and len(out) < size:
        fits = [r for r in left if room[r["kind"]] > 0] or left
        best = min(fits, key=lambda r: (ranks[r["kind"]], taken.get(r["section"], 0) - merit(r), r["ord"], r["url"]))
        left.remove(best)
        taken[best["section"]] = taken.get(best["section"], 0) + 1
        room[best["kind"]] -= 1
        out.append(best["url"])
    return out


def test_frontier_of_a_large_site(spark):
    r = random.Random(7)
    made = [dict(site="hot" if r.random() < 0.5 else f"s{r.randrange(6)}", url=f"u{i:04}", kind=r.choice(["docs", "product", "other", "pricing"]), section=f"x{int(r.random() ** 2 * 60)}", missing=r.choice([0, 0, 1, 4]), known=r.randrange(7), inlinks=r.choice([0, 1, 3, 40]), ord=r.randrange(50)) for i in range(1200)]
    df = spark.createDataFrame([tuple(m.values()) for m in made], "site string, url string, kind string, section string, missing int, known int, inlinks int, ord int")
    for budget, size in ((10, 5), (3, 12)):
        got = {}
        for row in ranking.frontier(df, "site", budget, size).orderBy("site", "place").collect():
            got.setdefault(row.site, []).append(row.url)
        assert got == {s: plainly([m for m in made if m["site"] == s], budget, size) for s in {m["site"] for m in made}}


def test_references_in_blocks(spark):
    r = random.Random(9)
    vec = lambda: [r.uniform(-1, 1) for _ in range(6)]
    asked = spark.createDataFrame([(i, vec()) for i in range(40)] + [(99, [0.0] * 6), (98, None)], "vec_id int, embedding array<double>")
    refs = spark.createDataFrame([(f"r{i:02}", vec()) for i in range(23)] + [("zero", [0.0] * 6)], "ref string, vector array<double>")
    want = sorted(map(repr, vocabulary.top_two(asked, refs).collect()))
    assert len(want) == 40 and sorted(map(repr, vocabulary.top_two(asked, refs, block=5).collect())) == want
    assert vocabulary.top_two(asked, refs.where("ref = 'r01'")).where("runner_up is not null").count() == 0


def test_long_forms_are_found(spark):
    forms = spark.createDataFrame([("one two three four five six seven eight nine", "c1"), ("three four", "c2")], "form string, concept_id string")
    texts = spark.createDataFrame([(1, "Zero one, two three four five six seven eight nine ten."), (2, None)], "id int, text string")
    assert {(r.id, r.concept_id) for r in vocabulary.occurrences(texts, ["id"], forms).collect()} == {(1, "c1"), (1, "c2")}


def test_streamed_blocks_in_many_batches(spark, tmp_path, monkeypatch):
    """Each batch knows what all earlier ones showed, without Python for each block; null pages and texts are left out."""
    pages = [(p, f"s{p % 2}" if p % 7 else None, f"Block {p % 3} of all\nBlock {p % 3} of all\r\nOnly page {p}\nshort") for p in range(24)] + [(None, "s0", "Block 0 of all"), (24, "s0", None)]
    for i in range(0, len(pages), 2):
        spark.createDataFrame(pages[i : i + 2], "doc_id bigint, source string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        time.sleep(0.02)
    # a block has a line or two, so a call of Python for each is most of the work
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    stream = folds.read_table(spark, f"file://{tmp_path}/t", files=2)
    got = folds.repeated_blocks(stream, "source", "doc_id", "text")
    rows = got.collect()
    shown, n = {}, 0
    for r in rows:
        shown.setdefault((r.site, r.key), {}).setdefault(r.page, set()).add(r.dropped)
    for held in shown.values():
        assert all(len(v) == 1 for v in held.values()) and sum(not v.pop() for v in held.values()) == min(2, len(held))
    assert len(rows) == 24 * 3 and got.where("page is null").count() == 0
