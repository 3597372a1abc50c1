import os

import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing, spam, tokenizer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(tokenizer.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no vocabulary")


@needs_vocabulary
def test_shares_and_repeats(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 40), "big" if i < 600 else "small" if i < 640 else "other") for i in range(700)] + [(900, None, "big"), (901, "", "small"), (902, "x", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 8), ("none", 0.0, 1), ("absent", 0.2, 3), ("big", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, _ = mixing.mixture(docs, targets)
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and max(r.copies for r in rows if r.source == "big") == 1 and max(r.copies for r in rows if r.source == "small") <= 8
    total = {s: sum(r.n_tokens * r.copies for r in rows if r.source == s) for s in ("big", "small")}
    assert {r.source for r in rows} == {"big", "small"} and abs(total["big"] / sum(total.values()) - 0.7) < 0.01
    assert max(r.copies for r in rows if r.source == "small") - min(r.copies for r in rows if r.source == "small") <= 1


@needs_vocabulary
def test_thresholds_are_nested(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "a" if i < 300 else "b") for i in range(600)], "doc_id bigint, text string, source string")
    used = []
    for share in (0.1, 0.2, 0.4):
        t = spark.createDataFrame([("a", share, 1), ("b", 1 - share, 1)], "source string, target_share double, max_repeats int")
        used.append({r.doc_id for r in mixing.mixture(docs, t)[0].where("source = 'a'").collect()})
    assert used[0] < used[1] < used[2] and abs(len(used[0]) - 300 / 9) <= 1


@needs_vocabulary
def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mixture(docs, targets)
    assert mixed.count() == 0 and [tuple(r) for r in shares.collect()] == [("a", 1.0, 1, 0, 0.0, 0, 0)]
    assert mixing.mixture(docs, targets.limit(0))[0].count() == 0


PROSE = "The board asked for one figure, and we had four of them. After the change it took us three days to close the books, which is why the team likes it. "
SPAM = [
    "best shift planner | cheap shift planner | shift planner online | shift planner tool | shift planner 2025 | shift planner reviews",
    "[shift planner](https://a.example/x)\n[cheap planner](https://b.example/y)\n[planner online](https://c.example/z)",
    "Home > Products > Shift Planner\nHome > Products > Bed Pricing > Reviews\nProducts > Pricing",
    "#ShiftPlanner #BestShiftPlanner #CheapPlanner #PlannerOnline #ShiftPlannerReviews",
    "Why shift planner? Because shift planner means shift planner. Our shift planner is the best shift planner for all your shift planner needs.",
    "SKU-1234 blue Alpha Vault cheap, SKU-9921 seat Beta Desk near me, ART-8122 XL Gamma Flow online",
    "安い shift planner 料金\nshift planner おすすめ 料金\nshift planner 比較 無料\n安い shift planner 比較\nshift planner 料金 無料",
]
GOOD = [PROSE * 3, "Shift planner: It shows who works when and why.\nBed pricing: It tells you what a bed costs per day.\nTenant import: You can bring in your tenants from a file.", '{\n  "id": 12,\n  "type": "shift_planner",\n  "amount": 44.2\n}\n' * 4, "Basic | 98 EUR | yes\nTeam | 245 EUR | no\nCompany | 183 EUR | no",
        "1) Open Account > Planner > Advanced and choose who may see it\n2) Open Account > Pricing > Advanced and choose who may see it", "設定は2分で終わります。料金は利用件数で決まります。変更の履歴は41日間保存されます。", PROSE + "\nHome > Products > Planner", "host: we moved all of our users over one weekend\nguest: and how did it go for the team at the end"]


def test_pages(spark):
    rows = [(i, t, 1.0) for i, t in enumerate(SPAM + GOOD)] + [(100, None, 1.0), (101, "", 1.0), (102, " \n ", 1.0), (103, PROSE + SPAM[0] * 4, 1.0), (104, "x" * 200_000 + " is here", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    got = sorted(r.doc_id for r in spam.keyword_pages(df).collect())
    assert [i for i in got if i != 104] == [*range(len(SPAM)), 103]
    assert spam.keyword_pages(df.limit(0)).count() == 0
    assert spam.keyword_pages(df.unionByName(df)).where(F.col("doc_id") == 0).count() == 2


def test_links_below_sentences(spark):
    """Words alone do not tell what links hold: a long address is one word. A transcript without full stops that says its sentences again is made of sentences."""
    links = PROSE + "\n" + "\n".join(f"https://site{i}.example/{'tenant_import/' * 5}pricing?id={i}" for i in range(12))
    said = "the changes are kept with the hour and the author and the team of pokon began with the cost reports the records that were deleted stay in the archive for days taibi checks each invoice before it is booked taibi checks each invoice before it is booked"
    assert spam.measure(links)[1] >= spam.SURE_SHARE and spam.measure(links)[2] < spam.TOP_WORD
    df = spark.createDataFrame([(1, links), (2, PROSE + "\nhttps://site.example/pricing"), (3, said)], "doc_id bigint, text string")
    assert [r.doc_id for r in spam.keyword_pages(df).collect()] == [1]


def test_repeated_sentences(spark):
    """A keyword sentence said again and again has too many function words and too few phrases to be told by either."""
    once = "Get the best shift planner for your team. "
    two = once + "This is the best shift planner for a shop like yours. "
    rows = [once * 50, two * 25, PROSE + once * 12, "2025 exam routing near me | tax archiving | " * 12, PROSE * 2 + once * 2, PROSE * 2, "And so it was. It is what it is. " * 20]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in spam.keyword_pages(df).collect()) == [0, 1, 2, 3]
