"""The fold of registry events against one that walks the log event by event."""

import random

from weftline.operators import registry as R
from weftline.operators import registry_events as E


def walk(seed, events):
    """The same rules, one event after the other."""
    state, split, conflicts, blocked = {}, set(), set(), {}
    for s in seed:
        state[s["id"]] = {**s, "aliases": {a.lower(): (a, "seed") for a in s["aliases"]}, "domains": set(s["domains"]), "distinct": set(s["distinct_from"]), "external": dict(s["external"])}
    events = sorted({repr(e): e for e in events}.values(), key=lambda e: e["event_id"])
    for e in events:
        if e["type"] in ("distinct_from_added", "unmerged") and e["actor"] == "reviewer" and (e["other"] or e["into"]):
            split.add(frozenset((e["entity_id"], e["other"] or e["into"])))
    for e in events:
        t, i, actor = e["type"], e["entity_id"], e["actor"] or "automation"
        me = state.get(i)
        if t == "entity_created":
            d = e["entity"]
            state.setdefault(d["id"], {"id": d["id"], "kind": d["kind"], "preflabel": d["preflabel"], "status": d["status"] or ("candidate" if actor == "automation" else "active"), "merged_into": None, "aliases": {a.lower(): (a, actor) for a in d["aliases"]}, "domains": set(d["domains"]), "distinct": set(), "external": {}})
        elif me is None:
            if t == "blocked_key_added":
                blocked[e["key"]] = e["reason"] or ""
            elif t == "blocked_key_removed":
                blocked.pop(e["key"], None)
            else:
                conflicts.add(e["event_id"])
        elif t == "alias_added":
            me["aliases"].setdefault(e["form"].lower(), (e["form"], actor))
        elif t == "alias_removed":
            me["aliases"].pop(e["form"].lower(), None)
        elif t == "merged":
            if e["into"] not in state or e["into"] == i or (actor != "reviewer" and frozenset((i, e["into"])) in split):
                conflicts.add(e["event_id"])
            else:
                me["status"], me["merged_into"] = "merged", e["into"]
        elif t == "unmerged":
            if me["status"] == "merged":
                me["status"], me["merged_into"] = "active", None
        elif t == "distinct_from_added":
            me["distinct"].add(e["other"])
            if e["other"] in state:
                state[e["other"]]["distinct"].add(i)
        elif t == "external_linked":
            me["external"][e["system"]] = e["value"]
        elif t == "domain_added":
            me["domains"].add(e["domain"].strip().lower())
        elif t == "domain_removed":
            me["domains"].discard(e["domain"].strip().lower())
        elif t == "promoted":
            me["status"] = "active" if me["status"] == "candidate" else me["status"]
        elif t == "rejected":
            me["status"] = "rejected"
        else:
            conflicts.add(e["event_id"])
    for me in state.values():
        if me["status"] == "merged" and me["merged_into"] and (me["merged_into"] in me["distinct"] or me["id"] in state[me["merged_into"]]["distinct"]):
            me["status"], me["merged_into"] = "active", None
    return state, blocked, conflicts


FIELDS = "event_id type actor entity_id entity form into other system value domain key reason".split()


def check(spark, seed, events):
    rows = [tuple((lambda v: tuple(v[k] for k in ("id", "kind", "preflabel", "status", "aliases", "domains")) if isinstance(v, dict) else v)(e[f]) for f in FIELDS) for e in events]
    got = E.fold_events(spark.createDataFrame([tuple(s[k] for k in ("id", "kind", "preflabel", "status", "merged_into", "aliases", "domains", "distinct_from", "external")) for s in seed], E.SEED), spark.createDataFrame(rows, E.EVENT))
    state, blocked, conflicts = walk(seed, events)
    assert sorted((r.id, r.status, r.merged_into) for r in got.entities.collect()) == sorted((i, s["status"], s["merged_into"]) for i, s in state.items())
    assert sorted((r.id, r.form, r.source) for r in got.aliases.collect()) == sorted((i, *a) for i, s in state.items() for a in s["aliases"].values())
    assert sorted((r.id, r.domain) for r in got.domains.collect()) == sorted((i, d) for i, s in state.items() for d in s["domains"])
    assert sorted((r.id, r.system, r.value) for r in got.external.collect()) == sorted((i, k, v) for i, s in state.items() for k, v in s["external"].items())
    assert sorted((r.id, r.other) for r in got.distinct.collect()) == sorted((i, o) for i, s in state.items() for o in s["distinct"])
    assert {r.key: r.reason for r in got.blocked.collect()} == blocked and {r.event_id for r in got.conflicts.collect()} == conflicts


def test_against_the_walk(spark):
    r = random.Random(3)
    seed = [dict(id=f"s{i}", kind="product", preflabel=f"S{i}", status=["active", "candidate", None][i % 3], merged_into=None, aliases=["Uno", "Due"][: i % 3], domains=["a.example"][: i % 2], distinct_from=["s0"] if i == 2 else [], external={"q": "1"} if i == 1 else {}) for i in range(4)]
    for s in seed:
        s["status"] = s["status"] or "active"
    ids = [f"s{i}" for i in range(4)] + [f"n{i}" for i in range(6)] + ["ghost"]
    events = []
    for n in range(700):
        t = r.choice([*E.TYPES, *E.TYPES, "merged", "unmerged", "entity_created", *E.BLOCKING, "odd"])
        e = dict.fromkeys(FIELDS)
        e |= {"event_id": f"e{r.randrange(10**9):09}", "type": t, "actor": r.choice(["reviewer", "automation", "automation", None]), "entity_id": r.choice(ids)}
        if t == "entity_created":
            i = r.choice(ids[4:-1])
            e |= {"entity_id": None, "entity": dict(id=i, kind="product", preflabel=i.upper(), status=r.choice([None, None, "active"]), aliases=r.sample(["Uno", "DUE"], r.randrange(3)), domains=[])}
        elif t.startswith("alias"):
            e["form"] = r.choice(["uno", "UNO", "due", "Tre"])
        elif t in ("merged", "unmerged"):
            e["into"] = r.choice(ids)
        elif t == "distinct_from_added":
            e["other"] = r.choice([i for i in ids if i != e["entity_id"]])
            if r.random() < 0.8:
                e["type"], e["form"] = "alias_added", "quattro"
        elif t == "external_linked":
            e |= {"system": r.choice("pq"), "value": str(n)}
        elif t.startswith("domain"):
            e["domain"] = r.choice([" A.example", "b.example"])
        elif t in E.BLOCKING:
            e |= {"key": r.choice("xyz"), "entity_id": None, "reason": r.choice([None, "junk"])}
        events.append(e)
    check(spark, seed, events + events[:40])


def test_no_events(spark):
    got = E.fold_events(spark.createDataFrame([], E.SEED), spark.createDataFrame([], E.EVENT))
    assert got.entities.count() == got.aliases.count() == got.blocked.count() == got.conflicts.count() == 0


def test_rungs(spark):
    keys = [("a.example", k, d) for k, d in [("learning management system", "learning management system"), ("lms", "LMS"), ("stripe", "Stripe"), ("sage", "Sage"), ("spam term", "Spam Term"), ("card connect", "Card Connect"), ("cardconnect", "CardConnect"), ("customer", "customer"), ("adyen", "Adyen"), ("stripe billing", "Stripe Billing"), ("ab", "AB"), ("alpha beta", "Alpha Beta"), ("amber box", "Amber Box"), ("a", "A")]] + [("b.example", "lms", "LMS"), ("b.example", "x", None)]
    registry = [("stripe", "e1"), ("sage", "e2"), ("sage", "e3"), ("cardconnect", "e4"), ("spam term", "e5"), ("", "e6")]
    got = R.resolve_keys(spark.createDataFrame(keys, "domain string, key string, display string"), spark.createDataFrame(registry, "form string, id string"), spark.createDataFrame([("learning management system", "c1")], "form string, concept_id string"), spark.createDataFrame([("spam term",), ("spam term",)], "key string"))
    found = {(r.domain, r.key): (r.target_kind, r.target, r.method) for r in got.collect()}
    assert len(found) == len(keys)
    at = lambda k, d="a.example": found[d, k]
    assert at("lms") == ("concept", "c1", "acronym") and at("lms", "b.example")[2] == "observed" and at("spam term") == ("mention", "spam term", "blocked")
    assert at("stripe") == ("entity", "e1", "registry") and at("sage")[2] == "ambiguous" and at("card connect") == ("entity", "e4", "spelling") and at("stripe billing") == ("entity", "e1", "suffix")
    assert at("customer")[2] == "mention" and at("adyen") == ("observed", "adyen", "observed") and at("ab")[2] == "observed"
