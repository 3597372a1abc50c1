"""Relations between a page's subject and the terms of a vocabulary, with the sentence that proves each.

The rules are data: a rule names a predicate, the kinds of term it takes, the
cues its sentence may or must have, and the confidence with and without one. A
sentence holds every term that stands in it as whole words. The first evidence
of a triple stands: by rule, then sentence, then term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as vocab

#: A sentence must be longer, evidence is cut to the second, an object has at least the third number of characters.
SENTENCE, EVIDENCE, OBJECT = 12, 160, 3


@dataclass(frozen=True)
class Rule:
    predicate: str
    kinds: tuple[str, ...]
    cues: tuple[str, ...] = ()
    required: bool = False
    cued: float = 0.9
    uncued: float = 0.8


#: Which kinds of concept stand for which relation, and the words that speak for it (fixed values).
RULES = (
    Rule("automates", ("process",), ("automat", "streamlin", "eliminat", "workflow"), False, 0.90, 0.80),
    Rule("compliesWith", ("standard",), ("complian", "comply", "audit", "evidence", "certif", "standard"), True, 0.95),
    Rule("supportsPricingModel", ("pricing",), ("price", "pricing", "plan", "billing", "costs", "tier"), False, 0.90, 0.80),
    Rule("hasFeature", ("feature",), ("feature", "module", "support", "offer", "include"), False, 0.85, 0.78),
    Rule("covers", ("domain",), ("manage", "handle", "record", "report"), True, 0.80),
)


def sentences(docs: DataFrame, key: str, text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried..., sent, sentence) of every sentence longer than SENTENCE characters; a line end ends a sentence as a mark does."""
    parts = F.split(F.regexp_replace(F.col(text), r"([.!?\n])\s+", "$1\u0001"), "\u0001")
    rows = docs.where(F.col(text).isNotNull()).select(key, *carried, F.posexplode(parts).alias("sent", "sentence")).withColumn("sentence", F.trim(F.regexp_replace("sentence", r"\s+", " ")))
    return rows.where(F.length("sentence") > SENTENCE)


def _any(sentence: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(sentence, F.lit(cue))
    return out


def triples(docs: DataFrame, key: str, forms: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(key, predicate, object, confidence, evidence) of each relation that a text states, each once.

    ``forms`` has concept_id, kind, form; the object is the concept. Terms within longer terms of the same sentence
    are left out. Null texts state nothing.
    """
    told = sentences(docs, key, text)
    found = vocab.occurrences(told, [key, "sent"], forms.select("form", "concept_id", "kind").distinct(), "sentence")
    kept = vocab.without_parts(found.select(key, "sent", "form").distinct(), [key, "sent"])
    matched = kept.join(forms.select("form", "concept_id", "kind").distinct(), "form").join(told, [key, "sent"])
    low = F.lower("sentence")
    made = F.array(*[
        F.when(F.col("kind").isin(*r.kinds) & (_any(low, r.cues) if r.required else F.lit(True)), F.struct(F.lit(i).alias("rule"), F.lit(r.predicate).alias("predicate"), F.when(_any(low, r.cues), r.cued).otherwise(r.uncued).alias("confidence")))
        for i, r in enumerate(rules)
    ])
    each = matched.select(key, "sent", "concept_id", "form", "sentence", F.explode(F.filter(made, lambda m: m.isNotNull())).alias("m"))
    each = each.where(F.length("form") >= OBJECT)
    first = F.min_by(F.struct(F.col("m.confidence").alias("confidence"), F.substring("sentence", 1, EVIDENCE).alias("evidence")), F.struct("m.rule", "sent", "form"))
    return each.groupBy(key, F.col("m.predicate").alias("predicate"), F.col("concept_id").alias("object")).agg(first.alias("f")).select(key, "predicate", "object", F.round("f.confidence", 2).alias("confidence"), "f.evidence")
