"""N-Triples and Turtle read as quads, and quads written as text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.quads import QUADS
from ..plans.skew import lookup_join

_TERM = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)'
_NT = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*\.\s*$"


def _value(term: Column) -> Column:
    inner = F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\\\\", "\u0002"), r"\\n", "\n"), r'\\"', '"'), "\u0002", r"\\")
    return F.when(term.startswith('"'), plain).when(term.startswith("<"), F.regexp_replace(term, "^<|>$", "")).otherwise(term)


def _kind(term: Column) -> Column:
    return F.when(term.startswith('"'), "literal").when(term.startswith("_:"), "bnode").otherwise("uri")


def parse_ntriples(lines: DataFrame, line: str = "value", graph: Column | None = None) -> DataFrame:
    """Quads of N-Triples lines; empty lines, comments and lines that cannot be read give none."""
    s, p, o = (F.regexp_extract(F.col(line), _NT, i) for i in (1, 2, 3))
    rows = lines.where(F.col(line).rlike(_NT)).select((graph if graph is not None else F.lit("")).alias("graph_id"), s.alias("s0"), p.alias("p0"), o.alias("o0"))
    empty = lambda c: F.nullif(c, F.lit(""))
    o0 = F.col("o0")
    return rows.select("graph_id", _value(F.col("s0")).alias("s"), _kind(F.col("s0")).alias("s_kind"), _value(F.col("p0")).alias("p"), _value(o0).alias("o"), _kind(o0).alias("o_kind"), empty(F.regexp_extract(o0, r'"\^\^<([^>]*)>$', 1)).alias("o_datatype"), empty(F.regexp_extract(o0, r'"@([A-Za-z-]+)$', 1)).alias("o_lang"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Quads of the N-Triples files at a path, each file a graph under its name."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.nt)?$", 1).alias("file"))
    return parse_ntriples(lines, "value", F.col("file"))


def ntriples(quads: DataFrame) -> DataFrame:
    """(graph_id, value): each quad as a line of N-Triples."""
    return quads.select("graph_id", F.concat(term(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang")), F.lit(" .")).alias("value"))


def _escaped(value: Column) -> Column:
    for sign, code in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r")):
        value = F.replace(value, F.lit(sign), F.lit(code))
    return value


def term(value: Column, kind: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    quoted = F.concat(F.lit('"'), _escaped(value), F.lit('"'))
    tail = F.lit("")
    if datatype is not None and lang is not None:
        tail = F.when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).when(lang.isNotNull(), F.concat(F.lit("@"), lang)).otherwise("")
    return F.when(kind == "literal", F.concat(quoted, tail)).when(kind == "bnode", value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write each graph's lines (graph_id, value) under a folder of its own; folders of other graphs stay."""
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").text(path)


def write_ntriples(quads: DataFrame, path: str) -> None:
    """Write each graph's quads as N-Triples under a folder of its own; folders of other graphs stay."""
    write_lines(ntriples(quads), path)


#: Statements of one subject that stand in one block of text; a subject with more has several, which mean the same together.
BLOCK = 10_000


def _in_blocks(quads: DataFrame, block: int) -> DataFrame:
    """The quads with ``part``, the block of their subject that they stand in."""
    sizes = quads.groupBy("graph_id", "s").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
    rows = lookup_join(quads, sizes, ["graph_id", "s"], "left")
    n = F.ceil(F.coalesce("__n", F.lit(1)) / block)
    return rows.withColumn("part", F.when(n > 1, F.pmod(F.xxhash64("p", "o", "o_kind"), n)).otherwise(F.lit(0)).cast("int")).drop("__n")


def turtle(quads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(graph_id, s, part, text): blocks of Turtle for each subject, predicates and objects in order, about ``block`` statements in one."""
    po = F.concat(F.lit("<"), F.col("p"), F.lit("> "), term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang")))
    blocks = _in_blocks(quads, block).groupBy("graph_id", "s", "s_kind", "part").agg(F.array_join(F.array_sort(F.collect_set(po)), " ;\n    ").alias("body"))
    return blocks.select("graph_id", "s", "part", F.concat(term(F.col("s"), F.col("s_kind")), F.lit(" "), F.col("body"), F.lit(" .")).alias("text"))


def jsonld(quads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(graph_id, s, part, text): JSON objects for each subject with its objects by predicate, about ``block`` statements in one; objects with one @id mean the same together."""
    o = F.when(F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_datatype").alias("@type"), F.col("o_lang").alias("@language")))).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
    per = _in_blocks(quads, block).groupBy("graph_id", "s", "part", "p").agg(F.array_sort(F.collect_set(o)).alias("os"))
    quoted = lambda c: F.to_json(F.struct(c.alias("x")))
    name = F.regexp_extract(quoted(F.col("p")), r'^\{"x":(.*)\}$', 1)
    body = per.groupBy("graph_id", "s", "part").agg(F.array_join(F.array_sort(F.collect_list(F.concat(name, F.lit(":["), F.array_join("os", ","), F.lit("]")))), ",").alias("b"))
    ident = F.regexp_extract(quoted(F.col("s")), r'^\{"x":(.*)\}$', 1)
    return body.select("graph_id", "s", "part", F.concat(F.lit('{"@id":'), ident, F.lit(","), F.col("b"), F.lit("}")).alias("text"))


_TOKENS = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>\s]*>)|(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*")|(?P<at>@[A-Za-z-]+)|(?P<dt>\^\^)|(?P<bn>_:[\w.-]*\w)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<pn>[A-Za-z][\w-]*:(?:[\w%-](?:[\w.%:-]*[\w%-])?)?|:[\w.%-]*[\w%-])|(?P<w>a\b|true\b|false\b|PREFIX\b|BASE\b)|(?P<op>[.;,\[\]])""",
    re.X | re.S,
)


def triples_of_turtle(text: str) -> Iterator[tuple]:
    """(s, s_kind, p, o, o_kind, datatype, lang) of a Turtle document without collections; ValueError where it cannot be read."""
    toks, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"cannot read Turtle at {text[at : at + 20]!r}")
        if m.lastgroup:
            toks.append((m.lastgroup, m.group()))
        at = m.end()
    toks.append(("end", ""))
    prefixes: dict[str, str] = {}
    base, i, blank = "", 0, 0
    out: list[tuple] = []

    def iri(kind: str, v: str) -> str:
        if kind == "iri":
            return v[1:-1] if ":" in v else base + v[1:-1]
        prefix, _, local = v.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix}:")
        return prefixes[prefix] + local

    def node() -> tuple:
        nonlocal i, blank
        kind, v = toks[i]
        i += 1
        if kind in ("iri", "pn"):
            return iri(kind, v), "uri", None, None
        if kind == "bn":
            return v, "bnode", None, None
        if v == "[":
            blank += 1
            name = f"_:b{blank}"
            if toks[i][1] != "]":
                predicates((name, "bnode"))
            if toks[i][1] != "]":
                raise ValueError("] is missing")
            i += 1
            return name, "bnode", None, None
        if kind == "num":
            return v, "literal", "xsd:decimal" if "." in v else "xsd:integer", None
        if kind == "w" and v in ("true", "false"):
            return v, "literal", "xsd:boolean", None
        if kind == "str":
            body = v[3:-3] if v.startswith('"""') else v[1:-1]
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), body)
            if toks[i][0] == "at":
                i += 1
                return body, "literal", None, toks[i - 1][1][1:]
            if toks[i][0] == "dt":
                i += 2
                return body, "literal", iri(*toks[i - 1]), None
            return body, "literal", None, None
        raise ValueError(f"unexpected {v or 'end'!r}")

    def predicates(s: tuple) -> None:
        nonlocal i
        while True:
            kind, v = toks[i]
            i += 1
            p = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type" if (kind, v) == ("w", "a") else iri(kind, v)
            while True:
                o = node()
                out.append((s[0], s[1], p, *o))
                if toks[i][1] != ",":
                    break
                i += 1
            while toks[i][1] == ";":
                i += 1
            if toks[i][1] in (".", "]", "") or toks[i][0] == "end":
                return

    while toks[i][0] != "end":
        kind, v = toks[i]
        if v in ("@prefix", "PREFIX", "@base", "BASE"):
            if v.lower().endswith("prefix"):
                prefixes[toks[i + 1][1].rstrip(":")] = toks[i + 2][1][1:-1]
                i += 3
            else:
                base = toks[i + 1][1][1:-1]
                i += 2
            if toks[i][1] == ".":
                i += 1
            continue
        subject = node()
        if toks[i][1] != ".":
            predicates(subject[:2])
        if toks[i][1] != ".":
            raise ValueError("a statement does not end")
        i += 1
    yield from out


@udtf(returnType="s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")
class ParseTurtle:
    """The triples of one Turtle text as a table function; a text that cannot be read gives none."""

    def eval(self, text: str):
        try:
            yield from list(triples_of_turtle(text or ""))
        except (ValueError, IndexError):
            return


def parse_turtle(documents: DataFrame, graph: str = "graph_id", text: str = "text") -> DataFrame:
    """Quads of Turtle documents, each a graph."""
    spark = documents.sparkSession
    spark.udtf.register("weftline_turtle", ParseTurtle)
    documents.createOrReplaceTempView("weftline_turtle_texts")
    return spark.sql(f"select d.`{graph}` as graph_id, t.* from weftline_turtle_texts d, lateral weftline_turtle(d.`{text}`) t").select(*QUADS.names)
