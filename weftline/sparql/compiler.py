"""A parsed SELECT query to a DataFrame plan.

A solution is a row with a column per variable that holds the term as one
string: its kind, value, datatype and language, so that joins are plain
equi-joins on strings, which Catalyst orders and distributes. Unbound is null.
Variables that may be unbound join by compatibility. Patterns that share no
variable would be a product of two tables; they are refused unless one side is a list of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch
from .parser import MOST_ROWS, QueryError, parse

_S = "\u0001"
_NUMERIC = ("xsd:integer", "xsd:decimal", "xsd:double", "xsd:float", "xsd:int", "xsd:long")


def _encode(kind: Column, value: Column, datatype: Column, lang: Column) -> Column:
    literal = F.concat(F.lit("l" + _S), value, F.lit(_S), F.coalesce(datatype, F.lit("")), F.lit(_S), F.coalesce(F.when(datatype.isNull(), lang), F.lit("")))
    return F.when(kind == "literal", literal).when(kind == "bnode", F.concat(F.lit("b" + _S), value)).otherwise(F.concat(F.lit("u" + _S), value))


def _literal(value: Column, datatype: str = "") -> Column:
    return F.concat(F.lit("l" + _S), value, F.lit(_S + datatype + _S))


class _Part:
    """Rows with the columns of ``vars``; those in ``loose`` may be null."""

    def __init__(self, df: DataFrame, names: list[str], loose: set[str] | None = None, few: bool = False):
        self.df, self.vars, self.loose, self.few = df, names, loose or set(), few


class _Compiler:
    def __init__(self, quads: DataFrame, rdf_type: str):
        self.spark, self.rdf_type, self.n = quads.sparkSession, rdf_type, 0
        self.scratch: Scratch | None = None
        self.quads = quads.select(
            F.concat(F.lit("u" + _S), "graph_id").alias("g"), _encode(F.col("s_kind"), F.col("s"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("s"), F.concat(F.lit("u" + _S), "p").alias("p"),
            _encode(F.col("o_kind"), F.col("o"), F.col("o_datatype"), F.col("o_lang")).alias("o"),
        )

    def constant(self, t: tuple) -> str:
        if t[0] == "iri":
            return "u" + _S + (self.rdf_type if t[1] == "\0type" else t[1])
        return f"l{_S}{t[1]}{_S}{t[2] or ''}{_S}{t[3] or ''}"

    def fresh(self) -> str:
        self.n += 1
        return f"__{self.n}"

    # -- patterns

    def pattern(self, node: tuple, graph: str | None) -> _Part:
        kind = node[0]
        if kind == "bgp":
            return self.bgp(node[1], graph)
        if kind == "join":
            return self.join(self.pattern(node[1], graph), self.pattern(node[2], graph))
        if kind == "optional":
            return self.optional(node, graph)
        if kind == "union":
            a, b = self.pattern(node[1], graph), self.pattern(node[2], graph)
            names = a.vars + [v for v in b.vars if v not in a.vars]
            return _Part(a.df.unionByName(b.df, allowMissingColumns=True), names, a.loose | b.loose | (set(a.vars) ^ set(b.vars)))
        if kind == "minus":
            a, b = self.pattern(node[1], graph), self.pattern(node[2], graph)
            shared = [v for v in a.vars if v in b.vars]
            return a if not shared else _Part(self.matched(a, b, shared, "left_anti"), a.vars, a.loose)
        if kind == "filter":
            return self.filtered(node[1], self.pattern(node[2], graph), graph)
        if kind == "bind":
            a = self.pattern(node[3], graph)
            return _Part(a.df.withColumn(node[1], self.term(node[2], a)), a.vars + [node[1]], a.loose | {node[1]}, a.few)
        if kind == "values":
            rows = [[None if t is None else self.constant(t) for t in r] for r in node[2]]
            df = self.spark.createDataFrame(rows, ", ".join(f"`{v}` string" for v in node[1]))
            return _Part(df, node[1], {v for i, v in enumerate(node[1]) if any(r[i] is None for r in rows)}, few=True)
        if kind == "graph":
            name = node[1]
            if name[0] == "var":
                return self.pattern(node[2], name[1])
            inner = self.fresh()
            a = self.pattern(node[2], inner)
            return _Part(a.df.where(F.col(inner) == self.constant(name)).drop(inner), [v for v in a.vars if v != inner], a.loose)
        df, names = self.query(node[1])
        return _Part(df, names, set(names))

    def bgp(self, triples: list, graph: str | None) -> _Part:
        parts = [self.triple(*t, graph) for t in triples]
        if not parts:
            return _Part(self.spark.range(1).select(), [], few=True)
        done = parts.pop(0)
        while parts:
            # a pattern that shares a variable first, so that nothing is multiplied out on the way
            i = next((i for i, p in enumerate(parts) if set(p.vars) & set(done.vars)), 0)
            done = self.join(done, parts.pop(i))
        return done

    def triple(self, s: tuple, path, o: tuple, graph: str | None) -> _Part:
        # a repeated step is followed from the end that is given, and not from everywhere
        start, end = (self.constant(t) if t[0] != "var" else None for t in (s, o))
        rows = self.path(path, graph, start, end)
        for name, t in (("s", s), ("o", o)):
            if t[0] != "var":
                rows = rows.where(F.col(name) == self.constant(t))
        return self.named(rows, [("s", s), ("o", o), *([("p", path)] if path[0] == "var" else []), *([("g", ("var", graph))] if graph else [])])

    def named(self, rows: DataFrame, at: list[tuple[str, tuple]]) -> _Part:
        seen: dict[str, str] = {}
        for column, t in at:
            if t[0] == "var":
                if t[1] in seen:
                    rows = rows.where(F.col(column) == F.col(seen[t[1]]))
                else:
                    seen[t[1]] = column
        return _Part(rows.select(*[F.col(c).alias(v) for v, c in seen.items()]), list(seen))

    def path(self, p, graph: str | None, start=None, end=None) -> DataFrame:
        """Rows (s, o), with p for a plain predicate and g where the graph is asked for; start and end, where given, are the only s and o asked for, and others may be left out."""
        keep = ["g"] if graph else []
        kind = p[0]
        if kind in ("iri", "var"):
            rows = self.quads if kind == "var" else self.quads.where(F.col("p") == self.constant(p))
            rows = rows.select("s", "o", *(["p"] if kind == "var" else []), *keep)
            return rows if graph else rows.distinct()
        if kind == "inv":
            return self.path(p[1], graph, end, start).select(F.col("o").alias("s"), F.col("s").alias("o"), *keep)
        if kind == "alt":
            return self.path(p[1], graph, start, end).select("s", "o", *keep).unionByName(self.path(p[2], graph, start, end).select("s", "o", *keep))
        if kind == "seq":
            a = self.path(p[1], graph, start).select("s", F.col("o").alias("m"), *keep)
            b = self.path(p[2], graph, None, end).select(F.col("s").alias("m"), "o", *keep)
            return a.join(b, ["m", *keep]).select("s", "o", *keep)
        if kind == "not":
            return self.quads.where(~F.col("p").isin([self.constant(t) for t in p[1]])).select("s", "o", *keep).distinct()
        base = self.path(p[1], graph).select("s", "o", *keep).distinct()
        nodes = self.quads.select(F.explode(F.array("s", "o")).alias("s"), *keep).distinct()
        same = nodes.select("s", F.col("s").alias("o"), *keep)
        if kind == "?":
            return base.unionByName(same).distinct()
        closed = self.closure(base, keep, start, end)
        return closed if kind == "+" else closed.unionByName(same).distinct()

    def closure(self, base: DataFrame, keep: list[str], start=None, end=None) -> DataFrame:
        """All pairs over one step or more, or those from one start or to one end: the pairs found last are lengthened by a step until none is new."""
        if start is None and end is not None:
            turned = self.closure(base.select(F.col("o").alias("s"), F.col("s").alias("o"), *keep), keep, end)
            return turned.select(F.col("o").alias("s"), F.col("s").alias("o"), *keep)
        self.scratch = self.scratch or Scratch(self.spark, "paths")
        base = self.scratch.keep(base)
        schema = base.schema
        paths = [self.scratch.write(base if start is None else base.where(F.col("s") == start))]
        last = self.scratch.read(schema, paths[0])
        step = base.select(F.col("s").alias("m"), F.col("o").alias("o2"), *keep)
        while True:
            known = self.scratch.read(schema, *paths)
            new = last.withColumnRenamed("o", "m").join(step, ["m", *keep]).select("s", F.col("o2").alias("o"), *keep).distinct().join(known, ["s", "o", *keep], "left_anti")
            path = self.scratch.write(new)
            last = self.scratch.read(schema, path)
            if last.limit(1).count() == 0:
                return known
            paths.append(path)

    def matched(self, a: _Part, b: _Part, shared: list[str], how: str, more: Column | None = None) -> DataFrame:
        """a joined with b, whose shared columns are renamed to x."""
        right = b.df.select(*[F.col(v).alias(f"{v}__r") if v in shared else F.col(v) for v in b.vars])
        on = F.lit(True)
        for v in shared:
            equal = F.col(v) == F.col(f"{v}__r")
            on = on & ((equal | F.col(v).isNull() | F.col(f"{v}__r").isNull()) if v in a.loose | b.loose else equal)
        return a.df.join(right, on if more is None else on & more, how)

    def join(self, a: _Part, b: _Part) -> _Part:
        shared = [v for v in a.vars if v in b.vars]
        names = a.vars + [v for v in b.vars if v not in a.vars]
        if not shared:
            if not (a.few or b.few):
                raise QueryError(f"the patterns over {a.vars} and {b.vars} share no variable")
            return _Part(a.df.crossJoin(b.df), names, a.loose | b.loose, a.few and b.few)
        if not (set(shared) & (a.loose | b.loose)):
            return _Part(a.df.join(b.df, shared), names, a.loose | b.loose, a.few and b.few)
        df = self.matched(a, b, shared, "inner")
        return _Part(df.select(*[F.coalesce(v, f"{v}__r").alias(v) if v in shared else F.col(v) for v in names]), names, (a.loose & b.loose) | ((a.loose | b.loose) - set(shared)))

    def optional(self, node: tuple, graph: str | None) -> _Part:
        a, inner, condition = self.pattern(node[1], graph), node[2], None
        if inner[0] == "filter" and inner[1][0] != "exists":
            condition, inner = inner[1], inner[2]
        b = self.pattern(inner, graph)
        shared = [v for v in a.vars if v in b.vars]
        if not shared:
            raise QueryError("an OPTIONAL part shares no variable with what stands before it")
        names = a.vars + [v for v in b.vars if v not in a.vars]
        more = None if condition is None else F.coalesce(self.boolean(condition, _Part(a.df, names)), F.lit(False))
        df = self.matched(a, b, shared, "left", more)
        return _Part(df.select(*[F.coalesce(v, f"{v}__r").alias(v) if v in shared else F.col(v) for v in names]), names, a.loose | (set(b.vars) - set(a.vars)))

    def filtered(self, e: tuple, a: _Part, graph: str | None) -> _Part:
        if e[0] == "exists":
            b = self.pattern(e[2], graph)
            shared = [v for v in a.vars if v in b.vars]
            if not shared:
                raise QueryError("an EXISTS part shares no variable with its group")
            return _Part(self.matched(a, b, shared, "left_semi" if e[1] else "left_anti"), a.vars, a.loose)
        if e[0] == "&&":
            return self.filtered(e[2], self.filtered(e[1], a, graph), graph)
        return _Part(a.df.where(self.boolean(e, a)), a.vars, a.loose, a.few)

    # -- expressions: an error is null

    def value(self, e: tuple, a: _Part) -> tuple[str, Column]:
        """(kind, column), kind being term, num, str or bool."""
        k = e[0]
        if k == "var":
            return "term", (F.col(e[1]) if e[1] in a.vars else F.lit(None).cast("string"))
        if k == "iri":
            return "term", F.lit(self.constant(e))
        if k == "lit":
            if e[2] in _NUMERIC:
                return "num", F.lit(float(e[1]))
            if e[2] == "xsd:boolean":
                return "bool", F.lit(e[1] == "true")
            return ("str", F.lit(e[1])) if not e[2] and not e[3] else ("term", F.lit(self.constant(e)))
        if k in ("||", "&&"):
            x, y = self.boolean(e[1], a), self.boolean(e[2], a)
            return "bool", (x | y) if k == "||" else (x & y)
        if k == "!":
            return "bool", ~self.boolean(e[1], a)
        if k in ("+", "-", "*", "/"):
            x, y = self.number(e[1], a), self.number(e[2], a)
            return "num", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[k]()
        if k in ("=", "!=", "<", ">", "<=", ">="):
            return "bool", self.compare(k, e[1], e[2], a)
        if k == "in":
            out = F.lit(False)
            for item in e[2]:
                out = out | self.compare("=", e[1], item, a)
            return "bool", out
        if k == "col":
            return e[2], F.col(e[1])
        if k == "call":
            return self.call(e[1], e[2], a)
        raise QueryError(f"{k} cannot stand in an expression")

    def string(self, e: tuple, a: _Part) -> Column:
        kind, c = self.value(e, a)
        return F.get(F.split(c, _S), F.lit(1)) if kind == "term" else c.cast("string")

    def number(self, e: tuple, a: _Part) -> Column:
        kind, c = self.value(e, a)
        return F.get(F.split(c, _S), F.lit(1)).try_cast("double") if kind == "term" else c if kind == "num" else c.try_cast("double")

    def boolean(self, e: tuple, a: _Part) -> Column:
        kind, c = self.value(e, a)
        if kind == "bool":
            return c
        if kind == "num":
            return c != 0
        v = F.get(F.split(c, _S), F.lit(1)) if kind == "term" else c
        return F.when(v.isin("true", "1"), True).when(v.isin("false", "0", ""), False).otherwise(v.isNotNull())

    def term(self, e: tuple, a: _Part) -> Column:
        kind, c = self.value(e, a)
        if kind == "term":
            return c
        if kind == "num":
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            return F.when(whole, _literal(c.cast("long").cast("string"), "xsd:integer")).otherwise(_literal(c.cast("string"), "xsd:decimal"))
        return _literal(c.cast("string"), "xsd:boolean" if kind == "bool" else "")

    def compare(self, op: str, x: tuple, y: tuple, a: _Part) -> Column:
        (kx, cx), (ky, cy) = self.value(x, a), self.value(y, a)
        if "num" in (kx, ky):
            u, v = self.number(x, a), self.number(y, a)
        elif "bool" in (kx, ky):
            u, v = self.boolean(x, a), self.boolean(y, a)
        elif kx == ky == "term" and op in ("=", "!="):
            nx, ny = self.number(x, a), self.number(y, a)
            both = nx.isNotNull() & ny.isNotNull() & cx.startswith("l") & cy.startswith("l")
            equal = F.when(both, nx == ny).otherwise(cx == cy)
            return equal if op == "=" else ~equal
        elif kx == ky == "term":
            nx, ny = self.number(x, a), self.number(y, a)
            sx, sy = self.string(x, a), self.string(y, a)
            both = nx.isNotNull() & ny.isNotNull()
            return F.when(both, self.ordered(op, nx, ny)).otherwise(self.ordered(op, sx, sy))
        else:
            u, v = self.string(x, a), self.string(y, a)
        return self.ordered(op, u, v)

    @staticmethod
    def ordered(op: str, u: Column, v: Column) -> Column:
        return {"=": u == v, "!=": u != v, "<": u < v, ">": u > v, "<=": u <= v, ">=": u >= v}[op]

    def call(self, name: str, args: list, a: _Part) -> tuple[str, Column]:
        s = lambda i: self.string(args[i], a)
        t = lambda i: self.term(args[i], a)
        if name == "REGEX":
            if len(args) > 2 and args[2][0] == "lit" and "i" in args[2][1]:
                return "bool", F.rlike(s(0), F.concat(F.lit("(?i)"), s(1)))
            return "bool", F.rlike(s(0), s(1))
        if name == "IF":
            kind, yes = self.value(args[1], a)
            other, no = self.value(args[2], a)
            return (kind, F.when(self.boolean(args[0], a), yes).otherwise(no)) if kind == other else ("term", F.when(self.boolean(args[0], a), t(1)).otherwise(t(2)))
        if name == "COALESCE":
            return "term", F.coalesce(*[self.term(x, a) for x in args])
        if name == "BOUND":
            return "bool", self.value(args[0], a)[1].isNotNull()
        simple = {
            "CONTAINS": lambda: ("bool", F.contains(s(0), s(1))), "STRSTARTS": lambda: ("bool", F.startswith(s(0), s(1))), "STRENDS": lambda: ("bool", F.endswith(s(0), s(1))),
            "STR": lambda: ("str", s(0)), "LCASE": lambda: ("str", F.lower(s(0))), "UCASE": lambda: ("str", F.upper(s(0))), "STRLEN": lambda: ("num", F.length(s(0)).cast("double")),
            "CONCAT": lambda: ("str", F.concat(*[self.string(x, a) for x in args])), "SUBSTR": lambda: ("str", F.substr(s(0), self.number(args[1], a).cast("int"), *([self.number(args[2], a).cast("int")] if len(args) > 2 else []))),
            "REPLACE": lambda: ("str", F.regexp_replace(s(0), s(1), s(2))), "STRBEFORE": lambda: ("str", F.when(F.contains(s(0), s(1)), F.substring_index(s(0), args[1][1], 1)).otherwise("")),
            "STRAFTER": lambda: ("str", F.when(F.contains(s(0), s(1)), F.substr(s(0), F.instr(s(0), args[1][1]) + F.length(s(1)))).otherwise("")),
            "LANG": lambda: ("str", F.when(t(0).startswith("l"), F.get(F.split(t(0), _S), F.lit(3)))), "DATATYPE": lambda: ("term", F.when(t(0).startswith("l"), F.concat(F.lit("u" + _S), F.coalesce(F.nullif(F.get(F.split(t(0), _S), F.lit(2)), F.lit("")), F.lit("xsd:string"))))),
            "ISIRI": lambda: ("bool", t(0).startswith("u")), "ISURI": lambda: ("bool", t(0).startswith("u")), "ISBLANK": lambda: ("bool", t(0).startswith("b")), "ISLITERAL": lambda: ("bool", t(0).startswith("l")),
            "ISNUMERIC": lambda: ("bool", F.get(F.split(t(0), _S), F.lit(2)).isin(*_NUMERIC)), "SAMETERM": lambda: ("bool", t(0) == t(1)), "IRI": lambda: ("term", F.concat(F.lit("u" + _S), s(0))), "URI": lambda: ("term", F.concat(F.lit("u" + _S), s(0))),
            "ABS": lambda: ("num", F.abs(self.number(args[0], a))), "ROUND": lambda: ("num", F.round(self.number(args[0], a))), "CEIL": lambda: ("num", F.ceil(self.number(args[0], a)).cast("double")), "FLOOR": lambda: ("num", F.floor(self.number(args[0], a)).cast("double")),
        }
        if name not in simple:
            raise QueryError(f"unknown function {name}")
        return simple[name]()

    # -- queries

    def query(self, q: dict) -> tuple[DataFrame, list[str]]:
        a = self.pattern(q["where"], None)
        if a.df.columns != a.vars:
            a = _Part(a.df.select(*a.vars), a.vars, a.loose, a.few)
        chosen = q["vars"] or [(v, ("var", v)) for v in a.vars if not v.startswith("_")]
        aggregates: list[tuple] = []

        def lift(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                if e not in aggregates:
                    aggregates.append(e)
                return ("col", f"__a{aggregates.index(e)}", "num" if e[1] in ("COUNT", "SUM", "AVG") else "str" if e[1] == "GROUP_CONCAT" else "term")
            return tuple(lift(x) for x in e) if isinstance(e, tuple) else [lift(x) for x in e] if isinstance(e, list) else e

        chosen = [(v, lift(e)) for v, e in chosen]
        having, order = [lift(e) for e in q["having"]], [(lift(e), down) for e, down in q["order"]]
        if aggregates or q["group"]:
            keys = [self.term(e, a).alias(v) for v, e in q["group"]]
            made = [self.aggregate(e, a).alias(f"__a{i}") for i, e in enumerate(aggregates)]
            df = a.df.groupBy(*keys).agg(*(made or [F.count(F.lit(1)).alias("__n")]))
            names = [v for v, _ in q["group"]]
            a = _Part(df, names, set(names))
            for e in having:
                a = _Part(a.df.where(self.boolean(e, a)), names, a.loose)
        df = a.df
        for v, e in chosen:
            if e != ("var", v):
                df = df.withColumn(v, self.term(e, a))
        scope = _Part(df, list(dict.fromkeys([*a.vars, *[v for v, _ in chosen]])), a.loose)
        names = [v for v, _ in chosen]
        for v in names:
            if v not in df.columns:
                df = df.withColumn(v, F.lit(None).cast("string"))
        if order:
            keys = []
            for e, down in order:
                kind, c = self.value(e, scope)
                if kind == "term":
                    rank = F.when(c.isNull(), 0).when(c.startswith("b"), 1).when(c.startswith("u"), 2).otherwise(3)
                    parts = [rank, self.number(e, scope), self.string(e, scope)]
                else:
                    parts = [c]
                keys += [p.desc_nulls_last() if down else p.asc_nulls_first() for p in parts]
            df = df.orderBy(*keys, *names)
        df = df.select(*names)
        if q["distinct"]:
            df = df.distinct() if not order else df.dropDuplicates(names)
        if q["offset"]:
            df = df.offset(q["offset"])
        return (df if q["limit"] is None else df.limit(q["limit"])), names

    def aggregate(self, e: tuple, a: _Part) -> Column:
        _, name, distinct, arg, sep = e
        if name == "COUNT":
            if arg is None:
                return (F.count_distinct(F.struct(*a.vars)) if distinct else F.count(F.lit(1))).cast("double")
            c = self.term(arg, a)
            return (F.count_distinct(c) if distinct else F.count(c)).cast("double")
        if name in ("SUM", "AVG"):
            c = self.number(arg, a)
            if distinct:
                values = F.collect_set(c)
                total = F.aggregate(values, F.lit(0.0), lambda x, y: x + y)
                return total if name == "SUM" else F.try_divide(total, F.size(values).cast("double"))
            return F.coalesce(F.sum(c), F.lit(0.0)) if name == "SUM" else F.avg(c)
        if name == "GROUP_CONCAT":
            c = self.string(arg, a)
            return F.array_join(F.array_sort(F.collect_set(c) if distinct else F.collect_list(c)), sep)
        c = self.term(arg, a)
        if name == "SAMPLE":
            return F.min(c)
        pick = F.struct(self.number(arg, a).alias("n"), c.alias("c"))
        return (F.max(F.when(c.isNotNull(), pick)) if name == "MAX" else F.min(F.when(c.isNotNull(), pick)))["c"]


def select(quads: DataFrame, text: str, rdf_type: str = "rdf:type", most: int | None = MOST_ROWS) -> DataFrame:
    """The rows of a SELECT query over quads, every cell a string and '' where unbound.

    Without a graph named, the triples of all graphs count once each. At most
    ``most`` rows are given (None: all). Updates, other sources and texts that are no SELECT query raise QueryError.
    """
    q = parse(text)
    if most is not None and (q["limit"] is None or q["limit"] > most):
        q["limit"] = most
    df, names = _Compiler(quads, rdf_type).query(q)
    return df.select(*[F.coalesce(F.get(F.split(F.col(v), _S), F.lit(1)), F.lit("")).alias(v) for v in names])

