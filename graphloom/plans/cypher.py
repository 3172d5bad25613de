"""Cypher text to DataFrame plans.

Every node variable is a set of flat columns, so Catalyst prunes what a query doesn't use and pushes
its filters into the scans. Relationships are equi-joins, OPTIONAL MATCH a left join, pattern
predicates semi or anti joins, variable lengths bounded frontier joins on distinct ends. Two rules
are applied where nodes are scanned, before Catalyst sees the plan: the as-of filter and the project
scope, each on the scan itself, so no operator precedence of the text can weaken them.

A variable-length relationship relates distinct ends per length (walks), and disconnected patterns
are joined on what WHERE equates. Independent patterns without any equality are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph, alive_at
from graphloom.operators import community, rank, retrieve
from graphloom.plans.cypher_ast import Call, CypherError, Match, NodePattern, Pattern, Project, Query, Unwind, Write, parse
from graphloom.session import cut_lineage

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "sign": F.signum,
    "coalesce": F.coalesce, "reverse": F.reverse, "keys": F.map_keys,
    "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.try_cast("long"), "tofloat": lambda x: x.try_cast("double"), "toboolean": lambda x: x.try_cast("boolean"),
    "replace": F.replace, "split": lambda x, s: F.split(x, F.concat(F.lit("\\Q"), s, F.lit("\\E"))), "substring": lambda x, a, *n: F.substr(x, a + 1, *n), "left": F.left, "right": F.right,
    "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.get(x, F.size(x) - 1), "range": F.sequence, "round": lambda x, *n: F.round(x, *n),
}


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


class Compiler:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any] | None = None, as_of: int | None = None, project: str | None = None, now: int = 0):
        self.graph, self.params, self.now = graph, params or {}, now
        nodes = graph.nodes
        if as_of is not None:
            nodes = nodes.filter(alive_at(as_of))
        if project is not None:
            nodes = nodes.filter(F.col("project_id") == project)
        self.nodes = nodes
        self.counter = 0

    def fresh(self) -> str:
        self.counter += 1
        return f"_gl{self.counter}"

    # ---- queries

    def run(self, queries: list[Query]) -> DataFrame:
        out = None
        for q in queries:
            df = Frame(self).clauses(q.clauses)
            if out is None:
                out = df
            else:
                out = out.union(df) if q.union_all else out.union(df).distinct()
        return out


class Frame:
    """The bindings of a query part: a DataFrame and what each name stands for (node, rel or value)."""

    def __init__(self, c: Compiler):
        self.c, self.df, self.names = c, None, {}

    def copy(self) -> Frame:
        f = Frame(self.c)
        f.df, f.names = self.df, dict(self.names)
        return f

    def columns_of(self, name: str) -> list[str]:
        kind = self.names[name]
        return [name] if kind == "value" else [x for x in self.df.columns if x.startswith(name + "__")]

    def clauses(self, clauses: list[Any]) -> DataFrame:
        for clause in clauses:
            if isinstance(clause, Match):
                self.match(clause)
            elif isinstance(clause, Unwind):
                self.unwind(clause)
            elif isinstance(clause, Call):
                self.call(clause)
            elif isinstance(clause, Project):
                self.project(clause)
            else:
                raise CypherError("write clauses belong to update()")
        if not isinstance(clauses[-1], Project) or not clauses[-1].final:
            raise CypherError("a query ends with RETURN")
        return self.df

    # ---- patterns

    def scan(self, p: NodePattern, var: str) -> DataFrame:
        df = self.c.nodes
        if p.labels:
            df = df.filter(F.col("type").isin(*p.labels))
        df = df.select(*[F.col(x).alias(f"{var}__{x}") for x in df.columns])
        for key, value in p.props.items():
            if not _names(value):
                df = df.filter(self.property(var, key, df.columns) == self.expr(value))
        return df

    def related(self, p: NodePattern, var: str) -> None:
        """The inline properties that name other bindings; Catalyst makes them conditions of the join."""
        for key, value in p.props.items():
            if _names(value):
                self.df = self.df.filter(self.property(var, key) == self.expr(value))

    def property(self, var: str, key: str, columns: list[str] | None = None) -> Column:
        columns = columns or self.df.columns
        for name in (key, _snake(key)):
            if f"{var}__{name}" in columns:
                return F.col(f"{var}__{name}")
        if f"{var}__props" in columns:
            return F.element_at(f"{var}__props", key)
        return F.lit(None).cast("string")

    def match(self, m: Match) -> None:
        if m.optional:
            return self.optional(m)
        conjuncts = _conjuncts(m.where)
        for p in m.patterns:
            self.pattern(p, conjuncts)
        self.filter(m.where)

    def pattern(self, p: Pattern, conjuncts: list[Any]) -> None:
        first = p.nodes[0]
        start = next((k for k, n in enumerate(p.nodes) if n.var in self.names), 0)
        if start:  # begin at a bound end
            p = Pattern(p.path, p.nodes[::-1], [_flipped(r) for r in p.rels[::-1]]) if start == len(p.nodes) - 1 else p
            first = p.nodes[0]
        var = first.var or self.c.fresh()
        self.enter(first, var, conjuncts)
        for rel, node in zip(p.rels, p.nodes[1:]):
            there = node.var or self.c.fresh()
            self.step(var, rel, node, there, p.path)
            var = there

    def enter(self, node: NodePattern, var: str, conjuncts: list[Any]) -> None:
        if var in self.names:
            if node.labels:
                self.df = self.df.filter(F.col(f"{var}__type").isin(*node.labels))
            for key, value in node.props.items():
                self.df = self.df.filter(self.property(var, key) == self.expr(value))
            return
        scan = self.scan(node, var)
        if self.df is None:
            self.df = scan
        else:
            known = set(self.names)
            joined = any(e[0] == "=" and _names(e[1]) | _names(e[2]) >= {var} and (_names(e[1]) | _names(e[2])) & known for e in conjuncts)
            one = bool(node.props)
            if not joined and not one:
                raise CypherError(f"nothing relates ({var}) to the patterns before it")
            self.df = self.df.join(scan)  # Catalyst makes the equality of WHERE the join's condition
        self.names[var] = "node"
        self.related(node, var)

    def edges(self, types: list[str], rel: str) -> DataFrame:
        df = self.c.graph.edges
        if types:
            df = df.filter(F.col("type").isin(*types))
        return df.select(*[F.col(x).alias(f"{rel}__{x}") for x in df.columns])

    def step(self, here: str, r: Any, node: NodePattern, there: str, path: str | None) -> None:
        rel = r.var or self.c.fresh()
        if r.hops:
            self.walks(here, r, there, path)
        else:
            e = self.edges(r.types, rel)
            for key, value in r.props.items():
                e = e.filter(self.property(rel, key, e.columns) == self.expr(value))
            src, dst = F.col(f"{rel}__src"), F.col(f"{rel}__dst")
            if r.direction == "both":
                ends = F.explode(F.array(F.struct(src.alias("a"), dst.alias("b")), F.struct(dst.alias("a"), src.alias("b"))))
                e = e.withColumn("_gl_e", ends).withColumns({f"{rel}__here": F.col("_gl_e.a"), f"{rel}__there": F.col("_gl_e.b")}).drop("_gl_e")
            else:
                a, b = (src, dst) if r.direction == "out" else (dst, src)
                e = e.withColumns({f"{rel}__here": a, f"{rel}__there": b})
            self.df = self.df.join(e, F.col(f"{here}__id") == F.col(f"{rel}__here")).drop(f"{rel}__here")
            self.names[rel] = "rel"
        end = F.col(f"{rel}__there") if not r.hops else F.col("_gl_there")
        if there in self.names:
            self.df = self.df.filter(F.col(f"{there}__id") == end)
            self.enter(node, there, [])
        else:
            self.df = self.df.join(self.scan(node, there), F.col(f"{there}__id") == end)
            self.names[there] = "node"
            self.related(node, there)
        self.df = self.df.drop("_gl_there", f"{rel}__there")

    def walks(self, here: str, r: Any, there: str, path: str | None) -> None:
        e = self.c.graph.edges
        if r.types:
            e = e.filter(F.col("type").isin(*r.types))
        pairs = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[r.direction]
        step = e.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])).alias("x")).select(F.col("x.a").alias("_gl_a"), F.col("x.b").alias("_gl_b"))
        reach = self.df.select(F.col(f"{here}__id").alias("_gl_from")).distinct().withColumn("_gl_there", F.col("_gl_from"))
        low, high = r.hops
        levels = reach.withColumn("_gl_n", F.lit(0)) if low == 0 else None
        for n in range(1, high + 1):
            if n > 2:  # else every level would be computed again for each further one
                reach = cut_lineage(reach)
            reach = reach.join(step, F.col("_gl_there") == F.col("_gl_a")).select("_gl_from", F.col("_gl_b").alias("_gl_there")).distinct()
            if n >= low:
                level = reach.withColumn("_gl_n", F.lit(n))
                levels = level if levels is None else levels.unionByName(level)
        self.df = self.df.join(levels, F.col(f"{here}__id") == F.col("_gl_from")).drop("_gl_from")
        if path:
            self.df = self.df.withColumnRenamed("_gl_n", path)
            self.names[path] = "value"
        else:
            self.df = self.df.drop("_gl_n")

    def alone(self, patterns: list[Pattern]) -> tuple[Frame, list[str]]:
        """The patterns by themselves, and the names they share with this frame."""
        f = Frame(self.c)
        for p in patterns:
            f.pattern(p, [])
        return f, [n for n in f.names if n in self.names]

    def optional(self, m: Match) -> None:
        f, shared = self.alone(m.patterns)
        own = [e for e in _conjuncts(m.where) if _names(e) <= set(f.names)]
        for e in own:
            f.filter(e)
        on, right = F.lit(True), f.df
        for name in shared:
            key = self.c.fresh()
            right = right.withColumn(key, F.col(f"{name}__id")).drop(*f.columns_of(name))
            on = on & (F.col(f"{name}__id") == F.col(key))
        if not shared:
            raise CypherError("OPTIONAL MATCH must share a variable with the patterns before it")
        names = self.names | {n: k for n, k in f.names.items() if n not in self.names}
        both = self.copy()
        both.names = names
        both.df = self.df.limit(0).join(right.limit(0)) if len(own) < len(_conjuncts(m.where)) else self.df
        for e in _conjuncts(m.where):
            if e not in own:
                on = on & both.expr(e)
        self.df = self.df.join(right, on, "left").drop(*[x for x in right.columns if re.fullmatch(r"_gl\d+", x)])
        self.names = names

    # ---- filters

    def filter(self, where: Any) -> None:
        for e in _conjuncts(where):
            negative = e[0] == "not" and e[1][0] == "pattern"
            if negative or e[0] == "pattern":
                f, shared = self.alone([e[1][1] if negative else e[1]])
                keys = [(F.col(f"{n}__id") == F.col(f"_gl_k_{n}")) for n in shared]
                if not keys:
                    raise CypherError("a pattern predicate must share a variable")
                ids = f.df.select(*[F.col(f"{n}__id").alias(f"_gl_k_{n}") for n in shared]).distinct()
                on = keys[0]
                for k in keys[1:]:
                    on = on & k
                self.df = self.df.join(ids, on, "left_anti" if negative else "left_semi")
            else:
                self.df = self.df.filter(self.expr(e))

    # ---- other clauses

    def unwind(self, u: Unwind) -> None:
        value = self.expr(u.value)
        if self.df is None:
            self.df = self.c.graph.nodes.sparkSession.range(1).select(F.explode(value).alias(u.var))
        else:
            self.df = self.df.withColumn(u.var, F.explode(value))
        self.names[u.var] = "value"

    def call(self, call: Call) -> None:
        args = [self.literal(a) for a in call.args]
        procedure = PROCEDURES.get(call.name.lower())
        if procedure is None:
            raise CypherError(f"no procedure {call.name}")
        found = procedure(PropertyGraph(self.c.nodes, self.c.graph.edges), *args)
        names = dict(call.yields) or {x: x for x in ("node", *[x for x in found.columns if x != "id"])}
        if self.df is not None:
            raise CypherError("CALL begins a query")
        values = [F.col(x).alias(names[x]) for x in found.columns if x in names]
        if "node" in names:
            var = names["node"]
            scan = self.scan(NodePattern(var, [], {}), var)
            self.df = found.select(F.col("id").alias("_gl_id"), *values).join(scan, F.col("_gl_id") == F.col(f"{var}__id")).drop("_gl_id")
            self.names[var] = "node"
        else:
            self.df = found.select(*values)
        self.names |= {names[x]: "value" for x in found.columns if x in names}
        self.filter(call.where)

    def literal(self, e: Any) -> Any:
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.c.params[e[1]]
        if e[0] == "list":
            return [self.literal(x) for x in e[1]]
        raise CypherError("a constant is expected here")

    def project(self, p: Project) -> None:
        if self.df is None:
            self.df = self.c.graph.nodes.sparkSession.range(1).drop("id")
        items = list(p.items)
        if p.star:
            items = [(("var", n), n) for n in self.names if not n.startswith("_gl")] + items
        whole = {alias: e[1] for e, alias in items if e[0] == "var" and self.names.get(e[1]) in ("node", "rel")}
        values = [(e, alias) for e, alias in items if alias not in whole]
        grouped = any(_aggregates(e) for e, _ in values)
        before, old = self.df, dict(self.names)
        columns: list[Column] = []
        names: dict[str, str] = {}
        for alias, var in whole.items():
            if p.final:
                columns.append(F.col(f"{var}__id" if old[var] == "node" else f"{var}__type").alias(alias))
                names[alias] = "value"
            else:
                columns += [F.col(x).alias(alias + x[len(var) :]) for x in self.columns_of(var)]
                names[alias] = old[var]
        keys = columns + [self.expr(e).alias(alias) for e, alias in values if not _aggregates(e)]
        sums = [self.expr(e).alias(alias) for e, alias in values if _aggregates(e)]
        names |= {alias: "value" for _, alias in values}
        hidden: list[tuple[Column, bool]] = []
        extra: list[Column] = []
        for k, (e, down) in enumerate(p.order):
            alias = next((a for x, a in items if x == e or e == ("var", a)), None)
            if alias is not None and alias not in whole:
                hidden.append((F.col(_quoted(alias)), down))
            elif grouped or p.distinct:
                self.names = names
                hidden.append((self.expr(e, set(names)), down))
                self.names = old
            else:
                extra.append(self.expr(e).alias(f"_gl_o{k}"))
                hidden.append((F.col(f"_gl_o{k}"), down))
        if grouped:
            df = before.groupBy(*keys).agg(*sums)
            order = [_quoted(a) for a in self._ordered(items, whole, old, p.final)]
            df = df.select(*order)
        else:
            df = before.select(*self._in_order(items, whole, old, p.final), *extra)
        if p.distinct:
            df = df.distinct()
        if hidden:
            visible = [f.name for f in df.schema.fields if not f.name.startswith("_gl_o") and "map<" not in f.dataType.simpleString()]
            ties = [F.col(_quoted(c)) for c in visible] if p.limit is not None or p.skip is not None else []
            df = df.orderBy(*[c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in hidden], *ties)
        if p.skip is not None:
            df = df.offset(int(self.literal(p.skip)))
        if p.limit is not None:
            df = df.limit(int(self.literal(p.limit)))
        self.df = df.drop(*[f"_gl_o{k}" for k in range(len(p.order))])
        self.names = names
        if p.where is not None:
            self.filter(p.where)

    def _in_order(self, items: list[tuple[Any, str]], whole: dict[str, str], old: dict[str, str], final: bool) -> list[Column]:
        out = []
        for e, alias in items:
            if alias in whole:
                var = whole[alias]
                if final:
                    out.append(F.col(f"{var}__id" if old[var] == "node" else f"{var}__type").alias(alias))
                else:
                    out += [F.col(x).alias(alias + x[len(var) :]) for x in self.df.columns if x.startswith(var + "__")]
            else:
                out.append(self.expr(e).alias(alias))
        return out

    def _ordered(self, items: list[tuple[Any, str]], whole: dict[str, str], old: dict[str, str], final: bool) -> list[str]:
        out = []
        for _, alias in items:
            if alias in whole and not final:
                out += [alias + x[len(whole[alias]) :] for x in self.df.columns if x.startswith(whole[alias] + "__")]
            else:
                out.append(alias)
        return out

    # ---- expressions

    def expr(self, e: Any, known: set[str] | None = None) -> Column:
        kind = e[0]
        sub = lambda x: self.expr(x, known)
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            if e[1] not in self.c.params:
                raise CypherError(f"no parameter ${e[1]}")
            value = self.c.params[e[1]]
            return F.array(*[F.lit(x) for x in value]) if isinstance(value, (list, tuple)) else F.lit(value)
        if kind == "var":
            name = e[1]
            if name in self.names:
                return {"node": F.col(f"{name}__id"), "rel": F.col(f"{name}__type")}.get(self.names[name], F.col(_quoted(name)))
            if known is None or name not in known:
                raise CypherError(f"unknown name {name}")
            return F.col(_quoted(name))
        if kind == "local":
            return e[1]
        if kind == "prop":
            base = e[1]
            if base[0] == "var" and self.names.get(base[1]) in ("node", "rel"):
                return self.property(base[1], e[2])
            return sub(base)[e[2]]
        if kind == "index":
            return F.get(sub(e[1]), sub(e[2]).cast("int"))
        if kind == "haslabel":
            return F.col(f"{e[1]}__type").isin(*e[2])
        if kind == "list":
            return F.array(*[sub(x) for x in e[1]])
        if kind == "map":
            return F.struct(*[sub(v).alias(k) for k, v in e[1].items()])
        if kind == "case":
            out = None
            for condition, value in e[1]:
                out = F.when(sub(condition), sub(value)) if out is None else out.when(sub(condition), sub(value))
            return out.otherwise(sub(e[2])) if e[2] is not None else out
        if kind in ("any", "all", "none"):
            inner = lambda x: self.expr(_bound(e[3], e[1], x), known)
            if kind == "all":
                return F.forall(sub(e[2]), inner)
            hit = F.exists(sub(e[2]), inner)
            return ~hit if kind == "none" else hit
        if kind == "call":
            return self.function(e, known)
        if kind == "pattern":
            raise CypherError("pattern predicates only stand alone, joined by AND")
        if kind == "not":
            return ~sub(e[1])
        if kind == "neg":
            return -sub(e[1])
        if kind == "isnull":
            return sub(e[1]).isNull()
        if kind == "notnull":
            return sub(e[1]).isNotNull()
        a = sub(e[1])
        if kind == "in":
            if e[2][0] in ("list", "param"):
                items = self.literal(e[2]) if e[2][0] == "param" or all(x[0] in ("lit", "param") for x in e[2][1]) else None
                if items is not None:
                    return a.isin(*items) if items else F.lit(False)
            return F.array_contains(sub(e[2]), a)
        b = sub(e[2])
        ops: dict[str, Callable[[], Column]] = {
            "and": lambda: a & b, "or": lambda: a | b, "xor": lambda: (a | b) & ~(a & b), "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "=~": lambda: F.regexp(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), "contains": lambda: F.contains(a, b), "starts": lambda: F.startswith(a, b), "ends": lambda: F.endswith(a, b),
            "+": lambda: F.concat(a.cast("string"), b.cast("string")) if _texty(e[1]) or _texty(e[2]) else a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }
        return ops[kind]()

    def function(self, e: Any, known: set[str] | None) -> Column:
        _, name, distinct, args = e
        sub = lambda x: self.expr(x, known)
        if name == "count":
            if args and args[0][0] == "star":
                return F.count("*")
            return F.count_distinct(sub(args[0])) if distinct else F.count(sub(args[0]))
        if name == "collect":
            return F.collect_set(sub(args[0])) if distinct else F.collect_list(sub(args[0]))
        if name in ("sum", "avg", "min", "max"):
            return getattr(F, name + "_distinct" if distinct and name == "sum" else name)(sub(args[0]))
        if args and args[0][0] == "var":
            var = args[0][1]
            if self.names.get(var) == "node":
                special = {"labels": lambda: F.array(F.col(f"{var}__type")), "id": lambda: F.col(f"{var}__id"), "properties": lambda: self.property(var, "props"), "keys": lambda: F.map_keys(f"{var}__props")}
                if name in special:
                    return special[name]()
            if self.names.get(var) == "rel" and name == "type":
                return F.col(f"{var}__type")
        if name in ("timestamp", "datetime"):
            return F.lit(self.c.now) if name == "timestamp" else F.timestamp_millis(F.lit(self.c.now))
        if name == "length" and args[0][0] == "var":
            return sub(args[0])
        if name == "size":
            return F.size(sub(args[0])) if args[0][0] in ("list", "call") else F.length(sub(args[0]))
        if name == "exists":
            return sub(args[0]).isNotNull()
        if name not in FUNCTIONS:
            raise CypherError(f"no function {name}")
        return FUNCTIONS[name](*[sub(x) for x in args])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _conjuncts(e: Any) -> list[Any]:
    if e is None:
        return []
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _children(e: Any) -> list[Any]:
    if isinstance(e, dict):
        return list(e.values())
    return [x for x in (e if isinstance(e, (tuple, list)) else []) if isinstance(x, (tuple, list, dict))]


def _names(e: Any) -> set[str]:
    out = {e[1]} if isinstance(e, tuple) and e and e[0] in ("var", "haslabel") else set()
    if isinstance(e, tuple) and e and e[0] == "pattern":
        return {n.var for n in e[1].nodes if n.var}
    for x in _children(e):
        out |= _names(x)
    return out


def _aggregates(e: Any) -> bool:
    if isinstance(e, tuple) and e and e[0] == "call" and e[1] in AGGREGATES:
        return True
    return any(_aggregates(x) for x in _children(e))


def _bound(e: Any, name: str, value: Column) -> Any:
    """e with a local name replaced by a column."""
    if e == ("var", name):
        return ("local", value)
    if isinstance(e, tuple):
        return tuple(_bound(x, name, value) for x in e)
    if isinstance(e, list):
        return [_bound(x, name, value) for x in e]
    return {k: _bound(v, name, value) for k, v in e.items()} if isinstance(e, dict) else e


def _texty(e: Any) -> bool:
    return (e[0] == "lit" and isinstance(e[1], str)) or (e[0] == "+" and (_texty(e[1]) or _texty(e[2]))) or (e[0] == "call" and e[1] in ("tostring", "tolower", "toupper"))


def _flipped(r: Any) -> Any:
    from dataclasses import replace

    return replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction])


def _page_rank(graph: PropertyGraph, *_: Any) -> DataFrame:
    return rank.pagerank(graph)


def _communities(graph: PropertyGraph, *_: Any) -> DataFrame:
    return community.label_propagation(graph).withColumnRenamed("community", "community_id")


def _text_search(graph: PropertyGraph, _index: str, text: str) -> DataFrame:
    return retrieve.bm25(graph.label("FUNCTION", "CLASS", "FILE", "SECTION"), "id", F.concat_ws(" ", "name", "summary", "path"), text, None)


PROCEDURES = {"pagerank.get": _page_rank, "community_detection.get": _communities, "text_search.search": _text_search}


def cypher(graph: PropertyGraph, text: str, params: dict[str, Any] | None = None, as_of: int | None = None, project: str | None = None, now: int = 0) -> DataFrame:
    """The result of a read query. as_of and project restrict every node scan."""
    return Compiler(graph, params, as_of, project, now).run(parse(text))


@dataclass(frozen=True)
class Intent:
    """A kind of question: stems of words that must occur, the query, and whether it needs the name of something."""

    stems: tuple[str, ...]
    query: str
    named: bool = False


INTENTS = (
    Intent(("file",), "MATCH (f:FILE) RETURN f.path AS path ORDER BY path"),
    Intent(("file", "under"), "MATCH (f:FILE) WHERE f.path STARTS WITH $name RETURN f.path AS path ORDER BY path", True),
    Intent(("file", "layer"), "MATCH (f:FILE) WHERE f.path CONTAINS $name RETURN f.path AS path ORDER BY path", True),
    Intent(("file", "import"), "MATCH (f:FILE)-[:IMPORTS]->(i:IMPORT)-[:REFERENCES]->(t:FILE) WHERE t.path = $name RETURN DISTINCT f.path AS path ORDER BY path", True),
    Intent(("function",), "MATCH (x:FUNCTION) RETURN x.name AS name ORDER BY name"),
    Intent(("function", "file"), "MATCH (f:FILE)-[:CONTAINS]->(x:FUNCTION) WHERE f.path = $name RETURN x.name AS name ORDER BY name", True),
    Intent(("call",), "MATCH (a:FUNCTION)-[:CALLS_TO]->(b:FUNCTION) WHERE b.name = $name RETURN DISTINCT a.name AS name ORDER BY name", True),
    Intent(("class",), "MATCH (c:CLASS) RETURN c.name AS name ORDER BY name"),
    Intent(("test", "cover"), "MATCH (t:TEST_CASE)-[:TESTS]->(x:CLASS|FUNCTION) RETURN x.name AS name, count(t) AS tests ORDER BY tests DESC, name"),
    Intent(("violation",), "MATCH (f:FILE)-[:VIOLATES_RULE]->(r:RULE) RETURN f.path AS path, r.id AS rule ORDER BY path, rule"),
)
CENSUS = "MATCH (n) RETURN labels(n)[0] AS type, count(n) AS count ORDER BY count DESC, type"
_QUOTED = re.compile(r"""(["'`])(.+?)\1""")


def from_words(question: str) -> tuple[str, dict[str, str]]:
    """(query, parameters) for a question in words: the intent with the most stems in it, the earlier one on ties.

    The name of something is what is quoted, or else the last word with a dot or slash. Intents that
    need a name are passed over without one; a question of no known kind gets a census of labels.
    """
    quoted = _QUOTED.search(question)
    words = [w.strip("?!,;:.") for w in question.split()]
    name = quoted[2] if quoted else next((w for w in reversed(words) if "/" in w or "." in w), None)
    asked = [w.lower() for w in _QUOTED.sub(" ", question).split()]
    fit = [i for i in INTENTS if (name or not i.named) and all(any(w.startswith(stem) for w in asked) for stem in i.stems)]
    if not fit:
        return CENSUS, {}
    best = max(fit, key=lambda i: len(i.stems) + i.named / 2)
    return best.query, {"name": name} if best.named else {}


def update(graph: PropertyGraph, text: str, params: dict[str, Any] | None = None, now: int = 0) -> PropertyGraph:
    """The graph after a write query: CREATE, MERGE [ON CREATE SET], MATCH ... SET, MATCH ... [DETACH] DELETE.

    Node properties are columns or entries of props. CREATE and MERGE take node patterns with an id.
    """
    (q,) = parse(text)
    frame = Frame(Compiler(graph, params, now=now))
    nodes, edges = graph.nodes, graph.edges
    for clause in q.clauses:
        if isinstance(clause, Match):
            frame.match(clause)
        elif isinstance(clause, Unwind):
            frame.unwind(clause)
        elif not isinstance(clause, Write):
            raise CypherError("only MATCH, UNWIND and write clauses are updates")
        elif clause.kind in ("create", "merge"):
            for p in clause.patterns:
                if p.rels:
                    edges = _created_edges(frame, p, edges)
                else:
                    nodes = _created_node(frame, p.nodes[0], clause, nodes, graph)
        elif clause.kind == "set":
            for var, key, value in clause.sets:
                nodes = _assigned(frame, nodes, var, key, value)
        else:
            for var in clause.names:
                gone = frame.df.select(F.col(f"{var}__id").alias("_gl_id")).distinct()
                touching = edges.join(gone, F.col("src") == F.col("_gl_id"), "left_anti").join(gone, F.col("dst") == F.col("_gl_id"), "left_anti")
                if not clause.detach:
                    raise CypherError("nodes with relationships need DETACH DELETE")
                edges = touching
                nodes = nodes.join(gone, F.col("id") == F.col("_gl_id"), "left_anti")
    return PropertyGraph(nodes, edges)


def _assigned(frame: Frame, nodes: DataFrame, var: str, key: str, value: Any) -> DataFrame:
    new = frame.df.select(F.col(f"{var}__id").alias("_gl_id"), frame.expr(value).alias("_gl_new")).dropDuplicates(["_gl_id"]).withColumn("_gl_hit", F.lit(True))
    rows = nodes.join(new, F.col("id") == F.col("_gl_id"), "left")
    column = next((c for c in (key, _snake(key)) if c in nodes.columns), None)
    if column:
        rows = rows.withColumn(column, F.when(F.col("_gl_hit"), F.col("_gl_new").cast(nodes.schema[column].dataType)).otherwise(F.col(column)))
    else:
        kept = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: k != key)
        rows = rows.withColumn("props", F.when(F.col("_gl_hit"), F.map_concat(kept, F.create_map(F.lit(key), F.col("_gl_new").cast("string")))).otherwise(F.col("props")))
    return rows.select(*nodes.columns)


def _created_node(frame: Frame, p: NodePattern, clause: Write, nodes: DataFrame, graph: PropertyGraph) -> DataFrame:
    given = dict(p.props) | {k: v for var, k, v in clause.sets if var == p.var}
    if "id" not in given or not p.labels:
        raise CypherError("a created node needs a label and an id")
    source = frame.df if frame.df is not None else graph.nodes.sparkSession.range(1).drop("id")
    values = {k: frame.expr(v) for k, v in given.items()}
    columns, used = [], set()
    for f in nodes.schema.fields:
        key = next((k for k in values if k == f.name or _snake(k) == f.name), None)
        if f.name == "type":
            columns.append(F.lit(p.labels[0]).alias("type"))
        elif key:
            used.add(key)
            columns.append(values[key].cast(f.dataType).alias(f.name))
        elif f.name != "props":
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
    if "props" in nodes.columns:
        rest = [x for k, v in values.items() if k not in used for x in (F.lit(k), v.cast("string"))]
        columns.append((F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")).alias("props"))
    new = source.select(*columns).dropDuplicates(["id"])
    if clause.kind == "merge":
        new = new.join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(new)


def _created_edges(frame: Frame, p: Pattern, edges: DataFrame) -> DataFrame:
    (a, b), (r,) = p.nodes, p.rels
    a, b = (b, a) if r.direction == "in" else (a, b)
    new = frame.df.select(F.col(f"{a.var}__id").alias("src"), F.col(f"{b.var}__id").alias("dst"), F.lit(r.types[0]).alias("type")).distinct()
    new = new.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return edges.unionByName(new, allowMissingColumns=True)
