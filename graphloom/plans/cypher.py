"""A subset of Cypher compiled to joins over nodes and edges, and the guard that keeps queries read-only.

MATCH one path of labelled nodes and typed relations (also `*1..n`), WHERE with comparisons, IN, CONTAINS, STARTS WITH,
ENDS WITH, AND, OR, NOT; RETURN with aliases, DISTINCT and count; ORDER BY; LIMIT. Anything else is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Words that would write.
WRITES = ("create", "set", "merge", "remove", "delete", "drop", "alter", "copy", "load", "install", "detach", "export")
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<op><=|>=|<>|->|<-|\.\.|[-(){}\[\]:,.=<>*|]))""")


def is_write(query: str) -> bool:
    """Whether a query has a writing word outside strings that is no label or type (after a colon)."""
    bare = re.sub(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|//[^\n]*""", " ", query)
    return any(m[2].lower() in WRITES for m in re.finditer(r"(:?)\s*\b([A-Za-z_]\w*)", bare) if not m[1])


class _Reader:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if not text[at:].strip():
                    break
                raise ValueError(f"unsupported Cypher at: {text[at : at + 20]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1].lower() in values

    def take(self, *values: str) -> str:
        if self.at >= len(self.tokens) or values and not self.peek(*values):
            raise ValueError(f"unsupported Cypher: expected {' or '.join(values) or 'more'}, got {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def maybe(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def literal(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "num":
            return float(value) if "." in value else int(value)
        if value.lower() in ("true", "false"):
            return value.lower() == "true"
        raise ValueError(f"unsupported Cypher: {value} is no literal")


def _element(r: _Reader, end: str, letter: str) -> dict:
    name = r.take() if r.at < len(r.tokens) and r.tokens[r.at][0] == "word" else f"_{letter}{r.at}"
    out = {"name": name, "labels": [], "props": {}, "hops": None}
    if r.maybe(":"):
        out["labels"].append(r.take())
        while r.maybe("|"):
            r.maybe(":")
            out["labels"].append(r.take())
    if r.maybe("*"):
        lo = int(r.take()) if r.tokens[r.at][0] == "num" else 1
        hi = lo
        if r.maybe(".."):
            hi = int(r.take())
        out["hops"] = (lo, hi)
    if r.maybe("{"):
        while not r.maybe("}"):
            key = r.take()
            r.take(":")
            out["props"][key] = r.literal()
            r.maybe(",")
    r.take(end)
    return out


def _property(r: _Reader, frames: dict[str, str]) -> Column:
    name = r.take()
    if name.lower() == "labels" and r.maybe("("):
        v = r.take()
        r.take(")")
        return F.col(f"{v}__label")
    if name.lower() == "label" and r.maybe("("):
        v = r.take()
        r.take(")")
        return F.col(f"{v}__label")
    if name not in frames:
        raise ValueError(f"unsupported Cypher: unknown name {name}")
    if r.maybe("."):
        return F.col(f"{name}__{r.take()}")
    return F.col(f"{name}__id")


def _value(r: _Reader, frames) -> Column:
    kind, value = r.tokens[r.at]
    return _property(r, frames) if kind == "word" and value.lower() not in ("true", "false") else F.lit(r.literal())


def _test(r: _Reader, frames) -> Column:
    if r.maybe("not"):
        return ~_test(r, frames)
    if r.maybe("("):
        out = _either(r, frames)
        r.take(")")
        return out
    lower = lambda c: c
    left = lower(_value(r, frames))
    if r.maybe("in"):
        r.take("[")
        values = []
        while not r.maybe("]"):
            values.append(r.literal())
            r.maybe(",")
        return left.isin(*values)
    if r.maybe("contains"):
        return left.contains(_value(r, frames))
    if r.maybe("starts"):
        r.take("with")
        return left.startswith(_value(r, frames))
    if r.maybe("ends"):
        r.take("with")
        return left.endswith(_value(r, frames))
    if r.maybe("is"):
        negated = r.maybe("not")
        r.take("null")
        return left.isNotNull() if negated else left.isNull()
    op = r.take("=", "<>", "<", ">", "<=", ">=")
    right = _value(r, frames)
    return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]


def _both(r, frames) -> Column:
    out = _test(r, frames)
    while r.maybe("and"):
        out = out & _test(r, frames)
    return out


def _either(r, frames) -> Column:
    out = _both(r, frames)
    while r.maybe("or"):
        out = out | _both(r, frames)
    return out


def _tested(df: DataFrame, e: dict, label_column: str | None) -> DataFrame:
    if label_column and e["labels"]:
        df = df.filter(F.col(f"{e['name']}__{label_column}").isin(*e["labels"]))
    for k, v in e["props"].items():
        df = df.filter(F.col(f"{e['name']}__{k}") == v)
    return df


def _hops(edges: DataFrame, lo: int, hi: int, name: str, starts: DataFrame, forward: bool) -> DataFrame:
    """Pairs of ends of walks of lo .. hi relations from the starts (id), along or against the relations, each pair and length once."""
    ends = ("sourceId", "targetId") if forward else ("targetId", "sourceId")
    step = edges.select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b")).distinct()
    level, out = step.join(starts.select(F.col("id").alias("a")), "a", "left_semi"), None
    for n in range(1, hi + 1):
        if n > 1:
            level = level.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        if n >= lo:
            here = level.withColumn("hops", F.lit(n))
            out = here if out is None else out.union(here)
    return out.select(F.col("a").alias(f"{name}__{ends[0]}"), F.col("b").alias(f"{name}__{ends[1]}"), F.col("hops").alias(f"{name}__hops"))


def run(query: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of a read-only query; ValueError for anything outside the subset."""
    if is_write(query):
        raise ValueError("only reading queries are allowed")
    r = _Reader(query)
    r.take("match")
    r.take("(")
    first = _element(r, ")", "n")
    path = [first]
    while r.peek("-", "<-"):
        left = r.maybe("<-")
        if not left:
            r.take("-")
        r.take("[")
        rel = _element(r, "]", "r")
        if left:
            r.take("-")
            direction = "in"
        else:
            direction = "out" if r.maybe("->") else "both"
            if direction == "both":
                r.take("-")
        r.take("(")
        path += [(rel, direction), _element(r, ")", "n")]
    as_node = lambda e: _tested(nodes.select(*[F.col(c).alias(f"{e['name']}__{c}") for c in nodes.columns]), e, "label")
    frames, df = {first["name"]: "node"}, as_node(first)
    for i in range(1, len(path), 2):
        (rel, direction), node = path[i], path[i + 1]
        last, name = path[i - 1]["name"], rel["name"]
        # The stored table of all relations has one name; its types are a property.
        types = [x for x in rel["labels"] if x != "CodeRelation"] + ([rel["props"].pop("type")] if "type" in rel["props"] else [])
        e = edges.filter(F.col("type").isin(*types)) if types else edges
        if rel["hops"]:
            if rel["hops"][1] > 10 or rel["hops"][0] < 1:
                raise ValueError("a variable path has 1 to 10 relations")
        else:
            e = _tested(e.select(*[F.col(c).alias(f"{name}__{c}") for c in edges.columns]), rel, None)
        source, target = F.col(f"{name}__sourceId"), F.col(f"{name}__targetId")
        ways = {"out": [(source, target)], "in": [(target, source)], "both": [(source, target), (target, source)]}[direction]
        joined = None
        for a, b in ways:
            if rel["hops"]:
                starts = df.select(F.col(f"{last}__id").alias("id")).distinct()
                walked = _hops(e, *rel["hops"], name, starts, a is source).select(f"{name}__sourceId", f"{name}__targetId", f"{name}__hops")
            else:
                walked = e
            j = df.join(walked, F.col(f"{last}__id") == a)
            j = j.filter(F.col(f"{node['name']}__id") == b) if node["name"] in frames else j.join(as_node(node), b == F.col(f"{node['name']}__id"))
            joined = j if joined is None else joined.union(j)
        df = joined
        frames |= {name: "edge", node["name"]: "node"}
    if r.maybe("where"):
        df = df.filter(_either(r, frames))
    r.take("return")
    distinct, columns, counts, names = r.maybe("distinct"), [], [], {}
    while True:
        begin = r.at
        if r.peek("count") and r.tokens[r.at + 1][1] == "(":
            r.take(), r.take()
            one = r.maybe("distinct")
            inner = None if r.maybe("*") else _property(r, frames)
            r.take(")")
            col, is_count = (F.count("*") if inner is None else F.countDistinct(inner) if one else F.count(inner)), True
        else:
            col, is_count = _property(r, frames), False
        shown = "".join(t for _, t in r.tokens[begin : r.at])
        alias = r.take() if r.maybe("as") else shown
        names[shown] = alias
        (counts if is_count else columns).append(col.alias(alias))
        if not r.maybe(","):
            break
    order = list(names.values())
    df = df.groupBy(*columns).agg(*counts).select(*[F.col(f"`{c}`") for c in order]) if counts else df.select(*columns)
    df = df.distinct() if distinct else df
    if r.maybe("order"):
        r.take("by")
        keys = []
        while True:
            begin = r.at
            r.take()
            if r.maybe("."):
                r.take()
            shown = "".join(t for _, t in r.tokens[begin : r.at])
            c = F.col(f"`{names.get(shown, shown)}`")
            keys.append(c.desc() if r.maybe("desc") else (r.maybe("asc"), c.asc())[1])
            if not r.maybe(","):
                break
        df = df.orderBy(*keys)
    if r.maybe("limit"):
        df = df.limit(int(r.take()))
    if r.at < len(r.tokens):
        raise ValueError(f"unsupported Cypher: {r.tokens[r.at][1]}")
    return df


def markdown(df: DataFrame, most: int = 500) -> str:
    """Rows as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
