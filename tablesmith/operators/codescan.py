"""Scans over scripts: data access, paths, old interfaces, safety, and line changes.

Input is a table ``path, text`` with one script per row. Python's own parser turns
a script into facts inside a task; resolving paths, rules and counts are columns.
"""

from __future__ import annotations

import ast
import functools
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import clamp, replace_words
from tablesmith.operators.automaton import occurrences
from tablesmith.operators.rules import Rule, flag_rows
from tablesmith.sources.paths import is_mount

# The writes that count, and the keyword names of a path argument.
WRITES = ["to_csv", "to_parquet", "to_json", "to_excel"]
PATH_ARGUMENTS = ["path", "filepath_or_buffer", "path_or_buf"]
# What a snippet may call and what it must not.
SAFE_MODULES = ["pd", "spark", "np"]
UNSAFE_FUNCTIONS = ["eval", "exec", "compile", "__import__", "open"]
UNSAFE_METHODS = ["system", "popen", "remove", "rmdir", "unlink"]
# Old interfaces and what replaces them.
OLD_INTERFACES = {
    "SQLContext": "Use SparkSession",
    "HiveContext": "Use SparkSession",
    "sqlContext": "Use spark from SparkSession",
}
REPLACED_NAMES = {"SQLContext": "SparkSession", "HiveContext": "SparkSession"}

_PARTS = "array<struct<kind:string,value:string,known:string>>"
_FACTS = (
    "error string, "
    f"calls array<struct<line:int,receiver:string,name:string,code:string,path:{_PARTS}>>, "
    "texts array<struct<line:int,value:string>>"
)
_SNIPPET = "parses boolean, call boolean, module string, name string, functions array<string>, methods array<string>"


_LEAVES = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)


def _nodes(roots: list[ast.AST]) -> list[ast.AST]:
    """All nodes below and at the given ones, level by level, those that only mark a use or an operator aside."""
    found = list(roots)
    for node in found:
        for field in node._fields:
            value = getattr(node, field, None)
            if type(value) is list:
                found += [v for v in value if isinstance(v, ast.AST) and not isinstance(v, _LEAVES)]
            elif isinstance(value, ast.AST) and not isinstance(value, _LEAVES):
                found.append(value)
    return found


def _path_parts(node: ast.expr | None, known: dict[str, str | None]) -> list[dict]:
    """A path expression as literal texts and names, with what a name holds here if that is certain; anything else is an unknown part."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return [{"kind": "text", "value": node.value, "known": node.value}]
    if isinstance(node, ast.Name):
        return [{"kind": "name", "value": node.id, "known": known.get(node.id)}]
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return _path_parts(node.left, known) + _path_parts(node.right, known)
    if isinstance(node, ast.JoinedStr):
        return [p for v in node.values for p in _path_parts(v.value if isinstance(v, ast.FormattedValue) else v, known)]
    return [{"kind": "unknown", "value": None, "known": None}]


def _text_of(node: ast.expr | None, known: dict[str, str | None]) -> str | None:
    """The text an expression has here, if that is certain."""
    texts = [p["known"] for p in _path_parts(node, known)]
    return "".join(texts) if texts and all(t is not None for t in texts) else None


def _call_fact(node: ast.Call, known: dict[str, str | None], code: bool) -> dict:
    named = {k.arg: k.value for k in node.keywords}
    path = node.args[0] if node.args else next((named[a] for a in PATH_ARGUMENTS if a in named), None)
    receiver = node.func.value.id if isinstance(node.func.value, ast.Name) else None
    return {
        "line": node.lineno, "receiver": receiver, "name": node.func.attr, "code": ast.unparse(node) if code else None,
        "path": None if path is None else _path_parts(path, known),
    }


def _bound(nodes: list[ast.AST]) -> set[str]:
    """The names that statements bind in any way, those of inner functions aside."""
    names: set[str] = set()
    front = list(nodes)
    while front:
        node = front.pop()
        kind = type(node)
        if kind is ast.Name:
            if type(node.ctx) is not ast.Load:
                names.add(node.id)
            continue
        if kind in _PLAIN:
            continue
        if kind in _DEFINITIONS:
            names.add(node.name)
            continue
        if kind is ast.alias:
            names.add(node.asname or node.name.split(".")[0])
        elif kind in _NAMING and node.name is not None:
            names.add(node.name)
        elif kind is ast.MatchMapping and node.rest is not None:
            names.add(node.rest)
        for field in node._fields:
            value = getattr(node, field, None)
            if type(value) is list:
                front += [v for v in value if isinstance(v, ast.AST)]
            elif isinstance(value, ast.AST):
                front.append(value)
    return names


_DEFINITIONS = {ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef}
_NAMING = {ast.ExceptHandler, ast.MatchAs, ast.MatchStar}
_PLAIN = {ast.Constant, ast.Lambda, ast.Load, ast.Store, ast.Del}


class _Reader:
    """Walks a script in the order in which it runs and notes calls with what the names in their paths hold at that place.

    A name holds the text last bound to it. Where ways meet, a name keeps its text only if all agree; a loop may
    run again, so what it binds is unknown where it begins. A function sees its own bindings, and of names outside those that are bound once.
    """

    def __init__(self, code: bool = True) -> None:
        self.calls: list[dict] = []
        self.code = code

    def block(self, body: list[ast.stmt], known: dict) -> dict:
        for statement in body:
            known = self.statement(statement, known)
        return known

    def look(self, nodes: list[ast.AST | None], known: dict) -> None:
        """Note the calls in expressions; names that they bind themselves are unknown in them."""
        for node in nodes:
            every = [] if node is None else _nodes([node])
            found = [n for n in every if type(n) is ast.Call and type(n.func) is ast.Attribute and (n.func.attr.startswith("read_") or n.func.attr in WRITES)]
            if found:
                inner = known | dict.fromkeys(_bound([node]) | {a.arg for n in every if isinstance(n, ast.Lambda) for a in ast.walk(n.args) if isinstance(a, ast.arg)})
                self.calls += [_call_fact(n, inner, self.code) for n in found]

    def statement(self, node: ast.stmt, known: dict) -> dict:
        match node:
            case ast.Assign(targets=targets, value=value):
                self.look([*targets, value], known)
                plain = {t.id for t in targets if isinstance(t, ast.Name)}
                return known | dict.fromkeys(_bound([*targets, value])) | dict.fromkeys(plain, _text_of(value, known))
            case ast.AnnAssign(target=ast.Name(id=name), value=ast.expr() as value):
                self.look([value], known)
                return known | {name: _text_of(value, known)}
            case ast.AugAssign(target=ast.Name(id=name) as target, op=ast.Add(), value=value):
                self.look([value], known)
                return known | {name: _text_of(ast.BinOp(ast.Name(id=target.id, ctx=ast.Load()), ast.Add(), value), known)}
            case ast.If(test=test, body=body, orelse=orelse):
                self.look([test], known)
                return _agreed(self.block(body, known), self.block(orelse, known))
            case ast.For(iter=iterable, body=body, orelse=orelse) | ast.AsyncFor(iter=iterable, body=body, orelse=orelse):
                self.look([iterable], known)
                again = known | dict.fromkeys(_bound([node.target, *body]))
                return self.block(orelse, _agreed(known, self.block(body, again)))
            case ast.While(test=test, body=body, orelse=orelse):
                again = known | dict.fromkeys(_bound(body))
                self.look([test], again)
                return self.block(orelse, _agreed(known, self.block(body, again)))
            case ast.With(items=items, body=body) | ast.AsyncWith(items=items, body=body):
                self.look(list(items), known)
                return self.block(body, known | dict.fromkeys(_bound(list(items))))
            case ast.Try(body=body, handlers=handlers, orelse=orelse, finalbody=final) | ast.TryStar(body=body, handlers=handlers, orelse=orelse, finalbody=final):
                tried = self.block(body, known)
                broken = known | dict.fromkeys(_bound(body))  # it may have stopped anywhere
                ways = [self.block(orelse, tried), *[self.block(h.body, broken | dict.fromkeys([h.name] if h.name else [])) for h in handlers]]
                return self.block(final, _agreed(*ways))
            case ast.Match(subject=subject, cases=cases):
                self.look([subject], known)
                return _agreed(known, *[self.block(c.body, known | dict.fromkeys(_bound([c.pattern]))) for c in cases])
            case ast.FunctionDef(args=args, body=body) | ast.AsyncFunctionDef(args=args, body=body):
                self.look([*node.decorator_list, *args.defaults, *args.kw_defaults], known)
                own = {a.arg for a in ast.walk(args) if isinstance(a, ast.arg)} | _bound(body)
                self.block(body, known | self.once | dict.fromkeys(own))
                return known | {node.name: None}
            case ast.ClassDef(body=body):
                self.look([*node.decorator_list, *node.bases], known)
                self.block(body, known)
                return known | {node.name: None}
            case _:
                self.look([node], known)
                return known | dict.fromkeys(_bound([node]))

    def read(self, module: ast.Module, nodes: list[ast.AST]) -> list[dict]:
        bound = Counter(n.id for n in nodes if type(n) is ast.Name and type(n.ctx) is ast.Store)
        single = {t.id: s.value for s in module.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name) and bound[t.id] == 1}
        # a function may run later: names bound more than once are unknown in it, names bound once hold their text
        self.once = dict.fromkeys(bound) | {name: _text_of(value, {}) for name, value in single.items()}
        self.block(module.body, {})
        return self.calls


def _agreed(*ways: dict) -> dict:
    """What names hold where several ways meet."""
    names = set().union(*ways)
    return {n: ways[0].get(n) if all(w.get(n) == ways[0].get(n) for w in ways) else None for n in names}


def _script_facts(text: str, code: bool = True) -> str:
    facts = {"error": None, "calls": [], "texts": []}
    try:
        module = ast.parse(text)
        nodes = _nodes([module])
        facts["calls"] = _Reader(code).read(module, nodes)
    except (SyntaxError, ValueError, RecursionError) as problem:
        return json.dumps(facts | {"error": f"{type(problem).__name__}: {problem}", "calls": []})
    for node in nodes:
        if type(node) is ast.Constant and isinstance(node.value, str) and "/mnt/" in node.value:
            facts["texts"].append({"line": node.lineno, "value": node.value})
    return json.dumps(facts)


def _snippet_facts(text: str) -> str:
    try:
        root = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, RecursionError):
        return json.dumps({"parses": False})
    calls = [n.func for n in ast.walk(root) if isinstance(n, ast.Call)]
    head = root.func if isinstance(root, ast.Call) else None
    plain = isinstance(head, ast.Attribute) and isinstance(head.value, ast.Name)
    return json.dumps(
        {
            "parses": True, "call": isinstance(root, ast.Call),
            "module": head.value.id if plain else None, "name": head.attr if plain else None,
            "functions": [c.id for c in calls if isinstance(c, ast.Name)],
            "methods": [c.attr for c in calls if isinstance(c, ast.Attribute)],
        }
    )


def _parsed(column: Column, function, schema: str) -> Column:
    def batches(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in values:
            yield series.map(function, na_action="ignore")

    batches.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # Marked as not repeatable, so that no filter derived from the result runs it again.
    return F.from_json(F.pandas_udf(batches, "string").asNondeterministic()(column), schema)


def without_magics(text: str | Column) -> Column:
    """Notebook commands (``%run``, ``!ls``) turned into comments, so the rest parses."""
    return F.regexp_replace(text, r"(?m)^[ \t]*[%!].*$", "# $0")


def script_facts(scripts: DataFrame, code: bool = True) -> DataFrame:
    """One row per script: calls of interest and mount texts, or the parse error. Without ``code`` the text of calls, costly to write, is null."""
    facts = _parsed(without_magics("text"), functools.partial(_script_facts, code=code), _FACTS)
    return scripts.select("path", facts.alias("_f")).select("path", "_f.*")


def _resolved(parts: Column) -> Column:
    """The path if every part is known, else null."""
    known = (F.size(parts) > 0) & F.forall(parts, lambda p: p["known"].isNotNull())
    return F.when(F.coalesce(known, F.lit(False)), F.array_join(F.transform(parts, lambda p: p["known"]), ""))


def _variable(parts: Column) -> Column:
    """The name of a path given by one variable, ``expression`` for a compound path."""
    single = F.when(F.get(parts, F.lit(0))["kind"] == "name", F.get(parts, F.lit(0))["value"])
    return F.when(F.size(parts) == 1, single).when(F.size(parts) > 1, "expression")


def access_findings(facts: DataFrame) -> DataFrame:
    """Reads through ``pd`` and the supported writes: line, operation, code, path, variable, mount."""
    call = facts.select("path", F.explode("calls").alias("c"))
    used = _resolved(F.col("c.path"))
    return call.where(_is_read(F.col("c")) | _is_write(F.col("c"))).select(
        F.col("path").alias("file_path"),
        F.col("c.line").alias("line_number"),
        F.concat(F.lit("pandas_"), "c.name").alias("operation_type"),
        F.col("c.code").alias("code_content"),
        used.alias("path_used"),
        _variable(F.col("c.path")).alias("variable_name"),
        is_mount(used).alias("is_mount_point"),
    )


def mount_references(facts: DataFrame) -> DataFrame:
    """Text constants that mention mounted storage."""
    text = facts.select("path", F.explode("texts").alias("t"))
    return text.select(
        F.col("path").alias("file_path"), F.col("t.line").alias("line_number"),
        F.lit("mount_point_reference").alias("operation_type"), F.col("t.value").alias("path_used"),
    )


def scan_errors(facts: DataFrame) -> DataFrame:
    return facts.where("error IS NOT NULL").select(F.col("path").alias("file_path"), "error")


def access_counts(facts: DataFrame) -> DataFrame:
    """Reads, writes and findings on mounts per script, scripts without any included. Counted in the script's own row."""
    found = F.filter("calls", lambda c: _is_read(c) | _is_write(c))

    def times(condition) -> Column:
        return F.coalesce(F.size(F.filter(found, lambda c: F.coalesce(condition(c), F.lit(False)))), F.lit(0)).cast("bigint")

    return facts.select(
        F.col("path").alias("file_path"), F.col("error").isNull().alias("parsed"), times(lambda c: c["name"].startswith("read_")).alias("reads"),
        times(lambda c: c["name"].startswith("to_")).alias("writes"), times(lambda c: is_mount(_resolved(c["path"]))).alias("mount_points"),
    )


def _is_read(call: Column) -> Column:
    return F.coalesce((call["receiver"] == "pd") & call["name"].startswith("read_"), F.lit(False))


def _is_write(call: Column) -> Column:
    return call["name"].isin(WRITES) & call["path"].isNotNull()


def snippet_safety(snippets: DataFrame, text: str = "text") -> DataFrame:
    """Is a snippet one single read call without anything dangerous in it? With the reason."""
    s = F.col("_s")
    bad_function = F.get(F.filter(s["functions"], lambda f: f.isin(UNSAFE_FUNCTIONS)), F.lit(0))
    bad_method = F.get(F.filter(s["methods"], lambda m: m.isin(UNSAFE_METHODS)), F.lit(0))
    # The wording of the reasons.
    reason = (
        F.when(~s["parses"], "Invalid Python syntax")
        .when(~s["call"], "Code must be a single function call")
        .when(s["module"].isNull(), "Not a valid pandas/spark read operation")
        .when(~s["module"].isin(SAFE_MODULES), F.format_string("Module '%s' not allowed", s["module"]))
        .when(~s["name"].startswith("read_"), F.format_string("Operation '%s' not allowed (only read operations)", s["name"]))
        .when(bad_function.isNotNull(), F.format_string("Dangerous function '%s' detected", bad_function))
        .when(bad_method.isNotNull(), F.format_string("Dangerous operation '%s' detected", bad_method))
        .otherwise("Safe")
    )
    labelled = snippets.withColumn("_s", _parsed(F.col(text), _snippet_facts, _SNIPPET)).withColumn("reason", reason)
    return labelled.withColumn("is_safe", F.col("reason") == "Safe").drop("_s")


def migration_flags(scripts: DataFrame, keep_unflagged: bool = False) -> DataFrame:
    """Old ways of using Spark, by text."""
    text = F.col("text")
    # The findings and the advice.
    rules = [
        Rule("sc.", "HIGH", text.contains("sc.") & text.contains("SparkContext"), "Use SparkSession instead of SparkContext"),
        Rule("RDD usage", "MEDIUM", F.lower(text).contains("rdd"), "Use DataFrames API for better performance"),
    ]
    return flag_rows(scripts, rules, ["path"], keep_unflagged)


def migration_risk(scripts: DataFrame) -> DataFrame:
    """HIGH findings per script, each occurrence counted, and the level they make."""
    text = F.col("text")
    high = F.when(text.contains("SparkContext"), F.regexp_count(text, F.lit(r"\bsc\."))).otherwise(F.lit(0)).cast("bigint")
    level = F.when(F.col("high") > 3, "CRITICAL").when(F.col("high") > 0, "HIGH").otherwise("LOW")
    return scripts.select("path", high.alias("high")).withColumn("risk_level", level)


def old_interfaces(scripts: DataFrame) -> DataFrame:
    """Old interface names a script mentions, with the advice."""
    found = [
        F.when(F.col("text").contains(old), F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")))
        for old, new in OLD_INTERFACES.items()
    ]
    return scripts.select("path", F.explode(F.array_compact(F.array(*found))).alias("_f")).select("path", "_f.*")


def dictionary_findings(scripts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(path, old, new, times): names of a dictionary (old, new) of any size that a script mentions, with the advice."""
    names = [r.old for r in dictionary.select("old").distinct().collect() if r.old]
    found = occurrences(scripts, "text", names, ["path"])
    return found.select("path", F.col("pattern").alias("old"), "times").join(dictionary.select("old", "new").distinct(), "old").select("path", "old", "new", "times")


def modernised(text: str | Column) -> Column:
    """The text with old interface names replaced."""
    return replace_words(text, REPLACED_NAMES)


def line_changes(before: Column, after: Column) -> Column:
    """Lines that differ at the same place and are blank on neither side, as an array.

    Lines are compared as they are and reported trimmed.
    """
    blanks = r"^[ \t\r\n\f]+|[ \t\r\n\f]+$"
    pairs = F.arrays_zip(F.split(before, "\n").alias("a"), F.split(after, "\n").alias("b"))
    numbered = F.transform(
        pairs,
        lambda p, i: F.struct(
            (i + 1).alias("line_number"),
            F.regexp_replace(p["a"], blanks, "").alias("original"),
            F.regexp_replace(p["b"], blanks, "").alias("converted"),
            (p["a"] != p["b"]).alias("differs"),
        ),
    )
    return F.filter(numbered, lambda r: r["differs"] & (r["original"] != "") & (r["converted"] != ""))


def confidence(changes: Column) -> Column:
    """One minus five percent per change, between 0.6 and 1."""
    return clamp(F.lit(1.0) - changes * F.lit(0.05), 0.6, 1.0)
