"""Source-code analysis: one walk of a file's syntax tree gives rows, everything else is joins.

``parse_python`` is a table function over (path, content): definitions, calls, imports, name reads and
writes, literals and rule findings as rows of one shape. It runs row by row where files are, in parallel.
"""

from __future__ import annotations

import ast
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.functions.rules import broken_rules

ROWS = "path string, kind string, name string, owner string, line int, end_line int, detail string"

def _name(node: ast.AST) -> str:
    """Dotted name of a call target or attribute; the last part if something else is in front."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _name(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return ""


def _receiver(node: ast.AST) -> str:
    """self, name, expr or none: what a method is called on."""
    if not isinstance(node, ast.Attribute):
        return "none"
    if isinstance(node.value, ast.Name):
        return "self" if node.value.id in ("self", "cls") else "name"
    return "expr"


def _own_nodes(fn):
    """The nodes of a function without what is inside functions and classes in it."""
    todo = list(fn.body)
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            todo += ast.iter_child_nodes(n)


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.rows, self.scope = path, [], []

    def add(self, kind: str, name: str, node: ast.AST, detail: str = "") -> None:
        line = getattr(node, "lineno", 0)
        self.rows.append((self.path, kind, name, ".".join(self.scope), line, getattr(node, "end_lineno", line) or line, detail))

    def _locals(self, fn) -> None:
        """A row per local that starts as a constant: how it is updated, how often to a constant, and exits of blocks that do not."""
        starts: dict[str, ast.Assign] = {}
        for s in fn.body:
            if isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant):
                for t in s.targets:
                    if isinstance(t, ast.Name):
                        starts.setdefault(t.id, s)
        if not starts:
            return
        own = list(_own_nodes(fn))
        for name, first in starts.items():
            sets = lambda n: isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == name for t in n.targets)  # noqa: E731, B023
            again = [n for n in own if sets(n) and n is not first]
            forms = ["constant" if isinstance(n.value, ast.Constant) else "computed" for n in again]
            forms += ["augmented" for n in own if isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name) and n.target.id == name]
            forms += ["loop" for n in own if isinstance(n, (ast.For, ast.AsyncFor)) and isinstance(n.target, ast.Name) and n.target.id == name]
            blocks = [b for n in own if isinstance(n, (ast.If, ast.ExceptHandler)) for b in ([n.body, n.orelse] if isinstance(n, ast.If) else [n.body]) if b]
            exits = sum(isinstance(b[-1], (ast.Return, ast.Continue, ast.Break, ast.Raise)) and not any(sets(n) for s in b for n in ast.walk(s)) for b in blocks)
            self.add("local", name, first, f"{'+'.join(sorted(set(forms)))}|{forms.count('constant')}|{exits}")

    def _define(self, kind: str, node) -> None:
        self.add(kind, ".".join([*self.scope, node.name]), node, ",".join(filter(None, (_name(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list))))
        self.scope.append(node.name)
        if kind != "class":
            for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                self._typed(a.arg, a.annotation, a)
            self._locals(node)
        self.generic_visit(node)
        self.scope.pop()

    def _typed(self, name: str, value: ast.AST | None, node: ast.AST) -> None:
        """A name that holds an instance: its class, as a call or an annotation names it."""
        made = _name(value.func) if isinstance(value, ast.Call) else value.value if isinstance(value, ast.Constant) and isinstance(value.value, str) else _name(value) if value is not None else ""
        if made and made.rsplit(".", 1)[-1][:1].isupper():
            self.add("typed", name, node, made)

    def visit_Assign(self, node):
        for t in node.targets:
            if isinstance(t, ast.Name) and isinstance(node.value, ast.Call):
                self._typed(t.id, node.value, node)
            elif isinstance(t, ast.Name) and isinstance(node.value, ast.Name) and not self.scope:
                self.add("alias", t.id, node, node.value.id)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name):
            self._typed(node.target.id, node.annotation, node)
        self.generic_visit(node)

    def visit_ClassDef(self, node):
        self._define("class", node)

    def visit_FunctionDef(self, node):
        self._define("function", node)

    def visit_AsyncFunctionDef(self, node):
        self._define("async_function", node)

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", a.name, node, a.asname or "")

    def visit_ImportFrom(self, node):
        for a in node.names:
            self.add("import", "." * node.level + (f"{node.module}." if node.module else "") + a.name, node, a.asname or "")

    def visit_Call(self, node):
        self.add("call", _name(node.func) or "?", node, _receiver(node.func))
        self.generic_visit(node)

    def visit_Name(self, node):
        self.add("read" if isinstance(node.ctx, ast.Load) else "write", node.id, node)

    def visit_Global(self, node):
        for n in node.names:
            self.add("global", n, node)

    def visit_Constant(self, node):
        if isinstance(node.value, str) and 0 < len(node.value) <= 400:
            self.add("literal", node.value, node)


def analyse(path: str, content: str) -> list[tuple]:
    """All rows of a file; a file that does not parse gives one row of kind error."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "error", type(e).__name__, "", getattr(e, "lineno", 0) or 0, 0, str(e)[:200])]
    walk = _Walk(path)
    walk.visit(tree)
    return walk.rows + [(path, "rule", name, "", line, line, rule) for name, rule, line in broken_rules(path, content, tree)]


def parse_python(files: DataFrame) -> DataFrame:
    """Rows of ROWS for every file of (path, content), by a table function."""
    from pyspark.sql.functions import udtf

    spark = files.sparkSession

    @udtf(returnType=T._parse_datatype_string(ROWS))
    class Parse:
        def eval(self, path: str, content: str):
            yield from analyse(path, content or "")

    # Names of one call: they are not to meet a user's views or another call's.
    name = f"strataq_{uuid.uuid4().hex}"
    spark.udtf.register(f"{name}_parse", Parse)
    return spark.sql(f"SELECT t.* FROM {{files}} f, LATERAL {name}_parse(f.path, f.content) t", files=files.select("path", "content"))


#: The rungs of call resolution in their order, with the rank of the first candidate of each.
RUNGS = (("self", 0), ("nested", 10), ("typed", 40), ("module", 50), ("import", 60), ("unique", 90))


def module_of(path):
    """The dotted module of a file's path."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^.*?([A-Za-z0-9_]+(/[A-Za-z0-9_]+)*)[.]py$", "$1"), "/", "."), "[.]__init__$", "")


def resolve_python_calls(rows: DataFrame) -> DataFrame:
    """(path, line, name, target, rung) of calls; ? where no rung fits.

    Rungs: a method of the caller's own class; a definition nested in the caller or outwards; a method of the class that the
    receiver was made of or annotated with; a definition of the module, or another name for one; what an import brings in, by
    name or by module; a method name that is unique. A call names its candidates with their ranks, and these meet definitions
    in one join on equal keys; the least rank wins.
    """
    defs = rows.where("kind IN ('function', 'async_function', 'class')").select("path", "name", F.concat_ws("::", "path", "name").alias("target"))
    unique = defs.groupBy(F.substring_index("name", ".", -1).alias("last")).agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1")
    keys = defs.select(F.col("target").alias("key"), "target").unionByName(defs.select(F.concat(F.lit("fqn:"), module_of(F.col("path")), F.lit("."), "name").alias("key"), "target"))
    keys = keys.unionByName(unique.select(F.concat(F.lit("last:"), "last").alias("key"), "target")).groupBy("key").agg(F.min("target").alias("target"))

    calls = rows.where("kind = 'call'").groupBy("path", "line", "name", "owner").agg(F.count("*").alias("times"))
    calls = calls.withColumn("head", F.substring_index("name", ".", 1)).withColumn("rest", F.expr("substr(name, length(head) + 1)"))
    one = lambda kind, *more: rows.where(F.col("kind") == kind).groupBy("path", *more, F.col("name").alias("head")).agg(F.min("detail").alias(kind))
    calls = calls.join(one("typed", "owner"), ["path", "owner", "head"], "left").join(one("alias"), ["path", "head"], "left")
    brought = import_map(rows).groupBy("path", "local").agg(F.min("fqn").alias("fqn"))
    side = lambda of, name: brought.select("path", F.col("local").alias(of), F.col("fqn").alias(name))
    calls = calls.withColumn("t_head", F.substring_index("typed", ".", 1)).join(side("head", "h_fqn"), ["path", "head"], "left").join(side("t_head", "t_fqn"), ["path", "t_head"], "left")

    here = lambda name: F.concat(F.col("path"), F.lit("::"), name)
    at = lambda rank, key: F.struct(F.lit(rank).alias("rank"), key.alias("key"))
    inside = F.regexp_replace("owner", "[.][^.]+$", "")
    owners = F.split("owner", "[.]")
    outward = F.transform(
        F.when(F.col("owner") == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(owners))),
        lambda k: F.struct((F.size(owners) - k + 10).alias("rank"), here(F.concat(F.array_join(F.slice(owners, 1, k), "."), F.lit("."), F.col("name"))).alias("key")),
    )
    fixed = F.array(
        at(0, F.when(F.col("head").isin("self", "cls") & F.contains("owner", F.lit(".")), here(F.concat(inside, "rest")))),
        at(40, here(F.concat("typed", "rest"))), at(41, F.concat(F.lit("fqn:"), "t_fqn", F.expr("substr(typed, length(t_head) + 1)"), "rest")),
        at(50, here(F.col("name"))), at(51, here(F.concat("alias", "rest"))), at(60, F.concat(F.lit("fqn:"), "h_fqn", "rest")),
        at(90, F.concat(F.lit("last:"), F.substring_index("name", ".", -1))),
    )
    asked = calls.select("path", "line", "name", "owner", "times", F.explode(F.filter(F.concat(outward, fixed), lambda c: c["key"].isNotNull())).alias("c")).select("*", "c.rank", "c.key").drop("c")
    best = asked.join(keys, "key", "left").groupBy("path", "line", "name", "owner").agg(F.min(F.when(F.col("target").isNotNull(), F.struct("rank", "target"))).alias("b"), F.max("times").alias("times"))
    rung = F.lit("?")
    for name, rank in RUNGS:
        rung = F.when(F.col("b.rank") >= rank, name).otherwise(rung)
    found = best.select("path", "line", "name", F.coalesce("b.target", F.lit("?")).alias("target"), rung.alias("rung"), "times")
    return found.select("path", "line", "name", "target", "rung", F.explode(F.sequence(F.lit(1), "times")).alias("_k")).drop("_k")


def flag_bindings(rows: DataFrame) -> DataFrame:
    """Locals with a constant start as ``operators.stores.ranked_flags`` takes them."""
    part = lambda k: F.split("detail", "[|]")[k]
    forms = F.filter(F.split(part(0), "[+]"), lambda x: x != "")
    return rows.where("kind = 'local'").select(
        F.concat_ws("::", "path", "owner", "name").alias("id"), "path", "line", F.lit(True).alias("init_is_constant"), forms.alias("assign_forms"), part(1).cast("int").alias("constant_rebinds"), part(2).cast("int").alias("guard_exits")
    )


def normalised_type(value):
    """A declared type without type arguments, array brackets, optional marks, qualifiers and package: ``final java.util.List<String>[]`` is List."""
    t = F.regexp_replace(F.trim(value), "^((final|const|static|readonly|public|private|protected|mut|ref|in|out)\\s+)+", "")
    for _ in range(4):
        t = F.regexp_replace(t, "<[^<>]*>|\\[[^\\[\\]]*\\]", "")
    t = F.regexp_replace(F.trim(F.regexp_replace(t, "[?&*!]+|\\s*\\|\\s*(None|null|undefined)", "")), "^.*(\\.|::)", "")
    return F.when(t.rlike("^[A-Za-z_$][A-Za-z0-9_$]*$"), t)


def import_map(rows: DataFrame) -> DataFrame:
    """(path, local, fqn): what a file's imports call a name, relative imports resolved against the file's package."""
    brought = rows.where("kind = 'import'").select("path", "name", F.when(F.col("detail") != "", F.col("detail")).otherwise(F.regexp_extract("name", "([^.]+)$", 1)).alias("local"))
    dots = F.length(F.regexp_extract("name", "^[.]*", 0))
    parts = F.split(module_of(F.col("path")), "[.]")
    # A package's own file is one level below its name already.
    up = F.when(F.col("path").endswith("/__init__.py"), dots - 1).otherwise(dots)
    package = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), ".")
    rest = F.regexp_replace("name", "^[.]+", "")
    return brought.select("path", "local", F.when(dots == 0, F.col("name")).otherwise(F.concat_ws(".", F.when(package != "", package), rest)).alias("fqn")).distinct()


def literal_flavour(value):
    """path, key or null of a literal."""
    return F.when(value.rlike("[/~]|[.](json|jsonl|yaml|yml|toml|txt|md|csv|db|sqlite|log|py|sh|parquet)$") & (F.length(value) <= 400) & ~value.rlike("\\s"), "path").when(value.rlike("^[A-Za-z_][A-Za-z0-9_]{0,63}$"), "key")


def unread_names(rows: DataFrame) -> DataFrame:
    """(path, name): module-level names that are written and read nowhere."""
    writes = rows.where("kind = 'write' AND owner = ''").select("path", "name").distinct()
    return writes.join(rows.where("kind = 'read'").select("name").distinct(), "name", "left_anti").select("path", "name")


def near_literals(rows: DataFrame) -> DataFrame:
    """(stem, a, b): path literals of different files that share a stem but differ."""
    lit = rows.where("kind = 'literal'").where(literal_flavour(F.col("name")) == "path")
    lit = lit.select("path", "name", F.lower(F.regexp_extract("name", "([^/]+?)([.][A-Za-z0-9]+)?$", 1)).alias("stem")).where("stem <> ''").distinct()
    other = lit.select(F.col("path").alias("b_path"), F.col("name").alias("b"), "stem")
    return lit.join(other, "stem").where("path <> b_path AND name < b").select("stem", F.col("name").alias("a"), "b").distinct()
