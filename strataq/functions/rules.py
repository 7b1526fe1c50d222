"""Static rules on one Python file, and the catalogue of patterns they belong to.

A file's nodes are sorted by type in one walk; every rule is a generator over the nodes it needs.
"""

from __future__ import annotations

import ast
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

# Pattern, tier, detection and confidence, by category.
CATALOGUE = """
Hallucination: H1 1 ruff_core 0.7, H2 1 ast 0.6, H3 1 ruff_core 0.7, H4 2 regex 0.45, H5 2 advisory 0.25, H6 1 ast 0.7, H7 1 ruff_core 0.7, H8 3 advisory 0.0, H9 1 ast 0.7
Schema Drift: SD1 2 regex 0.45, SD2 3 advisory 0.25, SD3 2 ast 0.55, SD4 3 advisory 0.0
Silent Swallowing: SS1 2 advisory 0.25, SS2 3 advisory 0.0, SS3 1 ast 0.6, SS4 3 advisory 0.0, SS5 1 ast 0.6, SS6 3 advisory 0.0
Cascade Propagation: CP1 3 advisory 0.0, CP2 3 advisory 0.0
Scope/Lifetime: SL1 2 ast 0.5, SL2 1 ast 0.65
Serialization Boundary: SB1 2 regex 0.4, SB2 1 ast 0.65
Async/Concurrency: AC1 1 ast 0.7, AC2 2 ast 0.45, AC3 3 advisory 0.0, AC4 2 ast 0.5
Test Contamination: TEC1 2 regex 0.4, TEC2 3 advisory 0.0
Agent Tooling: AT1 3 advisory 0.0, AT2 3 advisory 0.0, AT3 3 advisory 0.0, AT4 3 advisory 0.0, AT5 3 advisory 0.0, AT6 3 advisory 0.0
Parse Boundary: PB1 1 ast 0.55, PB2 3 advisory 0.0, PB3 3 advisory 0.0, PB4 3 advisory 0.0
Metastable Failure: MF1 3 advisory 0.0, MF2 2 ast 0.4, MF3 2 ast 0.4
Distributed Consistency: DC1 3 advisory 0.0, DC2 3 advisory 0.0, DC3 3 advisory 0.0, DC4 3 advisory 0.0
Configuration Drift: CD1 3 advisory 0.0, CD2 3 advisory 0.0, CD3 3 advisory 0.0
Observability Gap: OG1 1 ast 0.6, OG2 3 advisory 0.0, OG3 3 advisory 0.0, OG4 3 advisory 0.0
Wiring Gap: WG1 2 ast 0.45
Metric Misconfiguration: MC1 3 advisory 0.0, MC1b 2 regex 0.4
"""
# Metrics, words of values that can fall, names of classes that talk to others, and of what they call.
METRICS = ("Counter", "Gauge", "Histogram", "Summary")
FALLING = ("depth", "size", "active", "current", "usage", "level", "count", "inflight", "in_flight", "connections", "queue", "utilization", "temperature")
WIRED = ("Publisher", "Notifier", "Exporter", "Sender")
SENDS = ("send", "publish", "export", "notify", "emit")
OUTBOUND = ("post", "get", "put", "request", "send", "sendall", "publish", "connect", "urlopen", "sendto")
WRITES = ("execute", "executemany", "insert", "save")
MUTATES = ("insert", "execute", "executemany", "append", "write", "commit")
LOUD = tuple(f"{log}.{level}" for log in ("logger", "log", "logging") for level in ("warning", "error"))

CHAIN = re.compile(r"(?:\.[A-Za-z_][A-Za-z0-9_]*\([^()]*\)){2}\.[A-Za-z_][A-Za-z0-9_]*\(")
ROW_INDEX = re.compile(r"\b(?:row|rows|values|result|record|fetchone|fetchall)\b[A-Za-z0-9_]*\[\s*\d+\s*\]")
SQL = re.compile(r"\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b", re.IGNORECASE)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def catalogue() -> list[tuple[str, str, int, str, float]]:
    """(pattern, category, tier, detection, confidence)."""
    out = []
    for line in CATALOGUE.strip().splitlines():
        category, entries = line.split(": ")
        out += [(p, category, int(t), d, float(c)) for p, t, d, c in (e.split() for e in entries.split(", "))]
    return out


class File:
    """A parsed file: its nodes by type, and its lines but for comments, with their numbers."""

    def __init__(self, path: str, source: str, tree: ast.AST):
        self.name, self.source = path.rsplit("/", 1)[-1], source
        self.nodes: dict[type, list] = defaultdict(list)
        for n in ast.walk(tree):
            self.nodes[type(n)].append(n)
        self.lines = [(k, line) for k, line in enumerate(source.splitlines(), 1) if not line.lstrip().startswith("#")]
        self.is_test = "test" in self.name

    def all(self, *kinds: type) -> list:
        return [n for k in kinds for n in self.nodes[k]]

    def matching(self, pattern: re.Pattern) -> Iterator[int]:
        return (k for k, line in self.lines if pattern.search(line))


@dataclass(frozen=True)
class Rule:
    code: str
    pattern: str
    name: str
    find: Callable[[File], Iterator[int]]


RULES: list[Rule] = []


def rule(code: str, name: str, pattern: str | None = None):
    """Register a generator of the lines at which a file breaks a rule."""

    def register(find):
        RULES.append(Rule(code, pattern or code, name, find))
        return find

    return register


def called(call: ast.AST) -> str:
    """The dotted name that a call's function has, or nothing if other things than names are in front."""
    parts, at = [], getattr(call, "func", None)
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(parts)]) if isinstance(at, ast.Name) else ""


def inside(node: ast.AST, *kinds: type) -> Iterator[ast.AST]:
    return (n for n in ast.walk(node) if isinstance(n, kinds))


def _metric(call: ast.Call) -> str | None:
    last = call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", None)
    return last if last in METRICS else None


def _literal(call: ast.Call) -> str | None:
    first = call.args[0] if call.args else None
    return first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None


def _endless(loop: ast.While) -> bool:
    return isinstance(loop.test, ast.Constant) and loop.test.value is True


def _raises(stmt: ast.stmt) -> bool:
    return isinstance(stmt, ast.If) and any(isinstance(s, ast.Raise) for s in stmt.body)


@rule("LH001", "private-attribute", "H1")
def _private(f: File):
    for n in f.all(ast.Attribute):
        own = isinstance(n.value, ast.Name) and n.value.id == "self"
        if n.attr.startswith("_") and not n.attr.startswith("__") and not own:
            yield n.lineno


@rule("LH007", "vacuous-test", "H7")
def _vacuous(f: File):
    for test in f.all(ast.FunctionDef) if f.is_test else ():
        if test.name.startswith("test_"):
            yield from (e.lineno for s in test.body for e in inside(s, ast.Expr) if isinstance(e.value, ast.Compare))


@rule("LH009", "run-inside-async", "H9")
def _nested_run(f: File):
    yield from (c.lineno for a in f.all(ast.AsyncFunctionDef) for c in inside(a, ast.Call) if called(c) == "asyncio.run")


@rule("H2", "duplicate-metric")
def _twice(f: File):
    met = set()
    for c in f.all(ast.Call):
        name = _literal(c) if _metric(c) else None
        if name is not None and name in met:
            yield c.lineno
        met.add(name)


@rule("H4", "call-chain")
def _chain(f: File):
    return f.matching(CHAIN)


@rule("H5", "float-equality-in-test")
def _float(f: File):
    for a in f.all(ast.Assert) if f.is_test else ():
        t = a.test
        if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ast.Eq):
            if any(isinstance(x, ast.Constant) and isinstance(x.value, float) for x in (t.left, *t.comparators)):
                yield a.lineno


@rule("H6", "deprecated-call")
def _frozen(f: File):
    gone = lambda m: m == "pkg_resources" or m.startswith("pkg_resources.")
    yield from (n.lineno for n in f.all(ast.Import) for a in n.names if gone(a.name))
    yield from (n.lineno for n in f.all(ast.ImportFrom) if n.module == "pkg_resources")
    yield from (n.lineno for n in f.all(ast.Attribute) if n.attr == "Callable" and isinstance(n.value, ast.Name) and n.value.id == "collections")
    yield from _naive(f)


@rule("SB2", "naive-time")
def _naive(f: File):
    return (c.lineno for c in f.all(ast.Call) if called(c).endswith("datetime.utcnow"))


@rule("AC1", "old-event-loop")
def _old_loop(f: File):
    return (c.lineno for c in f.all(ast.Call) if called(c).endswith("asyncio.get_event_loop"))


@rule("H9", "async-constructor")
def _async_init(f: File):
    return (a.lineno for a in f.all(ast.AsyncFunctionDef) if a.name == "__init__")


@rule("SD1", "positional-index")
def _by_place(f: File):
    return f.matching(ROW_INDEX) if f.is_test else iter(())


@rule("SD2", "raw-sql")
def _raw_sql(f: File):
    return (k for k, line in f.lines if SQL.search(line) and ("'" in line or '"' in line))


@rule("SD3", "unlabelled-metric")
def _unlabelled(f: File):
    wide = lambda c: isinstance(c, ast.Call) and _metric(c) and (len(c.args) > 2 or any(k.arg == "labelnames" for k in c.keywords))
    names = {t.id for a in f.all(ast.Assign) if wide(a.value) for t in a.targets if isinstance(t, ast.Name)}
    for c in f.all(ast.Call):
        if isinstance(c.func, ast.Attribute) and c.func.attr in ("inc", "set", "observe") and isinstance(c.func.value, ast.Name) and c.func.value.id in names:
            yield c.lineno


@rule("SS3", "validation-after-guard")
def _late_check(f: File):
    for fn in f.all(*FUNCTIONS):
        ifs = [s for s in fn.body if isinstance(s, ast.If)]
        guards = [k for k, s in enumerate(ifs) if not _raises(s) and any(isinstance(x, ast.Return) for x in s.body)]
        yield from (s.lineno for s in ifs[guards[0] + 1 if guards else len(ifs) :] if _raises(s))


@rule("SS5", "per-record-swallow")
def _per_record(f: File):
    quiet = lambda s: isinstance(s, (ast.Pass, ast.Continue)) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)
    for loop in f.all(ast.For, ast.While):
        for t in (s for s in loop.body if isinstance(s, ast.Try)):
            if any(isinstance(c.func, ast.Attribute) and c.func.attr in WRITES for c in inside(t, ast.Call)):
                yield from [h.lineno for h in t.handlers if all(map(quiet, h.body))][:1]


def _bound(stmts: list[ast.stmt]) -> set[str]:
    plain = {t.id for s in stmts for a in inside(s, ast.Assign) for t in a.targets if isinstance(t, ast.Name)}
    return plain | {a.target.id for s in stmts for a in inside(s, ast.AnnAssign, ast.AugAssign) if isinstance(a.target, ast.Name)}


@rule("SL1", "conditional-binding")
def _maybe_unbound(f: File):
    for fn in f.all(*FUNCTIONS):
        a = fn.args
        sure = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x}
        maybe: set[str] = set()
        for s in fn.body:
            if isinstance(s, ast.If):
                yes, no = _bound(s.body), _bound(s.orelse)
                maybe |= yes - no - sure
                sure |= yes & no
                continue
            fresh = _bound([s])
            sure |= fresh
            maybe -= fresh
            for name in sorted({n.id for n in inside(s, ast.Name) if isinstance(n.ctx, ast.Load)} & (maybe - sure)):
                yield s.lineno
                maybe.discard(name)


@rule("SL2", "return-inside-patch")
def _patched(f: File):
    for fn in f.all(*FUNCTIONS):
        marks = [d.func if isinstance(d, ast.Call) else d for d in fn.decorator_list]
        if not any(getattr(m, "attr", getattr(m, "id", "")) == "fixture" for m in marks):
            continue
        patches = [w for w in inside(fn, ast.With) if any("patch" in called(i.context_expr).split(".") or called(i.context_expr).endswith("patch") for i in w.items if isinstance(i.context_expr, ast.Call))]
        yield from [r.lineno for w in patches[:1] for r in inside(w, ast.Return)][:1]


@rule("SB1", "array-to-json")
def _arrays(f: File):
    numpy = re.search(r"\bnp\.array\b|\bnumpy\b|\bndarray\b", f.source)
    return f.matching(re.compile(r"\bjson\.dumps\s*\(")) if numpy else iter(())


@rule("AC2", "unbounded-retry")
def _retry(f: File):
    for loop in filter(_endless, f.all(ast.While)):
        for t in (s for s in loop.body if isinstance(s, ast.Try)):
            stuck = [h for h in t.handlers if any(called(c).endswith("sleep") for c in inside(h, ast.Call)) and not any(inside(h, ast.Break, ast.Raise))]
            if stuck:
                yield loop.lineno


@rule("AC4", "orphan-task")
def _orphan(f: File):
    return (e.lineno for e in f.all(ast.Expr) if isinstance(e.value, ast.Call) and called(e.value).endswith("create_task"))


@rule("MF2", "reconnect-without-jitter")
def _lockstep(f: File):
    for loop in f.all(ast.For, ast.While):
        calls = list(inside(loop, ast.Call))
        names = [called(c) for c in calls]
        if any("connect" in n.lower() for n in names) and not any("random" in n for n in names):
            fixed = [c.lineno for c, n in zip(calls, names) if n.endswith("sleep") and c.args and isinstance(c.args[0], ast.Constant) and isinstance(c.args[0].value, (int, float))]
            yield from fixed[:1]


@rule("MF3", "log-in-endless-loop")
def _loud_loop(f: File):
    for loop in filter(_endless, f.all(ast.While)):
        yield from (s.lineno for s in loop.body if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and called(s.value).endswith(LOUD))


@rule("OG1", "swallowed-exception")
def _swallowed(f: File):
    for h in f.all(ast.ExceptHandler):
        s = h.body[0]
        nothing = isinstance(s, ast.Return) and (s.value is None or isinstance(s.value, ast.Constant) and s.value.value is None)
        if len(h.body) == 1 and (isinstance(s, ast.Pass) or nothing):
            yield h.lineno


@rule("PB1", "validation-after-mutation")
def _dirty(f: File):
    mine = lambda t: isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"

    def changes(s: ast.stmt) -> bool:
        if isinstance(s, ast.Expr):
            return called(s.value).endswith(MUTATES)
        return any(map(mine, getattr(s, "targets", []) if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AugAssign) else []))

    for fn in f.all(*FUNCTIONS):
        first = next((k for k, s in enumerate(fn.body) if changes(s)), len(fn.body))
        yield from [s.lineno for s in fn.body[first + 1 :] if _raises(s)][:1]


@rule("WG1", "no-op-integration")
def _no_op(f: File):
    real = lambda n: n.endswith(OUTBOUND) and not n.startswith(("logger.", "log.", "logging.", "print"))
    for c in f.all(ast.ClassDef):
        for m in c.body if c.name.endswith(WIRED) else ():
            if isinstance(m, FUNCTIONS) and m.name in SENDS and not any(real(called(x).lower()) for x in inside(m, ast.Call)):
                yield m.lineno


@rule("TEC1", "registry-leak")
def _leak(f: File):
    uses = re.search(rf"\b(?:{'|'.join(METRICS)})\s*\(|\._value\b", f.source)
    resets = re.search(r"autouse\s*=\s*True|reset|clear_registry|CollectorRegistry|_initialized", f.source)
    if f.is_test and uses and not resets:
        yield 1


@rule("MC1b", "counter-should-be-gauge")
def _gauge(f: File):
    for c in f.all(ast.Call):
        if _metric(c) == "Counter" and any(w in (_literal(c) or "").lower() for w in FALLING):
            yield c.lineno


def broken_rules(path: str, source: str, tree: ast.AST) -> list[tuple[str, str, int]]:
    """(name, code, line) of the rules that a file breaks, by line."""
    f = File(path, source, tree)
    return sorted({(r.name, r.code, line) for r in RULES for line in r.find(f)}, key=lambda x: (x[2], x[1]))
