"""Each static rule on a file that breaks it and on one that does not, and the catalogue."""

import ast

import pytest

from strataq.functions import code, rules

#: code, file name, lines that break the rule, source, and a like source that does not.
CASES = [
    ("LH001", "m.py", [1], "x._secret()", "self._own(); x.__dict__; x.open_"),
    ("LH007", "test_m.py", [2], "def test_a():\n    x == 1", "def test_a():\n    assert x == 1\ndef helper():\n    x == 1"),
    ("LH009", "m.py", [2], "async def f():\n    asyncio.run(g())", "def f():\n    asyncio.run(g())"),
    ("H2", "m.py", [2], "a = Counter('n')\nb = prometheus_client.Gauge('n')", "a = Counter('n')\nb = Counter('m')\nc = other('n')"),
    ("H4", "m.py", [1], "a.b().c(1).d()", "a.b().c()\n# a.b().c().d()"),
    ("H5", "test_m.py", [1, 2], "assert x == 1.5\nassert 2.5 == f()", "assert x < 1.5\nassert x == 1\nassert x == approx(1.5)"),
    ("H6", "m.py", [1, 2, 3, 4], "import pkg_resources\nfrom pkg_resources import x\ncollections.Callable\ndatetime.datetime.utcnow()", "import importlib\nabc.Callable\ndatetime.now()"),
    ("SB2", "m.py", [1], "datetime.utcnow()", "datetime.now(utc)"),
    ("AC1", "m.py", [1], "asyncio.get_event_loop()", "asyncio.get_running_loop()"),
    ("H9", "m.py", [2], "class A:\n    async def __init__(self): ...", "class A:\n    async def make(cls): ..."),
    ("SD1", "test_m.py", [1], "x = row[0]", "x = row['name']\nx = table[0]"),
    ("SD2", "m.py", [1], "q = 'SELECT a FROM t'", "select(a)\n# 'SELECT a'"),
    ("SD3", "m.py", [2], "c = Counter('a', 'b', ['l'])\nc.inc()", "c = Counter('a', 'b', ['l'])\nc.labels('x').inc()\nd = Counter('e', 'f')\nd.inc()"),
    ("SS3", "m.py", [4], "def f(x):\n    if not c:\n        return\n    if x < 0:\n        raise E", "def f(x):\n    if x < 0:\n        raise E\n    if not c:\n        return"),
    ("SS5", "m.py", [4], "for r in rs:\n    try:\n        db.execute(r)\n    except E:\n        continue", "for r in rs:\n    try:\n        db.execute(r)\n    except E:\n        log(r)\nfor r in rs:\n    try:\n        look(r)\n    except E:\n        pass"),
    ("SL1", "m.py", [4], "def f(a):\n    if a:\n        x = 1\n    return x", "def f(a):\n    x = 0\n    if a:\n        x = 1\n    return x\ndef g(a):\n    if a:\n        y = 1\n    else:\n        y = 2\n    return y"),
    ("SL2", "m.py", [4], "@pytest.fixture\ndef f():\n    with mock.patch('a'):\n        return 1", "@pytest.fixture\ndef f():\n    with mock.patch('a'):\n        yield 1\ndef g():\n    with mock.patch('a'):\n        return 1"),
    ("SB1", "m.py", [2], "import numpy\njson.dumps(x)", "json.dumps(x)"),
    ("AC2", "m.py", [1], "while True:\n    try:\n        go()\n    except E:\n        time.sleep(1)", "while True:\n    try:\n        go()\n    except E:\n        time.sleep(1)\n        raise\nwhile n < 3:\n    try:\n        go()\n    except E:\n        sleep(1)"),
    ("AC4", "m.py", [1], "asyncio.create_task(f())", "t = asyncio.create_task(f())"),
    ("MF2", "m.py", [3], "while up:\n    reconnect()\n    time.sleep(5)", "while up:\n    reconnect()\n    time.sleep(5 * random.random())\nwhile up:\n    go()\n    time.sleep(5)"),
    ("MF3", "m.py", [2], "while True:\n    logger.error('x')", "while True:\n    if changed:\n        logger.error('x')\n    logger.info('y')"),
    ("OG1", "m.py", [3, 7], "try:\n    f()\nexcept E:\n    pass\ntry:\n    f()\nexcept E:\n    return None", "try:\n    f()\nexcept E:\n    log('x')\n    return None"),
    ("PB1", "m.py", [4], "class A:\n    def f(self, x):\n        self.n += 1\n        if x < 0:\n            raise E", "class A:\n    def f(self, x):\n        if x < 0:\n            raise E\n        self.n += 1\n    def g(self, x):\n        n = 1\n        if x:\n            raise E"),
    ("WG1", "m.py", [2], "class AlertNotifier:\n    def send(self):\n        logger.post('x')", "class AlertNotifier:\n    def send(self):\n        requests.post('x')\nclass Other:\n    def send(self): ..."),
    ("TEC1", "test_m.py", [1], "c = Counter('a')", "c = Counter('a')\n@fixture(autouse=True)\ndef r(): ..."),
    ("MC1b", "m.py", [1], "Counter('Queue_Depth')", "Counter('requests_total')\nGauge('queue_depth')"),
]


@pytest.mark.parametrize("rule,name,lines,bad,good", CASES, ids=[c[0] for c in CASES])
def test_rule(rule, name, lines, bad, good):
    found = lambda src: [line for _, c, line in rules.broken_rules(f"pkg/{name}", src, ast.parse(src)) if c == rule]
    wrapped = bad if "return" not in bad or bad.startswith(("def", "class", "@")) else "def _():\n" + "\n".join(f" {x}" for x in bad.splitlines())
    assert found(wrapped) == (lines if wrapped == bad else [k + 1 for k in lines])
    clean = good if "return" not in good or good.startswith(("def", "class", "@")) else "def _():\n" + "\n".join(f" {x}" for x in good.splitlines())
    assert found(clean) == []


def test_rules_on_tests_need_a_test_file():
    src = "def test_a():\n    x == 1\n    assert y == 1.5\n    z = row[0]\n    Counter('a')._value"
    assert {c for _, c, _ in rules.broken_rules("pkg/m.py", src, ast.parse(src))} == {"LH001"}
    assert {c for _, c, _ in rules.broken_rules("pkg/test_m.py", src, ast.parse(src))} == {"LH001", "LH007", "H5", "SD1", "TEC1"}


def test_catalogue_and_rules_fit():
    patterns = {p: (tier, detection, confidence) for p, _, tier, detection, confidence in rules.catalogue()}
    assert len(patterns) == len(rules.catalogue()) == 58
    assert {r.pattern for r in rules.RULES} <= set(patterns) and len({r.code for r in rules.RULES}) == len(rules.RULES) == len(CASES)
    assert all(patterns[r.pattern][2] > 0 for r in rules.RULES)


def test_rule_rows_carry_their_code():
    rows = code.analyse("pkg/m.py", "try:\n    f()\nexcept E:\n    pass\n")
    assert [(r[2], r[4], r[6]) for r in rows if r[1] == "rule"] == [("swallowed-exception", 3, "OG1")]
