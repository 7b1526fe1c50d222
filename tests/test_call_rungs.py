"""Every rung of call resolution, and names that lead nowhere."""

from strataq.functions import code

FILES = {
    "pkg/base.py": "class Store:\n    def put(self): ...\n    def only_here(self): ...\n\ndef helper(): ...\n\nshort = helper\n",
    "pkg/main.py": """import pkg.base as b
from pkg.base import Store, helper as h

def top(x: Store, y):
    def inner():
        def deep():
            return 1
        deep()
        sibling()
        return deep
    def sibling():
        return 2
    inner()
    x.put()
    s = Store()
    s.put()
    b.helper()
    h()
    y.only_here()
    y.put2()
    other()
    other()
    again()

def other(): ...

again = other

class K:
    def run(self):
        self.stop()
        self.gone()
    def stop(self):
        other(); other()
""",
    "pkg/broken.py": "def (",
}


def test_calls_resolve_rung_by_rung(spark):
    rows = code.parse_python(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    assert rows.where("kind = 'error'").count() == 1
    got = sorted((r["line"], r["name"], r["target"].replace("pkg/main.py::", "m:").replace("pkg/base.py::", "b:"), r["rung"]) for r in code.resolve_python_calls(rows).collect())
    assert got == sorted([
        (8, "deep", "m:top.inner.deep", "nested"), (9, "sibling", "m:top.sibling", "nested"), (13, "inner", "m:top.inner", "nested"), (14, "x.put", "b:Store.put", "typed"), (15, "Store", "b:Store", "import"),
        (16, "s.put", "b:Store.put", "typed"), (17, "b.helper", "b:helper", "import"), (18, "h", "b:helper", "import"), (19, "y.only_here", "b:Store.only_here", "unique"), (20, "y.put2", "?", "?"),
        (21, "other", "m:other", "module"), (22, "other", "m:other", "module"), (23, "again", "m:other", "module"), (31, "self.stop", "m:K.stop", "self"), (32, "self.gone", "?", "?"), (34, "other", "m:other", "module"), (34, "other", "m:other", "module"),
    ])
