"""Queries without SQL give the rows of plain Python models on the smallest tables."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataq.functions import text as X
from strataq.queries import registry
from tests_support import SF, rows_of

GENERIC = set(X.GENERIC)


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def vectors(duck):
    rows = duck.execute("SELECT vec_id, embedding::DOUBLE[], label FROM embeddings ORDER BY vec_id").fetchall()
    norm = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    return [(i, norm(v), label) for i, v, label in rows]


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def cos(a, b):
    return sum(x * y for x, y in zip(a, b))


def tokens(t):
    return set(re.findall(r"[a-z0-9][a-z0-9._:/-]{2,}", t.lower())) - GENERIC


def words(t):
    return {w for w in re.split(r"[ \t\n]+", t.lower()) if w}


HOST = X.HOST.replace("(?i)", "")
IP = rf"(?<![0-9.]){X.IPV4}(?![0-9.])"


def named(t):
    found = re.findall(r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z0-9]*(?:[ \t][A-Z][a-zA-Z0-9]*)+(?![A-Za-z0-9_])", t)
    found += [p.strip(" ") for p in re.findall(r'"([^"]{2,80})"', t) if len(p.strip(" ")) >= 2]
    found += re.findall(IP, t) + [m[0] for m in re.finditer(rf"(?<![A-Za-z0-9_])(?:{HOST})", t, re.I)] + re.findall(X.URL, t)
    out = {}
    for x in found:
        out.setdefault(x.lower(), x)
    return list(out.values())


def test_named_entity_counts(spark, docs):
    system = "server|service|system|db|database|cluster|host|node|api|gateway|azure|aws|gcp|cloud"

    def kind(n):
        if re.match(X.IPV4, n):
            return "location"
        if re.match("(?i)https?://", n) or re.search(system, n.lower()):
            return "system"
        return "person" if re.fullmatch(r"[A-Z][a-z]+[ \t]+[A-Z][a-z]+", n) else "concept"

    n, names = Counter(), defaultdict(set)
    for _, t, _ in docs:
        for x in named(t or ""):
            n[kind(x)] += 1
            names[kind(x)].add(x)
    assert {(r["type"], r["mentions"], r["names"]) for r in run(spark, "named_entity_counts")} == {(k, n[k], len(names[k])) for k in n} and n


def test_code_reference_scan(spark, duck):
    want = Counter()
    for url, html in duck.execute("SELECT url, html FROM pages").fetchall():
        want.update({m[1] for m in re.finditer("(?<![A-Za-z0-9_])" + X.CODE_REF.replace("(?i)", ""), f"{url} {html}", re.I)})
    assert {(r["path"], r["n"]) for r in run(spark, "code_reference_scan")} == set(want.items()) and want


def test_code_references_in_a_text(spark):
    t = "see src/a/b.py:12, README.md; not a.pyx9 or .x, ./c.ts (d-e.yaml) and v1.2.3 in setup.cfg."
    got = spark.range(1).select(X.code_refs(F.lit(t)).alias("x")).first()["x"]
    assert got == ["src/a/b.py", "README.md", "./c.ts", "d-e.yaml"]


def test_parents_and_claims_are_trimmed(spark):
    row = spark.range(1).select(
        X.parents_of(F.array(F.lit(" a "), F.lit("b"), F.lit("a"), F.lit(" "))).alias("p"), X.claims_of(F.lit('[" one ", "two", " "]')).alias("c"),
        X.claims_of(F.lit("- first\n\n - second -\n")).alias("l"), X.claims_of(F.lit("  alone ")).alias("o"), X.claims_of(F.lit(None).cast("string")).alias("n"),
    ).first()
    assert row["p"] == ["a", "b"] and row["c"] == ["one", "two"] and row["l"] == ["first", "second"] and row["o"] == ["alone"] and row["n"] == []


def contaminated(docs, seeds):
    """Seeds, findings that share an entity with one, and all that is derived from any of these."""

    def entities(t):
        low = lambda p, i=re.I: {m[0].lower() for m in re.finditer(p, t, i)}
        return {m[0] for m in re.finditer(IP, t)} | low(X.HASH) | low(X.CVE.replace("(?i)", "")) | low(X.EMAIL, 0) | low(rf"(?<![A-Za-z0-9_])(?:{HOST})") | set(re.findall(X.URL, t))

    own = {i: entities(t or "") for i, t, _ in docs}
    bad = set().union(*(own[i] for i in seeds)) if seeds else set()
    reason = {i: "seed" if i in seeds else "entity" for i in own if i in seeds or own[i] & bad}
    child = defaultdict(list)
    for i in own:
        if i % 5:
            child[i - 1 - i % 3].append(i)
    todo = list(reason)
    while todo:
        for c in child[todo.pop()]:
            if c not in reason:
                reason[c] = "derived_from"
                todo.append(c)
    return reason


def test_retraction_dry_run(spark, docs, duck):
    ids = {i for i, _, _ in docs}
    seeds = {r[0] for r in duck.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()} & ids
    reason = contaminated(docs, seeds)
    assert {(r["reason"], r["n"]) for r in run(spark, "retraction_dry_run")} == set(Counter(reason.values()).items()) | {("restored", len(reason))}


def greedy(vectors, least, same=lambda a, b: True):
    reps, owner = [], {}
    for i, v, label in vectors:
        owner[i] = next((j for j, w, other in reps if same(label, other) and cos(v, w) >= least), i)
        if owner[i] == i:
            reps.append((i, v, label))
    return owner


def test_greedy_dedup(spark, vectors):
    assert {(r["vec_id"], r["rep"]) for r in run(spark, "greedy_dedup")} == set(greedy(vectors, 0.3).items())


def test_coalesced_verdicts(spark, vectors):
    owner, kind = greedy(vectors, 0.4, lambda a, b: a == b), {i: label for i, _, label in vectors}
    assert {(r["kind"], r["rep"], r["occurrences"]) for r in run(spark, "coalesced_verdicts")} == {(kind[i], i, n) for i, n in Counter(owner.values()).items()}


def test_winner_takes_all(spark, vectors):
    gone = set()
    for k, (i, v, _) in enumerate(vectors):
        if i in gone:
            continue
        for j, w, _ in vectors[k + 1 :]:
            if j not in gone and cos(v, w) >= 0.3:
                gone.add(j if i % 20 >= j % 20 else i)
    assert {r["vec_id"] for r in run(spark, "winner_takes_all")} == gone


def test_failure_correlation(spark, docs, duck):
    fails = [(words(t), f"src{i % 5}") for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    sessions = {s for _, s in fails}
    want = []
    for i, t, source in docs:
        importance = (i % 20 + 1) / 20
        hit = (i % 3 == 0 and source in sessions) or any(len(words(t or "") & w) >= 6 for w, _ in fails)
        want.append((f"f{i}", max(0.05, importance * 0.85) if hit else importance))
    assert rows_of((r["id"], r["importance"]) for r in run(spark, "failure_correlation")) == rows_of(want)


def test_merged_entities(spark, docs):
    known, want = defaultdict(list), set()
    for i, t, source in docs:
        for n in named(t or ""):
            n = n.lower()
            if n in {x[1] for x in want if x[0] == source}:
                continue
            home = next((k for k in known[source] if n in k or k in n), None)
            if home is None:
                known[source].append(n)
            want.add((source, n, home or n))
    got = {(r["investigation_id"], r["name"], r["canonical"]) for r in run(spark, "merged_entities")}
    assert {x[:2] for x in got} == {x[:2] for x in want}
    # Names first met in one document share a place, and may come in either order.
    assert all(n in c or c in n for _, n, c in got)


@pytest.fixture(scope="module")
def lexical(docs, duck):
    """By claim its hits: finding number and share of the claim's tokens, best first, ties by the finding's id as text."""
    out = {}
    for q, t in duck.execute("SELECT item_id, text FROM benchmark WHERE item_id % 50 = 0").fetchall():
        qt = tokens(t)
        hits = [(len(qt & tokens(d or "")) / len(qt), i) for i, d, _ in docs]
        out[q] = sorted(((s, i) for s, i in hits if s > 0), key=lambda x: (-x[0], f"f{x[1]}"))
    return out


def test_memory_route(spark, docs, lexical):
    text = {i: t for i, t, _ in docs}
    want = []
    for q, hits in lexical.items():
        seen = [(s, i) for s, i in hits[:60] if i % 5 in (0, 1, 2)][:30]
        kept = [(s, i) for k, (s, i) in enumerate(seen) if not any(len(words(text[i]) & words(text[j])) / len(words(text[i]) | words(text[j])) > 0.8 for _, j in seen[:k])]
        want += [(q, f"f{i}", s, place) for place, (s, i) in enumerate(kept[:10], 1)]
    assert rows_of((r["query"], r["id"], r["score"], r["place"]) for r in run(spark, "memory_route")) == rows_of((q, i, round(s, 9), p) for q, i, s, p in want)


def test_mmr_selection(spark, docs, lexical):
    text, want = {i: t for i, t, _ in docs}, []
    plain = lambda t: set(re.split(r"[ \t\n]+", t.lower()))
    for q, hits in lexical.items():
        left, chosen = {i: s for s, i in hits[:30]}, []
        while left and len(chosen) < 3:
            sim = lambda i: max((len(plain(text[i]) & plain(text[j])) / max(len(plain(text[i])), len(plain(text[j]))) for j in chosen), default=0.0)
            best = max(left, key=lambda i: (left[i] if not chosen else 0.75 * left[i] - 0.25 * sim(i), -i))
            chosen.append(best)
            want.append((q, len(chosen), best, left.pop(best)))
    assert rows_of((r["query"], r["place"], r["seq"], r["score"]) for r in run(spark, "mmr_selection")) == rows_of((q, p, i, round(s, 6)) for q, p, i, s in want)


def cut(t, limit):
    t = t.strip(" \t\n\x0b\f\r")
    if len(t) <= limit:
        return t
    out = t[:limit]
    for sep in ("\n", ". ", "; ", ", ", " "):
        if out.rfind(sep) > limit * 0.5:
            out = out[: out.rfind(sep) + 1]
            break
    return out.rstrip(" \t\n\x0b\f\r") + " …[truncated]"


def test_lane_texts_share_a_budget(spark):
    from strataq.operators import grounding

    lanes = [("t", k, f"lane{k}", "Some words here. " * (1 + 37 * k % 50), 0.05 * k) for k in range(1, 14)] + [("t", 14, "none", " ", 0.5), ("t", 15, "null", None, 0.5), ("u", 1, "x", "short", 0.1), ("v", 1, "x", "", 0.1)]
    got = {r["task"]: r for r in grounding.lanes_block(spark.createDataFrame(lanes, "task string, place int, tag string, text string, share double"), 1500).collect()}
    left, tags, parts = 1500, [], []
    for _, _, tag, t, share in lanes[:13]:
        if left > 0:
            part = f"[{tag}] " + cut(t, min(left, max(200, int(1500 * share))))
            left -= len(part)
            tags.append(tag)
            parts.append(part)
    assert got["t"]["sources"] == tags and got["t"]["block"] == "\n".join(parts) and got["t"]["chars"] == len(got["t"]["block"]) and len(tags) < 13
    assert got["u"]["block"] == "[x] short" and "v" not in got


def test_pair_dataset_joins_topics_once_and_negatives_differ(spark):
    from strataq.operators import metrics

    items = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, topic long")
    rows = [(r["a"], r["b"], r["label"]) for r in metrics.pair_dataset(items).collect()]
    assert {(a, b) for a, b, y in rows if y} == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 == j % 3}
    negative = [(a, b) for a, b, y in rows if not y]
    assert len(set(negative)) == len(negative) and all(a < b and a % 3 != b % 3 for a, b in negative) and 30 <= len(negative) <= 240
