"""Personal data by weak supervision.

Whole texts, of any length, are scanned for base spans by exact rules and for looser candidates. Four
labelers (strict form, gazetteer, context, shape) vote +1, 0 or -1 on every candidate. The votes fall
into a fixed number of cells (kind, votes, length class), which are counted over all documents.
Expectation-maximisation estimates each labeler's reliability and each cell's posterior from the
counts. A logistic regression then learns these posteriors from what is seen at a candidate: its
votes, its shape, and the words and characters beside it, hashed. It is trained on a bounded sample,
and judges every loose candidate; by the words beside it, it can overrule the votes. Cell counts and
the sample are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.textstats import unpacked
from strataq.storage import materialize, read_table

BASE = ("email", "ip", "card", "phone")
LOOSE = ("loose_email", "loose_ip", "loose_card", "loose_phone", "national_id", "iban", "secret")
KINDS = BASE + LOOSE
VOTERS = 4
SIZES = 4
#: Features are hashed to 2**FEATURE_BITS numbers; at most about SAMPLE candidates of each kind train the classifier.
FEATURE_BITS, SAMPLE = 13, 3000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# A run of digits whose start fails fails at its later digits too, so starts inside a run are left out.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
# Runs are taken whole and only from their start on, which keeps the search linear.
AT_DOT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:[\[(]at[\])]|\sat\s)\s?[A-Za-z0-9-]++(?:\s?(?:[\[(]dot[\])]|\sdot\s)\s?[A-Za-z0-9-]++)+")
KEYED = re.compile(r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?([^\s\"']{6,}+)")
ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")

# Endings and prefixes that the gazetteer knows.
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk us it nl ch at info biz eu ca".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "30", "38")
COUNTRIES = frozenset("AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split())
CUES = {
    "email": r"mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|address|server|host|login|adresse", "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"tel|phone|call|fax|mobile|anruf|llam", "national_id": r"ssn|social|security|id\b", "iban": r"iban|bank|konto|compte|cuenta", "secret": r"password|passwd|pwd|token|secret|key",
}
CUE = {k: re.compile(v, re.IGNORECASE) for k, v in CUES.items()}
AGAINST = re.compile(r"version|isbn|issn|order|invoice|section|chapter|page|total|\$|€|example only|sample", re.IGNORECASE)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain, in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans that pass the exact rules, and matches that fail their check."""
    good: list[tuple[str, int, int]] = []
    bad: list[tuple[str, int, int]] = []
    if "@" in text:
        good += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (good if fits else bad).append(("ip" if fits else "loose_ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            n = len(m[0]) - m[0].count(" ") - m[0].count("-")
            if 12 <= n <= 19:
                fits = luhn(m[0].replace(" ", "").replace("-", ""))
                (good if fits else bad).append(("card" if fits else "loose_card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                fits = 9 <= sum(c.isdigit() for c in m[0]) <= 15
                (good if fits else bad).append(("phone" if fits else "loose_phone", m.start(), m.end()))
    good.sort(key=lambda s: (s[1], BASE.index(s[0])))
    return good, bad


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Looser matches, from literals that most texts lack."""
    out: list[tuple[str, int, int]] = []
    if "dot" in text:
        out += [("loose_email", m.start(), m.end()) for m in AT_DOT.finditer(text)]
    if DIGIT.search(text):
        out += [("loose_phone", m.start(), m.end()) for m in LOOSE_PHONE.finditer(text)]
        if "-" in text:
            out += [("national_id", m.start(), m.end()) for m in NATIONAL.finditer(text)]
        out += [("iban", m.start(), m.end()) for m in IBAN.finditer(text)]
        if "IA" in text or "gh" in text:
            out += [("secret", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        out += [("secret", m.start(1), m.end(1)) for m in KEYED.finditer(text)]
    return out


def _iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, int, int, int]:
    """Strict form, gazetteer, context and shape: +1 personal data, -1 not, 0 no opinion."""
    value, family = text[start:end], kind.removeprefix("loose_")
    digits = "".join(c for c in value if c.isdigit())
    if family == "national_id":
        form = 1 if value[0] != "9" and value[:3] not in ("000", "666") and value[4:6] != "00" and value[7:] != "0000" else -1
    elif family == "iban":
        form = 1 if _iban_ok(value) else -1
    elif family == "secret":
        form = 1 if ACCESS.fullmatch(value) or re.fullmatch(r"[0-9a-f]{16,}|[A-Za-z0-9+/_=-]{24,}", value) else -1 if value.isalpha() else 0
    elif kind == "loose_phone":
        form = 0 if value[0] != "+" else -1
    else:
        form = 1 if kind in BASE else 0 if kind == "loose_email" else -1
    known = 0
    if family == "email":
        known = 1 if re.split(r"[^A-Za-z0-9]+", value)[-1].lower() in TOP_DOMAINS else -1
    elif family == "card":
        known = 1 if digits.startswith(CARD_PREFIXES) else -1
    elif family == "ip":
        known = -1 if value.startswith(("0.", "127.", "255.")) else 1
    elif family == "phone":
        known = -1 if len(set(digits)) < 3 else 1
    elif family == "iban":
        known = 1 if value[:2] in COUNTRIES else -1
    elif family == "secret":
        known = 1 if value.startswith(("AKIA", "ASIA", "gh")) else 0
    near = text[max(0, start - 40) : start] + " " + text[end : end + 20]
    context = 1 if CUE[family].search(near) else -1 if AGAINST.search(near) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    shape = -1 if left.isalnum() or right.isalnum() or left in "$€#" and left else 1
    if family == "secret":
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        shape = 1 if mixed and len(set(value)) >= 6 else -1
    return form, known, context, shape


def cell(kind: str, v: tuple[int, ...], length: int) -> int:
    """Kind, votes and length class as one number, of len(KINDS) * 3**VOTERS * SIZES."""
    code = KINDS.index(kind)
    for x in v:
        code = code * 3 + x + 1
    return code * SIZES + min(SIZES - 1, max(0, length // 8 - 1))


def uncell(code: int) -> tuple[int, tuple[int, ...], int]:
    size, code = code % SIZES, code // SIZES
    v = []
    for _ in range(VOTERS):
        v.append(code % 3 - 1)
        code //= 3
    return code, tuple(reversed(v)), size


WORD = re.compile(r"[^\W\d_]+")


def _shape(value: str) -> str:
    """Runs of letters, digits and other characters: a@a-9 for jane.doe7@mail-1 cut to its first twelve."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", value[:80]))))[:12]


def features(kind: str, v: tuple[int, ...], text: str, start: int, end: int) -> list[int]:
    """Numbers of what is seen at a candidate."""
    before, after = WORD.findall(text[max(0, start - 40) : start].lower())[-3:], WORD.findall(text[end : end + 30].lower())[:2]
    seen = [f"kind {kind}", f"shape {kind} {_shape(text[start:end])}", f"size {kind} {min(9, (end - start) // 4)}", f"left {text[start - 1 : start]!r}", f"right {text[end : end + 1]!r}"]
    seen += [f"vote {j} {x}" for j, x in enumerate(v)] + [f"vote {kind} {j} {x}" for j, x in enumerate(v)]
    seen += [f"before {w}" for w in before] + [f"after {w}" for w in after] + [f"last {kind} {w}" for w in before[-1:]]
    return [zlib.crc32(x.encode()) >> (32 - FEATURE_BITS) for x in seen]


SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,cell:int,seen:array<int>>>"
_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("cell", pa.int32()), ("seen", pa.list_(pa.int32()))])


def scan(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans and candidates of a whole text, with their cells; candidates that touch an earlier span are left out."""
    good, bad = base_spans(text)
    if not good and not bad and not ("=" in text or ":" in text or "dot" in text or DIGIT.search(text)):
        return [], []
    taken = sorted((a, b) for _, a, b in good)
    loose = []
    for s in sorted(bad + candidates(text), key=lambda s: (s[1], KINDS.index(s[0]))):
        at = _place(taken, s[1])
        if (at == 0 or taken[at - 1][1] <= s[1]) and (at == len(taken) or taken[at][0] >= s[2]):
            taken.insert(at, (s[1], s[2]))
            loose.append(s)

    def row(k: str, a: int, b: int) -> dict:
        v = votes(k, text, a, b)
        return {"start": a, "rank": KINDS.index(k), "end": b, "kind": k, "cell": cell(k, v, b - a), "seen": features(k, v, text, a, b)}

    return [row(*s) for s in good], [row(*s) for s in loose]


def _place(taken: list[tuple[int, int]], start: int) -> int:
    import bisect

    return bisect.bisect_left(taken, (start, start))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            cols: list[list] = [[], [], []]
            for text in part.column("_text"):
                good, loose = scan(text.as_py() or "")
                joined = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in good)
                for c, v in zip(cols, (good, loose, hashlib.sha256(joined.encode()).hexdigest())):
                    c.append(v)
            arrays = [part.column("_row"), pa.array(cols[0], pa.list_(_SPAN)), pa.array(cols[1], pa.list_(_SPAN)), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "_base", "_loose", "base_sha256"])


def estimate(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Posterior of each cell by expectation-maximisation over voters that are independent given the truth.

    Every voter has a probability of each of its three votes given true or false; every kind has its
    own share of true candidates. Starts from the majority of votes.
    """
    cells = sorted(counts)
    n = np.array([counts[c] for c in cells], float)
    parts = [uncell(c) for c in cells]
    kind = np.array([p[0] for p in parts])
    v = np.array([p[1] for p in parts]).reshape(len(cells), VOTERS) + 1
    post = 1 / (1 + np.exp(-2.0 * (v - 1).sum(1) + 0.5))
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        theta = np.full((2, VOTERS, 3), 1.0)
        for z in (0, 1):
            for j in range(VOTERS):
                theta[z, j] += np.bincount(v[:, j], weights=w[z], minlength=3)
        # A pseudo-count in favour of voters that are better than chance keeps the classes from swapping.
        theta[1, :, 2] += 2
        theta[0, :, 0] += 2
        theta /= theta.sum(2, keepdims=True)
        prior = (np.bincount(kind, weights=w[1], minlength=len(KINDS)) + 1) / (np.bincount(kind, weights=n, minlength=len(KINDS)) + 2)
        log = [np.log(theta[z, np.arange(VOTERS), v]).sum(1) for z in (0, 1)]
        odds = log[1] - log[0] + np.log(prior[kind] / (1 - prior[kind]))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return dict(zip(cells, post.tolist()))


class Spotter:
    """A logistic regression over hashed features; without any weights nothing is accepted."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0):
        self.weights, self.bias = weights, bias

    def odds(self, seen: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of candidates, whose features ``bounds`` cuts out of ``seen``."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[seen])])
        return sums[bounds[1:]] - sums[bounds[:-1]] + self.bias

    @staticmethod
    def train(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 300, rate: float = 0.1) -> Spotter:
        """Adam over all rows at once, towards the soft labels ``y``."""
        if not rows:
            return Spotter(None)
        seen = np.array([x for r in rows for x in r], np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        weight = weight / weight.sum()
        w = np.zeros((1 << FEATURE_BITS) + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(rounds):
            z = np.bincount(owner, weights=w[seen], minlength=len(rows)) + w[-1]
            error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            g = np.append(np.bincount(seen, weights=error[owner], minlength=1 << FEATURE_BITS), error.sum()) + l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.999 ** (k + 1))) + 1e-8)
        return Spotter(w[:-1], float(w[-1]))


def fit(found: DataFrame, sample: int = SAMPLE) -> Spotter:
    """Labelers' reliabilities from all candidates of ``found`` (_base, _loose), and the classifier from about ``sample`` of each kind, drawn by hash."""
    spans = found.select(F.explode(F.concat("_base", "_loose")).alias("s"))
    # At most len(KINDS) * 3**VOTERS * SIZES cells.
    counts = {r[0]: r[1] for r in spans.groupBy("s.cell").count().collect()}
    if not counts:
        return Spotter(None)
    soft = estimate(counts)
    of_kind = dict.fromkeys(KINDS, 0)
    for c, n in counts.items():
        of_kind[KINDS[uncell(c)[0]]] += n
    share = {k: min(1.0, sample / n) for k, n in of_kind.items() if n}
    chance = F.element_at(F.create_map(*(F.lit(x) for k, p in share.items() for x in (k, round(1_000_000 * p)))), F.col("s.kind"))
    drawn = spans.where(F.pmod(F.xxhash64("s"), F.lit(1_000_000)) < chance).select("s.cell", "s.kind", "s.seen")
    # Equal candidates are drawn together, so a repeated text could exceed the share: once each, with their number.
    rows = drawn.groupBy("cell", "kind", "seen").count().orderBy(F.xxhash64("seen"), "cell").limit(2 * sample * len(KINDS)).collect()
    return Spotter.train([r["seen"] for r in rows], np.array([soft[r["cell"]] for r in rows]), np.array([r["count"] / share[r["kind"]] for r in rows]))


def _result(base: list[dict], loose: list[dict]) -> tuple[list[int], str, int]:
    joined = sorted([*base, *loose], key=lambda s: (s["start"], s["rank"], s["end"]))
    return [sum(s["kind"] == k for s in base) for k in BASE], ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in joined), len(joined)


def find_pii(docs: DataFrame, keep: list[Column], threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``keep``, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of ``docs`` (text).

    Counts and digest cover the base spans, ``spans`` and ``n_spans`` those and accepted candidates;
    spans are kind:start:end in code points by start, then kind, comma-joined. A null or empty text
    has zero counts and an empty list; equal texts are judged alike; a kept column named like a result
    gives way to it; empty tables give no rows.
    """
    text = docs.select(F.struct(*keep).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    row = text.schema["_row"].dataType.simpleString()
    found = materialize(text.mapInArrow(_scan_batches, f"_row {row}, _base {SPANS}, _loose {SPANS}, base_sha256 string"), "pii-candidates")
    spotter = fit(found, sample)
    least = float(np.log(threshold / (1 - threshold)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = (batch.column(c).to_pylist() for c in ("_base", "_loose"))
            flat = [s for x in loose for s in x]
            if flat and spotter.weights is not None:
                good = spotter.odds(np.array([f for s in flat for f in s["seen"]], np.int64), np.cumsum([0, *(len(s["seen"]) for s in flat)])) >= least
            else:
                good = np.zeros(len(flat), bool)
            decided = iter(good.tolist())
            out = [_result(b, [s for s in x if next(decided)]) for b, x in zip(base, loose)]
            arrays = [batch.column("_row"), *(pa.array([o[0][i] for o in out], pa.int64()) for i in range(len(BASE))), batch.column("base_sha256")]
            arrays += [pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", *names])

    names = (*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans")
    schema = ", ".join(["_row " + row, *(f"n_{k} bigint" for k in BASE), "base_sha256 string, spans string, n_spans bigint"])
    return unpacked(found.mapInArrow(judge, schema), *names, names=names)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"), [F.col("doc_id").cast("long").alias("doc_id")])
