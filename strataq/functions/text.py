"""Text functions as Columns: tokens, polarity, entities, signatures and safe parsing.

Character classes are spelled out, so that results do not depend on how a regex dialect reads
``\\w`` or ``\\b`` outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too general to count as evidence, and markers of negation.
GENERIC = (
    "host", "user", "device", "query", "result", "results", "output", "input", "tool", "found", "seen", "shows",
    "reported", "detected", "contacted", "event", "events", "record", "records", "row", "rows",
)
NEGATIONS = ("no", "not", "never", "none", "without", "cannot", "can't", "didn't", "isn't", "aren't", "won't")
BLANKS = " \t\n\x0b\f\r"
TOKEN = "[a-z0-9][a-z0-9._:/-]{2,}"
IPV4 = "[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
EMAIL = "[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+[.][A-Za-z]{2,}"
URL = "(?i)https?://[^ \\t\\n\\r\"'<>;]+"
HOST = "(?i)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:[.][a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*[.](?:local|corp|internal|lan|dev|test|net|com|io|org)(?![A-Za-z0-9_])"
HASH = "(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
CVE = "(?i)CVE-[0-9]{4}-[0-9]+"
CODE_SUFFIXES = (
    "pyi|pyx|py|ipynb|tsx|ts|jsx|js|mjs|cjs|vue|svelte|kts|kt|java|scala|sc|groovy|gradle|cpp|cxx|cc|hpp|hxx|hh|c|h|"
    "rs|go|rb|php|swift|mm|m|cs|dart|lua|sh|bash|zsh|fish|ps1|sql|proto|graphql|html|htm|css|scss|sass|less|"
    "json|jsonl|yaml|yml|toml|ini|cfg|conf|xml|md|rst|txt|tf|hcl|dockerfile|mk|cmake|bzl"
)
CODE_REF = f"(?i)((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+[.](?:{CODE_SUFFIXES}))(?![A-Za-z0-9_.-])(?::([0-9]+))?"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of three characters or more without generic words; empty for null."""
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit(TOKEN), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, GENERIC)))


def is_negated(text: Column) -> Column:
    """Whether a negation stands as a word of its own."""
    return F.lower(_text(text)).rlike("(?:^|[^a-z0-9_])(?:" + "|".join(NEGATIONS) + ")(?:[^a-z0-9_]|$)")


def has_negation_marker(text: Column) -> Column:
    """Whether a marker occurs anywhere, inside words too."""
    return F.lower(_text(text)).rlike("not |no |never|false")


def entities(text: Column) -> Column:
    """Struct of distinct ips, hashes, cves, emails, hostnames and urls; all in lower case but urls."""
    t = _text(text)
    found = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    low = lambda p: F.array_distinct(F.transform(found(p), F.lower))
    return F.struct(
        F.array_distinct(found(f"(?<![0-9.])(?:{IPV4})(?![0-9.])")).alias("ips"), low(HASH).alias("hashes"), low(CVE).alias("cves"),
        low(EMAIL).alias("emails"), low(f"(?<![A-Za-z0-9_]){HOST}").alias("hostnames"), F.array_distinct(found(URL)).alias("urls"),
    )


def distinctive(entity_struct: Column, urls: bool = True) -> Column:
    """All entities that can tie findings together, with or without urls."""
    kinds = ("ips", "hashes", "cves", "emails", "hostnames") + (("urls",) if urls else ())
    return F.array_distinct(F.concat(*(entity_struct[k] for k in kinds)))


def entity_type(value: Column) -> Column:
    """ip, hash, cve, email or hostname; the first form that fits."""
    e = F.trim(value)
    colons = F.length(e) - F.length(F.replace(e, F.lit(":"), F.lit("")))
    return (
        F.when(e.rlike(f"^{IPV4}$"), "ip").when(e.rlike("^[0-9a-fA-F:]+$") & (colons >= 2), "ip").when(e.rlike("^[0-9a-fA-F]{32,64}$"), "hash")
        .when(e.rlike("(?i)^CVE-[0-9]{4}-[0-9]+$"), "cve").when(e.rlike("@.*[.]"), "email").otherwise("hostname")
    )


def named_entities(text: Column) -> Column:
    """Capitalised phrases, quoted phrases, addresses, hosts and urls in that order, first spelling kept."""
    t = _text(text)
    one = lambda p, g=0: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    phrases = F.filter(F.transform(one('"([^"]{2,80})"', 1), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)
    caps = one("(?<![A-Za-z0-9_])[A-Z][a-zA-Z0-9]*(?:[ \\t][A-Z][a-zA-Z0-9]*)+(?![A-Za-z0-9_])")
    all_ = F.concat(caps, phrases, one(f"(?<![0-9.])(?:{IPV4})(?![0-9.])"), one(f"(?<![A-Za-z0-9_]){HOST}"), one(URL))
    lowered = F.transform(all_, F.lower)
    return F.filter(all_, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def named_entity_type(name: Column) -> Column:
    system = "server|service|system|db|database|cluster|host|node|api|gateway|azure|aws|gcp|cloud"
    return (
        F.when(name.rlike(f"^{IPV4}"), "location").when(name.rlike("(?i)^https?://"), "system").when(F.lower(name).rlike(system), "system")
        .when(name.rlike("^[A-Z][a-z]+[ \\t]+[A-Z][a-z]+$"), "person").otherwise("concept")
    )


def code_refs(text: Column) -> Column:
    """Distinct file paths with a known code suffix."""
    return F.array_distinct(F.regexp_extract_all(_text(text), F.lit("(?<![A-Za-z0-9_])" + CODE_REF), F.lit(1)))


def canonical_signature(text: Column) -> Column:
    """Lower case with timestamps, hex runs and numbers replaced, blanks squeezed, 220 characters."""
    t = F.lower(F.trim(_text(text)))
    word = lambda p: f"(?<![a-z0-9_]){p}(?![a-z0-9_])"
    t = F.regexp_replace(t, word("[0-9]{4}-[0-9]{2}-[0-9]{2}t[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?(?:z|[+-][0-9]{2}:[0-9]{2})?"), "<ts>")
    t = F.regexp_replace(t, word("[0-9a-f]{7,64}"), "<hex>")
    t = F.regexp_replace(t, word("[0-9]+"), "<n>")
    return F.substring(F.regexp_replace(t, "[ \\t\\n\\r\\f\\x0b]+", " "), 1, 220)


def line_severity(line: Column) -> Column:
    """error, warning or null; an error word wins."""
    has = lambda ws: F.lower(_text(line)).rlike(f"(?:^|[^a-z0-9_])(?:{ws})(?:[^a-z0-9_]|$)")
    return F.when(has("error|exception|traceback|failed|failure|timeout|conflict"), "error").when(has("warn|warning|degraded|fallback|retry"), "warning")


def squeeze(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_text(text), "[ \\t\\n\\r\\f\\x0b]+", " ")))


def signature(kind: str, text: Column) -> Column:
    """SHA-256 of ``kind:text`` with the text squeezed and in lower case."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), squeeze(text)), 256)


def excerpt(text: Column, limit: int = 512) -> Column:
    return F.substring(_text(text), 1, limit)


def stable_id(text: Column) -> Column:
    """The first 15 hex digits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def hash_embedding(text: Column, size: int = 384) -> Column:
    """A deterministic vector in [-1, 1] from SHA-256 blocks of the text: eight numbers a block."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.conv(F.substr(F.sha2(F.concat(F.floor(i / 8).cast("string"), F.lit(":"), _text(text)), 256), (i % 8) * 8 + 1, F.lit(8)), 16, 10).cast("double") / 2147483647.5 - 1,
    )


def truncate_at_boundary(text: Column, limit: int | Column) -> Column:
    """At most ``limit`` characters, cut back to a line, sentence or word end if that keeps over half."""
    t = F.trim(_text(text), F.lit(BLANKS))
    most = limit if isinstance(limit, Column) else F.lit(limit)
    cut = F.substr(t, F.lit(1), most)
    out = cut
    for sep in reversed(("\n", ". ", "; ", ", ", " ")):
        at = F.length(cut) - F.locate(sep[::-1], F.reverse(cut)) - len(sep) + 1
        out = F.when((F.locate(sep[::-1], F.reverse(cut)) > 0) & (at > most * 0.5), F.substr(cut, F.lit(1), (at + 1).cast("int"))).otherwise(out)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(out, F.lit(BLANKS)), F.lit(" …[truncated]")))


def looks_like_dump(text: Column) -> Column:
    """Conversation dumps: role markers in over 800 characters, or over 1500 with few different words."""
    t = _text(text)
    words = F.regexp_extract_all(t, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    ratio = F.size(F.array_distinct(F.transform(words, F.lower))) / F.size(words)
    role = t.rlike('(?i)(?:^|[^A-Za-z0-9_])(?:user|assistant|system)[ \\t]*[:"]')
    return ((F.length(t) > 1500) & (F.size(words) > 0) & (role | (ratio < 0.35))) | (role & (F.length(t) > 800))


def intent(prompt: Column) -> Column:
    """The request without its polite opening, 200 characters."""
    polite = "(?i)^(can you|please|help me|could you|I need you to|I want you to|I'd like you to|would you)[ \\t\\n]+"
    return F.trim(F.substring(F.regexp_replace(F.trim(_text(prompt)), polite, ""), 1, 200))


def json_object(text: Column) -> Column:
    """The first {...} of a text as VARIANT; null where there is none that parses."""
    return F.try_parse_json(F.regexp_extract(_text(text), "(?s)\\{.*\\}", 0))


def contract_fields(text: Column) -> Column:
    """Field names of a contract's ``fields={...}`` in lower case."""
    body = F.regexp_extract(_text(text), "fields=(\\{[^}]+\\})", 1)
    return F.transform(F.map_keys(F.from_json(body, "map<string,string>")), F.lower)


def tag_value(tags: Column, key: str) -> Column:
    """The value of the first ``key:value`` tag."""
    return F.get(F.transform(F.filter(tags, lambda t: t.startswith(f"{key}:")), lambda t: F.substr(t, F.lit(len(key) + 2))), 0)


def markdown_headers(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit("(?m)^#{1,6}[ \\t]+(.+)$"), F.lit(1))


def front_matter(text: Column) -> Column:
    """The key: value lines between leading --- lines as a map."""
    body = F.regexp_extract(_text(text), "(?s)^---\\n(.*?)\\n---", 1)
    pairs = F.filter(F.split(body, "\n"), lambda x: F.instr(x, ":") > 0)
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.substr(x, F.instr(x, ":") + 1)))))


def line_slice(content: Column, first: Column, count: Column) -> Column:
    """``count`` lines of a file from line ``first`` on."""
    return F.array_join(F.slice(F.split(content, "\n"), first, count), "\n")


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def claims_of(raw: Column) -> Column:
    """A JSON list of claims, the bullet lines of a text, or the text as its only claim."""
    t = F.trim(_text(raw))
    listed = F.from_json(t, "array<string>")
    lines = F.transform(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, "^[ \\t-]+|[ \\t-]+$", ""))
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(t == "", F.array().cast("array<string>")).when(t.startswith("[") & listed.isNotNull(), clean(listed)).when(F.size(lines) > 1, lines).otherwise(F.array(t))


def parents_of(derived_from: Column) -> Column:
    """Trimmed distinct parent ids in their order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(derived_from, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def redact(values: Column, limit: int = 256) -> Column:
    """A map with the values of secret keys masked and others cut to ``limit`` characters."""
    secret = "(?i)pass|secret|token|key|auth|cred|cookie"
    return F.transform_values(values, lambda k, v: F.when(k.rlike(secret), "[redacted]").otherwise(F.substring(v, 1, limit)))


def sorted_json(values: Column) -> Column:
    """A map as compact JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))
