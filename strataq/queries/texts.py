"""Queries on text extraction and scalar scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import scoring as S
from strataq.functions import text as X
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL, NOW
from strataq.queries.base import query
from strataq.storage import read_table

GENERIC_SQL = ", ".join(f"'{w}'" for w in X.GENERIC)
TOKENS_SQL = lambda t: f"list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9._:/-]{{2,}}')), lambda x: x NOT IN ({GENERIC_SQL}))"
_WORDS = "no|not|never|none|without|cannot|can''t|didn''t|isn''t|aren''t|won''t"
NEGATED_SQL = lambda t: f"regexp_matches(lower({t}), '(?:^|[^a-z0-9_])(?:{_WORDS})(?:[^a-z0-9_]|$)')"


@query("token_document_frequency", f"SELECT token, count(*) AS df FROM (SELECT unnest({TOKENS_SQL('text')}) AS token FROM documents) GROUP BY 1")
def token_document_frequency(spark, sf):
    return read_table(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@query("polarity", f"SELECT doc_id, {NEGATED_SQL('text')} AS negated, regexp_matches(lower(text), 'not |no |never|false') AS marked FROM documents")
def polarity(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.is_negated(F.col("text")).alias("negated"), X.has_negation_marker(F.col("text")).alias("marked"))


_HOST = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:[.][a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*[.](?:local|corp|internal|lan|dev|test|net|com|io|org)"


@query(
    "entity_extract_counts",
    f"""SELECT kind, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (
      SELECT 'emails' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+[.][A-Za-z]{{2,}}'), lambda x: lower(x)))) AS value FROM documents
      UNION ALL SELECT 'hosts', unnest(list_distinct(list_transform(regexp_extract_all(url, '(?i){_HOST}\\b'), lambda x: lower(x)))) FROM pages
      UNION ALL SELECT 'urls', unnest(list_distinct(regexp_extract_all(url, '(?i)https?://[^ \\t\\n\\r"''<>;]+'))) FROM pages
      UNION ALL SELECT 'ips', unnest(list_distinct(regexp_extract_all(text, '\\b[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}}\\b'))) FROM documents)
    GROUP BY 1""",
)
def entity_extract_counts(spark, sf):
    docs, pages = read_table(spark, sf, "documents"), read_table(spark, sf, "pages")
    d = docs.select(X.entities(F.col("text")).alias("e"))
    p = pages.select(X.entities(F.col("url")).alias("e"))
    rows = lambda df, kind, field: df.select(F.lit(kind).alias("kind"), F.explode(F.col("e")[field]).alias("value"))
    all_ = rows(d, "emails", "emails").union(rows(p, "hosts", "hostnames")).union(rows(p, "urls", "urls")).union(rows(d, "ips", "ips"))
    return all_.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


@query("entity_types", r"""SELECT url AS value, CASE WHEN regexp_matches(url, '^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$') THEN 'ip' WHEN regexp_matches(url, '^[0-9a-fA-F:]+$') AND length(url) - length(replace(url, ':', '')) >= 2 THEN 'ip' WHEN regexp_matches(url, '^[0-9a-fA-F]{32,64}$') THEN 'hash' WHEN regexp_matches(url, '(?i)^CVE-[0-9]{4}-[0-9]+$') THEN 'cve' WHEN regexp_matches(url, '@.*[.]') THEN 'email' ELSE 'hostname' END AS type FROM (SELECT url FROM pages UNION ALL SELECT sha256(html) FROM pages UNION ALL SELECT 'CVE-2024-' || page_id FROM pages UNION ALL SELECT 'u' || page_id || '@mail.example' FROM pages UNION ALL SELECT '10.0.0.' || (page_id % 250) FROM pages UNION ALL SELECT 'fe80::' || (page_id % 10) FROM pages)""")
def entity_types(spark, sf):
    p = read_table(spark, sf, "pages")
    i = F.col("page_id").cast("string")
    forms = (F.col("url"), F.sha2("html", 256), F.concat(F.lit("CVE-2024-"), i), F.concat(F.lit("u"), i, F.lit("@mail.example")), F.concat(F.lit("10.0.0."), (F.col("page_id") % 250).cast("string")), F.concat(F.lit("fe80::"), (F.col("page_id") % 10).cast("string")))
    return p.select(F.explode(F.array(*forms)).alias("value")).select("value", X.entity_type(F.col("value")).alias("type"))


@query("named_entity_counts", None)
def named_entity_counts(spark, sf):
    names = read_table(spark, sf, "documents").select(F.explode(X.named_entities(F.col("text"))).alias("name"))
    return names.groupBy(X.named_entity_type(F.col("name")).alias("type")).agg(F.count("*").alias("mentions"), F.count_distinct("name").alias("names"))


@query("code_reference_scan", None)
def code_reference_scan(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("t"))
    return pages.select(F.explode(X.code_refs(F.col("t"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query(
    "signature_rollup",
    r"""SELECT signature, count(*) AS n FROM (SELECT substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(event_type || ' by ' || user_id || ' at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' value ' || event_id || ' ' || substr(sha256(event_type), 1, 12), ' ')),
      '\b[0-9]{4}-[0-9]{2}-[0-9]{2}t[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?(?:z|[+-][0-9]{2}:[0-9]{2})?\b', '<ts>', 'g'), '\b[0-9a-f]{7,64}\b', '<hex>', 'g'), '\b[0-9]+\b', '<n>', 'g'), '\s+', ' ', 'g'), 1, 220) AS signature FROM events) GROUP BY 1""",
)
def signature_rollup(spark, sf):
    line = F.concat_ws(" ", F.col("event_type"), F.lit("by"), F.col("user_id").cast("string"), F.lit("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("value"), F.col("event_id").cast("string"), F.substring(F.sha2("event_type", 256), 1, 12))
    return read_table(spark, sf, "events").groupBy(X.canonical_signature(line).alias("signature")).agg(F.count("*").alias("n"))


@query("text_signatures", r"""SELECT doc_id, sha256('memory:' || lower(trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' '))) AS signature, substr(text, 1, 512) AS excerpt, ('0x' || substr(sha256(text), 1, 15))::BIGINT AS stable_id FROM documents""")
def text_signatures(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.signature("memory", F.col("text")).alias("signature"), X.excerpt(F.col("text")).alias("excerpt"), X.stable_id(F.col("text")).alias("stable_id"))


@query("line_severities", "SELECT severity, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'warning' END AS severity FROM events) GROUP BY 1")
def line_severities(spark, sf):
    line = F.when(F.col("event_type") == "error", "Job FAILED with timeout").when(F.col("event_type") == "view", "slow, will Retry").otherwise("all fine")
    return read_table(spark, sf, "events").groupBy(X.line_severity(line).alias("severity")).agg(F.count("*").alias("n"))


@query("dump_detection", r"""SELECT doc_id, coalesce((length(text) > 1500 AND len(w) > 0 AND (r OR len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) < 0.35)) OR (r AND length(text) > 800), FALSE) AS dump FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}') AS w, regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:user|assistant|system)[ \t]*[:"]') AS r FROM documents)""")
def dump_detection(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.coalesce(X.looks_like_dump(F.col("text")), F.lit(False)).alias("dump"))


@query("hash_embeddings", "SELECT item_id, i, round(('0x' || substr(sha256((i // 8)::VARCHAR || ':' || text), i % 8 * 8 + 1, 8))::BIGINT / 2147483647.5::DOUBLE - 1, 9) AS value FROM benchmark, range(32) r(i)")
def hash_embeddings(spark, sf):
    return T.claims(spark, sf).select("item_id", F.posexplode(X.hash_embedding(F.col("text"), 32)).alias("i", "value")).select("item_id", F.col("i").cast("long").alias("i"), F.round("value", 9).alias("value"))


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AT_SQL = lambda sep: f"(length(cut) - length(string_split(cut, {sep})[-1]) - length({sep}))"
_CUT_SQL = " ".join(f"WHEN contains(cut, {sep}) AND {_AT_SQL(sep)} > 200 THEN substr(cut, 1, {_AT_SQL(sep)} + 1)" for sep in ("chr(10)", "'. '", "'; '", "', '", "' '"))


@query("boundary_truncation", f"WITH t AS (SELECT doc_id, trim(text, {_BLANK_SQL}) AS t FROM documents), c AS (SELECT *, substr(t, 1, 400) AS cut FROM t) SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE rtrim(CASE {_CUT_SQL} ELSE cut END, {_BLANK_SQL}) || ' …[truncated]' END AS text FROM c")
def boundary_truncation(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.truncate_at_boundary(F.col("text"), 400).alias("text"))


@query("claim_list_parsing", r"""WITH t AS (SELECT doc_id, trim(text, ' ') AS t FROM documents), l AS (SELECT *, list_transform(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: regexp_replace(x, '^[ \t-]+|[ \t-]+$', '', 'g')) AS l FROM t) SELECT doc_id, unnest(CASE WHEN t = '' THEN [] WHEN len(l) > 1 THEN l ELSE [t] END) AS claim FROM l""")
def claim_list_parsing(spark, sf):
    """No document is a JSON list, so the SQL leaves that form out."""
    return read_table(spark, sf, "documents").select("doc_id", F.explode(X.claims_of(F.col("text"))).alias("claim"))


@query(
    "decay_scores",
    f"""WITH {FINDINGS_SQL}, a AS (SELECT *, greatest(({NOW} - created_at_ts)::DOUBLE / 86400, 0) AS age FROM findings)
    SELECT id, round(importance * exp(-0.007::DOUBLE * age), 9) AS exponential, round(greatest(0.05::DOUBLE, importance * exp(-pow(age / 30, 0.8))), 9) AS weibull,
      round(exp(-ln(2::DOUBLE) / 7 * age), 9) AS weekly FROM a""",
)
def decay_scores(spark, sf):
    f, born = T.findings(spark, sf), F.col("created_at_ts")
    age = S.age_days(born, NOW)
    weibull = F.greatest(F.lit(0.05), F.col("importance") * S.weibull_retention(age))
    return f.select("id", F.round(S.exponential_decay(F.col("importance"), born, NOW), 9).alias("exponential"), F.round(weibull, 9).alias("weibull"), F.round(S.half_life(age, 7.0), 9).alias("weekly"))


@query(
    "replay_priority",
    f"""WITH {FINDINGS_SQL} SELECT id, priority FROM (SELECT id, seq, round(0.40::DOUBLE * exp(-ln(2::DOUBLE) / 720 * greatest(({NOW} - created_at_ts)::DOUBLE / 86400, 0) * 24)
      + 0.35::DOUBLE * least(1, importance * CASE confidence WHEN 'high' THEN 1.2::DOUBLE WHEN 'medium' THEN 1 ELSE 0.7::DOUBLE END) + 0.25::DOUBLE * ln(1 + recall_count::DOUBLE) / ln(11::DOUBLE), 9) AS priority FROM findings)
    ORDER BY priority DESC, seq LIMIT 7""",
)
def replay_priority(spark, sf):
    score = S.replay_priority(F.col("created_at_ts"), F.col("importance"), F.col("confidence"), F.col("recall_count"), NOW, 720.0)
    return T.findings(spark, sf).select("id", "seq", F.round(score, 9).alias("priority")).orderBy(F.desc("priority"), "seq").limit(7).select("id", "priority")


@query(
    "stability_retention",
    f"""WITH {FINDINGS_SQL}, d AS (SELECT id, recall_count, least(greatest(11 - importance * 10, 1), 10) AS difficulty, greatest(({NOW} - created_at_ts)::DOUBLE / 86400, 0) AS age FROM findings),
    s AS (SELECT *, greatest(1, difficulty * 0.5) * pow(1 + recall_count::DOUBLE, 1 / greatest(1, difficulty)) AS s FROM d), r AS (SELECT *, exp(-age / s) AS r FROM s)
    SELECT id, round(difficulty, 9) AS difficulty, round(s, 9) AS stability, round(r, 9) AS retention, CASE WHEN r >= 0.9 THEN 5 WHEN r >= 0.75 THEN 4 WHEN r >= 0.55 THEN 3 WHEN r >= 0.35 THEN 2 ELSE 1 END::DOUBLE AS grade, round(greatest(0.5, s * 0.5), 9) AS after_failure FROM r""",
)
def stability_retention(spark, sf):
    d = S.initial_difficulty(F.col("importance") * 10)
    f = T.findings(spark, sf).select("id", d.alias("d"), S.stability(F.col("recall_count"), d).alias("s"), S.age_days(F.col("created_at_ts"), NOW).alias("age")).withColumn("r", F.exp(-F.col("age") / F.col("s")))
    return f.select("id", F.round("d", 9).alias("difficulty"), F.round("s", 9).alias("stability"), F.round("r", 9).alias("retention"), S.retention_grade(F.col("r")).alias("grade"), F.round(S.stability_after_failure(F.col("s")), 9).alias("after_failure"))


@query(
    "multi_signal_scores",
    f"""WITH {FINDINGS_SQL} SELECT id, round(0.50::DOUBLE * importance + 0.20::DOUBLE * exp(-ln(2::DOUBLE) / 7 * greatest(({NOW} - created_at_ts)::DOUBLE / 86400, 0)) + 0.15::DOUBLE * CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END
      + 0.15::DOUBLE * CASE record_type WHEN 'observed' THEN 1 WHEN 'inferred' THEN 0.8::DOUBLE WHEN 'assumed' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END + 0.08::DOUBLE * ln(1 + recall_count::DOUBLE), 9) AS score FROM findings""",
)
def multi_signal_scores(spark, sf):
    score = S.multi_signal(F.col("importance"), F.col("created_at_ts"), F.col("confidence"), F.col("record_type"), F.col("recall_count").cast("double"), NOW)
    return T.findings(spark, sf).select("id", F.round(score, 9).alias("score"))


@query("protection_weights", f"WITH {FINDINGS_SQL} SELECT id, round(least(1, CASE confidence WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * CASE record_type WHEN 'observed' THEN 1.1::DOUBLE WHEN 'inferred' THEN 1 WHEN 'assumed' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END), 9) AS weight FROM findings")
def protection_weights(spark, sf):
    return T.findings(spark, sf).select("id", F.round(S.protection(F.col("confidence"), F.col("record_type")), 9).alias("weight"))


#: (rule, category, pattern), in order of severity; a subset that reads alike in all dialects.
RULES = (
    ("override", "injection_high", "(?i)ignore (all )?(previous|prior) (instructions?|rules?)"),
    ("jailbreak", "injection_high", "(?i)dan mode|godmode|jailbreak"),
    ("recursive-delete", "dangerous", "rm -[a-zA-Z]*r[a-zA-Z]*f"),
    ("drop-table", "dangerous", "(?i)drop (table|database|schema)"),
    ("pipe-to-shell", "supply_chain", "(curl|wget) .{0,120}[|] *(bash|sh|python)"),
    ("credential", "suspicious", "(?i)(password|token|secret) ?="),
    ("access-key", "suspicious", "AKIA[0-9A-Z]{16}"),
    ("script", "suspicious", "(?i)<script"),
)
_RULES_SQL = ", ".join(f"({i}, '{r}', '{c}', '{p}')" for i, (r, c, p) in enumerate(RULES))


@query("pattern_scan", f"WITH rules(o, rule, category, pattern) AS (VALUES {_RULES_SQL}), t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages) SELECT id, rule, category FROM (SELECT id, rule, category, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM t JOIN rules ON regexp_matches(text, pattern)) WHERE n = 1")
def pattern_scan(spark, sf):
    """The first fitting rule per text, tried in the rules' order as one expression: no join, no shuffle."""
    texts = read_table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    texts = texts.union(read_table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "html"))
    hit = F.coalesce(*(F.when(F.col("text").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(c).alias("category"))) for r, c, p in RULES))
    return texts.select("id", hit.alias("h")).where("h IS NOT NULL").select("id", "h.rule", "h.category")


@query("tool_call_ladder", f"WITH {FINDINGS_SQL} SELECT id, CASE WHEN record_type = 'gap' THEN 'allow' WHEN regexp_matches(text, '(?i)(password|token|secret) ?=') AND tier = 'hot' THEN 'block' WHEN regexp_matches(text, '(?i)(password|token|secret) ?=') THEN 'log' WHEN regexp_matches(text, 'AKIA[0-9A-Z]{{16}}') THEN 'block' ELSE 'audit' END AS decision FROM findings")
def tool_call_ladder(spark, sf):
    secret, key = F.col("text").rlike(RULES[5][2]), F.col("text").rlike(RULES[6][2])
    decision = F.when(F.col("record_type") == "gap", "allow").when(secret & (F.col("tier") == "hot"), "block").when(secret, "log").when(key, "block").otherwise("audit")
    return T.findings(spark, sf).select("id", decision.alias("decision"))
