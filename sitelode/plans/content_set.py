"""Queries over stored pages and documents: links, language, safety, classes, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.functions.layout import spread_small
from sitelode.functions.scalars import content_hash, risk_score
from sitelode.operators import bayes, calibrate, classify, content, dedup, language, metrics, safety
from sitelode.operators.classify import Rule
from sitelode.operators.content import LANGUAGE_WORDS
from sitelode.plans.discovery import classify_run, discovery_run
from sitelode.plans.registry import query
from sitelode.plans.views import AS_OF_EVENTS, AS_OF_SITES, Fixture
from sitelode.session import materialize, scratch_path
from sitelode.sources.text_lists import pattern_parse, patterns_frame, read_patterns, seed_parse

# --- fixed values: test patterns and rules that occur in the fixture texts -------------
PATTERN_TEXT = """
# Category 1: Contact
/[a-z0-9.]+@[a-z0-9.]+/i
# Category 2: Address
/[0-9]{1,3}(\\.[0-9]{1,3}){3}/i
# Category 3: Licence
/copyright|license/i
"""
PATTERNS = pattern_parse(PATTERN_TEXT)

RULES = (
    Rule("forum", "the", 1.0), Rule("forum", "with", 0.5),
    Rule("library", "les", 1.0), Rule("library", "pour", 0.25),
    Rule("market", "der", 0.75), Rule("market", "und", 0.5),
    Rule("service", "los", 0.5), Rule("service", "para", 1.0),
)
SIZE_LIMIT = 8000

SQL_HITS = {
    "Contact": "len(regexp_extract_all(text, '(?i)[a-z0-9.]+@[a-z0-9.]+'))",
    "Address": "len(regexp_extract_all(text, '[0-9]{1,3}(\\.[0-9]{1,3}){3}'))",
    "Licence": "len(regexp_extract_all(text, '(?i)copyright|license'))",
}
SQL_FLAGS = ", ".join(f"{expr} AS h_{name.lower()}" for name, expr in SQL_HITS.items())

SEED_SQL = """
  SELECT line, lower(regexp_extract(line, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@\\s]*@)?([^/:?#\\s]+)', 1)) AS address
  FROM (SELECT trim(value) AS line FROM seed_lines) t WHERE line <> '' AND NOT starts_with(line, '#')"""
ERROR_SQL = """CASE WHEN NOT suffix(address, '.onion') THEN 'address must end with .onion'
    WHEN length(address) <> 62 THEN 'invalid address length' END"""

RULE_VALUES = ", ".join(f"('{r.category}', '{r.keyword}', {r.weight})" for r in RULES)


def _rule_sql(key: str, source: str) -> str:
    """(key, category, confidence) by the keyword rules, over rows of `source`."""
    return f"""
  SELECT k.{key}, coalesce(b.category, 'other') AS category, coalesce(b.score / b.total, 0.0) AS confidence
  FROM (SELECT {key} FROM {source}) k LEFT JOIN (
    SELECT {key}, category, score, sum(score) OVER (PARTITION BY {key}) AS total,
      row_number() OVER (PARTITION BY {key} ORDER BY score DESC, category) AS rn
    FROM (SELECT w.{key}, r.category, sum(CAST(r.weight AS DOUBLE)) AS score
          FROM (SELECT DISTINCT {key}, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {source}) w
          JOIN (VALUES {RULE_VALUES}) r(category, keyword, weight) ON r.keyword = w.word
          GROUP BY 1, 2) s) b ON b.{key} = k.{key} AND b.rn = 1"""


@query(
    "seed_parse",
    f"""
WITH entries AS ({SEED_SQL})
SELECT line, address, {ERROR_SQL} AS error, ({ERROR_SQL}) IS NULL AS is_valid FROM entries""",
)
def seeds(fx: Fixture):
    return seed_parse(fx.seed_lines)


@query(
    "pattern_parse",
    """
WITH l AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) AS INT) AS category_no FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) x),
p AS (SELECT category_no, lang AS category, concat(lang, ending) AS pattern, 'i' AS flags FROM l, (VALUES ('[a-z]+er'), (' the')) e(ending)),
d AS (SELECT doc_id, category, bool_or(regexp_matches(text, concat('(?i)', pattern))) AS hit FROM documents, p GROUP BY ALL)
SELECT category_no, category, pattern, flags, (SELECT count(*) FROM d WHERE d.category = p.category AND hit) AS n_documents FROM p""",
)
def patterns(fx: Fixture):
    """A pattern file made from the languages of the documents, written, read, and applied."""
    langs = fx.documents.select("lang").distinct().filter("lang IS NOT NULL")
    listed = langs.agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    block = F.transform("langs", lambda x, i: F.concat(F.lit("# Category "), i + 1, F.lit(": "), x, F.lit("\n/"), x, F.lit("[a-z]+er/i\n/"), x, F.lit(" the/\n")))
    path = scratch_path(fx.spark, "patterns")
    listed.select(F.array_join(block, "\n").alias("value")).write.text(path)
    found = read_patterns(fx.spark, path)
    flagged = safety.pattern_flag(spread_small(fx.documents.select("doc_id", "text"), "doc_id"), found)
    hits = metrics.tag_counts(flagged, "flagged_categories").withColumnsRenamed({"tag": "category", "n": "n_documents"})
    parsed = patterns_frame(fx.spark, found)
    return parsed.join(hits, "category", "left").fillna(0, ["n_documents"]).select(
        "category_no", "category", "pattern", "flags", "n_documents"
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(fx: Fixture):
    return fx.documents.select("doc_id", content_hash("text").alias("content_hash"))


@query("size_gate", f"SELECT doc_id, octet_length(encode(text)) > {SIZE_LIMIT} AS over_size FROM documents")
def size_gate(fx: Fixture):
    return safety.size_gate(fx.documents, max_bytes=SIZE_LIMIT).select("doc_id", "over_size")


def _decoded_sql(expression: str) -> str:
    for entity, character in content.ENTITIES:
        expression = "replace({}, '{}', '{}')".format(expression, entity, character.replace("'", "''"))
    return expression


_TITLE_SQL = _decoded_sql(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_TEXT_SQL = _decoded_sql(r"""regexp_replace(regexp_replace(html,
    '(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')""")


@query(
    "page_extract",
    rf"""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
  nullif(trim({_TITLE_SQL}), '') AS title,
  nullif(regexp_extract(html, '(?is)<meta name="description" content="([^"]*)"', 1), '') AS description,
  nullif(regexp_extract(html, '(?is)<html[^>]*\blang="([^"]*)"', 1), '') AS language,
  trim(regexp_replace({_TEXT_SQL}, '\s+', ' ', 'g')) AS visible_text
FROM pages""",
)
def page_extract(fx: Fixture):
    extracted = content.page_extract(spread_small(fx.pages, "page_id"))
    return extracted.select("page_id", "host", "title", "description", "language", "visible_text")


@query(
    "link_extract",
    r"""
WITH h AS (
  SELECT page_id, url, unnest(hrefs) AS href, CAST(generate_subscripts(hrefs, 1) - 1 AS INT) AS position
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages) p)
SELECT page_id, position, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    ELSE concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), href) END AS link
FROM h WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(lower(href), 'mailto:')
  AND NOT starts_with(lower(href), 'javascript:')""",
)
def link_extract(fx: Fixture):
    return content.link_extract(spread_small(fx.pages, "page_id"))


@query(
    "link_bfs",
    """
WITH RECURSIVE reach AS (
  SELECT DISTINCT s_suppkey AS node, 0 AS depth FROM supplier
  UNION
  SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE r.depth < 2)
SELECT node, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY node""",
)
def link_bfs(fx: Fixture):
    return content.link_bfs(fx.edges, fx.supplier.select(F.col("s_suppkey").alias("node")), 2)


@query(
    "page_cap",
    """
SELECT host, url, depth, rank FROM (
  SELECT host, url, depth, CAST(row_number() OVER (PARTITION BY host ORDER BY depth, url) AS INT) AS rank
  FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, url, 5 - priority AS depth FROM crawl_jobs) p) r
WHERE rank <= 50""",
)
def page_cap(fx: Fixture):
    pages = fx.crawl_jobs.select(content.host_of("url").alias("host"), "url", (5 - F.col("priority")).alias("depth"))
    return content.page_cap(pages)


@query(
    "lang_detect_words",
    f"""
WITH profile AS (SELECT * FROM (VALUES {', '.join(f"('{lang}', '{w}')" for lang, ws in LANGUAGE_WORDS.items() for w in ws)}) v(lang, word)),
scores AS (
  SELECT w.doc_id, p.lang, count(*) AS hits
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) w
  JOIN profile p ON p.word = w.word GROUP BY 1, 2),
best AS (SELECT doc_id, lang, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS rn FROM scores)
SELECT d.doc_id, d.lang, CASE WHEN b.hits >= 3 THEN b.lang END AS detected
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.rn = 1""",
)
def lang_detect_words(fx: Fixture):
    documents = spread_small(fx.documents.select("doc_id", "text", "lang"), "doc_id")
    return content.lang_detect(documents).select("doc_id", "lang", "detected")


#: Every third document is held out of the training of models.
HELD_OUT = "doc_id % 3 = 2"

# A table for CRC-32, and the checksum of a text by it.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)) x)"""
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda p: CAST('0x' || p AS BIGINT))),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"""
_LANGUAGE_CTES = f"""{_CRC_TABLE},
w AS (SELECT doc_id, lang, {HELD_OUT} AS held_out, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents),
f AS (SELECT doc_id, lang, held_out, feature, count(*) AS n FROM (
  SELECT doc_id, lang, held_out, concat('^', left(word, {language.EDGE})) AS feature FROM w
  UNION ALL SELECT doc_id, lang, held_out, concat(right(word, {language.EDGE}), '$') FROM w) x GROUP BY ALL),
hashed AS (SELECT feature, {_CRC} % {language.BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM f) x, crc_table),
counts AS (SELECT lang, bucket, CAST(sum(n) AS BIGINT) AS n FROM f JOIN hashed ON hashed.feature = f.feature
  WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL)"""


@query("lang_profile", f"WITH {_LANGUAGE_CTES} SELECT lang, CAST(bucket AS INT) AS bucket, n FROM counts")
def lang_profile(fx: Fixture):
    known = fx.documents.filter(~F.expr(HELD_OUT)).select("doc_id", "text", "lang")
    return language.language_counts(spread_small(known, "doc_id"))


@query(
    "lang_detect",
    f"""
WITH {_LANGUAGE_CTES},
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
weights AS (SELECT t.lang, b.bucket, CAST(round({language.UNIT} * ln(CAST(coalesce(c.n, 0) + 1 AS DOUBLE) / CAST(t.total + {language.BUCKETS} AS DOUBLE))) AS BIGINT) AS weight
  FROM totals t CROSS JOIN range({language.BUCKETS}) b(bucket) LEFT JOIN counts c ON c.lang = t.lang AND c.bucket = b.bucket),
scores AS (SELECT f.doc_id, weights.lang, sum(f.n * weight) AS score
  FROM f JOIN hashed ON hashed.feature = f.feature JOIN weights ON weights.bucket = hashed.bucket GROUP BY 1, 2),
ranked AS (SELECT doc_id, lang, score, row_number() OVER p AS rn, lead(score) OVER p AS next
  FROM scores WINDOW p AS (PARTITION BY doc_id ORDER BY score DESC, lang DESC))
SELECT d.doc_id, d.lang, d.{HELD_OUT} AS held_out, CASE WHEN r.score - r.next >= ceil(ln({language.ODDS}) * {language.UNIT}) THEN r.lang END AS detected
FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.rn = 1""",
)
def lang_detect(fx: Fixture):
    model = language.LanguageModel.from_counts(lang_profile(fx))
    documents = spread_small(fx.documents.select("doc_id", "text", "lang"), "doc_id")
    return language.detect_language(documents, model).select("doc_id", "lang", F.expr(HELD_OUT).alias("held_out"), "detected")


@query(
    "pattern_flag",
    f"""
WITH d AS (SELECT doc_id, {SQL_FLAGS} FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN h_contact > 0 THEN 'Contact' END, CASE WHEN h_address > 0 THEN 'Address' END,
  CASE WHEN h_licence > 0 THEN 'Licence' END) AS flagged_categories, CAST(h_contact + h_address + h_licence AS INT) AS n_matches
FROM d""",
)
def pattern_flag(fx: Fixture):
    flagged = safety.pattern_flag(spread_small(fx.documents.select("doc_id", "text"), "doc_id"), PATTERNS)
    return flagged.select("doc_id", F.array_join("flagged_categories", ",").alias("flagged_categories"), "n_matches")


@query(
    "safety_check",
    f"""
WITH d AS (
  SELECT t.doc_id, h_contact + h_address + h_licence > 0 AS flagged, octet_length(encode(t.text)) > {SIZE_LIMIT} AS big,
    coalesce(s.is_honeypot, false) AS trap, coalesce(len(k.risk_factors), 0) AS n_factors
  FROM (SELECT doc_id, text, {SQL_FLAGS} FROM documents) t
  LEFT JOIN sites s ON s.site_id = t.doc_id LEFT JOIN safety_checks k ON k.id = t.doc_id)
SELECT doc_id, CASE WHEN flagged THEN 'block' WHEN big THEN 'quarantine' WHEN trap OR n_factors > 0 THEN 'review' ELSE 'allow' END AS action_taken,
  NOT flagged AND NOT big AND NOT trap AND n_factors = 0 AS is_safe
FROM d""",
)
def safety_check(fx: Fixture):
    scanned = safety.pattern_flag(spread_small(fx.documents.select("doc_id", "text"), "doc_id"), PATTERNS)
    gated = safety.size_gate(scanned, max_bytes=SIZE_LIMIT).select("doc_id", "flagged_categories", "over_size")
    sites = fx.sites.select(F.col("site_id").alias("doc_id"), "is_honeypot")
    factors = fx.safety_checks.select(F.col("id").alias("doc_id"), "risk_factors")
    joined = gated.join(sites, "doc_id", "left").join(factors, "doc_id", "left")
    return safety.safety_check(joined).select("doc_id", "action_taken", "is_safe")


@query(
    "risk_score",
    """
WITH c AS (SELECT site_id, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY classified_at DESC, id DESC) AS rn FROM classifications) r WHERE rn = 1),
k AS (SELECT site_id, risk_factors, action_taken FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY checked_at DESC, id DESC) AS rn FROM safety_checks) r WHERE rn = 1)
SELECT s.site_id, round(least(1.0, CASE WHEN k.action_taken = 'block' THEN 0.4 ELSE 0.0 END + 0.1 * coalesce(len(k.risk_factors), 0)
  + CASE WHEN s.is_honeypot THEN 0.3 ELSE 0.0 END + 0.2 * (1 - coalesce(c.confidence, 0.0))), 6) AS risk_score
FROM sites s LEFT JOIN c ON c.site_id = s.site_id LEFT JOIN k ON k.site_id = s.site_id""",
)
def risk_scores(fx: Fixture):
    newest = metrics.latest_classification(fx.classifications).select("site_id", "confidence")
    checked = metrics.latest_safety(fx.safety_checks).select("site_id", "risk_factors", "is_illegal")
    joined = fx.sites.select("site_id", "is_honeypot").join(newest, "site_id", "left").join(checked, "site_id", "left")
    flagged = F.when(F.col("is_illegal"), F.array(F.lit("flagged")))
    score = risk_score(flagged, F.col("risk_factors"), F.col("is_honeypot"), F.col("confidence"))
    return joined.select("site_id", F.round(score, 6).alias("risk_score"))


@query(
    "rule_classify",
    f"""
WITH c AS ({_rule_sql('doc_id', 'documents')})
SELECT doc_id, category, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM c""",
)
def rule_classify(fx: Fixture):
    documents = spread_small(fx.documents.select("doc_id", "text"), "doc_id")
    return classify.rule_classify(documents, RULES).select("doc_id", "category", F.round("confidence", 6).alias("confidence"))


@query(
    "confidence_gate",
    """
SELECT id, confidence, confidence >= 0.7 AS accepted, NOT confidence >= 0.7 AS requires_review FROM classifications""",
)
def confidence_gate(fx: Fixture):
    return classify.confidence_gate(fx.classifications).select("id", "confidence", "accepted", "requires_review")


def _labelled(fx: Fixture):
    return fx.labels.select("doc_id", F.when(F.col("toxic") == 1, "market").otherwise("library").alias("label"))


# --- the fixed folds of the model queries: fit, calibrate, hold out --------------------
FIT, CALIBRATE = "doc_id % 3 = 0", "doc_id % 3 = 1"


def _supervised(fx: Fixture, fold: str):
    """The Bayes model of one fold of the labelled documents, applied to all documents."""
    documents = spread_small(fx.documents.select("doc_id", "text"), "doc_id")
    model = bayes.fit_bayes(documents.filter(fold).join(_labelled(fx), "doc_id"))
    return bayes.bayes_classify(model, documents)


def _bayes_sql(fold: str) -> str:
    """CTEs: `judged` has (doc_id, category, confidence) of the Bayes model fitted on one fold."""
    return f"""
truth AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'market' ELSE 'library' END AS label FROM labels),
bag AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM documents) x GROUP BY 1, 2),
train AS (SELECT t.doc_id, t.label FROM truth t JOIN documents d ON d.doc_id = t.doc_id WHERE t.{fold}),
per_label AS (SELECT token, label, sum(n) AS n, count(*) AS docs FROM bag JOIN train ON train.doc_id = bag.doc_id GROUP BY 1, 2),
vocabulary AS (SELECT token FROM per_label GROUP BY token HAVING sum(docs) >= {bayes.MIN_DOCS}),
classes AS (SELECT c.label, CAST(round({bayes.UNIT} * ln(CAST(docs AS DOUBLE) / CAST((SELECT count(*) FROM train) AS DOUBLE))) AS BIGINT) AS prior, total
  FROM (SELECT label, count(*) AS docs FROM train GROUP BY label) c
  JOIN (SELECT label, sum(n) AS total FROM per_label JOIN vocabulary ON vocabulary.token = per_label.token GROUP BY label) t ON t.label = c.label),
weights AS (SELECT v.token, c.label, CAST(round({bayes.UNIT} * ln(CAST(coalesce(p.n, 0) + 1 AS DOUBLE) / CAST(c.total + (SELECT count(*) FROM vocabulary) AS DOUBLE))) AS BIGINT) AS weight
  FROM vocabulary v CROSS JOIN classes c LEFT JOIN per_label p ON p.token = v.token AND p.label = c.label),
sums AS (SELECT doc_id, label, sum(n * weight) AS s FROM bag JOIN weights ON weights.token = bag.token GROUP BY 1, 2),
scores AS (SELECT d.doc_id, c.label, c.prior + coalesce(s.s, 0) AS score FROM documents d CROSS JOIN classes c LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.label = c.label),
judged AS (SELECT doc_id, arg_max(label, (score, -rank)) AS category, 1 / sum(exp(CAST(score - best AS DOUBLE) / {bayes.UNIT})) AS confidence
  FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY label) AS rank FROM scores) x GROUP BY doc_id)"""


@query(
    "ml_supervised",
    f"""
WITH {_bayes_sql("doc_id % 3 <> 2")}
SELECT doc_id, {HELD_OUT} AS held_out, category, round(confidence, 6) AS confidence FROM judged""",
)
def ml_supervised(fx: Fixture):
    judged = _supervised(fx, f"NOT ({HELD_OUT})")
    return judged.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "category", F.round("confidence", 6).alias("confidence"))


@query("ml_logistic")
def ml_logistic(fx: Fixture):
    documents = spread_small(fx.documents.select("doc_id", "text"), "doc_id")
    model = classify.train_supervised(documents.join(_labelled(fx), "doc_id"))
    return classify.ml_supervised(model, documents).select("doc_id", "category", F.round("confidence", 4).alias("confidence"))


@query("ml_unsupervised")
def ml_unsupervised(fx: Fixture):
    return classify.ml_unsupervised(fx.embeddings)


def _calibrated(fx: Fixture, judged, truth):
    """Verdicts with their confidence replaced by the share of right ones, learnt on the calibration fold."""
    known = judged.filter(CALIBRATE).join(truth, "doc_id")
    table = calibrate.fit_calibration(known, F.col("category") == F.col("label"))
    return judged.withColumn("confidence", calibrate.calibrated(F.col("confidence"), table))


def _hybrid(fx: Fixture):
    truth = _labelled(fx)
    by_rule = classify.rule_classify(spread_small(fx.documents.select("doc_id", "text"), "doc_id"), RULES)
    by_rule = materialize(by_rule.select("doc_id", "category", "confidence"), "by-rule")
    by_model = materialize(_supervised(fx, FIT).select("doc_id", "category", "confidence"), "by-model")
    by_rule, by_model = _calibrated(fx, by_rule, truth), _calibrated(fx, by_model, truth)
    return {"rule_based": by_rule, "ml_supervised": by_model, "hybrid": classify.hybrid_classify(by_rule, by_model)}


def _isotonic_sql(name: str, judged: str) -> str:
    """CTE `name` (doc_id, category, confidence): calibrated by the greatest of least means over runs of bins."""
    bins = calibrate.BINS
    return f"""
{name}_bins AS (SELECT CAST(least(floor(j.confidence * {bins}), {bins - 1}) AS INT) AS bin, count(*) AS n, count(*) FILTER (j.category = t.label) AS hits
  FROM {judged} j JOIN truth t ON t.doc_id = j.doc_id WHERE j.{CALIBRATE} GROUP BY 1),
{name}_runs AS (SELECT a.bin AS low, z.bin AS high, (SELECT CAST(sum(hits) AS DOUBLE) / CAST(sum(n) AS DOUBLE) FROM {name}_bins m WHERE m.bin BETWEEN a.bin AND z.bin) AS share
  FROM {name}_bins a JOIN {name}_bins z ON z.bin >= a.bin),
{name}_fit AS (SELECT bin, max(least_share) AS share FROM (
  SELECT b.bin, r.low, min(r.share) AS least_share FROM {name}_bins b JOIN {name}_runs r ON r.low <= b.bin AND r.high >= b.bin GROUP BY 1, 2) x GROUP BY bin),
{name}_table AS (SELECT g.bin, coalesce((SELECT arg_max(share, f.bin) FROM {name}_fit f WHERE f.bin <= g.bin), (SELECT arg_min(share, f.bin) FROM {name}_fit f)) AS share FROM range({bins}) g(bin)),
{name} AS (SELECT j.doc_id, j.category, k.share AS confidence FROM {judged} j LEFT JOIN {name}_table k ON k.bin = CAST(least(floor(j.confidence * {bins}), {bins - 1}) AS INT))"""


HYBRID_CTES = f"""{_bayes_sql(FIT)},
ruled AS (SELECT doc_id, category, CAST(confidence AS DOUBLE) AS confidence FROM ({_rule_sql('doc_id', 'documents')}) x),
{_isotonic_sql("by_rule", "ruled")},
{_isotonic_sql("by_model", "judged")},
hybrid AS (SELECT r.doc_id, r.confidence >= {classify.CONFIDENCE_THRESHOLD} AS keep, CASE WHEN keep THEN r.category ELSE m.category END AS category,
  CASE WHEN keep THEN r.confidence ELSE m.confidence END AS confidence FROM by_rule r JOIN by_model m ON m.doc_id = r.doc_id)"""


@query(
    "hybrid_classify",
    f"""
WITH {HYBRID_CTES}
SELECT doc_id, category, round(confidence, 6) AS confidence, CASE WHEN keep THEN 'rule_based' ELSE 'ml_supervised' END AS decided_by FROM hybrid""",
)
def hybrid_classify(fx: Fixture):
    """Rules and model on one scale: both confidences are calibrated before the gate compares them."""
    return _hybrid(fx)["hybrid"].select("doc_id", "category", F.round("confidence", 6).alias("confidence"), "decided_by")


_ERROR_SQL = " UNION ALL ".join(
    f"""SELECT '{kind}' AS classifier, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(round(sum(abs(mean - CAST(hits AS DOUBLE) / CAST(n AS DOUBLE)) * n) / sum(n), 6) AS DOUBLE) AS error FROM (
  SELECT CAST(least(floor(c.confidence * {calibrate.BINS}), {calibrate.BINS - 1}) AS INT) AS bin, count(*) AS n, count(*) FILTER (c.category = t.label) AS hits, avg(c.confidence) AS mean
  FROM {source} c JOIN truth t ON t.doc_id = c.doc_id WHERE c.{HELD_OUT} GROUP BY 1) b"""
    for kind, source in (("rule_based", "by_rule"), ("ml_supervised", "by_model"), ("hybrid", "hybrid"))
)


@query("calibration_error", f"WITH {HYBRID_CTES} {_ERROR_SQL}")
def calibration_error(fx: Fixture):
    """Calibration error of the rules, the model and both together on the held-out fold."""
    truth, errors = _labelled(fx), None
    for kind, judged in _hybrid(fx).items():
        counts = calibrate.reliability(judged.filter(HELD_OUT).join(truth, "doc_id"), F.col("category") == F.col("label"))
        part = calibrate.calibration_error(counts).select(F.lit(kind).alias("classifier"), "n", F.round("error", 6).alias("error"))
        errors = part if errors is None else errors.unionByName(part)
    return errors


@query(
    "classify_run",
    f"""
WITH contents AS (SELECT d.doc_id AS site_id, d.text FROM documents d JOIN sites s ON s.site_id = d.doc_id WHERE s.category IS NULL),
judged AS ({_rule_sql('site_id', 'contents')})
SELECT s.site_id, CASE WHEN j.confidence >= 0.7 THEN j.category ELSE s.category END AS category,
  coalesce(NOT j.confidence >= 0.7, false) AS requires_review,
  j.category AS judged_category, round(CAST(j.confidence AS DOUBLE), 6) AS confidence
FROM sites s LEFT JOIN judged j ON j.site_id = s.site_id""",
)
def classification(fx: Fixture):
    contents = spread_small(fx.documents.select(F.col("doc_id").alias("site_id"), "text"), "site_id")
    run = classify_run(fx.sites, contents, AS_OF_SITES, RULES)
    judged = run.classifications.select("site_id", F.col("category").alias("judged_category"), F.round("confidence", 6).alias("confidence"))
    return run.sites.select("site_id", "category", "requires_review").join(judged, "site_id", "left")


@query(
    "discovery_run",
    f"""
WITH RECURSIVE entries AS ({SEED_SQL}),
links AS (SELECT src_address AS src, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS dst, url FROM site_links),
reach AS (
  SELECT DISTINCT address AS node, 0 AS depth FROM entries WHERE ({ERROR_SQL}) IS NULL
  UNION
  SELECT l.dst, r.depth + 1 FROM reach r JOIN links l ON l.src = r.node WHERE r.depth < 2),
found AS (SELECT node AS address, min(depth) AS depth FROM reach GROUP BY node),
fresh AS (SELECT address, depth FROM found WHERE ({ERROR_SQL}) IS NULL AND address NOT IN (SELECT address FROM sites)),
pages AS (
  SELECT address, depth, concat('http://', address, '/') AS url FROM fresh
  UNION
  SELECT f.address, f.depth, l.url FROM fresh f JOIN links l ON l.dst = f.address),
ranked AS (SELECT address, depth, url, row_number() OVER (PARTITION BY address ORDER BY depth, url <> concat('http://', address, '/'), url) AS rn FROM pages),
made AS (SELECT address, depth, CAST('0x' || substr(sha256(address), 1, 15) AS BIGINT) AS site_id FROM fresh)
SELECT 'job' AS kind, url AS item, CAST(-r.depth AS VARCHAR) AS detail, m.site_id FROM ranked r JOIN made m ON m.address = r.address WHERE rn <= 50
UNION ALL SELECT 'result', address, CASE WHEN depth = 0 THEN 'seed' ELSE 'crawl' END, site_id FROM made
UNION ALL SELECT 'site', address, 'discovered', site_id FROM made
UNION ALL SELECT 'rejected', address, error, NULL FROM (
  SELECT address, {ERROR_SQL} AS error FROM entries UNION SELECT address, {ERROR_SQL} FROM found) x WHERE error IS NOT NULL""",
)
def discovery(fx: Fixture):
    """New sites, and their results and jobs joined to them by their ids."""
    # the catalog as a stored table: its addresses are computed once, by all tasks, though customers may be one small file
    dealt = Fixture(fx.spark, fx.folder, {"customer": fx.customer.repartition("c_custkey")})
    fx = Fixture(fx.spark, fx.folder, {"sites": materialize(dealt.sites, "sites")})
    run = discovery_run(fx.seed_lines, fx.site_links, fx.sites, AS_OF_EVENTS)
    known = materialize(run.sites.join(fx.sites.select("address"), "address", "left_anti"), "new-sites")
    owner = known.select("site_id", "address")
    parts = {
        "job": run.crawl_jobs.join(owner, "site_id").select(F.col("url").alias("item"), F.col("priority").cast("string").alias("detail"), "site_id"),
        "result": run.discovery_results.join(owner, "site_id").select(F.col("address").alias("item"), F.col("discovery_method").alias("detail"), "site_id"),
        "site": known.select(F.col("address").alias("item"), F.col("status").alias("detail"), "site_id"),
        "rejected": run.rejected.select(F.col("address").alias("item"), F.col("error").alias("detail"), F.lit(None).cast("bigint").alias("site_id")),
    }
    stacked = None
    for kind, frame in parts.items():
        part = frame.select(F.lit(kind).alias("kind"), "item", "detail", "site_id")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


@query(
    "exact_dups",
    """
SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def exact_dups(fx: Fixture):
    return dedup.exact_dups(fx.documents)


@query(
    "exact_dup_members",
    """
SELECT d.doc_id, g.first_id FROM documents d
JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1) g ON g.text = d.text""",
)
def exact_dup_members(fx: Fixture):
    return dedup.exact_dup_members(fx.documents)


_SQL_BITS = " + ".join(
    f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN CAST({1 << i} AS BIGINT) ELSE 0 END" for i in range(dedup.BITS)
)
SIMHASH = f"""
  SELECT doc_id, CAST({_SQL_BITS} AS BIGINT) AS simhash
  FROM (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) AS h
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) w) t
  GROUP BY doc_id"""


@query("text_simhash", f"WITH s AS ({SIMHASH}) SELECT doc_id, simhash FROM s")
def text_simhash(fx: Fixture):
    return dedup.text_simhash(fx.documents)


@query(
    "near_dups",
    f"""
WITH s AS ({SIMHASH}), g AS (SELECT simhash, min(doc_id) AS rep, count(*) AS n FROM s GROUP BY simhash)
SELECT a.rep AS rep_a, b.rep AS rep_b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INT) AS distance, a.n AS n_a, b.n AS n_b
FROM g a JOIN g b ON a.rep < b.rep AND bit_count(xor(a.simhash, b.simhash)) <= 3""",
)
def near_dups(fx: Fixture):
    groups = materialize(dedup.simhash_groups(dedup.text_simhash(fx.documents)), "simhash")
    return dedup.near_dups(groups)


@query(
    "near_dup_members",
    f"""
WITH s AS ({SIMHASH}), g AS (SELECT simhash, min(doc_id) AS rep FROM s GROUP BY simhash)
SELECT s.doc_id, g.rep FROM s JOIN g ON g.simhash = s.simhash""",
)
def near_dup_members(fx: Fixture):
    hashes = materialize(dedup.text_simhash(fx.documents), "simhash")
    return dedup.near_dup_members(hashes, dedup.simhash_groups(hashes))


@query(
    "hash_upsert",
    """
SELECT site_id, hash_type, id, hash_value, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, hash_type ORDER BY created_at DESC, id DESC) AS rn FROM (
    SELECT id, site_id, hash_type, hash_value, created_at FROM content_hashes
    UNION ALL
    SELECT id, site_id, 'document', raw_content_hash, discovered_at FROM discovery_results) x) r
WHERE rn = 1""",
)
def hash_upsert(fx: Fixture):
    columns = ("id", "site_id", "hash_type", "hash_value", "created_at")
    incoming = fx.discovery_results.select(
        "id", "site_id", F.lit("document").alias("hash_type"), F.col("raw_content_hash").alias("hash_value"),
        F.col("discovered_at").alias("created_at"),
    )
    return dedup.hash_upsert(fx.content_hashes.select(*columns), incoming)
