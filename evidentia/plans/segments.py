"""Registered queries of JSON leaves and evidence segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as G
from .catalog import query


def _events_json(t):
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    return t("events").select(F.concat(F.lit("e"), number).alias("artifact_id"), F.concat(F.lit('{"type": "'), kind, F.lit('", "props": '), F.coalesce("props", F.lit("null")), F.lit(', "a/b": ["x~y", {"m~n": "'), kind, F.lit('", "": "", "t": true}], "when": [[["'), number, F.lit('"], []], null]}')).alias("json"))


_EVENTS = """e AS (SELECT 'e' || event_id AS artifact_id, unnest(['/type', '/a~1b/0', '/a~1b/1/m~0n', '/when/0/0/0']) AS pointer, unnest([event_type, 'x~y', event_type, event_id::VARCHAR]) AS text FROM events)"""


@query(rf"""WITH {_EVENTS}, d AS (SELECT 'd' || doc_id AS artifact_id, unnest(['/te~1xt', '/tags/0', '/tags/1', '/m/~0k/deep/0/0', '/m//deep/0/0']) AS pointer, unnest([text, lang, source, source, lang]) AS text FROM documents)
SELECT artifact_id, pointer, text, false AS unread FROM (FROM e UNION ALL FROM d) WHERE text <> ''""")
def json_leaf_pointers(t):
    deep = lambda c: F.struct(F.array(F.array(c)).alias("deep"))
    body = F.struct(F.col("text").alias("te/xt"), F.array("lang", "source").alias("tags"), F.create_map(F.lit("~k"), deep("source"), F.lit(""), deep("lang")).alias("m"))
    d = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("artifact_id"), F.to_json(body).alias("json"))
    return G.json_leaves(_events_json(t).unionByName(d))


_KIND = r"CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(lower(text), '\b(example|illustration|for instance)\b') THEN 'example' WHEN regexp_matches(lower(text), '\b(formula|multiplied by|times)\b|=') THEN 'formula' ELSE 'provision' END"


@query(rf"""WITH {_EVENTS}, d AS (
  SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN E'\nThe value = x times y. Example : ' || lang ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN E'\r\n\r \t\nIllustration: none' ELSE '' END AS text FROM documents),
raw AS (SELECT doc_id, unnest(l) AS raw, unnest(generate_series(1, len(l))) AS line FROM (SELECT doc_id, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n|$)') AS l FROM d)),
lines AS (SELECT 'd' || doc_id AS artifact_id, line, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pl, rtrim(raw, E'\r\n') AS text FROM raw),
cells AS (SELECT conv_id, turn, unnest([1, 2, 3]) AS col, unnest([role, text, '']) AS text FROM conversations),
book AS (SELECT 'd' || doc_id AS artifact_id, 'sheet=Tab%20' || replace(source, '/', '%2F') || '%3A(!):cell=A' || (doc_id + 1) || ':' AS pl, 'Tab ' || source || ':(!)!A' || (doc_id + 1) || '-' AS id, CASE WHEN doc_id % 3 = 0 THEN '=B' || (doc_id + 1) END AS formula, CASE WHEN doc_id % 4 > 0 THEN lang END AS stored FROM documents),
s AS (
  SELECT artifact_id, 'lines' AS source, 'text:line=' || line || ':offset=' || pl AS locator, 'text-line-' || line AS provision_id, text, {_KIND} AS kind FROM lines WHERE regexp_matches(text, '[^ \t\x0B\f]')
  UNION ALL SELECT artifact_id, 'json', pointer, pointer, text, {_KIND} FROM e WHERE text <> ''
  UNION ALL SELECT 'c' || conv_id, 'delimited', 'row=' || (turn + 1) || ':column=' || col, 'row-' || (turn + 1) || '-column-' || col, text, {_KIND} FROM cells WHERE text <> ''
  UNION ALL SELECT artifact_id, 'workbook', pl || 'formula', id || 'formula', formula, 'formula' FROM book WHERE formula <> ''
  UNION ALL SELECT artifact_id, 'workbook', pl || 'stored-value', id || 'stored-value', stored, CASE WHEN formula IS NULL THEN {_KIND.replace("text", "stored")} ELSE 'example' END FROM book WHERE stored <> ''
  UNION ALL SELECT 'p' || page_id, 'page', 'pdf:page=' || (page_id % 5) || ':offset=' || length(url) || ':endOffset=' || (length(url) + length(html)), 'pdf-page-' || (page_id % 5) || '-offset-' || length(url), html, {_KIND.replace("text", "html")} FROM pages WHERE page_id % 5 > 0 AND page_id % 11 > 0 AND html <> ''
), x AS (SELECT *, regexp_extract(text, '(?is)^(.*?)\b(?:example|illustration)\s*:', 1) AS f FROM s),
y AS (SELECT *, length(f) > 0 AND regexp_matches(f, '(?i)\bformula\b|=|\bmultiplied by\b|\btimes\b') AS pair FROM x)
SELECT artifact_id, source, locator, provision_id, text, kind FROM y WHERE NOT pair
UNION ALL SELECT artifact_id, source, locator || ':formula-offset=0', provision_id || '-formula', f, 'formula' FROM y WHERE pair
UNION ALL SELECT artifact_id, source, locator || ':example-offset=' || length(f), provision_id || '-example', substr(text, length(f) + 1), 'example' FROM y WHERE pair""")
def segment_evidence(t):
    d, k = t("documents"), F.col("doc_id")
    name = F.concat(F.lit("d"), k.cast("string")).alias("artifact_id")
    text = F.concat("text", F.when(k % 5 == 0, F.concat(F.lit("\nThe value = x times y. Example : "), "lang")).otherwise(""), F.when(k % 7 == 0, "\r\n\r \t\nIllustration: none").otherwise(""))
    lines = d.select(name, text.alias("text"))
    row = (k + 1).cast("string")
    book = d.select(name, F.concat(F.lit("Tab "), "source", F.lit(":(!)")).alias("sheet"), F.concat(F.lit("A"), row).alias("address"), F.when(k % 3 == 0, F.concat(F.lit("=B"), row)).alias("formula"), F.when(k % 4 > 0, F.col("lang")).alias("stored"))
    cells = t("conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("artifact_id"), F.col("turn").alias("row"), F.posexplode(F.array("role", "text", F.lit(""))).alias("col", "value"))
    start, page = F.length("url"), F.col("page_id")
    spans = t("pages").select(F.concat(F.lit("p"), page.cast("string")).alias("artifact_id"), (page % 5).alias("page"), start.alias("start"), (start + F.length("html") + F.when(page % 11 == 0, 1).otherwise(0)).alias("end"), F.col("html").alias("text"))
    return G.segment_evidence(lines=lines, json=_events_json(t), delimited=cells, workbook=book, pages=spans)
