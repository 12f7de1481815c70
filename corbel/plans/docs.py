"""Documentation queries: sections, mentions, patterns, changelogs, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.freshness import fingerprints, freshness
from ..operators.migration import migrations
from ..session import table
from ..sources import markdown
from ..sources.catalog import Workspace
from . import sql

STAMPED = "2025-10-01"


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of all documents; the document's number stands for its file name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("title"), "text")
    rows = markdown.chunked(docs)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "pos", "heading", F.array_join("trail", " > ").alias("trail"), F.length("text").alias("n"), "cut")


def chunk_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of its system that each documentation chunk mentions in its text."""
    ws = Workspace(spark, sf_dir)
    texts = ws.chunks.select(F.col("chunk_id").alias("id"), "system_id", F.concat_ws("\n", "heading", "text").alias("text"))
    return markdown.mentions(texts, ws.symbols).select(F.col("id").alias("chunk_id"), "name")


def document_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.patterns(table(spark, sf_dir, "documents").where("text is not null"))


def changelog_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_kind = 'changelog' and system_id is not null and text is not null")
    return markdown.changelog_mentions(docs, Workspace(spark, sf_dir).symbols)


def get_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol, and every prop of an export as `Component.prop`, with what became of it."""
    ws = Workspace(spark, sf_dir)
    rows = ws.exports.select("module_id", "epos", "system_id", "display_name", F.posexplode("props").alias("i", "p")).where("p.name is not null")
    props = rows.select(F.concat_ws("/", F.lit("p"), "module_id", "epos", "i").alias("query_id"), "system_id", F.concat_ws(".", "display_name", "p.name").alias("name"))
    symbols = ws.symbols.select(F.concat(F.lit("s/"), "symbol_id").alias("query_id"), "system_id", "name")
    docs = table(spark, sf_dir, "documents").where("doc_kind = 'changelog' and system_id is not null and text is not null")
    return migrations(ws, symbols.unionByName(props), docs)


def pattern_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exports and tags that the first code block of each document uses."""
    ws = Workspace(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").where("text is not null and system_id is not null")
    read = markdown.patterns(docs).join(docs.select("doc_id", "system_id"), "doc_id")
    names = ws.exports.select("system_id", F.explode(F.array("display_name", "tag_name")).alias("name"))
    return markdown.pattern_components(read, names).select("doc_id", "components")


def _facets(ws: Workspace, until: str | None) -> DataFrame:
    """Fingerprints of catalog, tokens and docs per system, of the rows of before a day or of all."""
    out = None
    for facet, name, key, time, parts in (
        ("catalog", "catalog_modules", "module_id", "generated_at", ["module_id", "dir", "pos"]),
        ("docs", "doc_chunks", "chunk_id", "indexed_at", ["path", "heading", "text"]),
        ("tokens", "tokens", "token_id", "added_at", ["name", "css_var", "value"]),
    ):
        rows = ws.raw(name, key)
        rows = rows.where(F.col(time) < F.lit(until).cast("timestamp_ntz")) if until else rows
        prints = fingerprints(rows.where("system_id is not null").withColumn("facet", F.lit(facet)), ["system_id", "facet"], *map(F.col, parts))
        out = prints if out is None else out.unionByName(prints)
    return out


def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facets(Workspace(spark, sf_dir), None)


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each system's sources are still as stamped on a given day."""
    ws = Workspace(spark, sf_dir)
    return freshness(_facets(ws, STAMPED), _facets(ws, None), ["system_id", "facet"])


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each manifest's text, the stamp of a single-file source."""
    return Workspace(spark, sf_dir).raw("custom_elements", "record_id").select("record_id", F.sha2("manifest", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (markdown_sections, chunk_mentions, document_patterns, changelog_mentions, get_migration, pattern_components, source_fingerprints, source_freshness, content_hashes)}

_NAMES = "flatten(list_transform(list_distinct(regexp_extract_all({0}, '[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*')), lambda r: flatten(list_transform(range(1, len(string_split(r, '-')) + 1), lambda i: list_transform(range(i, len(string_split(r, '-')) + 1), lambda j: array_to_string(string_split(r, '-')[i:j], '-'))))))"
_LINES = "unnest(string_split({0}, chr(10))) AS t, unnest(range(len(string_split({0}, chr(10))))) AS n"
_H = "CAST(CAST('0x' || substr(md5(concat_ws(chr(10), {0})), 1, 15) AS BIGINT) AS HUGEINT)"


def _prints(where: str) -> str:
    part = lambda *cols: _H.format(", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in cols))
    return f"""SELECT system_id, facet, count(*) AS n, CAST(sum(h) AS VARCHAR) AS fingerprint FROM (
SELECT system_id, 'catalog' AS facet, {part('module_id', 'dir', 'pos')} AS h FROM (SELECT DISTINCT ON (module_id) * FROM catalog_modules) WHERE {where.format('generated_at')}
UNION ALL SELECT system_id, 'docs', {part('path', 'heading', 'text')} FROM (SELECT DISTINCT ON (chunk_id) * FROM doc_chunks) WHERE {where.format('indexed_at')}
UNION ALL SELECT system_id, 'tokens', {part('name', 'css_var', 'value')} FROM (SELECT DISTINCT ON (token_id) * FROM tokens) WHERE {where.format('added_at')}) WHERE system_id IS NOT NULL GROUP BY ALL"""


ORACLES = {
    "markdown_sections": f"""WITH l0 AS (SELECT doc_id, {_LINES.format("replace(text, chr(13) || chr(10), chr(10))")} FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT *, regexp_matches(t, '^\\s*(`{{3,}}|~{{3,}})') AS f FROM l0),
l2 AS (SELECT *, sum(f::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS inside FROM l1),
l3 AS (SELECT *, CASE WHEN NOT f AND NOT inside AND regexp_matches(t, '^#{{1,6}}\\s+.*$') THEN len(regexp_extract(t, '^(#{{1,6}})', 1)) END AS lv FROM l2),
l4 AS (SELECT *, count(lv) OVER (PARTITION BY doc_id ORDER BY n) AS s, CASE WHEN lv IS NOT NULL THEN trim(regexp_extract(t, '^#{{1,6}}\\s+(.*?)\\s*#*\\s*$', 1)) END AS h FROM l3),
b AS (SELECT doc_id, s, regexp_replace(coalesce(string_agg(t, chr(10) ORDER BY n) FILTER (lv IS NULL), ''), '^{sql.SPACE}+|{sql.SPACE}+$', '', 'g') AS body, max(lv) AS lv, max(h) AS h FROM l4 GROUP BY ALL),
h1 AS (SELECT doc_id, min_by(h, s) AS h1 FROM b WHERE lv = 1 GROUP BY ALL),
up AS (SELECT b.doc_id, b.s, string_agg(a.h, ' > ' ORDER BY a.s) AS up FROM b JOIN b a ON a.doc_id = b.doc_id AND a.s < b.s AND a.lv < b.lv AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.s > a.s AND c.s < b.s AND c.lv <= a.lv) GROUP BY ALL),
z AS (SELECT b.doc_id, b.s, coalesce(b.h, h1, 'doc-' || b.doc_id) AS heading, coalesce(up || ' > ', '') || coalesce(b.h, h1, 'doc-' || b.doc_id) AS trail, body FROM b LEFT JOIN h1 USING (doc_id) LEFT JOIN up ON up.doc_id = b.doc_id AND up.s = b.s WHERE b.s > 0 OR body != '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS pos, heading, trail, CAST(least(1200, length(body)) AS INTEGER) AS n, length(body) > 1200 AS cut FROM z""",
    "chunk_mentions": f"""WITH {sql.CHUNKS}, {sql.SYMBOLS}, c AS (SELECT DISTINCT chunk_id, system_id, unnest({_NAMES.format("concat_ws(chr(10), heading, text)")}) AS name FROM ch)
SELECT chunk_id, name FROM c JOIN (SELECT DISTINCT system_id, name FROM sy) USING (system_id, name)""",
    "document_patterns": f"""WITH l0 AS (SELECT doc_id, {_LINES.format("replace(text, chr(13) || chr(10), chr(10))")} FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT *, sum(regexp_matches(t, '^\\s*(`{{3,}}|~{{3,}})')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS k, regexp_matches(t, '^\\s*(`{{3,}}|~{{3,}})') AS f FROM l0),
l2 AS (SELECT doc_id, n, t, regexp_matches(t, '^#{{1,6}}\\s+') OR trim(t) = '' AS stop FROM l1 WHERE NOT f AND k % 2 = 0),
l3 AS (SELECT *, min(n) FILTER (NOT stop) OVER (PARTITION BY doc_id) AS a FROM l2), l4 AS (SELECT *, min(n) FILTER (stop AND n > a) OVER (PARTITION BY doc_id) AS z FROM l3),
p AS (SELECT doc_id, string_agg(trim(t), ' ' ORDER BY n) AS description FROM l4 WHERE n >= a AND (z IS NULL OR n < z) GROUP BY ALL), d AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS x FROM documents WHERE text IS NOT NULL)
SELECT d.doc_id, nullif(regexp_extract(x, '(?m)^#\\s+(.+?)\\s*$', 1), '') AS title, nullif(description, '') AS description, nullif(trim(regexp_extract(x, '```([^\\n`]*)\\n([\\s\\S]*?)```', 1)), '') AS language, nullif(regexp_replace(regexp_extract(x, '```([^\\n`]*)\\n([\\s\\S]*?)```', 2), '\\n$', ''), '') AS code FROM d LEFT JOIN p USING (doc_id)""",
    "changelog_mentions": f"""WITH {sql.SYMBOLS}, l0 AS (SELECT doc_id, system_id, {_LINES.format("replace(text, chr(13) || chr(10), chr(10))")} FROM documents WHERE doc_kind = 'changelog' AND system_id IS NOT NULL AND text IS NOT NULL),
l1 AS (SELECT *, CASE WHEN regexp_matches(t, '^#{{2,3}}\\s+') THEN regexp_extract(t, '^#{{2,3}}\\s+(.*?)\\s*#*\\s*$', 1) END AS h FROM l0),
l2 AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS heading FROM l1),
c AS (SELECT DISTINCT doc_id, system_id, n, t, heading, unnest({_NAMES.format('t')}) AS name FROM l2 WHERE h IS NULL),
r AS (SELECT system_id, name, doc_id, n, t, heading, row_number() OVER (PARTITION BY system_id, name ORDER BY doc_id, n) AS rank FROM c JOIN (SELECT DISTINCT system_id, name FROM sy) USING (system_id, name))
SELECT system_id, name, CAST(rank AS INTEGER) AS rank, doc_id, CAST(n + 1 AS INTEGER) AS line, coalesce(heading, '') AS heading, trim(t) AS text FROM r WHERE rank <= 8""",
    "source_fingerprints": _prints("true"),
    "source_freshness": f"""WITH o AS ({_prints("{} < TIMESTAMP '" + STAMPED + "'")}), n AS ({_prints('true')})
SELECT system_id, facet, CASE WHEN o.fingerprint IS NULL THEN 'none' WHEN n.fingerprint IS NULL THEN 'unknown' WHEN o.fingerprint = n.fingerprint THEN 'fresh' ELSE 'stale' END AS status FROM o FULL JOIN n USING (system_id, facet)""",
    "content_hashes": "SELECT DISTINCT ON (record_id) record_id, sha256(manifest) AS digest FROM custom_elements",
}
ORACLES["get_migration"] = f"""WITH {sql.EXPORTS}, {sql.SYMBOLS}, {sql.NAMES}, rq AS (SELECT 's/' || symbol_id AS query_id, system_id, name AS component, NULL AS prop FROM sy
UNION ALL SELECT 'p/' || module_id || '/' || epos || '/' || i, system_id, display_name, p.name FROM (SELECT *, unnest(props) AS p, unnest(range(len(props))) AS i FROM ex) WHERE p.name IS NOT NULL),
fd AS (SELECT q.*, xk.display_name AS found, xk.deprecated, coalesce(list_filter(xk.props, lambda p: p.name = q.prop)[1], list_filter(xk.props, lambda p: lower(p.name) = lower(q.prop))[1]).deprecated AS pd FROM ({sql.loosely('rq', 'component')}) q JOIN xk ON xk.x = q.x),
tm AS (SELECT DISTINCT query_id, system_id, unnest([component, prop]) AS name FROM rq),
{{changes}},
hit AS (SELECT DISTINCT query_id, doc_id, n, t, heading FROM tm JOIN c USING (system_id, name)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, n) AS rank FROM hit),
ls AS (SELECT query_id, string_agg(coalesce(heading || ': ', '') || trim(t) || ' (' || (n + 1) || ')', chr(10) ORDER BY rank) AS lines FROM r WHERE rank <= 8 GROUP BY ALL)
SELECT rq.query_id, CASE WHEN pd != '' OR deprecated IS NOT NULL THEN 'deprecated' WHEN lines IS NOT NULL THEN 'mentioned' WHEN found IS NULL THEN 'missing' ELSE 'none' END AS status, coalesce(found, rq.component) AS name, rq.prop,
CASE WHEN coalesce(pd, '') = '' THEN deprecated.since END AS since, CASE WHEN coalesce(pd, '') = '' THEN deprecated.replacement END AS replacement, CASE WHEN coalesce(pd, '') = '' THEN deprecated.note ELSE pd END AS note, coalesce(lines, '') AS lines
FROM rq LEFT JOIN fd USING (query_id) LEFT JOIN ls USING (query_id)""".replace("{changes}", ORACLES["changelog_mentions"].partition("l0 AS")[1] + ORACLES["changelog_mentions"].partition("l0 AS")[2].partition("\nr AS")[0].rstrip(","))
ORACLES["pattern_components"] = f"""WITH {sql.EXPORTS}, d AS (SELECT doc_id, system_id, regexp_extract(replace(text, chr(13) || chr(10), chr(10)), '```([^\\n`]*)\\n([\\s\\S]*?)```', 2) AS code FROM documents WHERE text IS NOT NULL AND system_id IS NOT NULL),
u AS (SELECT DISTINCT doc_id, system_id, unnest(regexp_extract_all(regexp_replace(code, '\\n$', ''), '</?([A-Za-z][A-Za-z0-9._-]*)[\\s/>]', 1)) AS name FROM d),
nm2 AS (SELECT DISTINCT system_id, unnest([display_name, tag_name]) AS name FROM ex)
SELECT doc_id, string_agg(name, ' ' ORDER BY name) AS components FROM u JOIN nm2 USING (system_id, name) GROUP BY doc_id"""
