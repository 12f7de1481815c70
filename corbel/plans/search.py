"""Ranked retrieval: every twentieth alias as a request against all rows of its system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import describe_match
from ..operators import search
from ..sources.catalog import Workspace
from . import sql


def _requests(ws: Workspace, query) -> DataFrame:
    asked = ws.aliases.where("alias_id % 20 = 0")
    return asked.select(F.col("alias_id").alias("query_id"), "system_id", query.alias("query"), F.col("target").alias("component")).where("query is not null")


def _need():
    return F.concat_ws(" ", "alias", "concept")


def search_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names with their concept as queries."""
    ws = Workspace(spark, sf_dir)
    return search.search_components(ws, _requests(ws, _need()))


def match_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of search_components with what their first reason says."""
    hits = search_components(spark, sf_dir)
    return hits.select("query_id", "rank", describe_match(F.substring_index("matched_on", " | ", 1)).alias("label"))


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names with their concept as topics, targets as the wanted component."""
    ws = Workspace(spark, sf_dir)
    return search.search_docs(ws, _requests(ws, _need()))


def search_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation chunks in the role of patterns: heading = title, trail = tags, mentions = components."""
    ws = Workspace(spark, sf_dir)
    patterns = ws.chunks.select(F.col("chunk_id").alias("pattern_id"), "system_id", F.col("heading").alias("title"), F.col("trail").alias("tags"), F.col("mentions").alias("components"), F.col("text").alias("description"))
    return search.search_patterns(patterns, _requests(ws, _need()))


def resolve_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names and, for every other request, the listed name itself."""
    ws = Workspace(spark, sf_dir)
    return search.resolve_components(ws, _requests(ws, F.when(F.col("alias_id") % 40 == 0, F.coalesce("target", "alias")).otherwise(F.col("alias"))))


def component_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    asked = ws.symbols.where("symbol_id % 20 = 0").select(F.col("symbol_id").alias("query_id"), "system_id", F.col("name").alias("query"))
    return search.component_details(ws, asked.where("query is not null"))


def all_component_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every symbol."""
    ws = Workspace(spark, sf_dir)
    asked = ws.symbols.select(F.col("symbol_id").alias("query_id"), "system_id", F.col("name").alias("query"))
    return search.component_details(ws, asked.where("query is not null"))


QUERIES = {f.__name__: f for f in (search_components, match_labels, search_docs, search_patterns, resolve_components, component_details, all_component_details)}

_RQ = "rq AS (SELECT alias_id AS query_id, system_id, concat_ws(' ', alias, concept) AS query, target AS component FROM al WHERE alias_id % 20 = 0)"
_RN = "rq AS (SELECT * FROM (SELECT alias_id AS query_id, system_id, CASE WHEN alias_id % 40 = 0 THEN coalesce(target, alias) ELSE alias END AS query FROM al WHERE alias_id % 20 = 0) WHERE query IS NOT NULL)"
_QW = f"qw AS (SELECT query_id, system_id, word, count(*) AS copies FROM (SELECT query_id, system_id, unnest({sql.words('query')}) AS word FROM rq) GROUP BY ALL)"
_QM = f"qm AS (SELECT query_id, system_id, word, count(*) AS copies FROM (SELECT query_id, system_id, unnest({sql.meaningful('ws')}) AS word FROM (SELECT *, {sql.words('query')} AS ws FROM rq)) GROUP BY ALL)"


def _components(rq: str) -> str:
    """CTEs up to ranked(query_id, dir, name, score, matched_on, rank) for the requests of rq."""
    return f"""rs AS (SELECT query_id, system_id, query FROM {rq} WHERE {sql.trim('query')} != ''),
sw AS (SELECT query_id, system_id, word, count(*) AS copies FROM (SELECT query_id, system_id, unnest({sql.words('query')}) AS word FROM rs) GROUP BY ALL),
tm AS (SELECT DISTINCT query_id, system_id, unnest(list_append({sql.words('query')}, lower({sql.trim('query')}))) AS term FROM rs),
ac AS (SELECT *, lower(alias) AS term FROM al WHERE kind = 'components' AND alias IS NOT NULL),
at1 AS (SELECT tm.query_id, tm.system_id, ac.alias, ac.target FROM tm JOIN ac USING (system_id, term) WHERE target IS NOT NULL),
at2 AS ({sql.loosely('at1', 'target')}),
cw AS (SELECT query_id, system_id, concept, unnest({sql.words('concept')}) AS word FROM (SELECT DISTINCT query_id, tm.system_id, concept FROM tm JOIN ac USING (system_id, term) WHERE target IS NULL AND concept IS NOT NULL)),
ew AS (SELECT system_id, x, word, list_contains(d, word) AS described FROM (SELECT system_id, x, d, unnest(list_distinct(d || n)) AS word FROM (SELECT system_id, x, {sql.words('description')} AS d, {sql.segments('display_name')} || {sql.segments('tag_name')} AS n FROM xk))),
pn AS (SELECT system_id, x, unnest(coalesce(list_transform(props, lambda p: p.name), CAST([] AS VARCHAR[])) || coalesce(inherited_props, CAST([] AS VARCHAR[]))) AS prop FROM xk),
cm AS (SELECT DISTINCT query_id, sw.system_id, unnest(mentions) AS mention FROM sw JOIN (SELECT system_id, mentions, unnest(list_distinct({sql.words("concat_ws(' ', heading, text)")})) AS word FROM ch) c ON c.system_id = sw.system_id AND c.word = sw.word),
cx AS ({sql.loosely('cm', 'mention')}),
hits AS (SELECT query_id, x, 100 AS score, 'name' AS reason, 1 AS step FROM tm JOIN xk ON xk.system_id = tm.system_id AND (lower(display_name) = term OR lower(tag_name) = term)
UNION ALL SELECT query_id, x, 80, 'alias:' || alias, 2 FROM at2
UNION ALL SELECT query_id, x, 60 + count(*), 'concept:' || concept, 3 FROM cw JOIN ew USING (system_id, word) GROUP BY query_id, x, concept
UNION ALL SELECT query_id, x, 40, 'prop:' || prop, 4 FROM sw JOIN pn ON pn.system_id = sw.system_id AND lower(prop) = word
UNION ALL SELECT query_id, x, 20 + sum(copies), 'description', 5 FROM sw JOIN ew USING (system_id, word) WHERE described GROUP BY query_id, x
UNION ALL SELECT query_id, x, 10, 'docs', 6 FROM cx),
en AS (SELECT query_id, x.dir AS dir, x.display_name AS name, reason, step, max(score) AS score FROM hits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, dir) AS rank FROM (SELECT query_id, dir, name, CAST(max(score) AS INTEGER) AS score, string_agg(reason, ' | ' ORDER BY step, reason) AS matched_on FROM en GROUP BY ALL))"""


_BASE = f"{sql.EXPORTS}, {sql.ALIASES}, {sql.CHUNKS}, {sql.NAMES}"

ORACLES = {
    "search_components": f"WITH {_BASE}, {_RQ}, {_components('rq')} SELECT query_id, CAST(rank AS INTEGER) AS rank, name, dir, score, matched_on FROM ranked WHERE rank <= 8",
    "search_docs": f"""WITH {sql.ALIASES}, {sql.CHUNKS}, {_RQ}, {_QM},
ix AS (SELECT chunk_id, system_id, word, list_contains(h, word) AS h, list_contains(t, word) AS t, list_contains(b, word) AS b FROM (SELECT chunk_id, system_id, h, t, b, unnest(list_distinct(h || t || b)) AS word
FROM (SELECT chunk_id, system_id, {sql.words('heading')} AS h, {sql.words("array_to_string(trail, ' ')")} AS t, {sql.words('text')} AS b FROM ch))),
mt AS (SELECT query_id, chunk_id, h, t, CASE WHEN b THEN copies ELSE 0 END AS n, false AS c FROM qm JOIN ix USING (system_id, word)
UNION ALL SELECT DISTINCT query_id, chunk_id, false, false, 0, true FROM rq JOIN (SELECT chunk_id, system_id, unnest(mentions) AS m FROM ch) c ON c.system_id = rq.system_id AND lower(c.m) = lower({sql.trim('component')}) WHERE {sql.trim('component')} != ''),
sc AS (SELECT query_id, chunk_id, CAST(CASE WHEN bool_or(h) THEN 100 ELSE 0 END + CASE WHEN bool_or(c) THEN 90 ELSE 0 END + CASE WHEN bool_or(t) THEN 50 ELSE 0 END + CASE WHEN sum(n) > 0 THEN 10 + sum(n) ELSE 0 END AS INTEGER) AS score FROM mt GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path NULLS FIRST, heading NULLS FIRST, chunk_id) AS rank FROM sc JOIN ch USING (chunk_id)) WHERE rank <= 5""",
    "search_patterns": f"""WITH {sql.ALIASES}, {sql.CHUNKS}, {_RQ}, {_QM},
it AS (SELECT chunk_id, system_id, 'title' AS kind, 0 AS item, {sql.words('heading')} AS ws FROM ch
UNION ALL SELECT chunk_id, system_id, 'tag', i, {sql.words('t')} FROM (SELECT chunk_id, system_id, unnest(trail) AS t, unnest(range(len(trail))) AS i FROM ch)
UNION ALL SELECT chunk_id, system_id, 'component', i, {sql.segments('t')} FROM (SELECT chunk_id, system_id, unnest(mentions) AS t, unnest(range(len(mentions))) AS i FROM ch)
UNION ALL SELECT chunk_id, system_id, 'description', 0, {sql.words('text')} FROM ch),
ix AS (SELECT chunk_id, system_id, kind, item, unnest(list_distinct(ws)) AS word FROM it),
mt AS (SELECT query_id, chunk_id, kind, item, sum(copies) AS n FROM qm JOIN ix USING (system_id, word) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, CAST(sum(CASE kind WHEN 'title' THEN 100 + n WHEN 'tag' THEN 60 WHEN 'component' THEN 50 + n ELSE 10 + n END) AS INTEGER) AS score FROM mt GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id AS pattern_id, score FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, heading NULLS FIRST, chunk_id) AS rank FROM sc JOIN ch USING (chunk_id)) WHERE rank <= 5""",
    "resolve_components": f"""WITH {_BASE}, {_RN}, fd AS ({sql.loosely('rq', 'query')}), lf AS (SELECT * FROM rq WHERE query_id NOT IN (SELECT query_id FROM fd)),
fa AS (SELECT system_id, lower(alias) AS term, min_by(target, {{'pos': pos, 'alias_id': alias_id}}) AS target FROM al WHERE kind = 'components' AND target IS NOT NULL AND alias IS NOT NULL GROUP BY ALL),
a1 AS (SELECT lf.query_id, lf.system_id, fa.target FROM lf JOIN fa ON fa.system_id = lf.system_id AND fa.term = lower({sql.trim('query')})), a2 AS ({sql.loosely('a1', 'target')}),
ms AS (SELECT * FROM lf WHERE query_id NOT IN (SELECT query_id FROM a2)), {_components('ms')}, nr AS (SELECT query_id, string_agg(name, ', ' ORDER BY rank) AS nearest FROM ranked WHERE rank <= 3 GROUP BY ALL)
SELECT rq.query_id, CASE WHEN fd.how IS NOT NULL THEN fd.how WHEN a2.x IS NOT NULL THEN 'alias' ELSE 'missing' END AS status, coalesce(fd.x.display_name, a2.x.display_name) AS name, CASE WHEN fd.how IS NULL AND a2.x IS NULL THEN coalesce(nearest, '') END AS nearest
FROM rq LEFT JOIN fd USING (query_id) LEFT JOIN a2 ON a2.query_id = rq.query_id LEFT JOIN nr ON nr.query_id = rq.query_id""",
    "component_details": f"""WITH {_BASE}, {sql.SYMBOLS}, rq AS (SELECT symbol_id AS query_id, system_id, name AS query FROM sy WHERE symbol_id % 20 = 0 AND name IS NOT NULL), fd AS ({sql.loosely('rq', 'query')}),
dt AS (SELECT query_id, fd.system_id, xk.display_name AS name, coalesce(len(props), 0) AS n_props, coalesce(len(events), 0) AS n_events, coalesce(len(slots), 0) AS n_slots,
list_distinct(coalesce(list_transform(props, lambda p: p.name), CAST([] AS VARCHAR[])) || coalesce(inherited_props, CAST([] AS VARCHAR[]))) AS known FROM fd JOIN xk ON xk.x = fd.x),
mk AS (SELECT query_id, string_agg(alias || ' -> ' || target, '; ' ORDER BY pos, alias_id) AS mistakes FROM (SELECT query_id, system_id, unnest(known) AS target FROM dt) k JOIN al USING (system_id, target) WHERE kind = 'props' AND source = 'team' AND alias IS NOT NULL GROUP BY ALL)
SELECT query_id, name, CAST(n_props AS INTEGER) AS n_props, CAST(n_events AS INTEGER) AS n_events, CAST(n_slots AS INTEGER) AS n_slots, coalesce(mistakes, '') AS mistakes FROM dt LEFT JOIN mk USING (query_id)""",
}
ORACLES["all_component_details"] = ORACLES["component_details"].replace("symbol_id % 20 = 0 AND ", "")
ORACLES["match_labels"] = f"""SELECT query_id, rank, CASE WHEN r = '' THEN 'match' WHEN r = 'name' THEN 'name match' WHEN r LIKE 'alias:%' THEN 'alias ' || r[7:] WHEN r LIKE 'concept:%' THEN 'concept' WHEN r LIKE 'prop:%' THEN 'prop ' || r[6:] ELSE r END AS label
FROM (SELECT query_id, rank, string_split(matched_on, ' | ')[1] AS r FROM ({ORACLES['search_components']}))"""
