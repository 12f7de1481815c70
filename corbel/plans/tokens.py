"""Token queries: every twentieth token or alias as a request against all tokens of its system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import NAME_RULES, category_by_name
from ..functions.text import kebab, segments, words
from ..operators import tokens as ops
from ..sources.catalog import Workspace
from . import sql


def _values(ws: Workspace) -> DataFrame:
    return ws.tokens.where("token_id % 20 = 0 and value is not null").select(F.col("token_id").alias("query_id"), "system_id", F.col("value").alias("query"))


def _needs(ws: Workspace) -> DataFrame:
    said = F.concat_ws(" ", F.array_join(segments(F.col("name")), " "), "category", "description")
    return ws.tokens.where("token_id % 20 = 0").select(F.col("token_id").alias("query_id"), "system_id", said.alias("query"))


def resolved_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token's value by default and per theme, through var() chains."""
    return ops.resolved_values(Workspace(spark, sf_dir).tokens).select("token_id", "theme_pos", "theme", "value")


def nearest_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    return ops.nearest_colors(ws.tokens, _values(ws))


def nearest_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    return ops.nearest_lengths(ws.tokens, _values(ws))


def find_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and, for every other token, its needs in words as queries; two of three within the token's category."""
    ws = Workspace(spark, sf_dir)
    asked = ws.tokens.where("token_id % 20 = 0")
    said = F.concat_ws(" ", F.array_join(segments(F.col("name")), " "), "description")
    query = F.when(F.col("token_id") % 40 == 0, F.col("value")).otherwise(said)
    category = F.when(F.col("token_id") % 3 != 0, F.col("category"))
    return ops.find_tokens(ws.tokens, asked.select(F.col("token_id").alias("query_id"), "system_id", query.alias("query"), category.alias("category")).where("query is not null"))


def list_tokens_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As list_tokens, within the token's category."""
    ws = Workspace(spark, sf_dir)
    asked = ws.tokens.where("token_id % 20 = 0")
    return ops.listed_tokens(ws.tokens, asked.select(F.col("token_id").alias("query_id"), "system_id", F.array_join(F.slice(segments(F.col("name")), 2, 2), " ").alias("query"), "category"))


def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    return ops.tokens_by_words(ws.tokens, _needs(ws))


def list_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    return ops.listed_tokens(ws.tokens, ws.tokens.where("token_id % 20 = 0").select(F.col("token_id").alias("query_id"), "system_id", F.array_join(F.slice(segments(F.col("name")), 2, 2), " ").alias("query")))


def token_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category by name and value of every token, counted beside its given one."""
    df = Workspace(spark, sf_dir).tokens.select("category", category_by_name(F.col("name"), F.coalesce("value", F.lit(""))).alias("classified"))
    return df.groupBy("category", "classified").agg(F.count("*").alias("n"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, sf_dir).tokens.groupBy("system_id", "category").agg(F.count("*").alias("n"), F.count_if(F.col("css_var").isNull()).alias("n_without_css_var"))


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to write for each token, and its line in a listing."""
    write = F.when(F.col("css_var").isNotNull(), F.concat(F.lit("var("), "css_var", F.lit(")"))).otherwise(F.col("name"))
    themes = F.array_join(F.transform("values_by_theme", lambda v: F.concat(v["theme"], F.lit("="), v["value"])), ", ")
    line = F.concat(F.lit("- "), write, F.lit(": "), F.coalesce("value", F.lit("")), F.when(themes != "", F.concat(F.lit(" ("), themes, F.lit(")"))).otherwise(""))
    return Workspace(spark, sf_dir).tokens.select("token_id", write.alias("write"), line.alias("line"))


def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, words and kebab form of every token name."""
    c = F.col("name")
    return Workspace(spark, sf_dir).tokens.select("token_id", F.array_join(segments(c), " ").alias("parts"), F.array_join(words(F.col("description")), " ").alias("said"), kebab(c).alias("kebab"))


QUERIES = {f.__name__: f for f in (resolved_values, nearest_colors, nearest_lengths, find_tokens, token_words, list_tokens, list_tokens_of_category, token_categories, token_counts, token_lines, name_functions)}

_CH = "[0-9A-Za-z_-]"
_LINK = f"nullif(regexp_extract(trim(value), '^var\\((--{_CH}+)\\)$', 1), '')"


def _resolved() -> str:
    """CTEs up to rv(token_id, system_id, category, theme_pos, theme, value)."""
    out = f"""{sql.TOKENS}, ix AS (SELECT system_id AS s, css_var, min_by({{'token_id': token_id, 'value': value, 'vt': values_by_theme}}, {{'pos': pos, 'token_id': token_id}}) AS t FROM tk WHERE css_var IS NOT NULL GROUP BY ALL),
r0 AS (SELECT token_id, system_id, category, 0 AS theme_pos, NULL AS theme, value, token_id AS cur FROM tk UNION ALL
SELECT token_id, system_id, category, i, v.theme, v.value, token_id FROM (SELECT *, unnest(values_by_theme) AS v, unnest(range(1, len(values_by_theme) + 1)) AS i FROM tk))"""
    for k in range(5):
        out += f""", r{k + 1} AS (SELECT r.token_id, system_id, category, theme_pos, theme, CASE WHEN lk IS NULL THEN r.value WHEN t.token_id != cur THEN coalesce(list_filter(t.vt, lambda v: v.theme = r.theme)[1].value, t.value) END AS value, coalesce(t.token_id, cur) AS cur
FROM (SELECT *, {_LINK} AS lk FROM r{k}) r LEFT JOIN ix ON ix.s = r.system_id AND ix.css_var = lk)"""
    return out + f", rv AS (SELECT token_id, system_id, category, CAST(theme_pos AS INTEGER) AS theme_pos, theme, value FROM r5 WHERE value IS NOT NULL AND {_LINK} IS NULL)"


def _channel(c: str, i: int) -> str:
    hex6 = f"CAST('0x' || substr({c}, {2 * i}, 2) AS INTEGER)"
    hex3 = f"CAST('0x' || substr({c}, {i + 1}, 1) || substr({c}, {i + 1}, 1) AS INTEGER)"
    rgb = f"TRY_CAST(regexp_extract({c}, '(?i)^rgba?\\(\\s*(\\d+)\\s*,\\s*(\\d+)\\s*,\\s*(\\d+)\\s*(?:,\\s*[\\d.]+\\s*)?\\)$', {i}) AS INTEGER)"
    return f"CASE WHEN regexp_full_match({c}, '#[0-9a-fA-F]{{3}}') THEN {hex3} WHEN regexp_full_match({c}, '#([0-9a-fA-F]{{6}}|[0-9a-fA-F]{{8}})') THEN {hex6} ELSE {rgb} END"


_RGB = "{" + ", ".join(f"'{k}': {_channel('trim(value)', i)}" for i, k in ((1, "r"), (2, "g"), (3, "b"))) + "}"
_PX = "CASE WHEN regexp_full_match(trim(value), '(?i)-?\\d*\\.?\\d+(px|rem|)') THEN TRY_CAST(regexp_extract(trim(value), '^-?\\d*\\.?\\d+') AS DOUBLE) * CASE WHEN lower(trim(value)) LIKE '%rem' THEN 16 ELSE 1 END END"


def name_rule(category: str, names: str, pairs) -> str:
    tests = [f"list_has_any(s, {names.split()!r})"] if names else []
    tests += [f"contains(f, ' {a} {b} ')" for a, b in pairs]
    both = " AND NOT list_contains(s, 'color')" if category.endswith("*") else ""
    return f"WHEN ({' OR '.join(tests)}){both} THEN '{category.rstrip('*')}'"


_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY {}) AS rank"

ORACLES = {
    "resolved_values": f"WITH {_resolved()} SELECT token_id, theme_pos, theme, value FROM rv",
    "nearest_colors": f"""WITH {_resolved()}, cl AS (SELECT token_id, system_id, category, theme_pos, theme, {_RGB} AS c FROM rv), q AS (SELECT token_id AS query_id, system_id, {_RGB} AS w FROM tk WHERE token_id % 20 = 0),
d AS (SELECT query_id, cl.token_id, sqrt((c.r - w.r) ** 2 + (c.g - w.g) ** 2 + (c.b - w.b) ** 2) AS distance, theme_pos, theme FROM q JOIN cl USING (system_id) WHERE category = 'color' AND c.r IS NOT NULL AND w.r IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, token_id ORDER BY distance, theme_pos) AS k FROM d),
z AS (SELECT b.*, {_TOP.format('distance, pos, b.token_id')} FROM b JOIN tk ON tk.token_id = b.token_id WHERE k = 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, token_id, round(distance, 6) AS distance, theme FROM z WHERE rank <= 6""",
    "nearest_lengths": f"""WITH {_resolved()}, px AS (SELECT token_id, system_id, {_PX} AS p FROM rv WHERE theme_pos = 0 AND category IN ('space', 'size', 'radius')), q AS (SELECT token_id AS query_id, system_id, {_PX} AS w FROM tk WHERE token_id % 20 = 0),
z AS (SELECT query_id, px.token_id, abs(p - w) AS distance, {_TOP.format('abs(p - w), pos, px.token_id')} FROM q JOIN px USING (system_id) JOIN tk ON tk.token_id = px.token_id WHERE p IS NOT NULL AND w IS NOT NULL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, token_id, round(distance, 6) AS distance FROM z WHERE rank <= 6""",
    "token_words": f"""WITH {sql.TOKENS}, q AS (SELECT DISTINCT token_id AS query_id, system_id, unnest({sql.words("concat_ws(' ', array_to_string(" + sql.segments('name') + ", ' '), category, description)")}) AS word FROM tk WHERE token_id % 20 = 0),
p AS (SELECT token_id, system_id, unnest({sql.segments('name')}) AS word, 'name' AS kind FROM tk UNION ALL SELECT token_id, system_id, category, 'category' FROM tk UNION ALL SELECT token_id, system_id, unnest(list_distinct({sql.words('description')})), 'description' FROM tk),
s AS (SELECT query_id, token_id, CAST(sum(CASE kind WHEN 'name' THEN 30 WHEN 'category' THEN 15 ELSE 0 END) + max(CASE kind WHEN 'description' THEN 10 ELSE 0 END) AS INTEGER) AS score FROM q JOIN p USING (system_id, word) GROUP BY ALL),
z AS (SELECT s.*, {_TOP.format('score DESC, pos, s.token_id')} FROM s JOIN tk ON tk.token_id = s.token_id) SELECT query_id, CAST(rank AS INTEGER) AS rank, token_id, score FROM z WHERE rank <= 6""",
    "list_tokens": f"""WITH {sql.TOKENS}, q AS (SELECT DISTINCT token_id AS query_id, system_id, unnest({sql.words("array_to_string(" + sql.segments('name') + "[2:3], ' ')")}) AS word FROM tk WHERE token_id % 20 = 0),
k AS (SELECT token_id, system_id, unnest(list_distinct({sql.segments('name')} || {sql.words('description')})) AS word FROM tk),
m AS (SELECT DISTINCT query_id, token_id FROM q JOIN k USING (system_id, word)),
z AS (SELECT query_id, m.token_id, name, {_TOP.format("array_to_string(list_transform(regexp_extract_all(lower(name), '\\d+|\\D+'), lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN lpad(x, 10, '0') ELSE x END), ''), name, m.token_id")} FROM m JOIN tk ON tk.token_id = m.token_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, token_id, name FROM z WHERE rank <= 40""",
    "token_categories": f"""WITH {sql.TOKENS}, a AS (SELECT category, coalesce(value, '') AS value, {sql.segments("regexp_replace(name, '^--', '')")} AS s FROM tk), b AS (SELECT *, ' ' || array_to_string(s, ' ') || ' ' AS f FROM a)
SELECT category, CASE {' '.join(name_rule(*r) for r in NAME_RULES)} WHEN regexp_matches(lower(trim(value)), '^(#[0-9a-f]{{3,8}}$|(rgb|rgba|hsl|hsla|oklch|oklab)\\(|(black|white|transparent|currentcolor)$)') THEN 'color' ELSE 'other' END AS classified, count(*) AS n FROM b GROUP BY ALL""",
    "token_counts": f"WITH {sql.TOKENS} SELECT system_id, category, count(*) AS n, count(*) FILTER (css_var IS NULL) AS n_without_css_var FROM tk GROUP BY ALL",
    "token_lines": f"""WITH {sql.TOKENS}, a AS (SELECT token_id, CASE WHEN css_var IS NOT NULL THEN 'var(' || css_var || ')' ELSE name END AS write, coalesce(value, '') AS v, array_to_string(list_transform(values_by_theme, lambda x: x.theme || '=' || x.value), ', ') AS t FROM tk)
SELECT token_id, write, '- ' || write || ': ' || v || CASE WHEN t != '' THEN ' (' || t || ')' ELSE '' END AS line FROM a""",
    "name_functions": f"""WITH {sql.TOKENS} SELECT token_id, array_to_string({sql.segments('name')}, ' ') AS parts, array_to_string({sql.words('description')}, ' ') AS said, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab FROM tk""",
}
_FIND = f"""q AS (SELECT token_id AS query_id, system_id, value, CASE WHEN token_id % 40 != 0 THEN concat_ws(' ', array_to_string({sql.segments('name')}, ' '), description) END AS said, CASE WHEN token_id % 3 != 0 THEN category END AS cat FROM tk WHERE token_id % 20 = 0),
qv AS (SELECT query_id, system_id, cat, {_RGB} AS w, {_PX} AS p, value FROM (SELECT * REPLACE (CASE WHEN said IS NULL THEN value ELSE said END AS value) FROM q) WHERE value IS NOT NULL)"""
ORACLES["find_tokens"] = f"""WITH {_resolved()}, {_FIND}, cl AS (SELECT token_id, system_id, theme_pos, theme, {_RGB} AS c FROM rv WHERE category = 'color'),
px AS (SELECT token_id, system_id, category, {_PX} AS v FROM rv WHERE theme_pos = 0 AND category IN ('space', 'size', 'radius')),
hits AS (SELECT query_id, cl.token_id, 'color' AS how, min(sqrt((c.r - w.r) ** 2 + (c.g - w.g) ** 2 + (c.b - w.b) ** 2)) AS score FROM qv JOIN cl USING (system_id) WHERE c.r IS NOT NULL AND w.r IS NOT NULL AND coalesce(cat, 'color') = 'color' GROUP BY ALL
UNION ALL SELECT query_id, px.token_id, 'length', abs(v - p) FROM qv JOIN px USING (system_id) WHERE w.r IS NULL AND v IS NOT NULL AND p IS NOT NULL AND coalesce(cat, category) = category
UNION ALL SELECT query_id, token_id, 'words', CAST(sum(CASE kind WHEN 'name' THEN 30 WHEN 'category' THEN 15 ELSE 0 END) + max(CASE kind WHEN 'description' THEN 10 ELSE 0 END) AS DOUBLE)
FROM (SELECT DISTINCT query_id, system_id, cat, unnest({sql.words('value')}) AS word FROM qv WHERE w.r IS NULL AND p IS NULL) JOIN
(SELECT token_id, system_id, category, unnest({sql.segments('name')}) AS word, 'name' AS kind FROM tk UNION ALL SELECT token_id, system_id, category, category, 'category' FROM tk UNION ALL SELECT token_id, system_id, category, unnest(list_distinct({sql.words('description')})), 'description' FROM tk) USING (system_id, word)
WHERE coalesce(cat, category) = category GROUP BY query_id, token_id),
z AS (SELECT hits.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE how WHEN 'words' THEN -score ELSE score END, pos, hits.token_id) AS rank FROM hits JOIN tk ON tk.token_id = hits.token_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, token_id, how, round(score, 6) AS score FROM z WHERE rank <= 6"""
ORACLES["list_tokens_of_category"] = ORACLES["list_tokens"].replace("SELECT DISTINCT token_id AS query_id, system_id,", "SELECT DISTINCT token_id AS query_id, system_id, category,").replace("SELECT token_id, system_id, unnest(list_distinct(", "SELECT token_id, system_id, category, unnest(list_distinct(").replace("USING (system_id, word)", "USING (system_id, category, word)")
