"""Adapters and session state over the given tables, or over files Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import css_tokens, dtcg_tokens, globs
from ..sources.catalog import Workspace
from ..streaming import sessions
from . import sql
from .tokens import NAME_RULES, name_rule

# The DTCG type that stands for a category.
TYPES = {"color": "color", "space": "dimension", "size": "dimension", "radius": "dimension", "typography": "typography", "opacity": "number", "z-index": "number", "motion": "duration", "shadow": "shadow", "border": "border"}
INCLUDE = ["docs/{guides,howto}/**/*.md", "docs/reference/*popover*.md"]
EXCLUDE = ["**/button*.md", "docs/guides/??????-*.md"]


def css_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token written as a CSS file with its themes, and read back."""
    tokens = Workspace(spark, sf_dir).tokens.where("css_var is not null and (value is not null or size(values_by_theme) > 0)")
    rule = lambda selector, value: F.concat(F.lit(selector), F.lit(" { "), "css_var", F.lit(": "), value, F.lit("; }"))
    themed = F.array_join(F.transform("values_by_theme", lambda v: F.concat(F.lit('[data-theme="'), v["theme"], F.lit('"] { '), F.col("css_var"), F.lit(": "), v["value"], F.lit("; }"))), "\n")
    css = F.concat_ws("\n", F.lit('@import "base.css"; /* { tokens } */'), F.when(F.col("value").isNotNull(), rule(":root, html", F.col("value"))), F.concat(F.lit("@layer themes { "), themed, F.lit(" }")))
    read = css_tokens.css_tokens(tokens.select("system_id", F.col("token_id").alias("pos"), css.alias("css")))
    shown = F.array_join(F.array_sort(F.transform("themes", lambda v: F.concat(v["theme"], F.lit("="), v["value"]))), ", ")
    return read.select("system_id", "name", "value", shown.alias("themes"), "category", F.array_join("refs", " ").alias("refs"))


def dtcg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token written as a nested JSON file with an inherited type, and read back."""
    tokens = Workspace(spark, sf_dir).tokens.where("value is not null and name is not null")
    kind = F.coalesce(*[F.when(F.col("category") == c, t) for c, t in TYPES.items()], F.lit("other"))
    leaf = F.to_json(F.struct(F.col("value").alias("$value"), F.col("description").alias("$description")))
    quoted = lambda part: F.to_json(F.struct(part.alias("k")))
    key = lambda part: F.regexp_extract(quoted(part), r'^\{"k":(".*")\}$', 1)
    nested = F.aggregate(F.reverse(F.split("name", r"\.")), F.col("leaf"), lambda inner, part: F.concat(F.lit("{"), key(part), F.lit(":"), inner, F.lit("}")))
    text = F.concat(F.lit('{"$type":"'), "kind", F.lit('",'), F.substr("nested", F.lit(2)))
    files = tokens.select("system_id", "token_id", "name", leaf.alias("leaf"), kind.alias("kind")).withColumn("nested", nested)
    read = dtcg_tokens.dtcg_tokens(files.select("system_id", F.col("token_id").alias("pos"), F.lit(None).cast("string").alias("theme"), text.alias("json")))
    return read.select("system_id", "name", "value", "category", F.array_join("refs", " ").alias("refs"), "description")


def documentation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documentation files that some globs take, with their chunks."""
    df = Workspace(spark, sf_dir).chunks.where(globs.matches(F.col("path"), INCLUDE, EXCLUDE))
    return df.groupBy("path").agg(F.count("*").alias("n_chunks"))


def sessions_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events' users that end after 30 idle minutes."""
    return sessions.idle_sessions(table(spark, sf_dir, "events")).select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), "n")


def sessions_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, as far as its watermark has closed them."""
    df = sessions.streamed_sessions(spark, f"{sf_dir}/events.parquet")
    return df.select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), "n")


def sessions_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a bounded table lets go, idle or least recently seen."""
    ended = sessions.streamed_evictions(sessions.stream_of(spark, f"{sf_dir}/events.parquet"))
    return ended.groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (css_round_trip, dtcg_round_trip, documentation_paths, sessions_idle, sessions_streamed, sessions_lru)}

_SESSIONS = """e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT user_id, min(ts) AS b, max(ts) AS d, count(*) AS n FROM s GROUP BY user_id, k)"""
_SHOW = "SELECT user_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS began, strftime(d, '%Y-%m-%d %H:%M:%S') AS ended, n FROM g"


def _css_oracle() -> str:
    rules = " ".join(name_rule(*r) for r in NAME_RULES)
    return f"""WITH {sql.TOKENS}, a AS (SELECT system_id, css_var AS name, coalesce(value, list_filter(vt, lambda v: v.theme = 'light')[1].value, vt[1].value) AS value,
list_distinct(list_filter([CASE WHEN value IS NOT NULL THEN 'light=' || value END] || coalesce(list_transform(list_filter(vt, lambda v: v.theme != 'light' OR value IS NULL), lambda v: v.theme || '=' || v.value), CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL)) AS th FROM (SELECT *, list_filter(values_by_theme, lambda v: v.value IS NOT NULL) AS vt FROM tk) WHERE css_var IS NOT NULL AND (value IS NOT NULL OR len(values_by_theme) > 0)),
b AS (SELECT *, {sql.segments("regexp_replace(name, '^--', '')")} AS s FROM a), c AS (SELECT *, ' ' || array_to_string(s, ' ') || ' ' AS f FROM b)
SELECT system_id, name, value, CASE WHEN len(th) > 1 THEN array_to_string(list_sort(th), ', ') END AS themes, CASE {rules} WHEN regexp_matches(lower(trim(value)), '^(#[0-9a-f]{{3,8}}$|(rgb|rgba|hsl|hsla|oklch|oklab)\\(|(black|white|transparent|currentcolor)$)') THEN 'color' ELSE 'other' END AS category,
array_to_string(list_distinct(regexp_extract_all(value, 'var\\(\\s*(--[a-zA-Z0-9_-]+)', 1)), ' ') AS refs FROM c"""


_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[-_.\\s]+'), lambda w: w != '')"
ORACLES = {
    "css_round_trip": _css_oracle(),
    "dtcg_round_trip": f"""WITH {sql.TOKENS}, a AS (SELECT *, {_WORDS} AS w FROM tk WHERE value IS NOT NULL AND name IS NOT NULL)
SELECT system_id, name, value, CASE WHEN category IN ('space', 'size', 'radius') THEN CASE WHEN list_has_any(w, ['space', 'spacing', 'gap', 'inset', 'padding', 'margin']) THEN 'space' WHEN list_has_any(w, ['radius', 'rounded']) THEN 'radius' ELSE 'size' END
WHEN category IN ('opacity', 'z-index') THEN CASE WHEN list_has_any(w, ['opacity', 'alpha']) THEN 'opacity' WHEN list_has_any(w, ['z', 'layer', 'elevation']) THEN 'z-index' ELSE 'other' END
WHEN category IN ('color', 'typography', 'motion', 'shadow', 'border') THEN category ELSE 'other' END AS category, array_to_string(list_sort(list_distinct(regexp_extract_all(value, '\\{{([a-zA-Z0-9_.-]+)\\}}', 1))), ' ') AS refs, description FROM a""",
    "documentation_paths": f"""WITH {sql.CHUNKS} SELECT path, count(*) AS n_chunks FROM ch WHERE (regexp_full_match(path, 'docs/(guides|howto)/(.*/)?[^/]*\\.md') OR regexp_full_match(path, 'docs/reference/[^/]*popover[^/]*\\.md'))
AND NOT regexp_full_match(path, '(.*/)?button[^/]*\\.md') AND NOT regexp_full_match(path, 'docs/guides/[^/]{{6}}-[^/]*\\.md') AND NOT regexp_matches(path, '(^|/)(node_modules|\\.[^/]+)/') GROUP BY ALL""",
    "sessions_idle": f"WITH {_SESSIONS} {_SHOW}",
    "sessions_streamed": f"WITH {_SESSIONS} {_SHOW} WHERE d + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
}
