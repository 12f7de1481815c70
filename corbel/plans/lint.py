"""Usage checks over all fenced code of the documentation chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNIVERSAL_ATTRIBUTES
from ..operators import lint
from ..operators.merge import first_by
from ..sources import markup
from ..sources.catalog import Workspace
from . import sql, tokens

# Names that need no quotes in a snippet.
_PLAIN = "^[A-Za-z][A-Za-z0-9-]*$"
_FENCE = r"```[^\n`]*\n([\s\S]*?)```"


def snippets(ws: Workspace) -> DataFrame:
    """snippet_id (chunk/number), system_id, code of every fenced block."""
    blocks = ws.chunks.select("chunk_id", "system_id", F.posexplode(F.regexp_extract_all("text", F.lit(_FENCE), 1)).alias("n", "code"))
    return blocks.select(F.concat_ws("/", "chunk_id", "n").alias("snippet_id"), "system_id", "code")


def code_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of the snippets with its attributes."""
    ws = Workspace(spark, sf_dir)
    shown = F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.coalesce(F.concat(F.lit("="), a["value"]), F.lit("")))), " ")
    return markup.elements(snippets(ws)).select("snippet_id", "line", "tag", shown.alias("attrs"))


def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(Workspace(spark, sf_dir)).select(markup.language(F.col("code")).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


def element_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all element checks."""
    ws = Workspace(spark, sf_dir)
    found = lint.check_elements(ws, lint.resolved_elements(ws, snippets(ws)))
    return found.select("snippet_id", "line", "kind", "severity", "subject", "fix")


def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings by kind over all snippets, raw values and imports included."""
    ws = Workspace(spark, sf_dir)
    return lint.check_usage(ws, snippets(ws)).groupBy("kind", "severity").agg(F.count("*").alias("n"), F.count_distinct("snippet_id").alias("n_snippets"))


def used_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    return lint.used_components(ws, snippets(ws))


def made_snippets(ws: Workspace) -> DataFrame:
    """A snippet for each export name, with mistakes made on purpose: an element where the name has a dash, else an import with JSX."""
    first = first_by(ws.exports, ["system_id", "display_name"], ["pos", "module_id", "epos"])
    prop = F.get(F.filter("props", lambda p: p["name"].rlike(_PLAIN)), F.lit(0))["name"]
    attr = F.coalesce(F.concat(F.lit(" "), prop, F.lit('="nope"')), F.lit(""))
    name = F.col("display_name")
    html = F.concat(F.lit("<"), name, attr, F.lit(' zz-made-up="1" style="color: #336699; width: 13px"></'), name, F.lit(">"))
    tsx = F.concat(F.lit("import { "), name, F.lit(", ZzMadeUp } from '"), "system_id", F.lit("';\nimport { pick } from 'zz-tools';\n<"), name, attr, F.lit(" zzMadeUp=\"1\" className=\"a [7px]\" style={{ color: '#336699', width: 13 }} />"))
    return first.select(F.concat_ws("/", "module_id", "epos").alias("snippet_id"), "system_id", F.when(name.contains("-"), html).otherwise(tsx).alias("code"))


def usage_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in order, of snippets in both languages made from the exports."""
    ws = Workspace(spark, sf_dir)
    return lint.usage_report(ws, made_snippets(ws)).select("snippet_id", "rank", "line", "kind", "severity", "subject", "fix")


def made_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that each snippet made from an export is taken for."""
    return made_snippets(Workspace(spark, sf_dir)).select("snippet_id", markup.language(F.col("code")).alias("language"))


QUERIES = {f.__name__: f for f in (code_elements, code_languages, element_findings, usage_report, used_components, usage_findings, made_languages)}

_SNIPPETS = """f0 AS (SELECT chunk_id, system_id, regexp_extract_all(text, '```[^\\n`]*\\n([\\s\\S]*?)```', 1) AS b FROM ch),
sn AS (SELECT chunk_id || '/' || n AS snippet_id, system_id, code FROM (SELECT chunk_id, system_id, unnest(b) AS code, unnest(range(len(b))) AS n FROM f0)),
ln AS (SELECT snippet_id, system_id, code, unnest(string_split(code, chr(10))) AS t, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS line FROM sn),
tg AS (SELECT snippet_id, system_id, code, CAST(line AS INTEGER) AS line, unnest(regexp_extract_all(t, '<[a-zA-Z][a-zA-Z0-9.-]*[^<>]*>')) AS g FROM ln),
el AS (SELECT snippet_id, system_id, code, line, regexp_extract(g, '^<([a-zA-Z][a-zA-Z0-9.-]*)', 1) AS tag, regexp_extract_all(g, '\\s([a-zA-Z_:@][-a-zA-Z0-9_:.]*(="[^"]*")?)', 1) AS at_ FROM tg)"""
_UNIVERSAL = "[" + ", ".join(f"'{w}'" for w in [*UNIVERSAL_ATTRIBUTES, "class"]) + "]"
_REAL = f"""{sql.EXPORTS}, {sql.CHUNKS}, {sql.SYMBOLS}, {_SNIPPETS}, ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_id, display_name ORDER BY pos, module_id, epos) AS n FROM ex) WHERE n = 1),
kn AS (SELECT DISTINCT system_id, name FROM sy),
rs AS (SELECT el.*, ct.display_name, ct.props, ct.inherited_props, ct.deprecated, kn.name AS known FROM el LEFT JOIN ct ON ct.system_id = el.system_id AND ct.display_name = tag LEFT JOIN kn ON kn.system_id = el.system_id AND kn.name = tag WHERE contains(tag, '-'))"""
_CAMEL = "string_split({0}, '-')[1] || array_to_string(list_transform(string_split({0}, '-')[2:], lambda w: upper(w[1]) || w[2:]), '')"
_KEBAB = "lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'))"


def _match(name: str) -> str:
    first = lambda test: f"list_filter(allowed, lambda p: {test})[1]"
    return f"coalesce({first(f'p = {name}')}, {first(f'lower(p) = lower({name})')}, {first(f'p = ' + _CAMEL.format(name))}, {first(f'p = ' + _KEBAB.format(name))})"


ORACLES = {
    "code_elements": f"WITH {sql.CHUNKS}, {_SNIPPETS} SELECT snippet_id, line, tag, array_to_string(list_transform(at_, lambda a: replace(a, '\"', '')), ' ') AS attrs FROM el",
    "code_languages": f"WITH {sql.CHUNKS}, {_SNIPPETS} SELECT CASE WHEN NOT regexp_matches(code, '\\b(import|export|function)\\b|=>|\\{{') AND regexp_matches(code, '<[a-zA-Z]') THEN 'html' ELSE 'tsx' END AS language, count(*) AS n FROM sn GROUP BY ALL",
    "used_components": f"WITH {_REAL} SELECT snippet_id, string_agg(tag, ' ' ORDER BY tag) AS components FROM (SELECT DISTINCT snippet_id, tag FROM rs WHERE display_name IS NOT NULL OR known IS NOT NULL) GROUP BY ALL",
    "element_findings": f"""WITH {_REAL}, {sql.ALIASES}, nm AS (SELECT *, coalesce(list_filter(list_transform(props, lambda p: p.name), lambda n: n IS NOT NULL), CAST([] AS VARCHAR[])) AS ns FROM rs WHERE display_name IS NOT NULL),
al2 AS (SELECT *, list_sort(list_distinct(flatten(list_transform(ns, lambda n: [n, {_CAMEL.format('n')}, {_KEBAB.format('n')}])))) || coalesce(inherited_props, CAST([] AS VARCHAR[])) AS allowed FROM nm),
at1 AS (SELECT *, string_split(a, '="')[1] AS name, CASE WHEN contains(a, '="') THEN regexp_extract(a, '="(.*)"$', 1) END AS value FROM (SELECT *, unnest(at_) AS a FROM al2)),
at2 AS (SELECT * FROM at1 WHERE NOT list_contains({_UNIVERSAL}, name) AND NOT regexp_matches(name, '^(data-|aria-|on[A-Z]|on-|@)')),
ok AS (SELECT *, list_filter(props, lambda p: p.name = at2.name OR p.name = {_CAMEL.format('at2.name')} OR p.name = {_KEBAB.format('at2.name')})[1] AS p FROM at2 WHERE list_contains(allowed, name)),
vl AS (SELECT *, trim(p.type) AS ty, list_filter(list_transform(string_split(trim(p.type), '|'), lambda x: trim(x)), lambda x: x != 'undefined') AS mq FROM ok WHERE value IS NOT NULL),
vm AS (SELECT *, CASE WHEN len(mq) > 0 AND len(list_filter(mq, lambda x: NOT regexp_full_match(x, '''.*''|".*"'))) = 0 THEN list_transform(mq, lambda x: x[2:-2]) END AS mb FROM vl),
tm AS (SELECT system_id AS s, lower(alias) AS la, min_by(target, {{'pos': pos, 'alias_id': alias_id}}) AS target FROM al WHERE kind = 'props' AND source = 'team' AND alias IS NOT NULL GROUP BY ALL),
iv AS (SELECT at2.*, tm.target FROM at2 LEFT JOIN tm ON tm.s = at2.system_id AND tm.la = lower(at2.name) WHERE NOT list_contains(allowed, name))
SELECT snippet_id, line, 'unknown-component' AS kind, 'error' AS severity, tag AS subject, NULL AS fix FROM rs WHERE display_name IS NULL AND known IS NULL
UNION ALL SELECT snippet_id, line, 'deprecated', 'warning', tag, deprecated.replacement FROM rs WHERE deprecated IS NOT NULL
UNION ALL SELECT snippet_id, line, 'deprecated', 'warning', tag || '.' || name, p.deprecated FROM ok WHERE p.deprecated != ''
UNION ALL SELECT snippet_id, line, 'invalid-value', CASE WHEN ty IN ('boolean', 'number') THEN 'warning' ELSE 'error' END, tag || '.' || name, CASE WHEN ty NOT IN ('boolean', 'number') THEN coalesce('use ''' || list_filter(mb, lambda m: lower(m) = lower(value))[1] || ''' instead', 'one of ' || array_to_string(mb, ', ')) END
FROM vm WHERE CASE ty WHEN 'boolean' THEN value NOT IN ('true', 'false') WHEN 'number' THEN trim(value) = '' OR TRY_CAST(value AS DOUBLE) IS NULL ELSE coalesce(NOT list_contains(mb, value), false) END
UNION ALL SELECT snippet_id, line, 'invented-prop', 'warning', tag || '.' || name, 'use ''' || coalesce({_match('target')}, {_match('iv.name')}) || ''' instead' FROM iv""",
}
_MADE = f"""ct AS (SELECT *, module_id || '/' || epos AS snippet_id, list_filter(props, lambda p: regexp_matches(p.name, '{_PLAIN}'))[1] AS p, contains(display_name, '-') AS html FROM (SELECT *, row_number() OVER (PARTITION BY system_id, display_name ORDER BY pos, module_id, epos) AS n FROM ex) WHERE n = 1)"""


def _nearest_fix(name: str, source: str, distance: str) -> str:
    write = "CASE WHEN tk.css_var IS NOT NULL THEN 'use var(' || tk.css_var || ')' ELSE 'use ' || tk.name END"
    return f"{name} AS (SELECT {source}.system_id, min_by({write}, {{'d': {distance}, 'pos': tk.pos, 'id': tk.token_id}}) AS fix FROM {source} JOIN tk ON tk.token_id = {source}.token_id WHERE {distance} IS NOT NULL GROUP BY ALL)"


ORACLES["usage_findings"] = f"""WITH {tokens._resolved()}, {sql.EXPORTS}, {sql.SYMBOLS}, {_MADE}, cl AS (SELECT token_id, system_id, {tokens._RGB} AS c FROM rv WHERE category = 'color'),
px AS (SELECT token_id, system_id, {tokens._PX} AS v FROM rv WHERE theme_pos = 0 AND category IN ('space', 'size', 'radius')),
{_nearest_fix('fc', 'cl', 'sqrt((c.r - 51) ** 2 + (c.g - 102) ** 2 + (c.b - 153) ** 2)')}, {_nearest_fix('f13', 'px', 'abs(v - 13)')}, {_nearest_fix('f7', 'px', 'abs(v - 7)')},
el AS (SELECT *, CASE WHEN html THEN 1 ELSE 3 END AS line, display_name || '.' || p.name AS at_, trim(p.type) AS ty, NOT list_contains({_UNIVERSAL}, p.name) AND NOT regexp_matches(p.name, '^(data-|aria-|on[A-Z]|on-|@)') AS own FROM ct),
un AS (SELECT *, list_filter(list_transform(string_split(ty, '|'), lambda x: trim(x)), lambda x: x != 'undefined') AS mq FROM el WHERE own),
raw AS (SELECT system_id, snippet_id, line, display_name, unnest(CASE WHEN html THEN ['c', '13'] ELSE ['c', '13', '7'] END) AS what FROM el),
fd AS (SELECT snippet_id, line, 'deprecated' AS kind, 'warning' AS severity, display_name AS subject, deprecated.replacement AS fix FROM el WHERE deprecated IS NOT NULL
UNION ALL SELECT snippet_id, line, 'deprecated', 'warning', at_, p.deprecated FROM el WHERE own AND p.deprecated != ''
UNION ALL SELECT snippet_id, line, 'invalid-value', 'warning', at_, NULL FROM un WHERE ty IN ('boolean', 'number')
UNION ALL SELECT snippet_id, line, 'invalid-value', 'error', at_, 'one of ' || array_to_string(list_transform(mq, lambda x: x[2:-2]), ', ') FROM un WHERE len(mq) > 0 AND len(list_filter(mq, lambda x: NOT regexp_full_match(x, '''.*''|".*"'))) = 0
UNION ALL SELECT snippet_id, line, 'invented-prop', 'warning', display_name || CASE WHEN html THEN '.zz-made-up' ELSE '.zzMadeUp' END, NULL FROM el
UNION ALL SELECT snippet_id, line, 'missing-accessible-name', 'error', display_name, NULL FROM el WHERE regexp_matches(display_name, '{lint.ICON_ONLY}')
UNION ALL SELECT snippet_id, line, 'raw-value', 'warning', display_name, coalesce(CASE what WHEN 'c' THEN fc.fix WHEN '13' THEN f13.fix ELSE f7.fix END, 'use a design token') FROM raw LEFT JOIN fc USING (system_id) LEFT JOIN f13 USING (system_id) LEFT JOIN f7 USING (system_id)
UNION ALL SELECT snippet_id, 2, 'disallowed-import', 'error', 'zz-tools', NULL FROM el WHERE NOT html
UNION ALL SELECT snippet_id, 1, 'unknown-component', 'error', name, NULL FROM (SELECT snippet_id, system_id, unnest([display_name, 'ZzMadeUp']) AS name FROM el WHERE NOT html) i WHERE NOT EXISTS (SELECT 1 FROM sy WHERE sy.system_id = i.system_id AND sy.name = i.name))
SELECT snippet_id, CAST(row_number() OVER (PARTITION BY snippet_id ORDER BY line, kind, subject, fix NULLS FIRST) AS INTEGER) AS rank, CAST(line AS INTEGER) AS line, kind, severity, subject, fix FROM fd"""
ORACLES["made_languages"] = f"WITH {sql.EXPORTS}, {_MADE} SELECT snippet_id, CASE WHEN html THEN 'html' ELSE 'tsx' END AS language FROM ct"
_WHOLE = lint.RAW_VALUE.removeprefix("(?i)")
# Counts of kinds need no fixes; code of the chunks is HTML throughout, so that it has no imports.
ORACLES["usage_report"] = f"""WITH fnd AS ({ORACLES['element_findings']}), {sql.CHUNKS}, {_SNIPPETS},
at3 AS (SELECT snippet_id, string_split(a, '="')[1] AS name, CASE WHEN contains(a, '="') THEN regexp_extract(a, '="(.*)"$', 1) END AS value FROM (SELECT *, unnest(at_) AS a FROM el)),
rw AS (SELECT snippet_id, unnest(list_filter(list_transform(string_split(value, ';'), lambda d: trim(regexp_replace(d, '^[^:]*:', ''))), lambda v: regexp_matches(lower(v), '{_WHOLE}'))) AS raw FROM at3 WHERE lower(name) = 'style' AND value IS NOT NULL
UNION ALL SELECT snippet_id, unnest(list_distinct(regexp_extract_all(value, '(#(?:[0-9a-fA-F]{{8}}|[0-9a-fA-F]{{6}}|[0-9a-fA-F]{{4}}|[0-9a-fA-F]{{3}}))\\b', 1) || regexp_extract_all(value, '(?i)\\b((?:rgba?|hsla?)\\([^)]*\\))', 1) || regexp_extract_all(value, '\\[[^\\]]*?(-?\\d*\\.?\\d+px)[^\\]]*?\\]', 1))) FROM at3 WHERE name IN ('class', 'className') AND value IS NOT NULL),
al3 AS (SELECT snippet_id, kind, severity FROM fnd UNION ALL SELECT snippet_id, 'raw-value', 'warning' FROM rw)
SELECT kind, severity, count(*) AS n, count(DISTINCT snippet_id) AS n_snippets FROM al3 GROUP BY ALL"""
