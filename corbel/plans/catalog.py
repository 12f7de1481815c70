"""Catalog queries: flat exports, manifests, merges, gaps, totals and index texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal_union, spellings
from ..operators.merge import first_by, merge_aliases, merge_overlay
from ..operators.search import top
from ..session import table
from ..sources.catalog import Workspace
from ..sources.catalog_json import all_exports, catalog_tables, json_exports, json_props, overlay_problems, overlay_stubs
from ..sources.connect import connection_aliases, matched
from ..sources.manifests import element_props, elements, manifest_tables
from . import sql

_NONE = "array<string>"


def export_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each export with how it is written: as an element or as an import."""
    tag = F.concat(F.lit("<"), "tag_name", F.lit(">...</"), "tag_name", F.lit(">"))
    use = F.when(F.col("tag_name").isNotNull(), tag).otherwise(F.concat(F.lit("import { "), "display_name", F.lit(" } from '"), "system_id", F.lit("'")))
    return Workspace(spark, sf_dir).exports.select("module_id", "epos", "dir", "display_name", "tag_name", "description", use.alias("usage"), F.col("deprecated.replacement").alias("replacement"))


def prop_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All allowed spellings of the own and inherited props of each export."""
    none = F.array().cast(_NONE)
    own = F.filter(F.transform("props", lambda p: p["name"]), lambda n: n.isNotNull())
    every = F.concat(F.coalesce(own, none), F.coalesce(F.filter("inherited_props", lambda n: n.isNotNull()), none))
    return Workspace(spark, sf_dir).exports.select("module_id", "epos", F.array_join(spellings(every), " ").alias("spellings"))


def prop_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each literal is a member of a prop's type."""
    props = Workspace(spark, sf_dir).exports.select(F.explode("props").alias("p")).select(F.explode(literal_union(F.col("p.type"))).alias("literal"))
    return props.groupBy("literal").agg(F.count("*").alias("n"))


def manifest_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = elements(manifest_tables(spark, sf_dir))
    at = lambda k: F.get("places", F.lit(k))
    return df.select("record_id", at(0).alias("module_pos"), at(1).alias("decl_pos"), "display_name", "tag_name", "class_name", "description", "deprecated")


def manifest_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_props(manifest_tables(spark, sf_dir)).select("record_id", "parent_key", "pos", "name", "type", "deprecated", "from_kind")


def undocumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current symbols in capitals that no export documents and that are no types.

    Where it is not told whether a symbol is a type, its ending decides.
    """
    ws = Workspace(spark, sf_dir)
    symbols = ws.symbols.where("removed_at is null and name is not null").groupBy("system_id", "name").agg(F.max("is_type_only").alias("is_type_only"))
    # How names of types end.
    like_type = F.col("name").rlike("(Props|Variant|Size|State|Status|Appearance|Padding|Position|Type|Name|Platform)$")
    value = F.col("name").rlike("^[A-Z][A-Za-z0-9]*$") & F.coalesce(~F.col("is_type_only"), ~like_type)
    return symbols.where(value).join(ws.exports.select("system_id", F.col("display_name").alias("name")).distinct(), ["system_id", "name"], "left_anti").select("system_id", "name")


def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_aliases(Workspace(spark, sf_dir).aliases)


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element manifests in the role of the overlay: the first declaration of each tag in a system."""
    tables = manifest_tables(spark, sf_dir)
    props = element_props(tables).groupBy("parent_key").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("name", "type").alias("p")))).alias("ps"))
    props = props.select(F.col("parent_key").alias("key"), F.transform("ps", lambda x: x["p"]).alias("props"))
    systems = table(spark, sf_dir, "custom_elements").select("record_id", "system_id").distinct()
    rows = elements(tables).where("tag_name is not null").join(systems, "record_id")
    first = first_by(rows, ["system_id", "tag_name"], ["record_id", "places"])
    return first.join(props, "key", "left").select("system_id", F.col("tag_name").alias("name"), F.when(F.col("description") != "", F.col("description")).alias("description"), "props")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    own = first_by(ws.exports, ["system_id", "display_name"], ["pos", "module_id", "epos"])
    own = own.select("system_id", F.col("display_name").alias("name"), "description", F.transform("props", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"))).alias("props"))
    return merge_overlay(own, ws.symbols, _overlay(spark, sf_dir))


def merged_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog exports with manifest facts laid over them; unknown names are reported."""
    shown = F.array_join(F.transform("props", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ", ")
    return _merged(spark, sf_dir).select("system_id", "name", "status", "description", shown.alias("props"))


def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports, props, tokens, chunks and aliases of each system."""
    ws = Workspace(spark, sf_dir)
    zero = F.lit(0).cast("long")
    kinds = ["exports", "props", "tokens", "chunks", "aliases"]

    def part(df: DataFrame, kind: str, n) -> DataFrame:
        return df.select("system_id", *[(n.cast("long") if k == kind else zero).alias(f"n_{k}") for k in kinds])

    one = F.lit(1)
    rows = part(ws.exports, "exports", one).unionByName(part(ws.exports, "props", F.coalesce(F.size("props"), F.lit(0)))).unionByName(part(ws.tokens, "tokens", one))
    rows = rows.unionByName(part(ws.chunks, "chunks", one)).unionByName(part(ws.aliases, "aliases", one))
    return rows.groupBy("system_id").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per export, in the form of a short index."""
    line = F.concat(F.lit("- "), "display_name", F.when(F.col("deprecated").isNotNull(), " (deprecated)").otherwise(""), F.lit(": "), F.coalesce("description", F.lit("")))
    return Workspace(spark, sf_dir).exports.select("module_id", "epos", line.alias("line"))


def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props table of each export, as in a full index."""
    text = lambda c: F.coalesce(c, F.lit(""))
    told = lambda p: F.concat(F.when(p["deprecated"] != "", F.concat(F.lit("DEPRECATED: "), p["deprecated"], F.lit(". "))).otherwise(""), text(p["description"]))
    row = lambda p: F.concat(F.lit("| "), text(p["name"]), F.lit(" | `"), text(p["type"]), F.lit("` | "), F.when(p["required"], "yes").otherwise("no"), F.lit(" | "), text(p["default_value"]), F.lit(" | "), told(p), F.lit(" |"))
    rows = F.array_join(F.transform(F.filter("props", lambda p: p.isNotNull()), row), "\n")
    return Workspace(spark, sf_dir).exports.select("module_id", "epos", F.when(F.coalesce(rows, F.lit("")) == "", "(no props)").otherwise(rows).alias("rows"))


def do_dont(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per system: the first deprecated export and prop, and the first three prop aliases with a target."""
    ws = Workspace(spark, sf_dir)
    order = F.struct("pos", "module_id", "epos")
    dep = ws.exports.where("deprecated is not null").groupBy("system_id").agg(F.min_by(F.struct("display_name", "deprecated.replacement"), order).alias("e"))
    dep = dep.select("system_id", F.lit(1).alias("line"), F.concat(F.lit("use "), "e.display_name", F.coalesce(F.concat(F.lit(", use "), "e.replacement", F.lit(" instead")), F.lit(""))).alias("text"))
    props = ws.exports.select("system_id", "pos", "module_id", "epos", "display_name", F.posexplode("props").alias("ppos", "p")).where("p.deprecated != ''")
    dep_prop = props.groupBy("system_id").agg(F.min_by(F.concat_ws(".", "display_name", "p.name"), F.struct("pos", "module_id", "epos", "ppos")).alias("p"))
    dep_prop = dep_prop.select("system_id", F.lit(2).alias("line"), F.concat(F.lit("set "), "p").alias("text"))
    team = ws.aliases.where("kind = 'props' and source = 'team' and target is not null and alias is not null")
    some = top(team, "system_id", [F.asc("pos"), F.asc("alias_id")], 3).groupBy("system_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("target", F.lit(" (not "), "alias", F.lit(")")).alias("t")))).alias("a"))
    write = some.select("system_id", F.lit(4).alias("line"), F.concat(F.lit("write "), F.array_join(F.transform("a", lambda x: x["t"]), ", ")).alias("text"))
    return dep.unionByName(dep_prop).unionByName(write)


def component_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that an export takes and gives: its own and inherited props, its events and its slots."""
    text = lambda c: F.coalesce(c, F.lit(""))
    named = lambda c: F.filter(c, lambda x: x["name"].isNotNull())
    joined = lambda c, shown: text(F.array_join(F.transform(named(c), shown), "; "))
    prop = lambda p: F.concat(p["name"], F.when(p["required"], "").otherwise("?"), F.lit(": "), text(p["type"]), F.coalesce(F.concat(F.lit(" = "), p["default_value"]), F.lit("")))
    event = lambda e: F.concat(e["name"], F.lit(": "), text(e["type"]))
    slot = lambda s: F.concat(s["name"], F.coalesce(F.concat(F.lit(" - "), s["description"]), F.lit("")))
    return Workspace(spark, sf_dir).exports.select(
        "module_id", "epos", "display_name", joined("props", prop).alias("props"), text(F.array_join("inherited_props", ", ")).alias("inherited"),
        joined("events", event).alias("events"), joined("slots", slot).alias("slots"),
    )


def _connection_files(ws: Workspace) -> DataFrame:
    """A connection file for every symbol and for every typed component name that can stand in code."""
    typed = ws.aliases.where("kind = 'components'").select("system_id", F.concat(F.lit("a/"), "alias_id").alias("path"), F.col("alias").alias("name"), F.col("alias_id").alias("k"))
    rows = ws.symbols.select("system_id", F.concat(F.lit("s/"), "symbol_id").alias("path"), "name", F.col("symbol_id").alias("k")).unionByName(typed)
    rows = rows.where(F.col("name").rlike("^[A-Za-z][A-Za-z0-9]*$"))
    code = F.format_string(
        "figma.connect(%s, 'https://f.test/file?node-id=%d-7', {\n  props: { size: figma.enum('Size', { 'Big %d': 'lg', md: \"md\" }), on: figma.boolean('On') },\n  example: (props) => (<%s size={props.size} />),\n})",
        "name", "k", "k", "name",
    )
    return rows.select("path", "system_id", code.alias("text"))


def connections_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of symbols and typed names, and what the catalog has of them."""
    ws = Workspace(spark, sf_dir)
    return matched(_connection_files(ws), ws.exports.select("system_id", F.col("display_name").alias("name")), ws.symbols)


def connections_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design values that real components write otherwise in code."""
    ws = Workspace(spark, sf_dir)
    return connection_aliases(_connection_files(ws), ws.symbols)


def _catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every catalog module written as a catalog in JSON."""
    modules = Workspace(spark, sf_dir).raw("catalog_modules", "module_id")
    prop = lambda p: F.when(p.isNotNull(), F.struct(p["name"].alias("name"), p["type"].alias("type"), p["required"].alias("required"), p["default_value"].alias("defaultValue"), p["deprecated"].alias("deprecated")))
    export = lambda e: F.when(e.isNotNull(), F.struct(e["display_name"].alias("displayName"), e["tag_name"].alias("tagName"), e["description"].alias("description"), F.transform(e["props"], prop).alias("props")))
    component = F.struct("dir", F.transform("exports", export).alias("exports"))
    return modules.select(F.col("module_id").alias("record_id"), F.to_json(F.struct(F.array(component).alias("components"))).alias("text"))


def json_catalog_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules' exports, written as JSON and read back with their defaults."""
    return json_exports(catalog_tables(_catalog_files(spark, sf_dir))).select("record_id", "key", "dir", "display_name", "tag_name", "description")


def json_catalog_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_props(catalog_tables(_catalog_files(spark, sf_dir))).select("record_id", "export_key", "pos", "name", "type", "required", "default_value", "deprecated")


def json_all_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that each catalog file exports."""
    files = _catalog_files(spark, sf_dir)
    return all_exports(files, catalog_tables(files))


def overlay_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with modules, and with manifests, in the role of overlays."""
    ws = Workspace(spark, sf_dir)
    modules = ws.raw("catalog_modules", "module_id").select(F.concat(F.lit("m/"), "module_id").alias("path"), F.to_json(F.struct(F.transform("exports", lambda e: F.struct(e["display_name"].alias("displayName"))).alias("exports"))).alias("text"))
    return overlay_problems(modules.unionByName(ws.raw("custom_elements", "record_id").select(F.concat(F.lit("e/"), "record_id").alias("path"), F.col("manifest").alias("text"))))


def overlay_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to be filled in for undocumented symbols of which no manifest declares a class."""
    systems = table(spark, sf_dir, "custom_elements").select("record_id", "system_id").distinct()
    declared = elements(manifest_tables(spark, sf_dir)).join(systems, "record_id").select("system_id", F.col("class_name").alias("name"))
    return overlay_stubs(undocumented(spark, sf_dir), declared)


def catalog_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and distinct prop names of each system."""
    ws = Workspace(spark, sf_dir)
    props = ws.exports.select("system_id", F.explode("props").alias("p")).select("system_id", F.col("p.name").alias("name"), F.lit(False).alias("symbol"))
    rows = ws.symbols.select("system_id", "name", F.lit(True).alias("symbol")).unionByName(props).where("name is not null").distinct()
    return rows.groupBy("system_id").agg(F.count_if("symbol").alias("n_symbols"), F.count_if(~F.col("symbol")).alias("n_prop_names"))


QUERIES = {
    f.__name__: f
    for f in (export_summaries, prop_spellings, prop_literals, manifest_exports, manifest_props, undocumented, merged_aliases, merged_overlay, catalog_totals, index_lines, index_tables, do_dont, component_contracts, connections_matched, connections_aliases, json_catalog_exports, json_catalog_props, json_all_exports, overlay_checks, overlay_scaffold, catalog_sizes)
}

_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE CAST([] AS JSON[]) END"


def _each(source: str, field: str, keep: str, pos: str) -> str:
    listed = _LIST.format(f"json_extract(j, '$.{field}')")
    return f"SELECT {keep}, unnest(l) AS j, unnest(range(len(l))) AS {pos} FROM (SELECT {keep}, {listed} AS l FROM {source})"


def _str(field: str) -> str:
    return f"CASE WHEN json_type(json_extract(j, '$.{field}')) = 'VARCHAR' THEN json_extract_string(j, '$.{field}') END"


_DEP = f"CASE WHEN json_extract_string(j, '$.deprecated') = 'true' THEN 'deprecated' WHEN {_str('deprecated')} != '' THEN {_str('deprecated')} END"
_MANIFEST = f"""m0 AS (SELECT DISTINCT ON (record_id) record_id, system_id, manifest::JSON AS j FROM custom_elements WHERE json_valid(manifest)),
m1 AS ({_each('m0', 'modules', 'record_id, system_id', 'm')}), m2 AS ({_each('m1', 'declarations', 'record_id, system_id, m', 'd')}),
el AS (SELECT record_id, system_id, m, d, coalesce(tag_name, class_name, 'UnknownElement') AS display_name, tag_name, class_name, coalesce(nullif(ds, ''), sm, '') AS description, deprecated FROM
(SELECT *, {_str('tagName')} AS tag_name, {_str('name')} AS class_name, {_str('description')} AS ds, {_str('summary')} AS sm, {_DEP} AS deprecated, json_extract_string(j, '$.customElement') = 'true' AS ce FROM m2 WHERE json_type(j) = 'OBJECT') WHERE ce OR tag_name IS NOT NULL),
pa AS (SELECT *, 0 AS k FROM ({_each('m2', 'attributes', 'record_id, m, d', 'p')}) UNION ALL SELECT *, 1 FROM ({_each('m2', 'members', 'record_id, m, d', 'p')})),
pb AS (SELECT record_id, m, d, p, k, {_str('name')} AS name, coalesce(json_extract_string(j, '$.type.text'), CASE k WHEN 0 THEN 'string' ELSE 'unknown' END) AS type, {_DEP} AS deprecated FROM pa
WHERE {_str('name')} IS NOT NULL AND (k = 0 OR (json_extract_string(j, '$.kind') = 'field' AND coalesce(json_extract_string(j, '$.static'), '') != 'true' AND coalesce(json_extract_string(j, '$.privacy'), '') NOT IN ('private', 'protected')))),
pc AS (SELECT *, row_number() OVER (PARTITION BY record_id, m, d, replace(lower(name), '-', '') ORDER BY k, p) AS n FROM pb),
pp AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id, m, d ORDER BY k, p) - 1 AS INTEGER) AS pos FROM pc WHERE k = 0 OR n = 1)"""
_CAMEL = "n[1] || array_to_string(list_transform(n[2:], lambda w: upper(w[1]) || w[2:]), '')"

ORACLES = {
    "export_summaries": f"""WITH {sql.EXPORTS} SELECT module_id, epos, dir, display_name, tag_name, description, CASE WHEN tag_name IS NOT NULL THEN '<' || tag_name || '>...</' || tag_name || '>' ELSE 'import {{ ' || display_name || ' }} from ''' || system_id || '''' END AS usage, deprecated.replacement AS replacement FROM ex""",
    "prop_spellings": f"""WITH {sql.EXPORTS}, a AS (SELECT module_id, epos, unnest(list_filter(coalesce(list_transform(props, lambda p: p.name), CAST([] AS VARCHAR[])) || coalesce(inherited_props, CAST([] AS VARCHAR[])), lambda n: n IS NOT NULL)) AS name FROM ex),
b AS (SELECT module_id, epos, name AS s FROM a UNION SELECT module_id, epos, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) FROM a UNION SELECT module_id, epos, {_CAMEL} FROM (SELECT *, string_split(name, '-') AS n FROM a)),
c AS (SELECT module_id, epos, string_agg(s, ' ' ORDER BY s) AS spellings FROM b GROUP BY ALL) SELECT module_id, epos, coalesce(spellings, '') AS spellings FROM ex LEFT JOIN c USING (module_id, epos)""",
    "prop_literals": f"""WITH {sql.EXPORTS}, a AS (SELECT list_filter(list_transform(string_split(p.type, '|'), lambda x: trim(x)), lambda x: x != 'undefined') AS l FROM (SELECT unnest(props) AS p FROM ex)),
b AS (SELECT unnest(l) AS q FROM a WHERE len(l) > 0 AND len(list_filter(l, lambda x: NOT regexp_full_match(x, '''.*''|".*"'))) = 0) SELECT q[2:-2] AS literal, count(*) AS n FROM b GROUP BY ALL""",
    "manifest_exports": f"WITH {_MANIFEST} SELECT record_id, CAST(m AS INTEGER) AS module_pos, CAST(d AS INTEGER) AS decl_pos, display_name, tag_name, class_name, description, deprecated FROM el",
    "manifest_props": f"WITH {_MANIFEST} SELECT record_id, record_id || '/module.' || m || '/declaration.' || d AS parent_key, pos, name, type, deprecated, CASE k WHEN 0 THEN 'attribute' ELSE 'member' END AS from_kind FROM pp",
    "undocumented": f"""WITH {sql.EXPORTS}, {sql.SYMBOLS}, a AS (SELECT system_id, name, bool_or(is_type_only) AS t FROM sy WHERE removed_at IS NULL AND name IS NOT NULL GROUP BY ALL)
SELECT system_id, name FROM a WHERE regexp_full_match(name, '[A-Z][A-Za-z0-9]*') AND coalesce(NOT t, NOT regexp_matches(name, '(Props|Variant|Size|State|Status|Appearance|Padding|Position|Type|Name|Platform)$')) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.system_id = a.system_id AND ex.display_name = a.name)""",
    "merged_aliases": f"""WITH {sql.ALIASES}, a AS (SELECT *, CASE source WHEN 'lexicon' THEN 0 WHEN 'code-connect' THEN 1 WHEN 'team' THEN 2 END AS l FROM al WHERE alias IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY system_id, kind, alias ORDER BY l DESC, pos DESC, alias_id DESC) AS w, first_value(l) OVER f AS layer, first_value(pos) OVER f AS first_pos FROM a WHERE l IS NOT NULL WINDOW f AS (PARTITION BY system_id, kind, alias ORDER BY l, pos))
SELECT system_id, kind, alias, alias_id, target, concept, source, layer, first_pos FROM b WHERE w = 1""",
    "merged_overlay": f"""WITH {_MANIFEST}, {sql.EXPORTS}, {sql.SYMBOLS},
o0 AS (SELECT *, row_number() OVER (PARTITION BY system_id, tag_name ORDER BY record_id, m, d) AS n FROM el WHERE tag_name IS NOT NULL),
ov AS (SELECT o0.system_id, tag_name AS name, nullif(description, '') AS description, coalesce(ps, CAST([] AS STRUCT(n VARCHAR, t VARCHAR)[])) AS ps FROM o0 LEFT JOIN (SELECT record_id, m, d, list({{'n': name, 't': type}} ORDER BY pos) AS ps FROM pp GROUP BY ALL) USING (record_id, m, d) WHERE n = 1),
ow AS (SELECT system_id, display_name AS name, description AS d0, coalesce(list_filter(list_transform(props, lambda p: {{'n': p.name, 't': p.type}}), lambda p: p.n IS NOT NULL), CAST([] AS STRUCT(n VARCHAR, t VARCHAR)[])) AS p0 FROM (SELECT *, row_number() OVER (PARTITION BY system_id, display_name ORDER BY pos, module_id, epos) AS n FROM ex) WHERE n = 1),
j AS (SELECT ov.system_id, ov.name, CASE WHEN NOT EXISTS (SELECT 1 FROM sy WHERE sy.system_id = ov.system_id AND sy.name = ov.name) THEN 'unknown' WHEN ow.name IS NULL THEN 'created' ELSE 'merged' END AS status, coalesce(description, d0, '') AS description, ps, coalesce(p0, CAST([] AS STRUCT(n VARCHAR, t VARCHAR)[])) AS p0 FROM ov LEFT JOIN ow ON ow.system_id = ov.system_id AND ow.name = ov.name)
SELECT system_id, name, status, CASE WHEN status != 'unknown' THEN description END AS description, CASE WHEN status != 'unknown' THEN array_to_string(list_transform(list_transform(p0, lambda p: coalesce(list_filter(ps, lambda o: o.n = p.n)[-1], p)) || list_filter(ps, lambda o: NOT list_contains(list_transform(p0, lambda p: p.n), o.n)), lambda p: p.n || ':' || p.t), ', ') END AS props FROM j""",
    "catalog_totals": f"""WITH {sql.EXPORTS}, {sql.TOKENS}, {sql.CHUNKS}, {sql.ALIASES}, u AS (SELECT system_id, 1 AS a, coalesce(len(props), 0) AS b, 0 AS c, 0 AS d, 0 AS e FROM ex UNION ALL SELECT system_id, 0, 0, 1, 0, 0 FROM tk UNION ALL SELECT system_id, 0, 0, 0, 1, 0 FROM ch UNION ALL SELECT system_id, 0, 0, 0, 0, 1 FROM al)
SELECT system_id, CAST(sum(a) AS BIGINT) AS n_exports, CAST(sum(b) AS BIGINT) AS n_props, CAST(sum(c) AS BIGINT) AS n_tokens, CAST(sum(d) AS BIGINT) AS n_chunks, CAST(sum(e) AS BIGINT) AS n_aliases FROM u GROUP BY ALL""",
    "index_lines": f"WITH {sql.EXPORTS} SELECT module_id, epos, '- ' || display_name || CASE WHEN deprecated IS NOT NULL THEN ' (deprecated)' ELSE '' END || ': ' || coalesce(description, '') AS line FROM ex",
    "index_tables": f"""WITH {sql.EXPORTS}, r AS (SELECT module_id, epos, array_to_string(list_transform(list_filter(props, lambda p: p IS NOT NULL), lambda p: '| ' || coalesce(p.name, '') || ' | `' || coalesce(p.type, '') || '` | ' || CASE WHEN p.required THEN 'yes' ELSE 'no' END || ' | ' || coalesce(p.default_value, '') || ' | ' || CASE WHEN p.deprecated != '' THEN 'DEPRECATED: ' || p.deprecated || '. ' ELSE '' END || coalesce(p.description, '') || ' |'), chr(10)) AS t FROM ex)
SELECT module_id, epos, CASE WHEN coalesce(t, '') = '' THEN '(no props)' ELSE t END AS rows FROM r""",
    "do_dont": f"""WITH {sql.EXPORTS}, {sql.ALIASES}, d AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY pos, module_id, epos) AS n FROM ex WHERE deprecated IS NOT NULL),
p0 AS (SELECT system_id, pos, module_id, epos, display_name, unnest(props) AS p, unnest(range(len(props))) AS ppos FROM ex), p1 AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY pos, module_id, epos, ppos) AS n FROM p0 WHERE p.deprecated != ''),
t AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY pos, alias_id) AS n FROM al WHERE kind = 'props' AND source = 'team' AND target IS NOT NULL AND alias IS NOT NULL)
SELECT system_id, 1 AS line, 'use ' || display_name || coalesce(', use ' || deprecated.replacement || ' instead', '') AS text FROM d WHERE n = 1
UNION ALL SELECT system_id, 2, 'set ' || concat_ws('.', display_name, p.name) FROM p1 WHERE n = 1
UNION ALL SELECT system_id, 4, 'write ' || string_agg(target || ' (not ' || alias || ')', ', ' ORDER BY n) FROM t WHERE n <= 3 GROUP BY system_id""",
}
_FILES = f"""fl AS (SELECT * FROM (SELECT 's/' || symbol_id AS path, system_id, name, symbol_id AS k FROM sy UNION ALL SELECT 'a/' || alias_id, system_id, alias, alias_id FROM al WHERE kind = 'components') WHERE regexp_matches(name, '^[A-Za-z][A-Za-z0-9]*$'))"""
ORACLES["connections_matched"] = f"""WITH {sql.EXPORTS}, {sql.SYMBOLS}, {sql.ALIASES}, {_FILES}
SELECT path, CAST(0 AS INTEGER) AS pos, system_id, name AS component, CASE WHEN NOT EXISTS (SELECT 1 FROM sy WHERE sy.system_id = fl.system_id AND sy.name = fl.name) THEN 'unmatched'
WHEN EXISTS (SELECT 1 FROM ex WHERE ex.system_id = fl.system_id AND ex.display_name = fl.name) THEN 'mapped' ELSE 'created' END AS status, k || ':7' AS node_id, '<' || name || ' size={{{{size}}}} />' AS example FROM fl"""
ORACLES["connections_aliases"] = f"""WITH {sql.SYMBOLS}, {sql.ALIASES}, {_FILES}
SELECT DISTINCT system_id, 'Big ' || k AS alias, 'lg' AS target, name || '.size' AS concept FROM fl WHERE EXISTS (SELECT 1 FROM sy WHERE sy.system_id = fl.system_id AND sy.name = fl.name)"""
_SHOWN = "coalesce(array_to_string(list_transform(list_filter({0}, lambda x: x.name IS NOT NULL), lambda x: {1}), '; '), '')"
ORACLES["component_contracts"] = f"""WITH {sql.EXPORTS} SELECT module_id, epos, display_name, {_SHOWN.format('props', "x.name || CASE WHEN x.required THEN '' ELSE '?' END || ': ' || coalesce(x.type, '') || coalesce(' = ' || x.default_value, '')")} AS props,
coalesce(array_to_string(inherited_props, ', '), '') AS inherited, {_SHOWN.format('events', "x.name || ': ' || coalesce(x.type, '')")} AS events, {_SHOWN.format('slots', "x.name || coalesce(' - ' || x.description, '')")} AS slots FROM ex"""
_MODULES = """md AS (SELECT DISTINCT ON (module_id) * FROM catalog_modules), xe AS (SELECT * FROM (SELECT module_id, dir, unnest(exports) AS e, unnest(range(len(exports))) AS i FROM md) WHERE e IS NOT NULL)"""
_EXPORT_KEY = "module_id || '/component.0/export.' || i"
ORACLES["json_catalog_exports"] = f"WITH {_MODULES} SELECT module_id AS record_id, {_EXPORT_KEY} AS key, coalesce(dir, '') AS dir, coalesce(e.display_name, '') AS display_name, e.tag_name AS tag_name, coalesce(e.description, '') AS description FROM xe"
ORACLES["json_catalog_props"] = f"""WITH {_MODULES} SELECT module_id AS record_id, {_EXPORT_KEY} AS export_key, CAST(k AS INTEGER) AS pos, coalesce(p.name, '') AS name, coalesce(p.type, 'unknown') AS type, coalesce(p.required, false) AS required, p.default_value AS default_value, p.deprecated AS deprecated
FROM (SELECT module_id, i, unnest(e.props) AS p, unnest(range(len(e.props))) AS k FROM xe) WHERE p IS NOT NULL"""
ORACLES["json_all_exports"] = f"WITH {_MODULES} SELECT DISTINCT module_id AS record_id, coalesce(e.display_name, '') AS name FROM xe"
ORACLES["overlay_checks"] = f"""WITH md AS (SELECT DISTINCT ON (module_id) * FROM catalog_modules), ce AS (SELECT DISTINCT ON (record_id) * FROM custom_elements)
SELECT 'm/' || module_id AS path, 'no exports array' AS problem FROM md WHERE exports IS NULL UNION ALL SELECT 'm/' || module_id, 'exports[' || i || '] has no displayName' FROM (SELECT module_id, unnest(exports) AS e, unnest(range(len(exports))) AS i FROM md) WHERE e.display_name IS NULL
UNION ALL SELECT 'e/' || record_id, CASE WHEN NOT json_valid(manifest) THEN 'not valid JSON' WHEN json_type(manifest::JSON) != 'OBJECT' THEN 'not an object' ELSE 'no exports array' END FROM ce WHERE manifest IS NOT NULL"""
ORACLES["overlay_scaffold"] = f"""WITH ud AS ({ORACLES['undocumented']}), dc AS (SELECT DISTINCT c.system_id, m.class_name AS name FROM ({ORACLES['manifest_exports']}) m JOIN custom_elements c USING (record_id) WHERE m.class_name IS NOT NULL)
SELECT system_id, name, 'Read the declaration of ' || name || ' and fill in its props.' AS note FROM ud ANTI JOIN dc USING (system_id, name)"""
ORACLES["catalog_sizes"] = f"""WITH {sql.EXPORTS}, {sql.SYMBOLS}, pn AS (SELECT system_id, p.name AS name FROM (SELECT system_id, unnest(props) AS p FROM ex)), al AS (SELECT system_id, name, true AS s FROM sy WHERE name IS NOT NULL UNION SELECT system_id, name, false FROM pn WHERE name IS NOT NULL)
SELECT system_id, count(*) FILTER (s) AS n_symbols, count(*) FILTER (NOT s) AS n_prop_names FROM al GROUP BY ALL"""
