"""The pN_ queries of the general problems: flat tables, hierarchies, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import looped_ancestors, paths_to_root, resolve_links
from ..operators.nested import INVALID, FlatTables, Level, flatten_records
from ..operators.orphans import orphan_references, orphans_by_period
from ..operators.references import ref_key, ref_kind, token_links, token_nodes
from ..session import once, stage, table, trimmed
from ..sources.manifests import manifest_tables

MODULE = (Level("exports", "export", (Level("props", "prop"), Level("events", "event"))),)


def module_tables(spark: SparkSession, sf_dir: str) -> FlatTables:
    df = once(table(spark, sf_dir, "catalog_modules").select("module_id", "exports"), "module_id")
    # As text: Spark writes it faster than Arrow's nested structs turn into Python's objects.
    return flatten_records(df, "module_id", F.to_json(F.struct("exports")), MODULE)


def _children(src: str, rows: DataFrame, module_pos, parent_pos, child_pos) -> DataFrame:
    return rows.where("name is not null").select(
        F.lit(src).alias("src_table"),
        "record_id",
        module_pos.alias("module_pos"),
        parent_pos.alias("parent_pos"),
        F.col("tag").alias("child_kind"),
        child_pos.alias("child_pos"),
        F.col("name").alias("child_name"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get("places", F.lit(k))
    manifests = manifest_tables(spark, sf_dir).rows("attribute", "member")
    modules = module_tables(spark, sf_dir).rows("prop", "event")
    return _children("custom_elements", manifests, at(0), at(1), at(2)).unionByName(_children("catalog_modules", modules, F.lit(0), at(0), at(1)))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members' flat table joined to their declarations by the parent key."""
    tables = manifest_tables(spark, sf_dir)
    members = tables.table("member", "name string, kind string, privacy string, static boolean")
    parents = tables.table("declaration", "name string, tagName string").select(F.col("key").alias("_key"), F.col("name").alias("class_name"), F.col("tagName").alias("tag_name"))
    joined = members.join(parents, members["parent_key"] == parents["_key"])
    return joined.select("record_id", "key", "parent_key", "class_name", "tag_name", F.col("name").alias("member_name"), "kind", "privacy", "static")


def p1_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests that are no valid JSON."""
    return manifest_tables(spark, sf_dir).rows(INVALID).select("record_id")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens under ids that are written once, so that a lost task can't renumber them."""
    rows = once(token_nodes(table(spark, sf_dir, "tokens")), "system_id", "name")
    return stage(rows.select(F.monotonically_increasing_id().alias("id"), "system_id", "name", "css_var", "refs"), "nodes")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    resolved = resolve_links(token_links(nodes))
    names = nodes.select(F.col("id").alias("root"), F.col("name").alias("root_name"))
    ended = resolved.where("not looped").join(names, "root").select("id", "root_name", F.col("steps").cast("int").alias("depth"))
    looped = resolved.where("looped").select("id", F.lit("(cycle)").alias("root_name"), F.lit(-1).alias("depth"))
    rows = nodes.select("id", "system_id", "name").join(ended.unionByName(looped), "id", "left")
    return rows.select("system_id", "name", F.coalesce("root_name", "name").alias("root_name"), F.coalesce("depth", F.lit(0)).alias("depth"))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens, their links, and the links as resolved."""
    nodes = _nodes(spark, sf_dir)
    links = stage(token_links(nodes), "links")
    return nodes, links, resolve_links(links)


def _paths(nodes: DataFrame, links: DataFrame, resolved: DataFrame) -> DataFrame:
    named = nodes.join(links.select("id", "parent"), "id", "left").select("id", "parent", "name", "system_id")
    return paths_to_root(named, resolved).join(nodes.select("id", "system_id", "name"), "id")


def _descendants(paths: DataFrame) -> DataFrame:
    rows = paths.select("system_id", "name", "path", F.posexplode("path").alias("pos", "ancestor"))
    rows = rows.withColumn("distance", (F.size("path") - 1 - F.col("pos")).cast("int"))
    return rows.where("distance > 0").select("system_id", F.col("ancestor").alias("name"), F.col("name").alias("derived_name"), "distance")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token's path from its root; tokens on or above a loop have none."""
    return _paths(*_resolved(spark, sf_dir)).select("system_id", "name", F.array_join("path", " > ").alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token and token derived from it, with the distance; without tokens on or above a loop."""
    return _descendants(_paths(*_resolved(spark, sf_dir)))


def p2_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all tokens: a walk into a loop ends where it would come back to a token it has passed."""
    nodes, links, resolved = _resolved(spark, sf_dir)
    ends = looped_ancestors(links, resolved)
    named = ends.join(nodes.select("id", "system_id", F.col("name").alias("derived_name")), "id")
    above = nodes.select(F.col("id").alias("above"), "name")
    looped = named.join(above, "above").select("system_id", "name", "derived_name", F.col("distance").cast("int").alias("distance"))
    return _descendants(_paths(nodes, links, resolved)).unionByName(looped)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_table, record_id, scope, system_id, ref_name, at of all three referring tables.

    A redelivered row has the same references again; who asks counts them once.
    """
    tokens = table(spark, sf_dir, "tokens").select("token_id", "system_id", trimmed(F.col("name")).alias("name"), trimmed(F.col("css_var")).alias("css_var"), "refs", "added_at")
    refs = tokens.select("token_id", "system_id", "added_at", F.explode("refs").alias("ref")).where("ref is not null")
    refs = refs.select("token_id", "system_id", "added_at", ref_kind(F.col("ref")).alias("kind"), ref_key(F.col("ref")).alias("key"))
    css = tokens.where("css_var is not null").groupBy(F.col("system_id").alias("_system"), F.col("css_var").alias("_css")).agg(F.min("name").alias("_name"))
    same = F.col("system_id").eqNullSafe(F.col("_system")) & (F.col("key") == F.col("_css"))
    var = stage(refs.where("kind = 'css'").join(css, same, "left").select("token_id", "system_id", "added_at", F.coalesce("_name", "key").alias("key")), "css-refs")
    by_name = refs.where("kind = 'name'").select("token_id", "system_id", "added_at", "key")

    def shaped(df: DataFrame, name: str, record_id: str, scope: str, ref: str, at: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col(record_id).alias("record_id"), F.lit(scope).alias("scope"), "system_id", F.col(ref).alias("ref_name"), F.col(at).alias("at"))

    chunks = table(spark, sf_dir, "doc_chunks")
    mentions = chunks.select("chunk_id", "system_id", "indexed_at", F.explode("mentions").alias("m")).withColumn("m", trimmed(F.col("m"))).where("m != ''")
    aliases = table(spark, sf_dir, "aliases").where("kind = 'components' and target is not null").withColumn("target", trimmed(F.col("target")))
    return (
        shaped(by_name.unionByName(var), "tokens", "token_id", "tokens", "key", "added_at")
        .unionByName(shaped(mentions, "doc_chunks", "chunk_id", "symbols", "m", "indexed_at"))
        .unionByName(shaped(aliases, "aliases", "alias_id", "symbols", "target", "added_at"))
    )


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda df, scope: df.select(F.lit(scope).alias("scope"), "system_id", trimmed(F.col("name")).alias("name"), "added_at", "removed_at")
    return shape(table(spark, sf_dir, "tokens"), "tokens").unionByName(shape(table(spark, sf_dir, "symbols"), "symbols"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphan_references(references(spark, sf_dir), known_names(spark, sf_dir))
    return found.select("ref_table", "record_id", "ref_name", "reason").distinct()


def p6_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_period(orphan_references(references(spark, sf_dir), known_names(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (p1_found, p1_members, p1_rejected, p2_found, p2_paths, p2_descendants, p2_derived, p6_found, p6_by_period)}

_JSON_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE CAST([] AS JSON[]) END"
_SPACE = "[\\s\\x1c-\\x1f\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _trim(col: str) -> str:
    return f"regexp_replace({col}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _each(source: str, field: str, keep: str, pos: str) -> str:
    """Elements of a JSON field that is an array or a bare object, with their places."""
    listed = _JSON_LIST.format(f"json_extract(j, '$.{field}')")
    return f"SELECT {keep}, unnest(l) AS j, unnest(range(len(l))) AS {pos} FROM (SELECT {keep}, {listed} AS l FROM {source})"


def _text(source: str, field: str) -> str:
    """A field as get_json_object reads it: a string as it is, null as nothing, all else as JSON."""
    at = f"json_extract({source}, '$.{field}')"
    return f"CASE json_type({at}) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string({source}, '$.{field}') ELSE CAST({at} AS VARCHAR) END"


_TOKENS = f"""t AS (SELECT DISTINCT ON (token_id) token_id, system_id, {_trim('name')} AS name, {_trim('css_var')} AS css_var, refs, added_at FROM tokens),
parsed AS (SELECT token_id, system_id, name, added_at, r, {_trim('r')} AS x FROM (SELECT *, unnest(refs) AS r FROM t) WHERE r IS NOT NULL)"""
_INNER = f"CASE WHEN regexp_full_match(x, '(?s)var\\(.*\\)') THEN {_trim('x[5:-2]')} WHEN regexp_full_match(x, '(?s)\\{{.*\\}}') THEN {_trim('x[2:-2]')} ELSE x END"

_P2 = f"""WITH RECURSIVE t AS (SELECT DISTINCT ON (token_id) token_id, system_id, {_trim('name')} AS name, {_trim('css_var')} AS css_var, refs FROM tokens),
f AS (SELECT system_id, name, {_trim('list_filter(refs, lambda r: r IS NOT NULL)[1]')} AS x FROM t),
g AS (SELECT system_id, name, regexp_full_match(x, '(?s)var\\(.*\\)') AS css, {_INNER} AS k FROM f WHERE x IS NOT NULL),
up AS (SELECT g.system_id, g.name, p.name AS parent FROM g JOIN t p ON p.system_id = g.system_id AND (CASE WHEN css THEN p.css_var = k ELSE p.name = k END)),
walk AS (SELECT system_id, name, name AS cur, 0 AS depth FROM t UNION ALL SELECT w.system_id, w.name, up.parent, w.depth + 1 FROM walk w JOIN up ON up.system_id = w.system_id AND up.name = w.cur WHERE w.depth < 400),
ends AS (SELECT system_id, name, max(depth) AS depth, max_by(cur, depth) AS root FROM walk GROUP BY ALL)"""
_P6 = f"""WITH {_TOKENS}, css AS (SELECT system_id AS s, css_var, min(name) AS n FROM t WHERE css_var IS NOT NULL GROUP BY ALL),
inner_ AS (SELECT *, regexp_full_match(x, '(?s)var\\(.*\\)') AS is_css, {_INNER} AS k FROM parsed),
refs_ AS (SELECT 'tokens' AS ref_table, token_id AS record_id, 'tokens' AS scope, i.system_id, CASE WHEN is_css THEN coalesce(css.n, k) ELSE k END AS ref_name, added_at AS tm FROM inner_ i LEFT JOIN css ON is_css AND css.s = i.system_id AND css.css_var = k
UNION SELECT 'doc_chunks', chunk_id, 'symbols', system_id, {_trim('m')}, indexed_at FROM (SELECT *, unnest(mentions) AS m FROM doc_chunks) WHERE {_trim('m')} != ''
UNION SELECT 'aliases', alias_id, 'symbols', system_id, {_trim('target')}, added_at FROM aliases WHERE kind = 'components' AND target IS NOT NULL),
names AS (SELECT DISTINCT 'tokens' AS scope, system_id, {_trim('name')} AS name, added_at, removed_at FROM tokens UNION SELECT DISTINCT 'symbols', system_id, {_trim('name')}, added_at, removed_at FROM symbols),
judged AS (SELECT r.ref_table, r.record_id, r.ref_name, r.tm, count(n.name) AS spans, coalesce(bool_or(n.added_at <= r.tm AND (n.removed_at IS NULL OR n.removed_at > r.tm)), false) AS live, coalesce(bool_or(n.added_at <= r.tm), false) AS begun
FROM refs_ r LEFT JOIN names n ON n.scope = r.scope AND n.system_id = r.system_id AND n.name = r.ref_name GROUP BY ALL),
orphans AS (SELECT ref_table, record_id, ref_name, tm, CASE WHEN spans = 0 THEN 'missing' WHEN NOT begun THEN 'late' ELSE 'deleted' END AS reason FROM judged WHERE NOT live)"""

ORACLES = {
    "p1_found": f"""WITH m0 AS (SELECT DISTINCT ON (record_id) record_id, manifest::JSON AS j FROM custom_elements WHERE json_valid(manifest)),
m1 AS ({_each('m0', 'modules', 'record_id', 'module_pos')}),
m2 AS ({_each('m1', 'declarations', 'record_id, module_pos', 'parent_pos')}),
m3 AS (SELECT *, 'attribute' AS child_kind FROM ({_each('m2', 'attributes', 'record_id, module_pos, parent_pos', 'child_pos')}) UNION ALL SELECT *, 'member' FROM ({_each('m2', 'members', 'record_id, module_pos, parent_pos', 'child_pos')})),
c0 AS (SELECT DISTINCT ON (module_id) module_id, exports FROM catalog_modules),
c1 AS (SELECT module_id, unnest(exports) AS e, unnest(range(len(exports))) AS parent_pos FROM c0),
c2 AS (SELECT module_id, parent_pos, 'prop' AS child_kind, unnest(range(len(e.props))) AS child_pos, unnest(list_transform(e.props, lambda x: x.name)) AS child_name FROM c1
UNION ALL SELECT module_id, parent_pos, 'event', unnest(range(len(e.events))), unnest(list_transform(e.events, lambda x: x.name)) FROM c1)
SELECT 'custom_elements' AS src_table, record_id, CAST(module_pos AS INTEGER) AS module_pos, CAST(parent_pos AS INTEGER) AS parent_pos, child_kind, CAST(child_pos AS INTEGER) AS child_pos, json_extract_string(j, '$.name') AS child_name FROM m3 WHERE json_type(json_extract(j, '$.name')) = 'VARCHAR'
UNION ALL SELECT 'catalog_modules', module_id, 0, CAST(parent_pos AS INTEGER), child_kind, CAST(child_pos AS INTEGER), child_name FROM c2 WHERE child_name IS NOT NULL""",
    "p1_members": f"""WITH m0 AS (SELECT DISTINCT ON (record_id) record_id, manifest::JSON AS j FROM custom_elements WHERE json_valid(manifest)),
m1 AS ({_each('m0', 'modules', 'record_id', 'a')}), m2 AS (SELECT record_id, a, b, j, j AS d FROM ({_each('m1', 'declarations', 'record_id, a', 'b')}) WHERE json_type(j) = 'OBJECT'), m3 AS ({_each('m2', 'members', 'record_id, a, b, d', 'c')})
SELECT record_id, record_id || '/module.' || a || '/declaration.' || b || '/member.' || c AS key, record_id || '/module.' || a || '/declaration.' || b AS parent_key,
{_text('d', 'name')} AS class_name, {_text('d', 'tagName')} AS tag_name, {_text('j', 'name')} AS member_name, {_text('j', 'kind')} AS kind, {_text('j', 'privacy')} AS privacy, TRY_CAST({_text('j', 'static')} AS BOOLEAN) AS static FROM m3 WHERE json_type(j) = 'OBJECT'""",
    "p1_rejected": "SELECT DISTINCT record_id FROM custom_elements WHERE manifest IS NOT NULL AND NOT json_valid(manifest)",
    "p2_found": f"""{_P2} SELECT system_id, name, CASE WHEN depth = 400 THEN '(cycle)' ELSE root END AS root_name, CAST(CASE WHEN depth = 400 THEN -1 ELSE depth END AS INTEGER) AS depth FROM ends""",
    "p2_descendants": f"""{_P2} SELECT w.system_id, w.cur AS name, w.name AS derived_name, CAST(w.depth AS INTEGER) AS distance FROM walk w JOIN ends e ON e.system_id = w.system_id AND e.name = w.name WHERE e.depth < 400 AND w.depth > 0""",
    "p2_derived": f"""{_P2.partition("walk AS")[0]}
seen AS (SELECT system_id, name, name AS cur, [name] AS past FROM t UNION ALL SELECT s.system_id, s.name, up.parent, list_append(s.past, up.parent) FROM seen s JOIN up ON up.system_id = s.system_id AND up.name = s.cur WHERE NOT list_contains(s.past, up.parent))
SELECT system_id, cur AS name, name AS derived_name, CAST(len(past) - 1 AS INTEGER) AS distance FROM seen WHERE len(past) > 1""",
    "p2_paths": f"""{_P2} SELECT w.system_id, w.name, string_agg(w.cur, ' > ' ORDER BY w.depth DESC) AS path FROM walk w JOIN ends e ON e.system_id = w.system_id AND e.name = w.name WHERE e.depth < 400 GROUP BY ALL""",
    "p6_found": f"""{_P6} SELECT DISTINCT ref_table, record_id, ref_name, reason FROM orphans""",
    "p6_by_period": f"""{_P6} SELECT ref_table, strftime(tm, '%Y-%m') AS period, reason, count(*) AS n_refs, count(DISTINCT ref_name) AS n_names FROM orphans GROUP BY ALL""",
}
