"""Code snippets checked against the catalog of their system: only real names, props and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import camel, kebab, literal_union, raw_values, spellings, universal_attribute
from ..session import stage
from ..sources.catalog import Workspace
from ..sources.markup import elements, imported, language
from .merge import first_by
from .tokens import nearest_colors, nearest_lengths, resolved_values

# Fixed value: what a style entry is if it is a raw colour or length as a whole.
RAW_VALUE = r"(?i)^(#([0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{4}|[0-9a-f]{3})|(rgba?|hsla?)\([^)]*\)|-?\d*\.?\d+px)$"
# Fixed value: names of elements that show an icon only.
ICON_ONLY = "(?i)IconButton|Icon-only|icon-button"
COLUMNS = ["snippet_id", "el", "line", "kind", "severity", "subject", "message", "fix"]


def _finding(df: DataFrame, kind: str, severity: Column, subject: Column, message: Column, fix: Column) -> DataFrame:
    return df.select("snippet_id", "el", "line", F.lit(kind).alias("kind"), severity.alias("severity"), subject.alias("subject"), message.alias("message"), fix.cast("string").alias("fix"))


def casing_match(pool: Column, name: Column) -> Column:
    """The pool's entry that name means: exact, in any case, in camel or in kebab case."""
    first = lambda test: F.get(F.filter(pool, test), F.lit(0))
    return F.coalesce(first(lambda p: p == name), first(lambda p: F.lower(p) == F.lower(name)), first(lambda p: p == camel(name)), first(lambda p: p == kebab(name)))


def catalog_of(ws: Workspace) -> DataFrame:
    """system_id, name, props, allowed, deprecated of each export name, the first by position."""
    none = F.array().cast("array<string>")
    names = F.filter(F.transform("props", lambda p: p["name"]), lambda n: n.isNotNull())
    own = first_by(ws.exports, ["system_id", "display_name"], ["pos", "module_id", "epos"])
    return own.select(
        "system_id", F.col("display_name").alias("name"), F.filter("props", lambda p: p.isNotNull() & p["name"].isNotNull()).alias("props"),
        F.array_distinct(F.concat(spellings(F.coalesce(names, none)), F.coalesce("inherited_props", none))).alias("allowed"), "deprecated",
    )


def resolved_elements(ws: Workspace, snippets: DataFrame) -> DataFrame:
    """Elements with the export they mean: tags with a dash, and local names imported from the system's package.

    snippets(snippet_id, system_id, code). resolved is documented, undocumented,
    unknown or, for all other elements, null.
    """
    systems = snippets.select(F.col("snippet_id").cast("string").alias("snippet_id"), "system_id", language(F.col("code")).alias("language"))
    els = elements(snippets).join(systems, "snippet_id")
    bound = imported(snippets).where("local_name is not null").select(F.col("snippet_id").alias("_s"), F.col("local_name").alias("_l"), F.coalesce("real_name", "local_name").alias("_real"), "module")
    base = F.substring_index("tag", ".", 1)
    els = els.join(bound, (F.col("snippet_id") == F.col("_s")) & (base == F.col("_l")), "left")
    ours = (F.col("module") == F.col("system_id")) | F.col("module").startswith(F.concat("system_id", F.lit("/")))
    meant = F.when(F.col("tag").contains("-"), F.col("tag")).when((F.col("language") == "tsx") & ours, F.col("_real"))
    els = stage(els.withColumn("meant", meant).drop("_s", "_l", "_real"), "elements")
    # Plain elements mean nothing: they stay out of the joins, where they would all share one key.
    named, plain = els.where("meant is not null"), els.where("meant is null")
    cat = catalog_of(ws).select(F.col("system_id").alias("_cs"), F.col("name").alias("_cn"), "props", "allowed", "deprecated")
    known = ws.symbols.select(F.col("system_id").alias("_ks"), F.col("name").alias("_kn")).distinct()
    named = named.join(cat, (F.col("system_id") == F.col("_cs")) & (F.col("meant") == F.col("_cn")), "left").join(known, (F.col("system_id") == F.col("_ks")) & (F.col("meant") == F.col("_kn")), "left")
    how = F.when(F.col("_cn").isNotNull(), "documented").when(F.col("_kn").isNotNull(), "undocumented").otherwise("unknown")
    named = named.withColumn("resolved", how).drop("_cs", "_cn", "_ks", "_kn")
    return stage(named.unionByName(plain, allowMissingColumns=True), "resolved")


def check_elements(ws: Workspace, els: DataFrame) -> DataFrame:
    """Findings on elements: unknown and deprecated components, props, values and names."""
    unknown = els.where("resolved = 'unknown' and module is null")
    real = els.where("resolved = 'documented'")
    told = F.concat_ws(", ", F.concat(F.lit("since "), "deprecated.since"), F.concat(F.lit("use "), "deprecated.replacement"), "deprecated.note")
    old = F.concat(F.lit("'"), "meant", F.lit("' is deprecated"), F.when(told != "", F.concat(F.lit(": "), told)).otherwise(""), F.lit("."))
    out = _finding(unknown, "unknown-component", F.lit("error"), F.col("meant"), F.concat(F.lit("Unknown component '"), "meant", F.lit("'")), F.lit(None))
    out = out.unionByName(_finding(real.where("deprecated is not null"), "deprecated", F.lit("warning"), F.col("meant"), old, F.col("deprecated.replacement")))

    attrs = real.where("not spread").select("snippet_id", "el", "line", "system_id", "meant", "props", "allowed", F.explode("attrs").alias("a"))
    attrs = attrs.where(~universal_attribute(F.col("a.name"), F.lit(True)))
    subject = F.concat("meant", F.lit("."), "a.name")
    own = F.get(F.filter("props", lambda p: p["name"].isin(F.col("a.name"), camel(F.col("a.name")), kebab(F.col("a.name")))), F.lit(0))
    known = attrs.where(F.array_contains("allowed", F.col("a.name"))).withColumn("p", own)
    note = F.concat(F.lit("'"), "a.name", F.lit("' on "), "meant", F.lit(" is deprecated: "), "p.deprecated")
    out = out.unionByName(_finding(known.where("p.deprecated != ''"), "deprecated", F.lit("warning"), subject, note, F.col("p.deprecated")))

    value, kind, members = F.col("a.value"), F.trim("p.type"), literal_union(F.trim("p.type"))
    wrong = (
        F.when(kind == "boolean", F.when(~value.isin("true", "false"), "expected true or false"))
        .when(kind == "number", F.when((F.trim(value) == "") | value.try_cast("double").isNull(), "expected a number"))
        .when(~F.array_contains(members, value), F.concat(F.lit("expected one of "), F.array_join(members, ", ")))
    )
    judged = known.where("a.value is not null").withColumn("wrong", wrong).where("wrong is not null")
    strict = ~kind.isin("boolean", "number")
    close = F.get(F.filter(members, lambda m: F.lower(m) == F.lower(value)), F.lit(0))
    text = F.concat(F.lit("Invalid value '"), value, F.lit("' for "), "a.name", F.lit(" on <"), "meant", F.lit(">: "), "wrong")
    fix = F.when(strict, F.coalesce(F.concat(F.lit("use '"), close, F.lit("' instead")), F.concat(F.lit("one of "), F.array_join(members, ", "))))
    out = out.unionByName(_finding(judged, "invalid-value", F.when(strict, "error").otherwise("warning"), subject, text, fix))

    team = ws.aliases.where("kind = 'props' and source = 'team' and alias is not null").groupBy(F.col("system_id").alias("_s"), F.lower("alias").alias("_a")).agg(F.min_by("target", F.struct("pos", "alias_id")).alias("_t"))
    invented = attrs.where(~F.array_contains("allowed", F.col("a.name"))).join(team, (F.col("system_id") == F.col("_s")) & (F.lower("a.name") == F.col("_a")), "left")
    best = F.coalesce(casing_match(F.col("allowed"), F.col("_t")), casing_match(F.col("allowed"), F.col("a.name")))
    text = F.concat(F.lit("Invented prop '"), "a.name", F.lit("' on "), "meant")
    out = out.unionByName(_finding(invented, "invented-prop", F.lit("warning"), subject, text, F.concat(F.lit("use '"), best, F.lit("' instead"))))

    labelled = F.exists("attrs", lambda a: a["name"].isin("aria-label", "aria-labelledby", "title", "label") & (F.trim(F.coalesce(a["value"], F.lit(""))) != ""))
    nameless = real.where(F.col("meant").rlike(ICON_ONLY) & ~labelled & ~F.col("has_children"))
    return out.unionByName(_finding(nameless, "missing-accessible-name", F.lit("error"), F.col("meant"), F.concat(F.lit("'"), "meant", F.lit("' needs an accessible name")), F.lit(None)))


def check_raw_values(ws: Workspace, els: DataFrame) -> DataFrame:
    """Raw colours and lengths in class and style attributes, with the nearest token as the fix."""
    one = F.lower("a.name") == "style"
    attrs = els.select("snippet_id", "el", "line", "system_id", "tag", F.explode("attrs").alias("a")).where(one | F.col("a.name").isin("class", "className"))
    entry = lambda d: F.struct(F.concat(F.lit("style."), F.trim(F.regexp_extract(d, r"^([^:]*):", 1))).alias("where"), F.trim(F.regexp_replace(d, r"^[^:]*:", "")).alias("raw"))
    whole = F.filter(F.transform(F.split("a.value", ";"), entry), lambda v: v["raw"].rlike(RAW_VALUE))
    parts = F.transform(raw_values(F.col("a.value")), lambda v: F.struct(F.col("a.name").alias("where"), v.alias("raw")))
    found = attrs.where("a.value is not null").withColumn("r", F.explode(F.when(one, whole).otherwise(parts))).select("*", "r.where", "r.raw")
    asked = found.select("system_id", F.col("raw").alias("query")).distinct().withColumn("query_id", F.xxhash64("system_id", "query"))
    asked, values = stage(asked, "raw-values"), stage(resolved_values(ws.tokens), "values")
    near = nearest_colors(ws.tokens, asked, 1, values).select("query_id", "token_id").unionByName(nearest_lengths(ws.tokens, asked, 1, values).select("query_id", "token_id"))
    write = F.when(F.col("css_var").isNotNull(), F.concat(F.lit("use var("), "css_var", F.lit(")"))).otherwise(F.concat(F.lit("use "), "name"))
    fixes = near.join(ws.tokens.select("token_id", write.alias("fix")), "token_id").select("query_id", F.col("fix").alias("_fix"))
    rows = found.withColumn("query_id", F.xxhash64("system_id", "raw")).join(fixes, "query_id", "left")
    text = F.concat(F.lit("Raw value '"), "raw", F.lit("' in "), "where")
    return _finding(rows, "raw-value", F.lit("warning"), F.col("tag"), text, F.coalesce("_fix", F.lit("use a design token")))


def check_imports(ws: Workspace, snippets: DataFrame, allowed: tuple[str, ...] = ("react", "react-dom")) -> DataFrame:
    """Imports from foreign packages, and imported names that the system's package does not have.

    The system's id stands for its package; relative imports are fine, so are
    `allowed` packages; a subpath counts as its package. Default and namespace
    imports have no name to check.
    """
    rows = imported(snippets).join(snippets.select(F.col("snippet_id").cast("string").alias("snippet_id"), "system_id"), "snippet_id").withColumn("el", F.lit(-1))
    within = lambda pkg: (F.col("module") == pkg) | F.col("module").startswith(F.concat(pkg, F.lit("/")))
    fine = F.col("module").rlike(r"^\.\.?(/|$)") | within(F.col("system_id"))
    for pkg in allowed:
        fine = fine | within(F.lit(pkg))
    foreign = rows.where(~fine).select("snippet_id", "el", "line", "module").distinct()
    out = _finding(foreign, "disallowed-import", F.lit("error"), F.col("module"), F.concat(F.lit("Disallowed import '"), "module", F.lit("'")), F.lit(None))
    named = rows.where(within(F.col("system_id")) & F.col("real_name").isNotNull())
    missing = named.join(ws.symbols.select("system_id", F.col("name").alias("real_name")).distinct(), ["system_id", "real_name"], "left_anti")
    text = F.concat(F.lit("Unknown component '"), "real_name", F.lit("' imported from '"), "module", F.lit("'"))
    return out.unionByName(_finding(missing, "unknown-component", F.lit("error"), F.col("real_name"), text, F.lit(None)))


def check_usage(ws: Workspace, snippets: DataFrame) -> DataFrame:
    """All findings on snippets(snippet_id, system_id, code); clean snippets give none."""
    els = resolved_elements(ws, snippets)
    return check_elements(ws, els).unionByName(check_raw_values(ws, els)).unionByName(check_imports(ws, snippets))


def usage_report(ws: Workspace, snippets: DataFrame) -> DataFrame:
    """check_usage with the `rank` of each finding in its snippet: by line, then kind, then element."""
    order = [F.asc("line"), F.asc("kind"), F.asc("subject"), F.asc("fix"), F.asc("el"), F.asc("message")]
    return check_usage(ws, snippets).withColumn("rank", F.row_number().over(W.partitionBy("snippet_id").orderBy(*order)))


def used_components(ws: Workspace, snippets: DataFrame) -> DataFrame:
    """snippet_id and the real components it uses, sorted."""
    used = resolved_elements(ws, snippets).where("resolved in ('documented', 'undocumented')")
    return used.groupBy("snippet_id").agg(F.array_join(F.array_sort(F.collect_set("meant")), " ").alias("components"))
