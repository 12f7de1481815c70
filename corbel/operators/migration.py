"""What became of a component or of one of its props: deprecation, replacement, changelog lines, code modifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage, trimmed
from ..sources.catalog import Workspace
from ..sources.markdown import changelog_lines, mentions


def codemods(files: DataFrame, requests: DataFrame) -> DataFrame:
    """query_id, files: the files(system_id, file) of its system whose name holds the component's, in any case, joined by commas.

    File names are looked up by their parts between dots, dashes and slashes, one
    after another, so that nothing is compared with every request; a component
    whose name begins or ends within a part is found only as that whole part.
    """
    parts = F.filter(F.split(F.lower("file"), "[^a-z0-9]+"), lambda w: w != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.array_join(F.slice(parts, i, n), ""))))
    named = files.where("file is not null").select("system_id", "file", F.explode(F.array_distinct(runs)).alias("_key"))
    asked = requests.select("query_id", "system_id", F.regexp_replace(F.lower("component"), "[^a-z0-9]+", "").alias("_key")).where("_key != ''")
    met = asked.join(named, ["system_id", "_key"]).select("query_id", "file").distinct()
    return met.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("files"))


def migrations(ws: Workspace, requests: DataFrame, changelogs: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, status, name, prop, since, replacement, note, lines for requests(query_id, system_id, name).

    name is a component or `Component.prop`. The deprecation of the prop, by its
    exact name or else in any case, goes before that of the component. Status is
    deprecated, mentioned (in a changelog only), none, or missing if the catalog
    has no such component. lines are the first `limit` lines of the system's
    changelogs(doc_id, system_id, text) that name the component or the prop, as
    `heading: text (line)`. Null and blank names are missing.
    """
    name = trimmed(F.col("name"))
    dot = F.instr(name, ".")
    component = F.when(dot > 0, trimmed(F.substring_index(name, ".", 1))).otherwise(name)
    prop = F.when(dot > 0, trimmed(F.substr(name, dot + 1)))
    asked = stage(requests.select("query_id", "system_id", component.alias("component"), prop.alias("prop")), "asked")
    details = ws.exports.select(F.struct("pos", "module_id", "epos", "dir", "display_name").alias("export"), "props", "deprecated")
    found = ws.found_loosely(asked.where("component != ''"), "component").join(details, "export")
    first = lambda test: F.get(F.filter("props", test), F.lit(0))
    of_prop = F.coalesce(first(lambda p: p["name"] == F.col("prop")), first(lambda p: F.lower(p["name"]) == F.lower("prop")))["deprecated"]
    told = F.when(of_prop != "", F.struct(F.lit(None).cast("string").alias("since"), F.lit(None).cast("string").alias("replacement"), of_prop.alias("note"))).otherwise(F.struct("deprecated.since", "deprecated.replacement", "deprecated.note"))
    known = (of_prop != "") | F.col("deprecated").isNotNull()
    found = found.select("query_id", F.col("export.display_name").alias("found"), known.alias("known"), told.alias("d"))

    terms = asked.select("query_id", "system_id", F.explode(F.array_distinct(F.array_compact(F.array("component", "prop")))).alias("name")).where("name != ''")
    lines = mentions(changelog_lines(changelogs), terms.select("system_id", "name").distinct())
    # The first lines of a name are all that any request for it can use.
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("id.doc_id", "id.n"))
    lines = lines.select("system_id", "name", "id").withColumn("_n", rank("system_id", "name")).where(F.col("_n") <= limit).drop("_n")
    said = terms.join(lines, ["system_id", "name"]).select("query_id", "id").distinct().withColumn("rank", rank("query_id")).where(F.col("rank") <= limit)
    text = F.concat(F.when(F.col("id.heading") != "", F.concat("id.heading", F.lit(": "))).otherwise(""), F.trim("id.raw"), F.lit(" ("), F.col("id.n") + 1, F.lit(")"))
    said = said.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))

    df = asked.join(found, "query_id", "left").join(said, "query_id", "left")
    status = F.when(F.col("known"), "deprecated").when(F.col("lines").isNotNull(), "mentioned").when(F.col("found").isNull(), "missing").otherwise("none")
    return df.select("query_id", status.alias("status"), F.coalesce("found", "component").alias("name"), "prop", "d.since", "d.replacement", "d.note", F.coalesce("lines", F.lit("")).alias("lines"))
