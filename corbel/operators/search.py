"""Ranked retrieval in bulk: many requests against the tables of their systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import meaningful, segments, words
from ..session import trimmed
from ..sources.catalog import Workspace

# Scores of the kinds of match.
NAME, ALIAS, CONCEPT, PROP, DESCRIPTION, DOCS = 100, 80, 60, 40, 20, 10
HEADING, COMPONENT, TRAIL, BODY = 100, 90, 50, 10
TITLE, TAG, PART = 100, 60, 50


def top(df: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each request in an order that leaves no ties."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)


def query_words(requests: DataFrame, tokens: Column) -> DataFrame:
    """query_id, system_id, word, copies: the words of each query with how often each occurs."""
    rows = requests.select("query_id", "system_id", F.explode(tokens).alias("word"))
    return rows.groupBy("query_id", "system_id", "word").agg(F.count("*").alias("copies"))


def search_components(ws: Workspace, requests: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, rank, name, dir, score, matched_on for requests(query_id, system_id, query).

    Six kinds of match, by name, alias, concept, prop, description and docs; an
    export's score is its best, its reasons come in that order. Blank queries
    have no hits. Equal scores are ranked by name and directory.
    """
    asked = requests.where(trimmed(F.col("query")) != "")
    tokens = words(F.col("query"))
    counted = query_words(asked, tokens)
    terms = asked.select("query_id", "system_id", F.explode(F.array_distinct(F.concat(tokens, F.array(F.lower(trimmed(F.col("query"))))))).alias("term"))
    hit = lambda df, score, reason, step: df.select("query_id", "export", score.cast("int").alias("score"), reason.alias("reason"), F.lit(step).alias("step"))

    names = ws.exports.select("system_id", F.struct("pos", "module_id", "epos", "dir", "display_name").alias("export"), F.explode(F.array_distinct(F.array(F.lower("display_name"), F.lower("tag_name")))).alias("term"))
    by_name = hit(terms.join(names.where("term is not null"), ["system_id", "term"]), F.lit(NAME), F.lit("name"), 1)

    aliases = ws.aliases.where("kind = 'components' and alias is not null").select("system_id", "alias", "concept", "target", F.lower("alias").alias("term"))
    aliased = ws.found_loosely(terms.join(aliases.where("target is not null"), ["system_id", "term"]), "target")
    by_alias = hit(aliased, F.lit(ALIAS), F.concat(F.lit("alias:"), "alias"), 2)

    concepts = terms.join(aliases.where("target is null and concept is not null"), ["system_id", "term"]).select("query_id", "system_id", "concept").distinct()
    concept_words = concepts.select("query_id", "system_id", "concept", F.explode(words(F.col("concept"))).alias("word"))
    matched = concept_words.join(ws.export_words, ["system_id", "word"]).groupBy("query_id", "export", "concept").agg(F.count("*").alias("n"))
    by_concept = hit(matched, F.lit(CONCEPT) + F.col("n"), F.concat(F.lit("concept:"), "concept"), 3)

    props = ws.exports.select(
        "system_id",
        F.struct("pos", "module_id", "epos", "dir", "display_name").alias("export"),
        F.explode(F.concat(F.coalesce(F.transform("props", lambda p: p["name"]), F.array().cast("array<string>")), F.coalesce("inherited_props", F.array().cast("array<string>")))).alias("prop"),
    )
    by_prop = hit(counted.join(props.where("prop is not null").withColumn("word", F.lower("prop")), ["system_id", "word"]), F.lit(PROP), F.concat(F.lit("prop:"), "prop"), 4)

    described = counted.join(ws.export_words.where("described"), ["system_id", "word"]).groupBy("query_id", "export").agg(F.sum("copies").alias("n"))
    by_description = hit(described, F.lit(DESCRIPTION) + F.col("n"), F.lit("description"), 5)

    # What is mentioned beside a word is made distinct before the queries meet it, however many chunks have the word.
    said = ws.chunks.where("size(mentions) > 0").select("system_id", "mentions", F.explode(F.array_distinct(words(F.concat_ws(" ", "heading", "text")))).alias("word"))
    beside = said.join(counted.select("system_id", "word").distinct(), ["system_id", "word"], "left_semi").select("system_id", "word", F.explode("mentions").alias("mention")).distinct()
    mentioned = counted.join(beside, ["system_id", "word"]).select("query_id", "system_id", "mention").distinct()
    by_docs = hit(ws.found_loosely(mentioned.where("mention is not null"), "mention"), F.lit(DOCS), F.lit("docs"), 6)

    hits = by_name.unionByName(by_alias).unionByName(by_concept).unionByName(by_prop).unionByName(by_description).unionByName(by_docs)
    # Exports of one directory and name are one entry.
    entries = hits.groupBy("query_id", F.col("export.dir").alias("dir"), F.col("export.display_name").alias("name")).agg(
        F.max("score").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("step", "reason"))), lambda r: r["reason"]), " | ").alias("matched_on")
    )
    return top(entries, "query_id", [F.desc("score"), F.asc("name"), F.asc("dir")], limit).select("query_id", "rank", "name", "dir", "score", "matched_on")


def search_docs(ws: Workspace, requests: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, rank, chunk_id, score for requests(query_id, system_id, query, component).

    Heading, trail and body words add up; a mention of `component` adds to the
    score but filters nothing. Equal scores are ranked by path, heading and id.
    """
    counted = query_words(requests, meaningful(words(F.col("query"))))
    tagged = lambda field, text: F.transform(F.array_distinct(words(text)), lambda w: F.struct(F.lit(field).alias("field"), w.alias("word")))
    every = F.concat(tagged("h", F.col("heading")), tagged("t", F.concat_ws(" ", "trail")), tagged("b", F.col("text")))
    index = ws.chunks.select("chunk_id", "system_id", F.explode(every).alias("e")).select("chunk_id", "system_id", "e.word", *[(F.col("e.field") == f).alias(f) for f in "htb"])
    zero = F.lit(0).cast("long")
    matched = counted.join(index, ["system_id", "word"]).select("query_id", "chunk_id", "h", "t", F.when(F.col("b"), F.col("copies")).otherwise(zero).alias("n"), F.lit(False).alias("c"))
    asked = requests.select("query_id", "system_id", F.lower(trimmed(F.col("component"))).alias("m")).where("m != ''")
    mentions = ws.chunks.select("chunk_id", "system_id", F.explode("mentions").alias("m")).select("chunk_id", "system_id", F.lower("m").alias("m")).distinct()
    wanted = asked.join(mentions, ["system_id", "m"]).select("query_id", "chunk_id", F.lit(False).alias("h"), F.lit(False).alias("t"), zero.alias("n"), F.lit(True).alias("c"))
    on = lambda field, score: F.when(F.max(field), score).otherwise(0)
    scored = matched.unionByName(wanted).groupBy("query_id", "chunk_id").agg((on("h", HEADING) + on("c", COMPONENT) + on("t", TRAIL) + F.when(F.sum("n") > 0, BODY + F.sum("n")).otherwise(0)).cast("int").alias("score"))
    ranked = scored.join(ws.chunks.select("chunk_id", "path", "heading"), "chunk_id")
    return top(ranked, "query_id", [F.desc("score"), F.asc("path"), F.asc("heading"), F.asc("chunk_id")], limit).select("query_id", "rank", "chunk_id", "score")


def search_patterns(patterns: DataFrame, requests: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, rank, pattern_id, score for requests(query_id, system_id, query).

    patterns(pattern_id, system_id, title, tags, components, description). Title
    and description overlaps count once, every matching tag and component adds.
    Equal scores are ranked by title and id.
    """
    counted = query_words(requests, meaningful(words(F.col("query"))))
    none = F.array().cast("array<string>")

    def part(kind: str, items: Column, split) -> DataFrame:
        """One row per word of each item; an item is known by its place."""
        rows = patterns.select("pattern_id", "system_id", F.posexplode(items).alias("item", "text"))
        return rows.select("pattern_id", "system_id", F.lit(kind).alias("kind"), "item", F.explode(F.array_distinct(split(F.col("text")))).alias("word"))

    index = (
        part("title", F.array("title"), words)
        .unionByName(part("tag", F.coalesce("tags", none), words))
        .unionByName(part("component", F.coalesce("components", none), segments))
        .unionByName(part("description", F.array("description"), words))
    )
    matched = counted.join(index, ["system_id", "word"]).groupBy("query_id", "pattern_id", "kind", "item").agg(F.sum("copies").alias("n"))
    base = F.when(F.col("kind") == "title", TITLE + F.col("n")).when(F.col("kind") == "tag", TAG).when(F.col("kind") == "component", PART + F.col("n")).otherwise(BODY + F.col("n"))
    scored = matched.groupBy("query_id", "pattern_id").agg(F.sum(base).cast("int").alias("score"))
    ranked = scored.join(patterns.select("pattern_id", "title"), "pattern_id")
    return top(ranked, "query_id", [F.desc("score"), F.asc("title"), F.asc("pattern_id")], limit).select("query_id", "rank", "pattern_id", "score")


def resolve_components(ws: Workspace, requests: DataFrame) -> DataFrame:
    """query_id, status, name, nearest for requests(query_id, system_id, query).

    The exact name, then any case, then the first alias with a target, if that
    exists; else the status is missing and the three nearest are listed. A miss
    is a row, never a guess; a blank query is a miss with none near.
    """
    named = ws.found_loosely(requests, "query").select("query_id", "how", F.col("export.display_name").alias("found"))
    left = requests.join(named, "query_id", "left_anti").withColumn("term", F.lower(trimmed(F.col("query"))))
    first = ws.aliases.where("kind = 'components' and target is not null and alias is not null").groupBy("system_id", F.lower("alias").alias("term")).agg(F.min_by("target", F.struct("pos", "alias_id")).alias("target"))
    aliased = ws.found_loosely(left.join(first, ["system_id", "term"]), "target").select("query_id", F.col("export.display_name").alias("meant"))
    missing = left.join(aliased, "query_id", "left_anti")
    near = search_components(ws, missing.select("query_id", "system_id", "query"), 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("n"))
    near = near.select("query_id", F.array_join(F.transform("n", lambda x: x["name"]), ", ").alias("nearest"))
    df = requests.select("query_id").join(named, "query_id", "left").join(aliased, "query_id", "left").join(near, "query_id", "left")
    status = F.when(F.col("how").isNotNull(), F.col("how")).when(F.col("meant").isNotNull(), "alias").otherwise("missing")
    return df.select("query_id", status.alias("status"), F.coalesce("found", "meant").alias("name"), F.when(status == "missing", F.coalesce("nearest", F.lit(""))).alias("nearest"))


def component_details(ws: Workspace, requests: DataFrame) -> DataFrame:
    """query_id, name, n_props, n_events, n_slots, mistakes of each export asked for.

    Mistakes are the team's prop aliases whose target is a prop of the export:
    `alias -> target`, in the order of the alias list.
    """
    found = ws.found_loosely(requests, "query").select("query_id", "system_id", "export")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    none = F.array().cast("array<string>")
    detail = ws.exports.select(
        F.struct("pos", "module_id", "epos", "dir", "display_name").alias("export"),
        count("props").alias("n_props"),
        count("events").alias("n_events"),
        count("slots").alias("n_slots"),
        F.array_distinct(F.concat(F.coalesce(F.transform("props", lambda p: p["name"]), none), F.coalesce("inherited_props", none))).alias("known"),
    )
    rows = found.join(detail, "export")
    team = ws.aliases.where("kind = 'props' and source = 'team' and alias is not null and target is not null").select("system_id", "target", F.struct("pos", "alias_id", F.concat("alias", F.lit(" -> "), "target").alias("m")).alias("a"))
    mistakes = rows.select("query_id", "system_id", F.explode("known").alias("target")).join(team, ["system_id", "target"]).groupBy("query_id").agg(F.array_sort(F.collect_list("a")).alias("a"))
    mistakes = mistakes.select("query_id", F.array_join(F.transform("a", lambda x: x["m"]), "; ").alias("mistakes"))
    return rows.join(mistakes, "query_id", "left").select("query_id", F.col("export.display_name").alias("name"), "n_props", "n_events", "n_slots", F.coalesce("mistakes", F.lit("")).alias("mistakes"))
