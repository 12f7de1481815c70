"""Markdown texts: sections with their trail, patterns, and where names are mentioned."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_BREAK = re.compile(r"\r?\n")


def sections(text: str, title: str) -> list[tuple[str, list[str], str]]:
    """heading, trail and whole body of each section; headings inside fences are text.

    Text before the first heading is a section of its own, called by the first
    heading of level 1, else by `title`. A fence ends at the next fence of its sign.
    """
    heads: list[tuple[int, str]] = []
    bodies: list[list[str]] = [[]]
    sign = ""
    for line in _BREAK.split(text):
        fence = _FENCE.match(line)
        if fence:
            sign = "" if sign == fence[1][0] else sign or fence[1][0]
        head = None if fence or sign else _HEADING.match(line)
        if head:
            heads.append((len(head[1]), head[2].strip()))
            bodies.append([])
        else:
            bodies[-1].append(line)
    whole = ["\n".join(b).strip() for b in bodies]
    out, open_ = [], []
    if whole[0]:
        title = next((h for level, h in heads if level == 1), title)
        out.append((title, [title], whole[0]))
    for (level, head), body in zip(heads, whole[1:]):
        open_ = [o for o in open_ if o[0] < level] + [(level, head)]
        out.append((head, [h for _, h in open_], body))
    return out


SECTIONS = "doc_id string, pos int, heading string, trail array<string>, text string, cut boolean"


def chunked(docs: DataFrame, limit: int = 1200) -> DataFrame:
    """doc_id, pos, heading, trail, text, cut of each section of docs(doc_id, title, text).

    The text is cut at `limit` code points, the feature of the index; `cut` tells
    where. Null texts have no sections. One pass over whole texts, no shuffle.
    """
    schema = pa.schema([("doc_id", pa.string()), ("pos", pa.int32()), ("heading", pa.string()), ("trail", pa.list_(pa.string())), ("text", pa.string()), ("cut", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, title, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(doc, i, h, t, b[:limit], len(b) > limit) for i, (h, t, b) in enumerate(sections(text or "", title or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("string"), "title", "text").mapInArrow(run, SECTIONS)


def name_candidates(text: Column, most_parts: int) -> Column:
    """Every name of up to most_parts dashed parts that stands in a text between word boundaries, each once."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*"), 0))
    def every(run: Column) -> Column:  # noqa: E306
        parts = F.split(run, "-")
        starts = F.sequence(F.lit(1), F.size(parts))
        upto = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_parts), F.size(parts) - i + 1)), lambda n: F.array_join(F.slice(parts, i, n), "-"))
        return F.flatten(F.transform(starts, upto))
    return F.array_distinct(F.flatten(F.transform(runs, every)))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of texts(id, system_id, text) with each name of their system they mention as a whole word.

    Names are words or words joined by dashes; letters outside ASCII bound them.
    The texts' own names are looked up by equality, so nothing is compared with
    every name of a system.
    """
    known = names.where("name is not null").select("system_id", "name").distinct()
    most = known.agg(F.max(F.size(F.split("name", "-")))).first()[0] or 1
    said = texts.select("id", "system_id", F.explode(name_candidates(F.col("text"), most)).alias("name"))
    return said.join(known, ["system_id", "name"])


def _fences_out(line: Column) -> Column:
    return line.rlike(r"^\s*(`{3,}|~{3,})")


def patterns(docs: DataFrame) -> DataFrame:
    """doc_id, title, description, language, code of docs(doc_id, text) read as patterns.

    Front matter wins for title, description and language; else the first heading
    of level 1, the first paragraph outside headings and fences, and the info
    word of the first fence. What is found nowhere is null.
    """
    text = F.regexp_replace("text", "\r\n", "\n")
    front = F.regexp_extract(text, r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    body = F.when(front != "", F.regexp_replace(text, r"(?s)^---[ \t]*\n.*?\n---[ \t]*(?:\n|$)", "")).otherwise(text)
    none = lambda c: F.when(c != "", c)
    meta = lambda k: none(F.regexp_replace(F.trim(F.regexp_extract("front", rf"(?mi)^{k}:[ \t]*(.*)$", 1)), r"^(['\"])(.*)\1$", "$2"))
    df = docs.select("doc_id", front.alias("front"), body.alias("body"))
    start = lambda s: F.struct(s["fence"].alias("fence"), s["lines"].alias("lines"), s["done"].alias("done"))

    def step(s: Column, line: Column) -> Column:
        """One line further: fences toggle, a heading or blank line ends a paragraph that has begun."""
        fence = _fences_out(line)
        stop = line.rlike(r"^#{1,6}\s+") | (F.trim(line) == "")
        skip = s["done"] | (s["fence"] & ~fence)
        return F.struct(
            F.when(s["done"], s["fence"]).otherwise(s["fence"] != fence).alias("fence"),
            F.when(skip | fence | stop, s["lines"]).otherwise(F.concat(s["lines"], F.array(F.trim(line)))).alias("lines"),
            (s["done"] | (~fence & ~s["fence"] & stop & (F.size(s["lines"]) > 0))).alias("done"),
        )

    zero = F.struct(F.lit(False).alias("fence"), F.array().cast("array<string>").alias("lines"), F.lit(False).alias("done"))
    paragraph = F.aggregate(F.split("body", "\n"), start(zero), step, lambda s: F.array_join(s["lines"], " "))
    fence = r"```([^\n`]*)\n([\s\S]*?)```"
    return df.select(
        "doc_id",
        F.coalesce(meta("title"), none(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1))).alias("title"),
        F.coalesce(meta("description"), none(paragraph)).alias("description"),
        F.coalesce(meta("language"), none(F.trim(F.regexp_extract("body", fence, 1)))).alias("language"),
        none(F.regexp_replace(F.regexp_extract("body", fence, 2), "\n$", "")).alias("code"),
    )


def pattern_components(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, system_id, components: the names of its system that the code of patterns(doc_id, system_id, code) has as a tag, sorted.

    A tag is a name after `<` or `</` that a blank, slash or bracket ends; names
    are compared with their case. Patterns without any have no row.
    """
    tags = F.array_distinct(F.regexp_extract_all("code", F.lit(r"</?([A-Za-z][A-Za-z0-9._-]*)(?=[\s/>])"), 1))
    used = patterns.select("doc_id", "system_id", F.explode(tags).alias("name"))
    met = used.join(names.where("name is not null").select("system_id", "name").distinct(), ["system_id", "name"])
    return met.groupBy("doc_id", "system_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("components"))


def changelog_lines(docs: DataFrame) -> DataFrame:
    """id (doc_id, n, heading, raw), system_id, text of the lines of docs(doc_id, system_id, text) that are no heading of level 2 or 3."""
    from pyspark.sql import Window as W

    head = r"^#{2,3}\s+(.*?)\s*#*\s*$"
    lines = docs.select("doc_id", "system_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw"))
    is_head = F.col("raw").rlike(head)
    before = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("heading", F.last(F.when(is_head, F.regexp_extract("raw", head, 1)), ignorenulls=True).over(before)).where(~is_head)
    return lines.select(F.struct("doc_id", "n", "heading", "raw").alias("id"), "system_id", F.col("raw").alias("text"))


def changelog_mentions(docs: DataFrame, names: DataFrame, limit: int = 8) -> DataFrame:
    """system_id, name, rank, doc_id, line, heading, text: changelog lines that name a component.

    docs(doc_id, system_id, text). Only headings of level 2 and 3 count; their own
    lines mention nothing; a line belongs to the last heading before it. The first
    `limit` lines of each name are listed, by document and line.
    """
    from pyspark.sql import Window as W

    found = mentions(changelog_lines(docs), names)
    rank = F.row_number().over(W.partitionBy("system_id", "name").orderBy("id.doc_id", "id.n"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= limit)
    return top.select("system_id", "name", "rank", F.col("id.doc_id").alias("doc_id"), (F.col("id.n") + 1).alias("line"), F.coalesce("id.heading", F.lit("")).alias("heading"), F.trim("id.raw").alias("text"))
