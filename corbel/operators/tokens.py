"""Design tokens: values through var() chains, nearest values, words, natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.color import color_distance, parse_color, parse_px
from ..functions.text import natural_key, segments, words
from ..session import stage
from .by_system import ByWords, Listed, answered

_VAR = r"^var\((--[\w-]+)\)$"


def resolved_values(tokens: DataFrame, hops: int = 5) -> DataFrame:
    """token_id, system_id, category, pos, theme_pos, theme, value: each token's value by default and per theme.

    A value var(--x) is replaced by that of the token with this css variable, in
    the same theme if it has one, over at most `hops` links. A link to nowhere, to
    itself, or one more than that gives no row; so does a null value. theme_pos
    counts from 1, the default has 0 and a null theme.
    """
    keep = ["token_id", "system_id", "category", "pos"]
    tokens = stage(tokens.select(*keep, "css_var", "value", "values_by_theme"), "tokens")
    themed = F.coalesce("values_by_theme", F.array().cast("array<struct<theme:string,value:string>>"))
    ways = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("theme"), F.col("value"))), themed)
    state = tokens.select(*keep, F.posexplode(ways).alias("theme_pos", "w")).select(
        *keep, "theme_pos", "w.theme", F.coalesce("w.value", F.lit(None)).alias("value"), F.col("token_id").alias("at")
    )
    index = tokens.where("css_var is not null").groupBy(F.col("system_id").alias("_system"), F.col("css_var").alias("_css")).agg(
        F.min_by(F.struct("token_id", "value", "values_by_theme"), F.struct("pos", "token_id")).alias("_t")
    )
    index = stage(index, "css-variables")
    link = F.regexp_extract(F.trim("value"), _VAR, 1)
    linked = F.coalesce(link, F.lit("")) != ""
    done = state.where(~linked)
    going = stage(state.where(linked), "linked")
    for _ in range(hops):
        # Only values that are links look further; after a round or two there are none.
        if going.isEmpty():
            break
        joined = going.withColumn("_link", link).join(index, (F.col("_link") == F.col("_css")) & (F.col("system_id") == F.col("_system")))
        own = F.get(F.filter("_t.values_by_theme", lambda v: v["theme"] == F.col("theme")), F.lit(0))["value"]
        now = joined.where(F.col("_t.token_id") != F.col("at")).select(*keep, "theme_pos", "theme", F.coalesce(own, "_t.value").alias("value"), F.col("_t.token_id").alias("at"))
        now = stage(now, "linked")
        done, going = done.unionByName(now.where(~linked)), now.where(linked)
    return done.where("value is not null").select(*keep, "theme_pos", "theme", "value")


def _asked(requests: DataFrame) -> DataFrame:
    """requests with a category, null where any will do."""
    return requests if "category" in requests.columns else requests.withColumn("category", F.lit(None).cast("string"))


# Groups of more places than this begin with narrower cells.
DENSE = 2_000


def _color_width(places: Column) -> Column:
    """The width of cells of which three by three by three hold a few hundred colours on average, a power of two."""
    return F.greatest(F.lit(2.0), 256 / F.pow(F.lit(2.0), F.ceil(F.log2(F.cbrt(places / 20)))))


def _around(own: Column, reach: int, dimensions: int) -> Column:
    """The coordinates of all cells up to reach away from a cell in each direction."""
    every = F.array(F.array().cast("array<int>"))

    def wider(cells: Column, steps: Column) -> Column:
        return F.flatten(F.transform(cells, lambda cell: F.transform(steps, lambda v: F.concat(cell, F.array(v)))))

    for d in range(dimensions):
        every = wider(every, F.sequence(own[d] - reach, own[d] + reach))
    return every


def _nearest(requests: DataFrame, points: DataFrame, cell, distance, width: float, limit: int, narrow=None) -> DataFrame:
    """query_id, rank, token_id, distance, theme of the `limit` nearest tokens of each request.

    requests(query_id, grp, wanted), points(grp, token_id, pos, theme_pos, theme,
    place). Equal requests are answered once, and of the tokens at one place only
    the first `limit` can be among the nearest. Space is cut into cells of a width;
    cell(column, width) gives a place's coordinates. A request first meets its own cell and
    those next to it: if its last token is no farther than these reach in every
    direction, none outside is nearer. Groups of many places begin with cells of
    the width narrow(places), if given. Only requests that are still open, as in
    groups with few places, meet all places of their group.
    """
    at = ["grp", "place"]
    tokens = points.groupBy(*at, "pos", "token_id").agg(F.min(F.struct("theme_pos", "theme")).alias("w"))
    first = W.partitionBy(*at).orderBy("pos", "token_id")
    kept = tokens.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit)
    kept = stage(kept.select(*at, "pos", "token_id", "w.*"), "places")
    found, open_ = None, stage(requests.select("grp", "wanted").distinct(), "asked")
    dimensions = 1 if dict(requests.dtypes)["wanted"] == "double" else 3
    rounds = [F.lit(width), None]
    if narrow is not None:
        dense = stage(kept.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("grp", narrow(F.col("n")).alias("width")), "dense")
        rounds = rounds if dense.isEmpty() else [dense, *rounds]
    for of in rounds:
        wide = lambda df: df.join(of, "grp") if isinstance(of, DataFrame) else df.withColumn("width", of)  # noqa: B023, E731
        if of is None:
            met = open_.join(kept, "grp")
        else:
            around = wide(open_).withColumn("cell", F.explode(_around(cell(F.col("wanted"), F.col("width")), 1, dimensions))).drop("width")
            met = around.join(wide(kept).withColumn("cell", cell(F.col("place"), F.col("width"))), ["grp", "cell"])
        near = F.min(F.struct(distance(F.col("place"), F.col("wanted")).alias("distance"), "theme_pos", "theme")).alias("n")
        each = met.groupBy("grp", "wanted", "pos", "token_id").agg(near)
        order = W.partitionBy("grp", "wanted").orderBy("n.distance", "pos", "token_id")
        ranked = each.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= limit)
        ranked = ranked.select("grp", "wanted", "rank", "token_id", "n.distance", "n.theme")
        if of is not None:
            ranked = stage(ranked, "near")
            closed = wide(ranked.groupBy("grp", "wanted").agg(F.max("rank").alias("n"), F.max("distance").alias("d"))).where((F.col("n") == limit) & (F.col("d") <= F.col("width"))).select("grp", "wanted")
            ranked, open_ = ranked.join(closed, ["grp", "wanted"], "left_semi"), stage(open_.join(closed, ["grp", "wanted"], "left_anti"), "asked")
        found = ranked if found is None else found.unionByName(ranked)
        if open_.isEmpty():
            break
    return requests.join(found, ["grp", "wanted"]).select("query_id", "rank", "token_id", F.round("distance", 6).alias("distance"), "theme")


def nearest_colors(tokens: DataFrame, requests: DataFrame, limit: int = 6, resolved: DataFrame | None = None) -> DataFrame:
    """query_id, rank, token_id, distance, theme for requests(query_id, system_id, query[, category]) that are colours.

    Only colour tokens compete, each with its nearest theme, the first of equal
    ones; a request for another category has none. Queries that are no colour have
    no rows; ties go by position and id. resolved may hold the tokens' resolved_values.
    """
    asked = _asked(requests).where("category is null or category = 'color'").select("query_id", F.col("system_id").alias("grp"), parse_color(F.col("query")).alias("wanted")).where("wanted is not null")
    values = stage(resolved_values(tokens), "values") if resolved is None else resolved
    points = values.where("category = 'color'").select(F.col("system_id").alias("grp"), "token_id", "pos", "theme_pos", "theme", parse_color(F.col("value")).alias("place")).where("place is not null")
    return _nearest(asked, points, lambda c, width: F.array(*[F.floor(c[k] / width).cast("int") for k in "rgb"]), color_distance, 64, limit, _color_width)


def nearest_lengths(tokens: DataFrame, requests: DataFrame, limit: int = 6, resolved: DataFrame | None = None) -> DataFrame:
    """query_id, rank, token_id, distance for requests(query_id, system_id, query[, category]) that are lengths.

    Space, size and radius tokens, or those of them that are asked for, compete
    with their default value. resolved may hold the tokens' resolved_values.
    """
    group = lambda category: F.struct("system_id", category.alias("category"))
    asked = _asked(requests).select("query_id", group(F.coalesce("category", F.lit("*"))).alias("grp"), parse_px(F.col("query")).alias("wanted")).where("wanted is not null")
    values = stage(resolved_values(tokens), "values") if resolved is None else resolved
    px = values.where("theme_pos = 0 and category in ('space', 'size', 'radius')").withColumn("category", F.explode(F.array(F.lit("*"), "category")))
    points = px.select(group(F.col("category")).alias("grp"), "token_id", "pos", "theme_pos", "theme", parse_px(F.col("value")).alias("place")).where("place is not null")
    return _nearest(asked, points, lambda c, width: F.array(F.floor(c / width).cast("int")), lambda a, b: F.abs(a - b), 16, limit).drop("theme")


def find_tokens(tokens: DataFrame, requests: DataFrame, limit: int = 6) -> DataFrame:
    """query_id, rank, token_id, how, score for requests(query_id, system_id, query[, category]).

    A colour finds the nearest colours, a length the nearest lengths (score is the
    distance), anything else the tokens by words (score is theirs).
    """
    requests = stage(_asked(requests), "requests")
    values = stage(resolved_values(tokens), "values")
    color, px = parse_color(F.col("query")).isNotNull(), parse_px(F.col("query")).isNotNull()
    shaped = lambda df, how, score: df.select("query_id", "rank", "token_id", F.lit(how).alias("how"), F.col(score).cast("double").alias("score"))
    out = shaped(nearest_colors(tokens, requests, limit, values), "color", "distance").unionByName(shaped(nearest_lengths(tokens, requests.where(~color), limit, values), "length", "distance"))
    return out.unionByName(shaped(tokens_by_words(tokens, requests.where(~color & ~px), limit), "words", "score"))


def tokens_by_words(tokens: DataFrame, requests: DataFrame, limit: int = 6) -> DataFrame:
    """query_id, rank, token_id, score for requests(query_id, system_id, query[, category]) in words.

    30 for every part of the name that is asked for, repeated parts again, 15 for
    the category, 10 once for the description. Ties go by position and id.
    """
    asked = _asked(requests).select("system_id", "query_id", "category", F.array_distinct(words(F.col("query"))).alias("words"))
    parts = tokens.select("system_id", "token_id", "category", "pos", segments(F.col("name")).alias("words"), F.array_distinct(words(F.col("description"))).alias("more"))
    return answered(asked, parts, ["pos", "token_id"], lambda: ByWords(limit), _answer(requests, tokens, "score int"))


def _answer(requests: DataFrame, tokens: DataFrame, last: str) -> StructType:
    """query_id, rank, token_id with the types these have, and one more column."""
    ids = [StructField(c, df.schema[c].dataType) for c, df in (("query_id", requests), ("token_id", tokens))]
    return StructType([ids[0], StructField("rank", IntegerType()), ids[1], *StructType.fromDDL(last).fields])


def listed_tokens(tokens: DataFrame, requests: DataFrame, limit: int = 40) -> DataFrame:
    """query_id, rank, token_id, name: tokens with any query word in name or description, in natural order.

    requests(query_id, system_id, query[, category]); a category leaves only its tokens.
    """
    asked = _asked(requests).select("system_id", "query_id", "category", F.array_distinct(words(F.col("query"))).alias("words"))
    known = tokens.select("system_id", "token_id", "category", F.array_distinct(F.concat(segments(F.col("name")), words(F.col("description")))).alias("words"), F.col("name").alias("more"))
    known = known.withColumn("_key", natural_key(F.col("more")))
    return answered(asked, known, ["_key", "more", "token_id"], lambda: Listed(limit), _answer(requests, tokens, "name string"))
