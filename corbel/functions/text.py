"""Column functions over names and prose. A null gives null, or an empty list where a list is due."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are left out of topics and needs.
STOPWORDS = (
    "a an the and or of to in on for with is are be it this that i we you my our do does did can could should would will when how "
    "what which why where use using used not no if as at by from about"
).split()
# Attributes every element may have.
UNIVERSAL_ATTRIBUTES = "key ref children className style id slot hidden title role tabIndex tabindex lang dir part".split()


def _none() -> Column:
    return F.array().cast("array<string>")


def words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; everything else separates."""
    return F.coalesce(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""), _none())


def segments(c: Column) -> Column:
    """Parts of a name between - _ . and before each capital, in lower case."""
    return F.coalesce(F.filter(F.transform(F.split(c, "(?=[A-Z])|[-_.]+"), F.lower), lambda w: w != ""), _none())


def path_words(c: Column) -> Column:
    """Parts of a token path: split only where a capital follows a small letter or digit."""
    split = F.split(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2"), r"[-_.\s]+")
    return F.coalesce(F.filter(F.transform(split, F.lower), lambda w: w != ""), _none())


def meaningful(tokens: Column) -> Column:
    """The words without stop words, or all of them if only stop words are left."""
    kept = F.filter(tokens, lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def overlap(query: Column, known: Column) -> Column:
    """How many of the query words are known; repeated query words count again."""
    return F.size(F.filter(query, lambda w: F.array_contains(known, w)))


def kebab(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2"))


def camel(c: Column) -> Column:
    """first-second to firstSecond; a dash that no letter or digit follows stays."""
    parts = F.split(c, "-(?=[a-zA-Z0-9])")
    upper = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), upper), ""))


def spellings(names: Column) -> Column:
    """Each name as it is, in camel and in kebab case, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n, camel(n), kebab(n))))))


def prop_key(c: Column) -> Column:
    """Key under which an attribute and a field are the same prop."""
    return F.translate(F.lower(c), "-", "")


def literal_union(c: Column) -> Column:
    """Members of a type such as 'sm' | 'md'; null for any other type."""
    parts = F.filter(F.transform(F.split(c, r"\|"), lambda p: F.trim(p)), lambda p: p != "undefined")
    quoted = r"^(['\"])(.*)\1$"
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(quoted)), F.transform(parts, lambda p: F.regexp_extract(p, quoted, 2)))


def raw_values(c: Column) -> Column:
    """Raw colours, colour functions and bracketed px lengths in a text, each once."""
    # The three forms.
    hexes = F.regexp_extract_all(c, F.lit(r"(#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{4}|[0-9a-fA-F]{3}))(?![0-9A-Za-z_])"), 1)
    calls = F.regexp_extract_all(c, F.lit(r"(?i)(?<![0-9A-Za-z_])((?:rgba?|hsla?)\([^)]*\))"), 1)
    lengths = F.regexp_extract_all(c, F.lit(r"\[[^\]]*?(-?\d*\.?\d+px)[^\]]*?\]"), 1)
    return F.array_distinct(F.concat(hexes, calls, lengths))


def universal_attribute(c: Column, custom_elements: Column) -> Column:
    """Attributes that need no entry in a catalog."""
    return c.isin(UNIVERSAL_ATTRIBUTES) | ((c == "class") & custom_elements) | c.rlike("^(data-|aria-|on[A-Z]|on-|@)")


def describe_match(reason: Column) -> Column:
    """What the first reason of a hit says of it."""
    rest = lambda kind: F.concat(F.lit(f"{kind} "), F.substr(reason, F.lit(len(kind) + 2)))
    named = F.when(F.coalesce(reason, F.lit("")) == "", "match").when(reason == "name", "name match").when(reason.startswith("alias:"), rest("alias"))
    return named.when(reason.startswith("concept:"), "concept").when(reason.startswith("prop:"), rest("prop")).otherwise(reason)


def natural_key(c: Column) -> Column:
    """Sort key under which space-2 comes before space-10, whatever the case."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(\d+)", "0000000000$1"), r"0*(\d{10})(?!\d)", "$1")


def line_at(c: Column, offset: Column) -> Column:
    """Line number of a place in a text: one more than the line ends before it."""
    head = F.substr(c, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
