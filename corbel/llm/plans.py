"""The pN_ queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import once, stage, table, trimmed
from . import canonical, encodings, leakage, packing, splitting, terms

_SPACE = "[\\s\\x1c-\\x1f\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _trim(col: str) -> str:
    return f"regexp_replace({col}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized documentation chunks, with the chunk's trail."""
    return splitting.split_oversized(table(spark, sf_dir, "doc_chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece_no = 0").select("chunk_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = once(table(spark, sf_dir, "doc_chunks").select("chunk_id", "mentions"), "chunk_id")
    by_mention = terms.array_frequency(chunks.select(F.filter(F.transform("mentions", trimmed), lambda m: m != "").alias("terms")))
    lexicon = once(table(spark, sf_dir, "convention_lexicon").select("lexicon_id", "expected", "occurrences"), "lexicon_id")
    expected = lexicon.select(F.col("lexicon_id").alias("record_id"), trimmed(F.col("expected")).alias("term"), F.col("occurrences").alias("n"))
    by_expected = terms.term_frequency(expected.where("term != ''"))
    mentions_marked = terms.marked(by_mention, "n_records", 2, chunks.agg(F.count("*")).scalar(), 200)
    expected_marked = terms.marked(by_expected, "n_total", 2, lexicon.agg(F.sum("occurrences")).scalar(), 100)
    shaped = lambda df, field: df.select(F.lit(field).alias("field"), "term", "n_total", "n_records", "mark")
    return shaped(mentions_marked, "mentions").unionByName(shaped(expected_marked, "lexicon"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alias_id, field, scope, value of every alias and component target as typed."""
    rows = once(table(spark, sf_dir, "aliases").select("alias_id", "system_id", "kind", "alias", "target"), "alias_id")
    scope = lambda what, col: F.concat(F.lit(f"{what}:"), col)
    alias = rows.where("alias is not null").select("alias_id", F.lit("alias").alias("field"), scope("kind", F.col("kind")).alias("scope"), F.col("alias").alias("value"))
    target = rows.where("target is not null and kind = 'components'")
    return alias.unionByName(target.select("alias_id", F.lit("target").alias("field"), scope("system", F.col("system_id")).alias("scope"), F.col("target").alias("value")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir)
    lexicon = table(spark, sf_dir, "convention_lexicon").select(F.concat(F.lit("kind:"), "kind").alias("scope"), trimmed(F.col("expected")).alias("name"))
    symbols = table(spark, sf_dir, "symbols").select(F.concat(F.lit("system:"), "system_id").alias("scope"), trimmed(F.col("name")).alias("name"))
    mapped = canonical.map_to_names(typed, lexicon.unionByName(symbols).where("name != ''"))
    return typed.join(mapped, ["scope", "value"], "left").select("alias_id", "field", F.coalesce("canonical", F.lit("(none)")).alias("canonical"))


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values that no listed name was meant by, with how often they occur."""
    lost = p5_found(spark, sf_dir).where("canonical = '(none)'").select("alias_id", "field")
    return _typed(spark, sf_dir).join(lost, ["alias_id", "field"]).groupBy("field", "scope", "value").agg(F.count("*").alias("n"))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    windows = table(spark, sf_dir, "context_windows").where("label = 'standard'")
    return windows.agg(F.max("capacity_tokens")).first()[0]


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in containers of the `standard` capacity."""
    counts = stage(packing.token_counts(table(spark, sf_dir, "documents")), "sizes")
    return packing.pack(counts, _capacity(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, and how evenly their cost is spread."""
    work = F.sum(F.col("n_tokens") + F.col("n_tokens").cast("double") * F.col("n_tokens") / _capacity(spark, sf_dir))
    each = p7_packed(spark, sf_dir).groupBy("shard", "container").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), work.alias("cost"))
    return each.agg(
        F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens"), F.sum("n_pieces").alias("n_pieces"), F.round(F.max("cost") / F.avg("cost"), 3).alias("cost_spread")
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with the leaked passages cut out."""
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.garbled_documents(table(spark, sf_dir, "documents"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents' texts, restored as far as possible."""
    return encodings.restored_documents(table(spark, sf_dir, "documents"))


def p3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every oversized chunk whether its pieces are within the limit, overlap as told and give its text again."""
    pieces = p3_pieces(spark, sf_dir)
    step = F.struct("piece_no", "start", "end", "text", "n_pieces", "trail")
    by_chunk = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(step)).alias("p"))
    at = lambda i: F.get("p", i - 1)["end"]
    fits = F.forall("p", lambda p: (F.length(p["text"]) <= 1200) & (F.length(p["text"]) == p["end"] - p["start"]) & (p["n_pieces"] == F.size("p")))
    overlaps = F.forall(F.transform("p", lambda p, i: (i == 0) | (p["start"] == at(i) - 120)), lambda x: x)
    again = F.array_join(F.transform("p", lambda p, i: F.when(i == 0, p["text"]).otherwise(F.substr(p["text"], F.lit(121)))), "")
    return by_chunk.select("chunk_id", fits.alias("fits"), overlaps.alias("overlaps"), F.md5(again).alias("digest"), F.array_join(F.get("p", F.lit(0))["trail"], " > ").alias("trail"))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its tokens as packed, from 0 on without a gap, whether it is in one piece, and whether all its containers are within the capacity."""
    capacity = _capacity(spark, sf_dir)
    packed = stage(p7_packed(spark, sf_dir), "packed")
    over = packed.groupBy("shard", "container").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > capacity)
    rows = packed.join(over, ["shard", "container"], "left").groupBy("doc_id")
    end = F.max(F.col("first_token") + F.col("n_tokens"))
    return rows.agg((end == F.sum("n_tokens")).alias("no_gap"), ((F.count("*") == 1) | (F.sum("n_tokens") > capacity)).alias("whole"), (F.count("n") == 0).alias("fits"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p4_found, p5_found, p5_unmatched, p7_packed, p7_fill, p3_whole, p7_whole, p8_found, p8_cleaned, p9_found, p9_restored)}

ORACLES = {
    "p3_found": f"""SELECT DISTINCT chunk_id FROM doc_chunks WHERE length({_trim('text')}) > 1200""",
    "p4_found": f"""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, mentions FROM doc_chunks),
m AS (SELECT chunk_id, {_trim('m')} AS term FROM (SELECT chunk_id, unnest(mentions) AS m FROM c)),
f AS (SELECT term, count(*) AS n_total, count(DISTINCT chunk_id) AS n_records FROM m WHERE term != '' GROUP BY ALL),
l AS (SELECT DISTINCT ON (lexicon_id) lexicon_id, {_trim('expected')} AS term, coalesce(occurrences, 0) AS n FROM convention_lexicon),
g AS (SELECT term, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_records FROM l WHERE term != '' GROUP BY ALL)
SELECT 'mentions' AS field, term, n_total, n_records, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records * 200 > (SELECT count(*) FROM c) THEN 'common' ELSE 'useful' END AS mark FROM f
UNION ALL SELECT 'lexicon', term, n_total, n_records, CASE WHEN n_total <= 2 THEN 'rare' WHEN n_total * 100 > (SELECT sum(n) FROM l) THEN 'common' ELSE 'useful' END FROM g""",
}
ORACLES["p3_whole"] = f"""SELECT DISTINCT ON (chunk_id) chunk_id, true AS fits, true AS overlaps, md5({_trim('text')}) AS digest, array_to_string(trail, ' > ') AS trail FROM doc_chunks WHERE length({_trim('text')}) > 1200"""
ORACLES["p7_whole"] = "SELECT doc_id, true AS no_gap, true AS whole, true AS fits FROM documents WHERE text IS NOT NULL"
_WORDS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"
_GRAMS = "SELECT DISTINCT {0}, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS k FROM (SELECT {0}, " + _WORDS + " AS w FROM {1}) WHERE len(w) >= 20"
ORACLES["p8_found"] = f"WITH d AS ({_GRAMS.replace('{L}', '{{L}}').replace('{N}', '{{N}}').format('doc_id', 'documents')}), i AS ({_GRAMS.replace('{L}', '{{L}}').replace('{N}', '{{N}}').format('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (k)"
