"""Parts of the DuckDB statements that the queries are compared with."""

from __future__ import annotations

from ..functions.text import STOPWORDS

SPACE = "[\\s\\x1c-\\x1f\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def trim(col: str) -> str:
    return f"regexp_replace({col}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(col: str) -> str:
    return f"coalesce(list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9]+'), lambda w: w != ''), CAST([] AS VARCHAR[]))"


def segments(col: str) -> str:
    return f"coalesce(list_filter(list_transform(regexp_split_to_array(regexp_replace({col}, '([A-Z])', chr(1) || '\\1', 'g'), '[-_.\\x01]+'), lambda w: lower(w)), lambda w: w != ''), CAST([] AS VARCHAR[]))"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def meaningful(col: str) -> str:
    kept = f"list_filter({col}, lambda w: NOT list_contains({_STOP}, w))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {col} END"


EXPORTS = """ex AS (SELECT module_id, epos, system_id, pos, dir, e.* FROM (SELECT module_id, system_id, pos, dir, unnest(exports) AS e, CAST(unnest(range(len(exports))) AS INTEGER) AS epos
FROM (SELECT DISTINCT ON (module_id) * FROM catalog_modules)) WHERE e.display_name IS NOT NULL)"""
TOKENS = f"tk AS (SELECT DISTINCT ON (token_id) * REPLACE ({trim('name')} AS name, {trim('css_var')} AS css_var) FROM tokens)"
ALIASES = f"al AS (SELECT DISTINCT ON (alias_id) * REPLACE ({trim('alias')} AS alias, {trim('target')} AS target) FROM aliases)"
CHUNKS = "ch AS (SELECT DISTINCT ON (chunk_id) * FROM doc_chunks)"
SYMBOLS = f"sy AS (SELECT DISTINCT ON (symbol_id) * REPLACE ({trim('name')} AS name) FROM symbols)"
# Exports by spelling: the first by position; xkey identifies an export.
NAMES = """xk AS (SELECT *, {'pos': pos, 'module_id': module_id, 'epos': epos, 'dir': dir, 'display_name': display_name} AS x FROM ex),
nm AS (SELECT system_id, name, min(x) AS x FROM (SELECT system_id, x, display_name AS name FROM xk UNION ALL SELECT system_id, x, tag_name FROM xk WHERE tag_name IS NOT NULL) GROUP BY ALL),
nl AS (SELECT system_id, lower(name) AS name, min(x) AS x FROM nm GROUP BY ALL)"""


def loosely(source: str, col: str) -> str:
    """All columns of source with x and how of the export that col names."""
    t = trim(f"s.{col}")
    return f"""SELECT s.*, coalesce(nm.x, nl.x) AS x, CASE WHEN nm.x IS NOT NULL THEN 'exact' ELSE 'case' END AS how FROM {source} s
LEFT JOIN nm ON nm.system_id = s.system_id AND nm.name = {t} LEFT JOIN nl ON nl.system_id = s.system_id AND nl.name = lower({t}) WHERE coalesce(nm.x, nl.x) IS NOT NULL"""
