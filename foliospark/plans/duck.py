"""Building blocks of the SQL oracles: the engine's rules in DuckDB's dialect."""

from __future__ import annotations

from ..functions.constants import BM25_B, BM25_K1, CLITIC_STEM, CLITICS, PHRASE_ALIASES, ROMAN_NUMERALS, STOPWORDS, TOKEN_ALIASES


def listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def normalized(text: str) -> str:
    out = f"lower(strip_accents(coalesce({text}, '')))"
    for a, b in PHRASE_ALIASES:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def tokens(name: str, table: str, key: str, text: str = "text") -> str:
    """CTEs ending in ``name(key, pos, term)``."""
    clitic = " ".join(f"WHEN ends_with(raw, '{c}') AND length(raw) >= {CLITIC_STEM + len(c)} THEN left(raw, length(raw) - {len(c)})" for c in CLITICS)
    alias = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TOKEN_ALIASES.items())
    return f"""
        {name}_parts AS (SELECT {key}, string_split_regex({normalized(text)}, '[^a-z0-9]+') AS parts FROM {table}),
        {name}_raw AS (SELECT {key}, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM {name}_parts),
        {name}_stem AS (
            SELECT {key}, pos, raw, regexp_full_match(raw, '[0-9]+') OR raw IN {listed(ROMAN_NUMERALS)} AS fixed, CASE {clitic} ELSE raw END AS stem
            FROM {name}_raw WHERE raw <> '' AND (regexp_full_match(raw, '[0-9]+') OR raw NOT IN {listed(STOPWORDS)})),
        {name} AS (
            SELECT {key}, pos, CASE WHEN fixed THEN raw ELSE CASE stem {alias} ELSE stem END END AS term FROM {name}_stem
            WHERE fixed OR (length(CASE stem {alias} ELSE stem END) >= 2 AND (CASE stem {alias} ELSE stem END) NOT IN {listed(STOPWORDS)}))"""


def index(table: str = "documents", key: str = "doc_id") -> str:
    """CTEs ``tok, tf, dl, df, corpus``."""
    return (
        tokens("tok", table, key)
        + f""",
        tf AS (SELECT {key}, term, count(*) AS tf FROM tok GROUP BY ALL),
        dl AS (SELECT d.{key}, coalesce(sum(tf.tf), 0) AS dl FROM {table} d LEFT JOIN tf USING ({key}) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
        corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""
    )


def bm25(questions: str = "benchmark", q_key: str = "item_id", table: str = "documents", key: str = "doc_id") -> str:
    """``index`` and CTEs ending in ``hits(q_key, key, score, coverage, matched_terms)``."""
    return (
        index(table, key)
        + ","
        + tokens("qtok", questions, q_key)
        + f""",
        q AS (
            SELECT a.{q_key}, a.term, a.qtf, a.pos, ln(1e0 + (n - coalesce(df, 0) + 5e-1) / (coalesce(df, 0) + 5e-1)) AS idf
            FROM (SELECT {q_key}, term, count(*) AS qtf, min(pos) AS pos FROM qtok GROUP BY ALL) a LEFT JOIN df USING (term), corpus),
        total AS (SELECT {q_key}, sum(idf) AS total_idf FROM q GROUP BY ALL),
        hits AS (
            SELECT {q_key}, {key}, round(sum(qtf * idf * tf * {BM25_K1 + 1}e0 / (tf + {BM25_K1}e0 * ({1 - BM25_B}e0 + {BM25_B}e0 * dl / avgdl))), 6) AS score,
                   round(sum(idf) / any_value(total_idf), 6) AS coverage, list(term ORDER BY pos) AS matched_terms
            FROM q JOIN tf USING (term) JOIN dl USING ({key}) JOIN total USING ({q_key}), corpus GROUP BY {q_key}, {key} HAVING sum(qtf * idf * tf) > 0)"""
    )


UNIT_DOT = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"

# White space of any kind, as Java and Python have it.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{SPACE}+'), lambda w: w <> '')"


def truncated(x: str, limit: int) -> str:
    return f"(CASE WHEN length({x}) > {limit} THEN regexp_replace(left({x}, {limit}), ' [^ ]*$', '') || ' …' ELSE {x} END)"


def cited(x: str) -> str:
    """Sorted distinct cited pages: runs of numbers, folded one after the other as structs of one type."""
    sep = r"\s*(?:,|dan|s\.?d\.?|[-–—])\s*"
    runs = f"regexp_extract_all(coalesce({x}, ''), '(?i)halaman\\s*:?\\s*(\\d{{1,4}}(?:{sep}\\d{{1,4}})*)', 1)"
    numbers = "list_transform(regexp_extract_all(run, '\\d{1,4}'), lambda s: s::INT)"
    marks = "list_transform(string_split_regex(run, '\\d{1,4}'), lambda s: regexp_matches(s, '[-–—]'))"
    steps = f"list_transform({numbers}, lambda n, i: {{'stop': false, 'at': n, 'pages': [n], 'dash': i > 1 AND ({marks})[i]}})"
    bad = "(b.dash AND (b.at <= a.at OR b.at - a.at > 40))"
    stop = f"(a.stop OR {bad})"
    more = "(CASE WHEN b.dash THEN range(a.at, b.at + 1)::INT[] ELSE [b.at] END)"
    fold = f"lambda a, b: {{'stop': {stop}, 'at': CASE WHEN {stop} THEN a.at ELSE b.at END, 'pages': CASE WHEN {stop} THEN a.pages ELSE a.pages || {more} END, 'dash': false}}"
    return f"list_sort(list_distinct(flatten(list_transform({runs}, lambda run: list_reduce({steps}, {fold}).pages))))"
