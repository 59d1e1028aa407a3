"""Text normalisation and tokens as Column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import CLITIC_STEM, CLITICS, PHRASE_ALIASES, ROMAN_NUMERALS, STOPWORDS, TOKEN_ALIASES


# Beyond these common characters, a text may hold a longer form.
_UNUSUAL = "[^\\x00-\\x7fÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž‘’“”–—…•]"


@cache
def _folding() -> tuple[str, str, str]:
    """By rule over all code points: characters and the ones that replace them, and a table of longer forms.

    A form is the compatibility decomposition without combining marks, in lower
    case.  Only forms with an ASCII character count; what is no letter or digit
    in a longer form separates words.  Marks come last and have no replacement.
    """
    marks, single, longer = [], {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        form = unicodedata.normalize("NFKD", c)
        if form == c:
            continue
        plain = "".join(x for x in form if not unicodedata.combining(x)).lower()
        if len(plain) == 1 and plain.isascii():
            single[c] = plain
        elif len(plain) > 1 and any(x.isascii() and x.isalnum() for x in plain):
            longer[c] = "".join(x if x.isascii() and x.isalnum() else " " for x in plain)
    return "".join([*single, *marks]), "".join(single.values()), ",".join(f"{c}={form}" for c, form in longer.items())


def fold(text: Column) -> Column:
    """Compatibility forms without marks, as far as they are ASCII.

    Plain ASCII texts are left alone.  Of the unusual characters of a text each
    is looked up once and replaced where it has a longer form.
    """
    source, target, table = _folding()
    forms = F.str_to_map(F.lit(table), F.lit(","), F.lit("="))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_UNUSUAL})"), F.lit(1)))
    whole = F.when(text.rlike(_UNUSUAL), F.aggregate(found, text, lambda acc, c: F.replace(acc, c, F.coalesce(F.try_element_at(forms, c), c)))).otherwise(text)
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(whole, source, target)).otherwise(text)


def normalize(text: Column) -> Column:
    """Accents off, lower case, and multi-word aliases joined, in list order."""
    out = F.lower(fold(F.coalesce(text, F.lit(""))))
    for a, b in PHRASE_ALIASES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_clitic(token: Column) -> Column:
    """The token without its first matching clitic, if enough of it remains."""
    out = None
    for suffix in CLITICS:
        hit = token.endswith(suffix) & (F.length(token) >= CLITIC_STEM + len(suffix))
        cut = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(token)


def canonical(token: Column) -> Column:
    """The canonical form of a token."""
    aliases = F.create_map(*[F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, token), token)


def _once(df: DataFrame, expr: Column, name: str, *keep: str) -> DataFrame:
    """``keep`` and ``expr``, which is computed once: as a projection, later conditions would repeat it."""
    return df.select(*keep, F.explode(F.array(expr)).alias(name))


def tokens(df: DataFrame, text: str, *keep: str, remove_stopwords: bool = True) -> DataFrame:
    """``keep`` columns with one row ``(pos, term)`` for each token of ``text``.

    Digits stay as they are; then stopwords go, Roman numerals stay, clitics
    are cut, aliases are mapped, and single letters and new stopwords go.
    Words become rows right after the split, so the rules run as generated code
    over rows and not as interpreted functions over arrays.
    """
    known = lambda x: F.col(x).isin(*STOPWORDS) if remove_stopwords else F.lit(False)
    words = _once(df, normalize(F.col(text)), "norm", *keep).select(*keep, F.posexplode(F.split("norm", "[^a-z0-9]+")).alias("pos", "raw"))
    words = words.filter((F.col("raw") != "") & ~known("raw"))
    fixed = F.col("raw").rlike("^[0-9]+$") | F.col("raw").isin(*ROMAN_NUMERALS)
    stems = _once(words, F.struct(fixed.alias("fixed"), F.when(fixed, F.col("raw")).otherwise(strip_clitic(F.col("raw"))).alias("stem")), "s", *keep, "pos")
    terms = _once(stems, F.struct(F.col("s.fixed"), F.when(F.col("s.fixed"), F.col("s.stem")).otherwise(canonical(F.col("s.stem"))).alias("term")), "t", *keep, "pos")
    return terms.select(*keep, "pos", F.col("t.fixed").alias("fixed"), F.col("t.term").alias("term")).filter(F.col("fixed") | ((F.length("term") >= 2) & ~known("term"))).drop("fixed")


CACHED_WORDS = 1 << 18
"""Words of which a worker remembers the term."""
COUNTED_ROWS = 1_000
"""Texts of a batch of counts."""
_SEPARATED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


_STOP, _ROMAN = frozenset(STOPWORDS), frozenset(ROMAN_NUMERALS)
_OTHER = re.compile("[^\\x00-\\x7f]")


def term_of(raw: str) -> str | None:
    """The rules of ``tokens`` for one word of a normalised text; None if it goes."""
    if raw in _STOP:
        return None
    if raw.isdigit() or raw in _ROMAN:
        return raw
    stem = next((raw[: -len(x)] for x in CLITICS if raw.endswith(x) and len(raw) >= CLITIC_STEM + len(x)), raw) if raw.endswith(CLITICS) else raw
    term = TOKEN_ALIASES.get(stem, stem)
    return term if len(term) >= 2 and term not in _STOP else None


@cache
def _forms() -> dict[str, str]:
    """What ``fold`` makes of each character that it changes."""
    source, target, table = _folding()
    longer = dict(x.split("=", 1) for x in table.split(",")) if table else {}
    single = dict(zip(source, target.ljust(len(source), "\0")))
    return {c: form.replace("\0", "") for c, form in single.items()} | {c: form for c, form in longer.items() if re.match(_UNUSUAL, c)}


def normalized(text: str) -> str:
    """``normalize`` of one text."""
    if not text.isascii():
        forms = _forms()
        for c in set(_OTHER.findall(text)):
            if c in forms:
                text = text.replace(c, forms[c])
    text = text.lower()
    for a, b in PHRASE_ALIASES:
        if a in text:
            text = text.replace(a, b)
    return text


def _counted(batches):
    known: dict[bytes, str | None] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, COUNTED_ROWS):
            part = batch.slice(at, COUNTED_ROWS)
            terms, counts = [], []
            for text in part.column(1).to_pylist():
                found: dict[str, int] = {}
                for word, n in Counter(normalized(text or "").encode().translate(_SEPARATED).split()).items():
                    if word in known:
                        term = known[word]
                    else:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        term = known[word] = term_of(word.decode())
                    if term is not None:
                        found[term] = found.get(term, 0) + n
                terms.append(list(found))
                counts.append(list(found.values()))
            total = pa.array([sum(x) for x in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), total, pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "dl", "terms", "tfs"])


def term_counts(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """``(doc_id, dl, terms, tfs)`` of each row: its ``tokens`` counted, in one pass, without a row for every token."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_counted, "doc_id long, dl long, terms array<string>, tfs array<long>")


def content_terms(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Distinct terms of a query with the position of their first occurrence."""
    return tokens(df, text, *keep).groupBy(*keep, "term").agg(F.min("pos").alias("pos"))


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word and marked, if longer."""
    cut = F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(" …"))).otherwise(text)


def half_even(value: Column, digits: int) -> Column:
    """Rounded by its exact binary value, halves to even: 2.675 is a little less than it seems and gives 2.67."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")
