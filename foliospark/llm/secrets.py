"""Secret scans with SQL functions only: base patterns and character Markov models.

Base spans come from three patterns.  Further spans are long tokens that look
drawn at random: two first-order Markov models over characters, one of random
strings and one of ordinary identifiers, give each token a log-likelihood
ratio.  Both models are bigram counts of labelled samples, smoothed towards
the uniform distribution, and are kept as one array of log ratios with a fixed
number of entries, so nothing that grows with the data is sent around.

Scanning is a projection: no shuffle, no Python, one pass over the rows.

Defined cases: null counts as empty; empty texts have no spans and the digest
of the empty string; without samples both models are uniform and no span is
added; samples are taken by row number, so equal rows are as likely as others;
very long texts are scanned whole; spans that begin together are listed by kind;
repeated rows give repeated rows; an empty table an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_sample

# The base patterns, and the least length of what each matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{7,}"
SAMPLE_ROWS = 4_000
"""Documents from which the samples are taken, about this many at most."""
BACKOFF = 4.0
THRESHOLD = 0.75
"""Least mean log-likelihood ratio of a transition, in nats."""


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Matched strings; an empty array where a cheap test finds none."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def located(text: Column, pattern: str, kind: int) -> Column:
    """``array<struct<start,kind,end>>`` of all leftmost matches, in code points.

    The gaps between matches come from splitting at the pattern, so a match
    begins where the gaps and matches before it end.
    """
    gaps, found = F.split(text, pattern, -1), matches(text, pattern)
    lengths = F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.coalesce(x["m"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), F.aggregate(lengths, zero, step)["spans"]).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind; failing matches are dropped after matching."""
    assign = F.zip_with(located(text, ASSIGN, 0), matches(text, ASSIGN, 1), lambda s, v: F.struct(s.alias("s"), F.length(v).alias("n")))
    kept = F.transform(F.filter(assign, lambda x: x["n"] >= ASSIGN_VALUE), lambda x: x["s"])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return {
        "assign": F.when(text.rlike(ASSIGN), kept).otherwise(none),
        "access": located(text, ACCESS.replace("+", f"{{{ACCESS_LENGTH - 4},}}"), 1),
        "hex": located(text, HEX.replace("+", f"{{{HEX_LENGTH},}}"), 2),
    }


def samples_from(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled samples ``(sample, random)`` of a bounded share of the documents.

    What a base pattern matches is random; identifier-like words of the text
    outside such matches are ordinary.
    """
    text = row_sample(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")), sample_rows)
    hexes, keys = HEX.replace("+", "{32,}"), ACCESS.replace("+", "{12,}")
    random = text.select(F.explode(F.concat(F.filter(matches(F.col("t"), ASSIGN, 1), lambda v: F.length(v) >= ASSIGN_VALUE), matches(F.col("t"), keys), matches(F.col("t"), hexes))).alias("sample"), F.lit(1).alias("random"))
    cut = F.col("t")
    for pattern in (ASSIGN, keys, hexes):
        cut = F.regexp_replace(cut, pattern, " ")
    ordinary = text.select(F.explode(matches(cut, IDENTIFIER)).alias("sample"), F.lit(0).alias("random"))
    return random.unionByName(ordinary).distinct()


def train(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log ratios of the transition probabilities, in alphabet order.

    ``samples(sample string, random int)``.  Counts of transitions are
    aggregated before the shuffle and have at most ``2 * len(ALPHABET) ** 2``
    groups, which is what the driver gets.
    """
    n = len(ALPHABET)
    pairs = samples.filter("sample is not null and length(sample) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(sample) - 1), i -> substring(sample, i, 2))")).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect()}
    totals = {(k, a): sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}
    nexts = {(k, b): sum(counts.get((k, a + b), 0) for a in ALPHABET) for k in (0, 1) for b in ALPHABET}
    every = {k: sum(nexts[k, b] for b in ALPHABET) for k in (0, 1)}

    def chance(k: int, a: str, b: str) -> float:
        """Transition probability, backed off to the character's own and the uniform one."""
        own = (nexts[k, b] + alpha) / (every[k] + alpha * n)
        return (counts.get((k, a + b), 0) + BACKOFF * own) / (totals[k, a] + BACKOFF)

    table = [math.log(chance(1, a, b) / chance(0, a, b)) for a in ALPHABET for b in ALPHABET]
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions."""
    # A literal of fixed size: one array that constant folding builds once.
    ratios = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(ratios, ((place(i) - 1) * len(ALPHABET) + place(i + 1)).cast("int")))
    return total / (F.length(token) - 1)


def added_spans(text: Column, base: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """Candidates of letters and digits above ``threshold`` that overlap no base span."""
    found = F.zip_with(located(text, CANDIDATE, 3), matches(text, CANDIDATE), lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    free = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["s"]["end"]) & (x["s"]["start"] < b["end"])))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    mixed = F.filter(free, lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]"))
    return F.when(text.rlike(CANDIDATE), F.transform(F.filter(mixed, lambda x: ratio(x["v"], table) > threshold), lambda x: x["s"])).otherwise(none)


def with_spans(docs: DataFrame, table: list[float], text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of spans, and their names by kind, ``base`` and ``spans``; no name clashes with one of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(text)
    at = {k: fresh(docs, k) for k in (*kinds, "base", "spans")}
    out = docs.select("*", *[c.alias(at[k]) for k, c in kinds.items()])
    out = out.select("*", F.array_sort(F.concat(*[at[k] for k in kinds])).alias(at["base"]))
    return out.select("*", F.array_sort(F.concat(F.col(at["base"]), added_spans(text, F.col(at["base"]), table))).alias(at["spans"])), at


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and list of the spans of every whole text."""
    found, at = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), table)
    return found.select("doc_id", *[F.size(at[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(F.col(at["base"])).cast("binary"), 256).alias("base_sha256"), listed(F.col(at["spans"])).alias("spans"))


def redact(docs: DataFrame, table: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; a null text stays null."""
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    found, at = with_spans(docs, table, text_col)
    clean = F.when(F.size(at["spans"]) > 0, F.aggregate(at["spans"], zero, step, finish)).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
