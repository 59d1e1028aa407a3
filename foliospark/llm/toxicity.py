"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps homoglyphs (compatibility forms, Cyrillic and Greek look-alikes)
and digit substitutions to one letter, so disguised words meet the lexicon.
The lexicon is learned from labelled rows: words and word stems whose share of
toxic texts is far above their share of the others, weighted by the log odds.
Texts that agree in the bottom hash of their words (exact and most near copies,
and unrelated texts that share that word) count once, so a copied text does not
put its own words into the lexicon.
The evidence of a text is the sum of the weights of matched entries outside
exception phrases, divided by a slowly growing function of its length; a
one-variable logistic regression turns it into a score.

Defined cases: null and empty texts have no evidence and get the base score;
without labelled rows, or with one class only, the lexicon is empty and every
score is the base rate (0.0 without any label); documents with labels null are
unlabelled; repeated labels of an id count as given; repeated rows are scored
each; very long texts are scored whole, in time that grows with their length; a
score of exactly 0.5 is toxic; a tie of entries at one place counts the greater
weight; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

MAX_TRAIN_ROWS = 20_000
"""Labelled rows used for fitting: about this many at most, chosen by a hash."""

EXCEPTIONS = ("trash can", "trash bin", "taken out the trash", "class clown", "clown fish", "pathetic fallacy", "pond scum", "soap scum", "sore loser", "stupid simple")
"""Phrases in which a lexicon entry is harmless; a caller may give others."""

# Look-alike letters and digit substitutions, each with the
# letter that it is folded to.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
}
_TABLE = str.maketrans(LOOKALIKES)
_WORD = re.compile(r"[^\W_]+")
# Marks that stand for letters only inside a word.
_MARKS = re.compile(r"(?<![^\W_])[!|@$]+|[!|@$]+(?![^\W_])")


def fold(text: str) -> str:
    """Folded words, each after one space, and a space at the end."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "!" in text or "|" in text or "@" in text or "$" in text:
        text = _MARKS.sub(" ", text)
    return " " + " ".join(_WORD.findall(text.translate(_TABLE))) + " "


def entries_of(words: set[str], low: int, high: int) -> set[str]:
    """Whole words and proper stems; both begin at a word's begin."""
    return {f" {w} " for w in words if len(w) >= 3} | {" " + w[:k] for w in words for k in range(low, min(high, len(w) - 1) + 1)}


def _features(stem: tuple[int, int]):
    """The entries of each text, with the copy group of the text."""

    def run(batches):
        for b in batches:
            pairs = set()
            for text in b.column(0).to_pylist():
                words = set(fold(text or "").split())
                if words:
                    group = min(map(hash_word, words))
                    pairs.update((e, group) for e in entries_of(words, *stem))
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in pairs], pa.string()), pa.array([g for _, g in pairs], pa.int64())], ["entry", "grp"])

    return run


def _holders(entries: set[str], stem: tuple[int, int]):
    """How many texts of the task hold each of ``entries``, and how many texts there are."""

    def run(batches):
        seen, n = Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                seen.update(entries & entries_of(set(fold(text or "").split()), *stem))
        seen[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

    return run


@lru_cache(1 << 16)
def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode()) >> 1


def learn_lexicon(rows: DataFrame, stem: tuple[int, int] = (4, 9), share: float = 0.02, purity: float = 0.95) -> dict[str, float]:
    """``rows(text, toxic)`` to ``{entry: weight}``; an entry is ' word ' or ' stem'.

    An entry is kept if ``share`` of the toxic copy groups hold it (two at
    least) and the toxic ones among its holders reach ``purity``, by class
    shares.  A stem replaces the longer entries that begin with it.  Entries
    that a share ``s`` of the groups holds are at most ``1 / s`` times the mean
    number of entries of a group, so the lexicon does not grow with the data.
    """
    held = arrow_map(rows.filter("toxic = 1").select("text"), _features(stem), "entry string, grp long").distinct()
    bad = held.agg(F.countDistinct("grp")).first()[0]
    if not bad:
        return {}
    frequent = held.groupBy("entry").count().filter(F.col("count") >= max(2.0, share * bad)).collect()
    toxic = {r["entry"]: r["count"] for r in frequent}
    clean = {r["entry"]: r["n"] for r in arrow_map(rows.filter("toxic = 0").select("text"), _holders(set(toxic), stem), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    good = clean.get("", 0)
    if not good:
        return {}
    weights = {}
    for entry, n in toxic.items():
        p, q = (n + 0.5) / (bad + 1), (clean.get(entry, 0) + 0.5) / (good + 1)
        if n / bad >= purity * (n / bad + clean.get(entry, 0) / good):
            weights[entry] = math.log(p / q)
    lexicon: dict[str, float] = {}
    for entry in sorted(weights, key=lambda e: (len(e.rstrip()), e)):
        if not any(entry[:k] in lexicon for k in range(2, len(entry))):
            lexicon[entry] = weights[entry]
    return lexicon


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    """Entries as (weight, length, exception)."""
    machine = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        machine.add_word(entry, (weight, len(entry), False))
    for phrase in exceptions:
        machine.add_word(fold(phrase), (0.0, len(fold(phrase)), True))
    if len(machine):
        machine.make_automaton()
    return machine


def evidence(text: str | None, machine) -> float:
    """Sum of the weights of entries outside exception phrases, by length."""
    if not text or not len(machine):
        return 0.0
    folded = fold(text)
    hits, safe = [], []
    for end, (weight, length, exception) in machine.iter(folded):
        (safe if exception else hits).append((end - length + 1, end, weight))
    if safe:
        # Of the phrases that begin no later than a hit, does one end no earlier?
        safe.sort()
        begins, reach = [s[0] for s in safe], list(accumulate((s[1] for s in safe), max))
        hits = [h for h in hits if not ((k := bisect_right(begins, h[0])) and reach[k - 1] >= h[1])]
    if not hits:
        return 0.0
    best: dict[int, float] = {}
    for start, _, weight in hits:  # a stem and a whole word at one place count once
        best[start] = max(weight, best.get(start, 0.0))
    return sum(best.values()) / (1.0 + math.log2(1.0 + len(folded) / 2000.0))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> tuple[float, float]:
    """Weighted ridge logistic regression of one variable by Newton steps."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z, w = np.stack([np.ones_like(x), x / scale]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        g = z @ (n * (p - y)) + penalty * np.array([0.0, w[1]])
        h = (z * (n * p * (1 - p))) @ z.T + np.diag([1e-9, penalty])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


class Model:
    """Lexicon and logistic; small and bounded, so it can be broadcast."""

    def __init__(self, lexicon: dict[str, float], bias: float, slope: float, exceptions: tuple[str, ...] = EXCEPTIONS):
        self.lexicon, self.bias, self.slope, self.exceptions = lexicon, bias, slope, exceptions

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * x))))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def _evidence_of(model_value):
    def run(batches):
        machine = automaton(*model_value())
        for b in batches:
            x = [evidence(t, machine) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64())], ["key", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn from labelled rows outside the held-out fold only."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    step = max(1, known.count() // max_rows)
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    rows = texts.join(known, "doc_id").select("text", "toxic").persist()
    try:
        lexicon = learn_lexicon(rows)
        x = arrow_map(rows.select(F.col("toxic").alias("key"), "text"), _evidence_of(lambda: (lexicon, exceptions)), "key int, x double")
        # Evidence is rounded to three digits or tenths, so the driver gets a bounded histogram.
        grid = F.greatest(F.lit(0.1), F.pow(F.lit(10.0), F.floor(F.log10(F.greatest("x", F.lit(1.0)))) - 2))
        bins = x.groupBy("key", (F.round(F.col("x") / grid) * grid).alias("x")).count().collect()
    finally:
        rows.unpersist()
    total = sum(r["count"] for r in bins)
    positive = sum(r["count"] for r in bins if r["key"])
    if not lexicon:
        rate = positive / total if total else 0.0
        return Model({}, math.log(max(rate, 1e-13) / max(1 - rate, 1e-13)), 0.0, exceptions)
    bias, slope = fit_logistic(np.array([r["x"] for r in bins], float), np.array([r["key"] for r in bins], float), np.array([r["count"] for r in bins], float))
    return Model(lexicon, bias, slope, exceptions)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, fold, score and prediction of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        machine = automaton(m.lexicon, m.exceptions)
        for b in batches:
            s = [m.score(evidence(t, machine)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], ["doc_id", "score", "predicted"])

    scored = arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = sent.value
        machine = automaton(m.lexicon, m.exceptions)
        for b in batches:
            yield b.filter(pa.array([m.score(evidence(t, machine)) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
