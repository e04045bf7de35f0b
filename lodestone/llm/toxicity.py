"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding disguises.

Folding: lower case; accents, homoglyphs and full-width forms become plain Latin
letters; digits beside a letter and signs between letters become the letters they
stand for; marks and zero-width characters vanish; everything else is a space.  ``i``,
``l`` and ``1`` fold into one letter, as a ``1`` may stand for either.

The lexicon holds whole words with weights, learned as log-odds of their document frequency
among toxic and clean training rows.  A beginning takes the place of words only if two or more
of them have it and it weighs nearly as much as the heaviest, that is, if clean words hardly have it.
Exception phrases are those given and the pairs of a lexicon word and a neighbour that are as
good as always clean among the training rows.  One automaton finds all entries and all exception
phrases in a chunk of documents; a hit inside an exception phrase doesn't count.  A
logistic curve over the weight found and the weight per word gives the score.

The fit uses at most ``max_rows`` labelled rows of each class (those with the least
hash of their id).  The curve is fitted to what each half of them weighs by the lexicon of
the other half; the lexicon that is used comes from both.  That bound is a parameter of the classifier alone: every document is scored,
whole.  It bounds the lexicon, too, as each entry takes the evidence of several toxic rows.

Defined results: null and empty texts have no hits and get the curve's value for none.
Rows stay one by one.  Labels of an id count once, toxic if any of them is; null ids
and null labels are left out of the fit.  Without toxic or without clean rows, or
where no word tells them apart, the lexicon is empty and the score is the smoothed share of
toxic labels.  Other columns
pass through; a column of an output's name is replaced.
"""

from __future__ import annotations

import functools
import json
import math
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, bounded_batches, each_batch, fold, table, written

#: Labelled rows of each class that the fit takes at most.
MAX_ROWS = 10_000
#: Log-likelihood ratio from which on an entry's counts aren't chance.
EVIDENCE = 12
#: Least weights of an entry among which the fit chooses.
FLOORS = (3.0, 4.0, 5.0, 6.0, 7.0)
_COUNTS = ("clean0", "toxic0", "clean1", "toxic1")
#: Weight that a beginning may have less than the heaviest word that it stands for.
SLACK = 0.5

# Letters of other scripts that look like Latin ones.
_HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
# Digits and signs that stand for letters.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
_DROP, _GAP = 0, 32


@functools.cache
def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it folds to on its own, and which letter it stands for beside letters (0: none)."""
    plain = np.full(0x110000, _GAP, np.uint32)
    beside = np.zeros(0x110000, np.uint8)
    for c in (*range(0x40000), *range(0xE0000, 0xE0200)):
        kind = unicodedata.category(ch := chr(c))
        if kind[0] == "L":
            low = unicodedata.normalize("NFKD", ch).lower()[:1] if c > 0x7F else ch.lower()
            low = _HOMOGLYPHS.get(ch.lower(), _HOMOGLYPHS.get(low, low or ch))
            plain[c] = ord("i" if low == "l" else low)
        elif kind in ("Mn", "Me", "Cf"):
            plain[c] = _DROP
        elif kind == "Nd":
            plain[c] = 0x30 + unicodedata.digit(ch)
    for sign, letter in {**_DIGITS, **_SIGNS}.items():
        beside[ord(sign)] = ord(letter)
    for c in range(0xFF10, 0xFF1A):
        beside[c] = beside[c - 0xFF10 + 0x30]
    return plain, beside


def fold_texts(texts: list[str]) -> tuple[str, np.ndarray]:
    """The texts folded, each between two spaces, and the place at which each ends."""
    plain, beside = _fold_tables()
    points = np.frombuffer((" " + " \n ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 3) - 1
    out = plain[points]
    letter = (out > 0x39) & (out != _GAP)
    odd = np.flatnonzero(beside[points])
    if len(odd):
        digit = out[odd] != _GAP
        near = np.where(digit, letter[odd - 1] | letter[odd + 1], letter[odd - 1] & letter[odd + 1])
        run = odd[near]
        grown = True
        letter[run] = True
        while grown:  # a digit beside a digit that became a letter
            left = odd[digit & ~letter[odd]]
            more = left[letter[left - 1] | letter[left + 1]]
            letter[more] = True
            run = np.concatenate((run, more))
            grown = len(more) > 0
        out[run] = beside[points[run]]
    keep = out != _DROP
    if not keep.all():
        ends = np.concatenate(([0], np.cumsum(keep)))[np.minimum(ends, len(keep))]
        out = out[keep]
    return out.astype("<u4").tobytes().decode("utf-32-le"), ends


def fold_phrase(phrase: str) -> str:
    return f" {' '.join(fold_texts([phrase])[0].split())} "


def text_chunks(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of about so many characters; null counts as empty."""
    row, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i == len(texts) - 1:
            yield row, i + 1, [x or "" for x in texts[row : i + 1]]
            row, size = i + 1, 0


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights (a leading space: a word's beginning, a trailing one: its end), exceptions and the curve."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def dumps(self) -> str:
        return json.dumps([self.weights, self.exceptions, self.curve])

    def score(self, found: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = _inputs(found, words) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@functools.lru_cache(maxsize=2)
def _automaton(dumped: str):
    import ahocorasick

    weights, exceptions, _ = json.loads(dumped)
    automaton = ahocorasick.Automaton()
    for entry, weight in weights:
        automaton.add_word(entry, (weight, len(entry)))
    for phrase in map(fold_phrase, exceptions):
        if phrase.strip():
            automaton.add_word(phrase, (0.0, len(phrase)))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def weigh(texts: list[str], lexicon: str, floors: tuple[float, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the weight of its hits, the number of hits and of words.

    With ``floors`` the weight has a column for each, of the hits that weigh so much at least.
    """
    folded, ends = fold_texts(texts)
    spaces = np.frombuffer(folded.encode("utf-32-le"), np.uint32) == _GAP
    begins = np.zeros(len(spaces) + 1, np.int64)
    np.cumsum(np.concatenate(([False], spaces[:-1] & ~spaces[1:])), out=begins[1:])
    at = begins[np.minimum(ends, len(spaces))]
    words = np.diff(at, prepend=0)
    automaton = _automaton(lexicon)
    hits = [(end, weight, size) for end, (weight, size) in automaton.iter(folded)] if len(automaton) else []
    if not hits:
        return np.zeros((len(texts), len(floors)) if floors else len(texts)), np.zeros(len(texts), np.int64), words
    end, weight, size = (np.array(x) for x in zip(*hits, strict=True))
    harmless = weight == 0
    if harmless.any():
        begin = end - size + 1
        covered = np.zeros(len(folded) + 1, np.int64)
        np.add.at(covered, begin[harmless], 1)
        np.add.at(covered, end[harmless] + 1, -1)
        counts = ~harmless & ~(np.cumsum(covered)[begin + 1] > 0)
        end, weight = end[counts], weight[counts]
    doc = np.searchsorted(ends, end, "right")
    doc = np.minimum(doc, len(texts) - 1)
    sums = np.stack([np.bincount(doc, weight * (weight >= f), len(texts)) for f in floors], axis=1) if floors else np.bincount(doc, weight, len(texts))
    return sums, np.bincount(doc, minlength=len(texts)), words


def _inputs(found: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Inputs of the curve: one, the weight found, and the weight for 100 words."""
    return np.stack([np.ones(len(found)), np.log1p(found), np.log1p(100 * found / np.maximum(words, 1))], axis=1)


def _features(text: str) -> set[str]:
    """Beginnings of three letters on and whole words of a folded text."""
    out = set()
    for word in set(text.split()):
        out.update(f" {word[:k]}" for k in range(3, min(len(word), 11)))
        out.add(f" {word} ")
    return out


def _labelled(documents: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Text, label and half of the rows that the fit takes, and all training labels by class."""
    known = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).where(fold("doc_id", 5) != 0)
    )
    totals = {int(y): int(n) for y, n in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id", F.lit(1))
    taken = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(max_rows)
        taken = part if taken is None else taken.unionByName(part)
    taken = taken.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).cast("int"))
    rows = documents.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y", "half")
    return rows, totals  # 2 * max_rows ids are broadcast at most


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Fits lexicon and curve; only lexicon entries and two numbers for each labelled row come to the driver."""
    with Scratch(documents.sparkSession):
        return _learned(documents, labels, max_rows, exceptions)


def _learned(documents: DataFrame, labels: DataFrame, max_rows: int, exceptions: tuple[str, ...]) -> Lexicon:
    bounded_batches(documents.sparkSession)
    rows, totals = _labelled(documents, labels, max_rows)
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 20)
    prior = math.log(share / (1 - share))
    if not totals.get(0) or not totals.get(1):
        return Lexicon((), exceptions, (prior, 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(4)]  # by half and class
        for batch in batches:
            for text, y, half in zip(*(batch.column(n).to_pylist() for n in ("text", "y", "half")), strict=True):
                seen[2 * half + y].update(_features(fold_texts([text])[0]))
                seen[2 * half + y][""] += 1
                if sum(map(len, seen)) > 400_000:
                    yield flush(seen)
        yield flush(seen)

    def flush(seen: list[Counter]) -> pa.RecordBatch:
        names = list(set().union(*seen))
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)], ["entry", *_COUNTS])
        for c in seen:
            c.clear()
        return out

    kind = "entry string, " + ", ".join(f"{c} long" for c in _COUNTS)
    sums = written(rows.mapInArrow(count, kind).groupBy("entry").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "entries")
    halves = [_entries(sums, clean, toxic) for clean, toxic in (("clean0", "toxic0"), ("clean1", "toxic1"))]
    lexicons = [Lexicon(h, exceptions).dumps() for h in halves]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weights by the lexicon of the other half."""
        for batch in batches:
            halves = np.asarray(batch.column("half"))
            for h in (0, 1):
                part = batch.filter(pa.array(halves == h))
                for row, end, texts in text_chunks(part.column("text").to_pylist()) if part.num_rows else ():
                    weight, _, words = weigh(texts, lexicons[1 - h], FLOORS)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, weight.T), pa.array(words, pa.int64()), part.column("y").slice(row, end - row)], [*weights, "words", "y"])

    weights = [f"weight{k}" for k in range(len(FLOORS))]
    data = rows.select("text", "y", "half").mapInArrow(found, ", ".join(f"{w} double" for w in weights) + ", words long, y int").toArrow()
    curves = [_curve(*(data[c].to_numpy() for c in (w, "words", "y")), totals, prior) for w in weights]
    (curve, _), floor = min(zip(curves, FLOORS, strict=True), key=lambda c: c[0][1])
    entries = tuple(e for e in _entries(sums, "clean0 + clean1", "toxic0 + toxic1") if e[1] >= floor)
    if not entries:
        return Lexicon((), exceptions, (prior, 0.0, 0.0))
    return Lexicon(entries, (*exceptions, *_harmless(rows, Lexicon(entries, exceptions).dumps())), curve)


def _contexts(text: str, dumped: str) -> set[str]:
    """The words that hits are in, and each with the word before and the word behind it; and one entry for any hit."""
    folded = fold_texts([text])[0]
    out = set()
    for end, (weight, size) in _automaton(dumped).iter(folded):
        if weight:
            begin, stop = end - size + 1, folded.find(" ", end)
            word = folded[begin + 1 : stop]
            before, behind = folded[max(0, begin - 40) : begin].split(), folded[stop : stop + 40].split()
            out |= {f"{before[-1]} {word}"} if before else set()
            out |= {f"{word} {behind[0]}"} if behind else set()
            out.add("")
    return out


def _harmless(rows: DataFrame, dumped: str) -> tuple[str, ...]:
    """Pairs of a lexicon word and a neighbour that are far more often clean than hits are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y].update(_contexts(text, dumped))
        names = list(set().union(*seen))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)], ["phrase", "clean", "toxic"])

    sums = written(rows.select("text", "y").mapInArrow(count, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "contexts")
    total = sums.where("phrase = ''").first()
    if not total or not total["clean"]:
        return ()
    share = total["clean"] / (total["clean"] + total["toxic"])
    surprise = F.col("clean") * F.log(F.lit(1 / share))  # of no toxic row among so many
    return tuple(sorted(r["phrase"] for r in sums.where((F.col("phrase") != "") & (F.col("toxic") == 0) & (surprise >= EVIDENCE)).collect()))


def _entries(sums: DataFrame, clean: str, toxic: str) -> tuple[tuple[str, float], ...]:
    """Entries that these counts call for: weight 2 or more, and unlikely (by the likelihood ratio) to be so by chance."""
    counts = sums.select("entry", F.expr(clean).alias("clean"), F.expr(toxic).alias("toxic"))
    total = counts.where("entry = ''").first()
    n0, n1 = (total["clean"], total["toxic"]) if total else (0, 0)
    if not n0 or not n1:
        return ()
    c, t = F.col("clean"), F.col("toxic")
    weight = F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    chance = t * F.log(t / ((t + c) * (n1 / (n0 + n1)))) + F.when(c > 0, c * F.log(c / ((t + c) * (n0 / (n0 + n1))))).otherwise(0)
    strong = counts.where("entry <> '' and toxic > 0").withColumn("weight", weight).where((F.col("weight") >= 2) & (chance >= EVIDENCE))
    return _stems({r["entry"]: round(float(r["weight"]), 4) for r in strong.select("entry", "weight").collect()})


def _stems(strong: dict[str, float]) -> tuple[tuple[str, float], ...]:
    """Whole words, but those that share a beginning that weighs nearly as much as the heaviest of them go by it, the longest such one."""
    words = sorted(e for e in strong if e[-1] == " ")
    alike: dict[tuple[str, ...], str] = {}
    for beginning in sorted(e for e in strong if e[-1] != " "):  # a longer one comes behind those that it has as beginnings
        at = bisect_left(words, beginning)
        stop = bisect_left(words, beginning + "\U0010ffff")
        if stop - at > 1 and strong[beginning] >= max(strong[w] for w in words[at:stop]) - SLACK:
            alike[tuple(words[at:stop])] = beginning
    kept: dict[str, float] = {}
    for entry in sorted([*alike.values(), *words], key=lambda e: (len(e), e)):
        if not any(entry[:k] in kept for k in range(4, len(entry))):
            kept[entry] = strong[entry]
    return tuple(kept.items())


def _curve(weight: np.ndarray, words: np.ndarray, y: np.ndarray, totals: dict[int, int], prior: float) -> tuple[tuple[float, float, float], float]:
    """Logistic regression by damped Newton steps, and its loss; rows are weighted back to the shares of the classes among all training labels."""
    if len(set(y.tolist())) < 2:
        return (prior, 1.0, 0.0), 0.0
    x = _inputs(weight, words)
    share = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum()) / sum(totals.values()) * len(y)
    ridge = np.diag([0.01, 0.5, 0.5])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + b @ ridge @ b / 2)

    beta = np.array([prior, 0.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (share * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, slope)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return tuple(round(float(b), 6) for b in beta), loss(beta)


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` (1 if the score is 0.5 or more), ``toxic_weight`` and ``toxic_hits``."""
    added = {"score": (T.DoubleType(), pa.float64()), "predicted": (T.IntegerType(), pa.int32()), "toxic_weight": (T.DoubleType(), pa.float64()), "toxic_hits": (T.LongType(), pa.int64())}
    kept = [c for c in df.columns if c not in added and (keep_text or c != text)]
    out = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, k) for n, (k, _) in added.items()])
    bounded_batches(df.sparkSession)
    dumped = lexicon.dumps()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.schema.names
        for row, end, texts in text_chunks(batch.column(names.index(text)).to_pylist()):
            weight, hits, words = weigh(texts, dumped)
            value = lexicon.score(weight, words)
            columns = [batch.column(names.index(c)).slice(row, end - row) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(weight, pa.float64()), pa.array(hits, pa.int64())], [*kept, *added])

    return df.mapInArrow(each_batch(run), out)


def remove_toxic(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    inner = {c: f"__{i}" for i, c in enumerate(df.columns)}
    clean = score(df.withColumnsRenamed(inner), lexicon, inner[text]).where("predicted = 0").select(*inner.values())
    return clean.withColumnsRenamed({v: k for k, v in inner.items()})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, the labels of four fifths of the ids being known."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, lexicon, keep_text=False)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "toxic_weight", "toxic_hits")
