"""Score documents for toxicity with a weighted lexicon, learned from labelled rows.

Texts are folded first: lower case, look-alike letters of other scripts and digit substitutions become Latin letters,
everything between letters becomes one space. Terms are whole words or beginnings of words, found by one
Aho-Corasick pass. A hit inside an exception phrase does not count. The sum of the weights of all hits, divided by
the logarithm of the text's length, goes through a logistic curve.

Learning takes at most ``LEARN_ROWS`` labelled rows (those with the least hash of their id; equal texts once):
- a word's evidence is the number of different neighbours it has in toxic texts, so that copies of one text do not make
  its words toxic, against its occurrences in clean ones;
- beginnings of words, up to ``MOST_BEGINNING`` letters, add up the evidence of their words; a shorter pure beginning
  stands for all longer ones;
- pairs of a term and a neighbour that only clean texts hold become exception phrases;
- the curve is fitted to the labels.
``SEED_TERMS`` take part even where few labelled rows hold them, unless clean texts speak against them.

Defined results: null and empty texts have no hits and get the score of such texts; labels that are null are not used;
rows are kept one by one; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import freeing
from pairloom.llm.pieces import blocks
from pairloom.session import written

LEARN_ROWS = 20_000
BLOCK = 1 << 20
HOLD_OUT = 5  # rows whose crc32 of the id leaves no remainder are never learned from
LEAST_EVIDENCE = 6
CLEAN_SHARE = 0.02  # evidence in clean texts, as a share of that in toxic ones, that a term may have
LEAST_BEGINNING = 4
MOST_BEGINNING = 64  # letters; longer terms are whole words
LEAST_CLEAN_PHRASES = 3
SEED_WEIGHT = 4.0
# Insults that are toxic in nearly any text; weights are learned where labelled rows hold them.
SEED_TERMS = (
    "idiot idiots idiotic moron morons moronic imbecile stupid dumbass loser losers scum scumbag trash garbage "
    "worthless pathetic disgusting clown clowns jerk bastard bitch asshole fuck fucking shit retard cretin vermin"
).split()
# Look-alike signs and the letters they stand for.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l", "ο": "o", "α": "a", "ε": "e", "ι": "i",
    "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "χ": "x", "ⅰ": "i", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
}
WIDE = {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)}
CLEAN, TOXIC = 0, 1


def folded(text: Column | str) -> Column:
    """Letters between single spaces, with a space at both ends."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    table = LOOK_ALIKE | WIDE
    plain = F.translate(F.lower(col), "".join(table), "".join(table.values()))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}]+", " ")), F.lit(" "))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


@dataclass(frozen=True)
class Lexicon:
    """Terms as they stand in folded text (`` word `` or `` begin``), their weights, phrases, and the curve."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 4.0
    offset: float = -4.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        found.make_automaton()
        return found

    def hits(self, automaton, text: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the hits that no exception phrase covers."""
        found = [(end - size + 1, end + 1, weight) for end, (size, weight) in automaton.iter(text)]
        excused = sorted((a, b) for a, b, weight in found if weight == 0.0)
        starts = [a for a, _ in excused]
        furthest = [0, *accumulate((b for _, b in excused), max)]  # the last end of the stretches up to each one
        return [h for h in found if h[2] and furthest[bisect_right(starts, h[0])] < h[1]]

    def level(self, automaton, text: str) -> float:
        total = sum(weight for _, _, weight in self.hits(automaton, text))
        return total / math.log(math.e + text.count(" "))

    def score(self, level: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.offset + self.slope * level))))


def curve(levels: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with a little shrinkage so that clear cases stay finite."""
    design = np.stack([levels, np.ones_like(levels)], 1)
    w, shrink = np.zeros(2), np.diag([0.01, 0.0001])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - labels) + shrink @ w
        bend = (design * (p * (1 - p))[:, None]).T @ design + shrink
        step = np.linalg.solve(bend, grad)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _parts(batches):
    """Batches cut to about ``BLOCK`` bytes of text, as Python's strings and sets take many times their size."""
    for batch in batches:
        yield from blocks(batch, "_text", BLOCK)


def _evidence(rows: DataFrame) -> DataFrame:
    """word, toxic (different surroundings in toxic texts), clean (occurrences in clean ones)."""

    def count(batches):
        clean: Counter[str] = Counter()
        for batch in _parts(batches):
            found = set()
            for text, label in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist()):
                parts = text.split()
                if label == CLEAN:
                    clean.update(parts)
                else:
                    padded = ["", *parts, ""]
                    found.update((w, zlib.crc32(f"{padded[i]} {padded[i + 2]}".encode())) for i, w in enumerate(parts))
            if found:
                words, around = zip(*found)
                yield batch_of(words, around, [1] * len(words))
        if clean:
            yield batch_of(list(clean), [None] * len(clean), list(clean.values()))

    def batch_of(words, around, n):
        arrays = [pa.array(words, pa.string()), pa.array(around, pa.int64()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "around", "n"])

    placed = rows.mapInArrow(freeing(count), "word string, around long, n long").groupBy("word", "around").agg(F.sum("n").alias("n"))
    return placed.groupBy("word").agg(
        F.count("around").alias("toxic"),
        F.coalesce(F.sum(F.when(F.col("around").isNull(), F.col("n"))), F.lit(0)).alias("clean"),
    )


def _terms(evidence: DataFrame) -> dict[str, float]:
    totals = evidence.agg(F.sum("toxic"), F.sum("clean")).first()
    all_toxic, all_clean = totals[0] or 0, totals[1] or 0
    whole = evidence.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("term"), "toxic", "clean")
    sizes = F.sequence(F.lit(LEAST_BEGINNING), F.least(F.length("word"), F.lit(MOST_BEGINNING)))
    longer = evidence.filter(F.length("word") >= LEAST_BEGINNING)
    begins = longer.select("word", F.explode(sizes).alias("size"), "toxic", "clean")
    begins = begins.select(F.concat(F.lit(" "), F.expr("substring(word, 1, size)")).alias("term"), "toxic", "clean")
    begins = begins.groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("words")
    )
    begins = begins.filter("words > 2").drop("words")
    pure = (F.col("toxic") >= LEAST_EVIDENCE) & (F.col("clean") <= CLEAN_SHARE * F.col("toxic"))
    seeds = F.col("term").isin([f" {word} " for word in SEED_TERMS])
    # At most the surroundings of LEARN_ROWS texts divided by LEAST_EVIDENCE.
    found = whole.filter(pure | seeds).unionByName(begins.filter(pure)).collect()
    counts = {row.term: (row.toxic, row.clean) for row in found}

    def weight(toxic, clean):
        return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))

    terms: dict[str, float] = {}
    for term in sorted(counts, key=lambda t: (len(t), t)):
        toxic, clean = counts[term]
        covered = any(term[:n] in terms for n in range(2, min(len(term), MOST_BEGINNING + 2)))
        if not covered and toxic >= LEAST_EVIDENCE and clean <= CLEAN_SHARE * toxic:
            terms[term] = max(weight(toxic, clean), 1.0)
    for word in SEED_TERMS:
        toxic, clean = counts.get(f" {word} ", (0, 0))
        if clean <= toxic * 0.5 and not any(f" {word} "[:n] in terms for n in range(2, len(word) + 3)):
            terms[f" {word} "] = SEED_WEIGHT
    return terms


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = LEARN_ROWS) -> Lexicon:
    """A lexicon from at most ``most`` labelled documents outside the held-out part."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_label"))
    marked = marked.filter(F.col("_label").isin(CLEAN, TOXIC) & F.col("_id").isNotNull() & ~held_out("_id"))
    marked = marked.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text")).join(F.broadcast(marked), "_id")
    rows = rows.groupBy(folded("_text").alias("_text")).agg(F.max("_label").alias("_label"))
    rows = written(rows, "toxicity-rows")
    terms = _terms(_evidence(rows))
    plain = Lexicon(terms)

    def phrases(batches):
        automaton = plain.automaton()
        for batch in _parts(batches):
            found = set()
            for text, label in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist()):
                for start, end, _ in plain.hits(automaton, text):
                    stop = text.index(" ", end - 1 if text[end - 1] == " " else end)
                    left = text.rfind(" ", 0, start) if start > 0 else -1
                    right = text.find(" ", stop + 1)
                    if left >= 0:
                        found.add((text[left : stop + 1], label, zlib.crc32(text[stop : stop + 20].encode())))
                    if right > 0:
                        found.add((text[start : right + 1], label, zlib.crc32(text[max(0, start - 20) : start].encode())))
            if found:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())],
                    names=["phrase", "label", "around"],
                )

    pairs = rows.mapInArrow(freeing(phrases), "phrase string, label int, around long").distinct().groupBy("phrase")
    pairs = pairs.agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    excused = pairs.filter((F.col("toxic") == 0) & (F.col("n") >= LEAST_CLEAN_PHRASES)).select("phrase").collect()
    lexicon = Lexicon(terms, tuple(sorted(row.phrase for row in excused)))
    levels = _levels(rows, lexicon, ["_label"]).select("_label", "level").toPandas()  # at most ``most`` rows
    if levels["_label"].nunique() < 2:
        return lexicon
    slope, offset = curve(levels["level"].to_numpy(float), levels["_label"].to_numpy(float))
    return Lexicon(terms, lexicon.exceptions, slope, offset) if slope > 0 else lexicon


def _levels(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """Columns of ``keep``, level and score; only the folded text goes through Python."""

    @F.arrow_udf("struct<level:double,score:double>")
    def judge(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for texts in arrays:
            found = []
            for part in _parts([pa.RecordBatch.from_arrays([texts], names=["_text"])]):
                found += [lexicon.level(automaton, text) for text in part.column("_text").to_pylist()]
            scores = pa.array([lexicon.score(level) for level in found], pa.float64())
            yield pa.StructArray.from_arrays([pa.array(found, pa.float64()), scores], ["level", "score"])

    return rows.select(*keep, judge("_text").alias("_judged")).select(*keep, "_judged.level", "_judged.score")


def _scored(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str) -> DataFrame:
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], folded(text).alias("_text"))
    found = _levels(rows, lexicon, [f"_k{i}" for i in range(len(keep))])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """Columns of ``keep``, level, score (0 to 1), predicted (1 from score 0.5 on)."""
    found = _scored(docs, lexicon, keep, text)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "level", "score", "predicted")


def without_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The documents that the lexicon does not take for toxic, columns unchanged."""
    found = _scored(docs, lexicon, docs.columns, text).filter("predicted = 0")
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])
