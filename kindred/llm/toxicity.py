"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: densities of a learned lexicon (words, and word beginnings for inflected
and compounded forms) and of a fixed one, the nearness of lexicon words to second-person
words, capitals, punctuation, obfuscation (letters mixed with digits or symbols, also read
back to letters for the lexicon), repeated letters and length. Labels, ids, languages and
sources are never features.

Fitting uses at most `sample_rows` labelled rows (chosen by a hash of the id) of those that
may be learned from; scoring covers every whole text.

Defined results: null and empty texts get the score of a text without words; without
labelled rows of both classes every score is 0. Repeated ids are scored row by row; of
several labels of one id the largest counts; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow_rows import map_batches
from kindred.llm.boosting import BoostedTrees, Isotonic
from kindred.plans.stored import drop, stored

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 16_000
#: Entries of the learned lexicon, at most, and documents an entry must occur in.
LEXICON_SIZE = 600
LEAST_DOCUMENTS = 4
#: Word forms that a Python worker remembers within a task; emptied when full.
REMEMBERED = 150_000

# Common insults, second-person words, and letters written as other signs.
INSULTS = frozenset("idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool ugly hate".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
SIGNS = str.maketrans("013457@$!", "oieastasi")
EDGES = ".,;:!?\"'()[]{}|<>«»¿¡…-_*#~`/\\"

#: The same sign three times.
REPEATED = re.compile(r"(.)\1\1")

FEATURES = ("learned", "learned_max", "beginnings", "beginnings_max", "fixed", "near_you", "you", "capitals", "shouted", "exclamations", "questions", "punctuation", "digits", "obfuscated", "repeated", "word_length", "log_words", "hits")
_PER_WORD = 14


def forms(word: str) -> tuple[str, list[str], bool]:
    """The plain form of a chunk, its beginnings and whether it was obfuscated."""
    plain = word.strip(EDGES)
    mixed = any(c.isalpha() for c in plain) and any(c in "013457@$!*" for c in plain)
    low = plain.lower()
    if mixed:
        low = low.translate(SIGNS)
    return low, [low[:k] for k in (4, 5, 6) if len(low) > k], mixed


@dataclass
class Lexicon:
    words: dict[str, float]
    beginnings: dict[str, float]

    def row(self, chunk: str) -> list[float]:
        """What one chunk of a text adds to the features."""
        end = 1 if not chunk[-1].isalnum() else 0
        plain = chunk[:-1] if end else chunk
        if plain.isalpha() and plain[1:].islower() and not REPEATED.search(plain):
            # the usual case: a word with at most a capital and a sign at its end
            low, get = plain.lower(), self.beginnings.get
            word = self.words.get(low, 0.0)
            begin = max(get(low[:4], 0.0), get(low[:5], 0.0), get(low[:6], 0.0)) if len(low) > 6 else max((get(low[:k], 0.0) for k in (4, 5) if len(low) > k), default=0.0)
            fixed, n = low in INSULTS, len(chunk)
            return [word, begin, fixed, low in SECOND_PERSON, plain[0].isupper(), 0, end and chunk[-1] == "!", end and chunk[-1] == "?", end, 0, 0, 0, n, word > 0 or begin > 0 or fixed]
        low, begins, mixed = forms(chunk)
        word = self.words.get(low, 0.0)
        begin = max((self.beginnings.get(b, 0.0) for b in begins), default=0.0)
        letters = sum(map(str.isalpha, chunk))
        upper = sum(map(str.isupper, chunk))
        return [
            word, begin, low in INSULTS, low in SECOND_PERSON, upper, letters > 1 and upper == letters, chunk.count("!"), chunk.count("?"),
            len(chunk) - letters - sum(map(str.isdigit, chunk)), sum(map(str.isdigit, chunk)), mixed, bool(REPEATED.search(chunk)), len(chunk), max(word, begin) > 0 or low in INSULTS,
        ]


class Reader:
    """Feature rows of texts; remembers the values of word forms it has met."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.at = lexicon, {}
        self.table = np.zeros((1024, _PER_WORD), np.float32)

    def features(self, text: str) -> np.ndarray:
        chunks = text.split()
        if len(self.at) > REMEMBERED:
            self.at.clear()
        new = [c for c in dict.fromkeys(chunks) if c not in self.at]
        if new:
            n = len(self.at) + len(new)
            if n > len(self.table):
                self.table = np.resize(self.table, (2 * n, _PER_WORD))
            self.table[len(self.at) : n] = [self.lexicon.row(c) for c in new]
            self.at.update(zip(new, range(len(self.at), n), strict=True))
        out = np.zeros(len(FEATURES), np.float32)
        if not chunks:
            return out
        rows = self.table[np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))]
        n, total = len(chunks), rows.sum(0)
        hits, you = np.flatnonzero(rows[:, 13]), np.flatnonzero(rows[:, 3])
        near = 0.0
        if len(hits) and len(you):
            k = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.minimum(k, len(you) - 1)]), np.abs(hits - you[np.maximum(k - 1, 0)]))
            near = float((1 / (1 + gap)).sum())
        letters = max(1.0, float(total[12] - total[8] - total[9]))
        out[:] = [
            total[0] / n, rows[:, 0].max(), total[1] / n, rows[:, 1].max(), total[2] / n, near / n, total[3] / n, total[4] / letters, total[5] / n, total[6] / n,
            total[7] / n, total[8] / n, total[9] / n, total[10] / n, total[11] / n, total[12] / n, math.log1p(n), min(len(hits), 50),
        ]
        return out


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings that occur far more often in texts of label 1, by smoothed log odds.

    sample: text, label. Counts of documents are summed in Spark; only the best
    LEXICON_SIZE entries of each kind reach the driver.
    """

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys = set()
                for chunk in set((text or "").split()):
                    low, begins, _ = forms(chunk)
                    if low:
                        keys.add("w" + low)
                        keys.update("b" + x for x in begins)
                for k in keys:
                    seen.setdefault(k, [0, 0])[label] += 1
            if len(seen) > 400_000:
                yield _counted(seen)
                seen = {}
        if seen:
            yield _counted(seen)

    totals = sample.agg(F.sum("label").alias("pos"), F.count("*").alias("n")).first()
    pos, neg = float(totals.pos or 0), float(totals.n - (totals.pos or 0))
    counts = sample.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(pos) + 1)) - F.log((F.col("clean") + 0.5) / (F.lit(neg) + 1))
    good = counts.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("odds", odds).where("odds > 2.5")
    found: dict[str, dict[str, float]] = {"w": {}, "b": {}}
    for kind in found:
        best = good.where(F.col("entry").startswith(kind)).orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "entry").limit(LEXICON_SIZE)
        found[kind] = {r.entry[1:]: float(r.odds) for r in best.collect()}
    return Lexicon(found["w"], found["b"])


def _counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["entry", "clean", "toxic"])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees | None
    calibration: Isotonic | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or self.calibration is None:
            return np.zeros(len(x))
        return np.clip(self.calibration.apply(self.trees.margin(x.astype(np.float64))), 0, 1)


def fit_toxicity(documents: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on at most sample_rows labelled documents.

    learn_from: a Column over id_col; only rows where it holds are learned from.
    The sample's ids (at most sample_rows) are broadcast, its texts stored once; of an id with
    several rows one text is taken.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn_from).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample_rows)
    texts = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    part = F.pmod(F.xxhash64(F.concat(F.lit("part"), F.col(id_col).cast("string"))), F.lit(4)) == 0
    one = texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    sample = stored(one.select("one.text", "label", part.alias("calibrate")), "toxic-sample")
    lexicon = learn_lexicon(sample.where("not calibrate").select("text", "label"))
    reader = Reader(lexicon)

    def featured(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [reader.features(t or "").tolist() for t in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), b.column(1), b.column(2)], names=["x", "label", "calibrate"])

    held = map_batches(sample, featured, "x array<float>, label int, calibrate boolean").toArrow()
    drop(sample)
    x = np.array(held.column("x").to_pylist(), np.float64).reshape(len(held), len(FEATURES))
    y = np.array(held.column("label").to_pylist(), np.float64)
    calibrate = np.array(held.column("calibrate").to_pylist(), bool)
    order = np.lexsort([*x.T, y])  # rows arrive in any order
    x, y, calibrate = x[order], y[order], calibrate[order]
    fit = ~calibrate
    if len(np.unique(y[fit])) < 2:
        return ToxicityModel(lexicon, None, None)
    trees = BoostedTrees().fit(x[fit], y[fit])
    use = calibrate if len(np.unique(y[calibrate])) == 2 else fit
    return ToxicityModel(lexicon, trees, Isotonic.fit(trees.margin(x[use]), y[use]))


def score_toxicity(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `score double` of every row."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # at most 2 * LEXICON_SIZE entries and the trees
    readers: dict[int, Reader] = {}

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        reader = readers.setdefault(0, Reader(held.value.lexicon))
        x = np.stack([reader.features(t or "") for t in b.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(x), pa.float64())], names=[id_col, "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    return map_batches(documents.select(id_col, F.col(text_col).cast("string")), score, f"`{id_col}` {kind}, score double", readers.clear)


def drop_toxic(documents: DataFrame, model: ToxicityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """documents without the rows that score threshold or more; all columns stay as they are."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    readers: dict[int, Reader] = {}
    names, at = documents.columns, documents.columns.index(text_col)

    def keep(b: pa.RecordBatch) -> pa.RecordBatch:
        reader = readers.setdefault(0, Reader(held.value.lexicon))
        x = np.stack([reader.features(t or "") for t in b.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays(b.columns, names=names).filter(pa.array(held.value.score(x) < threshold))

    return map_batches(documents, keep, documents.schema, readers.clear)
