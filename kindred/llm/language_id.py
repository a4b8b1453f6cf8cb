"""Language of texts: averaged embeddings of hashed subwords and a linear softmax.

A text is lower-cased; its subwords are the runs of one to four characters inside words (letters
and the marks on them), where a sign before or after a word counts as its edge. Each subword has
a row of a table of embeddings, by its hash. The mean of a text's rows goes through a linear
layer and a softmax. Table and layer are trained together by stochastic gradient descent in
numpy, with steps scaled by the gradients so far; rows that no training text has stay zero, so
unknown subwords say nothing.

Fitting uses at most `sample_rows` texts, dealt to the languages by hashes of the texts in equal
quotas; each gives two examples, the whole text and a short excerpt, so that short texts are
known too. A fourth of them is left out of training and calibrates: a temperature makes the
softmax probabilities honest, and the rejection bound is the least score from which on the texts
left out are right as often as `target` asks. Prediction covers every whole text.

Defined results: texts that are null or have no letter are `und` with score 0. Without any
labelled row all texts are `und`. Repeated ids are predicted row by row, equal texts alike;
other columns are not read. Texts of any length are read in pieces.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow_rows import map_batches
from kindred.plans.stored import drop, stored

#: Texts that the classifier is fitted on, about (twice as many at most), and languages it learns, at most: the most frequent ones.
SAMPLE_ROWS, LANGUAGES = 6000, 256
#: Rows and columns of the table of embeddings.
BUCKETS, WIDTH = 1 << 14, 16
#: Words of a training excerpt.
EXCERPT = 12
#: Code points handled at once.
SEGMENT = 1 << 17
#: Characters of the longest subword.
LONGEST = 4
UNKNOWN = "und"

_STEP = np.uint32(0x01000193)


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks, 0 for anything else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _codes(text: str) -> np.ndarray:
    """The code points of a lower-cased text between two signs; whatever is not of a word is 0."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_kinds()[raw] > 0, raw, 0).astype(np.uint32)


def _pieces(text: str) -> list[tuple[np.ndarray, int]]:
    """Pieces of a text's code points and how many subword starts of each count; pieces overlap by what the last starts need."""
    codes = _codes(text)
    if len(codes) <= SEGMENT:
        return [(codes, len(codes))]
    return [(codes[lo : lo + SEGMENT + LONGEST - 1], min(SEGMENT, len(codes) - lo)) for lo in range(0, len(codes), SEGMENT)]


def buckets(codes: np.ndarray) -> list[np.ndarray]:
    """For each length of subwords, the table row of the one that starts at each place; BUCKETS where there is none."""
    word = codes > 0
    n = len(codes)
    out, h = [], np.zeros(n, np.uint32)
    inner = np.ones(n, bool)  # whether all but the first and the last character are of a word
    for k in range(1, min(LONGEST, n) + 1):
        m = n - k + 1
        h = (h[:m] + codes[k - 1 :]) * _STEP
        h = h ^ (h >> np.uint32(15))
        if k == 1:
            there = word
        elif k == 2:
            there = word[:m] | word[1:]
        else:
            inner = inner[:m] & word[k - 2 : k - 2 + m]
            there = inner
        mixed = (h ^ np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        mixed = ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        found = np.full(n, BUCKETS, np.int64)
        found[:m] = np.where(there, mixed, BUCKETS)
        out.append(found)
    return out


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of a whole text's subwords, each once, and their shares of all subwords."""
    counts = np.zeros(BUCKETS + 1, np.int64)
    for codes, own in _pieces(text):
        for found in buckets(codes):
            counts += np.bincount(found[:own], minlength=BUCKETS + 1)
    at = np.flatnonzero(counts[:BUCKETS])
    return at, (counts[at] / max(1, counts[at].sum())).astype(np.float32)


def has_letter(codes: np.ndarray) -> bool:
    return bool((_kinds()[codes] == 2).any())


@dataclass
class LanguageModel:
    """embeddings: BUCKETS by WIDTH; layer: WIDTH by languages; bound: scores below it are rejected."""

    languages: list[str]
    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bound: float = 0.0

    def logits(self, means: np.ndarray) -> np.ndarray:
        """means: of the embeddings of each text's subwords."""
        return means @ self.layer + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


class Reader:
    """Predicts texts batch by batch.

    The mean of rows and the linear layer may change places: with fewer languages than columns
    the table is multiplied by the layer once, and a text's logits are the mean of those rows.
    """

    def __init__(self, model: LanguageModel):
        self.model, self.folded = model, len(model.languages) < model.embeddings.shape[1]
        table = (model.embeddings @ model.layer if self.folded else model.embeddings).astype(np.float64)
        self.table = np.concatenate([np.column_stack([table, np.ones(len(table))]), np.zeros((1, table.shape[1] + 1))])  # the last column counts

    def _sums(self, codes: np.ndarray, starts: np.ndarray, own: int) -> np.ndarray:
        """Sums of the table's rows from each start to the next, over the first `own` places."""
        total = sum(self.table[found[:own]] for found in buckets(codes))
        return np.add.reduceat(total, starts, axis=0)

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: sums of rows with the number of subwords in the last column, and whether it has a letter."""
        out, letters = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts), bool)
        held: list[np.ndarray] = []
        rows: list[int] = []

        def flush() -> None:
            if held:
                sizes = np.array([len(c) for c in held])
                out[rows] = self._sums(np.concatenate(held), np.cumsum(sizes) - sizes, int(sizes.sum()))
                held.clear()
                rows.clear()

        waiting = 0
        for i, text in enumerate(texts):
            pieces = _pieces(text)
            letters[i] = any(has_letter(codes) for codes, _ in pieces)
            if len(pieces) > 1:
                for codes, own in pieces:
                    out[i] += self._sums(codes, np.zeros(1, np.int64), own)[0]
            else:
                held.append(pieces[0][0])
                rows.append(i)
                waiting += len(pieces[0][0])
                if waiting > SEGMENT:
                    flush()
                    waiting = 0
        flush()
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and scores."""
        model = self.model
        sums, letters = self.sums(texts)
        if not model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        means = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        p = model.probabilities(means + model.bias if self.folded else model.logits(means))
        best = p.argmax(1)
        return [model.languages[k] if letter else UNKNOWN for k, letter in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, p.max(1), 0.0)


def train(rows: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, languages: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.1) -> LanguageModel:
    """Stochastic gradient descent on batches of texts, given by their subwords and shares."""
    r = np.random.RandomState(11)
    table, layer, bias = np.zeros((BUCKETS, WIDTH), np.float32), r.normal(0, 1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    seen = [np.full(x.shape, 1e-8, np.float32) for x in (table, layer, bias)]
    for epoch in range(epochs):
        order = r.permutation(len(labels))
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            used, at = np.unique(np.concatenate([rows[i] for i in chosen]), return_inverse=True)
            dense = np.zeros((len(chosen), len(used)), np.float32)
            dense[np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen]), at] = np.concatenate([shares[i] for i in chosen])
            means = dense @ table[used]
            z = means @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p /= len(chosen)
            slopes = (dense.T @ (p @ layer.T), means.T @ p, p.sum(0))
            for value, past, slope, which in zip((table, layer, bias), seen, slopes, (used, slice(None), slice(None)), strict=True):
                past[which] += slope * slope
                value[which] -= step * slope / np.sqrt(past[which])
    return LanguageModel(languages, table, layer, bias)


def calibrate(model: LanguageModel, logits: np.ndarray, labels: np.ndarray, target: float) -> LanguageModel:
    """Sets the temperature of least log loss and the rejection bound on texts that training hasn't seen."""
    if len(labels):

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(np.maximum(model.probabilities(logits)[np.arange(len(labels)), labels], 1e-12)).mean())

        model.temperature = min(np.exp(np.linspace(-1, 3, 41)).tolist(), key=loss)
        p = model.probabilities(logits)
        order = np.argsort(-p.max(1), kind="stable")
        right = (p.argmax(1) == labels)[order].cumsum()
        good = np.flatnonzero(right + 1 >= target * (np.arange(len(order)) + 1))  # one error is always allowed
        model.bound = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def fit_languages(documents: DataFrame, learn_from: Column, lang_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, target: float = 0.99) -> LanguageModel:
    """Fits on about sample_rows texts with a language.

    learn_from: a Column; only rows where it holds are learned from. Languages' counts (at most
    LANGUAGES rows) and the chosen texts' subwords (at most BUCKETS numbers for each of at most
    2 * sample_rows texts) reach the driver.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = documents.where(learn_from).select(text.alias("text"), lang.alias("lang")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    quota = sample_rows / len(languages)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, quota / r["count"])))])
    chance = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(chance < F.element_at(share, F.col("lang"))).dropDuplicates(["text", "lang"]).limit(2 * sample_rows)
    part = F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(4)) == 0
    sample = stored(chosen.select("text", "lang", part.alias("calibrate"), F.pmod(F.xxhash64(F.lit("excerpt"), "text"), F.lit(1 << 30)).alias("at")), "language-sample")

    def examples(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for text, lang, calibrate_, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = text.split()
            for t in (text, " ".join(words[(lo := at % max(1, len(words))) : lo + EXCERPT])):
                found, shares = subwords(t)
                if len(found):
                    for o, v in zip(out, (lang, calibrate_, found, shares), strict=True):
                        o.append(v)
        kinds = (pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["lang", "calibrate", "rows", "shares"])

    held = map_batches(sample, examples, "lang string, calibrate boolean, rows array<int>, shares array<float>").toArrow()
    drop(sample)
    labels = np.array([languages.index(x) for x in held.column("lang").to_pylist()], np.int64)
    left_out = np.array(held.column("calibrate").to_pylist(), bool)
    if not len(labels):
        return LanguageModel([], np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    found = [x.values.to_numpy() for x in held.column("rows")]
    shares = [x.values.to_numpy() for x in held.column("shares")]
    order = sorted(range(len(labels)), key=lambda i: (labels[i], len(found[i]), found[i].tobytes(), shares[i].tobytes()))  # rows arrive in any order
    fit, rest = [i for i in order if not left_out[i]], [i for i in order if left_out[i]]
    if not fit:
        fit, rest = rest, []
    model = train([found[i] for i in fit], [shares[i] for i in fit], labels[fit], languages)
    means = np.array([shares[i] @ model.embeddings[found[i]] for i in rest]).reshape(len(rest), WIDTH)
    return calibrate(model, model.logits(means), labels[rest], target)


def identify_languages(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang (of the model, or `und`), score and accepted (whether the score reaches the model's bound) of every row."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS by WIDTH numbers and a layer of WIDTH by LANGUAGES at most
    readers: dict[int, Reader] = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        reader = readers.get(0) or readers.setdefault(0, Reader(held.value))
        found, scores = reader.predict([t or "" for t in b.column(1).to_pylist()])
        accepted = [x != UNKNOWN and s >= reader.model.bound for x, s in zip(found, scores.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=[id_col, "lang_pred", "score", "accepted"])

    kind = documents.schema[id_col].dataType.simpleString()
    return map_batches(documents.select(id_col, F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean", readers.clear)
