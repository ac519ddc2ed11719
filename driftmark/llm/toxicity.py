"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Strings are the words of a text: lower-case letters, with marks between letters taken out ("st.upid") and single
letters that stand in a row joined ("s t u p i d"). The kernel of two words counts their common subsequences of three
letters, each weighted by 0.7 to the number of letters it spans, gaps of up to three inserted letters included, so an
insult with letters put in still shares most of its weight with the plain one; word ends count as letters. The
landmarks' kernel matrix turns a word's kernel values into features, on which a linear machine is trained. As
both steps are linear in the subsequences, a trained model is one weight per subsequence, and scoring a word takes a
few table lookups. A text's margin is that of its most toxic word.

Labels belong to texts, not to words. The words to learn as toxic are those that stand in toxic texts between
more different neighbours than chance explains (a likelihood ratio over distinct neighbour pairs, so that copies of
one text count once), and those whose first four letters do; words of texts labelled 0 are the others.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.langid import held_out
from driftmark.llm.work import stored

DECAY, GAP = 0.7, 3
LONGEST = 24  # letters of a word that are scored at once; longer ones are scored in overlapping parts
BITS = 22  # of a subsequence's number
LANDMARKS = 256
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000  # labelled texts the model is learned from, about
STEM = 4  # letters of a word's beginning
HARD_WORDS = 2000  # clean words a first model takes for the most toxic, which the next one learns as well
MOST_WORDS = 4000  # words of either kind the machine is trained on
LEAST_RATIO = 20  # of a toxic word's share of toxic contexts to its share of clean ones
THRESHOLD = 0.3
CACHE_WORDS = 300_000

NOT_LETTER = re.compile(r"[\W\d_]+")
SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s+){2,}\w(?![\w])")


def words(text: str) -> list[str]:
    """The words of a text in order."""
    text = text.lower()
    if SPACED.search(text):
        text = SPACED.sub(lambda m: re.sub(r"\s+", "", m[0]), text)
    return [w for w in (NOT_LETTER.sub("", t) if not t.isalpha() else t for t in text.split()) if w]


def _parts(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (0: none) and weights of the three-letter subsequences of each word, which has LONGEST letters at most."""
    width = LONGEST + 2
    letters = np.zeros((len(some), width + GAP + 2), np.uint32)
    joined = np.frombuffer("".join(f"^{w}$" for w in some).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in some], np.int64)
    row = np.repeat(np.arange(len(some)), sizes)
    letters[row, np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = joined
    numbers, weights = [], []
    x = letters.astype(np.uint64)
    for span in range(3, 4 + GAP):
        for middle in range(1, span - 1):
            a, b, c = x[:, :width], x[:, middle : middle + width], x[:, span - 1 : span - 1 + width]
            key = (((a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77) + c) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
            numbers.append(np.where(c > 0, key + np.uint64(1), np.uint64(0)))
            weights.append(np.full(width, DECAY**span))
    return np.concatenate(numbers, 1).astype(np.int64), np.concatenate(weights)


def _norms(numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.sqrt(((numbers > 0) * weights**2).sum(1)) + 1e-9


@dataclass
class Model:
    weights: np.ndarray  # of each subsequence
    bias: float
    slope: float  # turns a margin into a log-odds; zero margin is THRESHOLD

    def margins(self, some: list[str]) -> np.ndarray:
        numbers, weights = subsequences(some)
        return (self.weights[numbers] * weights).sum(1) / _norms(numbers, weights) + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30))))


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, c: float = 10.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent; the last feature is the bias."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    cost = np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0).clip(1, 20) * c
    diagonal = (x * x).sum(1) + 0.5 / cost
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + 0.5 * alpha[i] / cost[i]
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def train(toxic: list[str], clean: list[str]) -> Model:
    """The model that tells the toxic words from the clean ones; without toxic words nothing is toxic."""
    if not toxic:
        return Model(np.zeros((1 << BITS) + 1), -1.0, 8.0)
    some = [p for w in toxic for p in _parts(w)] + [p for w in clean for p in _parts(w)]
    y = np.array([1.0] * sum(len(_parts(w)) for w in toxic) + [-1.0] * sum(len(_parts(w)) for w in clean))
    numbers, weights = subsequences(some)
    rows = np.repeat(np.arange(len(some)), (numbers > 0).sum(1))
    values = (np.broadcast_to(weights, numbers.shape) / _norms(numbers, weights)[:, None])[numbers > 0]
    used, column = np.unique(numbers[numbers > 0], return_inverse=True)
    half = min(2 * LANDMARKS // 3, int((y > 0).sum()))
    positive, negative = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
    marks = np.concatenate([positive[np.linspace(0, len(positive) - 1, half).astype(int)], negative[np.linspace(0, len(negative) - 1, min(LANDMARKS - half, len(negative))).astype(int)] if len(negative) else negative])
    dense = np.zeros((len(marks), len(used)))
    for i, m in enumerate(marks):
        np.add.at(dense[i], column[rows == m], values[rows == m])
    kernel = np.zeros((len(some), len(marks)))
    for j in range(len(marks)):
        kernel[:, j] = np.bincount(rows, values * dense[j][column], minlength=len(some))
    eigen, vectors = np.linalg.eigh(dense @ dense.T)
    keep = eigen > 1e-6 * eigen.max()
    root = vectors[:, keep] / np.sqrt(eigen[keep])
    features = np.concatenate([kernel @ root, np.ones((len(some), 1))], 1)
    w = _svm(features, y)
    table = np.zeros((1 << BITS) + 1)
    table[used] = dense.T @ (root @ w[:-1])
    margin = features @ w
    low = np.quantile(margin[y < 0], 0.9998) if (y < 0).any() else -1.0
    high = np.quantile(margin[y > 0], 0.05)
    border = low + 0.4 * (high - low) if high > low else low  # insults with letters put in lie below the plain ones
    return Model(table.astype(np.float32), float(w[-1] - border), 6.0 / max(0.2, high - border))


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, word, context) of the words of labelled texts and of their beginnings, as ^abcd; each once a batch."""
    for batch in batches:
        found = {(label, w, xxhash.xxh64_intdigest(f"{a} {b}") >> 1) for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()) for a, word, b in _around(words(text)) for w in ((word, "^" + word[:STEM]) if len(word) > STEM else (word,))}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.string(), pa.int64()))], ["toxic", "word", "context"])


def _around(found: list[str]) -> Iterator[tuple[str, str, str]]:
    return zip(["", *found[:-1]], found, [*found[1:], ""])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts of docs that labels (doc_id, toxic) marks 0 or 1; rows without text or label teach nothing.

    About SAMPLE_TOXIC and SAMPLE_CLEAN texts are used, chosen by a hash of doc_id. What comes to the driver is
    MOST_WORDS words of either kind at most, and twice HARD_WORDS clean ones that a model took for toxic.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return train([], [])
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_TOXIC / counts[1])).otherwise(min(1.0, SAMPLE_CLEAN / counts[0]))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select("doc_id", F.col("text").cast("string")).filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    pairs = texts.mapInArrow(_contexts, "toxic int, word string, context long").distinct()
    seen = stored(pairs.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")), "labelled-words")
    bad_all, good_all, n = seen.agg(F.sum("bad"), F.sum("good"), F.count("*")).first()
    if not bad_all:
        return train([], [])
    rate = bad_all / (bad_all + (good_all or 0))
    all_ = F.col("bad") + F.col("good")
    gain = F.col("bad") * F.log(F.col("bad") / (all_ * rate)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (all_ * (1 - rate)))).otherwise(0.0)
    # Shares of each label's own contexts, so that the labels' balance decides nothing.
    odds = float(good_all or 1) / float(bad_all)
    strong = seen.filter(F.col("bad") * odds >= LEAST_RATIO * F.col("good")).withColumn("gain", gain).filter(F.col("gain") > float(np.log(n) + 1))
    stems = strong.filter("word like '^%'").orderBy(F.desc("gain"), "word").limit(MOST_WORDS).select(F.substring("word", 2, STEM).alias("stem"))
    begun = seen.filter((F.col("good") == 0) & (F.length("word") > STEM) & ~F.col("word").like("^%")).withColumn("stem", F.substring("word", 1, STEM))
    begun = begun.join(F.broadcast(stems), "stem", "left_semi").select("word", F.col("bad").cast("double").alias("gain"))
    toxic = strong.filter("word not like '^%'").select("word", "gain").unionByName(begun).groupBy("word").agg(F.max("gain").alias("gain"))
    toxic = [r["word"] for r in toxic.orderBy(F.desc("gain"), "word").limit(MOST_WORDS).collect()]
    clean = seen.filter("good > 0 and word not like '^%'").filter(F.col("good") * 2 > F.col("bad") * odds)
    if not toxic:
        warnings.warn("labelled texts teach no toxic word: every text will be scored as clean", stacklevel=2)
    frequent = [r["word"] for r in clean.orderBy(F.desc("good"), "word").limit(MOST_WORDS // 4).collect()]
    others = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(MOST_WORDS).collect()]
    taught = set(frequent) | set(others)
    model = train(toxic, sorted(taught))
    for _ in range(2 if toxic else 0):
        sent = docs.sparkSession.sparkContext.broadcast(model)
        margins = clean.select("word").mapInArrow(partial(_margins, model=sent), "word string, margin double")
        taught |= {r["word"] for r in margins.orderBy(F.desc("margin"), "word").limit(HARD_WORDS).collect()}
        model = train(toxic, sorted(taught))
    return model


def _margins(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some = batch.column("word").to_pylist()
        for i in range(0, len(some), 2048):
            part = some[i : i + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(_word_margins(part, model.value))], ["word", "margin"])


def _word_margins(some: list[str], model: Model) -> np.ndarray:
    """Margin of each word: the highest of its parts."""
    parts = [_parts(w) for w in some]
    ends = np.cumsum([len(ps) for ps in parts])
    return np.maximum.reduceat(model.margins([p for ps in parts for p in ps]), ends - [len(ps) for ps in parts])


def _score(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model, known = model.value, {}
    for batch in batches:
        scores = []
        for text in batch.column("__text"):
            found = dict.fromkeys(words(text.as_py() or ""))
            new = [w for w in found if w not in known]
            if new:
                if len(known) + len(new) > CACHE_WORDS:
                    known, new = {}, list(found)
                for i in range(0, len(new), 2048):
                    some = new[i : i + 2048]
                    known.update(zip(some, _word_margins(some, model).tolist()))
            scores.append(model.probability(max((known[w] for w in found), default=-10.0)))
        keep = [c for c in batch.schema.names if c != "__text"]
        predicted = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), predicted], [*keep, "score", "predicted"])


def scored(docs: DataFrame, model: Model, *keep: Column | str) -> DataFrame:
    """The kept columns of docs with score (0 to 1, higher is more toxic) and predicted (1 if score is 0.3 or more).

    A null or empty text, or one without letters, has the score of no toxic word at all. Each row is judged alone, so
    repeated rows get equal scores; an empty table gives no rows.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_score, model=sent), f"{schema}, score double, predicted int")


def teachable(rows: DataFrame) -> DataFrame:
    return rows.filter(~held_out(F.col("doc_id")))
