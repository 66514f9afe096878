"""Subject areas of documents: classifier chains over term, source and structure features.

Training, on the driver, over at most ``most_labelled`` labelled documents (chosen by a hash of their id):

1. Terms: a mixture of word distributions, one per subject and one for everything else, is fitted to the sentences of the
   labelled documents by expectation maximisation.  A sentence may speak of a subject of its document or of none;
   ``wrong_labels`` is the share of labels taken to be wrong.
2. Structure and source: the share of a document's sentences that speak of each subject, whether it reaches ``quarter``,
   the number of sentences, and the source.
3. Chains: one regularised logistic regression per subject over these features and the subjects decided before it,
   so that subjects which go together help each other; each is calibrated on held-out documents.

Scoring, on executors: every document's features, then a beam search over the chain for the most likely combination of
subjects.  Null and blank texts have no subject.  Repeated documents get the same subjects.  Null, unknown and repeated
labels are tolerated: a document whose labels are all null has no subject.  Without any labelled document nothing is assigned.
"""

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import words
from quirefold.session import spread

_END = re.compile(r"[.!?…。！？]+[\"”’»)\]]*(?=\s|$)|\n+")


@dataclass
class Sentences:
    """Words of a batch of texts by sentence."""

    word: np.ndarray
    sentence: np.ndarray
    document: np.ndarray  # of each sentence
    texts: int


def split(texts: list[str]) -> Sentences:
    """Sentences end at stops and line ends; pieces without a word are none."""
    low = [t.lower() for t in texts]
    value, number, start, _ = words.word_hashes(low)
    bounds = []
    for k, t in enumerate(low):
        bounds.append(np.fromiter((m.end() for m in _END.finditer(t)), dtype=np.int64))
    sizes = np.array([len(b) + 1 for b in bounds], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, dtype=np.int64)
    cuts = np.searchsorted(number, np.arange(len(texts) + 1))
    raw = np.empty(len(value), dtype=np.int64)
    for k in range(len(texts)):
        lo, hi = cuts[k], cuts[k + 1]
        raw[lo:hi] = first[k] + np.searchsorted(bounds[k], start[lo:hi], side="right")
    kept, sentence = np.unique(raw, return_inverse=True)
    document = np.searchsorted(first, kept, side="right") - 1
    return Sentences(value, sentence, document, len(texts))


@dataclass
class Terms:
    """Log weights of words by class; the last class is everything else."""

    vocabulary: np.ndarray
    weights: np.ndarray

    def of(self, s: Sentences) -> np.ndarray:
        """Sentences x classes: log likelihoods."""
        n, classes = len(s.document), self.weights.shape[1]
        at = np.searchsorted(self.vocabulary, s.word)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == s.word
        out = np.zeros((n, classes))
        for c in range(classes):
            out[:, c] = np.bincount(s.sentence[known], weights=self.weights[at[known], c], minlength=n)
        return out


def lifts(s: Sentences, labels: np.ndarray, word: np.ndarray, size: int, caution: float = 4.0, least: int = 3) -> np.ndarray:
    """Words x subjects: how much more often than usual the documents with a word have a subject, as a logarithm.

    Words that go with every subject alike, such as those of the phrases around, get weights near 0.
    """
    pairs = np.unique(s.document[s.sentence] * np.int64(size) + word)
    document, own = pairs // size, pairs % size
    n = np.bincount(own, minlength=size)
    base = np.maximum(labels.mean(axis=0), 1e-3)
    out = np.zeros((size, labels.shape[1]))
    for c in range(labels.shape[1]):
        with_it = np.bincount(own, weights=labels[document, c], minlength=size)
        out[:, c] = np.log((with_it + caution * base[c]) / (n + caution) / base[c])
    out[n < least] = 0
    return np.maximum(out, 0)


def fit_terms(s: Sentences, labels: np.ndarray, rounds: int = 5, least: int = 2, wrong_labels: float = 0.03) -> Terms:
    """Expectation maximisation that starts from the lifts of words; ``labels`` is documents x subjects."""
    vocabulary, word = np.unique(s.word, return_inverse=True)
    counts = np.bincount(word)
    kept = counts >= least
    lift = lifts(s, labels, word, len(vocabulary))
    new = np.cumsum(kept) - 1
    use = kept[word]
    word, sentence, vocabulary = new[word[use]], s.sentence[use], vocabulary[kept]
    k = labels.shape[1]
    allowed = np.full((len(labels), k + 1), wrong_labels / k)
    allowed[:, :k][labels > 0] = 1.0
    allowed[:, k] = 1.0
    allowed /= allowed.sum(axis=1, keepdims=True)
    prior = np.log(allowed[s.document])
    start = prior.copy()
    for c in range(k):
        start[:, c] += 1.5 * np.bincount(sentence, weights=np.maximum(lift[kept][word, c] - 0.7, 0), minlength=len(prior))
    start[:, k] += 1.5
    start -= start.max(axis=1, keepdims=True)
    post = np.exp(start)
    post /= post.sum(axis=1, keepdims=True)
    weights = np.zeros((len(vocabulary), k + 1))
    for _ in range(rounds):
        for c in range(k + 1):
            mass = np.bincount(word, weights=post[sentence, c], minlength=len(vocabulary)) + 0.02
            weights[:, c] = np.log(mass / mass.sum())
        score = prior.copy()
        for c in range(k + 1):
            score[:, c] += np.bincount(sentence, weights=weights[word, c], minlength=len(prior))
        score -= score.max(axis=1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(axis=1, keepdims=True)
    return Terms(vocabulary, weights - weights[:, [k]])


def features(
    s: Sentences, terms: Terms, sources: list[str | None], known: list[str], quarter: float, mixing: int = 2
) -> tuple[np.ndarray, np.ndarray]:
    """(documents x features, documents x subjects shares of sentences)."""
    k = terms.weights.shape[1] - 1
    score = terms.of(s)
    score[:, k] += 1.0  # a sentence needs evidence to speak of a subject
    total = np.bincount(s.document, minlength=s.texts)
    prior = np.zeros_like(score)
    for _ in range(mixing):  # sentences of one document tend to speak of the same subjects
        post = np.exp(score + prior - (score + prior).max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mix = np.stack([np.bincount(s.document, weights=post[:, c], minlength=s.texts) for c in range(k + 1)], axis=1)
        mix = np.log(mix / np.maximum(total, 1)[:, None] + 0.03)
        prior = mix[s.document] - mix.max(axis=1)[s.document][:, None]
    of = (score + prior).argmax(axis=1)
    share = np.zeros((s.texts, k))
    for c in range(k):
        share[:, c] = np.bincount(s.document[of == c], minlength=s.texts) / np.maximum(total, 1)
    strong = np.zeros((s.texts, k))
    for c in range(k):
        strong[:, c] = np.bincount(s.document, weights=np.clip(score[:, c] - score[:, k], 0, 20), minlength=s.texts) / np.maximum(total, 1)
    place = {x: i for i, x in enumerate(known)}
    source = np.zeros((s.texts, len(known) + 1))
    source[np.arange(s.texts), [place.get(x, len(known)) for x in sources]] = 1
    reach = 1 / (1 + np.exp(-np.clip((share - quarter + 0.01) * 80, -30, 30)))
    full = np.hstack([share * 4, reach * 2, strong / 5, np.log1p(total)[:, None] / 3, source, np.ones((s.texts, 1))])
    full[total == 0] = 0
    return full, share


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Everything that scoring needs; its size depends on the vocabulary of the training sample only."""

    subjects: list[str]
    sources: list[str]
    quarter: float
    terms: Terms
    order: list[int]
    chain: list[np.ndarray]
    calibration: list[tuple[float, float]]
    beam: int

    def decide(self, s: Sentences, sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(documents x subjects decisions, documents x subjects probabilities along the chosen path)."""
        x, share = features(s, self.terms, sources, self.sources, self.quarter)
        n, k = len(x), len(self.subjects)
        paths, chance = np.zeros((n, 1, k)), np.zeros((n, 1))
        given = np.zeros((n, 1, k))
        for step, c in enumerate(self.order):
            w, (a, b) = self.chain[step], self.calibration[step]
            raw = (x @ w[: x.shape[1]])[:, None] + paths[:, :, self.order[:step]] @ w[x.shape[1] :]
            p = np.clip(1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30))), 1e-9, 1 - 1e-9)
            with_it, with_p = paths.copy(), given.copy()
            with_it[:, :, c], with_p[:, :, c] = 1, p
            without_p = given.copy()
            without_p[:, :, c] = p
            paths = np.concatenate([paths, with_it], axis=1)
            given = np.concatenate([without_p, with_p], axis=1)
            chance = np.concatenate([chance + np.log(1 - p), chance + np.log(p)], axis=1)
            if paths.shape[1] > self.beam:
                top = np.argsort(-chance, axis=1, kind="stable")[:, : self.beam]
                rows = np.arange(n)[:, None]
                paths, given, chance = paths[rows, top], given[rows, top], chance[rows, top]
        best = chance.argmax(axis=1)
        rows = np.arange(n)
        decided = paths[rows, best]
        decided[np.bincount(s.document, minlength=n) == 0] = 0
        return decided, given[rows, best]


def train(
    texts: list[str], sources: list[str | None], labels: np.ndarray, subjects: list[str], quarter: float = 0.25, beam: int = 8
) -> Model:
    """Fits terms, chain and calibration; every fourth document is held out from the chain for the calibration."""
    s = split(texts)
    terms = fit_terms(s, labels)
    known = sorted({x for x in sources if x is not None})[:200]
    x, _ = features(s, terms, sources, known, quarter)
    order = np.argsort(-labels.sum(axis=0), kind="stable").tolist()
    held = np.arange(len(texts)) % 4 == 3
    if held.sum() < 20:
        held[:] = False
    chain, calibration = [], []
    for step, c in enumerate(order):
        both = np.hstack([x, labels[:, order[:step]]])
        w = logistic(both[~held], labels[~held, c])
        scale = (1.0, 0.0)
        if 5 <= labels[held, c].sum() <= held.sum() - 5:
            raw = np.clip(both[held] @ w, -30, 30)
            a, b = logistic(np.stack([raw, np.ones(len(raw))], axis=1), labels[held, c], penalty=0.1)
            scale = (float(a), float(b)) if a > 0 else scale
        chain.append(w)
        calibration.append(scale)
    return Model(subjects, known, quarter, terms, order, chain, calibration, beam)


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                s = split(part["text"].tolist())
                decided, chance = model.decide(s, part["source"].tolist())
                row, c = np.nonzero(decided)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy()[row],
                        "subject": np.array(model.subjects, dtype=object)[c],
                        "probability": chance[row, c],
                    }
                )

    return run


def labelled_sample(documents: DataFrame, doc_labels: DataFrame, subjects: list[str], most_labelled: int) -> tuple[list, list, np.ndarray]:
    """Texts, sources and label matrix of at most ``most_labelled`` labelled documents, chosen by a hash of doc_id."""
    labels = doc_labels.groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    rows = (
        documents.select("doc_id", "text", "source")
        .where("text IS NOT NULL")
        .join(labels, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
        .collect()
    )
    place = {x: i for i, x in enumerate(subjects)}
    matrix = np.zeros((len(rows), len(subjects)))
    for i, r in enumerate(rows):
        for x in r["labels"]:
            if x in place:
                matrix[i, place[x]] = 1
    return [r["text"] for r in rows], [r["source"] for r in rows], matrix


def assign(
    documents: DataFrame, doc_labels: DataFrame, subjects: DataFrame, most_labelled: int = 20_000, quarter: float = 0.25, beam: int = 8
) -> DataFrame:
    """(doc_id, subject, probability) for each subject of each document.

    ``documents`` has doc_id, text and source, ``doc_labels`` doc_id and subject, ``subjects`` subject (a short list);
    other columns are ignored.
    """
    spark = documents.sparkSession
    schema = "doc_id long, subject string, probability double"
    names = [r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    texts, sources, labels = labelled_sample(documents, doc_labels, names, most_labelled)
    if not names or not labels.any():
        return spark.createDataFrame([], schema)
    model = train(texts, sources, labels, names, quarter, beam)
    return spread(documents.select("doc_id", "text", "source").where("text IS NOT NULL")).mapInPandas(_score(model), schema)
