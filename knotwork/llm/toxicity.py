"""Toxicity by weak supervision.

Voters are lexicon entries (fixed lists of common insults in four languages, and
word beginnings induced from training labels) and patterns. Voters whose votes
hang together beyond what the label explains form a group. A generative label
model has, for either label, the chance of each number of firing voters in each
group, so that correlations within a group are parameters of the model and
copies of one voter count as one; expectation maximisation estimates it. Its
posteriors, not the labels, train a linear classifier over word beginnings,
which scores every whole text.

Labels are read only from rows whose crc32(doc_id as text) mod 5 is not 0, and
from at most ``sample`` of them (those with the smallest hash of doc_id). At most
VOTERS beginnings vote and FEATURES are weighed, those that tell most.

Defined cases: null and empty texts score what the classifier's bias gives;
unlabelled rows count for nothing in training; without labelled rows, or with
labels of one kind only, the fixed lexicon alone votes; repeated rows give equal rows.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Common insults by language.
INSULTS_BY_LANGUAGE = {
    "en": "clown disgusting dumb dumbass garbage idiot idiots imbecile jerk loser moron morons pathetic scum stupid trash worthless",
    "de": "abschaum arschloch dumm dummkopf ekelhaft erbärmlich idiot müll nichtsnutz trottel versager wertlos widerlich",
    "es": "asqueroso basura despreciable escoria estúpido estúpida idiota imbécil inútil patético payaso tonto",
    "fr": "abruti clown crétin dégoûtant idiot imbécile minable ordure pathétique pourri stupide vaurien",
}
INSULTS = list(dict.fromkeys(w for ws in INSULTS_BY_LANGUAGE.values() for w in ws.split()))
PATTERNS = {"address": re.compile(r"\byou(?:'re| are)? (?:an? )?(?:\w+ )?(?:idiot|moron|loser|clown)"), "shout": re.compile(r"\b[A-Z]{4,}\b.*!{2,}")}
WORDS = re.compile(r"[^\W\d_]+")
#: Most labelled rows used, lengths of word beginnings, voters induced, beginnings in the classifier, and the standard errors each must stand out by.
SAMPLE, HEADS, VOTERS, FEATURES, CERTAIN = 6_000, (4, 5, 6, 7, 99), 500, 1_500, 3


#: Words whose weights a task remembers; others are looked up again.
REMEMBERED = 60_000


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def heads(word: str) -> set[str]:
    """The word's beginnings, the whole word (with its end marked) among them."""
    return {word[:n] for n in HEADS[:-1] if len(word) >= n} | {word + "$"}


def _tokens(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


#: Residual correlation from which voters share a group, states of a group (0, 1, 2, 3 or more votes), and the rows that the labels count for as a prior.
JOINED, STATES, PRIOR_ROWS = 0.6, 4, 200


def groups(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The group of each voter: single linkage over correlations that remain within the labels."""
    cov = np.zeros((votes.shape[1],) * 2)
    for label in (0, 1):
        side = votes[labels == label]
        left = side - side.mean(0) if len(side) else side
        cov += left.T @ left
    scale = np.sqrt(cov.diagonal() + 1)  # a row's worth of no correlation
    near, group = cov / np.outer(scale, scale) > JOINED, np.arange(votes.shape[1])
    np.fill_diagonal(near, True)
    while True:
        least = np.where(near, group[None, :], len(group)).min(1)
        if (least == group).all():
            return np.unique(group, return_inverse=True)[1]
        group = least


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior of label 1 for each row of votes (1: the voter says toxic, 0: it abstains).

    The labels shape the groups and, as a prior worth PRIOR_ROWS rows, the chances of a group's
    states under either label; expectation maximisation over all rows does the rest. Abstaining is
    a state as well, so a row without votes is likelier clean than the share of toxic rows says.
    """
    group = groups(votes, labels)
    n_groups, n = group.max() + 1, len(votes)
    sums = np.zeros((n, n_groups), np.int32)
    np.add.at(sums.T, group, votes.T.astype(np.int32))
    at = np.minimum(sums, STATES - 1) + STATES * np.arange(n_groups)  # the state of each group as one number
    count = lambda w: np.bincount(at.ravel(), np.repeat(w, n_groups), STATES * n_groups) + 0.5 / STATES
    share = lambda c: c.reshape(n_groups, STATES) / c.reshape(n_groups, STATES).sum(1, keepdims=True)
    sides = [(labels == label).astype(float) for label in (0, 1)]
    prior = [share(count(w)) * min(PRIOR_ROWS, w.sum()) for w in sides]
    base = min(0.5, max(1, sides[1].sum()) / n)
    post, chance = np.zeros(n), [share(p.ravel()) for p in prior]
    for _ in range(rounds):
        odds = np.log(base / (1 - base)) + np.log(chance[1] / chance[0]).ravel()[at].sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done, post = np.abs(new - post).max() < 1e-4, new
        if done:
            break
        chance = [share(count(w) + p.ravel()) for w, p in zip((1 - post, post), prior)]
    return post


def train(rows: list[tuple[str, list[int], int]]) -> tuple[dict[str, float], float]:
    """rows: (distinct words joined by spaces, pattern votes, label). Weights of word beginnings, and the bias."""
    labels = np.array([y for *_, y in rows], np.float32)
    own = lambda words: {h for w in words.split() for h in heads(w)}
    # beginnings that no three toxic rows share can't become voters or features; counting numbers first keeps the memory small
    number = lambda h: zlib.crc32(h.encode("utf-8", "surrogatepass"))
    seen = [np.array([number(h) for h in own(words)], np.uint32) for words, _, y in rows if y]
    each, times = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint32), return_counts=True)
    often, always = set(each[times >= 3].tolist()), {w + "$" for w in INSULTS}
    counts: dict[str, list[int]] = {h: [0, 0] for h in sorted(always)}
    docs = []
    for words, patterns, y in rows:
        hs = [sys.intern(h) for h in own(words) if h in always or number(h) in often]
        for h in hs:
            counts.setdefault(h, [0, 0])[y] += 1
        docs.append((hs, patterns))
    pos, neg = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    gain = {h: b * np.log((b + 0.1) / pos / ((a + 0.1) / neg)) for h, (a, b) in counts.items() if b >= 4 and (b + 0.1) / pos > 20 * (a + 0.1) / neg}
    induced = sorted(gain, key=lambda h: (-gain[h], h))[:VOTERS]
    voters = {h: j for j, h in enumerate(dict.fromkeys([w + "$" for w in INSULTS] + induced))}
    votes = np.zeros((len(docs), len(voters) + len(PATTERNS)), np.float32)
    for i, (hs, patterns) in enumerate(docs):
        votes[i, [voters[h] for h in hs if h in voters]] = 1
        votes[i, len(voters) :] = patterns
    votes = votes[:, votes.any(0)]
    if not votes.size or not labels.any() or labels.all():
        return {w + "$": 6.0 for w in INSULTS}, -3.0
    post = label_model(votes, labels).astype(np.float32)
    # log odds over their standard error: what chance explains is no feature, and can't add up in long texts
    odds = {h: abs(np.log((b + 0.5) / pos) - np.log((a + 0.5) / neg)) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) for h, (a, b) in counts.items()}
    features = {h: j for j, h in enumerate(sorted((h for h in odds if odds[h] >= CERTAIN or h in always and sum(counts[h])), key=lambda h: (-odds[h], h))[:FEATURES])}
    x = np.zeros((len(docs), len(features)), np.float32)
    for i, (hs, _) in enumerate(docs):
        x[i, [features[h] for h in hs if h in features]] = 1
    w, bias = np.zeros(len(features), np.float32), 0.0
    grow, shift = np.full(len(features), 1e-3, np.float32), 1e-3  # AdaGrad on the logistic loss against posteriors, both sides weighted alike
    sure = post > 0.5
    weight = np.where(sure, 0.5 / max(1, sure.sum()), 0.5 / max(1, (~sure).sum())).astype(np.float32)
    for _ in range(150):
        error = (1 / (1 + np.exp(-np.clip(x @ w + np.float32(bias), -30, 30))) - post) * weight
        grad = x.T @ error + 1e-5 * w
        grow += grad**2
        shift += error.sum() ** 2
        w -= 0.3 * grad / np.sqrt(grow)
        bias -= float(0.3 * error.sum() / np.sqrt(shift))
    return {h: float(w[j]) for h, j in features.items() if abs(w[j]) > 1e-3}, float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Trains on at most ``sample`` labelled rows that aren't held out."""
    spark = docs.sparkSession
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = some.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen.collect()], "doc_id long, toxic int")  # at most sample rows

    common.bounded_batches(spark)

    def words(frames):
        for f in frames:
            yield f[["doc_id", "toxic"]].assign(words=[" ".join(sorted(_tokens(t or ""))) for t in f["text"]], patterns=[[int(bool(p.search(t or ""))) for p in PATTERNS.values()] for t in f["text"]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").mapInPandas(words, "doc_id long, toxic int, words string, patterns array<int>")
    return train([(r.words, r.patterns, r.toxic) for r in sorted(rows.collect(), key=lambda r: r.doc_id)])


class Contributions(dict):
    """Word to the sum of the weights of its beginnings, remembered within bounds."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = frozenset(h for h in heads(word) if h in self.weights)
        return out


def scores(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """doc_id, score for every document; a task reads nothing but texts."""
    weights, bias = model

    def start():
        known = Contributions(weights)

        def one(text):
            # whole texts: every distinct word counts, wherever it stands
            found = frozenset().union(*map(known.__getitem__, set(WORDS.findall(text.lower()))))
            return float(1 / (1 + np.exp(-np.clip(bias + sum(weights[h] for h in sorted(found)), -30, 30))))

        return lambda texts: {"score": [one(t) for t in texts]}

    return common.per_text(docs, "score double", start)


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
