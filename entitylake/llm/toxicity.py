"""Toxicity: gapped subsequence string kernel, Nystroem landmarks, support vector machine.

The kernel of two words counts common subsequences of three letters, each occurrence weighted by DECAY to the power of its span, so
inserted letters and gaps cost a factor instead of the match. Characters that aren't letters never enter, and single letters in
a row are one word. A sentence is compared with a landmark by its closest word. Landmarks are the words of the labelled sentences that
tell the labels apart most; the Nystroem map (kernel to the landmarks times the inverse root of
their own kernel) makes the machine linear. It learns from sentences: all of clean documents, and of each toxic document those
near a landmark, then over a few rounds those that the machine itself finds toxic and the worst one at least. A
document is judged by its three worst sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import bounded_sample, fold_part

DECAY, SPAN, LETTERS, WIDTH = 0.75, 5, 32, 24
#: Kernel values below this are none; it keeps the features of ordinary words empty.
LEAST = 0.5
#: Words whose kernel values a worker keeps; above it, it starts anew.
MOST_KNOWN = 300_000
LANDMARKS, COMMON = 128, 32
#: How many times more often a landmark is in toxic documents than in others, at least.
RATIO = 8
#: Worst sentences of a document that its score is made of.
WORST = 3
#: The bound of the fitted sample: labelled rows per label, and their longest text.
SAMPLE_ROWS, SAMPLE_CHARS = 2_000, 20_000

SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")
SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\s.*_\-]{1,2}){3,}[^\W\d_](?![^\W\d_])")
NO_LETTER = re.compile(r"[\W\d_]+")
#: Offsets of the second and third letter of a subsequence from its first, and its weight.
SHAPES = [(j, k, DECAY ** (k + 1)) for j, k in combinations(range(1, SPAN + 1), 2)]


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of the whole text, lower case, as they stand."""
    joined = SPACED.sub(lambda m: NO_LETTER.sub("", m[0]), text.lower())
    return [words for words in (part.split() for part in SENTENCE.split(joined)) if words]


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes 1 to 31 of words, padded with 0; longer words become several rows that overlap. Rows and their word."""
    rows, owner = [], []
    for i, word in enumerate(words):
        only = NO_LETTER.sub("", word) if not word.isalpha() else word
        if len(only) >= 3:
            for at in range(0, max(1, len(only) - SPAN), WIDTH - SPAN):
                rows.append(only[at : at + WIDTH])
                owner.append(i)
    if not rows:
        return np.zeros((0, WIDTH + SPAN), dtype=np.int32), np.zeros(0, dtype=np.int64)
    flat = np.frombuffer("".join(x.ljust(WIDTH, "\0") for x in rows).encode("utf-32-le", "replace"), dtype=np.uint32).reshape(len(rows), WIDTH)
    plain = (flat >= 97) & (flat <= 122)
    codes = np.where(flat == 0, 0, np.where(plain, flat - 96, 27 + flat % 5))
    out = np.zeros((len(rows), WIDTH + SPAN), dtype=np.int32)
    out[:, :WIDTH] = codes
    return out, np.array(owner)


def subsequences(codes: np.ndarray):
    """(index of a letter triple, weight, whether it is there) for each shape; a column per first letter."""
    first = codes[:, :WIDTH] * (LETTERS * LETTERS)
    for j, k, weight in SHAPES:
        last = codes[:, k : k + WIDTH]
        yield first + codes[:, j : j + WIDTH] * LETTERS + last, weight, last > 0


def norms(codes: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(sum(weight * weight * there.sum(axis=1) for _, weight, there in subsequences(codes)), 1e-12))


def profiles(words: list[str]) -> np.ndarray:
    """Normalised subsequence weights of words, a column each."""
    out = np.zeros((LETTERS**3, len(words)), dtype=np.float32)
    codes, owner = letter_codes(words)
    norm = norms(codes)
    for index, weight, there in subsequences(codes):
        row, _ = np.nonzero(there)
        np.add.at(out, (index[there], owner[row]), weight / norm[row])
    return out / np.maximum(1e-12, np.sqrt((out * out).sum(axis=0)))


@dataclass
class Machine:
    landmarks: list[str]
    profile: np.ndarray  # subsequences x landmarks
    best: np.ndarray  # the largest weight of each subsequence in any landmark
    root: np.ndarray  # inverse root of the landmarks' kernel
    weights: np.ndarray
    bias: float = 0.0
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0] + [0.0] * WORST))
    known: dict[str, int] = field(default_factory=dict)
    held: list[np.ndarray] = field(default_factory=list)

    def remember(self, words: set[str]) -> tuple[dict[str, int], list[np.ndarray]]:
        """Known words with the place of their kernel values, -1 for words near no landmark; new ones are added first."""
        if len(self.known) > MOST_KNOWN:
            self.known, self.held = {}, []
        new = sorted(words.difference(self.known))
        near, values = self.similar(new)
        self.known.update(dict.fromkeys(new, -1))
        for i, value in zip(near.tolist(), values):
            self.known[new[i]] = len(self.held)
            self.held.append(value)
        return self.known, self.held

    def similar(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words near any landmark (their numbers) and their kernel with every landmark."""
        codes, owner = letter_codes(words)
        if not len(codes):
            return np.zeros(0, dtype=np.int64), np.zeros((0, len(self.landmarks)), dtype=np.float32)
        norm = norms(codes)
        bound = sum(weight * self.best[index].sum(axis=1) for index, weight, _ in subsequences(codes)) / norm
        near = np.flatnonzero(bound >= LEAST)  # the sum of the largest weights is never below the kernel
        names, values = [], []
        for at in range(0, len(near), 256):
            some = near[at : at + 256]
            # an index that isn't there ends in class 0, which no landmark has, so its row is zero
            value = sum(weight * self.profile[index].sum(axis=1) for index, weight, _ in subsequences(codes[some]))
            value /= norm[some][:, None].astype(np.float32)
            value[value < LEAST] = 0
            kept = value.max(axis=1) > 0
            names.append(owner[some][kept])
            values.append(value[kept])
        if not names:
            return np.zeros(0, dtype=np.int64), np.zeros((0, len(self.landmarks)), dtype=np.float32)
        name, value = np.concatenate(names), np.concatenate(values)
        only, back = np.unique(name, return_inverse=True)
        most = np.zeros((len(only), value.shape[1]), dtype=np.float32)
        np.maximum.at(most, back, value)
        return only, most

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.root @ self.weights + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability that a text is toxic, by its worst sentence; a text without words has the score of an empty sentence."""
        found = [(text, self.margins(features)) for text, _, features in near_sentences(self, texts)]
        return logistic(worst_margins(len(texts), self.bias, found) @ self.scale)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def worst_margins(n: int, least: float, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per text its WORST highest margins, highest first, and a one; `least` stands for sentences that were not found."""
    out = np.full((n, WORST + 1), least)
    out[:, -1] = 1
    if found:
        text, margin = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-margin, text))
        text, margin = text[order], np.maximum(margin[order], least)
        place = np.arange(len(text)) - np.searchsorted(text, text)
        some = place < WORST
        out[text[some], place[some]] = margin[some]
    return out


def near_sentences(machine: Machine, texts: list[str], group_chars: int = 1 << 19):
    """(text, sentence in its text, features) of all sentences with a word near a landmark; others have no features."""
    at = 0
    while at < len(texts):
        until, size = at, 0
        while until < len(texts) and (until == at or size + len(texts[until]) <= group_chars):
            size += len(texts[until])
            until += 1
        split = [sentences(x) for x in texts[at:until]]
        known, held = machine.remember({w for parts in split for words in parts for w in words})
        owner, order, features = [], [], []
        for i, parts in enumerate(split, at):
            for j, words in enumerate(parts):
                hits = [row for row in map(known.__getitem__, words) if row >= 0]
                if hits:
                    owner.append(i)
                    order.append(j)
                    features.append(held[hits[0]] if len(hits) == 1 else np.maximum.reduce([held[row] for row in hits]))
        if owner:
            yield np.array(owner), np.array(order), np.stack(features)
        at = until


def separate(x: np.ndarray, y: np.ndarray, cost: np.ndarray, regular: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    rows = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), axis=1).astype(np.float64)
    ridge = np.full(rows.shape[1], regular * cost.sum())
    ridge[-1] *= 1e-3
    w, inside = np.zeros(rows.shape[1]), None
    for _ in range(steps):
        now = y * (rows @ w) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        some, c = rows[inside], cost[inside]
        w = np.linalg.solve((some * c[:, None]).T @ some + np.diag(ridge), some.T @ (c * y[inside]))
    return w[:-1], float(w[-1])


def telling_words(texts: list[str], toxic: np.ndarray) -> tuple[list[tuple[float, str]], list[str]]:
    """Words by how much more often documents with the label hold them, in standard errors; and all words, commonest first."""
    with_label, without = Counter(), Counter()
    for text, label in zip(texts, toxic):
        (with_label if label else without).update({NO_LETTER.sub("", w) for part in sentences(text) for w in part})
    common = sorted(((n + with_label[w], w) for w, n in without.items() if len(w) >= 3), key=lambda x: (-x[0], x[1]))[: 10 * COMMON]
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    found = []
    for word, n in with_label.items():
        if len(word) >= 3:
            p1, p0 = n / n1, (without[word] + 0.5) / n0
            if p1 < RATIO * p0:
                continue
            p = (n + without[word]) / (n1 + n0)
            found.append(((p1 - p0) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)), word))
    return sorted(found, key=lambda x: (-x[0], x[1])), [w for _, w in common]


def fit(texts: list[str], toxic: np.ndarray, share: float, rounds: int = 4) -> Machine:
    """The machine of labelled texts. `share` is the toxic share of all labelled rows, which the scores are calibrated to."""
    ranked, common = telling_words(texts, toxic)
    strength = {word: score for score, word in ranked}
    plain = [w for w in common if strength.get(w, 0) < 3][:COMMON]
    landmarks = [w for score, w in ranked if score >= 3][:LANDMARKS] or plain or ["none"]
    profile = profiles(landmarks)
    kernel = profile.T @ profile
    value, vector = np.linalg.eigh(kernel.astype(np.float64))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    machine = Machine(landmarks, profile, profile.max(axis=1), root, np.zeros(len(landmarks)))
    found = list(near_sentences(machine, texts))
    owner = np.concatenate([x[0] for x in found]) if found else np.zeros(0, dtype=np.int64)
    features = np.concatenate([x[2] for x in found]) if found else np.zeros((0, len(landmarks)), dtype=np.float32)
    mapped = features @ root.astype(np.float32)
    judged = np.ones(len(features))
    clean = np.flatnonzero(~toxic[owner])
    nothing = np.zeros((1 + int((~toxic).sum()) // 4, mapped.shape[1]), dtype=np.float32)
    for _ in range(rounds):
        worst: dict[int, int] = {}
        for i in np.argsort(judged, kind="stable").tolist():
            if toxic[owner[i]]:
                worst[int(owner[i])] = i
        positive = np.union1d(np.array(list(worst.values()), dtype=np.int64), np.flatnonzero(toxic[owner] & (judged > 0)))
        if not len(positive):
            break
        x = np.concatenate((mapped[positive], mapped[clean], nothing))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(clean) + len(nothing))))
        cost = np.where(y > 0, 0.5 * len(y) / len(positive), 0.5 * len(y) / (len(clean) + len(nothing)))
        machine.weights, machine.bias = separate(x, y, cost)
        judged = machine.margins(features)
    calibrate(machine, texts, toxic, share, owner, judged)
    machine.known, machine.held = {}, []
    return machine


def calibrate(machine: Machine, texts: list[str], toxic: np.ndarray, share: float, owner: np.ndarray, judged: np.ndarray) -> None:
    """Logistic of a document's worst margins, with Platt's softened targets, by damped Newton steps."""
    x = worst_margins(len(texts), machine.bias, [(owner, judged)] if len(owner) else [])
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic, share / n1, (1 - share) / n0) * len(texts)
    scale, ridge = np.zeros(x.shape[1]), np.array([1e-2] * WORST + [1e-6])
    for _ in range(200):
        p = logistic(x @ scale)
        g = x.T @ (weight * (p - target)) + ridge * scale
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        scale -= step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
    machine.scale = scale


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Machine | None:
    """The machine of `labelled` (text, toxic), fitted on at most `rows` rows of each label, of texts up to `chars`
    characters. Rows with null text or label teach nothing; without a row of each label there is no machine.
    """
    known = labelled.select("text", "toxic").where("text IS NOT NULL AND toxic IN (0, 1)")
    parts = [known.where((F.col("toxic") == label) & (F.length("text") <= chars)) for label in (1, 0)]
    return fit_sample(label_counts(known), bounded_sample(parts[0], rows).union(bounded_sample(parts[1], rows)))


def label_counts(known: DataFrame) -> dict[int, int]:
    return {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}


def fit_sample(counts: dict[int, int], sample: DataFrame) -> Machine | None:
    """The machine of `sample` (text, toxic), calibrated to the rows of each label in `counts`."""
    if not counts.get(0) or not counts.get(1):
        return None
    some = sample.select("text", "toxic").toArrow()
    toxic = np.array(some["toxic"].to_pylist()) == 1
    if toxic.all() or not toxic.any():
        return None
    return fit(some["text"].to_pylist(), toxic, counts[1] / (counts[0] + counts[1]))


def text_key() -> Column:
    """128 bits of sha256 that stand for a text while labels are joined."""
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def learn_by_id(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Machine | None:
    """As `learn`, of `docs` (doc_id, text) with their `labels` (of, toxic); the same sample, for which no text is shuffled.

    Texts meet their labels as digests. Only those of the sample, at most `rows` of each label, are then read where they lie.
    """
    written = docs.where("text IS NOT NULL").select(
        "doc_id", text_key().alias("digest"), (F.length("text") <= chars).alias("fits"),
        *[F.xxhash64("text", F.lit(label).cast(labels.schema["toxic"].dataType)).alias(f"h{label}") for label in (0, 1)],
    )
    named = written.join(labels.where("toxic IN (0, 1)"), F.col("doc_id") == F.col("of"))
    known = stored(named.select("of", "digest", "fits", "toxic", F.when(F.col("toxic") == 1, F.col("h1")).otherwise(F.col("h0")).alias("place")))
    chosen = None
    for label in (1, 0):
        once = known.where((F.col("toxic") == label) & F.col("fits")).groupBy("digest", "toxic", "place").agg(F.min("of").alias("of"))
        some = once.orderBy("place", "digest").limit(rows)
        chosen = some if chosen is None else chosen.union(some)
    chosen = chosen.withColumnRenamed("digest", "wanted").drop("place")
    held = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).where(text_key() == F.col("wanted"))
    return fit_sample(label_counts(known), held.select("text", "toxic", "of").distinct())


def score(docs: DataFrame, machine: Machine | None, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, a half everywhere without a machine) and predicted (1 from a half). Null text is empty; repeated rows stay."""
    kept = docs.drop("score", "predicted")
    at = kept.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = kept.withColumns({"score": F.lit(0.0)}).schema

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                texts = [x or "" for x in some.column(at).to_pylist()]
                value = sent.value.scores(texts) if sent.value else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(value)], names=[*some.schema.names, "score"])

    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def split_score(docs: DataFrame, labels: DataFrame, parts: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of `docs` (doc_id, text), learnt from `labels` (doc_id, toxic) of rows whose crc32 of the id, modulo `parts`, is not 0.

    A repeated id meets each of its labels; a null id has none.
    """
    own = labels.where(fold_part(F.col("doc_id"), parts) != 0).select(F.col("doc_id").alias("of"), "toxic")
    machine = learn_by_id(docs.select("doc_id", "text"), own)
    return score(docs.select("doc_id", "text"), machine).select("doc_id", (fold_part(F.col("doc_id"), parts) == 0).alias("held_out"), "score", "predicted")
