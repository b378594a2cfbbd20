"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel.

Two strings are alike as far as they share subsequences of ``LENGTH`` letters, each weighted by
decay ** gaps; so an insult is still met when letters are put between or left out. The kernel works
on windows of a word's letters (all else is dropped, a mark stands for the word's start). Nyström
landmarks make it a finite map in which a linear SVM is fitted. As the map is linear in the
subsequences' weights, the fitted machine folds into one weight per subsequence, and scoring is a
table lookup per subsequence: exactly the same numbers, no landmark is visited.

Labels are given per text while insults are words, so fitting picks the witness of each toxic text:
the windows that tell toxic from clean texts best, first by counts of letter runs, then by the SVM.
"""

from __future__ import annotations

import itertools
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, rows

LENGTH, WINDOW, DECAY, LANDMARKS = 3, 8, 0.6, 160
#: Bounds of the training draw: rows, and the longest text that is drawn.
MAX_TRAIN, MAX_TRAIN_BYTES = 6000, 32_768
#: Standard errors by which a letter run must point to toxic texts to make a first witness.
SURE = 4.0
#: The least share of toxic texts among those with a first witness's run, were classes equally large.
PURE = 0.88
_CODES = 64
_COMBOS = np.array(list(itertools.combinations(range(WINDOW), LENGTH)))
_GAPS = DECAY ** (_COMBOS[:, -1] - _COMBOS[:, 0] - (LENGTH - 1))
#: Length of the vector of a window with so many letters, were all its subsequences different.
_NORM = np.array([max(1e-9, float(np.sqrt((_GAPS[_COMBOS[:, -1] < n] ** 2).sum()))) for n in range(WINDOW + 1)])
_NO_WINDOW = -9.0


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def tokens(text: str) -> list[str]:
    """Lower-cased words; a run of three or more single letters is also read as one word."""
    w = text.lower().split()
    sizes = list(map(len, w))
    if sizes.count(1) >= 3:
        run = ""
        for t, n in zip([*w, "  "], [*sizes, 2]):
            if n == 1:
                run += t
            else:
                if len(run) >= 3:
                    w.append(run)
                run = ""
    return w


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the words' letters: codes (n x WINDOW, 0 behind the end), owner, letters in it."""
    plain = [letters(w) for w in words]
    size = np.array([len(p) + 1 for p in plain])
    flat = np.frombuffer(("^" + "^".join(plain)).encode("utf-32-le", "replace"), "<u4").astype(np.int32) if plain else np.empty(0, np.int64)
    del plain
    code = np.where((flat >= 97) & (flat <= 122), flat - 95, np.where(flat == 94, 1, 28 + flat % 36)).astype(np.int8)
    start = np.append(0, np.cumsum(size))[:-1]
    count = np.where(size < 3, 0, np.maximum(1, size - WINDOW + 1))  # a single letter has no window
    owner = np.repeat(np.arange(len(size)), count)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    inside = np.minimum(WINDOW, size[owner] - (at - start[owner]))
    place = at.astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    held = np.append(code, np.zeros(WINDOW, np.int8))[place]
    held[np.arange(WINDOW) >= inside[:, None]] = 0
    return held, owner, inside


def subsequences(codes: np.ndarray) -> np.ndarray:
    """The number of every subsequence of each window; 0 where it runs past the end."""
    a, b, c = (codes[:, _COMBOS[:, k]].astype(np.int32) for k in range(LENGTH))
    return np.where(c > 0, (a * _CODES + b) * _CODES + c, 0)


class KernelMachine:
    """Weight per subsequence, bias, and the logistic curve from margins to probabilities."""

    def __init__(self, weight: np.ndarray | None, bias: float, shift: float = 0.0):
        used = np.flatnonzero(weight) if weight is not None else np.empty(0, np.int64)
        self.used, self.value = used.astype(np.int32), weight[used].astype(np.float32) if weight is not None else None
        self.bias, self.slope, self.shift = bias, np.zeros(3), shift
        self._table, self._known = None, {}

    def __getstate__(self):
        return {**self.__dict__, "_table": None, "_known": {}}

    def window_margins(self, codes, inside) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(_CODES ** LENGTH, np.float32)
            if self.value is not None:
                self._table[self.used] = self.value
        out = np.empty(len(codes))
        for k in range(0, len(codes), 10_000):
            part = slice(k, k + 10_000)
            out[part] = (self._table[subsequences(codes[part])] @ _GAPS) / _NORM[inside[part]]
        return out + self.bias

    def word_margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), _NO_WINDOW)
        codes, owner, inside = windows(words)
        if len(owner):
            np.maximum.at(out, owner, self.window_margins(codes, inside))
        return out

    def margins(self, texts: list[str | None], limit: int = 1_000_000) -> np.ndarray:
        """The three largest margins of different words of each whole text, clipped to -3 to 3.
        Words are remembered up to ``limit``."""
        out = np.full((len(texts), 3), -3.0)
        for low in range(0, len(texts), 500):
            split = [tokens(t) if t else [] for t in texts[low:low + 500]]
            if len(self._known) > limit:
                self._known = {}
            new = list(set().union(*split).difference(self._known))
            for k in range(0, len(new), 20_000):
                part = new[k:k + 20_000]
                self._known.update(zip(part, self.word_margins(part).tolist()))
            get = self._known.__getitem__
            for k, w in enumerate(split, low):
                found = list(map(get, set(w)))
                for j in range(min(3, len(found))):
                    out[k, j] = most = max(found)
                    found.remove(most)
        return np.clip(out, -3, 3)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.slope + self.shift, -35, 35)))


def _features(codes, inside, index, table) -> np.ndarray:
    """Kernel values of windows against the landmarks, whose subsequence vectors are ``table``'s columns."""
    out = np.empty((len(codes), table.shape[1]))
    for k in range(0, len(codes), 400):
        part = slice(k, k + 400)
        out[part] = np.einsum("nsm,s->nm", table[index[subsequences(codes[part])]], _GAPS) / _NORM[inside[part], None]
    return out


def _landmark_table(codes, inside):
    """(subsequence -> row, rows x landmarks)."""
    subs = subsequences(codes)
    used = np.unique(subs[subs > 0])
    index = np.zeros(_CODES ** LENGTH, np.int32)
    index[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(codes)), np.float64)
    for m in range(len(codes)):
        np.add.at(table[:, m], index[subs[m]], _GAPS / _NORM[inside[m]])
    table[0] = 0
    return used, index, table


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps over the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, active = np.zeros(x1.shape[1]), np.ones(len(x), bool)
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-4
    for _ in range(steps):
        a = x1[active] * cost[active, None]
        w = np.linalg.solve(ridge + a.T @ x1[active], a.T @ y[active])
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _without_copies(bags: list[np.ndarray], size: int, bands: int = 6, depth: int = 3) -> np.ndarray:
    """False for texts that look like a near copy of an earlier one: copies are no further evidence."""
    rng, out, met = np.random.default_rng(3), np.ones(len(bags), bool), set()
    orders = [rng.permutation(size) for _ in range(bands * depth)]
    for k, bag in enumerate(bags):
        if len(bag):
            low = [int(o[bag].min()) for o in orders]
            keys = {(b, *low[b * depth:(b + 1) * depth]) for b in range(bands)}
            out[k] = not keys & met
            met |= keys
    return out


def _disturbed(codes, inside, weight, rng, copies: int = 4):
    """Witnesses with a letter put in behind the second, so that the machine learns to see past it."""
    many = np.repeat(np.arange(len(codes)), copies)
    many = many[inside[many] > 3]
    at = rng.integers(2, inside[many])
    place = np.arange(WINDOW)
    out = np.where(place < at[:, None], codes[many], np.roll(codes[many], 1, axis=1))
    out[np.arange(len(many)), at % WINDOW] = np.where(at < WINDOW, rng.integers(2, 28, len(many)), out[:, 0])
    return out, np.minimum(WINDOW, inside[many] + 1), weight[many] / copies


def _runs(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of each word's letter runs of 3 to 5, one word after the other; where each begins; how many there are."""
    number: dict[str, int] = {}
    flat, starts = array("i"), [0]
    for word in vocabulary:
        p = "^" + letters(word)
        flat.extend({number.setdefault(p[i:i + n], len(number)) for n in (3, 4, 5) for i in range(len(p) - n + 1)})
        starts.append(len(flat))
    return np.frombuffer(flat, np.int32), np.array(starts), len(number)


def fit(texts: list[str], label: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 3, cost: float = 20.0, negatives: int = 12_000) -> KernelMachine:
    """Fit on labelled texts. With one class only the score is the class share everywhere."""
    n_toxic = int(label.sum())
    if n_toxic == 0 or n_toxic == len(label):
        share = (n_toxic + 0.5) / (len(label) + 1)
        return KernelMachine(None, 0.0, float(np.log(share / (1 - share))))
    bags = [list(dict.fromkeys(tokens(t))) for t in texts]
    vocabulary = list(dict.fromkeys(w for b in bags for w in b))
    number = {w: k for k, w in enumerate(vocabulary)}
    bags = [np.array([number[w] for w in b], np.int64) for b in bags]
    alone = _without_copies(bags, len(vocabulary))
    if len(np.unique(label[alone])) < 2:
        alone[:] = True
    # First witnesses: words with a letter run that many toxic and few clean texts have.
    runs, run_start, n_runs = _runs(vocabulary)
    toxic, every = np.zeros(n_runs), np.zeros(n_runs)
    for bag, y, first_of_kind in zip(bags, label, alone):
        if first_of_kind and len(bag):
            met = np.unique(np.concatenate([runs[run_start[k]:run_start[k + 1]] for k in bag]))
            every[met] += 1
            if y:
                toxic[met] += 1
    n_toxic, n_all = int((label * alone).sum()), int(alone.sum())
    prior, ratio = n_toxic / n_all, n_toxic / max(1, n_all - n_toxic)
    # How far a run's toxic share is above the prior, in standard errors of a small sample; a run that
    # many clean texts have as well is no witness, however often it occurs.
    pure = toxic * (1 - PURE) >= PURE * ratio * (every - toxic)
    odds = np.where(pure, (toxic - prior * every) / np.sqrt(prior * (1 - prior) * every + 1), 0.0)
    first = np.array([odds[runs[a:b]].max() if b > a else 0.0 for a, b in zip(run_start, run_start[1:])])
    codes, owner, inside = windows(vocabulary)
    starts = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    clean = np.zeros(len(vocabulary), bool)
    for bag, y in zip(bags, label):
        if not y:
            clean[bag] = True
    word_score, window_score = np.where(clean | (first < SURE), -1.0, first), None
    rng = np.random.default_rng(7)
    clean_windows = np.flatnonzero(clean[owner])
    machine = None
    for _ in range(rounds):
        # Positives: the best window of the best words of each toxic text; words of clean texts are none.
        chosen: Counter = Counter()
        for bag, y in zip(bags, label):
            if y and len(bag):
                top = bag[np.argsort(-word_score[bag], kind="stable")[:4]]
                best = word_score[top[0]]
                chosen.update(int(k) for k in top if word_score[k] > 0 and word_score[k] >= 0.5 * best and starts[k] < starts[k + 1])
        if not chosen:
            break
        words = [k for k, _ in chosen.most_common()]
        pos = np.array([starts[k] + (int(np.argmax(window_score[starts[k]:starts[k + 1]])) if window_score is not None else 0) for k in words])
        weight = np.array([chosen[k] for k in words], float)
        hard = clean_windows[np.argsort(-window_score[clean_windows])[:negatives // 2]] if window_score is not None else clean_windows[:0]
        easy = rng.choice(clean_windows, min(len(clean_windows), negatives - len(hard)), replace=False) if len(clean_windows) else clean_windows
        neg = np.unique(np.concatenate([hard, easy]))
        # Landmarks: the commonest witnesses, a quarter of clean windows.
        marks = np.concatenate([pos[:landmarks * 3 // 4], (hard if len(hard) else easy)[:landmarks // 4]]).astype(np.int64)
        used, index, table = _landmark_table(codes[marks], inside[marks])
        values, vectors = np.linalg.eigh(_features(codes[marks], inside[marks], index, table))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) * (values > 1e-6)
        weight = np.minimum(weight, 20)
        more, more_inside, more_weight = _disturbed(codes[pos], inside[pos], weight, rng)
        x = _features(np.concatenate([codes[pos], more, codes[neg]]), np.concatenate([inside[pos], more_inside, inside[neg]]), index, table) @ root
        y = np.concatenate([np.ones(len(pos) + len(more)), -np.ones(len(neg))])
        share = np.concatenate([weight, more_weight])
        share = np.append(share * len(neg) / share.sum() / 4, np.ones(len(neg)))
        w, bias = _svm(x, y, cost * share)
        folded = np.zeros(_CODES ** LENGTH)
        folded[used] = table[1:] @ (root @ w)
        machine = KernelMachine(folded, bias)
        window_score = machine.window_margins(codes, inside)
        word_score = np.full(len(vocabulary), _NO_WINDOW)
        np.maximum.at(word_score, owner, window_score)
        word_score[clean & (word_score > 0)] = 0.0
        word_score = np.where(~clean & (first >= SURE), first, np.minimum(word_score, SURE / 2 - 0.01))  # counts stay evidence
    if machine is None:
        return KernelMachine(None, 0.0, float(np.log(prior / (1 - prior))))
    machine.slope, machine.shift = _curve(machine.margins(texts), label)
    return machine


def _curve(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Platt's logistic curve with smoothed targets over the margins; none counts against toxicity."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([margins, np.ones((len(margins), 1))])
    w, free = np.zeros(4), np.ones(4, bool)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        a = x[:, free]
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 0.1 * np.eye(free.sum())
        w[free] -= np.linalg.solve(h, a.T @ (p - target) + 0.1 * w[free])
        below = (w < 0) & (np.arange(4) < 3)
        free &= ~below
        w[below] = 0
    return w[:3], float(w[3])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> KernelMachine:
    """Fit on at most ``max_train`` labelled texts, half of each class, none above ``MAX_TRAIN_BYTES``."""
    short = docs.filter(F.octet_length(text) <= MAX_TRAIN_BYTES)
    got = labelled.training_texts(short, labels, label, max_train, id, text, balanced=True).orderBy("doc_id").toPandas()
    return fit(got["text"].tolist(), got["label"].to_numpy(float))


def toxicity(model: KernelMachine, docs: DataFrame, text: str = "text"):
    """The score as a column over ``text``; a null or empty text has no window and scores lowest."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        machine = given.value
        return pa.array(machine.probability(machine.margins(texts.to_pylist())))

    return F.arrow_udf(run, "double")(F.col(text))


def score_sentences(docs: DataFrame, model: KernelMachine, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence of each text: doc_id, sentence, score. Null texts have none."""
    parts = docs.select(F.col(id).alias("doc_id"), F.explode(F.split(text, r"(?<=[.!?])\s+|\n+")).alias("sentence")).filter("sentence != ''")
    return parts.withColumn("score", toxicity(model, parts, "sentence"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5). Only the text enters a
    score. Repeated rows are scored alike; null ids are not held out; other columns are not read."""
    model = train(docs, labels, id=id, text=text)
    return docs.select(F.col(id).alias("doc_id"), labelled.held_out(id).alias("held_out"), toxicity(model, docs, text).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op2_string_kernel(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return score_toxicity(rows.table(spark, sf_dir, "documents"), rows.table(spark, sf_dir, "labels"))


