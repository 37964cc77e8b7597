"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word is an input made of its own vector (hashed) and the mean of its characters' trigram
vectors, so unseen words of toxic stems score too. A text is cut into overlapping windows of ``WINDOW``
words, every ``STRIDE`` words; both directions run over each window, attention over its words pools
the states, and the pooled state gives the window's logit. The document's score is that of its worst window,
over all windows of the whole text.

Training: a bounded sample of labelled documents of any length: of each class in the order of a hash of the id (so
reruns agree), at most ``DOCS_PER_CLASS`` documents and ``CHARS_PER_CLASS`` characters in all. A label holds for a document,
so for toxic ones the worst window learns, for clean ones the three worst. At first the windows are picked by
naive Bayes over words and trigrams, then by the network itself among the ``CANDIDATES`` that naive Bayes finds worst.

Nulls: a null text is the empty text, which gets the score of an empty window; null labels aren't
learned from; a doc_id with several labels counts as toxic if one of them says so. Without both classes
every score is 0. Repeated rows are rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, gru

HIDDEN, WINDOW, STRIDE, LANES, WORDS, GRAMS = 8, 32, 16, 1024, 8192, 8192
DOCS_PER_CLASS, CHARS_PER_CLASS, STEPS, BATCH, TEACHER_STEPS, CANDIDATES = 900, 5_000_000, 420, 40, 160, 64
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
F32 = np.float32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_"


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, without punctuation around them."""
    return [w.strip(_EDGES) or w for w in (text or "").encode("utf-8", "replace").translate(_LOWER).split()]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, trigram rows of all words in one array, where each word's trigrams start)."""
    row = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(b"^%b$" % w for w in words), np.uint8).astype(np.int64)
    gram = ((raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * 40503 >> 7) % GRAMS
    first = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    pick = np.arange(int(size.sum())) - np.repeat(start, size) + np.repeat(first, size)
    return row, gram[pick], start


class Encoder:
    """Turns texts into windows over a table of the distinct words of a batch; row 0 is the padding."""

    def __init__(self, texts: list[str | None]):
        at: dict[bytes, int] = {}
        ids, count = [], []
        for text in texts:
            words = words_of(text)
            ids += [at.setdefault(w, len(at) + 1) for w in words]
            count.append(len(words))
        self.words = list(at)
        size = np.array(count, np.int64)
        many = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
        self.owner = np.repeat(np.arange(len(texts)), many)
        first = np.cumsum(many) - many
        begin = (np.arange(len(self.owner)) - first[self.owner]) * STRIDE
        place = begin[:, None] + np.arange(WINDOW)
        base = (np.cumsum(size) - size)[self.owner]
        flat = np.array(ids + [0], np.int64)
        inside = place < size[self.owner][:, None]
        self.windows = np.where(inside, flat[np.where(inside, base[:, None] + place, len(flat) - 1)], 0)  # (windows, WINDOW)
        self.first = first


def inputs(model: dict, d: str, words: list[bytes]) -> np.ndarray:
    """(3, 1 + words, H): the gates' inputs of each distinct word; zeros for the padding."""
    out = np.zeros((3, 1 + len(words), model["uf"].shape[1]), F32)
    for at in range(0, len(words), 4096):
        row, gram, start = features(words[at : at + 4096])
        size = np.diff(np.append(start, len(gram))).astype(F32)[:, None]
        for k in range(3):
            out[k, 1 + at : 1 + at + len(row)] = model["w" + d][k][row] + np.add.reduceat(model["c" + d][k][gram], start, axis=0) / size
    return out


def logits(model: dict, tables: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """The logit of each window, from word rows (windows, WINDOW)."""
    h = model["uf"].shape[1]
    out = np.empty(len(windows), F32)
    for at in range(0, len(windows), LANES):
        ids = np.ascontiguousarray(windows[at : at + LANES].T)
        both = [np.empty((*ids.shape, h), F32) for _ in "fb"]
        for d, hold in zip("fb", both):
            gru.run(model["u" + d], tables[d], ids, hold, d == "b")
        a = both[0] @ model["v"][:h] + both[1] @ model["v"][h:]
        z = both[0] @ model["o"][:h] + both[1] @ model["o"][h:]
        a = np.exp(np.minimum(a, 30)) * (ids > 0) + F32(1e-9)
        out[at : at + LANES] = (a * z).sum(0) / a.sum(0) + model["bias"][0]
    return out


def _learn(model: dict, enc: Encoder, picked: np.ndarray, goal: np.ndarray) -> dict:
    """Gradients of the logistic loss over the picked windows."""
    h = model["uf"].shape[1]
    used, ids = np.unique(enc.windows[picked], return_inverse=True)
    ids = ids.reshape(len(picked), WINDOW).T
    pad = np.searchsorted(used, 0) if used[0] == 0 else None
    words = [enc.words[k - 1] for k in used if k]
    row, gram, start = features(words)
    size = np.diff(np.append(start, len(gram)))
    keep, grads = {}, {}
    for d in "fb":
        table = inputs(model, d, words)
        table = table if pad is not None else table[:, 1:]
        keep[d] = gru.train_forward(model["u" + d], np.ascontiguousarray(table[:, ids].transpose(1, 0, 2, 3)), d == "b")
    s = np.concatenate([keep["f"]["out"], keep["b"]["out"]], 2)
    a = np.exp(np.minimum(s @ model["v"], 30)) * (enc.windows[picked].T > 0) + F32(1e-9)
    a /= a.sum(0)
    pooled = (a[:, :, None] * s).sum(0)
    p = 1 / (1 + np.exp(-(pooled @ model["o"] + model["bias"][0])))
    dz = ((p - goal) / len(goal)).astype(F32)
    grads["o"], grads["bias"] = pooled.T @ dz, np.array([dz.sum()], F32)
    dp = dz[:, None] * model["o"]
    da = a * ((s - pooled) * dp).sum(2)
    grads["v"] = np.einsum("tb,tbh->h", da, s)
    ds = a[:, :, None] * dp + da[:, :, None] * model["v"]
    for d, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
        grads["u" + d], dgx = gru.train_backward(model["u" + d], keep[d], part, d == "b")
        by_word = gru.table_gradient(ids, dgx, len(used))
        by_word = by_word[:, 1:] if pad is not None else by_word
        grads["w" + d], grads["c" + d] = np.zeros_like(model["w" + d]), np.zeros_like(model["c" + d])
        share = np.repeat(by_word / size[:, None].astype(F32), size, axis=1)
        for k in range(3):
            np.add.at(grads["w" + d][k], row, by_word[k])
            np.add.at(grads["c" + d][k], gram, share[k])
    return grads


def _teacher(encs: list[Encoder], goal: np.ndarray) -> list[np.ndarray]:
    """Naive Bayes scores of each document's windows: the worst word's log odds, by word or by its trigrams."""
    seen = [features(e.words) if e.words else None for e in encs]
    odds = []
    for part, rows in ((0, WORDS), (1, GRAMS)):
        n = np.zeros((2, rows))
        for f, g in zip(seen, goal):
            if f is not None:
                n[int(g), np.unique(f[part])] += 1
        n = (n + 0.5) / (np.array([(goal == 0).sum(), goal.sum()])[:, None] + 1)
        odds.append(np.log(n[1] / n[0]))
    out = []
    for e, f in zip(encs, seen):
        if f is None:
            out.append(np.zeros(len(e.windows)))
            continue
        score = np.maximum(odds[0][f[0]], np.maximum.reduceat(odds[1][f[1]], f[2]))
        out.append(np.concatenate([[-9], score])[e.windows].max(1))
    return out


def fit(pairs: list[tuple[str, int]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> dict | None:
    """Trains on (text, 0 or 1) pairs; None if a class is missing."""
    goal = np.array([y for _, y in pairs])
    by = [np.flatnonzero(goal == k) for k in (0, 1)]
    if not all(map(len, by)):
        return None
    rng = np.random.default_rng(seed)
    model = gru.init(rng, hidden)
    for d in "fb":
        model["w" + d] = (rng.standard_normal((3, WORDS, hidden)) * 0.05).astype(F32)
        model["c" + d] = (rng.standard_normal((3, GRAMS, hidden)) * 0.3).astype(F32)
    model |= {"v": (rng.standard_normal(2 * hidden) * 0.3).astype(F32), "o": (rng.standard_normal(2 * hidden) * 0.3).astype(F32), "bias": np.zeros(1, F32)}
    adam = gru.Adam(model, 0.02)
    single = [Encoder([t]) for t, _ in pairs]
    guide = _teacher(single, goal)
    worst = [np.sort(np.argsort(-g, kind="stable")[:CANDIDATES]) for g in guide]
    guide = [g[w] for g, w in zip(guide, worst)]
    for step in range(steps):
        pick = np.concatenate([rng.choice(b, BATCH // 2) for b in by])
        enc = Encoder([pairs[k][0] for k in pick])
        if step < TEACHER_STEPS:
            z = np.concatenate([guide[k] for k in pick])
            z = z + rng.random(len(z)) * 1e-3
        else:
            z = logits(model, {d: inputs(model, d, enc.words) for d in "fb"}, enc.windows[np.concatenate([at + worst[k] for k, at in zip(pick, enc.first)])])
        chosen, done = [], 0
        for k, at in zip(pick, enc.first):
            own = z[done : done + len(worst[k])]
            chosen.append(at + worst[k][np.argsort(-own)[: 1 if goal[k] else 3]])
            done += len(own)
        chosen = np.concatenate(chosen)
        adam.step(_learn(model, enc, chosen, goal[pick[enc.owner[chosen]]]), 0.02 if step < steps * 0.7 else 0.005)
    return model


def score_texts(model: dict | None, texts: list[str | None]) -> np.ndarray:
    """The worst window's score of each text."""
    if model is None or not texts:
        return np.zeros(len(texts))
    enc = Encoder(texts)
    z = logits(model, {d: inputs(model, d, enc.words) for d in "fb"}, enc.windows)
    return 1 / (1 + np.exp(-np.maximum.reduceat(z, enc.first).astype(float)))


def _key(df: DataFrame, n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def sample(documents: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS, max_chars: int = CHARS_PER_CLASS) -> list[tuple[str, int]]:
    """A sample of (text, label), bounded in rows and characters; only its ids (6 * per_class at most) meet the documents, by broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_key(labels, 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, 1.5 * per_class / counts.get(1, 1))).otherwise(min(1.0, 1.5 * per_class / counts.get(0, 1)))
    low = known.where((F.abs(F.xxhash64("doc_id", F.lit("tox-sample"))) % 1_000_000) < share * 1_000_000).orderBy(F.xxhash64("doc_id")).limit(6 * per_class)
    some = documents.select("doc_id", "text").join(F.broadcast(low), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    turn = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # of the sampled rows
    some = some.where((F.length("text") <= max_chars) & F.col("toxic").isin(0, 1)).withColumns({"turn": F.row_number().over(turn), "chars": F.sum(F.length("text")).over(turn)})
    rows = some.where((F.col("turn") <= per_class) & (F.col("chars") <= max_chars)).orderBy("toxic", "turn").collect()
    return [(r["text"], r["toxic"]) for r in rows]


def predict(documents: DataFrame, model: dict | None) -> DataFrame:
    """One row per document; see SCHEMA."""
    held = (_key(documents, 5) == 0).alias("held_out")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 3 MB whatever the corpus

    def run(batches):
        for b in common.portions(batches):
            s = score_texts(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", held, "text").mapInArrow(run, SCHEMA)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labelled rows that aren't held out, then scores every row."""
    return predict(documents, fit(sample(documents, labels)))
