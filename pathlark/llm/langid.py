"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

Every byte position of a text (lower-cased ASCII, UTF-8) gets a distribution over the languages from
the states of both directions; the document's distribution is the mean over all its positions. Texts
are run whole, in windows of ``WINDOW`` bytes that start with fresh states, many windows at a time.

Training: at most about ``DOCS_PER_LANG`` documents of each language (chosen by a hash of the id, so
reruns agree), ``SNIPPETS`` snippets of each, of which a step sees ``TRAIN_WINDOW`` bytes; every position is labelled with
the document's language, and the loss is summed over positions and propagated through time. Each step takes as many
of every language; of more languages than ``BATCH`` it takes some. That bound is a parameter, nothing else depends on the
size of the corpus.

Nulls: null text, or text without a letter: ``und`` with score 0. Null lang is never learned from. With
no labelled row, every document is ``und``. Repeated rows are rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, gru

HIDDEN, WINDOW, LANES = 8, 128, 1024
DOCS_PER_LANG, SNIPPETS, STEPS, BATCH, TRAIN_WINDOW = 300, 3, 260, 192, 96
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
F32 = np.float32


def sample(train: DataFrame, per_lang: int = DOCS_PER_LANG, snippets: int = SNIPPETS, length: int = 160) -> list[tuple[str, str]]:
    """A bounded sample of (lang, snippet): the rows of each language whose id hashes low enough."""
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.lit(None).cast("double")
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    low = (F.abs(F.xxhash64("doc_id", F.lit("lang-sample"))) % 1_000_000) < share * 1_000_000
    n = F.length("text")
    at = [F.substring("text", (1 + (n * (2 * k + 1) / (2 * snippets)).cast("int")), F.lit(length)) for k in range(snippets)]
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "parts"))  # of few rows: more than 2 * per_lang only if ids repeat
    rows = train.where(low).select("lang", F.array(*at).alias("parts"), "doc_id").withColumn("turn", turn).where(F.col("turn") <= 2 * per_lang).orderBy("lang", "turn").collect()
    return [(r["lang"], p) for r in rows for p in r["parts"] if p]


def fit(pairs: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> dict:
    """Trains on (lang, snippet) pairs by backpropagation through time."""
    langs = sorted({x for x, _ in pairs})
    rng = np.random.default_rng(seed)
    T = TRAIN_WINDOW
    x, y = [], []
    for lang, text in pairs:
        raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
        if len(raw) < 8:
            continue
        x.append(np.resize(raw, T))
        y.append(langs.index(lang))
    if not x:
        return {"langs": langs[:0]}
    x, y = np.stack(x).T.copy(), np.array(y)
    by = [np.flatnonzero(y == k) for k in range(len(langs))]
    by = [b for b in by if len(b)]
    p = gru.init(rng, hidden) | {d: (rng.standard_normal((3, 256, hidden)) * 0.3).astype(F32) for d in ("xf", "xb")}
    p |= {"w": (rng.standard_normal((2 * hidden, len(langs))) * 0.3).astype(F32), "b": np.zeros(len(langs), F32)}
    adam = gru.Adam(p, 0.02)
    for step in range(steps):
        some = by if len(by) <= BATCH else [by[k] for k in rng.choice(len(by), BATCH, replace=False)]
        pick = np.concatenate([rng.choice(b, BATCH // len(some)) for b in some])
        ids, goal = x[:, pick], y[pick]
        keep = {d: gru.train_forward(p["u" + d], np.ascontiguousarray(p["x" + d][:, ids].transpose(1, 0, 2, 3)), d == "b") for d in "fb"}
        h = np.concatenate([keep["f"]["out"], keep["b"]["out"]], 2)
        z = h @ p["w"] + p["b"]
        z = np.exp(z - z.max(2, keepdims=True))
        z /= z.sum(2, keepdims=True)
        z[:, np.arange(len(goal)), goal] -= 1
        z /= F32(z.shape[0] * z.shape[1])
        grads = {"w": h.reshape(-1, 2 * hidden).T @ z.reshape(-1, len(langs)), "b": z.sum((0, 1))}
        dh = z @ p["w"].T
        for d, part in (("f", dh[:, :, :hidden]), ("b", dh[:, :, hidden:])):
            grads["u" + d], dgx = gru.train_backward(p["u" + d], keep[d], part, d == "b")
            grads["x" + d] = gru.table_gradient(ids, dgx, 256)
        adam.step(grads, 0.02 if step < steps * 0.7 else 0.005)
    return p | {"langs": langs}


class Labeller:
    """Runs a fitted model over texts."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.u, self.x = ({d: np.ascontiguousarray(model[k + d]) for d in "fb"} for k in "ux")
        self.hidden = self.u["f"].shape[1]
        self.w = np.ascontiguousarray(model["w"].T)
        self.b = model["b"][:, None]
        self.hold = {d: np.empty((WINDOW, LANES, self.hidden), F32) for d in "fb"}

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """(steps, lanes) bytes to (languages, steps, lanes) probabilities."""
        steps, n = ids.shape
        ids = ids.astype(np.intp)
        z = self.b
        for k, d in enumerate("fb"):
            out = self.hold[d][:steps] if n == LANES else np.empty((steps, n, self.hidden), F32)
            gru.run(self.u[d], self.x[d], ids, out, d == "b")
            z = z + self.w[:, k * self.hidden : (k + 1) * self.hidden] @ out.reshape(-1, self.hidden).T
        np.exp(z, out=z)
        z /= z.sum(0)
        return z.reshape(-1, steps, n)

    def positions(self, text: str) -> list[str]:
        """The label of every byte position of one text."""
        raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
        out = []
        for at in range(0, len(raw), WINDOW):
            out += [self.langs[k] for k in self.windows(raw[at : at + WINDOW, None]).argmax(0)[:, 0]]
        return out

    def documents(self, texts: list[str]) -> np.ndarray:
        """(documents, languages): the mean over all positions."""
        raw = [t.encode("utf-8", "replace").lower() for t in texts]
        size = np.array([len(r) for r in raw])
        many = -(-size // WINDOW)
        flat = np.zeros((int(many.sum()), WINDOW), np.uint8)
        owner = np.repeat(np.arange(len(texts)), many)
        view, at = flat.reshape(-1), 0
        for r, m in zip(raw, many):
            view[at : at + len(r)] = np.frombuffer(r, np.uint8)
            at += int(m) * WINDOW
        first = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64)
        used = np.minimum(WINDOW, size[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
        # windows of about the same length run together: steps beyond their longest are not run
        order = np.argsort(-used, kind="stable")
        total = np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(order), LANES):
            pick = order[lo : lo + LANES]
            n = used[pick]
            p = self.windows(np.ascontiguousarray(flat[pick, : n.max()].T))
            if n.min() < n.max():
                p *= np.arange(p.shape[1])[:, None] < n
            np.add.at(total, owner[pick], p.sum(1).T)
        return total / np.maximum(size, 1)[:, None]


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """One row per document; see SCHEMA."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few KB whatever the corpus

    def run(batches):
        model = shared.value
        label = Labeller(model) if model["langs"] else None
        for b in common.portions(batches):
            texts = b.column("text").to_pylist()
            known = [t is not None and label is not None and any(map(str.isalpha, t)) for t in texts]
            p = label.documents([t for t, k in zip(texts, known) if k]) if any(known) else np.zeros((0, 1))
            best, score, at = [], [], 0
            for k in known:
                best.append(model["langs"][int(p[at].argmax())] if k else "und")
                score.append(float(min(1.0, p[at].max())) if k else 0.0)
                at += k
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", held, "text").mapInArrow(run, SCHEMA)


def identify(documents: DataFrame) -> DataFrame:
    """Trains on the rows that aren't held out, then predicts every row."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    train = documents.where((key != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    return predict(documents, fit(sample(train)))
