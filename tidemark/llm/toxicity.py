"""Toxicity scores from a bidirectional GRU with attention pooling over word and character inputs, trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textstats import learnable

WORD = re.compile(r"[^\W\d_]+")
WINDOW, STRIDE = 64, 48
HIDDEN, DEPTH, ATTENTION = 8, 4, 8
BUCKETS = 1 << 14
#: Labelled rows used for the fit at most, of toxic and of other texts.
TOXIC_ROWS, OTHER_ROWS = 2000, 3000
#: Steps of the fit at most, steps from one judgement to the next, and judgements without a better one that end it.
STEPS, JUDGED, PATIENCE = 480, 20, 8
#: Words whose inputs one pass of the network holds.
CHUNK_WORDS = 150_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its bucket; the buckets of all its 4-byte grams, end marks included; where each word's grams begin."""
    raw = [b"<" + w.encode() + b">>" for w in words]
    ids = np.fromiter((zlib.crc32(r) % BUCKETS for r in raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = np.zeros(max(len(data) - 3, 0), dtype=np.uint32)
    for i in range(4):
        h = h * np.uint32(31) + data[i : len(data) - 3 + i]
    h = (h * np.uint32(2654435761)) >> np.uint32(18)
    inside = np.ones(len(h), dtype=bool)
    for d in range(1, 4):  # grams that run into the next word
        at = begin[1:] - d
        inside[at[at >= 0]] = False
    counts = sizes - 3
    return ids, h[inside].astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]])


def inputs(p: dict, words: list[str]) -> tuple[np.ndarray, tuple]:
    """Input vectors of words: the word's own and the mean of its character grams'."""
    ids, grams, begin = word_features(words)
    counts = np.diff(np.append(begin, len(grams)))
    chars = np.add.reduceat(p["chars"][grams], begin, axis=0) / counts[:, None].astype(np.float32)
    return np.concatenate([p["words"][ids], chars], axis=1), (ids, grams, counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gru(projected: np.ndarray, u: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (steps, windows, HIDDEN); a padded step keeps the state. ``keep`` collects what the backward pass needs."""
    steps, n = index.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps):
        x, g = projected[index[t]], h @ u
        rz = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, r, z, c, g[:, 2 * HIDDEN :], m))
        h = np.where(m, c + z * (h - c), h)
        out[t] = h
    return out


def forward(p: dict, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Log odds per window. index, mask: (steps, windows) into the rows of ``x``."""
    projected = x @ p["wx"] + p["bx"]
    kf, kb = (None, None) if keep is None else ([], [])
    ahead = _gru(projected[:, : 3 * HIDDEN], p["uf"], index, mask, kf)
    back = _gru(projected[:, 3 * HIDDEN :], p["ub"], index[::-1], mask[::-1], kb)[::-1]
    states = np.concatenate([ahead, back], axis=2)
    a = np.tanh(states @ p["wa"])
    s = np.where(mask, a @ p["va"], np.float32(-1e9))
    e = np.exp(s - s.max(axis=0))
    weights = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weights, states)
    if keep is not None:
        keep |= {"kf": kf, "kb": kb, "states": states, "a": a, "weights": weights, "pooled": pooled}
    return pooled @ p["wo"] + p["bo"]


def _gru_back(projected_grad: np.ndarray, u: np.ndarray, index: np.ndarray, kept: list, dout: np.ndarray) -> np.ndarray:
    du, dh = np.zeros_like(u), np.zeros_like(dout[0])
    for t in range(len(kept) - 1, -1, -1):
        h, r, z, c, gc, m = kept[t]
        dh = dh + dout[t]
        d = dh * m
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dg = np.concatenate([dr, dz, dc * r], axis=1)
        np.add.at(projected_grad, index[t], np.concatenate([dr, dz, dc], axis=1))
        du += h.T @ dg
        dh = dh * ~m + d * z + dg @ u.T
    return du


def gradients(p: dict, words: list[str], index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean log loss and its gradient by every parameter."""
    x, (ids, grams, counts) = inputs(p, words)
    k: dict = {}
    odds = forward(p, x, index, mask, k)
    prob = _sigmoid(odds)
    loss = float(np.mean(np.logaddexp(0, odds) - y * odds))
    d = ((prob - y) / len(y)).astype(np.float32)
    g = {"wo": k["pooled"].T @ d, "bo": d.sum(keepdims=True)}
    dpool = d[:, None] * p["wo"]
    ds = np.einsum("nh,tnh->tn", dpool, k["states"])
    ds = k["weights"] * (ds - (ds * k["weights"]).sum(axis=0))
    da = ds[:, :, None] * p["va"] * (1 - k["a"] ** 2)
    g["va"] = np.einsum("tn,tna->a", ds, k["a"])
    g["wa"] = np.einsum("tnh,tna->ha", k["states"], da)
    dstates = k["weights"][:, :, None] * dpool + da @ p["wa"].T
    dproj = np.zeros((len(x), 6 * HIDDEN), np.float32)
    g["uf"] = _gru_back(dproj[:, : 3 * HIDDEN], p["uf"], index, k["kf"], dstates[:, :, :HIDDEN])
    g["ub"] = _gru_back(dproj[:, 3 * HIDDEN :], p["ub"], index[::-1], k["kb"], dstates[::-1, :, HIDDEN:])
    g["wx"], g["bx"] = x.T @ dproj, dproj.sum(axis=0)
    dx = dproj @ p["wx"].T
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], ids, dx[:, :DEPTH])
    np.add.at(g["chars"], grams, np.repeat(dx[:, DEPTH:] / counts[:, None].astype(np.float32), counts, axis=0))
    return loss, g


def start(rng: np.random.Generator) -> dict:
    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)

    return {
        "words": small(BUCKETS, DEPTH) * 0.1, "chars": small(BUCKETS, DEPTH) * 0.1, "wx": small(2 * DEPTH, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32),
        "uf": small(HIDDEN, 3 * HIDDEN), "ub": small(HIDDEN, 3 * HIDDEN), "wa": small(2 * HIDDEN, ATTENTION), "va": small(ATTENTION), "wo": small(2 * HIDDEN), "bo": np.zeros(1, np.float32),
    }


def windows_of(words: list) -> list[list]:
    """All overlapping windows of a text's words; the last one ends with the text, and no words are one empty window."""
    return [words[i : i + WINDOW] for i in range(0, max(len(words) - WINDOW + STRIDE, 1), STRIDE)]


def _packed(windows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    index = np.zeros((WINDOW, len(windows)), np.int64)
    mask = np.zeros((WINDOW, len(windows)), bool)
    for n, w in enumerate(windows):
        index[: len(w), n] = w
        mask[: len(w), n] = True
    return index, mask


def _lean(buckets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log odds of a text being toxic if it holds a bucket, shrunk where few texts do."""
    with_, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, t in zip(buckets, y, strict=True):
        u = np.unique(b)
        with_[u] += 1
        toxic[u] += t
    n, n1 = len(y), y.sum()
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((with_ - toxic + 0.5) / (n - n1 + 1))
    return np.clip(odds * with_ / (with_ + 10), -4, 4)


def train(texts: list[str], labels: list[int], steps: int = STEPS, batch: int = 128, seed: int = 7) -> dict:
    """Fit the network. A toxic text teaches by the window that leans most to toxic texts, as word counts of the sample tell, another by that one and one at random; other windows of long texts aren't learnt from.

    The first input of words and grams starts from how their presence leans in the sample; everything is then trained, by
    as many ``steps`` however few texts there are. About one text in eight, chosen by its hash, isn't taught but judges: of the parameters met every ``JUDGED`` steps
    those with the least loss on its texts count, and ``PATIENCE`` judgements without a better one end the fit. Without
    judges of both labels the last parameters count.
    """
    rng = np.random.default_rng(seed)
    p = start(rng)
    unique = dict(zip(texts, labels, strict=True))  # copies of a text teach once
    if len(set(unique.values())) < 2:
        p["wo"][:] = 0
        p["bo"][:] = 5 if unique and next(iter(unique.values())) else -5
        return p
    judges = {t: v for t, v in unique.items() if zlib.crc32(t.encode("utf-8", "surrogatepass")) % 8 == 0}
    taught = {t: v for t, v in unique.items() if t not in judges}
    if len(set(judges.values())) < 2 or len(set(taught.values())) < 2:
        judges, taught = {}, unique
    tokens, y = [WORD.findall(t.lower()) for t in taught], np.array(list(taught.values()), np.float32)
    held = [word_features(sorted(set(w)) or [""]) for w in tokens]
    p["words"][:, 0] = _lean([h[0] for h in held], y)
    p["chars"][:, 0] = _lean([h[1] for h in held], y)
    examples, targets = [], []
    for w, t in zip(tokens, y, strict=True):
        options = windows_of(w)
        if not options[0]:
            continue
        x, _ = inputs(p, w)
        per_word = np.maximum(x[:, 0], 0) + np.maximum(x[:, DEPTH], 0)
        lean = [float(np.sort(per_word[i * STRIDE : i * STRIDE + WINDOW])[-3:].sum()) for i in range(len(options))]
        chosen = {int(np.argmax(lean))} | (set() if t else {int(rng.integers(len(options)))})
        for c in sorted(chosen):
            examples.append(options[c])
            targets.append(t)
    if not examples:
        return p
    target = np.array(targets, np.float32)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    best, least, waited, queue = p, np.inf, 0, np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(queue) < min(batch, len(examples)):
            queue = np.concatenate([queue, rng.permutation(len(examples))])
        part, queue = queue[:batch], queue[batch:]
        vocabulary: dict[str, int] = {}
        index, mask = _packed([[vocabulary.setdefault(w, len(vocabulary)) for w in examples[i]] for i in part])
        _, g = gradients(p, list(vocabulary), index, mask, target[part])
        rate = 0.01 * (1 - step / (steps + 1))
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        if judges and step % JUDGED == 0:
            loss = _loss(p, judges)
            if loss < least:
                best, least, waited = dict(p), loss, 0
            elif (waited := waited + 1) >= PATIENCE:
                break
    return best if judges else p


def _loss(p: dict, known: dict[str, int]) -> float:
    """Log loss of whole texts' scores."""
    y = np.array(list(known.values()), np.float32)
    s = np.clip(score_texts(p, list(known)), 1e-3, 1 - 1e-3)
    return float(-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))


def score_texts(p: dict, texts: list[str]) -> np.ndarray:
    """For each text the largest probability of its windows; texts without words get the network's answer to an empty window."""
    empty = float(_sigmoid(p["bo"].astype(float))[0])
    scores = np.full(len(texts), empty)
    known: dict[str, int] = {}
    windows: list[list[int]] = []
    owner: list[int] = []

    def flush() -> None:
        if windows:
            x, _ = inputs(p, list(known))
            for lo in range(0, len(windows), 1024):
                index, mask = _packed(windows[lo : lo + 1024])
                prob = _sigmoid(forward(p, x, index, mask).astype(float))
                np.maximum.at(best, owner[lo : lo + 1024], prob)
        known.clear()
        windows.clear()
        owner.clear()

    best = np.full(len(texts), -1.0)
    held = 0
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        for lo in range(0, max(len(words) - WINDOW + STRIDE, 1), STRIDE):
            if not words:
                break
            windows.append([known.setdefault(w, len(known)) for w in words[lo : lo + WINDOW]])
            owner.append(i)
            held += WINDOW
            if held >= CHUNK_WORDS:
                flush()
                held = 0
    flush()
    return np.where(best >= 0, best, scores)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> dict:
    """Fit on at most ``toxic_rows`` and ``other_rows`` labelled rows whose identifiers' crc32 is not divisible by 5."""
    mine, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    known = labels.where(learnable(id_col) & F.col("toxic").isNotNull()).groupBy(mine.alias("id")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("toxic > 0").orderBy(*order).limit(toxic_rows).unionByName(known.where("toxic <= 0").orderBy(*order).limit(other_rows))
    # of repeated documents one text is taken, so that the bound holds
    rows = docs.select(mine.alias("id"), text.alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r[0], r.text))
    return train([r.text for r in rows], [int(r[2] > 0) for r in rows])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out (never learnt from), score (0 to 1), predicted (1 if score >= 0.5).

    All overlapping windows of ``WINDOW`` words of the whole text are scored; the largest probability counts. Labels and
    identifiers choose what is learnt from but are no inputs. Null and empty texts get the score of an empty window.
    Repeated rows are scored each. One kind of label only, or none: a constant score. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **options))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(model.value, texts.tolist()))

    scored = docs.select(F.col(f"`{id_col}`").alias("id"), (~learnable(id_col)).alias("held_out"), score(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("score"))
    return scored.select(F.col("id").alias(id_col), F.coalesce("held_out", F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
