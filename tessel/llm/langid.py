"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads every byte of a text in both directions, in chunks of CHUNK bytes, and gives each position a
distribution over the languages; a document's probabilities are the mean over its positions. It is trained in numpy
by backpropagation through time on the driver, from at most TRAIN_DOCUMENTS documents per language and TRAIN_CHUNKS
chunks of each, drawn by hash; the fitted weights, a few kilobytes, go to the tasks. Each text is judged alone, whole:
no shuffle, and memory for one slice of a batch.

A text that is null or has no letter is `und` with score 0. Without a training document all texts are `und`. Repeated
rows are judged each; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm._shared import pieces_of

HIDDEN = 8
CHUNK = 96
#: The most training documents of a language, and chunks of each, that the driver fits the network on.
TRAIN_DOCUMENTS, TRAIN_CHUNKS = 400, 6
STEPS, BATCH = 350, 256
PAD = 256


def _init(languages: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in ("f", "b"):
        w[f"e{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        w[f"u{d}"] = rng.normal(0, 0.4 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
        w[f"o{d}"] = rng.normal(0, 0.3, (languages, hidden)).astype(np.float32)
    w["c"] = np.zeros(languages, np.float32)
    return w


def _half_gates(w: dict[str, np.ndarray], d: str, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Input table (3H, 257) and recurrent weights, gates halved since sigmoid(a) = (1 + tanh(a / 2)) / 2."""
    e, u = w[f"e{d}"].T.copy(), w[f"u{d}"].copy()
    e[: 2 * hidden] *= 0.5
    u[: 2 * hidden] *= 0.5
    e[:hidden, PAD] = 30.0  # a padded step keeps the state
    return e, u


def run_direction(e: np.ndarray, u: np.ndarray, x: np.ndarray, hidden: int, backward: bool) -> np.ndarray:
    """States (T, H, B) of one direction over byte codes x (T, B)."""
    t_max, b = x.shape
    out = np.empty((t_max, hidden, b), np.float32)
    h = np.zeros((hidden, b), np.float32)
    for t in range(t_max - 1, -1, -1) if backward else range(t_max):
        g, a = np.take(e, x[t], axis=1), u @ h
        zr = g[: 2 * hidden]
        zr += a[: 2 * hidden]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n = a[2 * hidden :]
        n *= zr[hidden:]
        n += g[2 * hidden :]
        np.tanh(n, out=n)
        h = h - n
        h *= zr[:hidden]
        h += n
        out[t] = h
    return out


def position_probabilities(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(T, languages, B): each position's distribution."""
    hidden = w["uf"].shape[1]
    logits = np.matmul(w["of"], run_direction(*_half_gates(w, "f", hidden), x, hidden, False))
    logits += np.matmul(w["ob"], run_direction(*_half_gates(w, "b", hidden), x, hidden, True))
    logits += w["c"][:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over positions and its gradients, by backpropagation through time in both directions."""
    hidden, (t_max, b) = w["uf"].shape[1], x.shape
    states, logits = {}, np.broadcast_to(w["c"][:, None], (t_max, len(w["c"]), b)).copy()
    for d in ("f", "b"):
        e, u = w[f"e{d}"].T, w[f"u{d}"]
        h, kept = np.zeros((hidden, b), np.float32), [None] * t_max
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            g, a = e[:, x[t]], u @ h
            z = 1 / (1 + np.exp(-(g[:hidden] + a[:hidden])))
            z[:, x[t] == PAD] = 1
            r = 1 / (1 + np.exp(-(g[hidden : 2 * hidden] + a[hidden : 2 * hidden])))
            n = np.tanh(g[2 * hidden :] + r * a[2 * hidden :])
            kept[t] = (h, z, r, n, a[2 * hidden :])
            h = z * h + (1 - z) * n
            logits[t] += w[f"o{d}"] @ h
        states[d] = kept
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    live = (x != PAD).astype(np.float32)
    own = p[np.arange(t_max)[:, None], y[None, :], np.arange(b)[None, :]]
    loss = float(-(np.log(own + 1e-9) * live).sum() / live.sum())
    p[np.arange(t_max)[:, None], y[None, :], np.arange(b)[None, :]] -= 1
    p *= live[:, None, :] / live.sum()
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["c"] = p.sum(axis=(0, 2))
    for d in ("f", "b"):
        u, dh = w[f"u{d}"], np.zeros((hidden, b), np.float32)
        de = grad[f"e{d}"]
        for t in range(t_max - 1, -1, -1) if d == "f" else range(t_max):
            h, z, r, n, an = states[d][t]
            now = z * h + (1 - z) * n
            grad[f"o{d}"] += p[t] @ now.T
            dh = dh + w[f"o{d}"].T @ p[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r])
            grad[f"u{d}"] += da @ h.T
            np.add.at(de, x[t], np.concatenate([dz, dr, dn]).T)
            dh = dh * z + u.T @ da
    return loss, grad


def train(texts: list[bytes], labels: np.ndarray, languages: int, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, chunk: int = 48, seed: int = 0) -> dict[str, np.ndarray]:
    """Fit the network to chunks of bytes by Adam; a chunk shorter than `chunk` is padded."""
    rng = np.random.default_rng(seed)
    w = _init(languages, hidden, rng)
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    by_label = [np.flatnonzero(labels == c) for c in range(languages)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(by_label[c], 1 + (batch - 1) // languages) for c in (range(languages) if languages <= batch else rng.choice(languages, batch, replace=False))])
        x = np.full((chunk, len(pick)), PAD, np.int64)
        for i, k in enumerate(pick.tolist()):
            start = int(rng.integers(0, max(1, len(texts[k]) - chunk + 1)))
            part = np.frombuffer(texts[k][start : start + chunk], np.uint8)
            x[: len(part), i] = part
        _, grad = _gradients(w, x, labels[pick])
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def document_probabilities(w: dict[str, np.ndarray], texts: list[bytes], chunk: int = CHUNK, width: int = 2048) -> np.ndarray:
    """(documents, languages): mean of the probabilities at all byte positions; zeros for an empty text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    counts = -(-sizes // chunk)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = (np.cumsum(sizes) - sizes)[owner] + nth * chunk
    length = np.minimum(chunk, sizes[owner] - nth * chunk)
    order = np.argsort(-length, kind="stable")
    total = np.zeros((len(texts), len(w["c"])))
    for lo in range(0, len(order), width):
        own = order[lo : lo + width]
        t_max = int(length[own].max())
        at = begin[own][None, :] + np.arange(t_max)[:, None]
        live = np.arange(t_max)[:, None] < length[own][None, :]
        x = np.where(live, data[np.minimum(at, len(data) - 1)], PAD)
        p = position_probabilities(w, x)
        np.add.at(total, owner[own], np.einsum("tlb,tb->bl", p, live.astype(np.float32)))
    return total / np.maximum(sizes, 1)[:, None]


def training_texts(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, chunks: int = TRAIN_CHUNKS) -> tuple[list[bytes], list[str]]:
    """Chunks of labelled documents outside the held-out third, at most `documents` of a language, drawn by hash."""
    learn = docs.where("not held_out and lang is not null and text is not null and length(text) > 0").select("doc_id", "text", "lang")
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.lit("train"))
    seen = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    share = F.lit(1.0)
    for r in seen:  # about three times what is wanted, so that the ranking below is small
        share = F.when(F.col("lang") == r["lang"], min(1.0, 3 * documents / r["n"])).otherwise(share)
    few = learn.where(F.pmod(rank, F.lit(1 << 20)) < share * (1 << 20)).select("lang", rank.alias("h"), "doc_id", _spread("text", chunks).alias("parts"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = few.withColumn("k", first).where(F.col("k") <= documents).orderBy("lang", "k").select("lang", "parts").collect()
    pairs = [(p.encode(), r["lang"]) for r in picked for p in r["parts"] if p]
    return [p for p, _ in pairs], [lang for _, lang in pairs]


def _spread(text: str, chunks: int, size: int = 160):
    """Up to `chunks` pieces of a text, evenly spread over the whole of it."""
    step = F.greatest(F.lit(size), F.floor(F.length(text) / chunks).cast("int"))
    starts = F.slice(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), step.cast("int")), 1, chunks)
    return F.transform(starts, lambda s: F.substring(F.col(text), s, F.lit(size)))


def identify(docs: DataFrame, hidden: int = HIDDEN, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for documents (doc_id, text, lang)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    texts, langs = training_texts(rows)
    names = sorted(set(langs))
    w = train(texts, np.array([names.index(x) for x in langs]), len(names), hidden, steps) if names else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text", 4 << 20):
                found = batch.column("text").to_pylist()
                able = [i for i, t in enumerate(found) if t and any(map(str.isalpha, t))] if w else []
                langs, scores = ["und"] * len(found), [0.0] * len(found)
                if able:
                    p = document_probabilities(w, [found[i].encode() for i in able])
                    for i, best, score in zip(able, p.argmax(1).tolist(), p.max(1).tolist()):
                        langs[i], scores[i] = names[best], min(1.0, score)
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
