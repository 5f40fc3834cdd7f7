"""A small language model as a fixture for scores and losses: a frozen transformer body under a trainable head.

Arrays of whole batches (sequences, positions, width); attention runs inside the blocks of packed sequences,
backwards only. Weights are keyed draws, so every executor makes the same ones, and a loss or a gradient is a
function of the sequence, the head and the step.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np

from .. import config
from . import hashing as H

# Sizes, and the names under which weights are drawn.
WIDTH, LAYERS, HEADS, DROPOUT, RATE = 32, 2, 2, 0.1, 0.05
DRAWN = "frozen-model"
#: Positions that scored() holds as rows as wide as the vocabulary at once.
TILE = 128


def draws(key: int, n: int) -> np.ndarray:
    """The first n draws in [0, 1) of a key."""
    words = b"".join(hashlib.sha256(struct.pack(">QQ", key, k)).digest()[:8] for k in range(n))
    return np.frombuffer(words, ">u8").astype(np.float64) / 2.0**64


def drawn(rows: int, cols: int, name: str) -> np.ndarray:
    return (draws(H.key(config.SEED, DRAWN, 0, name), rows * cols).reshape(rows, cols) * 2 - 1) / np.sqrt(WIDTH)


@dataclass(frozen=True)
class Model:
    """body: everything frozen, by name. head (WIDTH, vocabulary) and bias are trained."""

    body: dict[str, np.ndarray]
    head: np.ndarray
    bias: np.ndarray


@cache
def initial(vocabulary: int = config.VOCAB_SIZE, length: int = config.SEQ_LEN) -> Model:
    """The model before training; norms start at scale 1 and shift 0, biases at 0."""
    body = {"emb": drawn(vocabulary, WIDTH, "emb"), "pos": drawn(length, WIDTH, "pos")}
    for k in range(LAYERS):
        body |= {f"L{k}.{w}": drawn(WIDTH, WIDTH, f"L{k}.{w}") for w in ("Wq", "Wk", "Wv", "Wo")}
        body |= {f"L{k}.W1": drawn(WIDTH, 4 * WIDTH, f"L{k}.W1"), f"L{k}.W2": drawn(4 * WIDTH, WIDTH, f"L{k}.W2")}
    return Model(body, drawn(WIDTH, vocabulary, "head"), np.zeros(vocabulary))


def normed(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + 1e-5)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def hidden(model: Model, ids: np.ndarray, positions: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(sequences, positions, WIDTH): the body's states. Padding (block -1) enters as zero and attends to nothing."""
    w, (n, t) = model.body, ids.shape
    real = blocks >= 0
    x = np.where(real[..., None], w["emb"][ids] + w["pos"][positions], 0.0)
    seen = (blocks[:, :, None] == blocks[:, None, :]) & real[:, :, None] & np.tri(t, dtype=bool)
    for k in range(LAYERS):
        y = normed(x)
        q, key, v = ((y @ w[f"L{k}.{m}"]).reshape(n, t, HEADS, -1).transpose(0, 2, 1, 3) for m in ("Wq", "Wk", "Wv"))
        scores = np.where(seen[:, None], q @ key.swapaxes(2, 3) / np.sqrt(WIDTH // HEADS), -1e300)
        out = np.where(real[:, None, :, None], softmax(scores) @ v, 0.0)
        x = x + out.transpose(0, 2, 1, 3).reshape(n, t, WIDTH) @ w[f"L{k}.Wo"]
        x = x + np.maximum(normed(x) @ w[f"L{k}.W1"], 0.0) @ w[f"L{k}.W2"]
    return normed(x)


def dropout(states: np.ndarray, branch: str, step: int, index: int) -> np.ndarray:
    """The states (positions, WIDTH) of one sequence with units dropped by keyed draws, the others scaled up."""
    kept = draws(H.key(config.SEED, branch, step, "dropout", index), states.size).reshape(states.shape) < 1 - DROPOUT
    return np.where(kept, states / (1 - DROPOUT), 0.0)


def losses(model: Model, ids: np.ndarray, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss of each position, states before the positions that bear loss, their errors: probability less target) of one sequence."""
    at = np.flatnonzero(mask[1:] == 1) + 1
    before = states[at - 1]
    p = softmax(before @ model.head + model.bias)
    out = np.zeros(len(ids))
    out[at] = -np.log(np.maximum(p[np.arange(len(at)), ids[at]], 1e-12))
    p[np.arange(len(at)), ids[at]] -= 1.0
    return out, before, p


def gradient(model: Model, ids, positions, blocks, mask, branch: str = "root", step: int = 0, index: int = 0, training: bool = True) -> tuple[float, int, np.ndarray]:
    """(mean loss, positions that bear it, the mean gradient of head and bias as one vector) of one sequence."""
    ids, positions, blocks, mask = (np.asarray(a) for a in (ids, positions, blocks, mask))
    states = hidden(model, ids[None], positions[None], blocks[None])[0]
    each, before, errors = losses(model, ids, dropout(states, branch, step, index) if training else states, mask)
    n = len(before)
    if not n:
        return 0.0, 0, np.zeros(model.head.size + model.bias.size)
    return float(each.sum() / n), n, np.concatenate([(before.T @ errors).ravel(), errors.sum(axis=0)]) / n


def updated(model: Model, mean_gradient: np.ndarray, rate: float = RATE) -> Model:
    """The model after one step of gradient descent on the head."""
    cut = model.head.size
    return replace(model, head=model.head - rate * mean_gradient[:cut].reshape(model.head.shape), bias=model.bias - rate * mean_gradient[cut:])


@cache
def sketch_plan(width: int, dim: int = config.SKETCH, purpose: tuple = ("opus-sketch", 0, "hash")) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of each position, as selection.sketch_table() has them."""
    u = np.array([[H.uniform(k := H.key(config.SEED, *purpose, i), 0), H.uniform(k, 1)] for i in range(width)])
    return np.floor(u[:, 0] * dim).astype(np.int64) % dim, np.where(u[:, 1] < 0.5, 1.0, -1.0)


def sketched(v: np.ndarray, dim: int = config.SKETCH) -> np.ndarray:
    bucket, sign = sketch_plan(len(v), dim)
    return np.bincount(bucket, v * sign, minlength=dim)


def scored(model: Model, sequences: Iterable[tuple], dim: int = 0) -> Iterator[tuple[float, int, np.ndarray]]:
    """(mean loss, positions that bear it, the gradient's sketch in dim numbers) of each sequence (ids, positions, blocks, mask), as gradient() without dropout and sketched() have them.

    Only TILE rows and one gradient are held that are as wide as the vocabulary, however many the sequences and however
    long: a sketch is a sum, so each tile's part goes into it at once, what the targets take off apart.
    """
    w = np.vstack([model.head, model.bias])
    rows, g = np.empty((TILE, w.shape[1])), np.empty_like(w)
    if dim:
        bucket, sign = sketch_plan(w.size, dim)
        place = bucket + dim * (sign < 0)  # buckets of sign 1, then those of sign -1
        places = place.reshape(w.shape)
    for ids, positions, blocks, mask in sequences:
        states = hidden(model, ids[None], positions[None], blocks[None])[0]
        at = np.flatnonzero(mask[1:] == 1) + 1
        loss, sums = 0.0, np.zeros(2 * dim)
        for own in np.split(at, range(TILE, len(at), TILE)) if len(at) else ():
            before, target = np.column_stack([states[own - 1], np.ones(len(own))]), ids[own]
            e = np.matmul(before, w, out=rows[: len(own)])
            e -= e.max(axis=1, keepdims=True)
            z = np.exp(e, out=e).sum(axis=1)
            loss -= np.log(np.maximum(e[np.arange(len(own)), target] / z, 1e-12)).sum()
            if dim:
                np.matmul((before / z[:, None]).T, e, out=g)
                sums += np.bincount(place, g.ravel(), 2 * dim) - np.bincount(places[:, target].ravel(), before.T.ravel(), 2 * dim)
        n = max(len(at), 1)
        yield float(loss / n), len(at), (sums[:dim] - sums[dim:]) / n
