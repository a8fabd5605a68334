"""Linear-chain models over many short chains at once, time first: arrays are (steps, chains, states)."""

from __future__ import annotations

import numpy as np


def pieces(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts, given by where each ends, into chains of at most ``size``: start and length of each chain, and its text."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    count = -((starts - ends) // size)
    owner = np.repeat(np.arange(len(ends)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[owner] + nth * size
    return at, np.minimum(ends[owner] - at, size), owner


def padded(at: np.ndarray, length: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each step of each chain and whether the chain reaches it."""
    step = np.arange(steps)[:, None]
    inside = step < length[None, :]
    return np.where(inside, at[None, :] + step, at[None, :]), inside


def forward_backward(emission: np.ndarray, inside: np.ndarray, transition: np.ndarray, with_pairs: bool = False):
    """Posterior of each step's state, log-likelihood normaliser of each chain, and expected transitions if asked for."""
    steps, chains, states = emission.shape
    top = emission.max(2, keepdims=True)
    local = np.exp(emission - top)
    local[~inside] = 1
    move = np.exp(transition)
    alpha, scale = np.empty_like(local), np.ones((steps, chains), local.dtype)
    now = local[0]
    for t in range(steps):
        if t:
            now = np.where(inside[t][:, None], (alpha[t - 1] @ move) * local[t], alpha[t - 1])
        total = now.sum(1)
        scale[t], alpha[t] = total, now / total[:, None]
    beta, post = np.ones((chains, states), local.dtype), np.empty_like(local)
    pairs = np.zeros((states, states))
    for t in range(steps - 1, -1, -1):
        post[t] = alpha[t] * beta
        if t:
            back = local[t] * beta / scale[t][:, None]
            if with_pairs:
                pairs += (alpha[t - 1] * inside[t][:, None]).T @ (back * inside[t][:, None]) * move
            beta = np.where(inside[t][:, None], back @ move.T, beta)
    post /= post.sum(2, keepdims=True)
    normal = (np.log(scale) * inside).sum(0) + (top[:, :, 0] * inside).sum(0)
    return post, normal, pairs


def viterbi(emission: np.ndarray, inside: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The most likely states of each chain; of equal ones the first."""
    steps, chains, states = emission.shape
    # One long vector per state: maxima over a handful of states are taken vector by vector.
    score, came = np.ascontiguousarray(emission[0].T), np.zeros((steps, states, chains), np.int8)
    for t in range(1, steps):
        now, here = np.ascontiguousarray(emission[t].T), inside[t]
        new = np.empty_like(score)
        for to in range(states):
            best = score[0] + transition[0, to]
            for of in range(1, states):
                way = score[of] + transition[of, to]
                came[t, to][way > best] = of
                np.maximum(best, way, out=best)
            new[to] = best + now[to]
        score = np.where(here, new, score)
    path = np.empty((steps, chains), np.int8)
    state, every = score.argmax(0), np.arange(chains)
    for t in range(steps - 1, -1, -1):
        path[t] = state
        state = np.where(inside[t], came[t][state, every], state)
    return path
