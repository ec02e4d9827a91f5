"""Greedy decoding with an n-gram ban and a loop guard, over any step function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NGRAM, MIN_RUN, CHECK_EVERY, MAX_TOKENS = 4, 40, 12, 2048


class NgramBan:
    """What followed each n-gram beginning so far; grows by one entry a token."""

    def __init__(self, n: int = NGRAM):
        self.n, self.seq, self.after = n, [], {}

    def add(self, token: int) -> None:
        self.seq.append(token)
        if len(self.seq) >= self.n:
            self.after.setdefault(tuple(self.seq[-self.n : -1]), set()).add(token)

    def banned(self) -> set[int]:
        return self.after.get(tuple(self.seq[1 - self.n :]), set()) if len(self.seq) >= self.n - 1 else set()


def looping(seq: list[int], min_run: int = MIN_RUN) -> bool:
    """The end is one token, six rounds of a cycle up to 12, or three of one up to 60."""
    if len(seq) < min_run:
        return False
    if len(set(seq[-min_run:])) == 1:
        return True
    tail = np.asarray(seq[-180:])
    return any(len(tail) >= p * k and bool(np.array_equal(tail[-p * k + p :], tail[-p * k : -p])) for p, k in ((p, 6 if p <= 12 else 3) for p in range(2, 61)))


def pick(logits: np.ndarray, banned: set[int]) -> int:
    """Place of the first maximum that is not banned."""
    logits = np.asarray(logits)
    out = [t for t in banned if 0 <= t < len(logits)]
    if out:
        logits = np.array(logits, copy=True)
        logits[out] = -np.inf
    return int(np.argmax(logits))


def greedy(first: np.ndarray, step: Callable[[int], np.ndarray], eos: int, max_tokens: int = MAX_TOKENS) -> tuple[list[int], str]:
    """Tokens and why they end: eos, repetition or max_tokens. first: logits after the prompt; they are not banned."""
    ban, token = NgramBan(), int(np.argmax(first))
    for _ in range(max_tokens):
        if token == eos:
            return ban.seq, "eos"
        ban.add(token)
        if len(ban.seq) % CHECK_EVERY == 0 and looping(ban.seq):
            seq = ban.seq
            while len(seq) > 1 and looping(seq):
                seq.pop()
            return seq, "repetition"
        token = pick(step(token), ban.banned())
    return ban.seq, "max_tokens"
