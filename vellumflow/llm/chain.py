"""Skip-chain conditional random field: linear chains, links between distant similar tokens, loopy sum-product."""

from __future__ import annotations

import numpy as np


class Segments:
    """Chains over consecutive tokens, laid out so that all chains advance together."""

    def __init__(self, starts: np.ndarray, n: int):
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths, self.n = starts[order], lengths[order], n
        longest = int(self.lengths[0]) if len(order) else 0
        # Chains still going at step t come first.
        self.going = np.searchsorted(-self.lengths, -np.arange(longest), side="left")

    def pass_over(self, potential: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward, backward (both scaled), marginals, and the log normaliser of each step."""
        n, k = potential.shape
        forward, backward = np.zeros((n, k)), np.ones((n, k))
        scale = np.ones(n)
        for t, g in enumerate(self.going):
            at = self.starts[:g] + t
            a = (start * potential[at]) if t == 0 else (forward[at - 1] @ transition) * potential[at]
            z = a.sum(axis=1)
            forward[at], scale[at] = a / z[:, None], z
        for t in range(len(self.going) - 2, -1, -1):
            at = self.starts[: self.going[t + 1]] + t
            b = (backward[at + 1] * potential[at + 1]) @ transition.T
            backward[at] = b / b.sum(axis=1)[:, None]
        marginal = forward * backward
        marginal /= marginal.sum(axis=1)[:, None]
        return forward, backward, marginal, np.log(scale)

    def pair_expectation(self, potential: np.ndarray, transition: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Expected number of each pair of neighbouring labels."""
        inner = np.ones(self.n, dtype=bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        left, right = forward[at - 1], potential[at] * backward[at]
        z = np.einsum("ni,ij,nj->n", left, transition, right)
        return transition * ((left / z[:, None]).T @ right)


def loopy_marginals(segments: Segments, potential: np.ndarray, transition: np.ndarray, start: np.ndarray, links: np.ndarray, skip: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Marginals with links (pairs of token places) that share the potential ``skip`` of their two labels.

    Each round passes over all chains exactly, then sends every link's messages both ways from the beliefs of its ends less
    what came from the other end; the messages join the potentials of the next pass. A token has at most two links
    (to its last and next similar token), so messages reach along all of a document's repetitions.
    """
    marginal = segments.pass_over(potential, transition, start)[2]
    if not len(links):
        return marginal
    a, b = links[:, 0], links[:, 1]
    k = potential.shape[1]
    to_a, to_b = np.full((len(links), k), 1.0 / k), np.full((len(links), k), 1.0 / k)
    for _ in range(rounds):
        from_a, from_b = marginal[a] / to_a, marginal[b] / to_b
        to_b, to_a = from_a @ skip, from_b @ skip.T
        to_a /= to_a.sum(axis=1)[:, None]
        to_b /= to_b.sum(axis=1)[:, None]
        to_a, to_b = np.maximum(to_a, 1e-12), np.maximum(to_b, 1e-12)
        joined = potential.copy()
        np.multiply.at(joined, a, to_a * k)
        np.multiply.at(joined, b, to_b * k)
        joined = np.maximum(joined / joined.max(axis=1)[:, None], 1e-30)
        marginal = np.maximum(segments.pass_over(joined, transition, start)[2], 1e-30)
    return marginal
