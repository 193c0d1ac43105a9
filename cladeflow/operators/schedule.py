"""Sharing workers among the stages of a pipeline by difficulty.

Spark plans its own tasks; this is for callers that run stages as separate applications.
"""

from __future__ import annotations


def share(nodes: int, difficulty: list[float]) -> list[int]:
    """Workers for each stage: one at least, the others in proportion to difficulty, by largest remainder."""
    if nodes < len(difficulty):
        raise ValueError("fewer workers than stages")
    if not difficulty:
        return []
    free, total = nodes - len(difficulty), sum(difficulty)
    wanted = [free * d / total if total else free / len(difficulty) for d in difficulty]
    out = [1 + int(w) for w in wanted]
    rest = sorted(range(len(out)), key=lambda i: (int(wanted[i]) - wanted[i], i))
    for i in rest[: nodes - sum(out)]:
        out[i] += 1
    return out


def stage_of(rank: int, shares: list[int]) -> int:
    """The stage of a worker, workers being numbered through the stages."""
    for stage, n in enumerate(shares):
        if rank < n:
            return stage
        rank -= n
    raise ValueError("no such worker")


def relative(values: list[float]) -> list[float]:
    """Each value over the smallest one."""
    least = min(values)
    return [v / least for v in values]
