"""Schedules on small aggregates: what to collect next, under shares of sources."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Need:
    """A family and how many records it still lacks."""

    family: str
    lacks: int


def allocate(needs: list[Need], held: dict[str, int], caps: dict[str, int], size: int, share: float) -> list[tuple[str, str]]:
    """Up to ``size`` picks (family, source), one at a time: the family that lacks most, then the source held least; no source beyond its cap, nor
    beyond ``share`` of all that is held once the pick is counted. Ties go by name. Input is an aggregate of families and sources, some
    hundreds of numbers; each pick changes the next share, so this runs on the driver."""
    left = {n.family: n.lacks for n in needs}
    have = dict.fromkeys(caps, 0) | held
    given = dict.fromkeys(caps, 0)
    total = sum(have.values())
    picks: list[tuple[str, str]] = []
    while len(picks) < size:
        family = min((f for f, n in left.items() if n > 0), key=lambda f: (-left[f], f), default=None)
        fits = [s for s in caps if given[s] < caps[s] and have[s] + 1 <= max(1.0, share * (total + 1))]
        if family is None or not fits:
            return picks
        source = min(fits, key=lambda s: (have[s], s))
        left[family] -= 1
        have[source] += 1
        given[source] += 1
        total += 1
        picks.append((family, source))
    return picks
