"""Large groups dealt out in units, so that no task holds a group whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def unit_pairs(unit: np.ndarray, home: bool, homes: int, visits: int) -> Iterator[tuple[np.ndarray, int, int, bool]]:
    """(positions, left unit, right unit, whether theirs is the right one) of points whose units are given.

    Members of a group are dealt in units 0..homes-1, visitors in homes..homes+visits-1. Every two members, and every
    member and visitor, have exactly one pair of units in common; visitors never meet one another.
    """
    for u in np.unique(unit).tolist():
        mine = np.flatnonzero(unit == u)
        if home:
            for other in range(homes):
                yield mine, min(u, other), max(u, other), u > other
            for visitor in range(visits):
                yield mine, u, homes + visitor, False
        else:
            for member in range(homes):
                yield mine, member, homes + u, True
