"""Names of working columns that no column of the user's rows has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` with underscores added until none is in ``taken`` in any case of letters.

    >>> fresh(["Score", "score_"], "score", "fit")
    ['score__', 'fit']
    """
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
