"""Vectorised union-find over the links that one task has found."""

from __future__ import annotations

import numpy as np


def flatten(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents (each at most its index) after linking a[i] with b[i]; flat on return."""
    parent = flatten(parent)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = flatten(parent)
    return parent
