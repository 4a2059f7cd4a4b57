"""Components of links between places of an array, inside a task."""

import numpy as np


def joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's component, once places `a` and `b` are linked too; `roots` says it before, and is changed."""
    while True:
        a, b = roots[a], roots[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return roots
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := roots[roots], roots):
            roots = up
