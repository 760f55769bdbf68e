"""The cheapest order of a product of several matrices."""

from __future__ import annotations

from functools import cache

from ..operators.matrix import MatrixFrame


def order(sizes: list[int]):
    """sizes: rows of the first matrix, then the columns of each -> a tree of pairs over their places with the fewest multiplications."""

    @cache
    def best(a: int, b: int):
        if b - a == 1:
            return 0, a
        return min(((best(a, k)[0] + best(k, b)[0] + sizes[a] * sizes[k] * sizes[b], (best(a, k)[1], best(k, b)[1])) for k in range(a + 1, b)), key=lambda x: x[0])

    return best(0, len(sizes) - 1)[1]


def chain_product(frames: list[MatrixFrame], sizes: list[int]) -> MatrixFrame:
    def run(tree) -> MatrixFrame:
        return frames[tree] if isinstance(tree, int) else run(tree[0]).matmul(run(tree[1]))

    return run(order(sizes))
