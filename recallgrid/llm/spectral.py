"""Leading eigenpairs of a symmetric matrix by spectral divide and conquer.

A polar decomposition of the matrix shifted by ``s`` has the factor sign(A - s I);
half of it plus the identity projects onto the eigenvectors beyond ``s``.  An
orthonormal basis of that subspace and its complement splits the matrix in two
blocks, which are split in turn until single components are left.  Blocks below
the wanted ones are never split.  The polar factor comes from dynamically
weighted Halley steps (QDWH): QR while ill-conditioned, then a Cholesky-sized
solve.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix; symmetric itself."""
    n = len(a)
    scale = np.linalg.norm(a)
    if not scale:
        return np.eye(n)
    x, low, eye = a / scale, EPS, np.eye(n)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        if c > 100:
            both = np.linalg.qr(np.concatenate([np.sqrt(c) * x, eye]))[0]
            new = q / c * x + (p - q / c) / np.sqrt(c) * both[:n] @ both[n:].T
        else:
            new = q / c * x + (p - q / c) * np.linalg.solve(eye + c * x.T @ x, x.T).T
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + c * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 10 * EPS and moved <= 1e-8:  # the steps are cubic: the next one would be at rounding level
            return x
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the upper part of the spectrum, and k."""
    n, diagonal = len(a), np.diag(a)
    size = np.linalg.norm(a)
    shifts = [np.median(diagonal), diagonal.mean(), *np.linspace(diagonal.min(), diagonal.max(), 9)[1:-1]]
    rng, best = np.random.default_rng(0), None
    for shift in shifts:
        factor = polar_factor(a - shift * np.eye(n))
        k = round((np.trace(factor) + n) / 2)
        if not 0 < k < n:
            continue
        projector = (factor + np.eye(n)) / 2
        basis = np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
        for _ in range(2):  # subspace steps, in case the first block lay badly
            basis = np.linalg.qr(projector @ basis, mode="complete")[0]
            error = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
            if best is None or error < best[0]:
                best = error, basis, k
            basis = basis[:, :k]
        if best[0] <= 4 * n * EPS * size:
            break
    return best and best[1:]


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    n = len(a)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    floor = n * EPS * np.linalg.norm(a)

    def descend(basis: np.ndarray, left: int) -> None:
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        m = len(block)
        spread = np.linalg.norm(block - np.eye(m) * (np.trace(block) / m))
        divided = split(block) if m > 1 and spread > floor * 1e-2 else None
        if divided is None:  # one component, or equal ones: any basis of theirs will do
            values.extend(np.diag(block))
            vectors.extend(basis.T)
            return
        inner, k = divided
        descend(basis @ inner[:, :k], left)
        if k < left:
            descend(basis @ inner[:, k:], left - k)

    if n:
        descend(np.eye(n), min(wanted, n))
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    chosen = np.array(vectors).reshape(-1, n)[order]
    chosen /= np.linalg.norm(chosen, axis=1, keepdims=True)
    return np.array(values)[order], chosen.T
