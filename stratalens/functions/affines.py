"""Affine matrices on the driver (a few numbers each) and orientation of dense arrays by them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from stratalens.functions.nd import Nd

# The two directions of each patient axis.
AXIS_CODES = ("LR", "PA", "IS")


def to_square(matrix: np.ndarray, dims: int) -> np.ndarray:
    """A homogeneous matrix for so many axes: the leading part of a larger one, or a smaller one filled up with the identity; translations stay."""
    m = np.asarray(matrix, float)
    if m.ndim == 1 or m.size == 1:  # spacings, the last repeated
        scale = np.ravel(m)[: dims].tolist()
        return np.diag([*scale, *[1.0] * (dims - len(scale)), 1.0])
    n = min(len(m) - 1, dims)
    out = np.eye(dims + 1)
    out[:n, :n], out[:n, -1] = m[:n, :n], m[:n, -1]
    return out


def rotation(angles: float | Sequence[float]) -> np.ndarray:
    """In a plane by one angle, in space by angles about the first, second and third axis, the third applied first."""
    a = np.ravel(angles)
    if len(a) == 1:
        c, s = math.cos(a[0]), math.sin(a[0])
        return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
    out = np.eye(4)
    for k, t in enumerate(a):
        m = np.eye(4)
        i, j = [x for x in range(3) if x != k]
        sign = -1 if k == 1 else 1
        m[i, i] = m[j, j] = math.cos(t)
        m[i, j], m[j, i] = -sign * math.sin(t), sign * math.sin(t)
        out = out @ m
    return out


def shearing(coefficients: Sequence[float]) -> np.ndarray:
    """Two coefficients in a plane, six in space: what each axis takes from the others, axis by axis."""
    dims = {2: 2, 6: 3}[len(coefficients)]
    m, left = np.eye(dims + 1), list(coefficients)
    for i in range(dims):
        for j in range(dims):
            if i != j:
                m[i, j] = left.pop(0)
    return m


def scaling(factors: Sequence[float]) -> np.ndarray:
    return np.diag([*map(float, factors), 1.0])


def translation(shift: Sequence[float]) -> np.ndarray:
    m = np.eye(len(shift) + 1)
    m[:-1, -1] = shift
    return m


def zoomed(matrix: np.ndarray, spacing: Sequence[float], diagonal: bool = True) -> np.ndarray:
    """The matrix with other voxel sizes: its directions scaled to them, or (diagonal) only their sizes and signs."""
    m = np.asarray(matrix, float)
    n = len(m) - 1
    old = np.sqrt((m[:n, :n] ** 2).sum(axis=0))
    old[old == 0] = 1
    new = np.array([*spacing, *old[len(spacing) :]][:n], float)
    new[new == 0] = old[new == 0]
    out = np.eye(n + 1)
    if diagonal:
        out[:n, :n] = np.diag(new)
        return out
    out[:n, :n] = m[:n, :n] / old * new
    return out


def box_in(shape: Sequence[int], source: np.ndarray, target: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(shape, offset) of the box in a target's voxels that holds a box of a source's: its corners' extent, each side rounded, and the corner that comes first."""
    n = len(shape)
    corners = np.array(np.meshgrid(*[(0, s - 1) for s in shape], indexing="ij")).reshape(n, -1)
    world = np.asarray(source)[:n, :n] @ corners + np.asarray(source)[:n, -1:]
    inv = np.linalg.inv(np.asarray(target))
    there = inv[:n, :n] @ world + inv[:n, -1:]
    size = np.rint(there.max(axis=1) - there.min(axis=1)).astype(int) + 1
    start = there.min(axis=1)
    offset = np.asarray(target)[:n, :n] @ start + np.asarray(target)[:n, -1]
    return size.tolist(), offset


def resized(source: Sequence[int], target: Sequence[int], centered: bool = True) -> np.ndarray:
    """Scaling from a size's voxels to another's; centred, the middles of the arrays stay together."""
    scale = np.asarray(source, float) / np.asarray(target, float)
    m = scaling(scale)
    if centered:
        m[:-1, -1] = (scale - 1) / 2
    return m


def axis_codes(matrix: np.ndarray) -> str:
    """For each array axis the patient direction it grows in: the one that takes the largest part of it, each taken once."""
    m = np.asarray(matrix, float)[:3, :3]
    left, out = set(range(3)), [""] * 3
    for k in sorted(range(3), key=lambda k: -np.abs(m[:, k]).max()):
        axis = max(left, key=lambda i: abs(m[i, k]))
        left.discard(axis)
        out[k] = AXIS_CODES[axis][int(m[axis, k] > 0)]
    return "".join(out)


def reorientation(source: str, target: str) -> tuple[list[int], list[bool]]:
    """(for each target axis the source axis it comes from, whether that is flipped)."""
    order, flipped = [], []
    for t in target:
        pair = next(p for p in AXIS_CODES if t in p)
        k = next(i for i, s in enumerate(source) if s in pair)
        order.append(k)
        flipped.append(source[k] != t)
    return order, flipped


def oriented(image: Nd, source: str, target: str, channels: int = 0) -> Nd:
    """A dense array, after so many channel axes, turned and flipped from one set of axis codes to another."""
    order, flipped = reorientation(source, target)
    axes = [*range(channels), *[k + channels for k in order]]
    turned = image if axes == list(range(len(axes))) else image.transpose(axes)
    hit = [channels + i for i, f in enumerate(flipped) if f]
    return turned.flip(hit) if hit else turned


def oriented_affine(matrix: np.ndarray, shape: Sequence[int], source: str, target: str) -> np.ndarray:
    """The affine of the reoriented array."""
    order, flipped = reorientation(source, target)
    m = np.zeros((4, 4))
    m[3, 3] = 1
    for new, (old, f) in enumerate(zip(order, flipped, strict=True)):
        m[old, new] = -1 if f else 1
        m[old, 3] = shape[old] - 1 if f else 0
    return np.asarray(matrix, float) @ m


def grid(size: Sequence[int], spacing: Sequence[float] | None = None, homogeneous: bool = True) -> np.ndarray:
    """Coordinates (axes [and a one] x size) of an array's cells about its centre."""
    s = spacing or [1.0] * len(size)
    axes = [(np.arange(n) - (n - 1) / 2) * x for n, x in zip(size, s, strict=True)]
    g = np.stack(np.meshgrid(*axes, indexing="ij"))
    return np.concatenate([g, np.ones((1, *size))]) if homogeneous else g


def control_grid(size: Sequence[int], spacing: Sequence[float], homogeneous: bool = True) -> np.ndarray:
    """A coarser grid that covers an array with a point to spare on each side."""
    n = [math.ceil((d - 1) / (2 * s) + 0.5) * 2 + 2 if d % 2 == 0 else math.ceil((d - 1) / (2 * s)) * 2 + 3 for d, s in zip(size, spacing, strict=True)]
    return grid(n, spacing, homogeneous)


def divisible_size(size: Sequence[int], k: Sequence[int] | int) -> list[int]:
    """The next sizes that k divides; a k of 0 leaves the axis."""
    ks = [k] * len(size) if isinstance(k, int) else list(k)
    return [math.ceil(n / d) * d if d > 0 else n for n, d in zip(size, ks, strict=True)]


def valid_patch(size: Sequence[int], patch: Sequence[int]) -> list[int]:
    """A patch no larger than the array; 0 and missing sizes are the array's own."""
    want = [*patch, *[0] * (len(size) - len(patch))][: len(size)]
    return [min(n, p or n) for n, p in zip(size, want, strict=True)]
