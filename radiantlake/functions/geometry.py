"""Rotations, covariances and camera matrices over columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .scalars import dot, matvec, unit


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def rotation_matrix(q: Column, normalize: bool = True) -> Column:
    """Rows of the rotation of quaternion (w, x, y, z)."""

    def rows(q: Column) -> Column:
        w, x, y, z = (q[i] for i in range(4))
        return F.array(
            F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
            F.array(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
            F.array(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
        )

    return _with(unit(q), rows) if normalize else rows(q)


@pandas_udf(T.ArrayType(T.DoubleType()))
def quaternion(rows: pd.Series) -> pd.Series:
    """Quaternion (w, x, y, z), w >= 0, of a rotation matrix: the eigenvector of the
    largest eigenvalue of its symmetric 4 x 4 form, which also gives the nearest
    rotation of an inexact matrix. Null for null."""

    known = rows.notna().to_numpy()
    out = pd.Series([None] * len(rows), dtype=object)
    if known.any():
        r = np.array([[list(x) for x in m] for m in rows[known]], dtype=float)
        k = np.zeros((len(r), 4, 4))
        k[:, :3, :3] = r + r.transpose(0, 2, 1) - np.eye(3) * np.trace(r, axis1=1, axis2=2)[:, None, None]
        k[:, 3, :3] = k[:, :3, 3] = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], axis=1)
        k[:, 3, 3] = np.trace(r, axis1=1, axis2=2)
        vectors = np.linalg.eigh(k)[1][:, :, -1]
        q = vectors[:, [3, 0, 1, 2]]
        q = np.where(q[:, :1] >= 0, q, -q)
        out[known] = pd.Series(list(q), index=np.flatnonzero(known))
    return out


def covariance(scales: Column, rotation: Column, modifier: float = 1.0) -> Column:
    """Upper triangle (xx, xy, xz, yy, yz, zz) of R S S^T R^T; scales are activated."""
    spread = F.zip_with(scales, scales, lambda a, b: a * b * (modifier * modifier))

    def entries(x: Column) -> Column:
        rows, s = x["rows"], x["spread"]
        return F.array(*(rows[i][0] * rows[j][0] * s[0] + rows[i][1] * rows[j][1] * s[1] + rows[i][2] * rows[j][2] * s[2] for i in range(3) for j in range(i, 3)))

    return _with(F.struct(rotation_matrix(rotation).alias("rows"), spread.alias("spread")), entries)


def camera_center(rotation: Column, t: Column) -> Column:
    """-R^T t of a world-to-camera rotation (rows) and translation."""
    return F.array(*(-(rotation[0][i] * t[0] + rotation[1][i] * t[1] + rotation[2][i] * t[2]) for i in range(3)))


def world_to_view(rotation: Column, t: Column, shift: Column | None = None, scale: float = 1.0) -> Column:
    """4 x 4 matrix that takes world points to the camera, after the camera's centre has
    been moved by shift and scaled. A rigid matrix inverts in closed form, so the new
    translation is -R (centre + shift) scale."""
    center = camera_center(rotation, t)
    if shift is not None:
        center = F.zip_with(center, shift, lambda a, b: a + b)
    moved = F.transform(center, lambda x: x * scale)
    back = matvec(rotation, moved)
    return F.array(*(F.concat(rotation[i], F.array(-back[i])) for i in range(3)), F.array(*(F.lit(float(v)) for v in (0, 0, 0, 1))))


def projection(near: float, far: float, fov_x: Column, fov_y: Column) -> Column:
    """Perspective matrix with depth from 0 to 1 and the eye looking along +z."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        F.array(1 / F.tan(fov_x / 2), zero, zero, zero),
        F.array(zero, 1 / F.tan(fov_y / 2), zero, zero),
        F.array(zero, zero, F.lit(far / (far - near)), F.lit(-far * near / (far - near))),
        F.array(zero, zero, one, zero),
    )


def project_point(matrix: Column, point: Column) -> Column:
    """A point through a 4 x 4 matrix of rows, divided by w + 1e-7."""
    h = F.concat(point, F.array(F.lit(1.0)))
    out = matvec(matrix, h)
    return F.transform(F.slice(out, 1, 3), lambda x: x / (out[3] + 1e-7))


def flip_axes(matrix: Column) -> Column:
    """A camera-to-world matrix from y up, z back to y down, z forward: its second and third columns change sign."""
    return F.transform(matrix, lambda row: F.array(row[0], -row[1], -row[2], row[3]))


def rigid_inverse(matrix: Column) -> Column:
    """Inverse of a rigid 4 x 4 matrix of rows: (R^T, -R^T t)."""
    turned = [F.array(*(matrix[j][i] for j in range(3))) for i in range(3)]
    t = F.array(*(matrix[j][3] for j in range(3)))
    return F.array(*(F.concat(row, F.array(-dot(row, t))) for row in turned), F.array(*(F.lit(float(v)) for v in (0, 0, 0, 1))))
