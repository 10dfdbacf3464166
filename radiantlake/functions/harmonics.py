"""Spherical harmonics as polynomials in a direction, and colours from them."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def basis(degree: int, x: Column, y: Column, z: Column) -> list[Column]:
    """The (degree + 1)^2 real harmonics at a unit direction, degree 0 to 4."""
    one = F.lit(1.0)
    xx, yy, zz, xy, yz, xz = x * x, y * y, z * z, x * y, y * z, x * z
    terms = [[(sqrt(1 / (4 * pi)), one)]]
    k1 = sqrt(3 / (4 * pi))
    terms.append([(-k1, y), (k1, z), (-k1, x)])
    k2 = sqrt(15 / (4 * pi))
    terms.append([(k2, xy), (-k2, yz), (sqrt(5 / (16 * pi)), 2 * zz - xx - yy), (-k2, xz), (k2 / 2, xx - yy)])
    a, b, c = sqrt(35 / (32 * pi)), sqrt(105 / (4 * pi)), sqrt(21 / (32 * pi))
    terms.append(
        [(-a, y * (3 * xx - yy)), (b, xy * z), (-c, y * (4 * zz - xx - yy)), (sqrt(7 / (16 * pi)), z * (2 * zz - 3 * xx - 3 * yy)), (-c, x * (4 * zz - xx - yy)), (b / 2, z * (xx - yy)), (-a, x * (xx - 3 * yy))]
    )
    d, e, f, g = 3 / 4 * sqrt(35 / pi), 3 / 4 * sqrt(35 / (2 * pi)), 3 / 4 * sqrt(5 / pi), 3 / 4 * sqrt(5 / (2 * pi))
    terms.append(
        [
            (d, xy * (xx - yy)),
            (-e, yz * (3 * xx - yy)),
            (f, xy * (7 * zz - 1)),
            (-g, yz * (7 * zz - 3)),
            (sqrt(9 / (256 * pi)), zz * (35 * zz - 30) + 3),
            (-g, xz * (7 * zz - 3)),
            (f / 2, (xx - yy) * (7 * zz - 1)),
            (-e, xz * (xx - 3 * yy)),
            (d / 4, xx * (xx - 3 * yy) - yy * (3 * xx - yy)),
        ]
    )
    return [F.lit(k) * term for band in terms[: degree + 1] for k, term in band]


def radiance(degree: int, dc: Column, rest: Column, direction: Column, per_channel: int = 15) -> Column:
    """Red, green, blue of a direction: dc has one coefficient a channel, rest has
    per_channel for red, then green, then blue."""
    values = basis(degree, direction[0], direction[1], direction[2])
    channels = []
    for c in range(3):
        total = values[0] * dc[c]
        for k in range(1, (degree + 1) ** 2):
            total = total + values[k] * rest[c * per_channel + k - 1]
        channels.append(total)
    return F.array(*channels)


def shown(color: Column) -> Column:
    """Radiance as a colour: moved by a half and not below zero."""
    return F.transform(color, lambda x: F.greatest(x + 0.5, F.lit(0.0)))


_C0 = sqrt(1 / (4 * pi))


def harmonic_of_rgb(rgb: Column) -> Column:
    return F.transform(rgb, lambda x: (x - 0.5) / _C0)


def rgb_of_harmonic(dc: Column) -> Column:
    return F.transform(dc, lambda x: x * _C0 + 0.5)
