"""Angles, energies and rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerotrace.schema import CATEGORIES, EARTH_RADIUS, GRAVITY, SOUND_SPEED


def finite(x: Column) -> Column:
    """x, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clean(x: Column) -> Column:
    """x, or 0 for null, NaN and infinities."""
    return F.coalesce(finite(x), F.lit(0.0))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_local(longitude: Column, latitude: Column, altitude: Column) -> tuple[Column, Column, Column]:
    """Metres east, up and north of the origin of coordinates."""
    return EARTH_RADIUS * F.radians(longitude) * F.cos(F.radians(latitude)), altitude, EARTH_RADIUS * F.radians(latitude)


def distance(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def bearing(dx: Column, dz: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dz, dx)), F.lit(360.0))


def folded(radians: Column) -> Column:
    """The size of an angle in degrees, folded once at 180."""
    a = F.abs(F.degrees(radians))
    return F.when(a > 180, 360 - a).otherwise(a)


def off_nose(dx: Column, dz: Column, heading: Column) -> Column:
    """The angle between a heading and the direction (dx, dz)."""
    return folded(F.atan2(dz, dx) - heading)


def specific_energy(altitude: Column, speed: Column) -> Column:
    return altitude + speed * speed / (2.0 * GRAVITY)


def turn_rate_from_load(load: Column, speed: Column) -> Column:
    n = F.abs(load)
    return F.when((n <= 1) | (speed < 30), 0.0).otherwise(F.degrees(GRAVITY * F.sqrt(F.greatest(n * n - 1, F.lit(0.0))) / F.nullif(speed, F.lit(0.0))))


def speed_or_estimate(speed: Column, mach: Column) -> Column:
    return F.when(speed > 0, speed).when(mach > 0, mach * SOUND_SPEED).otherwise(200.0)


def wrapped(radians: Column) -> Column:
    """An angle in -pi..pi."""
    pi = F.pi()
    return radians - 2 * pi * F.ceil((radians - pi) / (2 * pi))


def category(score: Column, japanese: bool = False) -> Column:
    out = None
    for name, ja, above in CATEGORIES:
        value = F.lit(ja if japanese else name)
        out = F.when(score > above, value) if out is None else out.otherwise(value) if above is None else out.when(score > above, value)
    return out


def euler(m: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Heading, pitch and bank from the axes of a rotation matrix: x (nose), y (up) and z (right wing)."""
    return F.atan2(m["xz"], m["xx"]), F.asin(m["xy"]), F.atan2(-m["zy"], m["yy"])


def blend(score: Column) -> Column:
    """Red, green and blue of a score in -1..1: red over yellow to green."""
    s = clip(score)
    return F.struct(F.when(s < 0, 1.0).otherwise(1 - s).alias("r"), F.when(s < 0, 1 + s).otherwise(1.0).alias("g"), F.lit(0.0).alias("b"))
