"""Attributes derived from a cell's annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: transmitters by effect
EXCITING = ["acetylcholine", "dopamine", "serotonin", "octopamine", "ach", "da", "5ht", "5-ht", "oct", "ser"]
INHIBITING = ["gaba", "glutamate", "glu"]
#: Nanometres per voxel.
VOXEL_NM = (4.0, 4.0, 40.0)


def sign_by_prefix(nt: Column) -> Column:
    """-1 for names that begin with GABA or GLU in any case, else +1, also for null."""
    up = F.upper(nt)
    return F.when(F.coalesce(up.startswith("GABA") | up.startswith("GLU"), F.lit(False)), -1).otherwise(1)


def _sign_of_names(nt: Column) -> Column:
    names = F.transform(F.split(nt, "[;,]"), lambda t: F.lower(F.trim(t)))
    stated = F.filter(names, lambda t: (t != "") & ~t.contains("negative"))
    plus, minus = F.exists(stated, lambda t: t.isin(EXCITING)), F.exists(stated, lambda t: t.isin(INHIBITING))
    return F.when(plus & ~minus, 1).when(minus & ~plus, -1)


def sign_by_names(known: Column, top: Column) -> Column:
    """+1 or -1 if all names stated have one effect, the known ones first, then the predicted; null for both or neither. Names said to be negative don't count."""
    return F.coalesce(_sign_of_names(known), _sign_of_names(top))


def label(*levels: Column) -> Column:
    """The first level that isn't blank, else `?`."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in levels], F.lit("?"))


def by_prefix(x: Column, cases: dict[str, str], other: str = "other", missing: str = "?") -> Column:
    """The value of the first prefix that fits, in the order given."""
    out = F.when(x.isNull(), F.lit(missing))
    for prefix, value in cases.items():
        out = out.when(x.startswith(prefix), F.lit(value))
    return out.otherwise(F.lit(other))


def any_contains(columns: list[Column], terms: list[str]) -> Column:
    """Whether any column holds any of the terms, in any case; null holds nothing."""
    hits = [F.coalesce(F.lower(c).contains(t.lower()), F.lit(False)) for c in columns for t in terms]
    return reduce(lambda a, b: a | b, hits)


def same_text(x: Column, text: str) -> Column:
    """Equal in any case; null is not."""
    return F.coalesce(F.lower(x) == text.lower(), F.lit(False))


def wrapped(angle: Column) -> Column:
    """An angle's difference, in [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
