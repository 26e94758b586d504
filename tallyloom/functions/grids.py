"""Grids (arrays of rows of colours 0-9) as column expressions: all higher-order functions, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 30


def from_vector(v: Column, width: int) -> Column:
    """A row-major vector of numbers cut into rows, each number made a colour."""
    rows = F.floor(F.size(v) / width).cast("int")
    cell = lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 100), F.lit(10)).cast("int")
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.slice(v, r * width + 1, F.lit(width)), cell))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, as the element of an array of
    one; where a lambda names an expression, it is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def valid(g: Column) -> Column:
    """Not empty, rectangular, colours 0 to 9, no side over 30."""

    def known(g: Column, width: Column) -> Column:
        whole = F.forall(g, lambda r: (F.size(r) == width) & F.forall(r, lambda c: c.isNotNull() & c.between(0, 9)))
        return F.coalesce((F.size(g) > 0) & (width > 0) & (F.size(g) <= LARGEST) & (width <= LARGEST) & whole, F.lit(False))

    return once(g, lambda x: once(F.size(F.get(x, F.lit(0))), lambda width: known(x, width)))


def text(g: Column) -> Column:
    """Rows of digits, one to a line."""
    return F.array_join(F.transform(g, lambda r: F.array_join(F.transform(r, lambda c: c.cast("string")), "")), "\n")


def from_text(t: Column) -> Column:
    """The inverse; blank lines are skipped, null unless all are digits."""
    digits = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substr(x, i, F.lit(1)).try_cast("int"))
    read = lambda lines: F.when(F.forall(lines, lambda x: x.rlike("^[0-9]+$")) & (F.size(lines) > 0), F.transform(lines, digits))
    return once(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), read)


def turned(g: Column) -> Column:
    """A quarter turn clockwise."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(g, F.lit(0))) - 1), lambda c: F.transform(F.reverse(g), lambda r: r[c]))


def mirrored(g: Column) -> Column:
    return F.transform(g, lambda r: F.reverse(r))


def upended(g: Column) -> Column:
    """Half a turn."""
    return F.reverse(F.transform(g, lambda r: F.reverse(r)))


def dihedral(g: Column, rotations: Column, flip: Column) -> Column:
    """Quarter turns first, then the mirror."""
    r = F.pmod(rotations, F.lit(4))
    spun = F.when(r == 0, g).when(r == 1, turned(g)).when(r == 2, upended(g)).otherwise(turned(upended(g)))
    return F.when(flip, mirrored(spun)).otherwise(spun)


def undo_dihedral(g: Column, rotations: Column, flip: Column) -> Column:
    """The mirror first, then the turns back."""
    straight = F.when(flip, mirrored(g)).otherwise(g)
    r = F.pmod(rotations, F.lit(4))
    return F.when(r == 0, straight).when(r == 1, turned(upended(straight))).when(r == 2, upended(straight)).otherwise(turned(straight))


def painted(g: Column, palette: Column) -> Column:
    return F.transform(g, lambda r: F.transform(r, lambda c: palette[c]))


def unpainted(g: Column, palette: Column) -> Column:
    return F.transform(g, lambda r: F.transform(r, lambda c: (F.array_position(palette, c) - 1).cast("int")))


def augmented(g: Column, rotations: Column, flip: Column, palette: Column) -> Column:
    """Dihedral element, then palette; a null grid stays null."""
    return F.when(g.isNotNull(), painted(dihedral(g, rotations, flip), palette))


def restored(g: Column, rotations: Column, flip: Column, palette: Column) -> Column:
    return F.when(g.isNotNull(), undo_dihedral(unpainted(g, palette), rotations, flip))


def cells(g: Column) -> Column:
    return F.aggregate(g, F.lit(0), lambda s, r: s + F.size(r))


def any_of_first_two(attempts: Column, solution: Column) -> Column:
    return F.exists(F.slice(attempts, 1, 2), lambda x: x == solution)
