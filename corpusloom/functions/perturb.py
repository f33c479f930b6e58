"""Text perturbations as Column expressions. Null stands for: doesn't apply.

A perturbation that changes nothing, or makes a text longer than 512 characters, is skipped by the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ALNUM_RUN, MAX_CHARS, let


def letter_case(x: Column) -> Column:
    """Upper and lower ASCII letters change places."""
    return F.translate(x, ascii_lowercase + ascii_uppercase, ascii_uppercase + ascii_lowercase)


def horizontal_white(x: Column) -> Column:
    """Blanks and tabs change places; a text without any gets a blank in front if there is room."""
    swapped = F.translate(x, " \t", "\t ")
    return F.when(swapped != x, swapped).when(F.length(x) < MAX_CHARS, F.concat(F.lit(" "), x))


def full_width(x: Column) -> Column:
    """ASCII letters and digits in their full-width forms."""
    plain = ascii_letters + digits
    return F.translate(x, plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))


def terminal_mark(x: Column) -> Column:
    """One more ``!`` at the end; without room, a final ASCII mark is changed."""
    last, body = F.substring(x, -1, 1), F.substring(x, F.lit(1), F.length(x) - 1)
    return F.when(F.length(x) < MAX_CHARS, F.concat(x, F.lit("!"))).when(last.rlike(r"\A\p{Punct}\z"), F.concat(body, F.when(last == "!", ".").otherwise("!")))


def longest_run(x: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then(run, start)`` on the first longest run of letters and digits, its place counted from 1.

    The first place where that run's text occurs is the run itself: elsewhere it could only lie in a longer run.
    """
    runs = F.regexp_extract_all(x, F.lit(f"({ALNUM_RUN})"), F.lit(1))
    first = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    return let(F.struct(first.alias("run"), x.alias("x")), lambda s: then(s["run"], F.instr(s["x"], s["run"]).cast("int")))


def _splice(x: Column, before: Column, cut: Column | int, new: Column) -> Column:
    """x with ``cut`` characters after the first ``before`` ones replaced."""
    return F.concat(F.substring(x, F.lit(1), before), new, F.substring(x, before + F.lit(1) + cut, F.length(x)))


def delete_middle(x: Column) -> Column:
    """The longest run of five or more loses its middle character."""
    return longest_run(x, lambda r, at: F.when(F.length(r) >= 5, _splice(x, at - 1 + F.floor(F.length(r) / 2).cast("int"), F.lit(1), F.lit(""))))


def swap_neighbours(x: Column) -> Column:
    """In the longest run of four or more, the two unequal neighbours nearest the centre (the first on a tie) change places."""

    def swap(r: Column, at: Column) -> Column:
        n = F.length(r)
        places = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(1)) != F.substring(r, i + 1, F.lit(1)))
        centre = F.floor(n / 2).cast("int") + 1
        nearest = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - centre).alias("d"), i.alias("i"))))["i"]
        return let(nearest, lambda i: F.when((n >= 4) & i.isNotNull(), _splice(x, at - 2 + i, F.lit(2), F.concat(F.substring(r, i + 1, F.lit(1)), F.substring(r, i, F.lit(1))))))

    return longest_run(x, swap)


def double_middle(x: Column) -> Column:
    """The longest run of three or more has its middle character twice, if there is room."""

    def double(r: Column, at: Column) -> Column:
        middle = F.floor(F.length(r) / 2).cast("int")
        return F.when((F.length(r) >= 3) & (F.length(x) < MAX_CHARS), _splice(x, at - 1 + middle, F.lit(0), F.substring(r, middle + 1, F.lit(1))))

    return longest_run(x, double)


FAMILIES = ("formatting", "typographic")
# Names, families and order of the suite.
SUITE: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("ascii-letter-case", "formatting", letter_case),
    ("horizontal-whitespace", "formatting", horizontal_white),
    ("unicode-compatibility-width", "formatting", full_width),
    ("terminal-punctuation", "formatting", terminal_mark),
    ("single-character-deletion", "typographic", delete_middle),
    ("adjacent-character-transposition", "typographic", swap_neighbours),
    ("single-character-duplication", "typographic", double_middle),
]
_added: list[tuple[str, str, Callable[[Column], Column]]] = []


def register(name: str, family: str, f: Callable[[Column], Column]) -> None:
    """Adds a perturbation to those of :func:`suite`: a text's variant, or null where it doesn't apply."""
    if family not in FAMILIES:
        raise ValueError(f"a perturbation is of {' or '.join(FAMILIES)}")
    if any(n == name for n, _, _ in suite()):
        raise ValueError(f"there is a perturbation {name} already")
    _added.append((name, family, f))


def unregister(name: str) -> None:
    """Takes a registered perturbation out again; the fixed ones stay."""
    _added[:] = [x for x in _added if x[0] != name]


def suite() -> list[tuple[str, str, Callable[[Column], Column]]]:
    """The fixed perturbations and the registered ones."""
    return [*SUITE, *_added]
