"""File mode bits as BIGINT columns: type tests and the text form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: The mode bit of every type and flag, with its letter, in the order in which the text form lists them.
MODE_BITS = [
    ("d", 31), ("a", 30), ("l", 29), ("T", 28), ("L", 27), ("D", 26), ("p", 25), ("S", 24),
    ("u", 23), ("g", 22), ("c", 21), ("t", 20), ("?", 19),
]

DIR, SYMLINK, DEVICE, PIPE, SOCKET, CHAR_DEVICE, IRREGULAR = (1 << b for b in (31, 27, 26, 25, 24, 21, 19))
#: What makes an entry something else than a regular file.
TYPE_MASK = DIR | SYMLINK | PIPE | SOCKET | DEVICE | CHAR_DEVICE | IRREGULAR


def has_bits(mode: Column, mask: int) -> Column:
    return mode.bitwiseAND(F.lit(mask).cast("long")) != 0


def is_dir(mode: Column) -> Column:
    return has_bits(mode, DIR)


def is_file(mode: Column) -> Column:
    """No type bit at all: links, pipes, sockets and devices are neither files nor directories."""
    return mode.bitwiseAND(F.lit(TYPE_MASK).cast("long")) == 0


def mode_string(mode: Column) -> Column:
    """Like drwxr-xr-x: the letters of the set bits, or a dash, then nine permission letters."""
    letters = F.concat(*[F.when(has_bits(mode, 1 << bit), letter).otherwise("") for letter, bit in MODE_BITS])
    head = F.when(letters == "", "-").otherwise(letters)
    return F.concat(head, *[F.when(has_bits(mode, 1 << (8 - i)), "rwxrwxrwx"[i]).otherwise("-") for i in range(9)])


def all_of(conditions: list[Column], empty: bool = True) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(empty)


def any_of(conditions: list[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(empty)
