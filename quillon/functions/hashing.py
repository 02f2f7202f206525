"""Randomness that depends on a row's key alone, so any partitioning draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits of a text as a number."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("double")


def group_hash(text: Column, seed: int = 42) -> Column:
    """In [0, 1): twelve hex digits of sha256(seed:text)."""
    return hex_number(F.sha2(F.concat_ws(":", F.lit(str(seed)), text), 256), 12) / float(16**12)


def assign_split(group: Column, held_out_test: bool = True, seed: int = 42) -> Column:
    """train, dev, calibration and test at 85/5/5/5, or without test at 90/5/5."""
    u = group_hash(group, seed)
    if held_out_test:
        return F.when(u < 0.85, "train").when(u < 0.90, "dev").when(u < 0.95, "calibration").otherwise("test")
    return F.when(u < 0.90, "train").when(u < 0.95, "dev").otherwise("calibration")


def coin(key: Column, share: float, salt: str = "pick") -> Column:
    """True for about that share of keys: eight hex digits of sha256 over 2^32."""
    return hex_number(F.sha2(F.concat_ws("|", F.lit(salt), F.lit(str(share)), key), 256), 8) / float(2**32) < share


def h100(text: Column) -> Column:
    """The whole sha256 as a number, modulo 100, folded digit by digit."""
    digits = F.split(F.sha2(text, 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: F.pmod(a * 16 + F.conv(d, 16, 10).cast("int"), F.lit(100)))


def pick_instruction(bank: Column, key: Column, split: Column) -> Column:
    """An entry of bank by sha1 of the key for training rows, the first one for others."""
    at = F.pmod(hex_number(F.sha1(key), 8).cast("long"), F.size(bank).cast("long")).cast("int")
    return F.element_at(bank, F.when(split == "train", at).otherwise(0) + 1)


def draw(modulus: int | Column, *parts: Column) -> Column:
    """A number below modulus from seven hex digits of md5 over the parts."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 7), 16, 10).cast("long"), F.lit(modulus) if isinstance(modulus, int) else modulus.cast("long"))
