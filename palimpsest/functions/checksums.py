"""Check digits of Chinese identity numbers (GB 11643) and unified credit codes (GB 32100), as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet of GB 32100.
CREDIT_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
FULL_WIDTH, DIGITS = "".join(chr(0xFF10 + i) for i in range(10)), "0123456789"


def id_check_char(body: Column) -> Column:
    """The check character of the first 17 digits; weights are powers of two modulo 11."""
    body = F.translate(body, FULL_WIDTH, DIGITS)
    total = sum(F.substring(body, i + 1, 1).try_cast("int") * (2 ** (17 - i) % 11) for i in range(17))
    return F.substring(F.lit("10X98765432"), (total % 11).cast("int") + 1, F.lit(1))


def id_valid(value: Column) -> Column:
    return F.coalesce((F.length(value) == 18) & (id_check_char(value) == F.upper(F.substring(F.translate(value, FULL_WIDTH, DIGITS), 18, 1))), F.lit(False))


def credit_check_char(body: Column) -> Column:
    """The check character of the first 17 signs; weights are powers of three modulo 31. Null for signs outside the alphabet."""
    places = [F.instr(F.lit(CREDIT_ALPHABET), F.substring(body, i + 1, 1)) for i in range(17)]
    known = F.array_min(F.array(*places)) > 0
    total = sum((p - 1) * (3**i % 31) for i, p in enumerate(places))
    return F.when(known & (F.length(body) >= 17), F.substring(F.lit(CREDIT_ALPHABET), ((F.lit(31) - total % 31) % 31).cast("int") + 1, F.lit(1)))


def credit_valid(value: Column) -> Column:
    return F.coalesce((F.length(value) == 18) & (credit_check_char(value) == F.substring(value, 18, 1)), F.lit(False))


CHECKS = {"id_checksum": id_valid, "uscc_checksum": credit_valid}
