"""Small functions over names, passwords, errors and figures."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from strongroom.model import MAGIC

# Error codes of the wire format and the classes of a password's characters.
ERRORS = {
    "UNSPECIFIED": 0, "WRONG_PASSWORD": 1, "NOT_FOUND": 2, "ALREADY_EXISTS": 3, "CRYPTO": 4,
    "IO": 5, "KDF": 6, "METADATA_TOO_LARGE": 7, "INVALID_ARGUMENT": 8, "INTERNAL": 9,
}
UPPER, LOWER, DIGITS, SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!@#$%^&*()_=+[]{};:,.<>?"
MEMORY = ("128", "256", "512")


def basename(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "[^/]*$", 0)


def portable(path: Column, root: Column) -> Column:
    """The path below root with forward slashes; a path elsewhere stays."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.replace(root, F.lit("\\"), F.lit("/"))
    inside = F.startswith(p, F.concat(r, F.lit("/")))
    return F.when(inside, F.substring(p, F.char_length(r) + 2, F.char_length(p))).otherwise(p)


def password_classes(password: Column) -> Column:
    """struct<upper, lower, digit, symbol>: which classes occur."""
    kinds = (("upper", "[A-Z]"), ("lower", "[a-z]"), ("digit", "[0-9]"), ("symbol", "[^A-Za-z0-9-]"))
    return F.struct(*(F.coalesce(password.rlike(pattern), F.lit(False)).alias(name) for name, pattern in kinds))


def is_grouped(password: Column) -> Column:
    """Whether a text is five groups of five with hyphens between."""
    return F.coalesce((F.char_length(password) == 29) & password.rlike("^[^-]{5}(-[^-]{5}){4}$"), F.lit(False))


def memory_mib(text: Column) -> Column:
    """128, 256 or 512; null for anything else."""
    return F.when(text.isin(*MEMORY), text.cast("int"))


def memory_mib_or_fail(text: Column) -> Column:
    """128, 256 or 512; anything else fails the query."""
    return F.when(text.isin(*MEMORY), text.cast("int")).otherwise(F.raise_error(F.concat(F.lit("memory is 128, 256 or 512 MiB, not "), F.coalesce(text, F.lit("null")))).cast("int"))


def error_code(kind: Column, opening: Column) -> Column:
    """The wire code of a kind of ERRORS; what doesn't authenticate while opening means a wrong password, an unknown kind is internal."""
    code = F.element_at(F.create_map(*(F.lit(x) for item in ERRORS.items() for x in item)), kind)
    return F.when(opening & (kind == "CRYPTO"), F.lit(ERRORS["WRONG_PASSWORD"])).otherwise(F.coalesce(code, F.lit(ERRORS["INTERNAL"])))


def has_magic(content: Column) -> Column:
    """Whether bytes begin as a container does."""
    return F.coalesce(F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC), F.lit(False))


def seconds_or_null(seconds: Column) -> Column:
    """Seconds since 1970; zero or less is unknown."""
    return F.when(seconds > 0, seconds)


def percent(ratio: Column) -> Column:
    return F.concat(F.format_string("%.1f", ratio * 100), F.lit("%"))


def generate_password(length: int = 25) -> str:
    """Random; with four characters or more every class occurs."""
    rng = secrets.SystemRandom()
    own = [rng.choice(c) for c in (UPPER, LOWER, DIGITS, SYMBOLS)][:length]
    own += rng.choices(UPPER + LOWER + DIGITS + SYMBOLS, k=max(0, length - len(own)))
    rng.shuffle(own)
    return "".join(own)


def generate_grouped_password() -> str:
    p = generate_password(25)
    return "-".join(p[k : k + 5] for k in range(0, 25, 5))
