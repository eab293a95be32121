"""Scalar rules on contract text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version used when none fits, and the version that stands in for one that was never released.
DEFAULT_VERSION = "0.8.19"
UNRELEASED, STAND_IN = "0.5.25", "0.5.17"

#: What a line of compiler output must say for a repair to be tried.
SAYS_CONVERT = "not implicitly convertible"
SAYS_EXPLICIT = "Explicit type conversion not allowed"
SAYS_MEMORY = 'Data location must be "memory"'
SAYS_BYTES = 'This function only accepts a single "bytes" argument'
SAYS_VISIBILITY = "Visibility for constructor is ignored"


def clean_source(code: Column) -> Column:
    """One leading byte-order mark and control characters go, then line ends become line feeds."""
    marked = F.regexp_replace(code, "^﻿", "")
    return normalise_newlines(F.regexp_replace(marked, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x9F]", ""))


def normalise_newlines(code: Column) -> Column:
    """CRLF and CR become LF, before any position is counted."""
    return F.regexp_replace(code, r"\r\n?", "\n")


def pragma_spec(code: Column) -> Column:
    """The first solidity version pragma, trimmed; null if there is none."""
    regex = r"(?Ud)pragma\s+solidity\s+([^;]+);"
    spec = F.regexp_replace(F.regexp_extract(code, regex, 1), r"(?U)^\s+|\s+$", "")
    return F.when(code.rlike(regex), spec)


def version_request(spec: Column) -> tuple[Column, Column]:
    """(exact version, lowest allowed version) that a pragma asks for; both null if it says neither (T4).

    The unreleased version anywhere is the stand-in. A lower bound (>=, or > beside <) asks for the first such token.
    """
    plain = F.translate(spec, "^~", "")
    parts = F.split(plain, r"\s+")
    at_least = F.substring(F.try_element_at(F.filter(parts, lambda t: t.startswith(">=")), F.lit(1)), 3, 100)
    above = F.substring(F.try_element_at(F.filter(parts, lambda t: t.startswith(">") & ~t.startswith(">=")), F.lit(1)), 2, 100)
    dots = F.length(plain) - F.length(F.translate(plain, ".", ""))
    bounded = F.contains(plain, F.lit(">=")) | (F.contains(plain, F.lit(">")) & F.contains(plain, F.lit("<")))
    exact = (
        F.when(F.contains(spec, F.lit(UNRELEASED)), F.lit(STAND_IN))
        .when(bounded, F.lit(None).cast("string"))
        .when(dots == 2, F.trim(plain))
        .when(dots == 1, F.concat(F.trim(plain), F.lit(".0")))
    )
    low = F.when(F.contains(spec, F.lit(UNRELEASED)), F.lit(None).cast("string")).when(F.contains(plain, F.lit(">=")), at_least).when(bounded, above)
    return exact, low


def version_parts(version: Column) -> Column:
    """The numbers of a version; null if it isn't made of numbers and dots."""
    return F.when(version.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(version, r"\."), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int")))


def min_compatible(low: Column, versions: list[str]) -> Column:
    """The smallest of the versions that is not below `low`, in numeric order; the default if none is (T5)."""
    known = F.array(*[F.struct(F.array(*[F.lit(int(x)) for x in v.split(".")]).alias("parts"), F.lit(v).alias("version")) for v in versions])
    fits = F.filter(known, lambda v: v["parts"] >= version_parts(low))
    return F.coalesce(F.array_min(fits)["version"], F.lit(DEFAULT_VERSION))


def required_version(spec: Column, versions: list[str]) -> Column:
    """The compiler version for a pragma; null if the pragma can't be read (T4, T5)."""
    exact, low = version_request(spec)
    return F.coalesce(exact, F.when(low.isNotNull(), min_compatible(low, versions)))


def rewrite_pragma(code: Column) -> Column:
    """The unreleased version in the code becomes the stand-in."""
    return F.replace(code, F.lit(f"^{UNRELEASED}"), F.lit(f"^{STAND_IN}"))


def autofix_basic(code: Column, error: Column, version: Column) -> tuple[Column, Column]:
    """(code, fixed): repairs that a compiler message asks for.

    Address variables are repaired by whole names, each once; a name is a run of word characters.
    """
    says = lambda text: F.contains(error, F.lit(text))
    a = F.contains(code, F.lit("16.66")) & says(SAYS_CONVERT)
    one = F.when(a, F.replace(code, F.lit("* 16.66"), F.lit("* 1666 / 100"))).otherwise(code)
    b = F.contains(one, F.lit("uint8(keccak256")) & says(SAYS_EXPLICIT)
    two = F.when(b, F.regexp_replace(one, r"(?U)uint8\s*\(\s*keccak256", "uint8(uint256(keccak256")).otherwise(one)
    c = says(SAYS_MEMORY)
    memory = F.regexp_replace(F.regexp_replace(two, r"(?U)\(string\s+", "(string memory "), r"(?U),\s*string\s+", ", string memory ")
    three = F.when(c, memory).otherwise(two)
    names = F.array_distinct(F.regexp_extract_all(three, F.lit(r"(?U)(\w+)\.transfer\s*\("), F.lit(1)))
    d = says("transfer") & says("address payable") & (F.size(names) > 0)
    paid = F.aggregate(names, three, lambda acc, v: F.regexp_replace(acc, F.concat(F.lit(r"(?U)\baddress\s+"), v, F.lit(r"\b")), F.concat(F.lit("address payable "), v)))
    four = F.when(d, paid).otherwise(three)
    e = (version >= "0.7.0") & F.contains(four, F.lit("now"))
    five = F.when(e, F.regexp_replace(four, r"(?U)\bnow\b", "block.timestamp")).otherwise(four)
    return five, a | b | c | d | e


def autofix_enhanced(code: Column, error: Column, version: Column, fixed: Column) -> tuple[Column, Column]:
    """(code, fixed): further repairs, applied to the result of autofix_basic (T7). Constructors keep their arguments."""
    f = F.contains(error, F.lit(SAYS_BYTES))
    one = F.when(f, F.regexp_replace(code, r"(?U)keccak256\s*\(([^)]+,[^)]+)\)", "keccak256(abi.encodePacked($1))")).otherwise(code)
    g = F.contains(error, F.lit(SAYS_VISIBILITY))
    two = F.when(g, F.regexp_replace(one, r"(?U)constructor\s*(\([^)]*\))\s*(public|internal|private|external)", "constructor$1")).otherwise(one)
    modern = version >= "0.5.0"
    h = F.contains(two, F.lit("sha3")) & modern
    three = F.when(h, F.regexp_replace(two, r"(?U)\bsha3\b", "keccak256")).otherwise(two)
    i = F.contains(three, F.lit("throw")) & modern
    four = F.when(i, F.regexp_replace(three, r"(?U)\bthrow\b", "revert()")).otherwise(three)
    k = F.contains(four, F.lit("suicide"))
    five = F.when(k, F.regexp_replace(four, r"(?U)\bsuicide\b", "selfdestruct")).otherwise(four)
    return five, fixed | f | g | h | i | k


def line_number(code: str, position: str) -> Column:
    """The line of a 0-based position, from 1."""
    before = F.substring(F.col(code), F.lit(1), F.col(position))
    return F.length(before) - F.length(F.translate(before, "\n", "")) + 1


def risk_level(score: Column) -> Column:
    """critical, high, medium or low."""
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.4, "medium").otherwise("low")


def safe_str(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def safe_int(x: Column, default: int = 0) -> Column:
    """The whole number, or the default for null and what is none."""
    return F.coalesce(x.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def decode_bytes(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are no valid UTF-8 (S2). A byte-order mark stays: clean_source takes it."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
