"""Barcode expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.stage import once


def _balanced_sum(terms: list[Column]) -> Column:
    """Sum as a shallow tree: a long chain nests too deep for the code generator."""
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return _balanced_sum(terms[:half]) + _balanced_sum(terms[half:])


def check_digit_ok(code: Column) -> Column:
    """True when the weighted digit sum, check digit included, is a multiple of ten.

    The k-th digit from the right equals ``code div 10^k`` modulo ten, so the sum needs no digit
    extraction; leading zeros do not matter, and one formula serves 8, 12, 13 and 14 digits.
    """
    number = code.try_cast("bigint")
    terms = [number] + [
        F.call_function("div", number, F.lit(10**k)) * F.lit(3 if k % 2 else 1) for k in range(1, 14)
    ]
    return _balanced_sum(terms) % 10 == 0


def gtin14(code: Column) -> Column:
    """Strict GTIN-8/12/13/14 to GTIN-14, else null. No trimming."""
    shaped = code.rlike(r"\A(?:[0-9]{8}|[0-9]{12,14})\z")
    return F.when(shaped & check_digit_ok(code), F.lpad(code, 14, "0"))


def trimmed(code: Column) -> Column:
    return F.regexp_replace(code, r"\A\s+|\s+\z", "")


def gtin14_trimmed(code: Column) -> Column:
    """The price export's variant: surrounding white space is dropped first."""
    return gtin14(trimmed(code))


def upce_to_upca(code: Column) -> Column:
    """Expand an 8-digit UPC-E (number system 0 or 1) to 12 digits; the 6th symbol picks the layout."""
    ns, check = F.substring(code, 1, 1), F.substring(code, 8, 1)
    d1, d2, d3, d4, d5, d6 = (F.substring(code, i, 1) for i in range(2, 8))
    body = (
        F.when(d6.isin("0", "1", "2"), F.concat(ns, d1, d2, d6, F.lit("0000"), d3, d4, d5))
        .when(d6 == "3", F.concat(ns, d1, d2, d3, F.lit("00000"), d4, d5))
        .when(d6 == "4", F.concat(ns, d1, d2, d3, d4, F.lit("00000"), d5))
        .otherwise(F.concat(ns, d1, d2, d3, d4, d5, F.lit("0000"), d6))
    )
    return F.when(ns.isin("0", "1"), F.concat(body, check))


def retail_digits(candidate: Column) -> Column:
    """Drop white space and hyphens from a typed or scanned code."""
    return F.regexp_replace(candidate, r"[\s\p{Z}-]", "")


def with_retail_barcode(df: DataFrame, candidate: Column, symbology: Column, gtin: str = "gtin", error: str = "error") -> DataFrame:
    """Add the GTIN-14 of a typed or scanned code and its error class; exactly one of them is non-null."""
    d, plain, expanded = F.col("_digits"), F.col("_plain"), F.col("_expanded")
    staged = once(df, _digits=retail_digits(candidate))
    staged = once(staged, _upca=F.when(d.rlike(r"\A[0-9]{8}\z"), upce_to_upca(d)))
    staged = once(staged, _plain=gtin14(d), _expanded=gtin14(F.col("_upca")))
    eight = F.length(d) == 8
    value = F.when(eight & (symbology == "upce"), expanded).when(eight, F.coalesce(plain, expanded)).otherwise(plain)
    kind = (
        F.when(F.coalesce(d, F.lit("")) == "", "empty")
        .when(~d.rlike(r"\A[0-9]+\z"), "unsupported-characters")
        .when(~F.length(d).isin(8, 12, 13, 14), "unsupported-length")
        .when(F.col(gtin).isNull(), "invalid-check-digit")
    )
    return once(staged, **{gtin: value}).withColumn(error, kind).drop("_digits", "_upca", "_plain", "_expanded")


def gs1_candidate(payload: Column) -> Column:
    """GTIN text inside a GS1 digital link or element string, not yet validated."""
    query = F.regexp_extract(payload, r"[?&]01=([^&#]*)", 1)
    path = F.regexp_extract(payload, r"(?s)/01/(.{14})", 1)
    element = F.regexp_extract(payload, r"(?s)\A(?:\(01\)|\]C101)(.{14})", 1)
    return F.when(F.length(query) == 14, query).when(path != "", path).when(element != "", element)


def aliases(gtin: Column) -> Column:
    """Display forms of a GTIN-14: itself plus 13, 12 and 8 digits where the zeros allow."""
    forms = [gtin] + [
        F.when(gtin.startswith("0" * (14 - width)), F.substring(gtin, 15 - width, width)) for width in (13, 12, 8)
    ]
    return F.array_compact(F.array(*forms))


def hash_bucket(key: Column, buckets: int) -> Column:
    """Stable shard: the first 8 sha-256 bytes, big endian and unsigned, modulo the bucket count."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(buckets).cast("decimal(20,0)")).cast("int")
