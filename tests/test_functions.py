import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions import barcodes, clock, ids, text
from larder.functions.udfs import fold_with_offsets


def frame(spark, values, ddl="v string"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def with_check(body: str) -> str:
    total = sum(int(d) * (3 if i % 2 == 0 else 1) for i, d in enumerate(reversed(body)))
    return body + str((10 - total % 10) % 10)


def test_gtin14_forms_and_rejections(spark):
    good = [with_check(b) for b in ("1234567", "03600029145", "400638133393", "1001234567890")]
    bad = ["", "abc", good[1] + "\n", " " + good[1], good[0][:-1] + str((int(good[0][-1]) + 1) % 10), "123456789"]
    got = column(frame(spark, good + bad + [None]), barcodes.gtin14(F.col("v")))
    assert got == [g.zfill(14) for g in good] + [None] * (len(bad) + 1)


def test_trimmed_gtin_keeps_the_strict_rules(spark):
    good = with_check("400638133393")
    assert column(frame(spark, [f" {good}\n", f"{good[:4]} {good[4:]}"]), barcodes.gtin14_trimmed(F.col("v"))) == [good.zfill(14), None]


@pytest.mark.parametrize(
    "upce,upca", [("04252614", "042100005264"), ("01234133", "012300000413"), ("01278906", "012000007896")]
)
def test_upce_expansion_by_sixth_symbol(spark, upce, upca):
    assert column(frame(spark, [upce]), barcodes.upce_to_upca(F.col("v"))) == [upca]


def test_retail_barcode_errors(spark):
    good = with_check("400638133393")
    df = barcodes.with_retail_barcode(frame(spark, ["", "12a", "123", good[:3] + "-" + good[3:], good[:-1] + "x"]), F.col("v"), F.lit("unknown"))
    assert [(r.gtin, r.error) for r in df.collect()] == [
        (None, "empty"), (None, "unsupported-characters"), (None, "unsupported-length"), (good.zfill(14), None), (None, "unsupported-characters"),
    ]


def test_aliases_follow_leading_zeros(spark):
    assert column(frame(spark, ["00000012345670", "12345678901231"]), barcodes.aliases(F.col("v"))) == [
        ["00000012345670", "0000012345670", "000012345670", "12345670"], ["12345678901231"],
    ]


def test_hash_bucket_is_unsigned_big_endian(spark):
    keys = [f"{n:014d}" for n in range(50)]
    want = [int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") % 32 for k in keys]
    assert column(frame(spark, keys), barcodes.hash_bucket(F.col("v"), 32)) == want


def test_freshness_boundaries_and_month_ends(spark):
    c = clock.Clock(1, 3)
    at = F.lit("2024-02-29T00:00:00Z").cast("timestamp")
    anchors = ["2024-01-31T00:00:00Z", "2024-01-29T00:00:01Z", "2023-11-29T00:00:00Z", "2023-11-29T00:00:01Z", "2024-01-31", None]
    assert column(frame(spark, anchors), clock.freshness(F.col("v"), at, c)) == [
        "refresh-recommended", "fresh", "stale", "refresh-recommended", "date-unknown", "date-unknown",
    ]


def test_certificate_expiry_is_inclusive_here(spark):
    row = frame(spark, ["2024-01-01T00:00:00Z"])
    cert = {n: F.lit(None).cast("string") for n in ("revoked_at", "suspended_at", "effective_at")} | {
        "expiry_at": F.col("v"), "last_checked_at": F.col("v"),
    }
    at = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    assert column(row, clock.certificate_state(cert, at, None)) == ["active"]


def test_text_forms(spark):
    assert column(frame(spark, [" ALDI -- Süd ", "Groß.Markt", " -- "]), text.alias_key(F.col("v"))) == ["aldi süd", "gross markt", None]
    assert column(frame(spark, ["de:Markt 5!", "Straße 1"]), text.slug(F.col("v"))) == ["de-markt-5", "strasse-1"]
    assert column(frame(spark, ["=1", "  +1", "\tx", "a=b"]), text.csv_safe(F.col("v"))) == ["'=1", "'  +1", "'\tx", "a=b"]
    assert column(frame(spark, ["a@b.de", "see HTTP://x", "+49 170 1234567", "12345678", "fine"]), text.pii_like(F.col("v"))) == [
        True, True, True, False, False,
    ]


def test_canonical_json_matches_json_dumps(spark):
    samples = ["plain", 'quo"te', "back\\slash", "üé", "tab\tnl\n", "bell\u0007", "unit\u001f", "literal \\u001F text", "\\\u001f"]
    df = frame(spark, samples)
    got = column(df, ids.canonical_json({"b": F.col("v"), "a": F.array("v"), "none": F.lit(None).cast("string")}))
    assert got == [json.dumps({"a": [s], "b": s}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for s in samples]


def test_formulation_hash_keeps_nulls(spark):
    want = json.dumps({"allergensText": None, "ingredientsText": "x", "tracesText": "y"}, sort_keys=True, separators=(",", ":"))
    got = column(frame(spark, ["x"]), ids.formulation_hash(F.col("v"), F.lit(None).cast("string"), F.lit("y")))
    assert got == [hashlib.sha256(want.encode()).hexdigest()]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1 ß,éÄ́ﬁ\n-½Ω"), max_size=40))
def test_fold_offsets_point_at_their_source(source):
    norm, at = fold_with_offsets(source)
    assert len(norm) == len(at) and norm == norm.strip() and "  " not in norm
    for char, origin in zip(norm, at):
        assert char == " " or char in fold_with_offsets(source[origin])[0]


def test_years_past_9999_are_dates_up_to_the_last_timestamp(spark):
    now, months = F.lit("2001-11-05T12:00:00Z").cast("timestamp"), clock.Clock(9, 12)
    texts = ["9999-12-05T12:00:00Z", "12001-02-28T12:00:00Z", "102000-01-05T12:00:00Z", "294247-01-05T12:00:00Z", "600000-01-05T12:00:00Z", "1234567-01-05T12:00:00Z"]
    assert column(frame(spark, texts), clock.freshness(F.col("v"), now, months)) == ["fresh"] * 4 + ["date-unknown"] * 2
    assert column(frame(spark, texts), clock.plus_days(clock.instant(F.col("v")), 30) > now) == [True] * 4 + [None] * 2


def test_folding_a_batch_keeps_offsets_as_one_buffer_of_four_bytes():
    import pyarrow as pa
    from larder.functions.udfs import fold_text

    got = fold_text.func(pa.array(["Käse, ß", None, "", "ab"]))
    assert got.field("norm").to_pylist() == ["kase ss", None, "", "ab"]
    assert got.field("offsets").to_pylist() == [[0, 1, 2, 3, 4, 6, 6], None, [], [0, 1]]
    assert got.field("offsets").type.value_type == pa.int32()
