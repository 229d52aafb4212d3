"""Content-addressed ids over canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_PREFIX = "ev"


def _lower_escapes(text: Column) -> Column:
    """Spark writes control characters as upper-case hex escapes; canonical JSON wants lower case.

    An even run of backslashes before the escape keeps a literal backslash apart from an escape. The
    text is bound once, as the item of a one-row array, so that its JSON is not spelled out again for
    every use.
    """
    codes = F.array(*(F.lit(f"{code:04X}") for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))))

    def lowered(json: Column) -> Column:
        one = lambda done, code: F.regexp_replace(done, F.concat(F.lit(r"(?<!\\)((?:\\\\)*)\\u"), code), F.concat(F.lit(r"$1\\u"), F.lower(code)))
        return F.when(json.contains("\\u00"), F.aggregate(codes, json, one)).otherwise(json)

    return F.element_at(F.transform(F.array(text), lowered), 1)


def canonical_json(fields: Mapping[str, Column], keep_nulls: bool = False) -> Column:
    """JSON object with sorted keys and no spaces. Values: strings, integers, arrays, structs."""
    body = F.struct(*(fields[name].alias(name) for name in sorted(fields)))
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return _lower_escapes(F.to_json(body, options))


def evidence_id(kind: str, fields: Mapping[str, Column], prefix: str = ID_PREFIX) -> Column:
    """``prefix:kind:sha256:hex`` of the record without its id; absent fields stay absent."""
    return F.concat(F.lit(f"{prefix}:{kind}:sha256:"), F.sha2(canonical_json(fields), 256))


def formulation_hash(ingredients: Column, allergens: Column, traces: Column) -> Column:
    """Hash of the exact formulation text; here explicit nulls are part of the hash."""
    fields = {"ingredientsText": ingredients, "allergensText": allergens, "tracesText": traces}
    return F.sha2(canonical_json(fields, keep_nulls=True), 256)
