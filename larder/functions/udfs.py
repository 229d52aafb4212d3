"""The few functions Spark has no expression for, as Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def format_g(values: pd.Series) -> pd.Series:
    """Shortest general number text (six significant digits, no trailing zeros)."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:g}")


class _Fold(dict):
    """Translation table filled on demand: base letters and digits in lower case, anything else a space.

    ``uneven`` gathers the characters whose folded form is not exactly one character.
    """

    def __init__(self) -> None:
        super().__init__()
        self.uneven: set[str] = set()

    def __missing__(self, code: int) -> str:
        base = (c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        folded = "".join(f if f.isalnum() else " " for c in base for f in c.casefold())
        if len(folded) != 1:
            self.uneven.add(chr(code))
        self[code] = folded
        return folded


_FOLD = _Fold()


def fold_with_offsets(source: str) -> tuple[str, np.ndarray]:
    """Folded text and, per folded character, the position of its source character (code points)."""
    joined = source.translate(_FOLD)
    if _FOLD.uneven.isdisjoint(source):
        origin = np.arange(len(joined))
    else:
        origin = np.repeat(np.arange(len(source)), [len(_FOLD[ord(c)]) for c in source])
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = chars == 32
    # One space per run of blanks, none at the ends.
    keep = _kept(blank)
    return chars[keep].tobytes().decode("utf-32-le", "surrogatepass"), origin[keep]


def _kept(blank: np.ndarray) -> np.ndarray:
    """Positions that stay when runs of blanks shrink to one and the ends are trimmed."""
    letters = np.flatnonzero(~blank)
    if not letters.size:
        return letters
    inner = np.arange(letters[0], letters[-1] + 1)
    repeated = blank & np.concatenate(([False], blank[:-1]))
    return inner[~repeated[inner]]


FOLDED = T.StructType(
    [T.StructField("norm", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))]
)


@F.arrow_udf(FOLDED)
def fold_text(texts: pa.Array) -> pa.Array:
    """Folded texts of a batch; their offsets stand in one buffer of four bytes a character, not as an object a row."""
    norms, places, widths = [], [], []
    for value in texts:
        source = value.as_py()
        norm, origin = fold_with_offsets(source) if source is not None else (None, np.empty(0))
        norms.append(norm)
        places.append(origin.astype(np.int32).tobytes())
        widths.append(len(origin))
    ends = np.concatenate(([0], np.cumsum(widths, dtype=np.int64))).astype(np.int32)
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(places))])
    absent = pa.array([n is None for n in norms], pa.bool_())
    offsets = pa.ListArray.from_arrays(pa.array(ends), flat, mask=absent)
    return pa.StructArray.from_arrays([pa.array(norms, pa.string()), offsets], fields=[pa.field("norm", pa.string()), pa.field("offsets", offsets.type)])
