import hashlib
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, size long, carried string"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source); the further columns clash with names that operators use."""

    def build(*docs):
        full = [(d[0], d[1], "en", d[2] if len(d) > 2 else "s", len(d[1] or ""), "k", 7, 8, "c") for d in docs]
        return spark.createDataFrame(full, COLUMNS).repartition(3)

    return build


@pytest.fixture
def items(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "item_id long, text string")


@pytest.fixture
def labels(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
