"""Documents without letters, with control characters and with rare spaces, against the SQL of their queries."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry

BLANK = ["", None, " ", "\t\n", "!!!", "...\n", "\x01", "Käse, ß!", "a" * 600, "é" * 511 + "  b"]


def compare(spark, folder, name, texts):
    rows = [(n, t, "en", "web", len(t or "")) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"select * from ({entry.oracle_sql()[name]}) w order by cast(doc_id as bigint)")
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(folder)).orderBy(F.col("doc_id").cast("bigint")).select(*columns).collect()
    assert [tuple(r) for r in got] == want.fetchall()


def test_texts_without_letters_are_folded(spark, tmp_path):
    compare(spark, tmp_path, "fold_text_with_offsets", BLANK)


def test_texts_are_cleaned_as_in_the_sql(spark, tmp_path):
    rare = ["\x1b[31mred\x1b[0m", "\u3000x\u2003\u2003y\u3000", "\u00a0\u00a0x\u00a0", "a\u0085b", "\x1c q\x1d \x7f", "\u200b\u2028", "x" * 159 + " \u2003 y"]
    compare(spark, tmp_path, "clean_text", BLANK + rare)
