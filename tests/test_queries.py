import math
import re

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("" if x is None or isinstance(x, float) and math.isnan(x) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scrub_word_boundary_on_every_text(spark, tmp_path):
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    odd = ["éthe theé the", "the\u0301 _the the_ THE", "日of本 of日", "ßand andß and1", "quéque Der\u00a0der", "İthe KTHE", "", None]
    texts = pd.concat([docs, pd.DataFrame({"doc_id": range(10**9, 10**9 + len(odd)), "text": odd})])
    texts.to_parquet(tmp_path / "documents.parquet")
    got = entry.queries()["scrub_word_boundary"](spark, f"file://{tmp_path}").toPandas()
    word = re.compile(r"(?<![A-Za-z0-9_])(?:the|of|and|que|der)(?![A-Za-z0-9_])", re.I | re.A)
    want = {i: len(word.findall(t or "")) for i, t in zip(texts.doc_id, texts.text)}
    assert len(got) == len(texts) and dict(zip(got.doc_id, got.n)) == want and docs.text.str.contains(r"[^\x00-\x7f]").any()
