"""SIDs of one domain whose last arcs meet in 32 bits, which tables of the registered queries' size at sf0.1 don't have."""

import os

import __spark_entry__ as entry
import pandas as pd
import pytest
from test_queries import rows

from veilgraph.catalogue import SALT
from veilgraph.functions import pseudonyms
from veilgraph.operators import mapping
from veilgraph.plans import job

HOME = "S-1-5-21-1000006-2000006-3000006"
#: Two pairs of customers of nation 6 whose SIDs get the same last arc under SALT.
PAIRS = ((247098, 313205), (34426, 122750))


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """sf0.001 with these four customers, an order each."""
    root = tmp_path_factory.mktemp("shared")
    for name in ("nation", "supplier", "customer", "orders"):
        own = pd.read_parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "customer":
            more = own.head(4).assign(c_custkey=[k for p in PAIRS for k in p], c_nationkey=own.c_nationkey.dtype.type(6))
            own = pd.concat([own, more])
        if name == "orders":
            own = pd.concat([own, own.head(4).assign(o_custkey=[k for p in PAIRS for k in p])])
        own.to_parquet(root / f"{name}.parquet", coerce_timestamps="us")
    return root


def sql(tables, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(tables):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{t}'")
    return rows(con.execute(entry.oracle_sql()[name]).df())


def test_the_pairs_meet():
    for p in PAIRS:
        assert len({pseudonyms.arc(SALT, f"{HOME}-{k + 1100}") for k in p}) == 1


def test_anonymize_graph(spark, tables):
    docs = entry.queries()["anonymize_graph"](spark, f"file://{tables}").toPandas()
    sids = docs.body.str.extractall(r'"ObjectIdentifier": "([^"]+)"')[0]
    assert len(sids) == sids.nunique() == len(pd.read_parquet(tables / "customer.parquet")) + len(pd.read_parquet(tables / "supplier.parquet")) + 25


@pytest.mark.parametrize("name", ["anonymize_published", "edge_preservation", "verify_each_code", "verify_tampered", "verify_full_outer"])
def test_query_equals_sql_where_arcs_meet(spark, tables, name):
    assert rows(entry.queries()[name](spark, f"file://{tables}").toPandas()) == sql(tables, name)


def settled(spark, sids, owned=None):
    values = spark.createDataFrame([("sid", s, None, False) for s in sids], "form string, token string, arg string, keep boolean")
    got = mapping.settled(values, SALT, owned or {}, job.frozen)
    reg = mapping.registry(mapping.identities(got))
    assert mapping.problems(reg).isEmpty() and mapping.hierarchy_faults(reg).isEmpty()
    return {r.token: r.output for r in got.collect()}


def test_one_of_each_pair_stays(spark):
    pairs = [[f"{HOME}-{k + 1100}" for k in sorted(p, key=lambda k: str(k + 1100))] for p in PAIRS]
    plain = settled(spark, [p[0] for p in pairs])
    every = [s for p in pairs for s in p] + [f"{s}-7" for s in pairs[0]]
    got = settled(spark, every)
    assert got == settled(spark, every[::-1]) and len(set(got.values())) == len(got)
    for a, b in pairs:
        home, _, arc = got[a].rpartition("-")
        assert got[a] == plain[a] and got[b] == f"{home}-{int(arc) + 1}"
    for s in pairs[0]:
        assert got[f"{s}-7"].rpartition("-")[0] == got[s]


def test_a_reused_mapping_stays_and_taken_arcs_are_passed_over(spark):
    a, b = (f"{HOME}-{k + 1100}" for k in PAIRS[0])
    home, _, arc = settled(spark, [b])[b].rpartition("-")
    saved = {("sids", b.lower()): f"{home}-{arc}"} | {("sids", f"{HOME.lower()}-{9000 + n}"): f"{home}-{int(arc) + n}" for n in range(1, 20)}
    assert settled(spark, [a, b], saved) == {a: f"{home}-{int(arc) + 20}", b: f"{home}-{arc}"}


def test_arcs_after_the_last_begin_anew():
    assert pseudonyms.next_arc(str((1 << 32) - 1)) == str(pseudonyms.FIRST_ARC) and pseudonyms.next_arc("1000000") == "1000001"


@pytest.mark.parametrize("name", ["verify_each_code", "verify_tampered"])
def test_source_and_output_are_compared_once(spark, tables, monkeypatch, name):
    """The joined table is written, not worked out anew by each gate that reads it."""
    tags, plain = [], job.frozen
    monkeypatch.setattr(job, "frozen", lambda df, tag: tags.append(tag) or plain(df, tag))
    entry.queries()[name](spark, f"file://{tables}")
    assert tags.count("compared") == 1
