"""Native operators stay off Python; large inputs are not shuffled where they need not be."""

import re

import pytest

from tessera.llm import chat, near_dup, packing, pii, quality, secrets
from tessera.llm.common import Scratch, table

TINY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [lambda s: pii.op3_pii(s, TINY), lambda s: chat.op6_chat_formatting(s, TINY), lambda s: secrets.op8_secret_scan(s, TINY)], ids=["op3", "op6", "op8"])
def test_native_plans_hold_no_python(spark, make):
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan(make(spark)))


def test_narrow_operators_do_not_shuffle(spark):
    docs = table(spark, TINY, "documents")
    assert "Exchange" not in plan(packing.pack(docs, packing.default_tokenizer()))
    assert "Exchange" not in plan(pii.pseudonymise(docs, "k"))
    model = quality.Model(quality.np.zeros(quality.STATISTICS), quality.np.ones(quality.STATISTICS), None)
    assert "Exchange" not in plan(quality.score_documents(docs, model))


def test_only_needed_columns_are_read(spark):
    docs = table(spark, TINY, "documents")
    for df in (packing.pack(docs, packing.default_tokenizer()), near_dup.sign(docs, 5, 25, 5, False), secrets.index(docs)):
        assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(df)), plan(df)[-500:]


def test_postings_are_intersected_in_compiled_code(spark):
    """No stage falls back to the interpreter because its code has grown too long."""
    docs = spark.createDataFrame([(1, "password = hunter22x"), (2, "no secret"), (3, "-----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string")
    lists = Scratch(spark, "t").put(secrets.postings(Scratch(spark, "t").put(secrets.index(docs))))
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert secrets.candidates(lists).count() == 3
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_clauses_say_what_a_query_says():
    query = ("or", frozenset({("and", frozenset({"abc", "bcd"})), "xyz", ("and", frozenset({"bcd", ("or", frozenset({"cde", "xyz"}))}))}))
    assert [sorted(c) for c in secrets.clauses(query)] == [["bcd", "xyz"], ["abc", "cde", "xyz"]]
    assert secrets.clauses("abc") == [frozenset({"abc"})]
