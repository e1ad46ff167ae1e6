"""Scalar functions against hand-worked values."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantmill.functions import columns as C


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_years(spark):
    assert values(spark, C.process_year("x"), ["20050101", "nan", None, "", "1999", "abcd"]) == [2005, None, None, None, 1999, None]


def test_country_chain(spark):
    rows = [(None, None, None), ("DEX", "FR", None), (None, "FR", "US"), (None, None, "GBX"), ("NA", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r[0] for r in df.select(C.consolidate_country("a", "b", "c")).collect()] == ["US", "DE", "FR", "GB", "NA"]


def test_doc_ids(spark):
    assert values(spark, C.normalise_doc_id("x"), ["0012345", "12345.0", "D0123", "10.05", None, "000"]) == ["12345", "12345", "D0123", "10.05", None, ""]


def test_tokens_and_levels(spark):
    assert values(spark, C.first_token("x"), ["a|b|c", "abc", None]) == ["a", "abc", None]
    assert values(spark, C.first_level("x"), ["a||b", "abc", None]) == ["a", "", ""]
    assert values(spark, C.level_of("x"), ["Energy", ".Solar", "..Cells"]) == [0, 1, 2]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("US 48197R", [("004", "8197R"), ("048", "197R"), ("481", "97R")]),
        ("US  48197R", [("048", "197R")]),
        ("US D 1130", [("D01", "130")]),
        ("US 333 21 R", [("333", "21"), ("333", "21R")]),
        ("US 358  11-  118", [("358", "11"), ("358", "11-118")]),
        ("US 424514", [("004", "24514"), ("042", "4514"), ("424", "514")]),
        ("US 44 589", [("044", "589")]),
        ("US PLT263", [("PLT", "263")]),
    ],
)
def test_uspc_candidates(spark, raw, expected):
    got = [tuple(c) for c in values(spark, C.uspc_candidates("x"), [raw])[0]]
    assert got == expected


def test_uspc_candidates_of_nothing(spark):
    assert values(spark, C.uspc_candidates("x"), ["", "US", None]) == [None, None, None]


def test_ipc_codes(spark):
    rows = ["H04L 9/20 [2006_x];G01N 1/00", "A01B 12345/1234567", "A01B", "", None, "H04L 9"]
    assert values(spark, C.ipc_code("x"), rows) == ["H04L0009200000", "A01B123451234567", None, None, None, None]


def test_keyword_cleaning():
    keys = ["wind (power) x", "solar (pv)", "plain"]
    assert C.clean_keywords(keys) == ["wind x", "solar", "plain"]
    assert C.clean_keywords(keys, compat=True) == ["wind ", "solar ", "plain"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab .é\n\\E", max_size=30), min_size=1, max_size=5))
def test_hits_agree_with_python(spark, texts):
    keys = ["a", "ab", "é", r"b\E", "a.b"]
    rex = re.compile("|".join(r"\b" + re.escape(k) + r"\b" for k in keys), re.I)
    got = [[*r] for r in values(spark, C.hits("x", C.keyword_pattern(keys)), texts)]
    assert got == [[m.group() for m in rex.finditer(t)] for t in texts]


def test_glue_and_counts(spark):
    df = spark.createDataFrame([(["solar", "cell"], None), (None, ["a\r\nb"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(C.glue_sections("a", "b")).collect()] == ["solarcell", "ab", ""]
    assert [r[0] for r in df.select(C.glue_sections("a", "b", blank=True)).collect()][0].split() == ["solar", "cell"]
    counts = spark.createDataFrame([(["a", "A", "a"],), ([],)], "h array<string>").select(C.hit_counts(F.col("h")))
    assert [r[0] for r in counts.collect()] == [{"a": 2, "A": 1}, {}]
    assert [r[0] for r in spark.createDataFrame([({"API": 3},), ({},)], "m map<string,int>").select(C.hits_of("m", "API")).collect()] == [3, 0]


def test_names(spark):
    rows = ["ACME COMPANY, INC.", "LTD", "BASF (EUROPE) GMBH", "FOO, ,", None]
    assert values(spark, C.clean_name_with_fallback("x"), rows) == ["ACME", "LTD", "BASF", "FOO", None]
    assert values(spark, C.generic_free_name("x"), ["BANK OF AMERICA", "SOFTWARE GROUP"]) == ["", "STWARE"]


def test_keywords_of_a_column_are_cleaned_like_a_list(spark):
    keys = ["wind", "solar (PV) cell", "tide power (sea)", "open (end", "(a) b", "a(b)c(d)e", "()", "", " x ", "two\nlines (a\nb) end", "a ) b"]
    got = spark.createDataFrame([*enumerate(keys)], "k int, key string").orderBy("k").select(C.clean_keyword("key")).collect()
    assert [r[0] for r in got] == C.clean_keywords(keys)
