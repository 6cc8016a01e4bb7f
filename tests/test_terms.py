"""Glossary terms in texts by automata, against looking for each term in each text."""

import random

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import terms

T_SCHEMA, G_SCHEMA = "id int, text string, row string, part int", "pos int, korean string, preferred string, note string"


def brute(texts, glossary):
    return sorted((*t, *g) for t in texts for g in glossary if t[1] is not None and g[1] and g[2] and g[2].strip() and g[1] in t[1])


@pytest.mark.parametrize("way", ["few", "broadcast", "parts", "single letters"])
def test_every_way(spark, way, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abㄱ가🙂 ") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60)), "r", 1) for i in range(150)] + [(900, None, "r", 2), (900, "", "r", 2), (901, "ab" * 40_000, None, None), (7, "ab a", "r", 3), (7, "ab a", "r", 3)]
    glossary = [(i, word(rng.randint(1, 5)), rng.choice(["x", "y", "", " ", None]), "n") for i in range(60)] + [(100, "a", "one", None), (101, "ab", "two", None), (102, "ab", "again", None), (103, "", "empty", None), (104, None, "null", None), (105, "b" * 50, "long", None)]
    if way == "few":
        monkeypatch.setattr(terms, "FEW", 10**6)
    got = terms.term_rows(spark.createDataFrame(texts, T_SCHEMA).repartition(5), spark.createDataFrame(glossary, G_SCHEMA), part={"parts": 20, "single letters": 1}.get(way, terms.PART) if way != "few" else terms.PART)
    assert got.columns == ["id", "text", "row", "part", "pos", "korean", "preferred", "note"]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(texts, glossary), key=key)


def test_empty_tables(spark):
    texts, glossary = spark.createDataFrame([(1, "a b", "r", 1)], T_SCHEMA), spark.createDataFrame([(1, "a", "x", None)] * 2, G_SCHEMA)
    for part in (terms.PART, 1):
        assert terms.term_rows(texts.filter(F.lit(False)), glossary, part=part).count() == 0
        assert terms.term_rows(texts, glossary.filter(F.lit(False)), part=part).count() == 0
        assert terms.term_rows(texts, glossary, part=part).count() == 2


def test_no_text_is_read_more_than_once_by_an_automaton():
    """Cost goes with text and hits: a term that is within many others is found with them in one pass."""
    a = terms.automaton(["a" * k for k in range(1, 200)])
    assert terms.found_in(a, "b" + "a" * 300) == ["a" * k for k in range(1, 200)]
    assert terms.found_in(a, None) == terms.found_in(a, "") == [] and terms.found_in(terms.automaton([]), "x") == []
