import json

import pytest
from pyspark.sql import functions as F

from hearthline.operators import facts, issues


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Bad: fukt i membran", True), ("Kjeller ikke godkjent", True), ("ikke godkjent", True), ("Tak lekk", True), ("Tak fin", False), ("Tak er fint", True), ("badet er fint nå", False),
        ("Grunn og murer", True), ("Fin utsikt mot fjorden", False), ("  Kjøkken\t slitt ", True), ("bad fukt", True), ("bad sop", False), ("takß er fint", True), ("", False), ("   ", False), (None, False),
    ],
)
def test_specific_entry(spark, text, want):
    assert spark.range(1).select(issues.is_specific_entry(F.lit(text).cast("string"))).first()[0] is want


def run(spark, f, raw):
    text = raw if raw is None or isinstance(raw, str) else json.dumps(raw)
    return [tuple(r) for r in spark.createDataFrame([(text,)], "raw string").select(f(F.col("raw"))).first()[0]]


def test_saved_facts(spark):
    raw = [
        {"key": "b", "order": 20}, {"id": " c ", "name": "C", "order": "1 0,5", "amount": 1.5}, {"slug": "d", "label": " ", "value": None, "amount": 2}, {"label": "no key", "value": 1},
        {"key": 7, "id": "e", "value": {"x": [1]}, "group": " G "}, "text", None, [1], {"key": "f", "order": True, "value": True}, {"key": "g", "order": 2000, "displayValue": "x"},
    ]
    assert run(spark, facts.saved_facts, raw) == [
        ("c", "C", "1.5", None, 10.5), ("b", "b", None, None, 20.0), ("d", "d", None, None, None), ("e", "e", '{"x":[1]}', "G", None), ("f", "f", "true", None, None), ("g", "g", "x", None, 2000.0),
    ]


def test_saved_pairs(spark):
    raw = [{"label": "a", "value": "1", "order": "3"}, {"label": "b", "value": 2}, {"label": "c", "value": "x"}, {"label": " ", "value": "y", "order": " "}, {"label": "d", "value": "z", "order": 2.0}, {"label": "e", "value": ""}, 5]
    assert run(spark, facts.saved_pairs, raw) == [(" ", "y", 0.0), ("c", "x", 2.0), ("d", "z", 2.0), ("a", "1", 3.0)]


@pytest.mark.parametrize("raw", [None, "", "{", "{}", "7", "[]", "null", [None]])
@pytest.mark.parametrize("f", [facts.saved_facts, facts.saved_pairs])
def test_no_facts(spark, f, raw):
    assert run(spark, f, raw) == []
