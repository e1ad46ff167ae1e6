"""JSON schemas: every keyword, references, numbers, what can't be applied."""

import pytest

from grantmill.llm import tool_calls
from grantmill.llm.schemas import loads, violations

TREE = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}, "required": ["v"], "additionalProperties": False}}}


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"properties": {"n": {"$ref": "#/$defs/i"}}, "$defs": {"i": {"type": "integer"}}}, [{"n": 1}, {}], [{"n": "no"}]),
        ({"definitions": {"a/b~": {"const": 1}}, "$ref": "#/definitions/a~1b~0"}, [1, 1.0], [2]),
        (TREE, [{"v": 1, "kids": [{"v": 2}, {"v": 3, "kids": []}]}], [{"v": 1, "kids": [{"v": "x"}]}, {"kids": []}, {"v": 1, "w": 2}]),
        ({"patternProperties": {"^s_": {"type": "string"}}, "additionalProperties": {"type": "integer"}}, [{"s_a": "x", "b": 1}], [{"s_a": 1}, {"b": "x"}]),
        ({"properties": {"s_a": {"minLength": 2}}, "patternProperties": {"^s_": {"maxLength": 3}}}, [{"s_a": "ab"}], [{"s_a": "a"}, {"s_a": "abcd"}]),
        ({"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False}, [["a", 1], ["a"], []], [[1], ["a", "b"], ["a", 1, 2]]),
        ({"items": [{"type": "string"}], "additionalItems": {"type": "integer"}}, [["a", 1, 2]], [["a", "b"]]),
        ({"contains": {"minimum": 5}}, [[1, 6]], [[1], []]),
        ({"contains": {"minimum": 5}, "minContains": 0, "maxContains": 1}, [[], [5]], [[5, 6]]),
        ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}], [{}, {"a": 1, "b": 2, "c": 3}]),
        ({"propertyNames": {"pattern": "^[a-z]+$"}}, [{"ab": 1}], [{"A": 1}]),
        ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}, [{"k": 1, "x": 0}, {"k": 2, "y": 0}, {"y": 1}], [{"k": 1}, {"k": 2}, {}]),
        ({"dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 2}, {"b": 1}], [{"a": 1}]),
        ({"dependentSchemas": {"a": {"required": ["b"]}}}, [{"a": 1, "b": 2}], [{"a": 1}]),
        ({"dependencies": {"a": ["b"], "c": {"minProperties": 3}}}, [{"a": 1, "b": 2}], [{"a": 1}, {"c": 1}]),
        ({"multipleOf": 0.1}, [0.3, 1, 0.7, -1.1], [0.35]),
        ({"multipleOf": 1e-8}, [12391239123, 0.00000003], [0.000000035]),
        ({"type": ["integer", "null"]}, [None, 3, 3.0], [True, "3", 3.5]),
        ({"exclusiveMinimum": 0, "exclusiveMaximum": 1}, [0.5], [0, 1]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [1, 5.5], [6, 1.5]),
        ({"not": {"required": ["x"]}}, [{}], [{"x": 1}]),
        ({"allOf": [{"minLength": 2}, {"$ref": "#/$defs/short"}], "$defs": {"short": {"maxLength": 3}}}, ["ab"], ["a", "abcd"]),
        ({"title": "t", "description": "d", "default": 3, "format": "email", "x-own": 1, "examples": [1]}, ["no email", 5], []),
        (True, [1, None], []),
        (False, [], [1]),
    ],
)
def test_keywords(schema, good, bad):
    assert [v for v in good if violations(v, schema)] == [] and [v for v in bad if not violations(v, schema)] == []


@pytest.mark.parametrize("schema", [{"unevaluatedProperties": False}, {"tpye": "string"}, {"$ref": "other.json"}, {"$ref": "#/nowhere"}, {"$ref": "#"}, {"items": 5}, {"$dynamicRef": "#x"}])
def test_what_can_t_be_applied_is_no_pass(schema):
    assert violations([1], schema)


def test_problems_of_calls():
    assert tool_calls.check('{"a":1}', '{"unevaluatedProperties":false}') == "$: keyword unevaluatedProperties is not known"
    assert tool_calls.check("{}", '{"required":5}').startswith("the schema can't be applied")
    assert tool_calls.check('"' + "a" * 40 + '!"', '{"pattern":"^(a|aa)+$"}') is not None


def test_nan_is_no_json(spark):
    for text in ("NaN", '{"a": Infinity}', "[-Infinity]"):
        with pytest.raises(ValueError):
            loads(text)
    rows = [
        (1, 0, "assistant", '{"content": "x", "tool_calls": [{"id": "a", "name": "f", "arguments": "{\\"n\\": NaN}"}]}'),
        (1, 1, "assistant", '{"content": NaN, "tool_calls": []}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnsRenamed({}).selectExpr("*", "1 AS kind", "2 AS problem", "3 AS json")
    got = {(r.turn, r.kind): (r.problem, r.json) for r in tool_calls.link(df).collect()}
    assert got[0, "call"][0] == "arguments are no JSON" and (1, "call") not in got and "NaN" in got[1, "message"][1]
    assert tool_calls.link(df.limit(0)).collect() == []
