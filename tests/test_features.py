"""Features on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import features as X

C = F.col


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize(
    "body, expected",
    [
        ('{"a": 1}', True), ("[1, 2]", True), ("12", True), ("true", True), ("null", True), ('"x"', True), ("", False),
        ("1 2", False), ("1],[2", False), ('1},{"b":2', False), ('{"a":1} x', False), ("{'a':1}", False), ("NaN", False),
        ('{"a":01}', False), ('{"a":1,"a":"xyz"}', True), (' {"a":[1,{"b":null}]}\n', True), ("the end", False), (None, False),
    ],
)
def test_json_body(spark, body, expected):
    assert one(spark, X.is_json_body(C("b")), b=body) is expected


@pytest.mark.parametrize(
    "query, body, kind, count, longest",
    [
        ("a=1&b=22&&c", "", "", 3, 2),
        ("a=%41%42+x", "", "", 1, 4),
        ("a=%zz&b=1", "", "", 0, 0),
        ("a=1;b=2", "", "", 0, 0),
        ("a=é", "", "", 1, 2),
        ("x=1", "u=abc&v=", "application/x-www-form-urlencoded", 3, 3),
        ("", '{"s":"abcd","n":1234567,"o":{"x":"long text"}}', "application/json", 3, 4),
        ("", '{"a":"longer","a":"xy"}', "application/json", 1, 2),
        ("", "[1,2,3]", "application/json", 0, 0),
        ("", '<?xml version="1.0"?><r><a>12</a><b>x</b></r>', "text/xml", 2, 2),
    ],
)
def test_params(spark, query, body, kind, count, longest):
    args = (C("q"), C("b"), C("t"))
    assert one(spark, X.num_params(*args), q=query, b=body, t=kind) == count
    assert one(spark, X.longest_param_value(*args), q=query, b=body, t=kind) == longest


def test_keywords_count_as_a_multiset(spark):
    # "sleep" is listed twice, "alert" is part of "alert("
    assert one(spark, X.num_keywords(F.lower("t")), t="SLEEP") == 2
    assert one(spark, X.num_keywords(F.lower("t")), t="Alert(1)") == 2


@pytest.mark.parametrize(
    "path, depth, numeric", [("/", 0, False), ("", 0, False), ("/a/1/", 2, True), ("//a//b", 3, False), ("/12x/y", 2, False), ("7", 1, True)]
)
def test_path(spark, path, depth, numeric):
    assert one(spark, X.path_depth(C("p")), p=path) == depth
    assert one(spark, X.has_numeric_segment(C("p")), p=path) is numeric


def test_bytes_and_code_points(spark):
    assert one(spark, X.body_length(C("t")), t="é€") == 5
    assert one(spark, X.num_unique_chars(C("t")), t="éé€a") == 3
    assert one(spark, X.num_special_chars(C("t")), t="a-b=c`!é?") == 2
    assert one(spark, X.special_ratio(C("t")), t="") == 0.0
    assert one(spark, X.uses_base64(C("t")), t="") is True
    assert one(spark, X.uses_base64(C("t")), t="abcé") is False
    assert one(spark, X.uses_hex(C("t")), t="\\x41") is True


def test_request_length(spark):
    df = spark.createDataFrame([("GET", "/a?b", "HTTP/1.1", {"Host": ["x"], "A": ["1", "22"]}, "é")], "m string, u string, p string, h map<string,array<string>>, b string")
    expected = len("GET /a?b HTTP/1.1\r\nHost: x\r\nA: 1\r\nA: 22\r\n\r\né".encode())
    assert df.select(X.request_length(C("m"), C("u"), C("p"), C("h"), C("b"))).first()[0] == expected


def test_header_names_ignore_case(spark):
    df = spark.createDataFrame([({"content-LENGTH": ["1", "2"]},)], "h map<string,array<string>>")
    row = df.select(X.multiple_content_length(C("h")), X.num_headers(C("h"))).first()
    assert tuple(row) == (True, 1)
