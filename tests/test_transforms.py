"""Golden rows of the normalisation steps and predicates."""

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import encoders as G
from tracewarden.functions.predicates import match
from tracewarden.functions.transforms import TRANSFORMS, apply_chain, chain_prefixes, effective_chain

GOLDEN = [
    ("urlDecodeUni", "a%20b+c%zz%u0041%uff1c%C3%A9%", "a b c%zzA<é%"),
    ("htmlEntityDecode", "&lt;a&#x3c;&#60;&amp;&ampx;&bogus;&nbsp;&eacute&#0;&#x80;&", "<a<<&&x;&bogus;\xa0é�€&"),
    ("jsDecode", r"\x3cscript>\74\n\q\\é", "<script><\nq\\é"),
    ("cssDecode", "\\3c script\\00003e\\ff1c x\\", "<script><x"),
    ("utf8toUnicode", "aé😀b", "a%u00e9%u1f600b"),
    ("escapeSeqDecode", r"\x3c\101\n\q\\", "<A\n\\q\\"),
    ("removeNulls", "a\x00b", "ab"),
    ("cmdLine", "C^at  /etc;  'ls' (x", "cat/etc ls(x"),
    ("replaceComments", "a/* x */b/*c", "a b "),
    ("removeCommentsChar", "a/*b*/c--d#e", "abcde"),
    ("removeWhitespace", "a \t\nb\xa0c", "abc"),
    ("compressWhitespace", "a \t\nb", "a b"),
    ("normalizePath", "/a/./b//../c/", "/a/c/"),
    ("normalizePath", "/../x", "/x"),
    ("normalizePath", "a/b/../../../c", "../c"),
    ("normalizePath", "", ""),
    ("normalizePathWin", "\\a\\..\\b", "/b"),
    ("length", "é", "2"),
    ("base64Decode", "PHNjcmlwdD4", "<script>"),
    ("base64Decode", "PHNj*xx", "<sc"),
]


@pytest.mark.parametrize("name, given, expected", GOLDEN)
def test_step(spark, name, given, expected):
    assert spark.createDataFrame([(given,)], "v string").select(TRANSFORMS[name](F.col("v"))).first()[0] == expected


def test_chains():
    assert effective_chain(["lowercase", "none", "urlDecodeUni"]) == ("urlDecodeUni",)
    assert chain_prefixes(["lowercase", "removeNulls"]) == [(), ("lowercase",), ("lowercase", "removeNulls")]
    with pytest.raises(ValueError):
        effective_chain(["noSuchStep"])


def test_sha1_then_hex(spark):
    got = spark.createDataFrame([("abc",)], "v string").select(apply_chain(F.col("v"), ["sha1", "hexEncode"])).first()[0]
    assert got == "a9993e364706816aba3e25717850c26c9cd0d89d"


@pytest.mark.parametrize(
    "operator, value, argument, expected",
    [
        ("pm", "xUnion y", "foo union", True), ("validateByteRange", "a\x00", "1-255", True),
        ("validateByteRange", "é", "32-126", True), ("validateByteRange", "é", "32-126,128-255", False),
        ("validateByteRange", "é", "32-126,195", True), ("ipMatch", "10.1.2.3", "10.0.0.0/8,::1", True),
        ("ipMatch", "::1", "10.0.0.0/8,::1", True), ("ipMatch", "x", "10.0.0.0/8", False), ("within", "GET", "GET HEAD", True),
        ("validateUrlEncoding", "a%2", "", True), ("gt", "12", "3", True), ("eq", "text", "0", True), ("rx", None, ".", False),
    ],
)
def test_predicate(spark, operator, value, argument, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(match(operator, F.col("v"), argument)).first()[0] is expected


def test_url_encoding(spark):
    df = spark.createDataFrame([("a b*~é",)], "v string")
    assert df.select(G.url_encode(F.col("v"))).first()[0] == "a+b%2A~%C3%A9"
    assert df.select(G.html_entity_encode(F.lit("<é"))).first()[0] == "&#x3c;&#xe9;"
    assert df.select(G.hex_encode(F.lit("aé"))).first()[0] == "%61%c3a9"
