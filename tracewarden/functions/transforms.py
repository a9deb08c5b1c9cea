"""Text normalisation before matching, one Column function per step.

The decoders cut a value into escape units and runs of other text, map every unit, and join the pieces; a unit becomes
the byte it stands for, so multi-byte characters spelled as several escapes come out whole. Values without the lead
character of an escape are passed through untouched.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX2 = "[0-9a-fA-F]{2}"
_HEX4 = "[0-9a-fA-F]{4}"


def _byte(hex_digits: Column) -> Column:
    """One raw byte as a string, from its hex digits."""
    return F.unhex(hex_digits).cast("string")


def _char(code_point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32")


def _code(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _pieces(value: Column, pattern: str, mapped: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), mapped), "")


def _low_byte(four: Column) -> Column:
    """Low byte of a four-digit code; full-width ASCII (ff01..ff5e) maps to plain ASCII."""
    low = F.substring(four, 3, 2)
    wide = F.lower(F.substring(four, 1, 2)) == "ff"
    code = _code(low)
    shifted = F.lpad(F.hex(code + 32), 2, "0")
    return _byte(F.when(wide & (code > 0) & (code < 0x5F), shifted).otherwise(low))


def _octal(digits: Column) -> Column:
    return _byte(F.lpad(F.conv(digits, 8, 16), 2, "0"))


def none(v: Column) -> Column:
    return v


def url_decode_uni(v: Column) -> Column:
    """``%HH``, ``%uHHHH`` and ``+``; broken escapes stay as they are."""

    def unit(t: Column) -> Column:
        return (
            F.when(t.rlike(f"^%[uU]{_HEX4}$"), _low_byte(F.substring(t, 3, 4)))
            .when(t.rlike(f"^%{_HEX2}$"), _byte(F.substring(t, 2, 2)))
            .otherwise(F.translate(t, "+", " "))
        )

    pattern = rf"%[uU]{_HEX4}|%{_HEX2}|[^%]+|%"
    return F.when(v.contains("%"), _pieces(v, pattern, unit)).otherwise(F.translate(v, "+", " "))


def url_decode(v: Column) -> Column:
    """Form decoding: ``%HH`` and ``+``."""
    unit = lambda t: F.when(t.rlike(f"^%{_HEX2}$"), _byte(F.substring(t, 2, 2))).otherwise(F.translate(t, "+", " "))
    return F.when(v.contains("%"), _pieces(v, rf"%{_HEX2}|[^%]+|%", unit)).otherwise(F.translate(v, "+", " "))


def lowercase(v: Column) -> Column:
    return F.lower(v)


# The named entities are those of HTML 5, taken from the standard library. Names that need no semicolon come first.
_BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_ENTITY_TABLE = ",".join(
    f"{name.rstrip(';')}:{text.encode().hex()}" for name, text in sorted(html.entities.html5.items()) if name.endswith(";")
)
# Code points 128..159 of numeric entities, read as Windows-1252.
_WINDOWS_1252 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6,
    0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C,
    0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A,
    0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}


def html_entity_decode(v: Column) -> Column:
    """Numeric and named entities; unknown names stay, old names also work without a semicolon."""
    table = F.str_to_map(F.lit(_ENTITY_TABLE), F.lit(","), F.lit(":"))
    windows = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in _WINDOWS_1252.items())), F.lit(","), F.lit(":"))
    bare = "|".join(_BARE)

    def numeric(code: Column) -> Column:
        mapped = F.coalesce(F.try_element_at(windows, code.cast("string")).cast("long"), code)
        bad = mapped.isNull() | (mapped == 0) | (mapped > 0x10FFFF) | mapped.between(0xD800, 0xDFFF)
        return _char(F.when(bad, F.lit(0xFFFD)).otherwise(mapped))

    def named(t: Column) -> Column:
        whole = F.try_element_at(table, F.regexp_extract(t, "^&([A-Za-z][A-Za-z0-9]*);?$", 1))
        head = F.regexp_extract(t, f"^&({bare})", 1)
        partial = F.concat(_byte(F.try_element_at(table, head)), F.substr(t, F.length(head) + 2))
        return F.when(t.endswith(";") & whole.isNotNull(), _byte(whole)).when(head != "", partial).otherwise(t)

    def unit(t: Column) -> Column:
        hexa, deci = F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+);?$", 1), F.regexp_extract(t, "^&#([0-9]+);?$", 1)
        return (
            F.when(hexa != "", numeric(F.when(F.length(F.ltrim(hexa, F.lit("0"))) <= 6, _code(hexa)).otherwise(0)))
            .when(deci != "", numeric(F.when(F.length(F.ltrim(deci, F.lit("0"))) <= 7, deci.try_cast("long")).otherwise(0)))
            .when(t.rlike("^&[A-Za-z]"), named(t))
            .otherwise(t)
        )

    pattern = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
    return F.when(v.contains("&"), _pieces(v, pattern, unit)).otherwise(v)


# Single-letter escapes and the bytes they stand for.
_LETTERS = {"a": "07", "b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B"}


def _letter(t: Column, otherwise: Column) -> Column:
    out = None
    for letter, code in _LETTERS.items():
        hit = t == "\\" + letter
        out = F.when(hit, _byte(F.lit(code))) if out is None else out.when(hit, _byte(F.lit(code)))
    return out.otherwise(otherwise)


def js_decode(v: Column) -> Column:
    r"""``\uHHHH``, ``\xHH``, octal and single-letter escapes; a backslash before anything else is dropped."""

    def unit(t: Column) -> Column:
        return (
            F.when(t.rlike(rf"^\\u{_HEX4}$"), _low_byte(F.substring(t, 3, 4)))
            .when(t.rlike(rf"^\\x{_HEX2}$"), _byte(F.substring(t, 3, 2)))
            .when(t.rlike(r"^\\[0-7]+$"), _octal(F.substr(t, F.lit(2))))
            .when(t.startswith("\\") & (F.length(t) == 2), _letter(t, F.substr(t, F.lit(2))))
            .otherwise(t)
        )

    pattern = rf"(?s)\\u{_HEX4}|\\x{_HEX2}|\\[0-3][0-7]{{0,2}}|\\[4-7][0-7]?|\\.|[^\\]+|\\"
    return F.when(v.contains("\\"), _pieces(v, pattern, unit)).otherwise(v)


def css_decode(v: Column) -> Column:
    r"""``\`` and up to six hex digits with one blank after them; an escaped line break and a last ``\`` vanish."""

    def coded(t: Column) -> Column:
        digits = F.regexp_extract(t, r"^\\([0-9a-fA-F]{1,6})", 1)
        four = F.lpad(F.regexp_extract(digits, "([0-9a-fA-F]{1,4})$", 1), 4, "0")
        return F.when(F.length(digits) >= 4, _low_byte(four)).otherwise(_byte(F.substring(four, 3, 2)))

    def unit(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^\\[0-9a-fA-F]"), coded(t))
            .when(t.isin("\\", "\\\n"), "")
            .when(t.startswith("\\"), F.substr(t, F.lit(2)))
            .otherwise(t)
        )

    pattern = r"(?s)\\[0-9a-fA-F]{1,6}[ \t\n\r\f\x0B]?|\\.|[^\\]+|\\"
    return F.when(v.contains("\\"), _pieces(v, pattern, unit)).otherwise(v)


def utf8_to_unicode(v: Column) -> Column:
    """Every character beyond ASCII becomes ``%uHHHH``."""

    def unit(t: Column) -> Column:
        code = F.lower(F.hex(F.encode(t, "UTF-32")))
        digits = F.ltrim(code, F.lit("0"))
        return F.when(
            t.rlike(r"^[^\x00-\x7F]"), F.concat(F.lit("%u"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
        ).otherwise(t)

    return F.when(v.rlike(r"[^\x00-\x7F]"), _pieces(v, r"(?s)[\x00-\x7F]+|[^\x00-\x7F]", unit)).otherwise(v)


def escape_seq_decode(v: Column) -> Column:
    """C escapes; a backslash before anything else stays."""

    def unit(t: Column) -> Column:
        return (
            F.when(t.rlike(rf"^\\x{_HEX2}$"), _byte(F.substring(t, 3, 2)))
            .when(t.rlike(r"^\\[0-7]+$"), _octal(F.substr(t, F.lit(2))))
            .when(t.isin("\\\\", "\\?", "\\'", '\\"'), F.substr(t, F.lit(2)))
            .otherwise(_letter(t, t))
        )

    pattern = rf"(?s)\\x{_HEX2}|\\[0-3][0-7]{{0,2}}|\\[4-7][0-7]?|\\[abfnrtv\\?'\"]|\\|[^\\]+"
    return F.when(v.contains("\\"), _pieces(v, pattern, unit)).otherwise(v)


def remove_nulls(v: Column) -> Column:
    return F.replace(v, F.lit("\x00"), F.lit(""))


def cmd_line(v: Column) -> Column:
    r"""Drop ``\ " ' ^``, blanks before ``/`` and ``(``; ``,`` and ``;`` become blanks; one blank at a time; lower case."""
    v = F.regexp_replace(v, r"[\\\"'^]", "")
    v = F.regexp_replace(v, r"[ \t\n\r,;]+", " ")
    return F.lower(F.regexp_replace(v, r" +([/(])", "$1"))


def replace_comments(v: Column) -> Column:
    """``/* … */`` becomes one blank, also when it is not closed."""
    return F.regexp_replace(v, r"(?s)/\*.*?(?:\*/|\z)", " ")


def remove_comments_char(v: Column) -> Column:
    return F.regexp_replace(v, r"/\*|\*/|--|#", "")


def remove_whitespace(v: Column) -> Column:
    return F.regexp_replace(v, "[ \t\n\r\f\u000b\u00a0]+", "")


def compress_whitespace(v: Column) -> Column:
    return F.regexp_replace(v, "[ \t\n\r\f\u000b\u00a0]+", " ")


def normalize_path(v: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes; ``..`` above the root vanishes, above a relative start it stays."""
    rooted = v.startswith("/")
    start = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        can_pop = (F.size(acc) > 0) & (last != "..")
        up = (
            F.when(can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(rooted, acc)
            .otherwise(F.array_append(acc, part))
        )
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.array_append(acc, part))

    joined = F.array_join(F.aggregate(F.split(v, "/", -1), start, step), "/")
    full = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)
    slash = v.endswith("/") & ~full.isin("", "/")
    return F.when(slash, F.concat(full, F.lit("/"))).otherwise(full)


def normalize_path_win(v: Column) -> Column:
    return normalize_path(F.translate(v, "\\", "/"))


def byte_length(v: Column) -> Column:
    return F.octet_length(v).cast("string")


def base64_decode(v: Column) -> Column:
    """Decode the longest valid start of the value."""
    digits = F.regexp_extract(v, "^[A-Za-z0-9+/]*", 0)
    keep = F.length(digits) - F.when(F.length(digits) % 4 == 1, 1).otherwise(0)
    digits = F.substr(digits, F.lit(1), keep)
    padded = F.rpad(digits, ((F.length(digits) + 3) / 4).cast("int") * 4, F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def sha1(v: Column) -> Column:
    return F.unhex(F.sha1(v)).cast("string")


def hex_encode(v: Column) -> Column:
    return F.lower(F.hex(v.cast("binary")))


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "none": none,
    "urlDecodeUni": url_decode_uni,
    "urlDecode": url_decode,
    "lowercase": lowercase,
    "htmlEntityDecode": html_entity_decode,
    "jsDecode": js_decode,
    "cssDecode": css_decode,
    "utf8toUnicode": utf8_to_unicode,
    "escapeSeqDecode": escape_seq_decode,
    "removeNulls": remove_nulls,
    "cmdLine": cmd_line,
    "replaceComments": replace_comments,
    "removeCommentsChar": remove_comments_char,
    "removeWhitespace": remove_whitespace,
    "compressWhitespace": compress_whitespace,
    "normalizePath": normalize_path,
    "normalisePath": normalize_path,
    "normalizePathWin": normalize_path_win,
    "length": byte_length,
    "base64Decode": base64_decode,
    "sha1": sha1,
    "hexEncode": hex_encode,
}


def effective_chain(names: list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    """Steps that count: ``none`` discards everything before it."""
    chain: list[str] = []
    for name in names or ():
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transform: {name}")
        chain = [] if name == "none" else [*chain, name]
    return tuple(chain)


def apply_chain(value: Column, names: list[str] | tuple[str, ...] | None) -> Column:
    for name in effective_chain(names):
        value = TRANSFORMS[name](value)
    return value


def chain_prefixes(names: list[str] | tuple[str, ...] | None) -> list[tuple[str, ...]]:
    """All stages of a chain, for rules that test after every step."""
    chain = effective_chain(names)
    return [chain[:n] for n in range(len(chain) + 1)]
