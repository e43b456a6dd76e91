"""Scalar helpers (SCL-1..18) as native column expressions.

Everything here returns a ``Column``; nothing runs in Python per row, so the
expressions stay inside whole-stage codegen of the stage that uses them.
Polymorphic record fields (``userIdentity``, ``sessionContext``,
``requestParameters``, ``responseElements``) are carried as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values that must equal the reference's for identical results:
# read-only spellings, OS keyword order, the service suffix and the 13-feature order.
READONLY_TRUE = ["true", "1", "t", "yes", "y"]
OS_RULES = [
    ("Windows", ["windows"]),
    ("Mac", ["mac os", "macintosh", "darwin", "os x"]),
    ("Linux", ["linux"]),
    ("Android", ["android"]),
    ("iOS", ["iphone", "ios", "ipad"]),
]
OS_DEFAULT = "Unknown"
SERVICE_SUFFIX = ".amazonaws.com"

# A JSON string literal, used to skip string contents when looking at structure.
_JSON_STRING = r'"(?:[^"\\]|\\.)*"'
# One dotted quad, each octet 0-255 written without leading zeros.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
# JSON texts whose value Python treats as false (``x or {}`` replaces them).
_FALSY_JSON = ["null", '""', "0", "0.0", "false", "[]", "{}"]


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_str(c: ColumnOrName) -> Column:
    """SCL-1: null -> '', else the text of the value."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def hash32(c: ColumnOrName) -> Column:
    """SCL-2: stable signed 32-bit hash of the text of ``c``; '' (and null) -> 0.

    First 8 hex digits of md5 read as an unsigned 32-bit number, folded to signed
    (flipping bit 31 and subtracting 2^31 maps [2^31, 2^32) to [-2^31, 0) and
    leaves the rest, with md5 evaluated once).
    """
    s = safe_str(c)
    unsigned = F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")
    signed = unsigned.bitwiseXOR(F.lit(2**31)) - F.lit(2**31)
    return F.when(s == "", F.lit(0).cast("bigint")).otherwise(signed)


def ip_to_int(c: ColumnOrName) -> Column:
    """SCL-3: dotted-quad IPv4 -> unsigned 32-bit number, anything else -> hash32(text)."""
    s = safe_str(c)
    parts = F.split(s, r"\.")
    value = (parts.getItem(0).cast("bigint") * 16777216 + parts.getItem(1).cast("bigint") * 65536
             + parts.getItem(2).cast("bigint") * 256 + parts.getItem(3).cast("bigint"))
    return F.when(s.rlike(_IPV4), value).otherwise(hash32(s))


def user_agent_num(c: ColumnOrName) -> Column:
    """SCL-4: length * 65536 + low 16 bits of hash32(first 4 characters)."""
    s = safe_str(c)
    return F.length(s).cast("bigint") * 65536 + hash32(F.substring(s, 1, 4)).bitwiseAND(F.lit(65535))


def compact_json(c: ColumnOrName) -> Column:
    """Remove whitespace outside string literals."""
    return F.regexp_replace(_col(c), r'("(?:[^"\\]|\\.)*")|\s+', "$1")


def _number_lengths(tokens: Column) -> Column:
    """Characters by which Python prints JSON numbers with a fraction or an exponent, all together.

    A token of at most 15 digits prints with just these digits; a longer one, or one with an exponent
    of three digits, with those of its double. Exponents from -4 to 15 are written out, others as ``e+16`` or ``e-05``.
    """
    texts = F.transform(tokens, lambda x: F.when(
        (F.length(F.regexp_replace(x, r"[eE].*|[-.]", "")) <= 15) & ~x.rlike("[eE][+-]?[0-9]{3}"), x)
        .otherwise(x.cast("double").cast("string")))
    parts = F.transform(texts, lambda t: F.struct(
        t.startswith("-").cast("int").alias("sign"), t.endswith("y").alias("infinite"),
        F.regexp_extract(t, r"^-?([0-9]+)", 1).alias("whole"), F.regexp_extract(t, r"\.([0-9]+)", 1).alias("fraction"),
        F.coalesce(F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("exponent")))
    digits = F.transform(parts, lambda p: F.struct(
        p["sign"].alias("sign"), p["infinite"].alias("infinite"), (p["exponent"] + F.length(p["whole"]) - 1).alias("first"),
        F.concat(p["whole"], p["fraction"]).alias("all"),
        F.ltrim(F.concat(p["whole"], p["fraction"]), F.lit("0")).alias("kept")))
    placed = F.transform(digits, lambda d: F.struct(
        d["sign"].alias("sign"), d["infinite"].alias("infinite"), F.length(F.rtrim(d["kept"], F.lit("0"))).alias("n"),
        (d["first"] - F.length(d["all"]) + F.length(d["kept"])).alias("e")))

    def size(x: Column) -> Column:
        n, e = x["n"], x["e"]
        power = 2 + F.greatest(F.lit(2), F.length(F.abs(e).cast("string")))  # the e, its sign, two digits or more
        return x["sign"] + (F.when(x["infinite"], F.lit(8)).when(n == 0, F.lit(3))
                            .when((e >= 0) & (e < 16), F.greatest(e + 3, n + 1))
                            .when((e < 0) & (e >= -4), n - e + 1)
                            .otherwise(n + F.when(n > 1, F.lit(1)).otherwise(F.lit(0)) + power))

    return F.aggregate(placed, F.lit(0), lambda total, x: total + size(x).cast("int"))


def json_length(c: ColumnOrName) -> Column:
    """SCL-5: length of the JSON text as Python's ``json.dumps`` prints the value.

    Separators ``", "`` and ``": "`` add one character per ``,``/``:`` outside
    strings; DEL and non-ASCII characters are escaped (``\\uXXXX``: +5 in the BMP, a
    surrogate pair: +11 above it). Escapes that Python would not write so shrink (``\\/``, ``\\u0041``,
    ``\\u000a``), numbers with a fraction or an exponent are spelled anew, ``-0`` prints as ``0``.
    Null prints ``null`` (4). Keys that one object repeats all count; numbers of more than 15 digits and those
    with exponents of three digits have the digits that Java prints, which may be one more.
    """
    js = _col(c)
    compact = compact_json(js)
    structure = F.regexp_replace(compact, _JSON_STRING, "")
    n = (F.length(compact)
         + F.regexp_count(structure, F.lit("[,:]"))
         + F.lit(5) * F.regexp_count(compact, F.lit(r"[\x{7F}-\x{FFFF}]"))
         + F.lit(11) * F.regexp_count(compact, F.lit(r"[\x{10000}-\x{10FFFF}]")))
    # Once escaped backslashes are out of the way, every backslash starts an escape.
    escapes = F.regexp_replace(compact, r"\\\\", "xx")
    shorter = (F.regexp_count(escapes, F.lit(r"\\/"))
               + F.lit(4) * F.regexp_count(escapes, F.lit(r"\\u00(?:0[89aAcCdD]|22|5[cC])"))
               + F.lit(5) * F.regexp_count(escapes, F.lit(
                   r"\\u00(?:2[013-9a-fA-F]|[346][0-9a-fA-F]|5[0-9abdefABDEF]|7[0-9a-eA-E])")))
    numbers = F.regexp_extract_all(structure, F.lit(r"(-?[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+))"), F.lit(1))
    respelled = _number_lengths(numbers) - F.aggregate(numbers, F.lit(0), lambda total, x: total + F.length(x))
    n = (n - F.when(js.contains("\\u00") | js.contains("\\/"), shorter).otherwise(F.lit(0))
         + F.when(structure.rlike("[0-9][.eE]"), respelled).otherwise(F.lit(0))
         - F.when(structure.contains("-0"), F.regexp_count(structure, F.lit(r"-0(?![.eE0-9])"))).otherwise(F.lit(0)))
    return F.when(js.isNull(), F.lit(4)).otherwise(n).cast("bigint")


def num_keys(c: ColumnOrName) -> Column:
    """SCL-6: number of keys of a JSON object, 0 for anything else."""
    keys = F.json_object_keys(_col(c))
    return F.when(keys.isNull(), F.lit(0)).otherwise(F.size(keys)).cast("bigint")


def guess_os(c: ColumnOrName) -> Column:
    """SCL-7: operating system from a user agent, first keyword rule that matches."""
    s = F.lower(safe_str(c))
    expr = None
    for name, words in OS_RULES:
        cond = None
        for w in words:
            cond = s.contains(w) if cond is None else (cond | s.contains(w))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(OS_DEFAULT))


def is_json_object(c: ColumnOrName) -> Column:
    return F.coalesce(F.ltrim(_col(c)).startswith("{"), F.lit(False))


def json_scalar_text(c: ColumnOrName) -> Column:
    """Text of a scalar JSON value as Python ``str`` shows it ('' for falsy values)."""
    js = F.trim(_col(c))
    text = F.get_json_object(F.concat(F.lit('{"v":'), js, F.lit("}")), "$.v")
    return F.when(js.isNull() | js.isin(*_FALSY_JSON), F.lit("")).otherwise(F.coalesce(text, js))


_IDENTITY_SCHEMA = "type STRING, arn STRING, userName STRING, principalId STRING"


def identity_fields(c: ColumnOrName) -> Column:
    """Parse the identity object once: struct(type, arn, userName, principalId)."""
    return F.from_json(_col(c), _IDENTITY_SCHEMA)


def identity_type(c: ColumnOrName) -> Column:
    """SCL-9: ``userIdentity.type`` for an object, the scalar's own text otherwise."""
    js = _col(c)
    return F.when(is_json_object(js), safe_str(identity_fields(js).getField("type"))) \
        .otherwise(json_scalar_text(js))


def iam_name(c: ColumnOrName) -> Column:
    """SCL-8: first non-empty of arn, userName, principalId for an object; scalar text otherwise."""
    js = _col(c)
    f = identity_fields(js)
    first = F.coalesce(F.nullif(f.getField("arn"), F.lit("")),
                       F.nullif(f.getField("userName"), F.lit("")),
                       F.nullif(f.getField("principalId"), F.lit("")))
    return F.when(is_json_object(js), safe_str(first)).otherwise(json_scalar_text(js))


def session_issuer_type(c: ColumnOrName, path: str = "$.sessionIssuer.type") -> Column:
    """SCL-10: type of the session issuer, read from ``sessionContext`` by ``path``."""
    return safe_str(F.get_json_object(_col(c), path))


def error_flag(c: ColumnOrName) -> Column:
    """SCL-11: 1 when the error code text is non-empty."""
    return (safe_str(c) != "").cast("int")


def strip_service(c: ColumnOrName) -> Column:
    """SCL-12: remove every '.amazonaws.com' from an event source."""
    return F.replace(_col(c), F.lit(SERVICE_SUFFIX), F.lit(""))


def name_prefix(c: ColumnOrName) -> Column:
    """SCL-13: text before the first '.', or 'Other' when there is none."""
    s = safe_str(c) if isinstance(c, str) else c
    return F.when(s.contains("."), F.substring_index(s, ".", 1)).otherwise(F.lit("Other"))


def strip_brackets(c: ColumnOrName) -> Column:
    """SCL-14: drop one pair of [ ] around a user agent."""
    s = safe_str(c)
    return F.when(s.startswith("[") & s.endswith("]") & (F.length(s) >= 2),
                  F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def iso_time(c: ColumnOrName, zoned: bool = False) -> Column:
    """SCL-15: ISO text as ``isoformat`` prints a whole-second timestamp; with its offset when ``zoned``."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss" + ("xxx" if zoned else ""))


def utc_time(c: ColumnOrName) -> Column:
    """SCL-15: ``%Y-%m-%d %H:%M:%S UTC``."""
    return F.concat(F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """SCL-18: num / den with 0/0 (and x/0) -> 0."""
    return F.coalesce(F.try_divide(_col(num).cast("double"), _col(den).cast("double")), F.lit(0.0))


def percent(num: ColumnOrName, den: ColumnOrName) -> Column:
    """SCL-17: num / den * 100."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double")) * 100.0


def is_readonly(c: ColumnOrName) -> Column:
    """FLT-3 predicate: boolean true or one of the accepted spellings."""
    return F.coalesce(F.lower(_col(c).cast("string")).isin(*READONLY_TRUE), F.lit(False))
