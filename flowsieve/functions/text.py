"""Text trimming and type coercion that never fails on dirty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters counted as whitespace when trimming text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_DECIMAL_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"
_HEX_INT = r"^0[xX](_?[0-9a-fA-F]+)+$"
_DIGITS = r"[0-9]+(_[0-9]+)*"
_FLOAT = rf"^[+-]?(({_DIGITS})\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
_PLAIN_FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf(inity)?)$"
_NAN = r"(?i)^[+-]?nan$"
_INF = r"(?i)^[+-]?inf(inity)?$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def _hex_value(text: Column) -> Column:
    # Up to 15 hex digits always fit a long; leading zeros do not count.
    digits = F.regexp_replace(F.substring(text, 3, 1 << 20), "_|^[0_]+(?=.)", "")
    return F.when(F.length(digits) <= 15, F.conv(digits, 16, 10).try_cast("bigint"))


def _int_of(text: Column, hex_probe: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (
        F.when(hex_probe.rlike(_HEX_INT), _hex_value(hex_probe))
        .when(
            ~F.lower(hex_probe).startswith("0x") & text.rlike(_DECIMAL_INT),
            F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"),
        )
        .otherwise(F.nullif(digits, F.lit("")).try_cast("bigint"))
    )


def int_from_text(c: Column) -> Column:
    """Integer in text: decimal, 0x-prefixed hex, else all digits run together."""
    text = strip(c)
    return _int_of(text, text)


def int_from_packet_text(c: Column) -> Column:
    """As int_from_text, but a leading blank hides the 0x prefix."""
    return _int_of(strip(c), c)


def float_from_text(c: Column) -> Column:
    """Floating-point number in text, null when it is not one."""
    text = strip(c)
    return (
        F.when(text.rlike(_FLOAT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(_NAN), F.lit(float("nan")))
        .when(text.rlike(_INF), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def float_or(c: Column, fallback: Column) -> Column:
    return F.coalesce(float_from_text(c), fallback)


def numeric_or_null(c: Column) -> Column:
    """Text column to double; anything unparseable becomes null.

    The pattern keeps dirty cells away from the cast, where each would cost an exception.
    """
    text = strip(c.cast("string"))
    return F.when(text.rlike(_PLAIN_FLOAT), text.try_cast("double"))


def numeric_or_zero(c: Column) -> Column:
    return F.coalesce(numeric_or_null(c), F.lit(0.0))


# --- JSON values whose type varies from record to record (VARIANT columns) ---


def variant_values(variants: list[Column]) -> Column:
    """Array of (kind, text, plain) per value: its type class, its text, its text trimmed.

    Kinds: text, number, flag, nested, null, or absent when the record has no such key.
    Text is a string as it is, and nested values as JSON. Working on an array keeps
    one copy of each rule in the plan instead of one per field.
    """
    # Most records have few of the keys: an absent one is passed by as null.
    seen = F.transform(
        F.array(*variants),
        lambda v: F.when(
            v.isNotNull(), F.struct(F.schema_of_variant(v).alias("schema"), F.try_variant_get(v, "$", "string").alias("text"))
        ),
    )
    nothing = F.lit(None).cast("string")
    absent = F.struct(F.lit("absent").alias("kind"), nothing.alias("text"), nothing.alias("plain"))

    def classify(s: Column) -> Column:
        schema = s["schema"]
        kind = (
            F.when(schema == "STRING", F.lit("text"))
            .when(schema == "VOID", F.lit("null"))
            .when(schema == "BOOLEAN", F.lit("flag"))
            .when(schema.startswith("OBJECT") | schema.startswith("ARRAY"), F.lit("nested"))
            .otherwise(F.lit("number"))
        )
        # Numbers and flags have nothing to trim.
        trims = (schema == "STRING") | schema.startswith("OBJECT") | schema.startswith("ARRAY")
        plain = F.when(trims, strip(s["text"])).otherwise(s["text"])
        present = F.struct(kind.alias("kind"), s["text"].alias("text"), plain.alias("plain"))
        return F.when(s.isNull(), absent).otherwise(present)

    return F.transform(seen, classify)


def _flag(text: Column) -> Column:
    return F.when(text == "true", F.lit(1)).otherwise(F.lit(0))


def _number_as_int(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9]{1,18}$"), text.try_cast("bigint")).otherwise(
        text.try_cast("double").try_cast("bigint")
    )


def int_from_json(value: Column) -> Column:
    kind, text, plain = value["kind"], value["text"], value["plain"]
    return (
        F.when(kind == "flag", _flag(text).cast("bigint"))
        .when(kind == "number", _number_as_int(text))
        .when(kind.isin("text", "nested"), _int_of(plain, plain))
    )


def float_from_json(value: Column) -> Column:
    kind, text = value["kind"], value["text"]
    return (
        F.when(kind == "flag", _flag(text).cast("double"))
        .when(kind == "number", text.try_cast("double"))
        .when(kind.isin("text", "nested"), float_from_text(text))
    )


def text_from_json(value: Column) -> Column:
    return F.when(value["kind"] == "flag", F.initcap(value["text"])).otherwise(value["text"])


def clean_text_from_json(value: Column) -> Column:
    shown = F.when(value["kind"] == "flag", F.initcap(value["text"])).otherwise(value["plain"])
    return F.nullif(shown, F.lit(""))


def strict_int_from_json(value: Column) -> Column:
    """A byte count: numbers truncate, text must be a plain integer, falsy values are 0.

    Null marks a value the record must be rejected for.
    """
    kind, text, plain = value["kind"], value["text"], value["plain"]
    return (
        F.when(kind.isin("absent", "null") | ((kind == "text") & (text == "")), F.lit(0).cast("bigint"))
        .when(kind == "flag", _flag(text).cast("bigint"))
        .when(kind == "number", _number_as_int(text))
        .when(
            (kind == "text") & plain.rlike(_DECIMAL_INT),
            F.replace(plain, F.lit("_"), F.lit("")).try_cast("bigint"),
        )
    )


# --- event time ---

_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(.[0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2}(:[0-9]{2})?)?)?)?$"
_BASIC = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:.([0-9]{2})([0-9]{2})?([0-9]{2})?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def time_from_text(c: Column) -> Column:
    """ISO date-time text; other text (also numbers in text) is null."""
    hour_only = F.regexp_replace(c, r"^(.{10}.[0-9]{2})(Z|[+-].*)?$", "$1:00$2")
    spaced = F.regexp_replace(F.regexp_replace(hour_only, r"^(.{10}).", "$1T"), ",", ".")
    zoned = F.regexp_replace(spaced, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    zoned = F.regexp_replace(zoned, r"(T.*[+-][0-9]{2})$", "$1:00")
    extended = F.when(F.length(c) > 10, zoned).otherwise(c)
    parts = [F.regexp_extract(c, _BASIC, i) for i in range(1, 8)]
    basic = F.concat(
        parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit("T"),
        F.coalesce(F.nullif(parts[3], F.lit("")), F.lit("00")), F.lit(":"),
        F.coalesce(F.nullif(parts[4], F.lit("")), F.lit("00")), F.lit(":"),
        F.coalesce(F.nullif(parts[5], F.lit("")), F.lit("00")), parts[6],
    )
    return F.when(c.rlike(_ISO), extended.try_cast("timestamp")).when(c.rlike(_BASIC), basic.try_cast("timestamp"))


def epoch_to_time(seconds: Column) -> Column:
    """Seconds since 1970 to a timestamp, rounded to the microsecond."""
    return F.timestamp_micros(F.rint(seconds * 1e6).try_cast("bigint"))


def time_from_json(value: Column, ingest_time: Column) -> Column:
    kind, text = value["kind"], value["text"]
    number = F.when(kind == "flag", _flag(text).cast("double")).when(kind == "number", text.try_cast("double"))
    return F.coalesce(epoch_to_time(number), time_from_text(F.when(kind == "text", text)), ingest_time)


def epoch_seconds(ts: Column) -> Column:
    """Timestamp to fractional epoch seconds, null to 0."""
    return F.coalesce(F.unix_micros(ts) / F.lit(1e6), F.lit(0.0))
