"""Strict JSON reading on top of VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import once

# JSON numbers that need the shorter spelling: 1.0 -> 1, 1.50 -> 1.5. The first
# alternative steps over string literals so that digits inside them stay.
_STRING_OR_PADDED = (
    r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
    r"|(?<![0-9.])(-?[0-9]+)\.0+(?![0-9.eE])"
    r"|(?<![0-9.])(-?[0-9]+\.[0-9]*[1-9])0+(?![0-9.eE])"
)
# What any number to respell has in it; few lines do, and the others are passed on.
_ODD = r"[0-9](?:\.[0-9]*0(?![0-9])|E-?[0-9])"


def _marked_pair(text: Column) -> Column:
    return F.try_parse_json(
        F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]"))
    )


def _first_of_pair(pair: Column, text: Column) -> Column:
    return F.when(
        F.try_variant_get(pair, "$[1]", "bigint") == F.xxhash64(text),
        F.try_variant_get(pair, "$[0]", "variant"),
    )


def parse_strict(text: Column) -> Column:
    """JSON text to VARIANT, NULL when the text is not exactly one JSON value.

    ``try_parse_json`` stops after the first value and ignores what follows, so
    the text is read as the first element of an array whose second element is
    the hash of the text itself. Anything after the first value moves or hides
    that element.
    """
    return once(_marked_pair(text), lambda pair: _first_of_pair(pair, text))


def with_parsed(frame: DataFrame, text: str, name: str) -> DataFrame:
    """Add a parsed document under a name; NULL unless the text is exactly one JSON value.

    The document stays inside its marked pair, because taking a VARIANT out of
    another one copies it. ``member``, ``members`` and ``canonical`` read it there.
    """
    kept = frame.columns
    pair = F.col(name)
    valid = F.try_variant_get(pair, "$[1]", "bigint") == F.xxhash64(F.col(text))
    paired = frame.select("*", _marked_pair(F.col(text)).alias(name))
    return paired.select(*kept, F.when(valid, pair).alias(name))


def starts_object(text: Column) -> Column:
    """Whether JSON text is an object, for text already known to be valid JSON."""
    return F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{"))


def member(doc: Column, path: str, kind: str = "variant") -> Column:
    """Member of a document; JSON null is kept as a VARIANT null, absence is NULL."""
    return F.try_variant_get(doc, f"$[0].{path}", kind)


def members(doc: Column) -> Column:
    """Document as MAP<STRING, VARIANT>, NULL for anything that is not an object."""
    return F.try_variant_get(doc, "$[0]", "map<string,variant>")


def canonical(doc: Column) -> Column:
    """Document as JSON text with the keys of every object in order."""
    return short_numbers(F.try_variant_get(doc, "$[0]", "string"))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_null_value(value: Column) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(kind(value), F.lit("OBJECT")), F.lit(False))


def is_string(value: Column) -> Column:
    return kind(value).eqNullSafe("STRING")


def is_number(value: Column) -> Column:
    name = kind(value)
    return F.coalesce(
        name.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(name, F.lit("DECIMAL")),
        F.lit(False),
    )


def string_value(value: Column) -> Column:
    """The string held by a VARIANT, NULL when it holds anything else."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number_value(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def entries_of(value: Column) -> Column:
    """Object as MAP<STRING, VARIANT>, NULL for anything that is not an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


# Numbers with an exponent, as doubles are printed; strings and other text are stepped over.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_EXPONENT = r"-?[0-9]+(?:\.[0-9]+)?E-?[0-9]+"
_TOKENS = rf'({_STRING}|{_EXPONENT}|-?[0-9]+(?:\.[0-9]+)?|[^"0-9-]++|.)'


def _plain_or_short(number: Column) -> Column:
    """A printed double as JSON writers spell it: in full from 1e-6 up to 1e21, else as 1e+21."""
    exponent = F.regexp_extract(number, "E(-?[0-9]+)", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(number, "^([^E]+)E", 1), r"\.0$", "")

    def full(scale: int) -> Column:
        return F.regexp_replace(number.cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")

    sign = F.when(exponent > 0, "+").otherwise("")
    return (
        F.when(exponent.between(0, 20), full(16))
        .when(exponent.between(-6, -1), full(24))
        .otherwise(F.concat(mantissa, F.lit("e"), sign, exponent.cast("string")))
    )


def short_numbers(json: Column) -> Column:
    """Numbers outside string literals as JSON writers spell them.

    Zero padding of fractions goes, and doubles lose an exponent that is not needed.
    """
    def spelled(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(f"(?s){_TOKENS}"), F.lit(1))
        return F.array_join(
            F.transform(
                tokens,
                lambda token: F.when(
                    F.rlike(token, F.lit(f"^{_EXPONENT}$")), _plain_or_short(token)
                ).otherwise(token),
            ),
            "",
        )

    def short(text: Column) -> Column:
        return once(
            F.regexp_replace(text, _STRING_OR_PADDED, "$1$2$3"),
            lambda plain: F.when(F.rlike(plain, F.lit("[0-9]E-?[0-9]")), spelled(plain)).otherwise(plain),
        )

    # The text is made once; a branch of its own would make it again.
    return once(json, lambda text: F.when(F.rlike(text, F.lit(_ODD)), short(text)).otherwise(text))


def without(entries: Column, keys) -> Column:
    """Map without the given keys (a list of names or an ARRAY<STRING> column)."""
    if isinstance(keys, Column):
        return F.map_filter(entries, lambda k, _: ~F.array_contains(keys, k))
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys))


def overlay(*maps: Column) -> Column:
    """Maps laid over each other; a later map wins on equal keys."""
    return F.map_concat(*maps)
