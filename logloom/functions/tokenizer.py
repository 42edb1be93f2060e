"""Split messages into fixed text and typed variables with one regular expression.

The expression finds the leftmost variable, trying the kinds in table order at
each position, and wraps every hit in a delimiter. Splitting at the delimiter
then alternates text and variable, so the per-element work is bounded by the
number of variables, not by the number of words. All quantifiers run over
single character classes or are possessive: matching long lines does not
recurse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import once

_HEX = "[0-9a-fA-F]"
_GROUP = f"{_HEX}{{1,4}}"

# Identifier shapes.
UUID = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
LONG_HEX = f"{_HEX}{{12,}}"

# Kinds of scalar variables in the order they are tried. Eight groups and
# more are an address of the first form of IPv6, so before :: there are seven at most.
SCALARS = (
    (
        "timestamp",
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
        r"(?:[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
        r"|[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?",
    ),
    ("uuid", UUID),
    ("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (
        "ipv6",
        f"(?:{_GROUP}:){{7}}{_GROUP}"
        f"|(?:{_GROUP}:){{1,7}}+:{_GROUP}(?::{_GROUP})*+"
        f"|::{_GROUP}(?::{_GROUP})*+",
    ),
    ("ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    ("hex", f"(?:0x)?{LONG_HEX}"),
)
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
KINDS = tuple(kind for kind, _ in SCALARS) + ("number", "quoted", "path-id")

_WORD = "[A-Za-z0-9_]"
_SEGMENT = "[A-Za-z0-9._~%-]"
_PATH_ID = (
    f"(?:[0-9]+|{UUID}|{LONG_HEX}|(?={_SEGMENT}*-)(?={_SEGMENT}*[0-9]){_SEGMENT}+)"
    f"(?!{_SEGMENT})"
)
# A path has a second slash and at least one identifier segment. A slash that
# directly follows "/segment" need not be tried: the path from the earlier slash
# held the same segments and was refused. This keeps long paths linear.
_PATH = (
    f"(?<!/{_SEGMENT}{{1,64}})(?=/{_SEGMENT}++/)"
    f"(?=[A-Za-z0-9._~%/-]*?/{_PATH_ID})/[A-Za-z0-9._~%/-]++"
)
# A number takes the letters stuck to it along, so that it cannot be mistaken for
# a longer kind when it is looked at on its own; they are given back as text.
# An e-mail address is looked for once per run of its signs, however long the run is:
# if the run's first sign begins none, no later sign does. It is looked for again only
# past what may have taken the run's first signs before: a date, the end of a time, a
# UUID or a path. Else a long run would be read to its end again from every sign. The
# looks back of many lengths are taken only where the last two signs allow for one.
_LOCAL, _SIGN = "[A-Za-z0-9._%+-]", "[.%+-]"
_AFTER = (
    r"(?<=[0-9]{4}-[0-9]{2}-[0-9]{2}" + _SIGN + ")",
    r"(?<=:[0-9]{2}(?:\.[0-9]{1,40})?(?:Z|[+-][0-9]{2}:?[0-9]{2})?" + _SIGN + ")",
    f"(?<=-{_HEX}{{12}}{_SIGN})",
    rf"(?<=\+)(?<=/{_SEGMENT}{{0,255}}\+)",
)
_ONCE_PER_RUN = (
    f"(?:(?<!{_LOCAL})|\\G|(?<=[0-9a-fA-FZ]{_SIGN})(?:{'|'.join(_AFTER[:3])})|{_AFTER[3]})"
)


# Signs that a value other than an address begins with: at most signs of a text none does.
_FIRST = "[0-9a-fA-F:]"


def _variable(email: bool) -> str:
    def scalar(kind: str, pattern: str) -> str:
        return (_ONCE_PER_RUN if kind == "email" else "") + f"(?>{pattern})(?!{_WORD})"

    scalars = "|".join(scalar(kind, pattern) for kind, pattern in SCALARS if email or kind != "email")
    found = f"(?={_FIRST})(?:{scalars}|(?>{NUMBER}){_WORD}*+)"
    if email:
        found += f"|(?!{_FIRST}){scalar('email', dict(SCALARS)['email'])}"
    return f"\"[^\"]++\"|'[^']++'|(?=/){_PATH}|(?<!{_WORD})(?:{found})"


_WITH_EMAIL, _WITHOUT_EMAIL = _variable(True), _variable(False)
_ONLY_PATH_ID = f"^{_PATH_ID}\\z"
_SHORT_NUMBER = r"^[0-9]{1,11}(?:\.[0-9]+)?\z"

# Control characters that no pattern touches. Text holding them is escaped first.
_DELIMITER, _ESCAPE, _CODE_ESCAPE, _CODE_DELIMITER = "\x1d", "\x1b", "\x1c", "\x1e"

Emit = Callable[[str, Column], Column]


def _escape(text: Column) -> Column:
    text = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _CODE_ESCAPE))
    return F.replace(text, F.lit(_DELIMITER), F.lit(_ESCAPE + _CODE_DELIMITER))


def _unescape(text: Column) -> Column:
    text = F.replace(text, F.lit(_ESCAPE + _CODE_DELIMITER), F.lit(_DELIMITER))
    return F.replace(text, F.lit(_ESCAPE + _CODE_ESCAPE), F.lit(_ESCAPE))


def _render_path(path: Column, emit: Emit) -> Column:
    segments = F.split(path, "/")
    return F.array_join(
        F.transform(
            segments,
            lambda part: F.when(
                F.rlike(part, F.lit(_ONLY_PATH_ID)), emit("path-id", part)
            ).otherwise(part),
        ),
        "/",
    )


def _render_variable(token: Column, emit: Emit) -> Column:
    """One matched variable, with the text that belongs to it."""
    head = F.left(token, F.lit(1))
    rendered = F.when(
        F.rlike(token, F.lit(_SHORT_NUMBER)), emit("number", token)
    ).when(
        head.isin('"', "'"),
        F.concat(head, emit("quoted", F.substring(token, F.lit(2), F.length(token) - 2)), head),
    ).when(head == "/", _render_path(token, emit))
    for kind, pattern in SCALARS:
        rendered = rendered.when(F.rlike(token, F.lit(f"^(?:{pattern})\\z")), emit(kind, token))
    digits = F.regexp_extract(token, f"^{NUMBER}", 0)
    return rendered.otherwise(
        F.concat(emit("number", digits), F.substring(token, F.length(digits) + 1, F.length(token)))
    )


def _render(message: Column, emit: Emit) -> Column:
    # A text without @ holds no address.
    wrapped = f"{_DELIMITER}$0{_DELIMITER}"
    marked = once(
        _escape(message),
        lambda text: F.when(
            F.contains(text, F.lit("@")), F.regexp_replace(text, _WITH_EMAIL, wrapped)
        ).otherwise(F.regexp_replace(text, _WITHOUT_EMAIL, wrapped)),
    )
    pieces = F.split(marked, _DELIMITER)
    return F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(i % 2 == 0, piece).otherwise(_render_variable(piece, emit)),
        ),
        "",
    )


def structure(message: Column) -> Column:
    """Message with every variable replaced by its kind between unit separators."""
    return _unescape(_render(message, lambda kind, _: F.lit(f"\x1f{kind}\x1f")))


def tokenize(message: Column) -> Column:
    """Message as ARRAY<STRUCT<type, kind, value>>; the values add up to the message."""
    shown = _render(
        message,
        lambda kind, value: F.concat(
            F.lit(f"{_DELIMITER}{kind}{_CODE_DELIMITER}"), value, F.lit(_DELIMITER)
        ),
    )

    def span(piece: Column, i: Column) -> Column:
        cut = F.instr(piece, _CODE_DELIMITER)
        variable = i % 2 == 1
        value = F.when(variable, F.substring(piece, cut + 1, F.length(piece))).otherwise(piece)
        return F.struct(
            F.when(variable, "variable").otherwise("text").alias("type"),
            F.when(variable, F.substring(piece, F.lit(1), cut - 1)).alias("kind"),
            _unescape(value).alias("value"),
        )

    spans = F.transform(F.split(shown, _DELIMITER), span)
    return F.filter(spans, lambda s: (s["type"] == "variable") | (s["value"] != ""))
