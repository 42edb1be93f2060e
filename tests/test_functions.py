"""Tokenizer, fingerprint, severity, times and JSON reading."""

import time
import hashlib
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logloom.functions import jsontext, severity, times, tokenizer
from logloom.functions.fingerprint import fingerprint
from logloom.functions.text import first_line, is_blank

CHANCE = random.Random(17)


def tokens(spark, *messages):
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string")
    rows = frame.select("i", tokenizer.tokenize(F.col("m")).alias("s")).orderBy("i").collect()
    return [[(s["kind"], s["value"]) for s in row["s"]] for row in rows]


def some(signs, least, most):
    return "".join(CHANCE.choice(signs) for _ in range(CHANCE.randint(least, most)))


HEX = "0123456789abcdef"


def hexes(n):
    return some(HEX, n, n)


#: A maker of values per kind; between two words each of them is exactly one variable.
MAKERS = {
    "timestamp": lambda: f"20{some('0123', 2, 2)}-0{some('123456789', 1, 1)}-1{some('0123456789', 1, 1)}"
    + CHANCE.choice(["", "T07:08:09Z", " 21:00:59.25+01:00", "T00:00:00.5-0330"]),
    "uuid": lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12)),
    "email": lambda: f"{some('klmnop', 1, 6)}{CHANCE.choice(['', '.x', '-y7', '+tag', '%z'])}@{some('qrst', 1, 5)}.test",
    "ipv6": lambda: CHANCE.choice([":".join(hexes(4) for _ in range(8)), f"fd{hexes(2)}::{hexes(3)}", f"::{hexes(2)}"]),
    "ipv4": lambda: ".".join(str(CHANCE.randint(0, 255)) for _ in range(4)),
    "hex": lambda: CHANCE.choice(["", "0x"]) + "c" + some(HEX, 12, 30),
    "number": lambda: some("123456789", 1, 9) + CHANCE.choice(["", ".5", ".08"]),
}
#: Makers of path segments that stand for something, and of those that do not.
IDS = [lambda: some("123456789", 1, 6), MAKERS["uuid"], lambda: f"{some('xyz', 1, 3)}-{some('123', 1, 2)}"]
PLAIN = ["orders", "v", "static~files", "img.png", "%20"]


def built(parts):
    """A message and its spans, from parts whose kinds are known beforehand."""
    message, spans = "", []

    def add(kind, value):
        nonlocal message
        message += value
        if kind is None and spans and spans[-1][0] is None:
            spans[-1] = (None, spans[-1][1] + value)
        elif value:
            spans.append((kind, value))

    for part in range(parts):
        add(None, CHANCE.choice(["lost ", "beim Laden von ", "été (", "=> [", "; k=", "é", "$"]) if part else "log ")
        choice = CHANCE.randint(0, 9)
        if choice == 0:
            mark = CHANCE.choice("\"'")
            add(None, mark)
            add("quoted", some("ab 12/:.@", 1, 9))
            add(None, mark)
        elif choice == 1:
            segments = [(None, CHANCE.choice(PLAIN)) for _ in range(CHANCE.randint(1, 3))]
            segments.insert(CHANCE.randint(0, len(segments)), ("path-id", CHANCE.choice(IDS)()))
            for kind, value in segments:
                add(None, "/")
                add(kind, value)
        else:
            kind = CHANCE.choice(list(MAKERS))
            add(kind, MAKERS[kind]())
        add(None, CHANCE.choice([" ", ") ", "] ", "; "]))
    return message, spans


def test_built_messages_have_the_kinds_they_were_built_from(spark):
    cases = [built(CHANCE.randint(0, 6)) for _ in range(3000)]
    assert {kind for _, spans in cases for kind, _ in spans} == {None, *tokenizer.KINDS}
    found = tokens(spark, *[message for message, _ in cases])
    for (message, expected), got in zip(cases, found):
        assert got == expected, message


def test_spans_add_up_and_other_values_change_nothing(spark):
    signs = ["\"", "'", "/", "a", "7", "@", ".", ":", "-", "_", " ", "%", "é", "\x1d", "\x1b", "\x1c", "\x1e", "\\", "$1", "\n"]
    for kind in MAKERS:
        signs += [MAKERS[kind]()]
    messages = ["".join(CHANCE.choices(signs, k=CHANCE.randint(0, 9))) for _ in range(3000)]
    for message, spans in zip(messages, tokens(spark, *messages)):
        assert "".join(value for _, value in spans) == message
        # Neighbouring texts are one span.
        assert all(a[0] or b[0] for a, b in zip(spans, spans[1:]))
    pairs = []
    for kind, make in MAKERS.items():
        pairs += [(f"before {make()} after", f"before {make()} after", kind) for _ in range(20)]
    frame = spark.createDataFrame(pairs, "a string, b string, kind string")
    rows = frame.select("kind", tokenizer.structure(F.col("a")).alias("a"), tokenizer.structure(F.col("b")).alias("b"))
    assert all(r["a"] == r["b"] == f"before \x1f{r['kind']}\x1f after" for r in rows.collect())


@pytest.mark.parametrize(
    "message, expected",
    [
        # A number takes no letters with it, and letters before digits keep them.
        ("waited 250us", [(None, "waited "), ("number", "250"), (None, "us")]),
        ("node7 gone", [(None, "node7 gone")]),
        ("7a1c gone", [("number", "7"), (None, "a1c gone")]),
        # An empty pair of quotes holds no value.
        ("''it'", [(None, "''"), ("quoted", "it"), (None, "'")]),
        # An address may follow a value that took the first signs of its run.
        ("2030-01-02.bo@mail.test", [("timestamp", "2030-01-02"), (None, "."), ("email", "bo@mail.test")]),
        ("2030-01-02.+-bo@mail.test", [("timestamp", "2030-01-02"), (None, "."), ("email", "+-bo@mail.test")]),
        ("_up.bo@mail.test", [("email", "_up.bo@mail.test")]),
        ("only words", [(None, "only words")]),
        ("", []),
    ],
)
def test_tokens_at_borders(spark, message, expected):
    assert tokens(spark, message) == [expected]


def test_time_for_hostile_texts_grows_with_their_length(spark):
    size = 100_000
    long = [
        "x" * size + " 2026-09-08T00:00:00Z", "/a" * (size // 2) + "/1", "'" * 9_999, "1:" * (size // 2),
        "ab-" * (size // 3), "a." * (size // 2), "a." * (size // 2) + " x@y.test", "a." * (size // 2) + "@",
        "_a-b." * (size // 5) + " @", "1.2-3%" * (size // 6) + " @",
    ]
    for message, spans in zip(long, tokens(spark, *long)):
        assert "".join(value for _, value in spans) == message


def prints(spark, *records):
    rows = [(i, *record) for i, record in enumerate(records)]
    frame = spark.createDataFrame(rows, "i int, body string, service string, severity int")
    found = frame.select(
        "i", fingerprint(F.col("body"), F.col("service"), F.col("severity")).alias("fp")
    )
    return [row["fp"] for row in found.orderBy("i").collect()]


SAME = [
    ("\n\n   Queue    drained   by   \ntail", "Queue drained by"),
    *[(f"step {MAKERS[kind]()} ended", f"step {MAKERS[kind]()} ended") for kind in MAKERS],
    ("bad 'left' shoe", "bad 'right one' shoe"),
    ("PUT /carts/77-a/items sent", "PUT /carts/b-902/items sent"),
    ("stopped\nat x\ny", "stopped\nelsewhere"),
    ("   \t  ", ""),
    ("   q　﻿r", "q r"),
]
DIFFERENT = [
    ("PUT /carts/5/items sent", "PUT /lists/5/items sent"),
    ("Queue drained", "queue drained"),
    ("no space left", "no route left"),
    ("job 7a1c stuck", "job 7b1c stuck"),
]


def test_messages_that_group(spark):
    found = prints(spark, *[(m, "checkout", 17) for pair in SAME for m in pair])
    assert found[::2] == found[1::2]
    found = prints(spark, *[(m, "checkout", 17) for pair in DIFFERENT for m in pair])
    assert all(a != b for a, b in zip(found[::2], found[1::2]))


def test_fingerprint_fields(spark):
    found = prints(
        spark,
        ("shape", "a", 17), ("shape", "b", 17), ("shape", None, 17), ("shape", "unknown", 17),
        ("shape", "a", None), ("shape", "a", 1),
    )
    assert len(set(found)) == 6
    text = "shape\x1eservice\x1fpresent\x1fa\x1eseverity\x1fabsent"
    assert found[4] == hashlib.sha1(text.encode()).hexdigest()


def test_first_line_and_blank(spark):
    bodies = ["", " \r\n\t\r\n x  y \r\nz", "a\rb\nc", " "]
    frame = spark.createDataFrame([(b,) for b in bodies], "b string")
    rows = frame.select(first_line(F.col("b")), is_blank(F.col("b"))).collect()
    assert [tuple(row) for row in rows] == [("", True), ("x y", False), ("a b", False), ("", True)]


def test_strict_json(spark):
    good = ['{"a":1}', " [1] ", "1", "-5", "null", '"x"', "true", '{"a":1,"a":2}', '{"a":"\\u0041"}']
    bad = [
        "", " ", "{bad", '{"a":1} x', "1],[2", "1,2", "01", "NaN", "'a'", "[1,]", '{"a":1}}', "tru",
        '{"a":"x\ty"}', "﻿{}", '{"a":1}//c', "{a:1}", '"\\x"', "+1", ".5", "1.",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    parsed = jsontext.with_parsed(frame, "t", "doc").orderBy("i").collect()
    assert [row["doc"] is not None for row in parsed] == [True] * len(good) + [False] * len(bad)
    other = frame.select(jsontext.parse_strict(F.col("t")).isNotNull(), "i").orderBy("i").collect()
    assert [row[0] for row in other] == [True] * len(good) + [False] * len(bad)


def test_number_spelling(spark):
    frame = spark.createDataFrame([('{"b":"1.0,2.50","a":[1.0,2.50,10,-0.10,1e3],"c":"x\\"1.0"}',)], "t string")
    text = frame.select(jsontext.short_numbers(F.col("t"))).first()[0]
    assert text == '{"b":"1.0,2.50","a":[1,2.5,10,-0.1,1e3],"c":"x\\"1.0"}'


def test_exponents(spark):
    cases = {
        "1e5": "100000", "1e21": "1e+21", "1e20": "100000000000000000000", "1.5e-3": "0.0015", "1e-6": "0.000001",
        "1e-7": "1e-7", "-2.25E10": "-22500000000", "1.7976931348623157e308": "1.7976931348623157e+308",
        "123456789.125": "123456789.125", "0.0": "0", "7": "7", "-0.0001": "-0.0001",
    }
    rows = [(f'{{"a":[{number}],"t":"{number} 1.0E9 \\\\\\""}}', want) for number, want in cases.items()]
    frame = spark.createDataFrame(rows, "t string, want string")
    found = frame.select(jsontext.short_numbers(F.try_parse_json("t").cast("string")), "t", "want").collect()
    for got, text, want in found:
        number = text[6 : text.index("]")]
        assert got == text.replace(f"[{number}]", f"[{want}]")


def test_severity(spark):
    cases = [
        ('"error"', None, 17, "error"), ('"  ErRoR "', None, 17, "  ErRoR "), ('"DEFAULT"', None, None, "DEFAULT"),
        ('"verbose"', None, 5, "verbose"), ('"crit"', None, 21, "crit"), ("30", None, None, "30"),
        ("30", "pino", 9, "30"), ('"30"', "pino", 9, "30"), ("3", "syslog", 17, "3"), ("8", "syslog", None, "8"),
        ("3.5", "syslog", None, "3.5"), ("70", "pino", None, "70"), ("null", None, None, None),
        ("{}", None, None, None), ('" "', None, None, None), ("true", None, None, None),
        ('"constructor"', None, None, "constructor"),
    ]
    for text, convention, number, token in cases:
        value = F.parse_json(F.lit(text))
        row = spark.range(1).select(severity.normalize(value, convention).alias("s")).first()["s"]
        assert (row["severity_number"], row["severity_text"]) == (number, token), text
    with pytest.raises(ValueError):
        severity.normalize(F.parse_json(F.lit("1")), "other")


def test_bands():
    assert severity.levels_of_band("warn") == [13, 14, 15, 16]
    assert severity.levels_of_band("unknown") == ["unknown"]
    with pytest.raises(ValueError):
        severity.levels_of_band("loud")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-09-08T10:00:00Z", "2026-09-08T10:00:00.000Z"),
        ("2026-09-08T10:00:00", "2026-09-08T10:00:00.000Z"),
        ("2026-09-08 10:00:04", "2026-09-08T10:00:04.000Z"),
        ("2026-09-08", "2026-09-08T00:00:00.000Z"),
        ("2026-09-08T10:00+02:00", "2026-09-08T08:00:00.000Z"),
        ("2026-09-08T10:00:00.123456789-0130", "2026-09-08T11:30:00.123Z"),
        ("2026-02-30", "2026-03-02T00:00:00.000Z"),
        ("2026-09-08T24:00:00Z", "2026-09-09T00:00:00.000Z"),
        ("2026-09-08T24:01:00Z", None),
        ("2026-13-01", None),
        ("1757325602", "2025-09-08T10:00:02.000Z"),
        ("1757325602000", "2025-09-08T10:00:02.000Z"),
        ("1757325602.25", "2025-09-08T10:00:02.250Z"),
        ("0", "1970-01-01T00:00:00.000Z"),
        ("-5", None),
        ("99999999999999999", None),
        ("1969-12-31T23:59:59Z", None),
        ("yesterday", None),
        ("2026/09/08", None),
    ],
)
def test_instants(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(times.iso_text(times.from_text(F.col("t")))).first()[0] == expected


def test_windows(utc):
    window = times.Window.of("2026-01-01T00:00:00Z", "2026-01-01T03:00:00Z")
    assert (window.bucket_unit(), window.bucket_count()) == ("minute", 180)
    assert window.previous().start == utc(2025, 12, 31, 21)
    assert times.Window.of("2026-01-01T00:00:00Z", "2026-01-04T00:00:00Z").bucket_unit() == "hour"
    assert times.Window.of("2026-01-01T00:00:00Z", "2026-01-04T00:00:01Z").bucket_unit() == "day"
    for bad in ("2026-01-01", "2026-01-01T00:00:00", "x", None):
        with pytest.raises(ValueError):
            times.parse_instant(bad)


def test_time_ranges(utc):
    now = utc(2026, 5, 2, 12)
    day = times.Window(now - timedelta(hours=24), now)
    assert times.time_range("1h", now) == times.Window(utc(2026, 5, 2, 11), now)
    assert times.time_range("bogus", now) == times.time_range(None, now) == day
    custom = times.time_range("custom", now, "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z")
    assert custom == times.Window(utc(2026, 1, 1), utc(2026, 1, 2))
    assert times.time_range("custom", now, "2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z") == day
    assert times.time_range("custom", now, None, "2026-01-01T00:00:00Z") == day


def test_addresses_behind_long_runs(spark):
    runs = {n: "-" * n + "joe@b.com" for n in (600, 60_000)}
    cases = {f"to {run} now": [("email", run)] for run in runs.values()}
    cases |= {
        "a" * 60_000 + "@b.com": [("email", "a" * 60_000 + "@b.com")],
        "ab:" * 7 + ":1": [("ipv6", "ab:" * 7 + ":1")],
        # Eight groups are an address of their own, so of a longer run the last ones are left.
        "ab:" * 9 + ":1": [("ipv6", "ab:" * 7 + "ab"), ("ipv6", "ab::1")],
        "2025-01-01.joe@b.com": [("timestamp", "2025-01-01"), ("email", "joe@b.com")],
        "2025-01-01.-+joe@b.com": [("timestamp", "2025-01-01"), ("email", "-+joe@b.com")],
        "/a/b-1-+joe@b.com x": [("path-id", "b-1-"), ("email", "+joe@b.com")],
        "1.1.joe@b.com": [("email", "1.1.joe@b.com")],
    }
    frame = spark.createDataFrame([(m,) for m in cases], "m string")
    for row in frame.select("m", tokenizer.tokenize(F.col("m")).alias("spans")).collect():
        assert [(s["kind"], s["value"]) for s in row["spans"] if s["type"] == "variable"] == cases[row["m"]], row["m"][:40]
        assert "".join(s["value"] for s in row["spans"]) == row["m"]


@pytest.mark.parametrize("unit", ["-", "a", "ab:", "a.", "1-"])
def test_runs_without_an_address_take_linear_time(spark, unit):
    """Six times the signs take far less than the 36 times of quadratic work."""

    def seconds(n):
        text = unit * n + " or @ and ::"
        frame = spark.createDataFrame([(text,)] * 3, "m string").coalesce(1).select(tokenizer.structure(F.col("m")).alias("m"))
        frame.write.format("noop").mode("overwrite").save()
        begin = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    assert seconds(60_000) < 15 * max(seconds(10_000), 0.1)


def test_a_run_without_an_address_costs_little_more_where_a_text_has_an_at_sign(spark):
    # Looking back over 50 lengths from every sign of the run took eight times as long.
    java = spark._jvm.java
    text = "at " + "-" * 20_000 + "1234 @ home"

    def seconds(pattern: str) -> float:
        compiled, taken = java.util.regex.Pattern.compile(pattern), []
        for _ in range(60):
            begun = java.lang.System.nanoTime()
            compiled.matcher(text).replaceAll("")
            taken.append(java.lang.System.nanoTime() - begun)
        return min(taken)

    assert seconds(tokenizer._WITH_EMAIL) < 5 * seconds(tokenizer._WITHOUT_EMAIL)
