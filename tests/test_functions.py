from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomwright.functions import dates, multivalue, numbers, phones, text, validators


def values(spark, cells, f):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_numbers(spark):
    cells = ["1,234", "$5", "(7)", "$(5)", "($5)", "12.0", "12.5", "x", " ", None, "-3"]
    assert values(spark, cells, numbers.to_integer) == [1234, 5, -7, -5, None, 12, None, None, None, None, -3]  # Q22
    assert values(spark, ["1,234.50", "(2.5)", "n/a"], numbers.to_decimal) == [Decimal("1234.5"), Decimal("-2.5"), None]
    assert values(spark, ["1e3", "+4.5", "7", "1."], lambda c: numbers.safe_numeric(c).cast("double")) == [None, 4.5, 7.0, None]
    assert values(spark, ["507.0", "507.9", "a"], lambda c: numbers.coerce(c, "INTEGER")) == [507, 507, None]
    assert values(spark, ["Yes", "off", "f", "?"], numbers.to_boolean) == [True, None, None, None]
    assert values(spark, ["Yes", "off", "f", "?"], lambda c: numbers.to_boolean(c, wide=True)) == [True, False, False, None]  # Q20


def test_dates(spark):
    cells = ["9/10/2025 20h11", "10/09/25 8:11pm", "10/09/2025", "13/02/2024", "2025-10-09T20:11:00Z", "Thu, 9th Oct, 2025 at 8:11pm", "9 Oct 2025", "12-25-95", "31/31/2024", "invalid date", "5", "", None]
    assert values(spark, cells, dates.iso) == ["2025-09-10T20:11:00Z", "2025-10-09T20:11:00Z", "2025-10-09T00:00:00Z", "2024-02-13T00:00:00Z", "2025-10-09T20:11:00Z", "2025-10-09T20:11:00Z", "2025-10-09T00:00:00Z", "1995-12-25T00:00:00Z", None, None, None, None, None]
    assert values(spark, ["10/09/2025"], lambda c: dates.iso(c, dayfirst=True)) == ["2025-09-10T00:00:00Z"]
    assert values(spark, ["10/09/2025"], lambda c: dates.iso(c, "%d/%m/%Y")) == ["2025-09-10T00:00:00Z"]  # Q5


def test_multivalue(spark):
    cells = ['["a@x.org", "b@x.org"]', "a; b;; c", "a@x.org b@y.org", "one", "", None, "x, NULL, X"]
    assert values(spark, cells, multivalue.values) == [["a@x.org", "b@x.org"], ["a", "b", "c"], ["a@x.org", "b@y.org"], ["one"], [], None, ["x", "X"]]
    assert values(spark, ["b;A;a;B;c"], lambda c: multivalue.distinct(multivalue.values(c))) == [["b", "A", "c"]]
    assert values(spark, ["a;b", "", None], lambda c: multivalue.value_at(c, 1, "-")) == ["b", "-", None]


@pytest.mark.parametrize(("cell", "form", "want"), [
    ("(415) 555-1234", "e164", "4155551234"), ("(415) 555-1234", "national", "(415) 555-1234"), ("+1 415 555 1234", "e164", "+14155551234"), ("+1 415 555 1234", "international", "+1 (415) 555-1234"),
    ("+44 20 7946 1234", "international", "+44 20 7946 1234"), ("555-1234", "national", "555-1234"), ("12345", "e164", None), ("1" * 16, "e164", None), ("+33 1 23 45 67 89", "international", "+33 123-456-789"),
    ("+999 123 456 7890", "digits_only", "9991234567890"), (None, "e164", None), ("", "e164", None), ("555 0000 x12", "e164", "555000012"), ("0041 44 668 1800", "e164", "+41446681800"),
])
def test_phones(spark, cell, form, want):
    assert values(spark, [cell], lambda c: phones.standardized(c, form)) == [want]


def test_phone_parts(spark):
    assert values(spark, ["(415) 555-1234"], lambda c: phones.standardized(c, "e164", default_country="1")) == ["+14155551234"]
    assert values(spark, ["555-123-4567 ext 89"], lambda c: phones.standardized(c, "e164", keep_extension=True)) == ["5551234567x89"]
    split = values(spark, ["+1 415 555 1234", "+49 030 1234567890", "123", None], phones.split)
    assert [tuple(s) if s else None for s in split] == [("1", None, "4155551234"), ("49", "030", "1234567890"), None, None]


def test_text(spark):
    df = spark.createDataFrame([(" a ", None, "c"), (None, "", " ")], "x string, y string, z string")
    assert [tuple(r) for r in df.select(text.merged([F.col(c) for c in "xyz"], "-"), text.first_filled([F.col(c) for c in "xyz"], "d")).collect()] == [("a-c", " a "), (None, "d")]
    assert values(spark, ["ab12", "none"], lambda c: text.replaced(c, r"(?P<l>[a-z]+)(\d+)", r"\2$\g<l>")) == ["12$ab", "none"]  # Q4
    assert values(spark, ["x" * 600, "x"], lambda c: F.length(text.shortened(c))) == [500, 1]


def test_validators(spark):
    def ok(cells, *a, **k):
        return values(spark, cells, lambda c: validators.passes(c, *a, **k))

    assert ok(["a@b.org", "a@b", "TBD", None, " "], "email") == [True, False, False, True, True]
    assert ok([None, " ", "x"], "not_empty", allow_null=False) == [False, False, True]
    assert ok(["on", "maybe"], "boolean") == [True, False]
    assert ok(["abc1", "1"], "regex", "[a-c]+") == [True, False]
    assert ok(["abc1"], "regex", "[") == [False]
    assert ok(["any", "n/a"], "no such validator") == [True, False]
    good = {"phone_us": "(415) 555-1234", "uuid": "123e4567-e89b-12d3-a456-426614174000", "ipv4": "10.0.0.1", "ipv6": "::1", "iban": "DE44500105175407324931", "hex_color": "#fff", "slug": "a-b", "time_24h": "23:59", "currency_usd": "$1,000.00", "postal_code_ca": "K1A 0B1", "url": "https://x.org/a"}
    for name, cell in good.items():
        assert ok([cell, "~~"], name) == [True, False], name
    assert [r["validator"] for r in validators.rules_for({"Work Email": "TEXT", "mobile": "TEXT", "zip": "TEXT", "ok": "BOOLEAN", "x": "TEXT"})] == ["email", "phone", "postal_code", "boolean"]
