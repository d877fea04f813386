"""Time formats derived from the values of a column."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import skimlark as sk
from skimlark.functions.moments import MOMENT, formats_of, parse_time, pattern_of

CASES = {
    "iso_zone": (["2026-01-31T10:00:00.5Z", "2026-02-01T10:00:00.123456789+01:00", "2026-02-28T23:59:59-05:30"],
                 [datetime(2026, 1, 31, 10, 0, 0, 500000), datetime(2026, 2, 1, 9, 0, 0, 123456), datetime(2026, 3, 1, 5, 29, 59)]),
    "fractions": (["2026-01-31 10:00:00", "2026-01-31 10:00:00.1", "2026-01-31 10:00:00.123456789"],
                  [datetime(2026, 1, 31, 10), datetime(2026, 1, 31, 10, 0, 0, 100000), datetime(2026, 1, 31, 10, 0, 0, 123456)]),
    "compact_zone": (["2026-01-31T10:00:00+0100", "2026-01-31T10:00:00-0000"], [datetime(2026, 1, 31, 9), datetime(2026, 1, 31, 10)]),
    "half_days": (["1/31/2026 12:05 AM", "2/1/2026 1:30 pm"], [datetime(2026, 1, 31, 0, 5), datetime(2026, 2, 1, 13, 30)]),
    "short_months": (["31 Jan 2026", "1 may 2026"], [datetime(2026, 1, 31), datetime(2026, 5, 1)]),
    "long_months": (["January 31, 2026", "May 1, 2026"], [datetime(2026, 1, 31), datetime(2026, 5, 1)]),
    "dashed_months": (["31-Jan-2026 08:15:00", "01-Dec-2025 23:00:10"], [datetime(2026, 1, 31, 8, 15), datetime(2025, 12, 1, 23, 0, 10)]),
    "day_first": (["31/01/2026 10:30", "01/02/2026 00:00"], [datetime(2026, 1, 31, 10, 30), datetime(2026, 2, 1)]),
    "month_first": (["01/31/2026 10:30", "01/02/2026 00:00"], [datetime(2026, 1, 31, 10, 30), datetime(2026, 1, 2)]),
    "dots": (["01.02.2026 10:30:01", "31.12.2025 00:00:00"], [datetime(2026, 2, 1, 10, 30, 1), datetime(2025, 12, 31)]),
    "weekdays": (["Sat, 31 Jan 2026 10:00:00 GMT", "Sun, 01 Feb 2026 00:00:00 UTC"], [datetime(2026, 1, 31, 10), datetime(2026, 2, 1)]),
    "signs": (["2026年1月31日", "2026年12月1日"], [datetime(2026, 1, 31), datetime(2026, 12, 1)]),
    "minutes": (["2026-01-31T10:05", "2026-01-31T23:59"], [datetime(2026, 1, 31, 10, 5), datetime(2026, 1, 31, 23, 59)]),
    "clock": (["10:05", "9:30"], [datetime(1970, 1, 1, 10, 5), datetime(1970, 1, 1, 9, 30)]),
}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_columns_are_read(spark, zone):
    """All columns are typed and read in one table; the session's zone and its clock changes do not matter."""
    width = max(len(texts) for texts, _ in CASES.values())
    rows = [tuple(texts[i] if i < len(texts) else None for texts, _ in CASES.values()) for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in CASES)).coalesce(1)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        verdicts = {r["column"]: r for r in sk.infer_types(df).collect()}
        assert {c: r["semantic_type"] for c, r in verdicts.items()} == dict.fromkeys(CASES, "datetime")
        for formats in ({c: r["dt_format"] for c, r in verdicts.items()}, None):
            got = sk.convert_types(df, dict.fromkeys(CASES, "datetime"), formats).collect()
            for c, (_, want) in CASES.items():
                assert [r[c] for r in got if r[c] is not None] == want, (c, verdicts[c]["dt_format"])
        over = sk.coerce_override(df.select("iso_zone", "day_first"), {"iso_zone": "datetime", "day_first": "datetime"}).collect()
        assert [r["day_first"] for r in over if r["day_first"]] == CASES["day_first"][1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_skipped_hour(spark):
    """02:30 on the night the clocks go forward stays 02:30."""
    df = spark.createDataFrame([("2026-03-29 02:30:00",)], "t string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(parse_time(F.col("t"), "yyyy-M-d H:m:s").alias("t")).first()["t"] == datetime(2026, 3, 29, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_majority_decides_and_rest_is_null(spark):
    texts = ["13/02/2026", "14/02/2026", "02/15/2026", "01/02/2026", "no date", "31/02/2026"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["time_format"]: r["hits"] for r in sk.time_ratios(df, "t").collect()}
    assert got == {"d/M/yyyy": 3, "M/d/yyyy": 2}


def test_other_texts_have_no_format(spark):
    texts = ["may be", "1.2.3", "2026", "10", "12-34", "sunny, warm", "2026-13-45", "1-2/2026", "x" * 5000, "", "12:60:99", "31 Foo 2026"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sk.time_ratios(df, "t").count() == 0
    assert sk.infer_types(df).first()["semantic_type"] != "datetime"


def test_every_shape_of_the_grammar_has_a_format():
    for found in ("Y-n-n", "Y-n-ntn:n:n.fX", "n/n/Y n:n p", "B n, Y", "L n Y", "W, n B Y n:n:n u", "n-B-Y", "n:n", "n.n.Y n:n:n", "Y年n月n日"):
        formats = formats_of(found)
        assert formats and all(re.compile(pattern_of(f)) for f in formats)
    assert formats_of("n/n/Y") == ["M/d/yyyy", "d/M/yyyy"] and formats_of("hello") == []
    assert re.match(MOMENT, "Jan 1, 2026 10:00") and not re.match(MOMENT, "1/2-2026")
