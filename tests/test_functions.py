import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import day, tuples
from reclutark.functions import calendar, coerce, measures, text
from reclutark.plans import conversations
from reclutark.functions.calendar import MONTH, QUARTER, RANGE, WEEK, YEAR, Period


def lit_date(iso):
    return F.lit(iso).cast("date")


def text_lit(value):
    return F.lit(value).cast("string")


# --- text ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, shown", [("  x\t\n", "x"), (" a b　", "a b"), ("", ""), (None, None)])
def test_strip(value, raw, shown):
    assert value(text.strip(text_lit(raw))) == shown


def test_fold_accents_keeps_enye_and_dieresis(value):
    assert value(text.fold_accents(F.lit("Institucionalización ñü"))) == "INSTITUCIONALIZACION ÑÜ"


@pytest.mark.parametrize("raw, shown", [(None, "SIN ESPECIFICAR"), ("  ", "SIN ESPECIFICAR"), (" Ana ", "Ana")])
def test_text_or_default(value, raw, shown):
    assert value(text.text_or_default(text_lit(raw))) == shown


def test_full_name_keeps_the_gap_of_a_missing_part(value):
    assert value(text.full_name(F.lit("ANA"), text_lit(None), F.lit("LOPEZ"))) == "ANA  LOPEZ"
    assert value(text.full_name(text_lit(None), text_lit(None), F.lit("LOPEZ"))) == "LOPEZ"


@pytest.mark.parametrize("flag, shown", [("SI", "VACANTE"), ("NO", "CHOFER"), (None, "CHOFER")])
def test_mask_confidential(value, flag, shown):
    assert value(text.mask_confidential(F.lit("CHOFER"), text_lit(flag))) == shown


def test_short_company(value):
    assert value(text.short_company(F.lit("SICMART SA DE CV"))) == "SICMART"
    assert value(text.short_company(F.lit("OTRA SA"))) == "OTRA SA"
    assert value(text.short_company(text_lit(None))) is None


@pytest.mark.parametrize(
    "name, shown",
    [("MARTA ELENA UNO", "HELEN"), ("Leticia Dos", "Leticia"), ("YULIANA  X", "YULI"), ("  ", None), (None, None)],
)
def test_first_word_alias_is_case_sensitive(value, name, shown):
    assert value(text.first_word_alias(text_lit(name))) == shown


@pytest.mark.parametrize(
    "name, shown", [("ANA LETICIA ELENA", "LETICIA"), ("marta elena", "ELENA"), ("AGENCIA", None), (None, None)]
)
def test_first_listed_word(value, name, shown):
    assert value(text.first_listed_word(text_lit(name))) == shown


@pytest.mark.parametrize(
    "name, choice, matches",
    [
        ("Marta Elena Uno", "HELEN", True),
        ("Marta Elena Uno", "ELENA", False),
        ("leticia dos", "LETY", True),
        ("YULIANA  CUATRO", "YULIANA", True),
        ("AGENCIA", "DIEGO", False),
        (None, "DIEGO", False),
    ],
)
def test_any_word_is(value, name, choice, matches):
    assert value(text.any_word_is(text_lit(name), choice)) is matches


@pytest.mark.parametrize(
    "reply, payload",
    [
        ('Claro: ```json\n{"a": 1}\n``` listo', '{"a": 1}'),
        ('{"output": "texto {\\"chart\\": 2} fin"}', '{"chart": 2}'),
        ('{"output": "solo texto"}', '{"output": "solo texto"}'),
        ('[{"output": "uno"}, {"output": "dos"}]', '{"output":"uno"}'),
        ("no json", None),
        ("{roto", None),
        ("{mal: }", None),
        (None, None),
    ],
)
def test_json_payload(spark, reply, payload):
    df = spark.createDataFrame([(reply,)], "texto string")
    assert conversations.payloads(df).first()["contenido"] == payload


# --- coercion -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, number", [("7", 7), (" 7 ", 7), ("3.9", 3), ("-3.9", -3), ("n/a", 0), (None, 0), ("NaN", 0)])
def test_lenient_int(value, raw, number):
    assert value(coerce.lenient_int(text_lit(raw))) == number


@pytest.mark.parametrize("raw", ["x", None, "3.5"])
def test_strict_int_raises(value, raw):
    with pytest.raises(Exception, match="not a valid bigint"):
        value(coerce.strict_int(text_lit(raw)))


def test_strict_date(value):
    assert value(coerce.strict_date(text_lit("2024-02-29"))) == dt.date(2024, 2, 29)
    assert value(coerce.strict_date(text_lit(None))) is None
    with pytest.raises(Exception, match="not a valid date"):
        value(coerce.strict_date(text_lit("ayer")))


@pytest.mark.parametrize("raw, iso", [
    ("2024-05-06", "2024-05-06"), ("2024-05-06T10:11:12", "2024-05-06"), ("ayer", None), ("45000", None), ("15/03/2024", "2024-03-15"), (None, None)])
def test_lenient_date(value, raw, iso):
    assert value(coerce.lenient_date(text_lit(raw))) == day(iso)


@pytest.mark.parametrize(
    "raw, iso",
    [
        ("2024-05-06", "2024-05-06"),
        ("2024-05-06 13:14:15", "2024-05-06"),
        ("5/6/2024", "2024-05-06"),
        ("25/12/2024", "2024-12-25"),
        ("25-12-2024", "2024-12-25"),
        ("2024/5/6", "2024-05-06"),
        ("2024-05-06T13:14:15Z", "2024-05-06"),
        ("12/25/2024 10:30", "2024-12-25"),
        ("2024-05-06 basura", None),
        ("31/31/2024", None),
        ("45000", None),
        ("45000.5", None),
        ("mañana", None),
        (None, None),
    ],
)
def test_import_date(value, raw, iso):
    assert value(coerce.import_date(text_lit(raw))) == day(iso)


def test_plausible_date_and_iso_text(value):
    assert value(coerce.plausible_date(lit_date("1999-12-31"))) is None
    assert value(coerce.plausible_date(lit_date("2000-01-01"))) == dt.date(2000, 1, 1)
    assert value(coerce.iso_text(lit_date("2000-01-01"))) == "2000-01-01"


# --- calendar -----------------------------------------------------------------------------------------------


def test_week_range():
    assert calendar.week_range(2026, 53) == (dt.date(2026, 12, 28), dt.date(2027, 1, 3))
    with pytest.raises(ValueError):
        calendar.week_range(2025, 53)


def test_quarter_range():
    assert calendar.quarter_range(2024, 1) == (dt.date(2024, 1, 1), dt.date(2024, 3, 31))
    assert calendar.quarter_range(2024, 4) == (dt.date(2024, 10, 1), dt.date(2024, 12, 31))
    with pytest.raises(ValueError):
        calendar.quarter_range(2024, 5)


def test_column_forms_agree_with_python(spark):
    rows = spark.sql("SELECT * FROM VALUES (2020, 53, 1), (2024, 1, 2), (2026, 53, 4) AS v(y, w, q)")
    y, w, q = F.col("y"), F.col("w"), F.col("q")
    got = rows.select(
        "y", "w", "q",
        calendar.iso_week_start(y, w).alias("week"),
        calendar.quarter_start(y, q).alias("first"),
        calendar.quarter_end(y, q).alias("last"),
        calendar.iso_weeks_in_year(y).alias("weeks"),
    ).collect()
    for row in got:
        assert row["week"] == calendar.week_range(row["y"], row["w"])[0]
        assert (row["first"], row["last"]) == calendar.quarter_range(row["y"], row["q"])
        assert row["weeks"] == dt.date(row["y"], 12, 28).isocalendar()[1]


def test_clamped_date_and_labels(value):
    assert value(calendar.clamped_date(F.lit(2025), F.lit(2), F.lit(29))) == dt.date(2025, 2, 28)
    assert value(calendar.month_label(F.lit(9))) == "Septiembre"
    assert value(calendar.month_label(F.lit(1), short=True)) == "Ene"
    assert value(calendar.year_month(lit_date("2024-03-05"))) == "2024-03"


def test_same_window_cuts_leap_day():
    windows = calendar.same_window([2024, 2025], (2, 29), (12, 31))
    assert [w[1] for w in windows] == [dt.date(2024, 2, 29), dt.date(2025, 2, 28)]


def dates(spark, *isos):
    return spark.createDataFrame([(day(i),) for i in isos], "d date")


@pytest.mark.parametrize(
    "period, kept",
    [
        (Period(), 5),
        (Period(YEAR), 5),
        (Period(YEAR, year=2024), 3),
        (Period(QUARTER, year=2024, quarter=1), 2),
        (Period(MONTH, year=2024, month=3), 1),
        (Period(WEEK, year=2024, week=1), 1),
        (Period(RANGE, start=dt.date(2024, 1, 1), end=dt.date(2024, 3, 31)), 2),
        (Period(RANGE, start=dt.date(2024, 1, 1)), 5),
    ],
)
def test_period_filter(spark, period, kept):
    df = dates(spark, "2024-01-01", "2024-03-31", "2024-12-31", "2023-12-31", None)
    assert period.filter(df, "d").count() == kept


def test_strict_period_refuses_missing_arguments():
    with pytest.raises(ValueError):
        Period(YEAR, strict=True).bounds()


def test_timestamp_counts_by_its_day(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 23:59:00' AS d")
    assert Period(QUARTER, year=2024, quarter=1).filter(df, "d").count() == 1


# --- measures -----------------------------------------------------------------------------------------------


def coverage(value, aut=None, sol=None, cob=None, hired=0, openings=0, as_of=None, tz_exact=False):
    return value(
        measures.coverage_days(
            lit_date(aut), lit_date(sol), lit_date(cob), F.lit(hired), F.lit(openings), day(as_of), tz_exact
        )
    )


def test_coverage_days(value):
    assert coverage(value, aut="1900-01-01") == 1
    assert coverage(value, sol="2024-01-01", hired=1, cob="2024-01-11") == 10
    assert coverage(value, aut="2024-01-01", hired=1, openings=2, as_of="2024-01-31") == 30
    assert coverage(value, aut="2024-01-01", hired=1, openings=0) is None
    assert coverage(value, hired=1, cob="2024-01-11") is None
    assert coverage(value, aut="2024-01-10", hired=1, cob="2024-01-09") == -1


def test_coverage_days_across_the_clock_change(value):
    case = dict(aut="2021-01-15", cob="2021-07-15", hired=1)
    assert coverage(value, **case) == 181
    assert coverage(value, **case, tz_exact=True) == 180
    assert coverage(value, aut="2021-07-15", cob="2021-12-15", hired=1, tz_exact=True) == 153


def test_listing_days_knows_no_marker(value):
    days = measures.listing_days(lit_date("1900-01-01"), lit_date(None), lit_date(None), dt.date(1900, 1, 31))
    assert value(days) == 30


def test_closed_days_drops_negative(value):
    assert value(measures.closed_days(lit_date("2024-01-10"), lit_date("2024-01-09"))) is None
    assert value(measures.closed_days(lit_date("2024-01-10"), lit_date("2024-01-10"))) == 0


def test_ratios(value):
    assert value(measures.change_pct(F.lit(15), F.lit(10))) == 50.0
    assert value(measures.change_pct(F.lit(15), F.lit(0))) is None
    assert value(measures.share_pct(F.lit(1), F.lit(0))) == 0.0
    assert value(measures.ratio_pct(F.lit(1), F.lit(3))) == 33.33
    assert value(measures.goal_pct(F.lit(30.0), 45)) == 150.0
    assert value(measures.goal_pct(F.lit(0.0), 45)) is None


def test_rounding_is_half_even(value):
    assert [value(F.bround(F.lit(x), 0)) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_efficiency_band(value):
    bands = [value(measures.efficiency_band(F.lit(x))) for x in (79.9, 80.0, 100.0, 100.1, 150.0, 150.1)]
    assert [b.split()[0] for b in bands] == ["Capacidad", "Operación", "Operación", "Sobrecarga", "Sobrecarga", "Riesgo"]


@pytest.mark.parametrize(
    "requested, hired, floor, left",
    [(3, 5, True, 0), (3, 5, False, -2), (3, 1, True, 2), (3, 0, True, 3), (3, None, True, 3), (None, 2, True, 0)],
)
def test_remaining_openings(value, requested, hired, floor, left):
    as_int = [F.lit(x).cast("bigint") for x in (requested, hired)]
    assert value(measures.remaining_openings(*as_int, floor=floor)) == left


@pytest.mark.parametrize("raw, iso", [
    ("15/03/24", "2024-03-15"), ("03/04/24", "2024-03-04"), ("20240315", "2024-03-15"), ("March 15, 2024", "2024-03-15"), ("15-Mar-2024", "2024-03-15"),
    ("15 March 2024", "2024-03-15"), ("15.03.2024", "2024-03-15"), ("2024.03.15", "2024-03-15"), ("03/15/2024 02:30 PM", "2024-03-15"),
    ("2024-03-15 02:30:00 pm", "2024-03-15"), ("Mar 5 2024", "2024-03-05"), ("15 Mar 24", "2024-03-15"), ("2024-03-15T10:00:00Z", "2024-03-15"), ("01/02/70", "1970-01-02"),
    ("2024-03", "2024-03-01"), ("2024/3", "2024-03-01"), ("Mar 2024", "2024-03-01"), ("march-2024", "2024-03-01"), ("Mar, 2024", "2024-03-01"), ("2024 Mar", "2024-03-01"),
    ("03/2024", "2024-03-01"), ("2024-Mar-05", "2024-03-05"), ("2024 March 5", "2024-03-05"), ("20240315 10:00", "2024-03-15"), ("20240315T1000", "2024-03-15"),
    ("20240315T10:00:30", "2024-03-15"), ("2024-03 10:00", "2024-03-01"), ("Mar 2024 10:00", "2024-03-01"),
    ("13/2024", None), ("2024-13", None), ("202403", None), ("20241315 10:00", None), ("Mar 24", None), ("5 Mar", None), ("2024 marzo", None),
    ("15 marzo 2024", None), ("45000", None), ("2024-13-01", None), ("2024-02-30", None), ("20241301", None), ("31/31/24", None), ("", None), ("Marcha 3, 2024", None),
])
def test_dates_of_spreadsheets(value, raw, iso):
    assert value(coerce.import_date(text_lit(raw))) == day(iso)


@pytest.mark.parametrize("reply, answer, chart", [
    ('{"output":"a","output":"b"}', "b", None), ('{"chart":1,"output":"x","chart":{"y":2}}', "x", '{"y":2}'), ('{"output":"a","output":{"z":"b"}}', '{"z":"b"}', None),
    ('{"output":"{\\"output\\":\\"c\\",\\"output\\":\\"d\\"}"}', "d", None), ('{"output":{"output":"in"},"chart":{"chart":3}}', '{"output":"in"}', '{"chart":3}'),
])
def test_the_last_of_repeated_names_counts(spark, reply, answer, chart):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    row = conversations.payloads(spark.createDataFrame([(reply,)], "texto string")).first()
    assert (row["respuesta"], row["grafica"]) == (answer, chart) and spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before


def test_a_text_that_looks_like_a_list_is_no_list(spark):
    df = spark.createDataFrame([('[{"output":"x"},{"output":"y"}]',), ('[{"output":"x"}]',)], "texto string")
    assert tuples(conversations.payloads(df, bodies=False), "respuesta") == [('[{"output":"x"},{"output":"y"}]',), ("x",)]
    assert tuples(conversations.payloads(df), "respuesta") == [("x",), ("x",)]


@pytest.mark.parametrize("reply, payload, answer", [
    ('{"output": "sí"}', '{"output": "sí"}', "sí"), ('{"a":1} y {"b":2}', None, None), ('{"output":"x"} fin {"chart":1}', None, None), ('{"a":1}}', None, None),
    ("{'a':1}", None, None), ('{"output":{"output":"n"}}', '{"output":{"output":"n"}}', '{"output":"n"}'), ('{"a":1}, {"b":2}', None, None), ('{"a":1,}', None, None),
    ('{"output": "{\\"output\\": \\"dentro\\"}"}', '{"output": "dentro"}', "dentro"), ("hola", None, None), ("", None, None),
])
def test_only_whole_json_is_a_payload(spark, reply, payload, answer):
    row = conversations.payloads(spark.createDataFrame([(reply,)], "texto string")).first()
    assert row["contenido"] == payload and row["respuesta"] == (reply if payload is None else answer)


def test_stripping_and_dates_test_few_patterns(spark):
    """Outer blanks are seen without a pattern, and a text that no date begins like meets no shape; each text is looked at once."""
    texts = ["2024-01-05", "5/3/2024", "45000", "pendiente", "20240105", "Mar 5, 2024", "2024 march", "3-2024", " ", None, "ñ 2024", "x/y", "1999.12.31 10:00"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", coerce.import_dates([F.col("t"), F.lit("2024-02-29")]).alias("both"), coerce.import_date(F.col("t")).alias("one")).orderBy("k").collect()
    assert [r.both[0] for r in got] == [r.one for r in got] and {str(r.both[1]) for r in got} == {"2024-02-29"}
    assert [str(r.one) if r.one else None for r in got] == [
        "2024-01-05", "2024-05-03", None, None, "2024-01-05", "2024-03-05", "2024-03-01", "2024-03-01", None, None, None, None, "1999-12-31"]
    assert "rlike" not in str(text.strip(F.col("t"))).lower()
    ends = ["!", "~", "\x7f", "a b", " a ", "á", "aá", "áa", "a\x7f", "", " x ", "\t x\n", "x\x1f", " "]
    stripped = spark.createDataFrame([(t,) for t in ends], "t string").select(text.strip(F.col("t"))).collect()
    assert [r[0] for r in stripped] == [t.strip(text.WHITE_SPACE) for t in ends]
