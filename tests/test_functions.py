"""Column expressions against fixed vectors."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contrapunto.functions import dates as DT
from contrapunto.functions import identifiers as I
from contrapunto.functions import money as M
from contrapunto.functions import text as TX
from contrapunto.functions.similarity import _best_window, _jaro_winkler
from contrapunto.operators import quality as Q
from contrapunto.operators.fill import norm_for_compare


def one(spark, expr, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize("number,digit", [("800255024", "3"), ("860007738", "9"), ("901148337", "1"), ("800.255.024", "3"), ("abc", None), ("12345", None), ("", None)])
def test_check_digit(spark, number, digit):
    assert one(spark, I.check_digit("n"), n=number) == digit


@pytest.mark.parametrize("mode,text,value", [
    ("auto", "88.284.000", "88284000"), ("auto", "1.234.567,89", "1234567.89"), ("auto", "1,234,567.89", "1234567.89"), ("auto", "$ 88.284.000 COP", "88284000"),
    ("auto", "88284000.0", "88284000"), ("auto", "12,5", "12.5"), ("auto", "1,200", "1200"), ("auto", "x", None), ("auto", "", None),
    ("cross", "12.000.000,50", "12000000.50"), ("cross", "12,50", "12.50"), ("cross", "1,234,567", "1234567"), ("cross", "12.000", "12000"), ("cross", "12.5", "12.5"),
    ("co", "$ 12.000.000,00", "12000000"), ("co", "12.000.000", "12000000"), ("plain", "$1,000.50", "1000.50"), ("plain", "1.000.50", None),
    ("pesos", "$18.000.000", "18000000"), ("pesos", "99.999", None), ("pesos", "10.000.000.000.001", None)])
def test_money_modes(spark, mode, text, value):
    got = one(spark, M.parse_money("t", mode), t=text)
    assert got == (None if value is None else Decimal(value))


def test_unknown_money_mode():
    with pytest.raises(ValueError):
        M.parse_money("t", "other")


@pytest.mark.parametrize("text,value", [("2024-03-05T00:00:00.000", "2024-03-05"), ("5/3/2024 10:00", "2024-03-05"), ("2024-03-05 | 2023-01-01", "2024-03-05"), ("31/02/2024", None), ("nada", None)])
def test_norm_date(spark, text, value):
    assert str(one(spark, DT.norm_date("t"), t=text)) == str(value)


def test_long_dates(spark):
    text = "suscrito el 1 de enero de 2019 y firmado, 27 de SEPTIEMBRE de 2025; ver 3 de mayo de 1890"
    assert str(one(spark, DT.last_long_date("t"), t=text)) == "2025-09-27"
    assert str(one(spark, DT.norm_date_es("t"), t=text)) == "2019-01-01"
    assert one(spark, DT.last_long_date("t"), t="31 de abril de 2020") is None


@pytest.mark.parametrize("url,pid", [
    ("https://p.example/x?noticeUID=CO1.NTC.5405127&isModal=true", "CO1.NTC.5405127"), ("https://p.example/x?NOTICEUID=CO1.NTC.1", "CO1.NTC.1"),
    ("https://p.example/x?PPI=CO1.PPI.11758446&isFromPublicArea=True", "CO1.PPI.11758446"), ("https://p.example/CO1.PCCNTR.8930451/View", "CO1.PCCNTR.8930451"),
    ("https://p.example/x?noticeUID=zzz&a=CO1.REQ.9", "CO1.REQ.9"), ("https://p.example/x?PPI=CO1.PPI.1&noticeUID=CO1.NTC.2", "CO1.NTC.2"), ("https://p.example/", None), ("", None)])
def test_link_ids(spark, url, pid):
    assert one(spark, I.link_id("u"), u=url) == pid


def test_canonical_url_is_idempotent_and_drops_tracking(spark):
    url = "HTTPS://Portal.Example.org/Path?b=2&isModal=true&a=x%20y&b=3&Country=co&empty=#frag"
    out = one(spark, I.canonical_url("u"), u=url)
    assert out == "https://portal.example.org/Path?a=x+y&b=2"
    assert one(spark, I.canonical_url("u"), u=out) == out


@pytest.mark.parametrize("text,year,label", [("CONTRATO-ENT-0001-2024", None, "CONTRATO-ENT-0001-2024"), ("contrato ent 7 2022", None, "CONTRATO-ENT-0007-2022"),
                                             ("1", "2018", "CONTRATO-ENT-0001-2018"), ("1", None, None), ("0", "2018", None), ("100000", "2018", None), ("x", "2018", None)])
def test_sequence_labels(spark, text, year, label):
    assert one(spark, I.norm_sequence("t", "y", "CONTRATO-ENT"), t=text, y=year) == label


@pytest.mark.parametrize("text,year,label", [("contrato ent 100001-1999", "1999", None), ("contrato ent 1000001 1999", None, None), ("CONTRATO-ENT 1234567890", None, None),
                                             ("contrato ent 99999-1999", None, "CONTRATO-ENT-99999-1999"), ("CONTRATO-ENT00072022", None, "CONTRATO-ENT-0007-2022"),
                                             ("contrato ent 7-2022 2023", None, "CONTRATO-ENT-0007-2022"), ("3000000000", "2018", None)])
def test_long_numbers_are_not_cut(spark, text, year, label):
    assert one(spark, I.norm_sequence("t", "y", "CONTRATO-ENT"), t=text, y=year) == label


def test_parties_and_flags(spark):
    assert one(spark, I.party_nature("t"), t="nit") == "Jurídica" and one(spark, I.party_nature("t"), t="cc") == "Natural"
    assert one(spark, I.party_group("t"), t="Unión Temporal X") == "Unión Temporal" and one(spark, I.party_group("t"), t="Acme") == "No"
    assert one(spark, I.yes_no("t"), t="TRUE") == "Sí" and one(spark, I.yes_no("t"), t="0") == "No" and one(spark, I.yes_no("t"), t="") is None


def test_taxid_match(spark):
    assert one(spark, I.taxid_match("a", "b"), a="NIT: 0901148337", b="901148337-1") is True
    assert one(spark, I.taxid_match("a", "b"), a="123", b="999") is False
    assert one(spark, I.taxid_match("a", "b"), a="", b="999") is None


@pytest.mark.parametrize("a,b,same", [("NIT: 00900.008122", "12", False), ("12", "900008122", False), ("12", "012", True), ("900008122", "900008122-7", True), ("800000999", "999", True)])
def test_taxid_fragments_do_not_match(spark, a, b, same):
    assert one(spark, I.taxid_match("a", "b"), a=a, b=b) is same


def test_flatten_url_and_labels(spark):
    assert one(spark, TX.flatten_url("t"), t='{"url": "https://a.b"}') == "https://a.b"
    assert one(spark, TX.flatten_url("t"), t="https://a.b") == "https://a.b"
    assert one(spark, TX.leading_number("t"), t="35A. ADICIONES") == "35A" and one(spark, TX.leading_number("t"), t="LINK") is None


def test_natural_order(spark):
    d = spark.createDataFrame([(x,) for x in ["35B", "otro", "4", "35A", "12", "27"]], "l string")
    assert [r.l for r in d.orderBy(TX.natural_key("l")).collect()] == ["4", "12", "27", "35A", "35B", "otro"]


@pytest.mark.parametrize("a,b,same", [("GERMAN BOTERO", "Germán  Botero", True), ("Botero", "German Botero", True), ("a b c d e f g", "g f e d c b x", True),
                                      ("uno dos", "tres cuatro", False), ("", "x", False)])
def test_text_match(spark, a, b, same):
    assert one(spark, Q.text_match("a", "b"), a=a, b=b) is same


def test_percent_rounding_is_exact(spark):
    d = spark.sql("select cast('810041.21' as decimal(38,2)) p, cast('1514520.34' as decimal(38,2)) w, cast(1 as decimal(38,2)) a, cast(800 as decimal(38,2)) b, cast(0 as decimal(38,2)) z")
    r = d.select(M.percent_of("p", "w").alias("x"), M.percent_of("a", "b").alias("y"), M.percent_of("a", "z").alias("z")).first()
    assert (r.x, r.y, r.z) == (Decimal("53.49"), Decimal("0.12"), None)


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=12), st.text("abcd ", min_size=1, max_size=30))
def test_best_window_matches_brute_force(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for cx in x:
            prev = 0
            for j, cy in enumerate(y, 1):
                prev, row[j] = row[j], prev + 1 if cx == cy else max(row[j], row[j - 1])
        return row[-1]

    best = 0.0
    for s in range(-len(short) + 1, len(long)):
        w = long[max(s, 0):s + len(short)]
        best = max(best, 2 * lcs(short, w) / (len(short) + len(w)))
    assert abs(best - _best_window(short, long)) < 1e-12


def test_best_window_over_word_size():
    a = "x" * 70 + "abc"
    assert _best_window(a, "zz" + a + "yy") == 1.0
    assert _best_window("ab" * 40, "ba" * 60) == 1.0


def test_jaro_winkler_vectors():
    assert round(_jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(_jaro_winkler("dwayne", "duane"), 4) == 0.84
    assert _jaro_winkler("", "a") == 0.0 and _jaro_winkler("x", "x") == 1.0


@settings(max_examples=20, deadline=None)
@given(st.decimals(min_value=0, max_value=10**9, places=2))
def test_norm_for_compare_is_symmetric(spark, n):
    d = spark.createDataFrame([(f"{n:.2f}", f"${n:,.2f}")], "a string, b string")
    r = d.select(norm_for_compare("a", F.lit("valor_total")).alias("a"), norm_for_compare("b", F.lit("valor_total")).alias("b")).first()
    assert r.a == r.b


def test_check_digit_reads_the_text_once(spark):
    d = spark.createDataFrame([("860.007.738-",), (" 901148337",), ("12345",), ("123456789012345678",), ("",), (None,), ("abc1234567",)], "t string").select(I.check_digit("t").alias("dv"))
    assert [r["dv"] for r in d.collect()] == ["9", "1", None, "2", None, None, None]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("reverse(") <= 1
