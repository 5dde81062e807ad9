import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from soundlattice.functions import text as T


@pytest.mark.parametrize(("name", "key"), [("A.B.C. & D$ (Live)", "a_b_c-and-d_"), ("Beyoncé – Halo", "beyonce–halo"), ("  Mr. X [demo]  ", "mr-x"), ("a - b", "a-b"), ("℮", "e")])
def test_name_key(name, key):
    assert T.name_key(name) == key


@given(st.text())
def test_name_key_properties(name):
    key = T.name_key(name)
    assert not set(key) & set(" .&$()[]")


def rows(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_fields_years_lists(spark):
    assert rows(spark, ["Song (Remix) feat. X", "Song featuring X", "", None, " a  b ft x"], T.process_field) == ["Song", "Song featuring X", None, None, "a b"]
    assert rows(spark, ["2020", "2020-05-01", "01-05-2020", "2020/05", None, "20"], T.extract_year) == ["2020", "2020", "2020", None, None, None]
    assert rows(spark, ["[]", '[" "]', "{}", "bad", "[null]", None, '["a"]'], lambda c: T.is_missing(T.load_list(c))) == [True, True, True, True, False, True, False]
    assert rows(spark, [" A,\tb ,C"], T.split_tags) == [["a", "b", "c"]]
    assert rows(spark, ["x.MP3", "mp3", "a.flac.txt", "a.Flac", None], T.allowed_file) == [True, False, False, True, None]
    assert rows(spark, ["Beyoncé", None], T.process_name) == ["beyonce", None]


def test_html_text(spark):
    page = '<p><span class="x genre y">Rock,\n Pop</span><span class="other">no</span><span class=\'genre\'>b'
    assert rows(spark, [page + "</span>", None], lambda c: T.html_text(c, "span", "genre")) == [["Rock,\n Pop", "b"], None]


def test_plain_names_have_the_same_key_in_both_engines(spark):
    r = random.Random(2)
    names = ["".join(r.choice("aB.c&$()[]- –é\t\n\r\x0b\x1c_1!,' x") for _ in range(r.randrange(14))) for _ in range(3000)]
    assert rows(spark, names, T.process_name) == [T.name_key(n) for n in names]
