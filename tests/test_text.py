import difflib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenelake.functions import text as X


def rows(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_tokenisers_equal_plain_python(spark):
    texts = ["Él dijo: “no”, foo_bar 42!", "", "A-b  c", "naïve café\tx y", "日本 語", "́x²"]
    got = rows(spark, texts).select("x", X.tokens_ascii("x").alias("a"), X.tokens_unicode("x").alias("u")).collect()
    for r in got:
        assert r.a == re.sub("[^a-z0-9 ]", " ", r.x.lower()).split()
        assert r.u == re.sub(r"[^\w\s]", " ", r.x.lower()).split()
    assert rows(spark, [None]).select(X.tokens_ascii("x").alias("a")).first().a is None


def plain_undouble(line):
    chars = [c for c in line if not c.isspace()]
    if len(chars) < 8 or len(chars) % 2 or sum(chars[i] == chars[i + 1] for i in range(0, len(chars), 2)) / (len(chars) // 2) < 0.8:
        return line
    return re.sub(r"([^ ]).?", r"\1", line)


def test_doubled_lines(spark):
    lines = ["SSaallmmoonn  RReevv", "bookkeeper", "aabbccdd", "aabbccde", "aabbccddxy", "x", "", "  IINNTT..  HHAALLLL"]
    for r in rows(spark, lines).select("x", X.undouble("x").alias("y")).collect():
        assert r.y == plain_undouble(r.x), r.x


def test_punctuation_stars_pages_and_continued(spark):
    r = rows(spark, ["“It’s” – a — b… �"]).select(X.fold_punctuation("x").alias("y")).first()
    assert r.y == "\"It's\" - a -- b... '"
    assert rows(spark, ["He runs.      *  "]).select(X.strip_star("x").alias("y")).first().y == "He runs."
    got = {r.x: (r.a, r.b) for r in rows(spark, ["CONTINUED", "(CONTINUED)", "CONTINUED: (3)", "CONTINUED:", "CONT'D", " 12. ", "12 men"]).select("x", X.is_continued("x").alias("a"), X.is_continued("x", "ingest").alias("b")).collect()}
    assert [k for k, v in got.items() if v[0]] == ["CONTINUED", "(CONTINUED)", "CONTINUED: (3)"]
    assert [k for k, v in got.items() if v[1]] == ["CONTINUED:", "CONT'D"]
    assert rows(spark, ["THE FILM   12."]).select(X.header_base("x").alias("y")).first().y == "THE FILM"


def test_scene_numbers(spark):
    got = [r.y for r in rows(spark, ["   2D   INT. HALL - DAY     2D", "INT. HALL - DAY", "He had 3 INTs"]).select(X.strip_scene_number("x").alias("y")).collect()]
    assert got == ["   INT. HALL - DAY", "INT. HALL - DAY", "He had 3 INTs"]


def test_headings_and_speakers(spark):
    got = [tuple(r.p) for r in rows(spark, ["INT./EXT. CAR/PARKING LOT - CONTINUOUS", "EXT. ROAD", "INT. HOUSE - HALL - NIGHT"]).select(X.heading_parts("x").alias("p")).collect()]
    assert got == [("INT", "CAR/PARKING LOT", "CONTINUOUS"), ("EXT", "ROAD", "UNSPECIFIED"), ("INT", "HOUSE - HALL", "NIGHT")]
    names = ["MARA", "MARA (V.O.)", "CUT TO", "INT. HALL", "A VERY LONG NAME INDEED", "Mara", "MR. O'NEIL #2", ""]
    assert [r.y for r in rows(spark, names).select(X.is_speaker("x").alias("y")).collect()] == [True, True, False, False, False, False, True, False]


def test_sentences_keep_abbreviations(spark):
    assert rows(spark, ["Mr. Smith runs.\n He falls! then Dr. No waits. End"]).select(X.sentences("x").alias("y")).first().y == ["Mr. Smith runs.", "He falls! then Dr. No waits.", "End"]


def test_names_titles_and_links(spark):
    r = rows(spark, ["NEO (V.O.)"]).select(X.plain_name("x").alias("a"), X.name_tokens("x").alias("b")).first()
    assert (r.a, r.b) == ("neo", ["neo"])
    got = {r.x: (r.t, r.s, r.y) for r in rows(spark, ["kill-time-vol-1-2003.pdf", "2012.html", "the-road-of-x.txt", "a-b-19991.pdf"]).select("x", X.file_title("x").alias("t"), X.file_slug("x").alias("s"), X.file_year("x").alias("y")).collect()}
    assert got["kill-time-vol-1-2003.pdf"] == ("Kill Time Vol 1", "kill_time_vol_1", "2003")
    assert got["2012.html"][:2] == ("2012", "2012")
    assert got["the-road-of-x.txt"][0] == "The Road of X" and got["a-b-19991.pdf"][2] is None
    links = ["https://v.example/?v=1&t=1h2m3s", "https://v.example/?t=90", "https://v.example/?start=5m", "https://v.example/"]
    assert [r.y for r in rows(spark, links).select(X.link_seconds("x").alias("y")).collect()] == [3723, 90, 300, 0]


def test_wikitext(spark):
    text = "== Plot ==\n'''A''' {{x|{{y}}}} [[b|c]] [[d]]<ref>z</ref> [[File:q.png|thumb]] <b>e</b>"
    assert rows(spark, [text]).select(X.wikitext_plain("x").alias("y")).first().y == "Plot\nA c d e"


def test_ellipsis_and_candidate_id(spark):
    r = rows(spark, ["one  two three"]).select(X.ellipsis("x", 9).alias("a"), X.ellipsis("x", 50).alias("b"), X.candidate_id(F.lit("m"), F.lit("c")).alias("c")).first()
    assert r.a == "one two…" and r.b == "one two three" and len(r.c) == 15


def test_routing(spark):
    got = [r.y for r in rows(spark, ['"open the door"', "he says hello", "a dark room", "people running", "meaning of life", "nothing", "the synopsis"]).select(X.route_field("x").alias("y")).collect()]
    assert got == ["dialogue", "dialogue", "visual", "action", "thematic", "action", "plot"]


def test_scene_texts(spark):
    d = [("A", "one", None), ("B", "two", None), ("A", "three", None), ("", "x", None), ("C", None, None)]
    df = spark.createDataFrame([("INT. X", ["He runs.", None, ""], d), (None, None, None)], "heading string, action_lines array<string>, dialogue array<struct<character:string,line:string,parenthetical:string>>")
    r, n = df.select(X.scene_text().alias("s"), X.dialogue_text().alias("d"), X.character_text().alias("c"), X.full_text().alias("f"), X.speakers().alias("w")).collect()
    assert (r.s, r.d, r.c) == ("INT. X He runs.", "A: one B: two A: three", "A: one three | B: two")
    assert r.f == "INT. X He runs. A: one B: two A: three" and r.w == ["A", "B", "C"]
    assert (n.s, n.d, n.f) == ("", "", "")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abc \n.", max_size=30), min_size=1, max_size=5))
def test_ellipsis_never_exceeds(spark, texts):
    for r in rows(spark, texts).select(X.ellipsis("x", 10).alias("y")).collect():
        assert len(r.y) <= 10
