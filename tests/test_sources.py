import os

from pyspark.sql import functions as F

from scenelake.operators import audit as A
from scenelake.sources import files as L
from scenelake.sources import screenplay as Y
from scenelake.streaming import ingest as G

SAMPLE = "\n".join([
    "FADE IN:", "", "INT. LIGHTHOUSE - NIGHT", "", "The lamp turns. Mara climbs the", "stairs.", "", " " * 25 + "MARA (V.O.)", " " * 10 + "It was never", " " * 10 + "about the light.", "",
    " " * 25 + "OTTO", " " * 15 + "(quietly)", " " * 10 + "It was.", "", "EXT. CLIFF - DAY", "", "Waves break on it.", "Otto waits for Mr. Grey.", "", "INT. KITCHEN", "", "Nobody.", "",
])


def test_parse_sample(spark):
    texts = spark.createDataFrame([("test_movie", SAMPLE), ("empty", None)], "slug string, text string")
    got = Y.scenes(Y.cleaned(Y.lines(texts))).orderBy("scene_number").collect()
    assert [s.scene_id for s in got] == ["test_movie_scene_001", "test_movie_scene_002", "test_movie_scene_003"]
    one = got[0]
    assert (one.int_ext, one.location, one.time_of_day) == ("INT", "LIGHTHOUSE", "NIGHT")
    assert one.action_lines == ["The lamp turns.", "Mara climbs the stairs."]
    assert [(d.character, d.line, d.parenthetical) for d in one.dialogue] == [("MARA", "It was never about the light.", None), ("OTTO", "It was.", "quietly")]
    assert one.characters == ["MARA", "OTTO"] and one.word_count == 15
    assert "Otto waits for Mr. Grey." in got[1].action_lines and got[2].time_of_day == "UNSPECIFIED"


def test_headers_and_blank_runs(spark):
    text = "\n".join([f"THE FILM   {n}.\nline {n} of text here\n\n\n\n\n" for n in range(12)])
    got = [r.line for r in Y.cleaned(Y.lines(spark.createDataFrame([("s", text)], "slug string, text string"))).orderBy("line_no").collect()]
    assert not any("THE FILM" in x for x in got)
    assert max(len(list(g)) for g in "".join("b" if x == "" else "x" for x in got).split("x")) <= 2


def test_remap(spark):
    rows = [("s", i, " " * n + "word") for i, n in enumerate([0, 12, 12, 36, 36, 20, 21])]
    got = [len(r.line) - 4 for r in Y.remapped(spark.createDataFrame(rows, "slug string, line_no int, line string")).orderBy("line_no").collect()]
    assert got == [0, 0, 0, 25, 25, 10, 10]


def test_files(spark, tmp_path):
    (tmp_path / "a-film-1999.txt").write_bytes("Café — 5 £\nline".encode("cp1252"))
    (tmp_path / "b.HTML").write_text("<html><body><pre>one\ntwo</pre></body></html>")
    (tmp_path / "c.htm").write_text("<p>x</p>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.doc").write_text("no")
    found = L.scan(spark, str(tmp_path))
    got = {r.filename: (r.text, r.error) for r in L.extract(found).collect()}
    assert set(got) == {"a-film-1999.txt", "b.HTML", "c.htm", "d.pdf"}
    assert got["a-film-1999.txt"][0].startswith("Café — 5 £") and got["b.HTML"][0] == "one\ntwo"
    assert got["c.htm"][1] == "mean line too short" and got["d.pdf"][1] == "no PDF provider"
    assert {r.filename: r.text for r in L.extract(found, pdf=lambda b: "text").collect()}["d.pdf"] == "text"
    man = spark.createDataFrame([("x.txt", "5", "A Film", "a_film")], "filename string, tmdb_id string, title string, slug string")
    merged = {r.filename: r.slug for r in L.merged_manifest(man, found.where("filename like 'a%'")).collect()}
    assert merged == {"x.txt": "a_film", "a-film-1999.txt": "a_film_2"}
    L.write_manifest(man, str(tmp_path / "manifest"))
    assert L.read_manifest(spark, str(tmp_path / "manifest")).first().slug == "a_film"


def test_upserts(spark):
    old = spark.createDataFrame([("1", "a", "plot"), ("2", "b", None)], "tmdb_id string, title string, wiki_plot string")
    new = spark.createDataFrame([("1", "A", None), ("3", "c", "p3")], "tmdb_id string, title string, wiki_plot string")
    assert sorted(tuple(r) for r in L.upsert_metadata(old, new).collect()) == [("1", "A", "plot"), ("2", "b", None), ("3", "c", "p3")]
    man = spark.createDataFrame([("f", "0", "t", "s"), ("g", "9", "t", "s2")], "filename string, tmdb_id string, title string, slug string")
    found = spark.createDataFrame([("f", "7"), ("g", "8")], "filename string, tmdb_id string")
    assert sorted((r.filename, r.tmdb_id) for r in L.resolve_ids(man, found).collect()) == [("f", "7"), ("g", "9")]


def test_incremental_equals_full(spark, tmp_path):
    docs = spark.createDataFrame([("scene", "1", "t"), ("scene", "2", "u"), ("plot", "1", "v")], "index string, doc_key string, text string")
    assert sorted(map(tuple, G.append_documents(docs.limit(1), docs).collect())) == sorted(map(tuple, docs.collect()))
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.range(100).write.parquet(src)
    assert G.run_available(spark, src, "id long", cp, G.parquet_sink(out)) == 100
    spark.range(100, 150).write.mode("append").parquet(src)
    assert G.run_available(spark, src, "id long", cp, G.parquet_sink(out)) == 50
    assert spark.read.parquet(out + "/batch=*").count() == 150


def test_audit(spark):
    man = spark.createDataFrame([("a-1990.txt", "1", "The Road", "a"), ("b.txt", "1", "Other", "a"), ("c.txt", "0", "C", "c")], "filename string, tmdb_id string, title string, slug string")
    meta = spark.createDataFrame([("1", "The Road", "1995-01-01", None, [], [], None)], "tmdb_id string, title string, release_date string, overview string, cast array<struct<name:string,character:string>>, directors array<string>, poster_url string").withColumn("genres", F.array(F.lit("x"))).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    got = {(r.check, r.severity, r.slug) for r in A.title_and_year(man, meta).collect()} | {(r.check, r.severity, r.slug) for r in A.duplicates(man).collect()} | {(r.check, r.severity, r.slug) for r in A.completeness(man, meta).collect()} | {(r.check, r.severity, r.slug) for r in A.missing_metadata(man, meta).collect()}
    assert {("title_mismatch", "CRITICAL", "a"), ("year_mismatch", "WARNING", "a"), ("duplicate_id", "CRITICAL", "a"), ("duplicate_slug", "CRITICAL", "a"), ("no_overview", "CRITICAL", "a"), ("no_cast", "CRITICAL", "a"), ("missing_metadata", "CRITICAL", "c")} <= got
    assert ("no_genres", "WARNING", "a") not in got
