import pytest

from scenelake.plans.query_plan import QueryPlan
from scenelake.service import NotFound, Service, build, checked
from tests.test_sources import SAMPLE

META = "tmdb_id string, title string, original_title string, overview string, release_date string, genres array<string>, directors array<string>, cast array<struct<name:string,character:string>>, poster_url string, tmdb_url string, wiki_plot string, fetched_at timestamp"


def test_build_and_query(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "test-movie-1999.txt").write_text(SAMPLE)
    (src / "broken.pdf").write_bytes(b"x")
    meta = [("0", "Test Movie", "Test Movie", "A keeper guards a lamp.", "1999-01-01", ["Drama"], ["Ana Silva"], [("Tom Hanks", "Mara Quinn")], None, None, None, None)]
    spark.createDataFrame(meta, META).write.parquet(store + "/metadata")
    wrote = build(spark, str(src), store)
    assert wrote["manifest"] == 2 and wrote["rejects"] == 1 and wrote["scenes"] == 3
    before = spark.read.parquet(store + "/documents").count()
    assert build(spark, str(src), store, ("convert", "parse", "index"), incremental=True)["documents"] == 0
    assert spark.read.parquet(store + "/documents").count() == before
    s = Service(spark, store)
    assert s.status() == {"status": "ok", "movies": 1, "full_index": True}
    top = s.query("about the light", mode="bm25", intents="dialogue").first()
    assert top.title == "Test Movie" and top.scene_ids[0] == "test_movie_scene_001"
    assert s.search("lamp keeper", QueryPlan("plot_level", ["plot"]), "bm25").first().movie_id == "0"
    assert s.movie("0")["title"] == "Test Movie" and s.movies().count() == 1
    with pytest.raises(NotFound):
        s.movie("5")
    with pytest.raises(NotFound):
        build(spark, str(src), store, ("dance",))


def test_bounds():
    for bad in (("", 5, "bm25"), ("x", 0, "bm25"), ("x", 21, "bm25"), ("x", 5, "magic")):
        with pytest.raises(ValueError):
            checked(*bad)
