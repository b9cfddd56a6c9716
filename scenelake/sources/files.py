"""Screenplay files, manifests and metadata as tables, and the sinks that keep them."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.functions import text as X

ENDINGS = (".pdf", ".html", ".htm", ".txt")
LEAST_MEAN_LINE = 20
METADATA = (
    "tmdb_id string, title string, original_title string, overview string, release_date string, runtime_minutes int, genres array<string>, original_language string, popularity double, "
    "vote_average double, vote_count int, directors array<string>, cast array<struct<name:string,character:string>>, poster_url string, tmdb_url string, wiki_plot string"
)
SCENE = (
    "scene_id string, movie_id string, scene_number int, heading string, int_ext string, location string, time_of_day string, characters array<string>, word_count int, "
    "action_lines array<string>, dialogue array<struct<character:string,line:string,parenthetical:string>>"
)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, content) of the files with a known ending, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content").where(F.regexp_extract(F.lower("filename"), r"(\.[^.]*)$", 1).isin(*ENDINGS))


class _Page(HTMLParser):
    """Text of a page: of its <pre> blocks if there are any, else of the body with <br> as line ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pre, self.body, self.depth, self.skip = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "pre":
            self.depth += 1
            self.pre.append("")
        elif tag in ("script", "style", "head"):
            self.skip += 1
        elif tag == "br":
            self.body.append("\n")
        elif tag in ("p", "div", "li", "tr", "h1", "h2", "h3"):
            self.body.append("\n")

    def handle_endtag(self, tag):
        if tag == "pre" and self.depth:
            self.depth -= 1
        elif tag in ("script", "style", "head") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if self.skip:
            return
        if self.depth:
            self.pre[-1] += data
        self.body.append(data)


def html_text(markup: str, check_pre: bool = False) -> str:
    """Text of a page; ValueError if its lines are so short that it cannot be a screenplay (unchecked for <pre> by default)."""
    page = _Page()
    page.feed(markup)
    text = "\n".join(page.pre) if page.pre else "".join(page.body).replace("\xa0", " ")
    lines = [x for x in text.splitlines() if x.strip()]
    if (not page.pre or check_pre) and (not lines or sum(map(len, lines)) / len(lines) < LEAST_MEAN_LINE):
        raise ValueError("mean line too short")
    return text


def decoded(raw: bytes) -> str:
    """UTF-8 (with or without mark), UTF-16 by its mark, else Windows-1252 where every byte has a character, else UTF-8 with replacements."""
    for mark, page in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(page, "replace")
    for page in ("utf-8", "cp1252"):
        try:
            return raw.decode(page)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def extract(files: DataFrame, pdf: Callable[[bytes], str] | None = None, check_pre: bool = False) -> DataFrame:
    """(filename, text, error): text of every file; what cannot be read has the reason in error. PDF needs a provider."""

    def run(batches):
        for batch in batches:
            out = []
            for name, raw in zip(batch["filename"], batch["content"]):
                try:
                    low = name.lower()
                    if low.endswith(".pdf"):
                        if pdf is None:
                            raise ValueError("no PDF provider")
                        text = pdf(bytes(raw))
                    elif low.endswith(".txt"):
                        text = decoded(bytes(raw))
                    else:
                        text = html_text(decoded(bytes(raw)), check_pre)
                    out.append((name, text, None))
                except Exception as e:  # one bad file must not end the job
                    out.append((name, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["filename", "text", "error"])

    return files.select("filename", "content").mapInPandas(run, "filename string, text string, error string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, tmdb_id, title, slug) from a JSON object keyed by file name."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<tmdb_id:string,title:string,slug:string>>")
    return raw.select(F.explode(entries).alias("filename", "e")).select("filename", "e.*")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON object keyed by file name; a manifest lists files by hand and so is small enough for one task."""
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("filename", F.struct("tmdb_id", "title", "slug")))))
    manifest.agg(F.to_json(entry).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with a slug from their file names; broken ones have _corrupt_record set."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("slug", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"^(.*?)_(?:scenes|metadata|characters)\.json$", 1))


def new_manifest_rows(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows for the files that the manifest lacks: id '0', title and slug from the name; a slug in use gets the first free of _2, _3 and so on."""
    fresh = files.select("filename").distinct().join(manifest.select("filename"), "filename", "left_anti").select("filename", X.file_title("filename").alias("title"), X.file_slug("filename").alias("base"))
    tail = F.expr("try_cast(nullif(regexp_extract(slug, '_([0-9]+)$', 1), '') as int)")
    used = manifest.select("slug").where("slug is not null").distinct()
    numbers = used.select(F.col("slug").alias("base"), F.lit(1).alias("n")).unionByName(used.select(F.regexp_replace("slug", r"_\d+$", "").alias("base"), tail.alias("n")).where("n > 1"))
    taken = numbers.groupBy("base").agg(F.collect_set("n").alias("taken"))
    w = Window.partitionBy("base").orderBy("filename")
    rows = fresh.join(taken, "base", "left").withColumn("k", F.row_number().over(w)).withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.col("k") + F.size("taken")), F.col("taken"))
    rows = rows.withColumn("n", F.element_at(free, F.col("k")))
    return rows.select("filename", F.lit("0").alias("tmdb_id"), "title", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("slug"))


def merged_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest with new files appended; existing rows stay as they are."""
    return manifest.select("filename", "tmdb_id", "title", "slug").unionByName(new_manifest_rows(files, manifest))


def resolve_ids(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """The manifest with ids written back where they were unresolved; found has (filename, tmdb_id)."""
    new = found.groupBy("filename").agg(F.min("tmdb_id").alias("new_id"))
    bad = F.trim(F.coalesce("tmdb_id", F.lit(""))).isin("", "0")
    return manifest.join(new, "filename", "left").withColumn("tmdb_id", F.when(bad, F.coalesce("new_id", "tmdb_id")).otherwise(F.col("tmdb_id"))).drop("new_id")


def upsert_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """New records over old ones by tmdb_id; a plot that only the old one has is kept."""
    columns = [c for c in new.columns if c != "tmdb_id"]
    a, b = old.select("tmdb_id", *(F.col(c).alias(f"_old_{c}") for c in columns), F.lit(True).alias("_was")), new.withColumn("_is", F.lit(True))
    both = b.join(a, "tmdb_id", "full_outer")
    pick = lambda c: F.coalesce(c, f"_old_{c}") if c == "wiki_plot" else F.when(F.col("_is"), F.col(c)).otherwise(F.col(f"_old_{c}"))
    return both.select("tmdb_id", *(pick(c).alias(c) for c in columns))


def search_title(metadata: DataFrame, wanted: DataFrame) -> DataFrame:
    """(title, year, tmdb_id): an exact lower-case title of the year first, then of any year, then the most popular that holds it."""
    known = metadata.select("tmdb_id", F.lower("title").alias("known"), F.substring("release_date", 1, 4).alias("of"), "popularity").distinct()
    from scenelake.operators.search import small

    asked = wanted.select("title", "year").distinct()
    pairs = known.join(small(asked), F.contains("known", F.lower("title")))
    level = F.when((F.col("known") == F.lower("title")) & (F.col("of") == F.col("year")), 0).when(F.col("known") == F.lower("title"), 1).otherwise(2)
    w = Window.partitionBy("title", "year").orderBy(level, F.desc_nulls_last("popularity"), "tmdb_id")
    return pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select("title", "year", "tmdb_id")


def plot_pages(title: str, year: str | None) -> list[str]:
    """Page names to try for a film's plot, likeliest first."""
    return ([f"{title} ({year} film)"] if year else []) + [f"{title} (film)", title]


def detail_record(payload: str) -> dict:
    """A metadata record from the service's JSON: directors from the crew, cast in order."""
    d = json.loads(payload)
    credits = d.get("credits") or {}
    return {
        "tmdb_id": str(d.get("id")), "title": d.get("title"), "original_title": d.get("original_title"), "overview": d.get("overview"), "release_date": d.get("release_date"), "runtime_minutes": d.get("runtime"),
        "genres": [g["name"] for g in d.get("genres") or []], "original_language": d.get("original_language"), "popularity": d.get("popularity"), "vote_average": d.get("vote_average"), "vote_count": d.get("vote_count"),
        "directors": [c["name"] for c in credits.get("crew") or [] if c.get("job") == "Director"], "cast": [{"name": c.get("name"), "character": c.get("character")} for c in credits.get("cast") or []],
        "poster_url": d.get("poster_path"), "tmdb_url": d.get("homepage"),
    }
