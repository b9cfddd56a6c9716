"""Screenplay text to clean lines to scenes, with windows over line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.functions import text as X

ACTION, DIALOGUE, PARENTHETICAL, CHARACTER = 0, 10, 15, 25
NAME_INDENT, SPEECH_INDENT = 20, 10
REPEATS, SHARE = 10, 0.02
INGEST_COLUMNS = (0, 12, 15, 25, 45)  # fixed


def lines(texts: DataFrame, key: str = "slug", text: str = "text") -> DataFrame:
    """(slug, line_no, line): every line of every text; all Unicode line ends count."""
    return texts.select(F.col(key).alias("slug"), F.posexplode(F.split(F.col(text), "\\R|[\\x1c-\\x1e]")).alias("line_no", "line"))


def _indent(line="line"):
    return F.length(line) - F.length(F.ltrim(line))


def cleaned(rows: DataFrame, profile: str = "convert") -> DataFrame:
    """Lines with punctuation folded, doubled characters undone, revision marks, page numbers, headers and scene numbers out, columns made canonical, blank runs cut to two."""
    if profile not in ("convert", "ingest"):
        raise ValueError(profile)
    rows = rows.withColumn("line", X.strip_star(X.undouble(X.fold_punctuation("line"))))
    base = F.when(~X.is_page_number("line"), X.header_base("line"))
    rows = rows.withColumn("base", base)
    repeated = rows.where("base is not null").groupBy("slug", "base").agg(F.count("*").alias("n")).where(F.col("n") > REPEATS).select("slug", "base", F.lit(True).alias("header"))
    if profile == "ingest":
        rows = rows.withColumn("base", F.coalesce("base", F.trim("line")))
    rows = rows.join(repeated, ["slug", "base"], "left")
    keep = (F.trim("line") == "") | ~(X.is_page_number("line") | X.is_continued("line", profile) | F.coalesce("header", F.lit(False)))
    rows = rows.where(keep).select("slug", "line_no", X.strip_scene_number("line", profile).alias("line"))
    rows = remapped(rows, profile)
    return without_blank_runs(rows.withColumn("line", F.rtrim("line")), "slug")


def without_blank_runs(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line) with at most two blank lines running."""
    w = Window.partitionBy(key).orderBy("line_no")
    run = rows.withColumn("solid", F.sum((F.col("line") != "").cast("int")).over(w))
    blank = Window.partitionBy(key, "solid").orderBy("line_no")
    numbered = run.withColumn("nth", F.row_number().over(blank) - F.when(F.col("solid") > 0, 1).otherwise(0))
    return numbered.where((F.col("line") != "") | (F.col("nth") <= 2)).select(key, "line_no", "line")


def remapped(rows: DataFrame, profile: str = "convert") -> DataFrame:
    """Lines moved to the canonical columns; other indents go the way of the nearest significant one.

    The convert profile moves a text whose names stand further right than the
    canonical column: the rightmost level to names, those in the right half to
    speech. The ingest profile moves a text whose second level from the right is at
    20 or more: its levels from the left become INGEST_COLUMNS.
    """
    rows = rows.withColumn("indent", F.when(F.trim("line") == "", 0).otherwise(_indent()))
    counts = rows.where("indent > 0").groupBy("slug", "indent").agg(F.count("*").alias("n"))
    total = counts.groupBy("slug").agg(F.sum("n").alias("total"))
    levels = counts.join(total, "slug").where(F.col("n") >= SHARE * F.col("total")).groupBy("slug").agg(F.sort_array(F.collect_list("indent")).alias("levels"))
    if profile == "ingest":
        levels = levels.where((F.size("levels") >= 2) & (F.try_element_at("levels", F.lit(-2)) >= NAME_INDENT))
        joined = rows.join(levels, "slug", "left")
        gaps = F.transform("levels", lambda v, i: F.struct(F.abs(v - F.col("indent")).alias("d"), i.alias("i")))
        columns = F.array(*map(F.lit, INGEST_COLUMNS))
        to = F.element_at(columns, (F.least(F.array_min(gaps)["i"], F.lit(len(INGEST_COLUMNS) - 1)) + 1).cast("int"))
        moved = F.concat(F.repeat(F.lit(" "), to), F.ltrim("line"))
        return joined.select("slug", "line_no", F.when(F.col("levels").isNotNull() & (F.col("indent") > 0), moved).otherwise(F.col("line")).alias("line"))
    levels = levels.where((F.size("levels") >= 2) & (F.element_at("levels", -1) > CHARACTER))
    joined = rows.join(levels, "slug", "left")
    nearest = F.array_min(F.transform("levels", lambda v: F.struct(F.abs(v - F.col("indent")).alias("d"), v.alias("v"))))["v"]
    top = F.element_at("levels", -1)
    to = F.when(nearest == top, CHARACTER).when(nearest > top / 2, DIALOGUE).otherwise(ACTION)
    moved = F.concat(F.repeat(F.lit(" "), to), F.ltrim("line"))
    return joined.select("slug", "line_no", F.when(F.col("levels").isNotNull() & (F.col("indent") > 0), moved).otherwise(F.col("line")).alias("line"))


def scenes(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Scenes of clean lines: spans from heading to heading, split into action and dialogue.

    A line is an event: a speaker's name begins a speech, a line of action ends
    it; the state of a line is the last event before it. Layout is read off a scene with
    three names or more, else off the whole text. ids has (slug, movie_id).
    """
    w = Window.partitionBy("slug").orderBy("line_no")
    marked = rows.withColumn("head", X.is_heading("line")).withColumn("scene_number", F.sum(F.col("head").cast("int")).over(w)).where("scene_number > 0")
    heads = marked.where("head").select("slug", "scene_number", F.trim("line").alias("heading"))
    body = marked.where("not head").withColumn("indent", _indent()).withColumn("name", X.is_speaker("line"))
    level = lambda rows, by: rows.where("name").groupBy(*by, "indent").agg(F.count("*").alias("n"), F.min("line_no").alias("first")).groupBy(*by).agg(
        F.sum("n").alias("names"), F.sum(F.when(F.col("indent") >= NAME_INDENT, F.col("n")).otherwise(0)).alias("standard"), F.max_by("indent", F.struct("n", -F.col("first"))).alias("usual")
    ).select(*by, "names", F.when(F.col("standard") >= 0.7 * F.col("names"), NAME_INDENT).otherwise(F.col("usual")).alias("level"))
    whole = level(body, ["slug"]).select("slug", F.col("level").alias("file_level"))
    own = level(body, ["slug", "scene_number"]).where("names >= 3").select("slug", "scene_number", F.col("level").alias("own_level"))
    body = body.join(whole, "slug", "left").join(own, ["slug", "scene_number"], "left").withColumn("level", F.coalesce("own_level", "file_level", F.lit(NAME_INDENT)))
    loose, blank = F.col("level") < NAME_INDENT, F.trim("line") == ""
    paren = F.col("line").rlike(r"^\s*\([^)]+\)\s*$")
    event = (
        F.when(blank, F.when(loose, "A"))
        .when(F.col("indent") >= NAME_INDENT, F.when(F.col("name"), "C").otherwise("A"))
        .when(loose & (F.col("indent") >= F.col("level")) & F.col("name"), "C")
        .when(~loose & (F.col("indent") < SPEECH_INDENT) & ~paren, "A")
    )
    s = Window.partitionBy("slug", "scene_number").orderBy("line_no")
    upto = s.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = body.withColumn("event", event).withColumn("state", F.coalesce(F.last("event", True).over(upto), F.lit("A")))
    body = body.withColumn("speech", F.sum((F.coalesce("event", F.lit("")) == "C").cast("int")).over(upto))
    # Blocks of action are parted by blank lines and speakers.
    body = body.withColumn("block", F.sum((blank | (F.coalesce("event", F.lit("")) == "C")).cast("int")).over(upto))
    text = F.trim("line")
    # Notes of a second column are taken out of speeches; a line that was nothing else goes.
    said = body.where((F.col("state") == "C") & ~blank).withColumn("line", F.when(F.col("event").isNull(), X.strip_dual_column("line")).otherwise(F.col("line"))).where(F.trim("line") != "")
    speeches = said.groupBy("slug", "scene_number", "speech").agg(
        F.min("line_no").alias("at"), F.first(F.when(F.col("event") == "C", F.trim(F.regexp_replace(text, r"\s*\(.*?\)\s*$", ""))), True).alias("character"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event").isNull() & ~paren, F.struct("line_no", text.alias("t"))))), lambda x: x["t"]), " ").alias("line"),
        F.max_by(F.when(paren & F.col("event").isNull(), F.trim(F.regexp_replace(text, r"^\(+|\)+$", ""))), F.when(paren & F.col("event").isNull(), F.col("line_no"))).alias("parenthetical"),
    ).where("line <> ''")
    dialogue = speeches.groupBy("slug", "scene_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "character", "line", "parenthetical"))), lambda d: F.struct(d["character"].alias("character"), d["line"].alias("line"), d["parenthetical"].alias("parenthetical"))).alias("dialogue"))
    acts = body.where((F.col("state") == "A") & ~blank).groupBy("slug", "scene_number", "block").agg(F.min("line_no").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    split = acts.select("slug", "scene_number", "at", F.filter(X.sentences("text"), lambda x: X.enough_letters(x)).alias("lines"))
    actions = split.groupBy("slug", "scene_number").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "lines"))), lambda x: x["lines"])).alias("action_lines"))
    out = heads.join(actions, ["slug", "scene_number"], "left").join(dialogue, ["slug", "scene_number"], "left")
    empty = "array<struct<character:string,line:string,parenthetical:string>>"
    out = out.withColumn("action_lines", F.coalesce("action_lines", F.array().cast("array<string>"))).withColumn("dialogue", F.coalesce("dialogue", F.array().cast(empty)))
    out = out.join(ids.select("slug", "movie_id"), "slug", "left") if ids is not None else out.withColumn("movie_id", F.lit(None).cast("string"))
    parts = X.heading_parts("heading")
    return out.select(
        X.scene_id("slug", "scene_number").alias("scene_id"), "movie_id", F.col("scene_number").cast("int").alias("scene_number"), "heading", parts["int_ext"].alias("int_ext"), parts["location"].alias("location"),
        parts["time_of_day"].alias("time_of_day"), X.speakers().alias("characters"), X.word_count().alias("word_count"), "action_lines", "dialogue", "slug",
    )
