"""Every query over the data folders by name, with the SQL it is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.functions import text as X
from scenelake.operators import audit as A
from scenelake.operators import entities as N
from scenelake.operators import index as I
from scenelake.operators import metrics as M
from scenelake.operators import registry as R
from scenelake.operators import rerank as K
from scenelake.operators import search as S
from scenelake.operators import video as V
from scenelake.plans import query_plan as P
from scenelake.runtime import cut, read, shared_dir
from scenelake.sources import files as L
from scenelake.sources import screenplay as Y
from scenelake.streaming import ingest as G

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# SQL that several queries share.
ASCII = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda t: t <> '')"
UNICODE = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
MEANT = "list_filter(dialogue, lambda d: coalesce(d.character, '') <> '' AND coalesce(d.line, '') <> '')"
LATEST_SCENES = "SELECT scene_id, arg_max(s, coalesce(s.ingested_at, TIMESTAMP '1970-01-01')) AS s FROM (SELECT scene_id, s FROM scenes s) GROUP BY scene_id"
SCENES = f"(SELECT s.* FROM ({LATEST_SCENES}))"
SCENE_TEXT = "array_to_string(list_filter(list_concat([heading], coalesce(action_lines, [])), lambda x: coalesce(x, '') <> ''), ' ')"
DIALOGUE_TEXT = f"coalesce(array_to_string(list_transform({MEANT}, lambda d: d.character || ': ' || d.line), ' '), '')"
SPEAKERS = f"list_transform({MEANT}, lambda d: d.character)"
DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
CHARACTER_TEXT = f"coalesce(array_to_string(list_transform({DISTINCT.format(SPEAKERS)}, lambda who: who || ': ' || array_to_string(list_transform(list_filter({MEANT}, lambda d: d.character = who), lambda d: d.line), ' ')), ' | '), '')"
FULL_TEXT = f"array_to_string(list_filter([heading, array_to_string(list_filter(coalesce(action_lines, []), lambda x: coalesce(x, '') <> ''), ' '), {DIALOGUE_TEXT}], lambda x: coalesce(x, '') <> ''), ' ')"
LATEST_METADATA = "(SELECT m.* FROM (SELECT tmdb_id, arg_max(m, (coalesce(m.fetched_at, TIMESTAMP '1970-01-01'), coalesce(m.title, ''))) AS m FROM (SELECT tmdb_id, m FROM metadata m WHERE tmdb_id IS NOT NULL) GROUP BY tmdb_id))"


def bm25_sql(docs: str, queries: str, tokens: str = ASCII) -> str:
    """CTEs ending in scored(query_id, doc_key, score) over docs(doc_key, text) and queries(query_id, query_text)."""
    return f"""
        docs AS ({docs}), asked AS (SELECT query_id, unnest({tokens.format('query_text')}) AS term FROM ({queries})),
        q AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
        t AS (SELECT doc_key, {tokens.format("coalesce(text, '')")} AS tokens FROM docs), size AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_dl FROM t),
        postings AS (SELECT doc_key, dl, term, count(*) AS tf FROM (SELECT doc_key, len(tokens) AS dl, unnest(tokens) AS term FROM t) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
        raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf, avg_dl FROM df, size), mean AS (SELECT avg(idf) AS mean_idf FROM raw),
        weights AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf, avg_dl FROM raw, mean),
        scored AS (SELECT query_id, doc_key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
                   FROM postings JOIN weights USING (term) JOIN q USING (term) GROUP BY query_id, doc_key)"""


DOCS = "SELECT doc_id AS doc_key, text FROM documents"
CASES = "SELECT item_id AS query_id, query_text FROM heldout_cases"
FIRST_CASE = "SELECT item_id AS query_id, query_text FROM heldout_cases WHERE item_id = (SELECT min(item_id) FROM heldout_cases)"
TOP = "SELECT query_id, doc_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM scored"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"), "text")


def cases(spark: SparkSession, sf: str, first: bool = False) -> DataFrame:
    rows = read(spark, sf, "heldout_cases").select(F.col("item_id").alias("query_id"), "query_text")
    return rows.orderBy("query_id").limit(1) if first else rows


_STORES: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, rows: DataFrame, unicode: bool = False) -> I.SparseIndex:
    """The sparse index over rows (doc_key, text), stored at its first use in an application as a build stores it."""
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _STORES:
        path = f"{shared_dir(spark)}/sparse-{uuid.uuid4().hex}"
        I.write_sparse(rows.withColumn("index", F.lit(name)), path, unicode=unicode)
        _STORES[at] = path
    return I.SparseIndex(spark, _STORES[at], unicode)


def bm25(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    """Scores of the documents for the asked (query_id, query_text) by the stored index."""
    return S.stored_scores(stored(spark, sf, "documents", docs(spark, sf)), asked.withColumn("index", F.lit("documents")))


# --- text -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({ASCII.format('text')}) AS n_tokens, md5(array_to_string({ASCII.format('text')}, ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def tokenize_ascii(spark, sf):
    t = X.tokens_ascii("text")
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"SELECT doc_id, len({UNICODE.format('text')}) AS n_tokens, md5(array_to_string({UNICODE.format('text')}, ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def tokenize_unicode(spark, sf):
    t = X.tokens_unicode("text")
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"SELECT count(*) AS n_docs, round(avg(len({ASCII.format("coalesce(text, '')")})), 6) AS avg_dl FROM documents")
def doc_lengths(spark, sf):
    rows = docs(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    return I.lengths(rows, ["doc_key"], []).select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({ASCII.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf):
    return I.document_frequencies(docs(spark, sf), ["doc_key"], [])


@query(f"SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len({ASCII.format('text')}) AS dl, unnest({ASCII.format('text')}) AS term FROM documents) GROUP BY ALL")
def postings(spark, sf):
    return I.postings(read(spark, sf, "documents"), ["doc_id"]).select("doc_id", "term", F.col("dl").cast("bigint").alias("dl"), "tf")


LINE_SQL = "(SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"


def _doc_lines(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("SELECT doc_id, md5(" + "replace(" * 8 + "text" + "".join(f", chr({ord(a)}), {b})" for a, b in (("�", "''''"), ("‘", "''''"), ("’", "''''"), ("“", "'\"'"), ("”", "'\"'"), ("–", "'-'"), ("—", "'--'"), ("…", "'...'"))) + ") AS digest FROM documents WHERE text IS NOT NULL")
def punct_fold(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(X.fold_punctuation("text")).alias("digest"))


@query(r"""
    WITH doubled AS (SELECT scene_id, regexp_replace(heading, '([^ ])', '\1\1', 'g') AS line FROM (SELECT DISTINCT scene_id, heading FROM scenes WHERE heading IS NOT NULL)
                     UNION ALL SELECT scene_id, heading FROM (SELECT DISTINCT scene_id, heading FROM scenes WHERE heading IS NOT NULL)),
    judged AS (SELECT *, regexp_replace(line, '\s', '', 'g') AS chars FROM doubled),
    tested AS (SELECT *, len(list_filter(range(0, len(chars) // 2), lambda i: chars[2 * i + 1] = chars[2 * i + 2])) AS same FROM judged)
    SELECT scene_id, line, CASE WHEN len(chars) >= 8 AND len(chars) % 2 = 0 AND same >= len(chars) / 2 * 0.8 THEN regexp_replace(line, '([^ ]).?', '\1', 'g') ELSE line END AS undoubled FROM tested""")
def dedouble_chars(spark, sf):
    rows = read(spark, sf, "scenes").select("scene_id", F.col("heading").alias("line")).where("line is not null").distinct()
    both = rows.select("scene_id", F.regexp_replace("line", "([^ ])", "$1$1").alias("line")).unionByName(rows)
    return both.select("scene_id", "line", X.undouble("line").alias("undoubled"))


@query(r"""
    WITH s AS (SELECT DISTINCT slug, scene_id, unnest(action_lines) AS line FROM scenes),
    marked AS (SELECT *, regexp_matches(line, '^\s*\d+\.?\s*$') AS page, regexp_matches(line, '^\s*\(?(?i:CONTINUED)(:\s*\(\d+\))?\)?\s*$') AS more,
               nullif(trim(regexp_extract(trim(line), '^(.*?)\s+\d+\.?\s*$', 1)), '') AS base FROM s WHERE line IS NOT NULL)
    SELECT slug, count(*) AS lines, count(*) FILTER (page) AS pages, count(*) FILTER (more) AS continued, count(*) FILTER (NOT page AND base IS NOT NULL) AS numbered, count(DISTINCT CASE WHEN NOT page THEN base END) AS bases FROM marked GROUP BY slug""")
def strip_noise(spark, sf):
    rows = read(spark, sf, "scenes").select("slug", "scene_id", F.explode("action_lines").alias("line")).where("line is not null").distinct()
    page = X.is_page_number("line")
    base = F.when(~page, X.header_base("line"))
    return rows.groupBy("slug").agg(
        F.count("*").alias("lines"), F.sum(page.cast("int")).cast("bigint").alias("pages"), F.sum(X.is_continued("line").cast("int")).cast("bigint").alias("continued"), F.count(base).alias("numbered"), F.countDistinct(base).alias("bases")
    )


@query(r"""
    WITH s AS (SELECT scene_id, '  ' || n || '   ' || heading || '      ' || n || '  ' AS line FROM (SELECT DISTINCT scene_id, heading, (scene_number % 10)::VARCHAR AS n FROM scenes WHERE heading IS NOT NULL AND scene_number IS NOT NULL))
    SELECT scene_id, CASE WHEN regexp_matches(line, '^(\s*)(?i:[A-Z0-9]+)\s+((?i:INT\.?(?:/EXT\.?)?|EXT\.?(?:/INT\.?)?|I/E)(?:\s+.+?)?)\s+(?i:[A-Z0-9]+)\s*$')
      THEN regexp_extract(line, '^(\s*)(?i:[A-Z0-9]+)\s+((?i:INT\.?(?:/EXT\.?)?|EXT\.?(?:/INT\.?)?|I/E)(?:\s+.+?)?)\s+(?i:[A-Z0-9]+)\s*$', 1) || trim(regexp_extract(line, '^(\s*)(?i:[A-Z0-9]+)\s+((?i:INT\.?(?:/EXT\.?)?|EXT\.?(?:/INT\.?)?|I/E)(?:\s+.+?)?)\s+(?i:[A-Z0-9]+)\s*$', 2)) ELSE line END AS line FROM s""")
def strip_scene_numbers(spark, sf):
    rows = read(spark, sf, "scenes").where("heading is not null and scene_number is not null").select("scene_id", "heading", (F.col("scene_number") % 10).cast("string").alias("n")).distinct()
    line = F.concat(F.lit("  "), "n", F.lit("   "), "heading", F.lit("      "), "n", F.lit("  "))
    return rows.select("scene_id", line.alias("line")).select("scene_id", X.strip_scene_number("line").alias("line"))


@query(r"""
    SELECT doc_id, line_no, regexp_replace(line || '     *', '\s+\*\s*$', '') AS line FROM """ + LINE_SQL)
def strip_stars(spark, sf):
    return _doc_lines(spark, sf).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), X.strip_star(F.concat("line", F.lit("     *"))).alias("line"))


@query(r"""
    WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s*\n\s*', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, regexp_replace(t, '\b(Mr|Mrs|Ms|Dr|Jr|Sr|Lt|Sgt|Cpl|Pvt|St|Vs|No|Vol|Dept|Ext|Int)\.\s+([A-Z])', '\1.' || chr(1) || '\2', 'g') AS t FROM x),
    m AS (SELECT doc_id, regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(2) || '\2', 'g') AS t FROM h)
    SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(t, chr(2)), lambda s: replace(trim(s), chr(1), ' ')), lambda s: s <> '') AS p FROM m)""")
def sentence_split(spark, sf):
    rows = read(spark, sf, "documents").where("text is not null").select("doc_id", X.sentences("text").alias("p"))
    return rows.select("doc_id", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(r"""
    SELECT scene_id, line FROM (SELECT DISTINCT scene_id, unnest(action_lines) AS line FROM scenes) WHERE len(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 3""")
def ocr_filter(spark, sf):
    rows = read(spark, sf, "scenes").select("scene_id", F.explode("action_lines").alias("line")).distinct()
    return rows.where(X.enough_letters("line"))


# --- scenes -----------------------------------------------------------------------------------------------------


def _scenes(spark, sf) -> DataFrame:
    rest = [c for c in read(spark, sf, "scenes").columns if c != "scene_id"]
    return read(spark, sf, "scenes").groupBy("scene_id").agg(F.max_by(F.struct(*rest), F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp"))).alias("s")).select("scene_id", "s.*")


@query(f"SELECT scene_id, {SCENE_TEXT} AS text FROM {SCENES}")
def scene_text(spark, sf):
    return _scenes(spark, sf).select("scene_id", X.scene_text().alias("text"))


@query(f"SELECT scene_id, {DIALOGUE_TEXT} AS text FROM {SCENES}")
def dialogue_text(spark, sf):
    return _scenes(spark, sf).select("scene_id", X.dialogue_text().alias("text"))


@query(f"SELECT scene_id, {CHARACTER_TEXT} AS text FROM {SCENES}")
def character_text(spark, sf):
    return _scenes(spark, sf).select("scene_id", X.character_text().alias("text"))


@query(f"SELECT scene_id, {FULL_TEXT} AS text FROM {SCENES}")
def full_text(spark, sf):
    return _scenes(spark, sf).select("scene_id", X.full_text().alias("text"))


_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


@query(f"SELECT scene_id, coalesce(list_sum(list_transform(action_lines, lambda x: {_WORDS.format("coalesce(x, '')")})), 0) + coalesce(list_sum(list_transform(dialogue, lambda d: {_WORDS.format("coalesce(d.line, '')")})), 0) AS words FROM {SCENES}")
def word_count(spark, sf):
    lines = F.coalesce("dialogue", F.array().cast("array<struct<character:string,line:string,parenthetical:string>>"))
    return _scenes(spark, sf).withColumn("dialogue", lines).select("scene_id", X.word_count().cast("bigint").alias("words"))


@query(f"SELECT scene_id, {DISTINCT.format("list_filter(list_transform(dialogue, lambda d: d.character), lambda c: coalesce(c, '') <> '')")} AS speakers FROM {SCENES}")
def distinct_characters(spark, sf):
    return _scenes(spark, sf).select("scene_id", X.speakers().alias("speakers"))


@query("SELECT slug, scene_number, slug || '_scene_' || CASE WHEN scene_number < 1000 THEN lpad(scene_number::VARCHAR, 3, '0') ELSE scene_number::VARCHAR END AS scene_id FROM scenes WHERE scene_number IS NOT NULL GROUP BY ALL")
def scene_ids(spark, sf):
    rows = read(spark, sf, "scenes").where("scene_number is not null").select("slug", "scene_number").distinct()
    return rows.withColumn("scene_id", X.scene_id("slug", "scene_number"))


INDEX_SQL = f"""
    WITH s AS (SELECT scene_id, movie_id, {SCENE_TEXT} AS a, {DIALOGUE_TEXT} AS b, {CHARACTER_TEXT} AS c, {FULL_TEXT} AS d FROM {SCENES}),
    idx AS (SELECT 'scene' AS "index", scene_id AS doc_key, movie_id, a AS text FROM s UNION ALL SELECT 'dialogue', scene_id, movie_id, b FROM s UNION ALL SELECT 'character', scene_id, movie_id, c FROM s
            UNION ALL SELECT 'full', scene_id, movie_id, d FROM s UNION ALL SELECT 'plot', tmdb_id, tmdb_id, trim(coalesce(nullif(wiki_plot, ''), overview), ' ') FROM {LATEST_METADATA})"""


@query(INDEX_SQL + """ SELECT "index", doc_key, movie_id, md5(text) AS digest FROM idx WHERE trim(text, ' ') <> ''""")
def index_documents(spark, sf):
    rows = I.index_documents(read(spark, sf, "scenes"), read(spark, sf, "metadata"))
    return rows.select("index", "doc_key", "movie_id", F.md5("text").alias("digest"))


# --- sparse and dense search ------------------------------------------------------------------------------------


@query(f"WITH {bm25_sql(DOCS, FIRST_CASE)} SELECT * FROM ({TOP}) WHERE rank <= 20")
def bm25_topk(spark, sf):
    return S.top(bm25(spark, sf, cases(spark, sf, True)), 20, ["query_id"])


@query(f"WITH {bm25_sql(DOCS, CASES)} SELECT * FROM ({TOP}) WHERE rank <= 10")
def bm25_batch_topk(spark, sf):
    return S.top(bm25(spark, sf, cases(spark, sf)), 10, ["query_id"])


@query(f"""WITH {bm25_sql(DOCS, "SELECT 0 AS query_id, 'zzzyx quorn lighthouse' AS query_text")},
    filled AS (SELECT 0 AS query_id, doc_key, coalesce(score, 0.0) AS score FROM docs LEFT JOIN scored USING (doc_key))
    SELECT * FROM (SELECT query_id, doc_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM filled) WHERE rank <= 20""")
def bm25_zero_pool(spark, sf):
    asked = spark.createDataFrame([(0, "zzzyx quorn lighthouse")], "query_id int, query_text string")
    rows = docs(spark, sf)
    return S.top(S.with_zero_scores(bm25(spark, sf, asked), rows, asked, 20), 20, ["query_id"])


@query(f"""WITH {bm25_sql(f"SELECT scene_id AS doc_key, text FROM (SELECT scene_id, {DIALOGUE_TEXT} AS text FROM {SCENES}) WHERE text <> ''", CASES, UNICODE)}, ranked AS (SELECT * FROM ({TOP}) WHERE rank <= 10)
    SELECT * FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM ranked z WHERE z.query_id = r.query_id AND z.rank <= r.rank AND z.score = 0)""")
def bm25_positive_only(spark, sf):
    rows = _scenes(spark, sf).select(F.col("scene_id").alias("doc_key"), X.dialogue_text().alias("text")).where("text <> ''")
    return S.until_zero(S.top(S.bm25_scores(rows, cases(spark, sf), unicode=True), 10, ["query_id"]), ["query_id"])


VECTORS = "unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"
DENSE = "SELECT q.vec_id AS query_id, d.vec_id AS doc_key, d.label, round(list_dot_product(q.v, d.v), 6) AS score FROM unit q, unit d WHERE q.vec_id % 20 = 0"


def _dense(spark, sf) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_key"), F.col("embedding").alias("vec"), "label")
    asked = rows.where("doc_key % 20 = 0").select(F.col("doc_key").alias("query_id"), F.col("vec").alias("query_vec"))
    return S.dense_scores(rows, asked).join(rows.select("doc_key", "label"), "doc_key").select("query_id", "doc_key", "label", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS}, scored AS ({DENSE}) SELECT * FROM ({TOP}) WHERE rank <= 10")
def dense_topk(spark, sf):
    return S.top(_dense(spark, sf), 10, ["query_id"]).select("query_id", "doc_key", "score", "rank")


@query(f"WITH {VECTORS}, scored AS ({DENSE}) SELECT * FROM (SELECT query_id, label, doc_key, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_key) AS rank FROM scored) WHERE rank <= 3")
def dense_topk_by_label(spark, sf):
    return S.top(_dense(spark, sf), 3, ["query_id", "label"]).select("query_id", "label", "doc_key", "score", "rank")


@query(f"WITH {VECTORS}, scored AS ({DENSE}) SELECT query_id, label, count(*) AS n, round(avg((1 + score) / 2), 5) AS similarity FROM scored GROUP BY ALL")
def dense_similarity_score(spark, sf):
    return _dense(spark, sf).groupBy("query_id", "label").agg(F.count("*").alias("n"), F.round(F.avg((1 + F.col("score")) / 2), 5).alias("similarity"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def l2_normalise(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", I.unit("embedding").alias("v"))
    return rows.select("vec_id", F.round(I.dot(F.col("v"), F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query()
def hashed_vectors(spark, sf):
    return I.hashed_vectors(docs(spark, sf).where("text is not null"), ["doc_key"])


# --- fusion and aggregation -------------------------------------------------------------------------------------

TWO_LISTS = f"""
    a AS (SELECT query_id, 0 AS list_no, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM scored),
    b AS (SELECT query_id, 1 AS list_no, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC NULLS LAST, doc_key) AS rank FROM (SELECT DISTINCT query_id FROM scored), (SELECT * FROM docs ORDER BY length(text) DESC NULLS LAST, doc_key LIMIT 20)),
    lists AS (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b),
    fused AS (SELECT query_id, doc_key, sum(1.0 / (60 + rank)) AS rrf_score, min((list_no, rank)) AS seen FROM lists GROUP BY query_id, doc_key),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 10) DESC, seen, doc_key) AS rank FROM fused)"""


def _two_lists(spark, sf) -> DataFrame:
    rows = docs(spark, sf)
    scored = bm25(spark, sf, cases(spark, sf))
    a = S.top(scored, 20, ["query_id"]).withColumn("list_no", F.lit(0))
    long = rows.select("doc_key", F.length("text").alias("size")).orderBy(F.desc_nulls_last("size"), "doc_key").limit(20)
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("size"), "doc_key")
    # Twenty rows for each query.
    b = scored.select("query_id").distinct().crossJoin(F.broadcast(long)).select("query_id", "doc_key", F.row_number().over(w).alias("rank"), F.lit(1).alias("list_no"))
    return a.select("query_id", "list_no", "doc_key", "rank").unionByName(b.select("query_id", "list_no", "doc_key", "rank"))


@query(f"WITH {bm25_sql(DOCS, CASES)}, {TWO_LISTS} SELECT query_id, doc_key, round(rrf_score, 6) AS rrf_score, rank FROM hits")
def rrf_two_lists(spark, sf):
    hits = S.fused_order(S.rrf(_two_lists(spark, sf), ["query_id"]), ["query_id"])
    return hits.select("query_id", "doc_key", F.round("rrf_score", 6).alias("rrf_score"), "rank")


@query(f"""WITH {bm25_sql(DOCS, CASES)}, {TWO_LISTS}, m AS (SELECT query_id, source, sum(rrf_score) AS total, min(rank) AS first_hit, list(doc_key ORDER BY rank)[1:3] AS top_scenes FROM hits JOIN (SELECT doc_id AS doc_key, source FROM documents) USING (doc_key) WHERE rank <= 20 GROUP BY query_id, source)
    SELECT query_id, source, round(total, 4) AS score, top_scenes, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 10) DESC, first_hit) AS rank FROM m""")
def movie_aggregate(spark, sf):
    hits = S.fused_order(S.rrf(_two_lists(spark, sf), ["query_id"]), ["query_id"])
    hits = hits.join(read(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"), "source"), "doc_key")
    return S.by_movie(hits, ["query_id"], 20, movie="source")


@query(f"""WITH {bm25_sql(DOCS, CASES)}, pool AS (SELECT * FROM ({TOP}) WHERE rank <= 40)
    SELECT query_id, doc_key, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM pool WHERE doc_key IN (SELECT doc_id FROM documents WHERE kind = 'review')""")
def pool_filter_compaction(spark, sf):
    ranked = S.top(bm25(spark, sf, cases(spark, sf)), 40, ["query_id"]).withColumn("movie_id", F.col("doc_key"))
    allowed = read(spark, sf, "documents").where("kind = 'review'").select(F.col("doc_id").alias("movie_id"))
    return S.keep_allowed(ranked, allowed, ["query_id"]).select("query_id", "doc_key", "score", "rank")


# --- filters ----------------------------------------------------------------------------------------------------


def _registry(spark, sf, scenes: bool = False) -> DataFrame:
    return R.registry(read(spark, sf, "manifest"), read(spark, sf, "metadata"), read(spark, sf, "scenes") if scenes else None)


@query(f"SELECT DISTINCT tmdb_id AS movie_id FROM (SELECT tmdb_id, unnest(genres) AS g FROM {LATEST_METADATA}) WHERE contains(lower(g), 'fiction') OR contains('fiction', lower(g))")
def genre_filter(spark, sf):
    return S.genre_ids(_registry(spark, sf), "Fiction")


@query(f"SELECT tmdb_id AS movie_id FROM {LATEST_METADATA}")
def genre_fail_open(spark, sf):
    registry = _registry(spark, sf)
    allowed = S.allowed_ids(registry, "no such genre", None, None)
    return registry.select("movie_id") if allowed is None else allowed


@query(f"SELECT tmdb_id AS movie_id FROM (SELECT tmdb_id, CASE WHEN regexp_full_match(trim(left(coalesce(release_date, ''), 4)), '[0-9]+') THEN left(release_date, 4)::INT END AS y FROM {LATEST_METADATA}) WHERE y IS NULL OR y BETWEEN 1990 AND 1999")
def year_range_filter(spark, sf):
    return S.year_ids(_registry(spark, sf), 1990, 1999)


@query(f"""SELECT tmdb_id AS movie_id FROM (SELECT tmdb_id, genres, CASE WHEN regexp_full_match(trim(left(coalesce(release_date, ''), 4)), '[0-9]+') THEN left(release_date, 4)::INT END AS y FROM {LATEST_METADATA}) WHERE (y IS NULL OR y >= 1980) AND len(list_filter(genres, lambda g: contains(lower(g), 'drama') OR contains('drama', lower(g)))) > 0""")
def genre_and_year_filter(spark, sf):
    return S.allowed_ids(_registry(spark, sf), "drama", 1980, None)


_EXCLUDED = f"SELECT plan_id, tmdb_id AS movie_id FROM (SELECT DISTINCT plan_id, unnest(exclude_titles) AS t FROM query_plans), {LATEST_METADATA} m WHERE t IS NOT NULL AND trim(t, ' ') <> '' AND (lower(trim(t, ' ')) = lower(trim(m.title, ' ')) OR contains(lower(trim(t, ' ')), lower(trim(m.title, ' '))) OR contains(lower(trim(m.title, ' ')), lower(trim(t, ' '))))"


@query("SELECT DISTINCT t.title, r.title AS matched, r.title_id FROM title_ref t, title_ref r WHERE lower(trim(r.title)) = lower(trim(t.title)) OR contains(lower(trim(r.title)), lower(trim(t.title))) OR contains(lower(trim(t.title)), lower(trim(r.title)))")
def title_bidirectional(spark, sf):
    ref = read(spark, sf, "title_ref")
    have = ref.select(F.col("title_id").cast("string").alias("movie_id"), "title")
    found = S.title_matches(have, ref.select("title"))
    return found.join(ref.select(F.col("title_id").cast("string").alias("movie_id"), "title_id", F.col("title").alias("matched")), "movie_id").select("title", "matched", "title_id")


def _plan_movies(spark, sf) -> DataFrame:
    """Each plan's films of the reference list by year, as a ranked list."""
    plans = read(spark, sf, "query_plans").where("filters.year_min is not null").select("plan_id", F.col("filters.year_min").alias("y")).distinct()
    ref = read(spark, sf, "title_ref").select(F.col("title_id").alias("movie_id"), "release_year")
    return plans.join(F.broadcast(ref), F.abs(F.col("release_year") - F.col("y")) <= 1).select("plan_id", "movie_id")


@query("""WITH m AS (SELECT DISTINCT p.plan_id, r.title_id AS movie_id FROM (SELECT DISTINCT plan_id, filters.year_min AS y FROM query_plans WHERE filters.year_min IS NOT NULL) p JOIN title_ref r ON abs(r.release_year - p.y) <= 1),
    x AS (SELECT title_id AS movie_id FROM title_ref WHERE title_id % 3 = 0), c AS (SELECT plan_id, count(*) FILTER (movie_id NOT IN (SELECT movie_id FROM x)) AS n_left FROM m GROUP BY plan_id)
    SELECT m.plan_id, m.movie_id FROM m JOIN c USING (plan_id) WHERE m.movie_id NOT IN (SELECT movie_id FROM x) OR n_left = 0""")
def exclude_movies(spark, sf):
    out = read(spark, sf, "title_ref").where("title_id % 3 = 0").select(F.col("title_id").alias("movie_id"))
    return S.exclude(_plan_movies(spark, sf).distinct(), out, ["plan_id"])


@query("SELECT DISTINCT p.plan_id, r.title_id AS movie_id FROM (SELECT DISTINCT plan_id, filters.year_min AS y FROM query_plans WHERE filters.year_min IS NOT NULL) p JOIN title_ref r ON abs(r.release_year - p.y) <= 1")
def exclude_fail_open(spark, sf):
    out = read(spark, sf, "title_ref").select(F.col("title_id").alias("movie_id"))
    return S.exclude(_plan_movies(spark, sf).distinct(), out, ["plan_id"])


# --- people and names -------------------------------------------------------------------------------------------


def _director_queries(spark, sf) -> DataFrame:
    rows = I.latest_metadata(read(spark, sf, "metadata")).select(F.col("tmdb_id").alias("query_id"), F.explode("directors").alias("d")).where("d is not null")
    return rows.groupBy("query_id").agg(F.concat_ws(" ", F.lit("films by"), F.concat_ws(" and ", F.sort_array(F.collect_set("d")))).alias("query_text"))


@query(f"""WITH p AS (SELECT DISTINCT name, movie_id FROM (SELECT tmdb_id AS movie_id, unnest("cast").name AS name FROM metadata UNION ALL SELECT tmdb_id, unnest(directors) FROM metadata) WHERE len({ASCII.format('name')}) >= 2),
    q AS (SELECT query_id, {ASCII.format("'films by ' || array_to_string(ds, ' and ')")} AS words FROM (SELECT tmdb_id AS query_id, list_sort(list_distinct(directors)) AS ds FROM {LATEST_METADATA} WHERE len(directors) > 0)),
    parts AS (SELECT DISTINCT name, unnest({ASCII.format('name')}) AS part FROM (SELECT DISTINCT name FROM p)), n AS (SELECT name, count(*) AS n FROM parts GROUP BY name),
    hit AS (SELECT query_id, name, count(*) AS c FROM parts JOIN (SELECT DISTINCT query_id, unnest(words) AS part FROM q) USING (part) GROUP BY ALL)
    SELECT query_id, name, movie_id FROM hit JOIN n USING (name) JOIN p USING (name) WHERE c = n""")
def entity_exact(spark, sf):
    people = N.people(read(spark, sf, "metadata"))
    asked = _director_queries(spark, sf)
    words = asked.select("query_id", F.explode(F.array_distinct(X.tokens_ascii("query_text"))).alias("part"))
    names = people.select("name").distinct().withColumn("parts", F.array_distinct(X.tokens_ascii("name")))
    parts = names.select("name", F.size("parts").alias("n"), F.explode("parts").alias("part"))
    exact = parts.join(words, "part").groupBy("query_id", "name", "n").count().where("count = n")
    return exact.join(people.select("name", "movie_id").distinct(), "name").select("query_id", "name", "movie_id")


@query()
def entity_fuzzy(spark, sf):
    asked = read(spark, sf, "heldout_cases").select(F.col("item_id").alias("query_id"), "query_text")
    return N.people_in_queries(N.people(read(spark, sf, "metadata")), asked)


_PLAIN = "trim(lower(regexp_replace({0}, '\\s*\\((?i:V\\.?O\\.?|O\\.?S\\.?|O\\.?C\\.?|CONT''D|VOICE|ARCHIVE|PRE-LAP)[^)]*\\)', '', 'g')), ' ')"


@query(f"""WITH names AS (SELECT slug, movie_id, screenplay_name, count(DISTINCT scene_id) AS scene_count FROM (SELECT DISTINCT slug, movie_id, scene_id, unnest(characters) AS screenplay_name FROM (SELECT scene_id, any_value(slug) AS slug, any_value(movie_id) AS movie_id, any_value(characters) AS characters FROM scenes GROUP BY scene_id)) WHERE screenplay_name <> '' GROUP BY ALL),
    roles AS (SELECT tmdb_id AS movie_id, generate_subscripts("cast", 1) - 1 AS tmdb_order, unnest("cast").character AS tmdb_character, unnest("cast").name AS actor FROM {LATEST_METADATA}),
    p AS (SELECT n.*, r.tmdb_character, r.actor, r.tmdb_order, {_PLAIN.format('screenplay_name')} AS a, {_PLAIN.format('tmdb_character')} AS b FROM names n JOIN roles r USING (movie_id) WHERE trim(r.tmdb_character, ' ') <> ''),
    t AS (SELECT *, regexp_extract_all(a, '[a-z]+') AS x, regexp_extract_all(b, '[a-z]+') AS y FROM p),
    s AS (SELECT *, CASE WHEN a = b THEN 0 WHEN len(x) > 0 AND len(y) > 0 AND (list_has_all(y, x) OR list_has_all(x, y)) THEN 1 WHEN a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) THEN 2 END AS priority FROM t),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, movie_id, screenplay_name ORDER BY priority, tmdb_order) AS k FROM s WHERE priority IS NOT NULL) WHERE k = 1)
    SELECT n.slug, n.movie_id, n.screenplay_name, b.tmdb_character, b.actor, CASE b.priority WHEN 0 THEN 'exact' WHEN 1 THEN 'token' WHEN 2 THEN 'substring' ELSE 'unmatched' END AS match_type, n.scene_count, coalesce(b.tmdb_order, -1) AS tmdb_order
    FROM names n LEFT JOIN best b ON n.slug = b.slug AND n.movie_id = b.movie_id AND n.screenplay_name = b.screenplay_name""")
def reconcile_names(spark, sf):
    return N.reconcile(read(spark, sf, "scenes"), read(spark, sf, "metadata")).withColumn("tmdb_order", F.col("tmdb_order").cast("bigint"))


@query(f"SELECT DISTINCT screenplay_name, {_PLAIN.format('screenplay_name')} AS plain, array_to_string(regexp_extract_all({_PLAIN.format('screenplay_name')}, '[a-z]+'), ' ') AS tokens FROM characters WHERE screenplay_name IS NOT NULL")
def name_normalise(spark, sf):
    rows = read(spark, sf, "characters").where("screenplay_name is not null").select("screenplay_name").distinct()
    return rows.select("screenplay_name", X.plain_name("screenplay_name").alias("plain"), F.array_join(X.name_tokens("screenplay_name"), " ").alias("tokens"))


# --- registry ---------------------------------------------------------------------------------------------------

REGISTRY = f"""SELECT m.tmdb_id AS movie_id, m.title, s.slug, left(coalesce(m.release_date, ''), 4) AS year, array_to_string(coalesce(m.genres, []), '|') AS genres, coalesce(c.n, 0) AS scene_count
    FROM {LATEST_METADATA} m LEFT JOIN (SELECT tmdb_id, min(slug) AS slug FROM manifest WHERE trim(tmdb_id, ' ') NOT IN ('', '0') GROUP BY tmdb_id) s ON s.tmdb_id = m.tmdb_id LEFT JOIN (SELECT movie_id, count(DISTINCT scene_id) AS n FROM scenes GROUP BY movie_id) c ON c.movie_id = m.tmdb_id"""


@query(REGISTRY)
def registry(spark, sf):
    return _registry(spark, sf, True).select("movie_id", "title", "slug", "year", F.array_join("genres", "|").alias("genres"), "scene_count")


@query(f"SELECT d.doc_id, coalesce(m.title, 'Movie ' || d.movie_id) AS title FROM documents d LEFT JOIN {LATEST_METADATA} m ON m.tmdb_id = d.movie_id")
def registry_lookup_default(spark, sf):
    return R.titled(read(spark, sf, "documents").select("doc_id", "movie_id"), _registry(spark, sf)).select("doc_id", "title")


@query(f"""SELECT kind, key, list_sort(list(DISTINCT movie_id)) AS movie_ids FROM (SELECT 'actor' AS kind, lower(unnest("cast").name) AS key, tmdb_id AS movie_id FROM {LATEST_METADATA} UNION ALL SELECT 'director', lower(unnest(directors)), tmdb_id FROM {LATEST_METADATA} UNION ALL SELECT 'genre', lower(unnest(genres)), tmdb_id FROM {LATEST_METADATA}) WHERE key <> '' GROUP BY kind, key""")
def inverted_set(spark, sf):
    return R.people_index(read(spark, sf, "metadata"))


@query(f"SELECT lower(c.screenplay_name) AS key, count(*) AS entries, sum(c.scene_count) AS scenes FROM characters c JOIN {LATEST_METADATA} m ON m.tmdb_id = c.movie_id WHERE c.match_type <> 'unmatched' AND c.screenplay_name <> '' GROUP BY 1")
def inverted_bag(spark, sf):
    rows = R.character_index(read(spark, sf, "characters"), read(spark, sf, "metadata"))
    return rows.select("key", F.size("entries").cast("bigint").alias("entries"), F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["scene_count"], F.lit(0))).alias("scenes"))


@query(f"SELECT lower(location) AS key, list_sort(list(scene_id)) AS scene_ids FROM (SELECT DISTINCT scene_id, movie_id, location FROM scenes WHERE location <> '') s JOIN {LATEST_METADATA} m ON m.tmdb_id = s.movie_id GROUP BY 1")
def location_index(spark, sf):
    rows = R.location_index(read(spark, sf, "scenes"), read(spark, sf, "metadata"))
    return rows.select("key", F.sort_array(F.transform("entries", lambda e: e["scene_id"])).alias("scene_ids"))


# --- files, titles, links ---------------------------------------------------------------------------------------

_YEARLESS = "regexp_replace({0}, '(^|[^0-9])((?:19|20)[0-9]{{2}})($|[^0-9])', '\\1\\3', 'g')"
_BARE = "trim(" + _YEARLESS.format(_YEARLESS.format("regexp_replace(lower(filename), '\\.[^.]*$', '')")) + ", '-')"


@query(f"""WITH f AS (SELECT DISTINCT filename, list_filter(regexp_split_to_array(replace({_BARE}, '-', ' '), '\\s+'), lambda w: w <> '') AS w FROM manifest)
    SELECT filename, array_to_string(w, '_') AS slug, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 OR i = len(w) OR x NOT IN ({", ".join(f"'{x}'" for x in X.SMALL_WORDS)}) THEN upper(x[1]) || x[2:] ELSE x END), ' ') AS title FROM f""")
def slug_title(spark, sf):
    rows = read(spark, sf, "manifest").select("filename").distinct()
    return rows.select("filename", X.file_slug("filename").alias("slug"), X.file_title("filename").alias("title"))


@query("SELECT DISTINCT filename, nullif(regexp_extract(filename, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])', 1), '') AS year FROM manifest")
def year_from_name(spark, sf):
    return read(spark, sf, "manifest").select("filename").distinct().select("filename", X.file_year("filename").alias("year"))


_WIKI = "'== Plot ==' || chr(10) || '{{Infobox|a={{b|c}}}}''''''' || title || ''''''' is a [[film|movie]] of [[' || title || ']].<ref name=\"x\">gone</ref><br/> ' || overview"


@query(f"""SELECT tmdb_id, trim('Plot' || chr(10) || regexp_replace(title || ' is a movie of ' || title || '. ' || overview, '[ \\t]+', ' ', 'g'), ' ') AS text FROM {LATEST_METADATA} WHERE title IS NOT NULL AND overview IS NOT NULL""")
def wikitext_plain(spark, sf):
    rows = I.latest_metadata(read(spark, sf, "metadata")).where("title is not null and overview is not null")
    marked = F.concat(F.lit("== Plot ==\n{{Infobox|a={{b|c}}}}'''"), "title", F.lit("''' is a [[film|movie]] of [["), "title", F.lit(']].<ref name="x">gone</ref><br/> '), "overview")
    return rows.select("tmdb_id", X.wikitext_plain(marked).alias("text"))


@query("SELECT doc_id, ((doc_id % 3) * 3600 + (doc_id % 60) * 60 + doc_id % 50)::INT AS seconds FROM documents")
def youtube_seconds(spark, sf):
    link = F.format_string("https://video.example/watch?v=a&t=%dh%dm%ds", F.col("doc_id") % 3, F.col("doc_id") % 60, F.col("doc_id") % 50)
    return read(spark, sf, "documents").select("doc_id", X.link_seconds(link).alias("seconds"))


@query("SELECT doc_id, 'cand_' || left(sha1(coalesce(source, '') || '::' || doc_id), 10) AS candidate, CASE WHEN length(flat) > 300 THEN rtrim(left(flat, 299)) || '…' ELSE flat END AS text FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS flat FROM documents WHERE source IS NOT NULL)")
def rerank_candidate_id(spark, sf):
    return read(spark, sf, "documents").where("source is not null").select("doc_id", X.candidate_id("source", F.col("doc_id").cast("string")).alias("candidate"), X.ellipsis("text", 300).alias("text"))


@query("SELECT item_id, CASE WHEN regexp_matches(trim(query_text, ' '), '^\".*\"$') THEN 'dialogue' " + " ".join("WHEN " + " OR ".join(f"contains(lower(query_text), '{w}')" for w in words.split(",")) + f" THEN '{f}'" for f, words in X.FIELD_WORDS.items()) + " ELSE 'action' END AS field FROM heldout_cases")
def keyword_router(spark, sf):
    return read(spark, sf, "heldout_cases").select("item_id", X.route_field("query_text").alias("field"))


@query()
def html_text(spark, sf):
    page = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), F.regexp_replace("text", "[<&>]", " "), F.lit("</p></body></html>"))
    rows = read(spark, sf, "documents").where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("filename"), F.encode(page, "UTF-8").alias("content"))
    return L.extract(rows)


@query("SELECT filename, min(tmdb_id) AS tmdb_id, min(title) AS title, min(slug) AS slug FROM manifest GROUP BY filename")
def manifest_merge(spark, sf):
    """Files that the manifest holds leave it as it is."""
    rows = read(spark, sf, "manifest")
    old = rows.groupBy("filename").agg(F.min("tmdb_id").alias("tmdb_id"), F.min("title").alias("title"), F.min("slug").alias("slug"))
    return L.merged_manifest(old, rows)


@query("SELECT tmdb_id, max(fetched_at) AS fetched_at, max(wiki_plot IS NOT NULL) AS has_plot FROM metadata WHERE tmdb_id IS NOT NULL GROUP BY tmdb_id")
def metadata_upsert(spark, sf):
    rows = read(spark, sf, "metadata").where("tmdb_id is not null")
    newest = I.latest_metadata(rows)
    oldest = rows.groupBy("tmdb_id").agg(F.min("fetched_at").alias("fetched_at"), F.max("wiki_plot").alias("wiki_plot"))
    return L.upsert_metadata(oldest, newest.select("tmdb_id", "fetched_at", "wiki_plot")).select("tmdb_id", "fetched_at", F.col("wiki_plot").isNotNull().alias("has_plot"))


_TIMES = "DAY|NIGHT|MORNING|EVENING|AFTERNOON|DAWN|DUSK|SUNSET|SUNRISE|NOON|MIDNIGHT|LATER|MOMENTS LATER|CONTINUOUS|SAME|SAME TIME|EARLY MORNING|LATE NIGHT"


def _heading_sql(rows: str, keep: str) -> str:
    """keep, int_ext, location and time_of_day over rows with a heading."""
    return f"""SELECT {keep}, CASE WHEN regexp_matches(t, '^(?i:EXT)') THEN 'EXT' ELSE 'INT' END AS int_ext, CASE WHEN timed THEN array_to_string(parts[1:len(parts) - 1], ' - ') ELSE rest END AS location, CASE WHEN timed THEN upper(parts[-1]) ELSE 'UNSPECIFIED' END AS time_of_day
        FROM (SELECT *, len(parts) > 1 AND regexp_matches(parts[-1], '^(?i:{_TIMES})$') AS timed FROM (SELECT *, regexp_split_to_array(rest, '\\s+[-–]\\s+') AS parts FROM (SELECT *, trim(heading, ' ') AS t, trim(regexp_replace(trim(heading, ' '), '^(?i:INT\\.?/EXT\\.?|EXT\\.?/INT\\.?|INT\\.?|EXT\\.?|I/E\\.?)\\s*', ''), ' ') AS rest FROM ({rows}))))"""


@query(_heading_sql("SELECT DISTINCT heading FROM scenes WHERE heading IS NOT NULL", "heading"))
def heading_parts(spark, sf):
    return read(spark, sf, "scenes").where("heading is not null").select("heading").distinct().select("heading", X.heading_parts("heading").alias("p")).select("heading", "p.*")


_SPEAKER = r"""SELECT line, base <> '' AND NOT regexp_matches(trim(line, ' '), '^\s*(?i:INT\.?(?:/EXT\.?)?|EXT\.?|I/E)\b') AND regexp_matches(base, '^[A-Z][A-Z0-9#\s''./-]*$') AND len(regexp_split_to_array(base, '\s+')) <= 4 AND NOT list_has_any(regexp_split_to_array(base, '\s+'), [%s]) AS speaker
    FROM (SELECT line, trim(regexp_replace(trim(line, ' '), '\s*\(.*?\)\s*$', ''), ' ') AS base FROM (SELECT DISTINCT screenplay_name AS line FROM characters WHERE screenplay_name IS NOT NULL UNION SELECT heading FROM scenes WHERE heading IS NOT NULL))""" % ", ".join(f"'{w}'" for w in X.SHOT_WORDS)


@query(_SPEAKER)
def speaker_lines(spark, sf):
    names = read(spark, sf, "characters").select(F.col("screenplay_name").alias("line")).unionByName(read(spark, sf, "scenes").select(F.col("heading").alias("line")))
    return names.where("line is not null").distinct().select("line", X.is_speaker("line").alias("speaker"))


_NOTE = r"\s{4,}\((?i:CHAKOBSA|PHONETIC|[A-Z]+ TRANSLATION)[^)]*\).*$"


@query(_SPEAKER.split("FROM (SELECT DISTINCT screenplay_name")[0].replace("SELECT line, base <> ''", "SELECT scene_id, pos, CASE WHEN base <> ''").replace("AS speaker", "THEN '' ELSE base END AS line").replace("SELECT line, trim(regexp_replace(trim(line, ' '),", "SELECT scene_id, pos, line, trim(regexp_replace(trim(line, ' '),") + rf"""FROM (SELECT scene_id, pos, trim(regexp_split_to_array(regexp_replace(line, '{_NOTE}', ''), '\s{{8,}}')[1], ' ') AS line
    FROM (SELECT DISTINCT scene_id, pos, d.line || '          ' || d.character || '     (FRENCH TRANSLATION)  x' AS line FROM (SELECT scene_id, generate_subscripts(dialogue, 1) - 1 AS pos, unnest(dialogue) AS d FROM scenes) WHERE d.line IS NOT NULL AND d.character IS NOT NULL AND NOT regexp_matches(d.line, '[\n\r]|\)\s*$'))))""")
def dual_columns(spark, sf):
    rows = read(spark, sf, "scenes").select("scene_id", F.posexplode("dialogue").alias("pos", "d")).where(r"d.line is not null and d.character is not null and not d.line rlike '[\\n\\r]|\\)\\s*$'")
    line = F.concat(F.col("d.line"), F.lit("          "), F.col("d.character"), F.lit("     (FRENCH TRANSLATION)  x"))
    return rows.select("scene_id", F.col("pos").cast("bigint").alias("pos"), line.alias("line")).distinct().select("scene_id", "pos", X.strip_dual_column("line").alias("line"))


@query("""SELECT doc_id, count(*) AS kept, sum(line_no)::BIGINT AS places FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, solid ORDER BY line_no) - (solid > 0)::INT AS nth FROM (SELECT *, sum((line <> '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS solid FROM (SELECT doc_id, line_no, rtrim(line, ' ') AS line FROM """ + LINE_SQL + """))) WHERE line <> '' OR nth <= 2 GROUP BY doc_id""")
def blank_runs(spark, sf):
    rows = _doc_lines(spark, sf).select("doc_id", "line_no", F.rtrim("line").alias("line"))
    return Y.without_blank_runs(rows, "doc_id").groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("line_no").alias("places"))


@query(_heading_sql("SELECT slug, scene_number, heading FROM (SELECT DISTINCT slug, dense_rank() OVER (PARTITION BY slug ORDER BY scene_number) AS scene_number, trim(heading, ' ') AS heading FROM (SELECT slug, scene_number, any_value(heading) AS heading FROM " + SCENES + r" WHERE scene_number IS NOT NULL AND regexp_matches(heading, '^(INT|EXT)[./][^\n\r]*$') GROUP BY slug, scene_number))", "slug, scene_number, heading"))
def parse_scenes(spark, sf):
    """Scenes written out as a screenplay and parsed again."""
    rows = _scenes(spark, sf).where(r"scene_number is not null and heading rlike '^(INT|EXT)[./][^\\n\\r]*$'").dropDuplicates(["slug", "scene_number"])
    spoken = F.transform(F.filter("dialogue", lambda d: (F.coalesce(d["character"], F.lit("")) != "") & (F.coalesce(d["line"], F.lit("")) != "")), lambda d: F.concat(F.repeat(F.lit(" "), F.lit(25)), F.upper(d["character"]), F.lit("\n" + " " * 10), F.regexp_replace(d["line"], r"\s+", " "), F.lit("\n")))
    body = F.concat_ws("\n", F.concat("heading", F.lit("\n")), F.array_join(F.transform(X.non_empty("action_lines"), lambda x: F.concat(F.lit("~ "), F.regexp_replace(x, r"\s+", " "), F.lit("\n"))), "\n"), F.array_join(spoken, "\n"))
    text = rows.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_number", body.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return Y.scenes(Y.lines(text)).select("slug", F.col("scene_number").cast("bigint").alias("scene_number"), "heading", "int_ext", "location", "time_of_day")


@query()
def cleaned_lines(spark, sf):
    texts = read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("slug"), "text")
    return Y.cleaned(Y.lines(texts))


# --- plans, reranking, evaluation -------------------------------------------------------------------------------

_TYPES, _INTENTS = ", ".join(f"'{t}'" for t in P.TYPE_INTENTS), ", ".join(f"'{i}'" for i in P.INTENTS)
_SUBS = f"list_filter(sub_queries, lambda s: s.intent IN ({_INTENTS}) AND trim(coalesce(s.text, ''), ' ') <> '')"
_FROM_SUBS = f"list_transform({_SUBS}, lambda s: s.intent)"
_OWN = f"list_filter(intents, lambda i: i IN ({_INTENTS}))"


@query(f"""SELECT DISTINCT plan_id, CASE WHEN query_type IN ({_TYPES}) THEN query_type ELSE 'plot_level' END AS query_type, coalesce(len({_SUBS}), 0) AS n_sub_queries,
    array_to_string(CASE WHEN len({_SUBS}) > 0 THEN {DISTINCT.format(_FROM_SUBS)} WHEN len({_OWN}) > 0 THEN {_OWN} ELSE ['full'] END, ',') AS intents FROM query_plans""")
def plan_validate(spark, sf):
    rows = read(spark, sf, "query_plans")
    subs = P.valid_sub_queries()
    return rows.select("plan_id", P.valid_type("query_type").alias("query_type"), F.coalesce(F.when(subs.isNotNull(), F.size(subs)), F.lit(0)).cast("bigint").alias("n_sub_queries"), F.array_join(P.valid_intents(), ",").alias("intents")).distinct()


@query(f"""WITH {bm25_sql(DOCS, CASES)}, r AS (SELECT * FROM ({TOP}) WHERE rank <= 10), told AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY doc_key) AS pos FROM r WHERE rank % 2 = 1)
    SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(pos, 1000), r.rank) AS rank FROM r LEFT JOIN told USING (query_id, doc_key)""")
def rerank_listwise(spark, sf):
    ranked = S.top(bm25(spark, sf, cases(spark, sf)), 10, ["query_id"])
    odd = ranked.where("rank % 2 = 1").groupBy("query_id").agg(F.sort_array(F.collect_list("doc_key")).alias("ids"))
    told = odd.select("query_id", F.concat("ids", F.slice("ids", 1, 2), F.array(F.lit(-5).cast("bigint"))).alias("ranked_ids"))
    return K.apply_order(ranked, told, ["query_id"], key="doc_key").select("query_id", "doc_key", "rank")


_EVAL = f"""WITH {bm25_sql("SELECT title_id AS doc_key, title AS text FROM title_ref", "SELECT item_id AS query_id, ground_truth[1] AS query_text FROM heldout_cases")}, r AS (SELECT * FROM ({TOP}) WHERE rank <= 5),
    j AS (SELECT r.query_id, r.rank, (len(list_filter(c.ground_truth, lambda g: contains(lower(t.title), lower(g)))) > 0)::INT AS hit FROM r JOIN title_ref t ON t.title_id = r.doc_key JOIN heldout_cases c ON c.item_id = r.query_id WHERE c.ground_truth IS NOT NULL),
    s AS (SELECT query_id, coalesce(max(CASE WHEN hit = 1 THEN 1.0 / rank END), 0) AS rr, max(hit) AS hit, avg(hit) AS p, sum(hit / log2(rank + 1)) AS g FROM j GROUP BY query_id)"""


@query(_EVAL + """
    SELECT item_id AS query_id, round(coalesce(rr, 0), 4) AS rr, coalesce(hit, 0)::DOUBLE AS hit, round(coalesce(p, 0), 4) AS precision, round(coalesce(g, 0), 4) AS ndcg_ref, coalesce(hit, 0)::DOUBLE AS recall FROM heldout_cases LEFT JOIN s ON s.query_id = item_id""")
def eval_metrics(spark, sf):
    scores = _evaluated(spark, sf)
    return scores.select("query_id", F.round("rr", 4).alias("rr"), "hit", F.round("precision", 4).alias("precision"), F.round("ndcg_ref", 4).alias("ndcg_ref"), "recall")


@query(_EVAL + """
    SELECT count(*) AS queries, round(avg(coalesce(rr, 0)), 4) AS rr, round(avg(coalesce(hit, 0)), 4) AS hit, round(avg(coalesce(p, 0)), 4) AS precision, round(avg(coalesce(g, 0)), 4) AS ndcg_ref, round(avg(coalesce(hit, 0)), 4) AS recall,
    round(avg(CASE WHEN expected_intent IS NOT NULL THEN (expected_intent = 'plot')::INT END), 4) AS intent_accuracy FROM heldout_cases LEFT JOIN s ON s.query_id = item_id""")
def eval_means(spark, sf):
    """Means over all cases; the intent taken for every query is 'plot'."""
    return M.means(_evaluated(spark, sf)).select("queries", "rr", "hit", "precision", "ndcg_ref", "recall", "intent_accuracy")


def _evaluated(spark, sf) -> DataFrame:
    ref = read(spark, sf, "title_ref").select(F.col("title_id").alias("doc_key"), F.col("title").alias("text"))
    held = read(spark, sf, "heldout_cases").select(F.col("item_id").alias("query_id"), "ground_truth", "expected_intent", F.try_element_at("ground_truth", F.lit(1)).alias("query_text"), F.lit("plot").alias("intent"))
    ranked = S.top(S.bm25_scores(ref, held), 5, ["query_id"]).join(ref.select("doc_key", F.col("text").alias("title")), "doc_key")
    return M.per_query(ranked, held)


# --- audit ------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT DISTINCT filename, tmdb_id, slug FROM manifest)
    SELECT 'duplicate_id' AS "check", 'CRITICAL' AS severity, min(slug) AS slug, tmdb_id AS message FROM f WHERE trim(tmdb_id, ' ') NOT IN ('', '0') GROUP BY tmdb_id HAVING count(*) > 1
    UNION ALL SELECT 'duplicate_slug', 'CRITICAL', slug, slug FROM f GROUP BY slug HAVING count(*) > 1""")
def audit_duplicates(spark, sf):
    return A.duplicates(read(spark, sf, "manifest"))


@query("""WITH l AS (SELECT scene_id, any_value(slug) AS slug, any_value(word_count) AS word_count, any_value(coalesce(len(dialogue), 0)) AS d, any_value(coalesce(len(action_lines), 0)) AS a FROM scenes GROUP BY scene_id),
    p AS (SELECT slug, count(*) AS n, sum(d) AS speeches, avg(coalesce(word_count, 0)) AS words, avg((a = 0 AND d = 0)::INT) AS bare, max(d) AS most FROM l GROUP BY slug),
    r AS (SELECT m.slug, p.n, p.speeches, p.words, p.bare, p.most FROM (SELECT DISTINCT slug FROM manifest) m LEFT JOIN p ON p.slug = m.slug)
    SELECT 'no_scenes' AS "check", 'CRITICAL' AS severity, slug FROM r WHERE n IS NULL UNION ALL SELECT 'no_dialogue', 'WARNING', slug FROM r WHERE speeches = 0 UNION ALL SELECT 'few_words', 'WARNING', slug FROM r WHERE words < 10
    UNION ALL SELECT 'empty_scenes', CASE WHEN bare > 0.2 THEN 'WARNING' ELSE 'INFO' END, slug FROM r WHERE bare > 0 UNION ALL SELECT 'long_dialogue', 'WARNING', slug FROM r WHERE most > 300""")
def audit_scenes(spark, sf):
    return A.scene_checks(read(spark, sf, "manifest"), read(spark, sf, "scenes")).select("check", "severity", "slug")


@query("SELECT slug, count(*) AS n, sum((match_type <> 'unmatched')::INT)::BIGINT AS matched, round(avg((match_type <> 'unmatched')::INT) * 100, 2) AS rate FROM (SELECT char_id, any_value(slug) AS slug, any_value(match_type) AS match_type FROM characters GROUP BY char_id) GROUP BY ROLLUP (slug)")
def audit_match_rate(spark, sf):
    return A.match_rates(read(spark, sf, "characters"))


@query(f"""WITH r AS (SELECT DISTINCT f.slug, m.* FROM (SELECT DISTINCT slug, tmdb_id FROM manifest WHERE trim(tmdb_id, ' ') NOT IN ('', '0')) f JOIN {LATEST_METADATA} m USING (tmdb_id))
    SELECT 'no_overview' AS "check", 'CRITICAL' AS severity, slug FROM r WHERE trim(coalesce(overview, ''), ' ') = '' UNION ALL SELECT 'no_cast', 'CRITICAL', slug FROM r WHERE coalesce(len("cast"), 0) = 0
    UNION ALL SELECT 'no_directors', 'WARNING', slug FROM r WHERE coalesce(len(directors), 0) = 0 UNION ALL SELECT 'no_genres', 'WARNING', slug FROM r WHERE coalesce(len(genres), 0) = 0 UNION ALL SELECT 'no_poster', 'WARNING', slug FROM r WHERE trim(coalesce(poster_url, ''), ' ') = ''""")
def audit_completeness(spark, sf):
    return A.completeness(read(spark, sf, "manifest"), read(spark, sf, "metadata")).select("check", "severity", "slug")


_MEANING = "list_filter(list_distinct(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), ' +')), lambda w: w NOT IN ('', 'the', 'a', 'an', 'of', 'in', 'and', 'to'))"


@query(f"""WITH r AS (SELECT f.*, m.title AS known, {_MEANING.format('f.title')} AS a, {_MEANING.format('m.title')} AS b FROM (SELECT DISTINCT filename, slug, tmdb_id, title FROM manifest) f JOIN {LATEST_METADATA} m USING (tmdb_id))
    SELECT slug, filename, CASE WHEN len(list_intersect(a, b)) / greatest(len(a), len(b), 1) < 0.4 THEN 'CRITICAL' ELSE 'INFO' END AS severity FROM r WHERE regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g') <> regexp_replace(lower(known), '[^a-z0-9 ]', '', 'g')""")
def audit_titles(spark, sf):
    rows = read(spark, sf, "manifest").select("filename", "slug", "tmdb_id", "title").distinct()
    issues = A.title_and_year(rows.withColumn("slug", F.concat_ws("\t", "slug", "filename")), read(spark, sf, "metadata")).where(F.col("check") == "title_mismatch")
    return issues.select(F.split("slug", "\t")[0].alias("slug"), F.split("slug", "\t")[1].alias("filename"), "severity")


@query(f"""SELECT f.slug, f.filename FROM (SELECT DISTINCT filename, slug, tmdb_id, title, nullif(regexp_extract(filename, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:$|[^0-9])', 1), '')::INT AS y FROM manifest) f JOIN {LATEST_METADATA} m USING (tmdb_id)
    WHERE regexp_full_match(left(coalesce(release_date, ''), 4), '[0-9]{{4}}') AND abs(y - left(release_date, 4)::INT) > 1""")
def audit_years(spark, sf):
    rows = read(spark, sf, "manifest").select("filename", "slug", "tmdb_id", "title").distinct()
    issues = A.title_and_year(rows.withColumn("slug", F.concat_ws("\t", "slug", "filename")), read(spark, sf, "metadata")).where(F.col("check") == "year_mismatch")
    return issues.select(F.split("slug", "\t")[0].alias("slug"), F.split("slug", "\t")[1].alias("filename"))


@query(f"SELECT DISTINCT 'ambiguous_title' AS \"check\", 'INFO' AS severity, slug, title AS message FROM manifest WHERE lower(title) IN (SELECT lower(title) FROM {LATEST_METADATA} GROUP BY 1 HAVING count(*) > 1)")
def audit_ambiguous(spark, sf):
    return A.ambiguous_by_metadata(read(spark, sf, "manifest"), read(spark, sf, "metadata"))


@query("""WITH l AS (SELECT scene_id, any_value(slug) AS slug, any_value(scene_number) AS scene_number, any_value(heading) AS heading, any_value(action_lines[1]) AS first_action FROM scenes WHERE slug IS NOT NULL GROUP BY scene_id),
    p AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY scene_number NULLS LAST, scene_id) AS place, count(*) OVER (PARTITION BY slug) AS n FROM l) SELECT slug, scene_id FROM p WHERE place = n // 2 + 1""")
def middle_scenes(spark, sf):
    return A.middle_scenes(read(spark, sf, "scenes")).select("slug", "scene_id")


@query("""WITH c AS (SELECT char_id, any_value(slug) AS slug, any_value(match_type) AS match_type, any_value(screenplay_name) AS name, any_value(scene_count) AS n FROM characters GROUP BY char_id),
    p AS (SELECT slug, count(*) AS n, avg((match_type <> 'unmatched')::INT) AS rate, list(name ORDER BY n DESC NULLS LAST, name) FILTER (match_type = 'unmatched') AS lost FROM c GROUP BY slug)
    SELECT 'match_rate' AS "check", CASE WHEN n > 5 THEN 'WARNING' ELSE 'INFO' END AS severity, slug, coalesce(array_to_string(lost[1:5], ', '), '') AS message FROM p WHERE rate < 0.4
    UNION ALL SELECT DISTINCT 'no_characters', 'WARNING', slug, '0 characters' FROM manifest WHERE slug IS NOT NULL AND slug NOT IN (SELECT slug FROM characters WHERE slug IS NOT NULL)""")
def audit_matches(spark, sf):
    return A.match_checks(read(spark, sf, "characters"), read(spark, sf, "manifest"))


@query("SELECT 'x' AS \"check\", 'x' AS severity, 'x' AS slug, 'x' AS message WHERE false")
def audit_empty(spark, sf):
    """No tables, no issues."""
    none = lambda t: read(spark, sf, t).limit(0)
    return A.audit(none("manifest"), none("metadata"), none("scenes"), none("characters"), ["x"])


@query(f"SELECT tmdb_id AS movie_id, title, row_number() OVER (ORDER BY title NULLS FIRST, tmdb_id) AS place FROM {LATEST_METADATA}")
def movies_by_title(spark, sf):
    # A list for people to look at: the whole of it is ordered.
    return _registry(spark, sf).select("movie_id", "title", F.row_number().over(Window.orderBy("title", "movie_id")).alias("place"))


@query("SELECT char_id, slug, screenplay_name, row_number() OVER (PARTITION BY slug ORDER BY scene_count DESC NULLS LAST, char_id) AS place FROM (SELECT char_id, any_value(slug) AS slug, any_value(screenplay_name) AS screenplay_name, any_value(scene_count) AS scene_count FROM characters GROUP BY char_id)")
def characters_by_scenes(spark, sf):
    return N.by_scenes(read(spark, sf, "characters").dropDuplicates(["char_id"]), "char_id").select("char_id", "slug", "screenplay_name", "place")


@query("SELECT DISTINCT slug FROM manifest WHERE slug NOT IN (SELECT slug FROM scenes WHERE slug IS NOT NULL)")
def audit_missing_outputs(spark, sf):
    return A.missing_outputs(read(spark, sf, "manifest"), {"scenes": read(spark, sf, "scenes")}).select("slug")


@query("SELECT DISTINCT slug FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM metadata d WHERE d.tmdb_id = m.tmdb_id)")
def audit_missing_metadata(spark, sf):
    return A.missing_metadata(read(spark, sf, "manifest"), read(spark, sf, "metadata")).select("slug")


# --- video ------------------------------------------------------------------------------------------------------


def _clips(spark, sf) -> DataFrame:
    """Scenes as clips of their movie: action, dialogue and heading as fields, through JSON."""
    clip = F.struct(F.array_join(X.non_empty("action_lines"), " ").alias("action"), F.col("heading").alias("visual_description"), X.dialogue_text().alias("concatenated_transcript"), F.lit("l").alias("youtube_link"), F.lit("0").alias("timestamp"), F.col("heading").alias("description"))
    rows = _scenes(spark, sf).where("slug is not null").select("slug", "scene_id", clip.alias("c"))
    movies = rows.groupBy("slug").agg(F.struct(F.lit("a story").alias("plot_summary"), F.array(F.lit("x"), F.lit("y")).alias("themes"), F.lit("").alias("tone"), F.map_from_entries(F.collect_list(F.struct("scene_id", "c"))).alias("clips")).alias("m"))
    return V.parse_clips(movies.select(F.to_json(F.create_map("slug", "m")).alias("value")))


_UNPIVOT = f"""
    WITH s AS (SELECT slug, scene_id, heading, array_to_string(list_filter(coalesce(action_lines, []), lambda x: coalesce(x, '') <> ''), ' ') AS act FROM {SCENES} WHERE slug IS NOT NULL),
    u AS (SELECT slug AS movie, scene_id AS clip_id, 'action' AS field_type, act AS content FROM s UNION ALL SELECT slug, scene_id, 'visual_description', heading FROM s UNION ALL SELECT slug, scene_id, 'description', heading FROM s
          UNION ALL SELECT DISTINCT slug, '', 'plot_summary', 'a story' FROM s UNION ALL SELECT DISTINCT slug, '', 'themes', 'x, y' FROM s)"""


@query(_UNPIVOT + " SELECT movie || '__' || CASE WHEN clip_id = '' THEN 'movie' ELSE clip_id END || '__' || field_type AS id, movie, clip_id, field_type, content FROM u WHERE trim(content, ' ') <> ''")
def field_unpivot(spark, sf):
    return V.unpivot(_clips(spark, sf)).select("id", "movie", "clip_id", "field_type", "content")


@query(f"""WITH {bm25_sql(f"SELECT scene_id AS doc_key, heading AS text FROM {SCENES}", CASES, UNICODE)}, a AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM scored),
    lists AS (SELECT query_id, 0 AS list_no, 'visual' AS field_type, doc_key, rank FROM a WHERE rank <= 10 UNION ALL SELECT query_id, 1, 'description', doc_key, 11 - rank FROM a WHERE rank <= 10),
    f AS (SELECT query_id, doc_key, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, min((list_no, rank)) AS seen, 'visual,description' AS matched_fields FROM lists GROUP BY query_id, doc_key)
    SELECT query_id, doc_key AS clip_id, rrf_score, matched_fields, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen, doc_key) AS retrieval_rank FROM f""")
def rrf_video_fields(spark, sf):
    rows = _scenes(spark, sf).select(F.col("scene_id").alias("doc_key"), F.col("heading").alias("text"))
    a = S.top(S.bm25_scores(rows, cases(spark, sf), unicode=True), 10, ["query_id"])
    w = Window.partitionBy("query_id")
    one = a.select("query_id", F.lit(0).alias("list_no"), F.lit("visual").alias("field_type"), F.lit("m").alias("movie"), F.col("doc_key").alias("clip_id"), "rank")
    two = a.select("query_id", F.lit(1).alias("list_no"), F.lit("description").alias("field_type"), F.lit("m").alias("movie"), F.col("doc_key").alias("clip_id"), (11 - F.col("rank")).alias("rank"))
    return V.fuse(one.unionByName(two), ["query_id"]).select("query_id", "clip_id", "rrf_score", F.array_join("matched_fields", ",").alias("matched_fields"), "retrieval_rank")


@query()
def video_query(spark, sf):
    # Parsed once: each field's list would aggregate and parse the movies anew.
    clips = cut(_clips(spark, sf))
    return V.query(V.unpivot(clips), V.transcripts(clips), "what does the watchmaker say about the lantern", fields=("dialogue", "action"), top_k=10)


# --- retrieval --------------------------------------------------------------------------------------------------


def _retriever(spark, sf) -> S.Retriever:
    scenes, metadata = read(spark, sf, "scenes"), read(spark, sf, "metadata")
    # As a build stores them, once for an application.
    at = (spark.sparkContext.applicationId, sf, "build")
    if at not in _STORES:
        path = f"{shared_dir(spark)}/build-{uuid.uuid4().hex}"
        I.index_documents(scenes, metadata).write.partitionBy("index").parquet(f"{path}/documents")
        _registry(spark, sf).write.parquet(f"{path}/registry")
        N.people(metadata).write.parquet(f"{path}/people")
        I.write_sparse(spark.read.parquet(f"{path}/documents"), f"{path}/sparse")
        _STORES[at] = path
    table = lambda n: spark.read.parquet(f"{_STORES[at]}/{n}")
    return S.Retriever(table("documents"), table("registry"), people=table("people"), sparse=I.SparseIndex(spark, f"{_STORES[at]}/sparse"))


_PLOT = f"SELECT tmdb_id AS doc_key, trim(coalesce(nullif(wiki_plot, ''), overview), ' ') AS text FROM {LATEST_METADATA} WHERE trim(coalesce(nullif(wiki_plot, ''), overview), ' ') <> ''"


@query(f"""WITH {bm25_sql(_PLOT, "SELECT 0 AS query_id, 'the watchmaker hides a lantern in the harbor' AS query_text")}, ranked AS (SELECT * FROM ({TOP}) WHERE rank <= 80),
    allowed AS (SELECT tmdb_id AS doc_key FROM (SELECT tmdb_id, genres, CASE WHEN regexp_full_match(trim(left(coalesce(release_date, ''), 4)), '[0-9]+') THEN left(release_date, 4)::INT END AS y FROM {LATEST_METADATA}) WHERE (y IS NULL OR y >= 1960) AND len(list_filter(genres, lambda g: contains(lower(g), 'drama') OR contains('drama', lower(g)))) > 0),
    kept AS (SELECT doc_key, row_number() OVER (ORDER BY rank) AS rank FROM ranked WHERE doc_key IN (SELECT doc_key FROM allowed))
    SELECT doc_key AS movie_id, round(1.0 / (60 + rank), 4) AS score, rank FROM kept WHERE rank <= 10""")
def retrieve_filtered(spark, sf):
    plan = P.QueryPlan("filtered", ["plot"], genre="Drama", year_min=1960)
    found = _retriever(spark, sf).retrieve(plan, "the watchmaker hides a lantern in the harbor", mode="bm25", top_k=10)
    return found.select("movie_id", "score", "rank")


@query()
def retrieve_hybrid(spark, sf):
    retriever = _retriever(spark, sf)
    # Not written: at 3 KB a row the vectors of all indices would be 20 times the tables; each search makes those of its index.
    retriever.vectors = I.hashed_vectors(retriever.docs, ["index", "doc_key"])
    text = "a widow drops the brass compass under the lamp"

    retriever.embed = lambda words: I.hashed_vector(spark, words)
    return retriever.retrieve(P.QueryPlan("complex_scene", ["scene"]), text, top_k=10)


def _list_sql(no: int, docs: str, movie: str, text: str, pool: int) -> str:
    """One list of retrieve(): filled up with documents of score 0 in order of their key."""
    return f"""SELECT {no} AS list_no, doc_key, {movie} AS movie_id, rank FROM (WITH {bm25_sql(docs, f"SELECT 0 AS query_id, '{text}' AS query_text")},
        filled AS (SELECT doc_key, coalesce(score, 0.0) AS score FROM docs LEFT JOIN scored USING (doc_key)) SELECT doc_key, row_number() OVER (ORDER BY score DESC, doc_key) AS rank FROM filled) l {'JOIN (SELECT scene_id AS doc_key, movie_id FROM ' + SCENES + ') USING (doc_key)' if movie == 'movie_id' else ''} WHERE rank <= {pool}"""


_SPOKEN_DOCS = f"SELECT scene_id AS doc_key, text FROM (SELECT scene_id, {DIALOGUE_TEXT} AS text FROM {SCENES}) WHERE trim(text, ' ') <> ''"


@query(f"""WITH lists AS ({_list_sql(0, _PLOT, 'doc_key', 'a letter in the harbor', 20)} UNION ALL {_list_sql(1, _SPOKEN_DOCS, 'movie_id', 'put the kettle down', 20)}),
    fused AS (SELECT doc_key, max(movie_id) AS movie_id, sum(1.0 / (60 + rank)) AS rrf_score, min((list_no, rank)) AS seen FROM lists GROUP BY doc_key),
    hits AS (SELECT *, row_number() OVER (ORDER BY round(rrf_score, 10) DESC, seen, doc_key) AS rank FROM fused),
    m AS (SELECT movie_id, sum(rrf_score) AS total, min(rank) AS first_hit, list(doc_key ORDER BY rank)[1:3] AS top_scenes FROM hits WHERE rank <= 20 GROUP BY movie_id),
    outs AS (SELECT tmdb_id FROM {LATEST_METADATA} WHERE contains(lower(trim(title, ' ')), 'the ninth lighthouse') OR contains('the ninth lighthouse', lower(trim(title, ' ')))),
    kept AS (SELECT *, count(*) FILTER (movie_id IS NULL OR movie_id NOT IN (SELECT tmdb_id FROM outs)) OVER () AS n_left FROM m)
    SELECT movie_id, round(total, 4) AS score, top_scenes, row_number() OVER (ORDER BY round(total, 10) DESC, first_hit) AS rank FROM kept WHERE n_left = 0 OR movie_id IS NULL OR movie_id NOT IN (SELECT tmdb_id FROM outs) QUALIFY rank <= 10""")
def retrieve_multi_aspect(spark, sf):
    plan = P.QueryPlan.validated({"query_type": "multi_aspect", "sub_queries": [{"intent": "plot", "text": "a letter in the harbor"}, {"intent": "dialogue", "text": "put the kettle down"}], "exclude_titles": ["The Ninth Lighthouse"]})
    return _retriever(spark, sf).retrieve(plan, "a letter in the harbor and someone says put the kettle down", mode="bm25", top_k=10)


# --- incremental ------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT slug FROM manifest WHERE slug NOT IN (SELECT slug FROM characters WHERE slug IS NOT NULL)")
def incremental_new_slugs(spark, sf):
    return G.new_rows(read(spark, sf, "manifest").select("slug").distinct(), read(spark, sf, "characters").select("slug"), "slug")


@query(INDEX_SQL + """ SELECT "index", count(*) AS n FROM idx WHERE trim(text, ' ') <> '' GROUP BY "index" """)
def incremental_append(spark, sf):
    every = I.index_documents(read(spark, sf, "scenes"), read(spark, sf, "metadata"))
    old = every.where(F.pmod(F.xxhash64("doc_key"), F.lit(2)) == 0)
    return G.append_documents(old, every).groupBy("index").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_incremental_ingest(spark, sf):
    """Events taken in by file, once, into the shared folder."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.write.parquet(f"{at}/in")
    schema = source.schema.simpleString()[7:-1].replace(":", " ")
    G.run_available(spark, f"{at}/in", schema, f"{at}/checkpoint", G.parquet_sink(f"{at}/out"))
    return spark.read.schema(source.schema).parquet(f"{at}/out/batch=*").groupBy("event_type").agg(F.count("*").alias("n"))
