"""Sparse and dense search, filters, fusion of rankings, aggregation by movie, and retrieval by plan.

Ranked lists are tables (query_id, list_id, doc_key, movie_id, score, rank). Ties go to the smaller
doc_key after the score is rounded, so every engine that rounds alike ranks alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scenelake.functions import text as X
from scenelake.operators import index as I
from scenelake.runtime import cut, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
SCENES_A_MOVIE = 3
POOL, FILTERED_POOL = 2, 8
#: Queries and filters are sent to all executors up to this many rows; larger tables are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Query vectors that are sent to all executors at once.
QUERY_BLOCK = 2_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table after counting that it is small; a larger one is left to an ordinary join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_key", text: str = "text", query_id: str = "query_id", query_text: str = "query_text", unicode: bool = False, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, key, score) of every document that shares a term with the query.

    Okapi BM25 with idf ln(N - df + 0.5) - ln(df + 0.5); a negative idf becomes
    epsilon times the mean idf of the vocabulary; a repeated query term counts
    repeatedly. Statistics are over all documents. Null texts are empty documents.
    """
    corpus = spread(docs.select(F.col(key).alias("doc_key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    tokens = X.tokens_unicode if unicode else X.tokens_ascii
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    tokenised = I.tokenised(corpus, ["doc_key"], "text", unicode)
    # The vocabulary is counted once and written; its size and means are three numbers.
    counts = cut(I.statistics(tokenised))
    total = counts.where("term = ''").select("df", "dl").first()
    if total is None:
        return asked.select("query_id").withColumn(key, F.lit(None).cast(docs.schema[key].dataType)).withColumn("score", F.lit(0.0)).limit(0)
    n_docs, avg_dl = total["df"], total["dl"] / total["df"]
    raw = counts.where("term <> ''").select("term", (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf")).first()[0]
    wanted = small(asked.select("term").distinct())
    terms = raw.join(wanted, "term", "left_semi").select("term", F.when(F.col("idf") < 0, epsilon * F.lit(mean)).otherwise(F.col("idf")).alias("idf"), F.lit(avg_dl).alias("avg_dl"))
    # explode() would have the words made twice, to filter on their number below the exchange.
    found = tokenised.select("doc_key", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).join(wanted, "term", "left_semi")
    postings = found.groupBy("doc_key", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    # The terms of the queries, and the queries, are of the queries' size.
    scored = postings.join(small(terms), "term").select("doc_key", "term", weight.alias("w")).join(small(asked), "term")
    return scored.groupBy("query_id", "doc_key").agg(F.sum(F.col("w") * F.col("qtf")).alias("score")).withColumnRenamed("doc_key", key)


def stored_scores(stored: I.SparseIndex, queries: DataFrame, key: str = "doc_key", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """bm25_scores() from a stored index for queries (query_id, index, query_text); only the folders of the queries' terms are read.

    One lookup serves any number of queries on any of the indices. Which folders
    those are is asked once, at most BUCKETS times the indices.
    """
    tokens = X.tokens_unicode if stored.unicode else X.tokens_ascii
    asked = queries.select("query_id", "index", F.explode(tokens("query_text")).alias("term")).groupBy("query_id", "index", "term").agg(F.count("*").alias("qtf")).withColumn("bucket", I.bucket())
    places = [(r["index"], r["bucket"]) for r in asked.select("index", "bucket").distinct().collect()]
    read = F.col("index").isin(sorted({i for i, _ in places})) & F.col("bucket").isin(sorted({n for _, n in places}))
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = F.when(raw < 0, epsilon * F.col("mean_idf")).otherwise(raw)
    weighed = stored.terms.where(read).join(small(asked), ["index", "bucket", "term"]).join(F.broadcast(stored.sizes), "index")  # a row for each index
    weighed = weighed.select("query_id", "index", "bucket", "term", (F.col("qtf") * idf).alias("w"), "avg_dl")
    weight = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    found = stored.postings.where(read).join(small(weighed), ["index", "bucket", "term"])
    return found.groupBy("query_id", "doc_key").agg(F.sum(weight).alias("score")).withColumnRenamed("doc_key", key)


def top(scored: DataFrame, k: int, within: list[str], key: str = "doc_key", digits: int = 6, score: str = "score") -> DataFrame:
    """The k best rows of each list with their rank from 1; score rounded, ties by key."""
    w = Window.partitionBy(*within).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("score", F.round(score, digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_zero_scores(scored: DataFrame, docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_key", query_id: str = "query_id") -> DataFrame:
    """Lists filled up to k with documents of score 0 in order of their key, where fewer match.

    At most k of the first documents can be wanted by any list, so only k + (number
    of matches within them) candidates are added, not all documents to all queries.
    """
    first = docs.select(key).orderBy(key).limit(2 * k)  # sent to all executors, the queries are not
    pool = queries.select(query_id).crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    fresh = pool.join(scored.select(query_id, key), [query_id, key], "left_anti")
    return scored.select(query_id, key, "score").unionByName(fresh.select(query_id, key, "score"))


def until_zero(ranked: DataFrame, within: list[str]) -> DataFrame:
    """Lists that end before the first score of exactly 0."""
    w = Window.partitionBy(*within).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("zeros", F.sum((F.col("score") == 0).cast("int")).over(w)).where("zeros = 0").drop("zeros")


def dense_scores(vectors: DataFrame, queries: DataFrame, key: str = "doc_key", vector: str = "vec", query_id: str = "query_id", query_vector: str = "query_vec") -> DataFrame:
    """(query_id, key, score): inner product of every query vector with every vector, both brought to length 1.

    A stated set of queries against all rows: the queries are counted and sent to
    all executors in blocks of QUERY_BLOCK, each a pass over the vectors.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), I.unit(query_vector).alias("q")).where("q is not null")
    stored = spread(vectors.select(key, vector)).select(F.col(key).alias("doc_key"), I.unit(vector).alias("v")).where("v is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for n in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        one = stored.crossJoin(F.broadcast(block)).select("query_id", F.col("doc_key").alias(key), I.dot(F.col("v"), F.col("q")).alias("score"))
        found = one if found is None else found.unionByName(one)
    return found


def similarity(score) -> Column:
    """Cosine as a similarity between 0 and 1, to four places."""
    return F.round((1 + (F.col(score) if isinstance(score, str) else score)) / 2, 4)


def rrf(ranked: DataFrame, within: list[str], key: str = "doc_key", list_no: str = "list_no", payload: tuple[str, ...] = (), keep: str = "last", k: int = RRF_K) -> DataFrame:
    """(within..., key, payload..., rrf_score, first_list, first_rank): sum of 1 / (k + rank) over the lists; payload of the first or last list."""
    place = F.struct(list_no, "rank")
    pick = F.min_by if keep == "first" else F.max_by
    return ranked.groupBy(*within, key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.min(place).alias("seen"), *(pick(c, place).alias(c) for c in payload)
    ).select(*within, key, *payload, "rrf_score", F.col(f"seen.{list_no}").alias("first_list"), F.col("seen.rank").alias("first_rank"))


def fused_order(fused: DataFrame, within: list[str], key: str = "doc_key") -> DataFrame:
    """Fused hits with their rank: score, then the list and rank where first seen, then key."""
    w = Window.partitionBy(*within).orderBy(F.desc(F.round("rrf_score", 10)), "first_list", "first_rank", key)
    return fused.withColumn("rank", F.row_number().over(w))


def by_movie(fused: DataFrame, within: list[str], cut: Column | int, movie: str = "movie_id", key: str = "doc_key", scenes: int = SCENES_A_MOVIE) -> DataFrame:
    """(within..., movie, score, top_scenes, rank) over the hits up to `cut`: scores summed, the first few hits kept, sorted before rounding."""
    hits = fused.where(F.col("rank") <= cut)
    movies = hits.groupBy(*within, movie).agg(F.sum("rrf_score").alias("total"), F.min("rank").alias("first_hit"), F.slice(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("doc_key")))), 1, scenes).alias("top"))
    w = Window.partitionBy(*within).orderBy(F.desc(F.round("total", 10)), "first_hit")
    return movies.select(*within, movie, F.round("total", 4).alias("score"), F.transform("top", lambda t: t["doc_key"]).alias("top_scenes"), F.row_number().over(w).alias("rank"))


# --- filters ----------------------------------------------------------------------------------------------------


def genre_ids(registry: DataFrame, genre: str) -> DataFrame:
    """(movie_id) of the movies with a genre that holds the text or is held by it, in any case."""
    g = F.lower("g")
    wanted = F.lit(genre.lower())
    return registry.select("movie_id", F.explode("genres").alias("g")).where(F.contains(g, wanted) | F.contains(wanted, g)).select("movie_id").distinct()


def year_ids(registry: DataFrame, year_min: int | None, year_max: int | None) -> DataFrame:
    """(movie_id) of the movies within the years; a bound of 0 or None is open, an unreadable year passes."""
    year = F.expr("try_cast(nullif(trim(year), '') as int)")
    ok = F.lit(True)
    if year_min:
        ok &= year >= year_min
    if year_max:
        ok &= year <= year_max
    return registry.where(year.isNull() | ok).select("movie_id").distinct()


def allowed_ids(registry: DataFrame, genre: str | None, year_min: int | None, year_max: int | None) -> DataFrame | None:
    """Movies that pass genre and years; None where no filter is active. A genre no movie has filters nothing; an empty result of both does."""
    allowed = None
    if genre and genre.strip():
        found = genre_ids(registry, genre.strip())
        if not found.isEmpty():
            allowed = found
    if year_min or year_max:
        years = year_ids(registry, year_min, year_max)
        allowed = years if allowed is None else allowed.join(years, "movie_id", "left_semi")
    return allowed


def keep_allowed(ranked: DataFrame, allowed: DataFrame | None, within: list[str]) -> DataFrame:
    """Hits of allowed movies, ranks closed up. Filters after the pool was cut, as ranks depend on it."""
    if allowed is None:
        return ranked
    w = Window.partitionBy(*within).orderBy("rank")
    return ranked.join(allowed, "movie_id", "left_semi").withColumn("rank", F.row_number().over(w))


def exclude(movies: DataFrame, excluded: DataFrame, within: list[str]) -> DataFrame:
    """Movies without the excluded ones; lists that would be empty are kept whole."""
    marked = movies.join(excluded.select("movie_id").distinct().withColumn("out", F.lit(1)), "movie_id", "left")
    w = Window.partitionBy(*within)
    return marked.withColumn("left", F.sum(F.when(F.col("out").isNull(), 1).otherwise(0)).over(w)).where("out is null or left = 0").drop("out", "left")


def title_matches(registry: DataFrame, titles: DataFrame, title: str = "title") -> DataFrame:
    """(title, movie_id): movies whose title equals, holds or is held by the wanted one, in any case; '' matches all."""
    a, b = F.lower(F.trim(F.col("have"))), F.lower(F.trim(F.col("want")))
    wanted = titles.select(F.col(title).alias("want")).where("want is not null").distinct()
    # Containment has no key to join by: the wanted titles, which are few, go to all executors after a count.
    return registry.select("movie_id", F.col("title").alias("have")).join(small(wanted), (a == b) | F.contains(a, b) | F.contains(b, a)).select(F.col("want").alias(title), "movie_id").distinct()


# --- retrieval by plan ------------------------------------------------------------------------------------------


class Retriever:
    """Searches the five indices by plan: pairs of text and index, sparse and dense lists, fusion, movies."""

    def __init__(self, docs: DataFrame, registry: DataFrame, vectors: DataFrame | None = None, embed=None, people: DataFrame | None = None, sparse: I.SparseIndex | None = None):
        self.docs, self.registry, self.vectors, self.embed, self.people, self.sparse = docs, registry, vectors, embed, people, sparse

    def _sparse(self, asked: list[tuple[int, str, str]], pool: int) -> DataFrame:
        """(query_id, index, doc_key, score) of the asked (number, text, index): one lookup in the stored index, else a search of the texts of each index."""
        queries = self.docs.sparkSession.createDataFrame(asked, "query_id int, query_text string, index string")
        if self.sparse is not None:
            scored = stored_scores(self.sparse, queries)
        else:
            scored = None
            for index in sorted({i for _, _, i in asked}):
                one = bm25_scores(self.docs.where(F.col("index") == index), queries.where(F.col("index") == index))
                scored = one if scored is None else scored.unionByName(one)
        filled = None
        for index in sorted({i for _, _, i in asked}):
            own = queries.where(F.col("index") == index)
            one = with_zero_scores(scored.join(F.broadcast(own.select("query_id")), "query_id"), self.docs.where(F.col("index") == index), own, pool).withColumn("index", F.lit(index))  # a row for each list
            filled = one if filled is None else filled.unionByName(one)
        return filled

    def _dense(self, asked: list[tuple[int, str, str]]) -> DataFrame:
        spark, found = self.docs.sparkSession, None
        for index in sorted({i for _, _, i in asked}):
            queries = spark.createDataFrame([(n, [float(x) for x in self.embed(t)]) for n, t, i in asked if i == index], "query_id int, query_vec array<double>")
            one = dense_scores(self.vectors.where(F.col("index") == index), queries).withColumn("index", F.lit(index))
            found = one if found is None else found.unionByName(one)
        return found

    def retrieve(self, plan, query: str, mode: str = "hybrid", top_k: int = 10) -> DataFrame:
        """(movie_id, score, top_scenes, rank) for a validated plan; filters and entities that leave nothing open up again."""
        from scenelake.operators.entities import people_in_query

        text = plan.rewrite or query
        filtered = allowed_ids(self.registry, plan.genre, plan.year_min, plan.year_max)
        # Looked up once: each question about it below would compare the names anew.
        named = cut(people_in_query(self.people, text).select("movie_id").distinct()) if self.people is not None else None
        allowed, by_person = filtered, False
        if named is not None and not named.isEmpty():
            both = named if filtered is None else named.join(filtered, "movie_id", "left_semi")
            if not both.isEmpty():
                allowed, by_person = both, True
        pairs = [(s["text"], s["intent"]) for s in plan.sub_queries] if plan.sub_queries else [(text, i) for i in plan.intents]
        pool = top_k * (FILTERED_POOL if plan.genre or plan.year_min or plan.year_max else POOL)
        kinds = [d for d in (True, False) if mode == "hybrid" or (mode == "faiss") == d]
        if True in kinds and (self.vectors is None or self.embed is None):
            raise ValueError(f"mode {mode} needs vectors and an embedder")
        # Lists are numbered pair by pair, dense before sparse; all of one kind are looked up together.
        numbered = [(n * len(kinds) + k, words, index, dense) for n, (words, index) in enumerate(pairs) for k, dense in enumerate(kinds)]
        scored = None
        for dense in kinds:
            asked = [(no, words, index) for no, words, index, d in numbered if d == dense]
            one = self._dense(asked) if dense else self._sparse(asked, pool)
            one = one.select("query_id", "index", "doc_key", "score")
            scored = one if scored is None else scored.unionByName(one)
        movie_of = self.docs.where(F.col("index").isin(sorted({i for _, i in pairs}))).select("index", "doc_key", "movie_id")
        # At most `pool` rows for each list of the plan, so the documents' keys stay where they lie.
        ranked = cut(movie_of.join(F.broadcast(top(scored, pool, ["query_id"])), ["index", "doc_key"]).select(F.col("query_id").alias("list_no"), "doc_key", "movie_id", "score", "rank"))

        def run(limit: DataFrame | None) -> DataFrame:
            lists = keep_allowed(ranked, limit, ["list_no"]).withColumn("query_id", F.lit(0))
            fused = fused_order(rrf(lists, ["query_id"], payload=("movie_id",)), ["query_id"])
            return by_movie(fused, ["query_id"], top_k * len(pairs))

        movies = run(allowed)
        if by_person and movies.isEmpty():
            movies = run(filtered)
        if plan.exclude_titles:
            spark = self.docs.sparkSession
            wanted = spark.createDataFrame([(t,) for t in plan.exclude_titles], "title string")
            movies = exclude(movies, title_matches(self.registry, wanted), ["query_id"])
        w = Window.orderBy("rank")
        return movies.where(F.col("rank") <= top_k * len(pairs)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).drop("query_id")
