"""Files matched to records of the same film without a shared key (problem 1).

Probabilistic record linkage. Titles of both sides are taken apart into names,
words that many titles share, sequel number and year. What a word is called in
another language is learned from the records whose two titles differ. Several
passes of blocking on pairs of names bring candidates together; each candidate
gets a level of agreement for title, year and cast. Expectation-maximisation over
the counts of level patterns, begun from the files that are resolved already,
estimates how often matches and non-matches show each level. The posterior
probability, shared among the records that fit one file, is the confidence.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake import runtime
from scenelake.llm.canonical import _NEAR, _VOWELS, ORDINALS, distance
from scenelake.llm.names import normal

CONFIDENCE = 0.3  # so that of two records that fit equally well, the more popular is given with less than half
COMMON_SHARE = 0.002  # share of the records' titles from which on a word says nothing about which film
ROUNDS = 60
LEAST_LIKELY = 0.01  # under which a record takes no part in sharing a file's probability
MOST_WORDS = 100_000  # words that the executors hold, beyond it an error
LEVELS = ["title_level", "year_level", "cast_level"]
LEAST_TRANSLATED = 3  # records whose titles must pair two words, and
TRANSLATED_SHARE = 0.5  # the share of a foreign word's records, for one to translate the other

# Fixed: little words of titles in the four languages.
LITTLE = frozenset("the a an of in ln 1n 0f from le la les l un une du de des d dans der die das den dem von im aus ein eine el los las del en s".split())
# Fixed: what uploaders add to titles.
_ADDED = re.compile(r"(?i)[\s_.,(\[-]*\b(?:final|v\d+|\d(?:st|nd|rd|th)\s*draft|(?:first|second|third|shooting|final|revised)\s*(?:draft|script)|draft|screenplay|script|(?:clean\s*)?scan|rev(?:ised|ision)?\.?\s*(?:blue|pink|white|yellow|green)?|the movie|film|ocr|copy\d*)\b[\s)\]._-]*$")


_LETTER, _HARD_C, _DOUBLED, _VOWEL = re.compile("[a-z]"), re.compile(r"c(?!h)"), re.compile(r"(.)\1+"), re.compile("[aeiou]")
_DIGITS = str.maketrans("013457", "oieast")


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """A word without accents, with look-alike digits as letters and spellings of one sound made one."""
    word = word.casefold()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    if _LETTER.search(word):
        word = word.translate(_DIGITS)
    for a, b in (("ph", "f"), ("ck", "k"), ("sch", "sh"), ("ou", "u"), ("oo", "u"), ("dj", "j"), ("qu", "k"), ("y", "i")):
        word = word.replace(a, b)
    word = _HARD_C.sub("k", word)
    word = _DOUBLED.sub(r"\1", word)
    return word[:-1] if len(word) > 4 and word.endswith("e") else word


@lru_cache(maxsize=200_000)
def bones(word: str) -> str:
    """The consonants of a folded word."""
    return _DOUBLED.sub(r"\1", _VOWEL.sub("", fold(word)))


_LITTLE = frozenset(fold(w) for w in LITTLE)
_DOT, _CUT, _WORD, _GENITIVE = re.compile(r"(?<=\S)[.](?=\S)"), re.compile(r"(?:\.{2,}|…|\w\.)\W*$"), re.compile(r"[^\W_]+"), re.compile(r"['’]s\b")
_YEAR = re.compile(r"(?:^|[\s.(\[-])((?:19|20)\d\d)[)\]]?\W*$")
_SUFFIX = re.compile(r"\.\w{2,5}$")


class Parsed:
    """A title as uploaded or recorded: words without little ones, number of the sequel, year."""

    def __init__(self, text: str):
        text = unicodedata.normalize("NFKC", text or "").replace("_", " ").replace("&", " and ")
        text = _DOT.sub(" ", text)
        self.year = None
        self.cut = bool(_CUT.search(text))
        for _ in range(3):
            m = _YEAR.search(text)
            if m:
                self.year = int(m[1])
                text = text[: m.start()]
            text = _ADDED.sub("", text)
        words = _WORD.findall(_GENITIVE.sub("", text))
        self.sequel = 1
        kept = []
        for i, w in enumerate(words):
            low = w.casefold()
            if i >= 2 and i == len(words) - 1 and low in ORDINALS and ORDINALS[low] > 1:
                self.sequel = ORDINALS[low]
                if kept and kept[-1] in ("part", "pt", "teil", "vol", "volume", "parte", "partie"):
                    kept.pop()
                continue
            kept.append(low)
        self.words = [w for w in (fold(x) for x in kept) if w and (w not in _LITTLE or len(kept) < 2)]


class Reader:
    """Titles taken apart, each once, with words that have a translation in its place."""

    def __init__(self, translations: dict[str, str]):
        self.translations = translations
        self.known: dict[str, Parsed] = {}

    def __call__(self, text: str | None) -> Parsed:
        found = self.known.get(text or "")
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[text or ""] = Parsed(text or "")
            found.words = [self.translations.get(w, w) for w in found.words]
        return found

    def of_file(self, name: str, title: str | None) -> list[Parsed]:
        """What the uploader's title and the file name say."""
        return [self(title), self(_SUFFIX.sub("", name).replace("-", " "))]


@lru_cache(maxsize=200_000)
def _letters(word: str) -> tuple[dict[str, int], dict[str, float]]:
    """How often each letter stands in a word, and the least that losing one costs if no near letter can take its place."""
    counts = Counter(word)
    twice = {x for x, y in zip(word, word[1:]) if x == y}
    return counts, {x: 0.5 if x in twice else 0.6 if x in _VOWELS else 1.0 for x in counts}


_CLOSE: dict[str, frozenset[str]] = {x: frozenset(y for pair in _NEAR if x in pair for y in pair) - {x} for x in frozenset().union(*_NEAR)}


def least_distance(a: str, b: str) -> float:
    """A lower bound of distance(): a letter that one word has more often than the other must be swapped, dropped or added there."""
    (x, lost), (y, gained) = _letters(a), _letters(b)
    sums = []
    for mine, costs, others in ((x, lost, y), (y, gained, x)):
        total = 0.0
        for letter, n in mine.items():
            n -= others.get(letter, 0)
            if n > 0:
                near = _CLOSE.get(letter)
                total += n * (0.5 if near and not near.isdisjoint(others) else costs[letter])
        sums.append(total)
    return max(sums)


@lru_cache(maxsize=400_000)
def word_likeness(a: str, b: str) -> float:
    """1 for equal folded words, less for the same consonants, one or two errors, else 0."""
    if a == b:
        return 1.0
    x, y = bones(a), bones(b)
    if x == y and len(x) >= 2 and (len(x) >= 3 or a == x or b == y):
        return 0.9
    # Most pairs differ in more letters than any rule below allows; the sums are rounded, so the bounds are a little wider.
    if least_distance(a, b) > 2.2001 and (min(len(x), len(y)) < 4 or least_distance(x, y) > 1.0001):
        return 0.0
    d = distance(a, b, 2.5)
    if d <= 1.2 and min(len(a), len(b)) >= 3:
        return 0.85
    if d <= 2.2 and min(len(a), len(b)) >= 5 or len(x) >= 4 and len(y) >= 4 and distance(x, y, 1.0) <= 1.0 and d <= 3.5:
        return 0.7
    return 0.0


def title_level(file: Parsed, record: Parsed, common: frozenset[str]) -> int:
    """5 all words equal, 4 all alike, 3 alike but for a cut or garbled word, 2 names alike, the rest different, 1 less, 0 other sequel."""
    if not file.words or not record.words:
        return 1
    if file.sequel != record.sequel:
        return 0
    free = list(range(len(file.words)))
    likeness, missed = [], []
    for word in sorted(record.words, key=lambda w: w in common):
        if missed and missed[0] not in common and not bones(missed[0]).startswith(bones(file.words[-1])):
            return 1  # another name, and no part of it either
        best = max(((word_likeness(file.words[i], word), -i) for i in free), default=(0.0, 0))
        if best[0] > 0:
            free.remove(-best[1])
            likeness.append(best[0])
        else:
            missed.append(word)
    if file.cut or missed:
        for word in list(missed):
            i = next((i for i in free if i == len(file.words) - 1 and word.startswith(file.words[i]) or file.words[i] and i == len(file.words) - 1 and bones(word).startswith(bones(file.words[i])) and bones(file.words[i])), None)
            if i is not None:
                free.remove(i)
                missed.remove(word)
                likeness.append(0.7)
    names = [w for w in record.words if w not in common]
    lost_names = [w for w in missed if w in names]
    strange = [file.words[i] for i in free]
    if not missed and not strange:
        return 5 if min(likeness) == 1 else 4 if sum(likeness) / len(likeness) >= 0.8 else 3
    if lost_names:
        return 3 if file.cut and len(lost_names) == 1 and len(likeness) >= 2 and not strange and len(missed) == 1 else 1
    # Words both know but only one has make another film; garbled ones may stand for what is missing.
    if any(w in common for w in strange) or len(missed) > len(strange) or "and" in missed:
        return 2
    return 3 if all(any(_remote(w, x) for x in strange) for w in missed) else 2


def _remote(a: str, b: str) -> bool:
    """Whether one word may be a badly garbled form of the other."""
    x, y = bones(a), bones(b)
    return bool(x and y) and (x[0] == y[0] or x[-1] == y[-1]) and distance(x, y, 3.0) <= 0.6 * max(len(x), len(y))


def title_keys(title: Parsed, common: frozenset[str]) -> set[str]:
    """Passes of blocking: one name by its consonants with the beginning of another, and two names in order, each whole or without one consonant."""
    named = [bones(w) for w in title.words if w not in common]
    named = [n for n in named if n]
    if len(named) < 2:
        return {"=" + " ".join(sorted(bones(w) or w for w in title.words))} | {f"1{n}" for n in named if len(n) > 2}
    keys = set()
    for i, a in enumerate(named):
        for j, b in enumerate(named):
            if i != j:
                keys.add(f"{a}|{b[:1]}")
            if i < j:
                keys |= {f"{x}~{y}" for x in _shortened(a) for y in _shortened(b)}
    return keys


def _shortened(consonants: str) -> set[str]:
    """The consonants and what they become without one, unless one alone would be left."""
    return {consonants} | ({consonants[:k] + consonants[k + 1 :] for k in range(len(consonants))} if len(consonants) > 2 else set())


def year_level(year: int | None, released: int | None) -> int:
    """3 the same year, 2 a year apart, 1 unknown, 0 further apart."""
    if not year or not released:
        return 1
    return 3 if year == released else 2 if abs(year - released) == 1 else 0


def release_year(column):
    """The year in a date of any form."""
    return F.expr(f"try_cast(regexp_extract({column}, '((?:19|20)[0-9]{{2}})', 1) as int)")


def fit(patterns: dict[tuple[int, ...], int], known: dict[tuple[int, ...], int] | None = None, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior probability of a match by pattern of levels, by expectation-maximisation from counts of patterns.

    Levels are taken as independent within matches and within non-matches; each
    is smoothed by half a count. The start is the share of pairs that agree no better
    in each field. The `known` pairs are matches in every round and weigh together
    as much as those found.
    """
    if not patterns:
        return {}
    fields = range(len(next(iter(patterns))))
    levels = [sorted({p[f] for p in patterns}) for f in fields]
    total = sum(patterns.values())

    def shares(counts: dict[tuple[int, ...], float]) -> list[dict[int, float]]:
        found = []
        for f in fields:
            table = {v: 0.5 for v in levels[f]}
            for p, n in counts.items():
                if p[f] in table:
                    table[p[f]] += n
            whole = sum(table.values())
            found.append({v: x / whole for v, x in table.items()})
        return found

    known = known or {}
    below = [{v: sum(n for p, n in patterns.items() if p[f] <= v) / total for v in levels[f]} for f in fields]
    posterior = {p: math.prod(below[f][p[f]] for f in fields) ** 2 for p in patterns}
    for _ in range(rounds):
        found = sum(n * posterior[p] for p, n in patterns.items())
        weight = min(1.0, found / max(1, sum(known.values())))
        share = min(0.99, max(0.001, found / total))
        match = shares({p: patterns.get(p, 0) * posterior.get(p, 0.0) + weight * known.get(p, 0) for p in {**patterns, **known}})
        other = shares({p: n * (1 - posterior[p]) for p, n in patterns.items()})
        for p in patterns:
            a = math.log(share) + sum(math.log(match[f][p[f]]) for f in fields)
            b = math.log1p(-share) + sum(math.log(other[f][p[f]]) for f in fields)
            posterior[p] = 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))
    return posterior


USABLE = "tmdb_id is not null and trim(tmdb_id) not in ('', '0')"


def unresolved(manifest: DataFrame) -> DataFrame:
    """(filename, title, slug) of the files whose tmdb_id is null, blank or '0'."""
    return manifest.where(f"not ({USABLE}) and filename is not null").select("filename", "title", "slug").distinct()


def records(metadata: DataFrame) -> DataFrame:
    """One row for each tmdb_id, the latest; cast as the names of the roles; popularity 0 where there is none."""
    if "popularity" not in metadata.columns:
        metadata = metadata.withColumn("popularity", F.lit(0.0))
    order = F.struct(F.coalesce("fetched_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("title", F.lit("")))
    latest = metadata.where(USABLE).groupBy("tmdb_id").agg(
        F.max_by(F.struct("title", "original_title", "release_date", "popularity", F.col("cast.character").alias("roles")), order).alias("m")
    )
    return latest.select("tmdb_id", "m.title", "m.original_title", release_year("m.release_date").alias("released"), F.coalesce("m.popularity", F.lit(0.0)).alias("popularity"), "m.roles")


def translations(films: DataFrame) -> dict[str, str]:
    """Words of one of a record's two titles with the word of the other that stands for them, by how many records pair the two.

    What both titles hold is left out, and what is left of either is paired. A word
    of many records can be few only, so the result is bounded: at most one word in
    LEAST_TRANSLATED records has an entry, and frequent ones are those of titles' nouns.
    """

    def paired(batches):
        read = Reader({})
        for batch in batches:
            out = []
            for film, title, original in zip(batch["tmdb_id"], batch["title"], batch["original_title"]):
                a, b = read(title).words, read(original).words
                only_a, only_b = set(a) - set(b), set(b) - set(a)
                out += [(film, y, x) for y in only_b for x in [*only_a, ""]] + [(film, x, y) for x in only_a for y in [*only_b, ""]]
            yield pd.DataFrame(out, columns=["film", "foreign", "own"])

    apart = films.where("title is not null and original_title is not null and lower(title) <> lower(original_title)")
    pairs = apart.select("tmdb_id", "title", "original_title").mapInPandas(paired, "film string, foreign string, own string").groupBy("foreign", "own").agg(F.count("*").alias("n"))
    whole = pairs.where("own = ''").select("foreign", F.col("n").alias("of"))
    likely = pairs.where(F.col("own") != "").join(whole, "foreign").where((F.col("n") >= LEAST_TRANSLATED) & (F.col("n") >= TRANSLATED_SHARE * F.col("of")))
    best = likely.groupBy("foreign").agg(F.max_by("own", F.struct("n", "own")).alias("own"))
    found = {r["foreign"]: r["own"] for r in runtime.bounded_rows(best, MOST_WORDS)}
    if not found:
        return {}
    # Of two words that stand for each other, the one that more titles have is kept.
    wanted = frozenset(found) | frozenset(found.values())

    def held(batches):
        read = Reader({})
        for batch in batches:
            yield pd.DataFrame({"word": [w for t in batch["title"] for w in set(read(t).words) & wanted]}, dtype=object)

    times = {r["word"]: r["count"] for r in films.select("title").mapInPandas(held, "word string").groupBy("word").count().collect()}
    return {a: b for a, b in found.items() if times.get(a, 0) < times.get(b, 0)}


def frequent_words(films: DataFrame, read: Reader) -> frozenset[str]:
    """Words in so many records' titles that they don't tell films apart; a title has a few words, so these can be a few thousand at most."""

    def title_words(batches):
        for batch in batches:
            yield pd.DataFrame({"word": [w for t in batch["title"] for w in set(read(t).words)]}, dtype=object)

    count = films.count()
    counted = films.select("title").mapInPandas(title_words, "word string").groupBy("word").count().where(F.col("count") >= max(4, COMMON_SHARE * count))
    return frozenset(r["word"] for r in runtime.bounded_rows(counted, MOST_WORDS))


def levels(batch: pd.DataFrame, read: Reader, common: frozenset[str]) -> tuple[list[int], list[int]]:
    """Levels of title and year of each row's file and record."""
    titles, years = [], []
    # A file and a record have many pairs in a batch; what they say is gathered once.
    files, films = {}, {}
    for name, title, a, b, released in zip(batch["filename"], batch["title"], batch["film_title"], batch["film_original"], batch["released"]):
        if (name, title) not in files:
            said = read.of_file(name, title)
            files[name, title] = said, list({(tuple(x.words), x.sequel, x.cut): x for x in said if x.words}.values())
        if (a, b) not in films:
            films[a, b] = list({(tuple(y.words), y.sequel): y for x in (a, b) if x for y in [read(x)]}.values())
        (mine, own), theirs = files[name, title], films[a, b]
        found = [title_level(x, y, common) for x in own for y in theirs]
        titles.append(0 if found and min(found) == 0 and any(m.sequel > 1 for m in mine) and max(found) < 3 else max(found, default=1))
        year = next((m.year for m in reversed(mine) if m.year), None)
        years.append(year_level(year, None if pd.isna(released) else int(released)))
    return titles, years


def keyed_files(files: DataFrame, read: Reader, common: frozenset[str]) -> DataFrame:
    """(key, filename, title, slug): the files under all their blocking keys."""

    def keys(batches):
        for batch in batches:
            out = [(key, *row) for row in zip(batch["filename"], batch["title"], batch["slug"]) for key in set().union(*(title_keys(x, common) for x in read.of_file(row[0], row[1])))]
            yield pd.DataFrame(out, columns=["key", "filename", "title", "slug"])

    return files.mapInPandas(keys, "key string, filename string, title string, slug string")


def keyed_films(films: DataFrame, read: Reader, common: frozenset[str]) -> DataFrame:
    """(key, tmdb_id, film_title, film_original, released): the records under the keys of both titles."""

    def keys(batches):
        for batch in batches:
            out = []
            for film, title, original, released in zip(batch["tmdb_id"], batch["title"], batch["original_title"], batch["released"]):
                out += [(key, film, title, original, None if pd.isna(released) else int(released)) for key in title_keys(read(title), common) | title_keys(read(original), common)]
            yield pd.DataFrame(out, columns=["key", "tmdb_id", "film_title", "film_original", "released"]).astype({"released": "Int32"})

    return films.select("tmdb_id", "title", "original_title", "released").mapInPandas(keys, "key string, tmdb_id string, film_title string, film_original string, released int")


def blocking_recall(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """(files, met): how many resolved files have a record, and how many of them share a blocking key with it."""
    films = records(metadata)
    read = Reader(translations(films))
    common = frequent_words(films, read)
    own = manifest.where(f"{USABLE} and filename is not null").select("filename", "title", F.col("tmdb_id").alias("own")).distinct().join(films.select(F.col("tmdb_id").alias("own")), "own")
    left = keyed_files(own.select("filename", "title", F.col("own").alias("slug")), read, common).withColumnRenamed("slug", "tmdb_id")
    met = left.join(keyed_films(films, read, common), ["key", "tmdb_id"]).select("filename", "tmdb_id").distinct()
    return own.agg(F.count("*").alias("files")).crossJoin(met.agg(F.count("*").alias("met")))  # a row each


def link(manifest: DataFrame, metadata: DataFrame, characters: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(filename, tmdb_id, confidence): the record each unresolved file most probably belongs to.

    Null or blank titles leave the file name to go by; null dates, casts and
    slugs make their level unknown; repeated rows count once, and of the
    refreshes of a record the latest counts. The probabilities of a file's records
    add up to 1 at most, so records that fit equally share it; between them the
    more popular is given, then the smaller id. Files for which no record reaches
    `confidence` give no row. Extra columns are ignored.
    """
    spark = manifest.sparkSession
    files, films = unresolved(manifest), runtime.cut(records(metadata))
    read = Reader(translations(films))
    common = frequent_words(films, read) | frozenset(read.translations.values())
    met = keyed_files(files, read, common).join(keyed_films(films, read, common), "key").drop("key").dropDuplicates(["filename", "title", "slug", "tmdb_id"])
    # What matches look like is first taken from the files whose record is known.
    known = manifest.where(f"{USABLE} and filename is not null").select("filename", "title", "slug", "tmdb_id").distinct().join(films.select("tmdb_id", F.col("title").alias("film_title"), F.col("original_title").alias("film_original"), "released"), "tmdb_id")
    pairs = met.withColumn("known", F.lit(False)).unionByName(known.withColumn("known", F.lit(True)))

    def judge(batches):
        for batch in batches:
            titles, years = levels(batch, read, common)
            yield batch[["filename", "slug", "tmdb_id", "known"]].assign(title_level=titles, year_level=years)

    candidates = pairs.mapInPandas(judge, "filename string, slug string, tmdb_id string, known boolean, title_level int, year_level int").where("title_level > 0 or known")

    def parts(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "parts": [sorted({p for n in names if n for p in re.findall(r"[^\W\d_]{5,}", normal(n))}) if names is not None else [] for names in batch["names"]]})

    spoken = characters.where("slug is not null").groupBy(F.col("slug").alias("id")).agg(F.collect_set("screenplay_name").alias("names")).mapInPandas(parts, "id string, parts array<string>")
    played = films.select(F.col("tmdb_id").alias("id"), F.col("roles").alias("names")).mapInPandas(parts, "id string, parts array<string>")
    cast = candidates.join(spoken.select(F.col("id").alias("slug"), F.col("parts").alias("said")), "slug", "left").join(played.select(F.col("id").alias("tmdb_id"), F.col("parts").alias("played")), "tmdb_id", "left")
    shared = F.size(F.array_intersect("said", "played"))
    level = F.when(F.col("said").isNull() | F.col("played").isNull() | (F.size("said") < 3) | (F.size("played") < 3), 1).when(shared >= F.greatest(F.lit(3), F.size("played") * 0.34), 3).when(shared >= 2, 2).otherwise(0)
    judged = runtime.cut(cast.select("filename", "slug", "tmdb_id", "known", "title_level", "year_level", level.alias("cast_level")))
    counts = judged.groupBy("known", *LEVELS).count().collect()  # at most 192 patterns
    posterior = fit({tuple(r[c] for c in LEVELS): r["count"] for r in counts if not r["known"]}, {tuple(r[c] for c in LEVELS): r["count"] for r in counts if r["known"]})
    table = spark.createDataFrame([(*p, float(x)) for p, x in posterior.items()] or [(-1, -1, -1, 0.0)], "title_level int, year_level int, cast_level int, probability double")
    likely = judged.where("not known").join(F.broadcast(table), LEVELS).where(F.col("probability") >= LEAST_LIKELY)
    odds = F.col("probability") / F.greatest(F.lit(1e-12), 1 - F.col("probability"))
    # A file has a few records left here, so they are added up and compared before they meet.
    scored = likely.groupBy("filename", "tmdb_id").agg(F.max(odds).alias("odds"), F.max("probability").alias("probability")).join(films.select("tmdb_id", "popularity"), "tmdb_id")
    chosen = scored.groupBy("filename").agg(F.sum("odds").alias("all"), F.max_by(F.struct("tmdb_id", "odds"), F.struct("odds", "popularity", "tmdb_id")).alias("best"))
    return chosen.select("filename", "best.tmdb_id", (F.col("best.odds") / (1 + F.col("all"))).alias("confidence")).where(F.col("confidence") >= confidence)
