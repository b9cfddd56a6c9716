"""Free-entered values mapped to a reference list (problem 6).

The words of all reference entries go into a symmetric-delete dictionary: every
word under every string that it becomes by deleting up to two letters. A typed
word finds the reference words within that edit distance by its own deletions.
Entries that share enough found words are ranked by a weighted
Damerau-Levenshtein distance over the whole value, then by how often the corpus
holds the entry exactly. What is too far from every entry is reported with -1.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake import runtime

MISS = -1
MOST_REFERENCES = 100_000
OWN_WORD = 0.1  # of the entry's own count, from which on (and from two on) a typed value is a word of its own and no typing error

# Fixed: words around a genre that say nothing about which.
GENRE_FILLERS = frozenset("film films movie movies story stories tale tales genre flick cinema".split())
# Fixed: how sequels are counted.
ORDINALS = {w: n for n, words in enumerate(["1 i one", "2 ii two", "3 iii three", "4 iv four", "5 v five", "6 vi six", "7 vii seven", "8 viii eight", "9 ix nine"], 1) for w in words.split()}
# Fixed: characters read or typed for one another, at a lower cost.
_NEAR = {frozenset(p) for p in "0o 1l 1i il 5s 3e 4a 8b 9g 6g 7t vw uv mn ae eo ou ai ck cs zs iy jy".split()}
_VOWELS = frozenset("aeiou")


def plain(text: str) -> str:
    """Lower case without accents, digits between letters read as letters, single spaces."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    text = text.replace("&", " and ")
    text = re.sub(r"(?<=[a-z])[013457](?=[a-z])", lambda m: "oleast"["013457".index(m[0])], text)
    return " ".join(re.findall(r"[^\W_]+", text))


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance, or a value over `most` as soon as it must be greater."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > 2 * most + 2:
        return most + 1
    # Equal ends cost nothing; one letter of them stays, as doubled letters are cheaper.
    ahead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[max(0, ahead - 1) :], b[max(0, ahead - 1) :]
    behind = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    if behind > 1:
        a, b = a[: 1 - behind], b[: 1 - behind]
    before2: list[float] = []
    before = [0.0]
    for c in b:
        before.append(before[-1] + 1)
    for i, x in enumerate(a, 1):
        row = [before[0] + 1]
        for j, y in enumerate(b, 1):
            if x == y:
                row.append(before[j - 1])
                continue
            swap = 0.5 if frozenset((x, y)) in _NEAR else 1.0
            drop = 0.5 if (i > 1 and a[i - 2] == x) else 0.8 if x in _VOWELS else 1.0
            add = 0.5 if (j > 1 and b[j - 2] == y) else 0.6 if y in _VOWELS else 1.0
            best = min(before[j - 1] + swap, before[j] + drop, row[-1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before2[j - 2] + 0.7)
            row.append(best)
        if min(row) > most and min(before) > most:
            return most + 1
        before2, before = before, row
    return before[-1]


def deletions(word: str, most: int) -> set[str]:
    """The word and all strings that deleting up to `most` letters leaves."""
    found = {word}
    for n in range(1, min(most, len(word) - 1) + 1):
        found.update("".join(c) for c in combinations(word, len(word) - n))
    return found


def budget(word: str) -> int:
    return 0 if len(word) <= 2 else 1 if len(word) <= 4 else 2


class Dictionary:
    """Entries by symmetric deletes of their words; rank breaks ties of distance, greater first."""

    def __init__(self, entries: list[tuple[str, int]], rank: dict[int, int]):
        self.entries = [(text, ref) for text, ref in dict.fromkeys(entries) if text]
        self.rank = rank
        self.exact = defaultdict(set)
        self.texts = defaultdict(list)
        holders = defaultdict(set)
        for n, (text, ref) in enumerate(self.entries):
            self.exact[text].add(ref)
            self.texts[ref].append(text)
            for word in text.split():
                holders[word].add(n)
        self.holders = {w: sorted(h) for w, h in holders.items()}
        self.weight = {w: np.log1p(len(self.entries) / len(h)) for w, h in holders.items()}
        self.deletes = defaultdict(list)
        for word in holders:
            for d in deletions(word, budget(word)):
                self.deletes[d].append(word)

    def near(self, word: str) -> list[str]:
        if word in self.holders:
            found = {word}
        else:
            found = set()
        for d in deletions(word, budget(word)):
            found.update(self.deletes.get(d, ()))
        return [w for w in found if distance(word, w, 2.0) <= 2.0]

    def ranked(self, text: str, most: float) -> list[tuple[float, int, int]]:
        """(distance, -rank, ref) of every entry within the distance, best first."""
        votes = defaultdict(float)
        for word in set(text.split()):
            seen = {}
            for found in self.near(word):
                for n in self.holders[found]:
                    seen[n] = max(seen.get(n, 0.0), self.weight[found])
            for n, w in seen.items():
                votes[n] += w
        if not votes:
            return []
        least = 0.6 * max(votes.values())
        best: dict[int, float] = {}
        for n, v in votes.items():
            if v >= least:
                entry, ref = self.entries[n]
                d = distance(text, entry, most)
                if d <= most and d < best.get(ref, most + 1):
                    best[ref] = d
        return sorted((d, -self.rank.get(ref, 0), ref) for ref, d in best.items())


class Genres:
    """Typed genres against the reference genres.

    A value means an entry by bounded edit distance, by holding the entry's words
    or a word that only this entry has, by shortening each of its words, by their
    initials, or by a common stem. Other words for a genre have nothing of its
    name and are reported as misses.
    """

    def __init__(self, reference: list[tuple[int, str]], counts: dict[int, int]):
        self.names = [(plain(name).split(), ref) for ref, name in reference if plain(name)]
        entries = [(text, ref) for words, ref in self.names for text in (" ".join(words), "".join(words))]
        self.book = Dictionary(entries, counts)
        owners = defaultdict(set)
        for words, ref in self.names:
            for w in words:
                owners[w].add(ref)
        self.single = {w: min(refs) for w, refs in owners.items() if len(refs) == 1 and w not in GENRE_FILLERS}

    def find(self, value: str, times: int = 1) -> int:
        words = plain(value).split()
        if len(words) > 1 and words[0] == "genre":
            words = words[1:]
        forms = [words]
        while len(words) > 1 and words[-1] in GENRE_FILLERS:
            words = words[:-1]
            forms.append(words)
        for form in forms:
            if (ref := self.exact(form)) is not None:
                return ref
        if words[-1:] and words[-1].endswith("s"):
            forms.append(words[:-1] + [words[-1][:-1]])
        near = [x for form in forms for x in self.near(" ".join(form), times)]
        if near:
            return min(near)[2]
        # The last word that says something decides: "song and dance musical".
        for form in (words[a:b] for size in range(len(words) - 1, 0, -1) for b in range(len(words), size - 1, -1) for a in [b - size]):
            if (ref := self.exact(form)) is not None:
                return ref
        for word in reversed(words):
            if word in self.single:
                return self.single[word]
        return self.shortened(words) or self.stem(words) or MISS

    def exact(self, words: list[str]) -> int | None:
        form = " ".join(words)
        for text in (form, form[:-1] if form.endswith("s") else "", form.replace(" ", "")):
            if text and (refs := self.book.exact.get(text)):
                return min(refs, key=lambda r: (-self.book.rank.get(r, 0), r))
        return None

    def near(self, form: str, times: int) -> list[tuple[float, int, int]]:
        """Entries within the distance that the length allows; a short word of its own is no misspelling of another."""
        size = len(form.replace(" ", ""))
        most = 0.0 if size <= 2 else 0.8 if size == 3 else 1.0 if size <= 5 else 1.6 if size <= 7 else 2.0
        return [x for x in self.book.ranked(form, most) if size > 5 or x[0] < 1.0 or times < max(2.0, OWN_WORD * -x[1])]

    def shortened(self, words: list[str]) -> int:
        """The one entry whose words the typed ones begin ("sci fi", "scifi", "docu"), or whose initials they are; else 0."""
        text = "".join(words)
        fits = set()
        for entry, ref in self.names:
            whole = len(words) == len(entry) and all(len(w) >= min(2, len(e)) and e.startswith(w) for w, e in zip(words, entry))
            halves = len(words) == 1 and len(entry) == 2 and any(i >= 2 and len(text) - i >= 2 and entry[0].startswith(text[:i]) and entry[1].startswith(text[i:]) for i in range(2, len(text) - 1))
            if (whole and len(text) > 2) or halves or len(entry) > 1 and text == "".join(e[0] for e in entry):
                fits.add(ref)
        return fits.pop() if len(fits) == 1 else 0

    def stem(self, words: list[str]) -> int:
        """The entry with which a typed word shares its beginning ("historical", "biopic") or that stands at its end or beginning ("melodrama", "horrorfilm"); else 0."""
        best = []
        for word in words:
            for entry, ref in self.names:
                own = "".join(entry)
                word = word.removesuffix("s")
                for part in {own, *(e for e in entry if e in self.single)}:
                    if len(part) >= 4 and len(word) > len(part) and (word.endswith(part) or word.startswith(part)):
                        best.append((-1.0, -len(part), ref))
                    n = next((i for i, (x, y) in enumerate(zip(word, part)) if x != y), min(len(word), len(part)))
                    if n >= 4 and n >= 0.6 * min(len(word), len(part)) or n == 3 and n >= 0.5 * len(word):
                        best.append((-n / len(part), -n, ref))
        return min(best)[2] if best else 0


class Title:
    """A typed title taken apart: words without leading article, number of the sequel, year."""

    def __init__(self, value: str):
        text = unicodedata.normalize("NFKC", value).replace("_", " ").strip()
        text = re.sub(r"^[\s\"“”'«»]+|[\s\"“”'«»!]+$", "", text)
        text = re.sub(r"(?i)^not\s+", "", text)
        self.raw = text
        text = re.sub(r"(?i)\W*\(\s*film\s*\)\W*$|\s+the movie\W*$", "", text)
        self.year = None
        m = re.search(r"[\s.(\[]((?:19|20)\d\d)[)\]]?\W*$", text)
        if m:
            self.year = int(m[1])
            text = text[: m.start()]
        text = re.sub(r"(?i)\W*\(\s*film\s*\)\W*$|\s+the movie\W*$", "", text).strip(" .!\"“”'")
        words = plain(text.replace(" vs. ", " against ").replace(".vs.", " against ").replace(" vs ", " against ")).split()
        words = ["against" if w == "vs" else w for w in words]
        self.sequel = 1
        if len(words) > 2 and words[-1] in ORDINALS:
            self.sequel = ORDINALS[words.pop()]
            if words[-1] in ("part", "pt", "chapter", "teil", "vol", "volume"):
                words.pop()
        # "Clock of Rirel Zvudron, The": the article stands behind, perhaps before a sequel's number.
        if len(words) > 1 and words[-1] in ("the", "a", "an"):
            words.insert(0, words.pop())
        self.words = words[1:] if len(words) > 1 and words[0] in ("the", "a", "an") else words
        self.text = " ".join(self.words)


def initials(title: str) -> str:
    return "".join(w[0] for w in re.findall(r"[^\W_]+", title))


class Titles:
    """Typed titles against the reference titles; a sequel or a film of another year is another film."""

    def __init__(self, reference: list[tuple[int, str, int | None]], counts: dict[int, int]):
        self.year = {ref: year for ref, _, year in reference}
        self.sequel: dict[int, int] = {}
        self.short = defaultdict(set)
        entries, swapped, heads = [], [], defaultdict(set)
        for ref, name, _ in reference:
            title = Title(name)
            self.sequel[ref] = title.sequel
            entries.append((title.text, ref))
            if " and " in title.text and "," not in name:
                left, _, right = title.text.partition(" and ")
                swapped.append((f"{right} and {left}", ref))
            if ":" in name:
                heads[Title(name.split(":")[0]).text].add(ref)
            self.short[initials(name)].add(ref)
            self.short[initials(re.sub(r"(?i)^(the|an?)\s", "", name))].add(ref)
        self.book = Dictionary(entries, counts)
        self.swapped = Dictionary([(t, r) for t, r in swapped if t not in self.book.exact], counts)
        self.heads = Dictionary([(t, r) for t, refs in heads.items() for r in refs], counts)

    def fits(self, ref: int, title: Title) -> bool:
        year = self.year.get(ref)
        return self.sequel[ref] == title.sequel and not (title.year and year and abs(title.year - year) > 1)

    def find(self, value: str, times: int = 1) -> int:
        title = Title(value)
        if re.fullmatch(r"[A-Za-z]{2,12}[0-9]?", title.raw) and re.search(r"[A-Z].*[A-Z]", title.raw):
            refs = self.short.get(title.raw, set())
            if not refs:
                refs = {r for r in self.short.get(title.raw.rstrip("0123456789"), set()) if str(self.sequel[r]) == title.raw[-1]}
            if refs:
                return min(refs, key=lambda r: (-self.book.rank.get(r, 0), r))
        if not title.text:
            return MISS
        size = len(title.text)
        for book, most in ((self.book, max(1.5, min(0.16 * size, 4.5))), (self.swapped, max(1.0, min(0.12 * size, 3.0))), (self.heads, 2.0)):
            found = [x for x in book.ranked(title.text, most) if self.fits(x[2], title) and self.alike(title.text, x[2], book)]
            if found:
                return found[0][2]
        return MISS

    def alike(self, text: str, ref: int, book: Dictionary) -> bool:
        """No word of the entry may be altogether another one: names that differ make another film."""
        best = False
        for entry in book.texts[ref]:
            mine, theirs = text.split(), entry.split()
            if len(mine) != len(theirs):
                best = best or distance(text.replace(" ", ""), entry.replace(" ", ""), 2.0) <= 2.0
            else:
                best = best or all(distance(a, b, 3.0) <= max(1.0, 0.36 * len(b)) for a, b in zip(mine, theirs))
        return best


def canonical_values(plans: DataFrame, genres: DataFrame, titles: DataFrame) -> DataFrame:
    """(plan_id, field_name, pos, value, ref_id) of each non-blank genre or excluded title that is no reference entry as it stands.

    ref_id is -1 where no entry is meant. Null plans, null or blank values, null
    arrays and null structs give no row; repeated plans count once; between
    entries equally near, the one the corpus holds more often wins, then the
    smaller id. Extra columns are ignored. The reference lists must stay under
    MOST_REFERENCES rows, which is checked before they are sent to the executors.
    """
    spark = plans.sparkSession
    genre_list = [(r[0], r[1]) for r in runtime.bounded_rows(genres.select("genre_id", "genre").where("genre_id is not null and genre is not null").distinct(), MOST_REFERENCES)]
    title_list = [(r[0], r[1], r[2]) for r in runtime.bounded_rows(titles.select("title_id", "title", "release_year").where("title_id is not null and title is not null").distinct(), MOST_REFERENCES)]
    typed = F.concat(
        F.array(F.struct(F.lit("genre").alias("field_name"), F.lit(0).alias("pos"), F.col("filters.genre").alias("value"))),
        F.coalesce(F.transform("exclude_titles", lambda v, i: F.struct(F.lit("exclude_titles").alias("field_name"), i.alias("pos"), v.alias("value"))), F.array()),
    )
    values = plans.where("plan_id is not null").select("plan_id", F.explode(typed).alias("v")).select("plan_id", "v.*").where(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)\S"))
    values = runtime.cut(values.distinct())
    names = [("genre", n, i) for i, n in genre_list] + [("exclude_titles", t, i) for i, t, _ in title_list]
    entries = F.broadcast(spark.createDataFrame(names, "field_name string, value string, ref long"))  # under MOST_REFERENCES twice
    # Every distinct value is looked up once, however many plans hold it.
    distinct = runtime.cut(values.groupBy("field_name", "value").agg(F.count("*").alias("n")))
    counts = {(r["field_name"], r["ref"]): r["n"] for r in distinct.join(entries, ["field_name", "value"]).collect()}
    shared = spark.sparkContext.broadcast((
        Genres(genre_list, {i: counts.get(("genre", i), 0) for i, _ in genre_list}),
        Titles(title_list, {i: counts.get(("exclude_titles", i), 0) for i, _, _ in title_list}),
    ))

    def run(batches):
        genre_book, title_book = shared.value
        for batch in batches:
            ids = [(genre_book if f == "genre" else title_book).find(v, n) for f, v, n in zip(batch["field_name"], batch["value"], batch["n"])]
            yield batch[["field_name", "value"]].assign(ref_id=np.array(ids, dtype=np.int64))

    meant = distinct.join(entries.select("field_name", "value"), ["field_name", "value"], "left_anti").mapInPandas(run, "field_name string, value string, ref_id long")
    return values.join(meant, ["field_name", "value"]).select("plan_id", "field_name", "pos", "value", "ref_id")
