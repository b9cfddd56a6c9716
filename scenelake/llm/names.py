"""Spellings of one person, role or organisation within a movie (problem 3).

Every distinct spelling starts as a profile of its own. Profiles of a movie that
share a blocking key (a name part, what it becomes without one letter, the long
form of a nickname, an acronym) are compared. Certain pairs are merged; a
shorter spelling is merged into a richer profile only if that one fits better
than any other. A merged profile unions the spellings and initials of its
members: where these together tell more than any of them ("ANNA Q." and
"DR. QUILLBERG" make ANNA QUILLBERG), the fuller name enters blocking and is
compared as a spelling of that profile. Profiles are matched again with what
they then hold, until neither a merge nor a fuller name is left.

Nothing about the names is listed. Which nicknames stand for which given names,
which words name organisations or figures ("MINING", "COAT") and which parts are
established names is counted over the cast lists of all movies.

The spellings of a movie lie together and are resolved in one pass over them. A
movie with more than a stated number is resolved round by round in joins
instead, so that no task holds it whole; both ways give the same profiles.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake import runtime

MOST_ROUNDS = 40  # beyond it an error
MOST_IN_TASK = 5_000  # spellings of a movie that one task resolves; a movie with more is resolved by all tasks together, with the same result
ESTABLISHED_IN = 3  # movies whose cast must hold a name part for it to be no typing error
NICKNAMED_IN = 3  # movies in which two given names must go with one family name for one to stand for the other, and
NICKNAMED_SHARE = 0.2  # the share of the movies that have the rarer one with a family name; brothers and sisters share a name by chance only

# Fixed: ranks and styles before a name, by their long form.
TITLES = {s: long for long, short in {
    "DOCTOR": "DR DOC", "LIEUTENANT": "LT LIEUT", "CAPTAIN": "CAPT CPT", "PROFESSOR": "PROF", "DETECTIVE": "DET", "SERGEANT": "SGT", "MISTER": "MR", "MISSUS": "MRS MISSIS", "MISS": "MS",
    "COLONEL": "COL", "GENERAL": "GEN", "OFFICER": "OFC", "AGENT": "", "SHERIFF": "", "INSPECTOR": "INSP", "JUDGE": "", "FATHER": "FR", "SISTER": "SR", "MAJOR": "MAJ", "CORPORAL": "CPL", "PRIVATE": "PVT",
}.items() for s in [long, *short.split()]}
NUMBERS = {w: n for n, words in enumerate("ONE 1ST FIRST,TWO 2ND SECOND,THREE 3RD THIRD,FOUR 4TH FOURTH,FIVE 5TH FIFTH,SIX 6TH SIXTH,SEVEN 7TH SEVENTH,EIGHT 8TH EIGHTH,NINE 9TH NINTH".split(","), 1) for w in words.split()}
_LITTLE = frozenset("IN THE A AN WITH W/ OF ON AND AT".split())
_SUFFIX = re.compile(r"\s*\(?\b(?:CONT(?:INUING|INUED|['’]?D)?|V\.?\s?O\.?|O\.?\s?S\.?|O\.?\s?C\.?|VOICE|PRE-?LAP|ARCHIVE|FILTERED|ON PHONE|OFF)\)\s*")


@lru_cache(maxsize=200_000)
def normal(name: str) -> str:
    """Upper case without accents and production marks; a nickname stands between bars."""
    text = unicodedata.normalize("NFKD", name.upper().replace("Ø", "O").replace("Ł", "L").replace("ß", "SS"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"[‘’`´]", "'", text)
    text = _SUFFIX.sub(" ", text)
    text = re.sub(r"(?<!\w)['\"“”«(]([^'\"“”»()]+)['\"“”»)](?!\w)", r" |\1| ", text)
    return re.sub(r"\s+", " ", text).strip(" .:;,-")if not re.search(r"\b\w\.$", text.strip()) else re.sub(r"\s+", " ", text).strip()


class Name:
    """The parts of one spelling."""

    __slots__ = ("kind", "given", "family", "first", "last", "word", "nick", "title", "role", "number", "words", "rank", "staff")

    def __init__(self, form: str, marks: frozenset[str] = frozenset()):
        """marks: those of the form's words that name organisations ("o:MINING") or figures ("f:COAT") in the cast lists."""
        self.kind, self.given, self.family, self.first, self.last, self.word = "none", "", "", "", "", ""
        self.nick, self.title, self.role, self.number, self.words, self.rank, self.staff = "", "", "", 0, (), 0, False
        nick = re.search(r"\|([^|]+)\|", form)
        if nick:
            self.nick = nick[1].strip()
            form = re.sub(r"\s*\|[^|]*\|\s*", " ", form).strip()
        comma = re.fullmatch(r"([^,\s]+(?: [^,\s]+)?),\s*(.+)", form)
        if comma:
            form = f"{comma[2]} {comma[1]}"
        raw = [w for w in re.split(r"\s+", form) if w]
        if len(raw) == 1 and re.fullmatch(r"(?:[A-Z]\.){2,}", raw[0]):
            self.kind, self.word, self.rank = "word", raw[0].replace(".", ""), 1
            return
        numbers = [n for w in raw if (n := NUMBERS.get(w.strip(".")) or (int(d[1]) if (d := re.fullmatch(r"#?(\d{1,4})\.?", w)) else 0))]
        words = [w for w in raw if not (NUMBERS.get(w.strip(".")) or re.fullmatch(r"#?\d{1,4}\.?", w) or numbers and w in ("NO.", "NO", "NUMBER", "#"))]
        if numbers and words:
            self.kind, self.role, self.number, self.rank = "role", " ".join(w.strip(".") for w in words), numbers[0], 3
            return
        while len(words) > 1 and words[0].strip(".") in TITLES:
            self.title = TITLES[words.pop(0).strip(".")]
        bare = [w.strip(".,'") for w in words]
        if len(bare) > 2 and (set(words) & _LITTLE or sum(f"f:{w}" in marks for w in bare) > 1) and not self.title:
            self.kind, self.words, self.rank = "thing", tuple(sorted(w for w in bare if w not in _LITTLE)), 3
            return
        middle = [w for w in words[1:-1] if len(w.strip(".")) > 1]
        if len(bare) >= 3 and middle and not self.title and not self.nick:
            self.kind, self.words, self.rank = "body", tuple(bare), 4
            return
        self.staff = len(bare) == 2 and f"o:{bare[1]}" in marks
        if self.staff and len(bare[0]) > 2 and not self.title:
            self.kind, self.words, self.rank = "body", (words[0] if words[0].endswith(".") else bare[0], bare[1]), 2
            return
        if len(bare) == 2 and words[0].endswith(".") and len(bare[0]) > 2:
            self.kind, self.words, self.rank = "body", (words[0], bare[1]), 2
            return
        bare = [w for i, w in enumerate(bare) if w and (len(w) > 1 or i in (0, len(bare) - 1))]
        if not bare:
            return
        if len(bare) == 1:
            self.rank = 1
            if self.title:
                self.kind, self.family = "titled", bare[0]
            elif len(bare[0]) > 1:
                self.kind, self.word = "word", bare[0]
            return
        a, b = bare[0], bare[-1]
        if len(a) == 1 and len(b) > 1:
            self.kind, self.first, self.family, self.rank = "first", a, b, 2
        elif len(b) == 1 and len(a) > 1:
            self.kind, self.given, self.last, self.rank = "last", a, b, 2
        elif len(a) > 1 and len(b) > 1:
            self.kind, self.given, self.family, self.rank = "full", a, b, 3


@lru_cache(maxsize=200_000)
def parse(form: str, marks: frozenset[str] = frozenset()) -> Name:
    return Name(form, marks)


class Known:
    """What the cast lists say about the parts of two spellings: established parts and ("LONG>SHORT") nicknames."""

    __slots__ = ("parts", "long", "short")

    def __init__(self, parts: frozenset[str] = frozenset(), nicknames: frozenset[str] = frozenset()):
        self.parts = parts
        self.long: dict[str, set[str]] = {}
        self.short: dict[str, set[str]] = {}
        for pair in nicknames:
            long, _, short = pair.partition(">")
            self.long.setdefault(short, set()).add(long)
            self.short.setdefault(long, set()).add(short)


NOTHING = Known()


@lru_cache(maxsize=400_000)
def within_one(a: str, b: str) -> bool:
    """One letter added, dropped or replaced, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def within_two(a: str, b: str) -> bool:
    """Two typing errors: dropping a letter from each, or mending one, leaves one at most."""
    return any(within_one(a[:i] + a[i + 1 :], b) or within_one(a, b[:j] + b[j + 1 :]) for i in range(len(a)) for j in range(len(b)) if i == j)


def alike(a: str, b: str, known: Known) -> float:
    """3 for the same part, 2 for one typing error; parts that are both established names are different names."""
    if a == b:
        return 3.0
    if len(min(a, b, key=len)) < 3 or a in known.parts and b in known.parts or not within_one(a, b):
        return 0.0
    return 2.0


def given_alike(a: str, b: str, known: Known) -> float:
    """alike(), or 2.8 for a nickname of the other, 2.4 for two nicknames of one name."""
    best = alike(a, b, known)
    if best < 2.8 and known.long:
        la, lb = known.long.get(a, set()), known.long.get(b, set())
        if b in la or a in lb:
            return 2.8
        if la & lb:
            return max(best, 2.4)
        if best == 0 and (any(alike(b, x, known) for x in la) or any(alike(a, x, known) for x in lb)):
            return 1.9
    return best


def compare(a: Name, b: Name, known: Known) -> tuple[float, bool]:
    """(score, certain) of two spellings; 0 if they cannot mean the same."""
    if a.rank < b.rank:
        a, b = b, a
    if "role" in (a.kind, b.kind):
        if a.kind == b.kind:
            same = alike(a.role, b.role, NOTHING)
            return (same, True) if same and a.number == b.number else (0.0, False)
        return (2.0, False) if b.kind == "word" and a.kind == "role" and b.word == a.role else (0.0, False)
    if "thing" in (a.kind, b.kind):
        if a.kind == b.kind:
            ok = len(a.words) == len(b.words) and all(alike(x, y, NOTHING) for x, y in zip(a.words, b.words))
            return (3.0, True) if ok else (0.0, False)
        words = [w for w in (b.given, b.family, b.word) if w]
        return (1.5, False) if a.kind == "thing" and b.kind == "full" and all(any(alike(w, x, NOTHING) for x in a.words) for w in words) else (0.0, False)
    if a.kind == "body":
        if b.kind == "body" and len(a.words) == len(b.words):
            ok = all(_short_for(x, y) or _short_for(y, x) or alike(x, y, known) for x, y in zip(a.words, b.words))
            return (3.0, True) if ok else (0.0, False)
        parts = b.words if b.kind == "body" else (b.given, b.family) if b.kind == "full" else ()
        if parts:
            at = -1
            for part in parts:
                at = next((i for i in range(at + 1, len(a.words)) if _short_for(part, a.words[i]) or alike(part, a.words[i], known)), None)
                if at is None:
                    return 0.0, False
            return 2.6, True
        initials = "".join(w[0] for w in a.words)
        if b.kind == "word" and len(initials) > 2 and b.word == initials:
            return 2.6, True
        if b.kind == "word" and len(b.word) > 2 and len(a.words) == 2 and b.word[0] == initials[0] and initials[1] in b.word[1:] and a.staff:
            return 1.5, False
        if b.kind == "word" and any(alike(b.word, w, known) for w in a.words):
            return 1.0, False
        return 0.0, False
    if "none" in (a.kind, b.kind) or "body" in (a.kind, b.kind):
        return 0.0, False
    if a.kind == "full":
        whole = a.given + a.family
        nicks = [a.given] + ([a.nick] if a.nick else [])
        if b.kind == "full":
            given = max(given_alike(x, y, known) for x, y in product(nicks, [b.given] + ([b.nick] if b.nick else [])))
            family = alike(a.family, b.family, known)
            if given == 3 and not family and len(a.family) > 5 and not (a.family in known.parts and b.family in known.parts) and within_two(a.family, b.family):
                family = 1.4
            if given and family:
                return given + family, given + family >= 4
            if a.given == b.family and a.family == b.given:
                return 5.0, True
            return 0.0, False
        if b.kind == "first":
            family = alike(a.family, b.family, known)
            return (family + 1 - 0.3 * (a.given[0] != b.first), False) if family and any(n[0] == b.first for n in nicks) else (0.0, False)
        if b.kind == "last":
            given = max(given_alike(n, b.given, known) for n in nicks)
            return (given + 1, False) if given and a.family[0] == b.last else (0.0, False)
        if b.kind == "titled":
            family = alike(a.family, b.family, known)
            return (family + (a.title == b.title) - 0.5 * bool(a.title and a.title != b.title), False) if family else (0.0, False)
        if len(b.word) > 6 and any(within_one(b.word, n + a.family) for x in nicks for n in (x, *known.long.get(x, ()), *known.short.get(x, ()))):
            return 5.0, True
        given = max(given_alike(n, b.word, known) for n in nicks)
        return (max(given, alike(a.family, b.word, known)), False)
    pair = {a.kind, b.kind}
    if pair == {"first"}:
        family = alike(a.family, b.family, known)
        return (family + 1, True) if family and a.first == b.first else (0.0, False)
    if pair == {"last"}:
        given = given_alike(a.given, b.given, known)
        return (given + 1, True) if given and a.last == b.last else (0.0, False)
    if pair == {"first", "last"}:
        f, l = (a, b) if a.kind == "first" else (b, a)
        return (1.2, False) if f.first == l.given[0] and f.family[0] == l.last else (0.0, False)
    if pair == {"titled"}:
        family = alike(a.family, b.family, known)
        return (family, True) if family and a.title == b.title else (0.0, False)
    if pair == {"first", "titled"}:
        family = alike(a.family, b.family, known)
        return family, False
    if pair == {"last", "titled"}:
        l, t = (a, b) if a.kind == "last" else (b, a)
        return (0.6, False) if t.family[0] == l.last else (0.0, False)
    w, o = (a, b) if a.kind == "word" else (b, a)
    if o.kind == "word":
        same = given_alike(w.word, o.word, known)
        if same:
            return same, same >= 2
        long, short = (w.word, o.word) if len(w.word) > len(o.word) else (o.word, w.word)
        return (1.5, False) if len(short) > 2 and len(long) > len(short) + 2 and (long.startswith(short) or long.endswith(short)) else (0.0, False)
    if o.kind == "first":
        if len(w.word) > len(o.family) + 2 and w.word.endswith(o.family) and w.word[0] == o.first:
            return 3.5, False
        return alike(w.word, o.family, known), False
    if o.kind == "last":
        if len(w.word) > len(o.given) + 2 and w.word.startswith(o.given) and w.word[len(o.given)] == o.last:
            return 3.5, False
        return given_alike(w.word, o.given, known), False
    if o.kind == "titled":
        return (2.5, False) if len(w.word) > len(o.family) + 2 and w.word.endswith(o.family) else (alike(w.word, o.family, known), False)
    return 0.0, False


def _short_for(short: str, long: str) -> bool:
    return short.endswith(".") and len(short) > 2 and long.startswith(short[:-1])


def shortened(word: str) -> set[str]:
    """The word and what it becomes without one letter."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 2 else set())


def blocking_keys(n: Name, known: Known = NOTHING) -> set[str]:
    """Under what a spelling is compared with others."""
    keys: set[str] = set()
    if n.kind == "role":
        keys |= {f"#{n.number} {w}" for w in shortened(n.role)} | {n.role}
    elif n.kind == "thing":
        keys.add("~" + " ".join(n.words)[:2] + str(len(n.words)))
        keys |= set(n.words)
    elif n.kind == "body":
        keys.add(n.words[0][0] + "*")
        for w in n.words:
            keys |= shortened(w.strip("."))
            keys.add(w.strip(".")[:4] + ".")
    else:
        for part in (n.given, n.family, n.word, n.nick):
            if part:
                keys |= shortened(part)
                for long in known.long.get(part, ()):
                    keys |= shortened(long)
        if n.given and n.family:
            for first in {n.given, n.nick, *known.long.get(n.given, ()), *known.short.get(n.given, ())} - {""}:
                keys |= {first[:3] + ">" + n.family[-2:], first[:2] + "<" + n.family[-3:]}
            keys.add(n.given[0] + "." + n.family[0] + ".")
        if n.first and n.family:
            keys.add(n.first + "." + n.family[0] + ".")
        if n.given and n.last:
            keys.add(n.given[0] + "." + n.last + ".")
        if n.kind == "word" and 2 < len(n.word) < 6:
            keys.add(n.word[0] + "*")
        if n.kind == "word" and len(n.word) > 6:
            keys |= {n.word[:3] + ">" + n.word[-2:], n.word[:2] + "<" + n.word[-3:]}
            keys |= {n.word[:i] for i in range(3, len(n.word) - 2)} | {n.word[i:] for i in range(3, len(n.word) - 2)}
    return keys


def spellings(characters: DataFrame, scenes: DataFrame) -> DataFrame:
    """(slug, name, cast) of every distinct non-blank string of the three fields; cast where the cast list spells it so."""
    spoken = scenes.select("slug", F.explode(F.col("dialogue.character")).alias("name"), F.lit(False).alias("cast"))
    played = characters.select("slug", F.explode(F.array(F.struct(F.col("screenplay_name").alias("name"), F.lit(False).alias("cast")), F.struct(F.col("tmdb_character").alias("name"), F.lit(True).alias("cast")))).alias("x")).select("slug", "x.*")
    return spoken.unionByName(played).where(F.col("slug").isNotNull() & F.col("name").rlike(r"(?U)[\p{L}\p{N}]")).groupBy("slug", "name").agg(F.max("cast").alias("cast"))


def same_character(characters: DataFrame, scenes: DataFrame) -> DataFrame:
    """(slug, name_a, name_b), name_a before name_b by code point: spellings of one character of the movie.

    Null or blank slugs and names, and strings without a letter or digit, give no
    row; repeated rows count once; a spelling that fits several profiles equally
    well stays by itself. Only slug, the two names and dialogue are read.
    """
    return pairs(resolve(spellings(characters, scenes)))


def pairs(members: DataFrame) -> DataFrame:
    """All pairs of different strings of one profile."""
    a, b = (members.select("slug", "profile", F.col("name").alias(n)) for n in ("name_a", "name_b"))
    return a.join(b, ["slug", "profile"]).where("name_a < name_b").select("slug", "name_a", "name_b").distinct()


FORM = "slug string, id long, form string, known array<string>, nicknames array<string>, marks array<string>"


def _set(values) -> frozenset[str]:
    return frozenset(values) if values is not None else frozenset()


def lessons(spelled: DataFrame) -> DataFrame:
    """(part, known, nickname, mark): what the forms (slug, form, cast) of all movies say about a part of a name.

    A row has one of: known, the part itself if the cast lists of ESTABLISHED_IN
    movies hold it; a nickname pair "LONG>SHORT", under either part; a mark of words
    that name organisations (behind the first word of three or more) or figures
    (beside little words) in cast lists.
    """

    def told(batches):
        for batch in batches:
            out = set()
            for slug, form, cast in zip(batch["slug"], batch["form"], batch["cast"]):
                n = parse(form)
                if n.kind == "full":
                    out |= {(slug, "given", g, n.family) for g in (n.given, n.nick) if g and " " not in g}
                if not cast:
                    continue
                out |= {(slug, "known", p, None) for p in re.findall(r"[^\W\d_]{2,}", form)}
                if n.kind == "body" and len(n.words) > 2:
                    out |= {(slug, "mark", f"o:{w}", None) for w in n.words[1:]}
                if n.kind == "thing":
                    out |= {(slug, "mark", f"f:{w}", None) for w in n.words}
            yield pd.DataFrame(list(out), columns=["slug", "kind", "value", "family"])

    rows = runtime.cut(spelled.mapInPandas(told, "slug string, kind string, value string, family string").distinct())
    counted = rows.where("kind <> 'given'").groupBy("kind", "value").agg(F.count("*").alias("n")).where(F.col("n") >= ESTABLISHED_IN)
    mark = F.when(F.col("kind") == "mark", F.col("value"))
    whole = counted.select(F.coalesce(F.substring(mark, 3, 1000), "value").alias("part"), F.when(F.col("kind") == "known", F.col("value")).alias("known"), F.lit(None).cast("string").alias("nickname"), mark.alias("mark"))
    named = rows.where("kind = 'given'").select("slug", "family", F.col("value").alias("short"))
    together = named.join(named.select("slug", "family", F.col("short").alias("long")), ["slug", "family"]).where((F.col("short") != F.col("long")) & (F.levenshtein("short", "long") > 1))
    times = named.groupBy("short").agg(F.countDistinct("slug").alias("of"))
    both = together.groupBy("short", "long").agg(F.countDistinct("slug").alias("n")).where(F.col("n") >= NICKNAMED_IN)
    # The rarer name is the nickname.
    rarer = both.join(times, "short").join(times.select(F.col("short").alias("long"), F.col("of").alias("long_of")), "long")
    sure = rarer.where((F.col("n") >= NICKNAMED_SHARE * F.col("of")) & (F.col("of") < F.col("long_of"))).select("short", "long")
    nicks = sure.select(F.explode(F.array("short", "long")).alias("part"), F.lit(None).cast("string").alias("known"), F.concat_ws(">", "long", "short").alias("nickname"), F.lit(None).cast("string").alias("mark"))
    return whole.unionByName(nicks)


def informed(forms: DataFrame, told: DataFrame) -> DataFrame:
    """FORM: the forms (slug, id, form) with what the cast lists say about their parts."""
    parts = forms.select("id", F.explode(F.array_distinct(F.regexp_extract_all("form", F.lit(r"(?U)[\p{L}]{2,}"), F.lit(0)))).alias("part"))
    found = parts.join(told, "part").groupBy("id").agg(F.collect_set("known").alias("known"), F.collect_set("nickname").alias("nicknames"), F.collect_set("mark").alias("marks"))
    return forms.select("slug", "id", "form").join(found, "id", "left").select("slug", "id", "form", "known", "nicknames", "marks")


def blocked(forms: DataFrame) -> DataFrame:
    """(key, id): forms under their blocking keys, each within its movie."""

    def keyed(batches):
        for batch in batches:
            out = [(s, k, i) for s, i, f, nicks, marks in zip(*(batch[c] for c in ("slug", "id", "form", "nicknames", "marks"))) for k in blocking_keys(parse(f, _set(marks)), Known(nicknames=_set(nicks)))]
            yield pd.DataFrame(out, columns=["slug", "key", "id"])

    return forms.mapInPandas(keyed, "slug string, key string, id long").select(F.xxhash64("slug", "key").alias("key"), "id")


def judged(met: DataFrame, forms: DataFrame) -> DataFrame:
    """(a, b, rank_a, rank_b, score, certain) of the pairs (id, other) that may mean the same."""
    told = [c for c in forms.columns if c != "id"]
    left = forms.select("id", *(F.col(c).alias(f"{c}_a") for c in told))
    right = forms.select(F.col("id").alias("other"), *(F.col(c).alias(f"{c}_b") for c in told))
    both = ["id", "other"] + [f"{c}_{side}" for side in "ab" for c in ("form", "known", "nicknames", "marks")]

    def judge(batches):
        for batch in batches:
            out = []
            for a, b, x, known_a, nicks_a, marks_a, y, known_b, nicks_b, marks_b in zip(*(batch[c] for c in both)):
                one, two = parse(x, _set(marks_a)), parse(y, _set(marks_b))
                score, certain = compare(one, two, Known(_set(known_a) | _set(known_b), _set(nicks_a) | _set(nicks_b)))
                if score:
                    out.append((a, b, one.rank, two.rank, score, certain))
            yield pd.DataFrame(out, columns=["a", "b", "rank_a", "rank_b", "score", "certain"])

    pairs = met.join(left, "id").join(right, "other").where("slug_a = slug_b").select(*both)
    return pairs.mapInPandas(judge, "a long, b long, rank_a int, rank_b int, score double, certain boolean")


def fuller(forms: DataFrame, profiles: DataFrame, grown: DataFrame) -> DataFrame:
    """(slug, id, form, profile): full names that the grown profiles hold only in parts, a given name in one spelling and a family name in another."""

    def parts(batches):
        for batch in batches:
            out = []
            for slug, i, form, marks in zip(batch["slug"], batch["id"], batch["form"], batch["marks"]):
                n = parse(form, _set(marks))
                if n.kind in ("full", "first", "last", "titled"):
                    out.append((slug, i, n.kind == "full", n.given if n.kind == "last" else None, n.family if n.kind in ("first", "titled") else None, n.last or n.family[:1], n.first))
            yield pd.DataFrame(out, columns=["slug", "id", "whole", "given", "family", "last", "first"])

    held = forms.join(profiles.join(grown, "profile", "left_semi"), "id").select("slug", "profile", "id", "form", "marks")
    said = held.mapInPandas(parts, "slug string, id long, whole boolean, given string, family string, last string, first string").join(profiles, "id")
    lacking = runtime.cut(said.join(said.where("whole").select("profile").distinct(), "profile", "left_anti"))
    given = lacking.where("given is not null").select("slug", "profile", "given", "last").distinct()
    family = lacking.where("family is not null").select("profile", "family", "first").distinct()
    fits = F.startswith("family", "last") & ((F.col("first") == "") | F.startswith("given", "first"))
    made = given.join(family, "profile").where(fits).select("slug", "profile", F.concat_ws(" ", "given", "family").alias("form")).distinct()
    # An id of its own beside those of the spellings: one name may be fuller than two profiles.
    return made.select("slug", F.xxhash64("slug", "form", "profile").alias("id"), "form", "profile")


def resolve(names: DataFrame, most: int = MOST_IN_TASK) -> DataFrame:
    """(slug, name, profile) of every spelling; movies with over `most` different spellings are resolved by joins."""

    def normalised(batches):
        for batch in batches:
            yield batch.assign(form=[normal(n) for n in batch["name"]])

    spelled = runtime.cut(names.mapInPandas(normalised, "slug string, name string, cast boolean, form string").withColumn("id", F.xxhash64("slug", "form")))
    forms = runtime.cut(informed(spelled.select("slug", "id", "form").distinct(), lessons(spelled.groupBy("slug", "form").agg(F.max("cast").alias("cast")))))
    large = runtime.cut(forms.groupBy("slug").count().where(F.col("count") > most).select("slug"))
    if large.isEmpty():
        profiles = resolved_in_task(forms)
    else:
        told = lessons(spelled.groupBy("slug", "form").agg(F.max("cast").alias("cast")))
        profiles = resolved_in_task(forms.join(large, "slug", "left_anti")).unionByName(resolved_by_joins(forms.join(large, "slug", "left_semi"), told))
    return spelled.select("slug", "name", "id").join(profiles, "id").select("slug", "name", "profile")


def resolved_in_task(forms: DataFrame) -> DataFrame:
    """(id, profile) of the forms FORM, each movie in one task."""

    def run(batches):
        slug, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch[c] for c in ("slug", "id", "form", "known", "nicknames", "marks"))):
                if row[0] != slug and held:
                    out += Movie(held).profiles()
                    held = []
                slug = row[0]
                held.append((int(row[1]), row[2], *map(_set, row[3:])))
            if out:
                yield pd.DataFrame(out, columns=["id", "profile"])
        if held:
            yield pd.DataFrame(Movie(held).profiles(), columns=["id", "profile"])

    return forms.repartition("slug").sortWithinPartitions("slug").mapInPandas(run, "id long, profile long")


class Movie:
    """The spellings (id, form, known, nicknames, marks) of one movie, merged and matched again round by round."""

    def __init__(self, spellings: list[tuple]):
        self.spellings = {i: (parse(form, marks), known, nicknames) for i, form, known, nicknames, marks in spellings}
        self.told = {part: (known, nicknames) for _, form, known, nicknames, _ in spellings for part in re.findall(r"[^\W\d_]{2,}", form)}
        self.own = list(self.spellings)
        self.profile = {i: i for i in self.spellings}
        self.blocks: dict[str, list[int]] = {}
        self.matches: dict[tuple[int, int], list] = {}

    def meet(self, fresh: list[int]) -> list[tuple]:
        """(profile, profile, rank, rank, score, certain) of the fresh spellings and those before them under the same keys."""
        seen, found = set(), []
        for i in fresh:
            name, known, nicknames = self.spellings[i]
            for key in blocking_keys(name, Known(nicknames=nicknames)):
                block = self.blocks.setdefault(key, [])
                for j in block:
                    pair = (min(i, j), max(i, j))
                    if pair not in seen:
                        seen.add(pair)
                        a, b = (self.spellings[x] for x in pair)
                        score, certain = compare(a[0], b[0], Known(a[1] | b[1], a[2] | b[2]))
                        if score:
                            found.append((self.profile[pair[0]], self.profile[pair[1]], a[0].rank, b[0].rank, score, certain))
                block.append(i)
        return found

    def keep(self, found: list[tuple]) -> None:
        """One match for two profiles: the best score, certain if any is, and on either side the richest rank."""
        ranks: dict[int, int] = {}
        best: dict[tuple[int, int], list] = {}
        for a, b, rank_a, rank_b, score, certain in found:
            ranks[a], ranks[b] = max(rank_a, ranks.get(a, 0)), max(rank_b, ranks.get(b, 0))
            if a != b:
                pair = best.setdefault((min(a, b), max(a, b)), [0, 0, 0.0, False])
                pair[2], pair[3] = max(pair[2], score), pair[3] or certain
        for (a, b), pair in best.items():
            pair[0], pair[1] = ranks[a], ranks[b]
        self.matches = best

    def moves(self) -> dict[int, int]:
        """The profiles that one round merges into others."""
        sides: dict[int, list[tuple]] = {}
        for (a, b), (rank_a, rank_b, score, certain) in self.matches.items():
            sides.setdefault(a, []).append((b, rank_a <= rank_b, (score, rank_b), certain))
            sides.setdefault(b, []).append((a, rank_b <= rank_a, (score, rank_a), certain))
        beside: dict[int, set[int]] = {}
        for own, others in sides.items():
            top = max((fit for _, poorer, fit, _ in others if poorer), default=None)
            tied = [o for o, poorer, fit, _ in others if poorer and fit == top]
            for other in {o for o, _, _, certain in others if certain} | set(tied if len(tied) == 1 else ()):
                beside.setdefault(own, set()).add(other)
                beside.setdefault(other, set()).add(own)
        least = {own: min(own, *others) for own, others in beside.items()}
        target = {own: least.get(to, to) for own, to in least.items()}
        return {own: to for own, to in target.items() if own != to}

    def fuller(self, grown: set[int]) -> list[int]:
        """New spellings: full names that the grown profiles hold only in parts."""
        parts: dict[int, tuple[set, set, list]] = {}
        for i, at in self.profile.items():
            if at in grown:
                given, family, whole = parts.setdefault(at, (set(), set(), []))
                n = self.spellings[i][0]
                if n.kind == "full":
                    whole.append(n)
                elif n.kind == "last":
                    given.add((n.given, n.last))
                elif n.kind in ("first", "titled"):
                    family.add((n.family, n.first))
        made = []
        for at, (given, family, whole) in parts.items():
            for form in sorted({f"{g} {f}" for g, last in given for f, first in family if f.startswith(last) and g.startswith(first)} if not whole else ()):
                i = hash((form, at))
                if i not in self.spellings:
                    told = [self.told[p] for p in form.split() if p in self.told]
                    self.spellings[i] = (parse(form), frozenset().union(*(k for k, _ in told)), frozenset().union(*(n for _, n in told)))
                    self.profile[i] = at
                    made.append(i)
        return made

    def profiles(self) -> list[tuple[int, int]]:
        """(id, profile) of the spellings given."""
        self.keep(self.meet(self.own))
        for _ in range(MOST_ROUNDS + 1):
            moved = self.moves()
            if not moved:
                return [(i, self.profile[i]) for i in self.own]
            self.profile = {i: moved.get(at, at) for i, at in self.profile.items()}
            carried = [(moved.get(a, a), moved.get(b, b), *rest) for (a, b), rest in self.matches.items()]
            self.keep(carried + self.meet(self.fuller(set(moved.values()))))
        raise RuntimeError(f"profiles still merge after {MOST_ROUNDS} rounds")


def resolved_by_joins(forms: DataFrame, told: DataFrame) -> DataFrame:
    """(id, profile) of the forms FORM, round by round over all of them.

    How well two profiles fit is how well their best spellings do, so what was
    compared once is carried over to the merged profiles, and only what a merge
    brings forth enters blocking and comparison again. Rounds end when there is
    neither a merge nor a fuller name; RuntimeError beyond MOST_ROUNDS.
    """
    forms, told, own = runtime.cut(forms), runtime.cut(told), forms.select("id")
    blocks = runtime.cut(blocked(forms))
    met = blocks.join(blocks.select("key", F.col("id").alias("other")), "key").where("id < other").select("id", "other").distinct()
    matches = runtime.cut(judged(met, forms))
    profiles = forms.select("id", F.col("id").alias("profile"))
    for _ in range(MOST_ROUNDS + 1):
        moved = runtime.cut(_moves(matches))
        if moved.isEmpty():
            return profiles.join(own, "id", "left_semi")
        profiles = runtime.cut(profiles.join(moved, "profile", "left").select("id", F.coalesce("target", "profile").alias("profile")))
        made = runtime.cut(fuller(forms, profiles, moved.select(F.col("target").alias("profile")).distinct()).join(forms.select("id"), "id", "left_anti"))
        matches = _carried(matches, moved)
        if not made.isEmpty():
            fresh = runtime.cut(informed(made, told))
            new_blocks = runtime.cut(blocked(fresh))
            forms, blocks = runtime.cut(forms.unionByName(fresh)), runtime.cut(blocks.unionByName(new_blocks))
            profiles = profiles.unionByName(made.select("id", "profile"))
            met = new_blocks.join(blocks.select("key", F.col("id").alias("other")), "key").where("id <> other").select("id", "other").distinct()
            matches = _best(matches.unionByName(_placed(judged(met, forms), profiles)))
        matches = runtime.cut(matches)
    raise RuntimeError(f"profiles still merge after {MOST_ROUNDS} rounds")


def _placed(matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs of spellings as pairs of the profiles that hold them."""
    at = lambda c: profiles.select(F.col("id").alias(c), F.col("profile").alias(f"to_{c}"))
    return matches.join(at("a"), "a").join(at("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), "rank_a", "rank_b", "score", "certain")


def _best(pairs: DataFrame) -> DataFrame:
    """One row for two profiles: the best score, certain if any is, and on either side the richest rank."""
    # A profile is as rich as its richest spelling, also where that spelling takes no part in the pair.
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("rank_a").alias("r")), F.struct(F.col("b").alias("p"), F.col("rank_b").alias("r")))).alias("x")).groupBy("x.p").agg(F.max("x.r").alias("r"))
    apart = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "certain").groupBy("a", "b").agg(F.max("score").alias("score"), F.max("certain").alias("certain"))
    return apart.join(ends.select(F.col("p").alias("a"), F.col("r").alias("rank_a")), "a").join(ends.select(F.col("p").alias("b"), F.col("r").alias("rank_b")), "b").select("a", "b", "rank_a", "rank_b", "score", "certain")


def _carried(matches: DataFrame, moved: DataFrame) -> DataFrame:
    """The pairs between profiles after a round."""
    to = lambda c: moved.select(F.col("profile").alias(c), F.col("target").alias(f"to_{c}"))
    return _best(matches.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "rank_a", "rank_b", "score", "certain"))


def _moves(matches: DataFrame) -> DataFrame:
    """(profile, target) of the profiles that one round merges into others."""
    one = F.struct(F.col("a").alias("own"), F.col("b").alias("other"), (F.col("rank_a") <= F.col("rank_b")).alias("poorer"), F.col("rank_b").alias("depth"))
    two = F.struct(F.col("b").alias("own"), F.col("a").alias("other"), (F.col("rank_b") <= F.col("rank_a")).alias("poorer"), F.col("rank_a").alias("depth"))
    sides = matches.select(F.explode(F.array(one, two)).alias("x"), "score", "certain").select("x.*", "score", "certain")
    # A profile follows what fits best among the richer ones, if that is one; certain pairs merge anyway.
    fit = F.when(F.col("poorer"), F.struct("score", "depth"))
    seen = sides.groupBy("own").agg(
        F.max(fit).alias("best"),
        F.collect_list(F.when(F.col("poorer") | F.col("certain"), F.struct("score", "depth", "other", "poorer", "certain"))).alias("all"),
    )
    tied = F.filter("all", lambda x: x["poorer"] & (x["score"] == F.col("best.score")) & (x["depth"] == F.col("best.depth")))
    sure = F.transform(F.filter("all", lambda x: x["certain"]), lambda x: x["other"])
    follows = F.when(F.size(tied) == 1, F.transform(tied, lambda x: x["other"])).otherwise(F.array().cast("array<bigint>"))
    edges = seen.select("own", F.explode(F.array_distinct(F.concat(follows, sure))).alias("other"))
    both = edges.unionByName(edges.select(F.col("other").alias("own"), F.col("own").alias("other")))
    least = runtime.cut(both.groupBy("own").agg(F.least(F.min("other"), F.first("own")).alias("target")))
    # One step along the least neighbours of the least neighbour; what is left over merges in the next round.
    further = least.select(F.col("own").alias("target"), F.col("target").alias("next"))
    return least.join(further, "target", "left").select(F.col("own").alias("profile"), F.coalesce("next", "target").alias("target")).where("profile <> target")
