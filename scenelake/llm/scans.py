"""Noise of scanned pages in headings and action lines (problem 2).

The words of the whole corpus are counted. Lines at page edges (in capitals, or
with a page number or draft mark) that come again in a movie, up to a bounded
edit distance, are running headers; bare numbers that rise with the scenes are
page numbers; both are taken out with "continued" marks. A word that the corpus
hardly holds, and that undoing a usual misreading turns into one that it holds
very often, was misread. What is left is joined: a word cut by a hyphen becomes
the whole word or the hyphenated one, whichever the corpus holds, and lines that
broke within a sentence become one paragraph.

There is one way through: a field has noise if its repair has other words or
signs than the field itself.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake import runtime
from scenelake.llm.canonical import distance

MOST_WORDS = 100_000  # words the executors hold, all that count LEAST_COUNT or more; beyond it an error
LEAST_COUNT = 5
TIMES_COMMONER = 40
REPEATS = 3  # scenes of a movie that must hold a line for it to be a running header
HEADER_ERRORS = 0.15  # of its letters, by which a line may differ from a running header
RISING = 0.5  # correlation with the scene's number, under which three and more bare numbers are no page numbers
FEW_HEADERS = 100_000  # rows of headers that are sent to all executors; more are joined by the movie

# Fixed: what scanners read for what stood there.
MISREAD = tuple(p.split(">") for p in "@>a 0>o c>e †>t 1>l 1>i !>i !>l li>h ri>n 9>g cl>d ii>u vv>w rn>m £>e 5>s l>i l>t 4>a nn>m lv>n 6>g 6>b m>rn d>cl ﬂ>fl ﬁ>fi 8>b 3>e $>s |>l ¦>i n>ri u>ii h>li i>l e>c".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TOKEN = re.compile(r"[\w†@|¦£$!ﬁﬂ]*[^\W\d_][\w†@|¦£$ﬁﬂ]*(?:!(?=\w)[\w†@|¦£$ﬁﬂ]+)*(?:['’-][\w†@]+)*")
_JAVA_WORD = r"(?U)\p{L}+(?:['’-]\p{L}+)*"
_CUT = re.compile(r"(?<=[^\W\d_])[-¬\xad‐]\s*[\r\n]\s*(?=[^\W\d_])|(?<=[^\W\d_])- (?=[^\W\d_])")
_CUT_END = re.compile(r"(?<=[^\W\d_])[-¬\xad‐]\s*$")
_STRAY = re.compile(r"(?:^|(?<=\s))(?:[|¦·•~^]|'~|~')(?=\s|$)")
_PAGE = re.compile(r"(?i)^\W*(?:page\s*)?[\dlO]{0,3}\d[\dlO]{0,3}(?:\s*(?:of|/)\s*[\dlO]{1,4})?\W*$")
_PAGE_WORD = re.compile(r"(?i)^\W*p[a@]ge\s+[\dlO]{1,4}(?:\s+[o0]f\s+[\dlO]{1,4})?\W*$")
_TAIL = re.compile(r"\s{2,}[\dlO]{1,4}\s*\.?\s*$|\s/\s[\dlO]{1,4}\s*$|\s[-–]\s*Rev\..*$|\s{2,}Rev\..*$")
_HEAD = re.compile(r"(?i)^\W*(?:(?:white|blue|pink|yellow|green|goldenrod|buff|salmon|cherry|tan|revised|final|shooting)\s+(?:draft|rev\w*|pages?|script))\W+|^\W*\d{1,4}\s{2,}")
_HEADING_PAGE = re.compile(r"(?<!ROOM)(?<!APARTMENT)(?<!SUITE)(?<!STAGE)(?<!FLOOR)(?<!ROUTE)\s+[-\[(]?\s*[\dlO]*\d[\dlO]*\s*[-\])]?\.?\s*$")
_LETTERS = str.maketrans("@01!5†£8|$9463", "aoiistebisgagE".lower())


def plain_letters(text: str) -> str:
    """Letters only, misread characters put back, for comparing lines."""
    return re.sub(r"[\W\d_]+", "", text.lower().translate(_LETTERS))


_MANY_LETTERS = re.compile(r"(?:[^\W\d_][\W\d_]*){16}")


def is_continued(line: str) -> bool:
    """CONTINUED in any of its forms, with page or part numbers, however misread; no form has 16 letters."""
    if _MANY_LETTERS.search(line):
        return False
    word = plain_letters(re.sub(r"\(\s*[\dlO]+\s*\)|(?:^|\s)\d+\.?(?=\s|$)", " ", line))
    if word in ("continued", "contd", "cont", "more"):
        return not re.fullmatch(r"(?i)more\W*", line.strip()) or line.strip().startswith("(")
    return 8 <= len(word) <= 11 and sum((Counter("continued") - Counter(word.replace("l", "i").replace("rn", "m"))).values()) <= 1 and word[:2] in ("co", "eo", "cc") and line.strip()[:1] in "(C0cG123456789"


def bare_number(line: str) -> int | None:
    """The number of a line that is nothing else, however misread."""
    return int(re.sub(r"\D", "", line.split("of")[0].split("/")[0].replace("l", "1").replace("O", "0")) or 0) if _PAGE.match(line) else None


def page_mark(line: str, numbered: bool = True) -> bool:
    """A page number by itself, where the movie has such, or a "continued" mark."""
    return bool(numbered and _PAGE.match(line) or _PAGE_WORD.match(line)) or is_continued(line)


def edge_line(line: str) -> str:
    """The letters of a line that may be a running header, or ''."""
    tail = _TAIL.search(line)
    head = _HEAD.match(line)
    marked = tail is not None or head is not None
    # Too few capitals, whatever else stands there: most lines end here.
    if not marked and sum(map(str.islower, line)) > 0.2 * len(line):
        return ""
    body = _TAIL.sub("", _HEAD.sub("", line))
    letters = [c for c in body if c.isalpha()]
    if len(letters) < 6 or not marked and sum(c.isupper() for c in letters) < 0.8 * len(letters):
        return ""
    return plain_letters(body.replace("...", ""))


def signatures(letters: str) -> list[str]:
    """Two ends of a line's letters, under which lines that may be the same meet."""
    return [letters[:7], letters[-7:]] if letters else []


@lru_cache(maxsize=100_000)
def same_header(letters: str, header: str) -> bool:
    """Whether a line's letters are those of a header, or of its beginning, up to a few errors."""
    a, b = sorted((letters, header), key=len)
    most = max(1.0, HEADER_ERRORS * len(a))
    return distance(a, b, most) <= most or len(a) >= 8 and distance(a, b[: len(a)], most) <= most


def like_slug(letters: str, slug: str | None) -> bool:
    """Whether the letters begin as the movie's slug does, up to a misread character or two."""
    own = plain_letters(slug or "")
    n = min(len(own), len(letters))
    if n < 8:
        return False
    a, b = letters[:n], own[:n]
    return sum(x != y for x, y in zip(a, b)) <= n // 8 + 1 or own.startswith(letters[:8]) or letters[-8:] == own[-8:]


def undone(word: str, depth: int = 2) -> list[str]:
    """What the word may have been before one or two misreadings."""
    found, last = {}, {word: None}
    for _ in range(depth):
        step = {}
        for w in last:
            for read, stood in MISREAD:
                at = w.find(read)
                while at >= 0:
                    step[w[:at] + stood + w[at + len(read) :]] = None
                    at = w.find(read, at + 1)
        found |= step
        last = step
    return list(found)


# Fixed: the misreadings of MISREAD that lengthen a word, in two orders, and the letters taken for one another.
_ORDERS = tuple(tuple(p.split(">") for p in order.split()) for order in ("rn>m nn>m ri>n lv>n ii>u vv>w cl>d li>h ﬂ>fl ﬁ>fi", "li>h cl>d ii>u ri>n vv>w lv>n nn>m rn>m ﬂ>fl ﬁ>fi"))
_ALIKE = str.maketrans("c1!|¦l0@4†8695£3$it", "eiiiiioaaibggseesii")


@lru_cache(maxsize=300_000)
def shapes(word: str) -> tuple[str, ...]:
    """Forms that a word shares with what it is misread for."""
    found = []
    for order in _ORDERS:
        w = word
        for read, stood in order:
            w = w.replace(read, stood)
        found.append(w.translate(_ALIKE))
    return tuple(dict.fromkeys(found))


def _named(text: str, m: re.Match) -> bool:
    """Whether a word is capitalised, but not all of it, and not because a sentence begins."""
    w = m[0]
    before = text[: m.start()].rstrip(" \t\"“«¿(")
    return w[:1].isupper() and not w.isupper() and bool(before) and before[-1] not in ".!?…:\n"


class Vocabulary:
    """The commonest words of the corpus with their counts."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.known: dict[str, str] = {}
        self.fine: set[str] = set()  # words in lower case that are no misreadings
        self.shaped: dict[str, int] = {}
        for word, n in counts.items():
            if n >= 20:
                for shape in shapes(word):
                    self.shaped[shape] = max(n, self.shaped.get(shape, 0))

    def original(self, word: str) -> str:
        """The common word that a rare word is a misreading of, or the word itself."""
        fixed = self.known.get(word)
        if fixed is None:
            if len(self.known) > 300_000:
                self.known.clear()
            mine, best, fixed = self.counts.get(word, 0), 0, word
            odd = not word.replace("-", "").replace("'", "").replace("’", "").isalpha()
            shaped = max(self.shaped.get(x, 0) for x in shapes(word))
            if len(word) > 2 and (odd and shaped or shaped >= max(20, TIMES_COMMONER * (mine + 1))):
                for depth in (1, 2):
                    for other in undone(word, depth):
                        n = self.counts.get(other, 0)
                        if n > best and (odd or n >= max(20, TIMES_COMMONER * (mine + 1)) and (len(word) > 3 or n > 400)):
                            best, fixed = n, other
                    if best:
                        break
            self.known[word] = fixed
        return fixed

    def certain(self, word: str, named: bool) -> str:
        """original(), but a capitalised word within a sentence may be a name: only a long one and a single misreading count."""
        low = word.lower()
        fixed = self.original(low)
        if fixed == low or not named:
            return fixed
        return fixed if len(low) > 5 and fixed in undone(low, 1) else low

    def repair(self, text: str) -> str:
        """The text with misread words put right and stray marks taken out."""

        def word(m: re.Match) -> str:
            w = m[0]
            low = w.lower()
            if low in self.fine:
                return w
            fixed = self.certain(w, _named(text, m))
            if fixed == low:
                if len(self.fine) > 300_000:
                    self.fine.clear()
                if self.original(low) == low:
                    self.fine.add(low)
                return w
            return fixed.upper() if sum(c.isupper() for c in w) > 1 else fixed[:1].upper() + fixed[1:] if w[:1].isupper() else fixed

        text = _STRAY.sub("", text)
        if not self.fine.issuperset(_TOKEN.findall(text.lower())):
            text = _TOKEN.sub(word, text)
        return re.sub(r"[ \t]{2,}", " ", text).strip()

    def join(self, left: str, right: str) -> str:
        """Two halves of a word cut by a hyphen: whole or hyphenated, whichever the corpus holds more often."""
        a = re.search(r"[\w'’-]*$", left)[0].lower()
        b = re.match(r"[\w'’-]*", right)[0].lower()
        whole, hyphened = self.counts.get(self.original(a + b), 0), self.counts.get(f"{a}-{b}", 0)
        return left + ("-" if hyphened > whole else "") + right


def repaired(heading: str | None, lines: list[str | None], slug: str | None, headers: list[str], vocabulary: Vocabulary, numbered: bool = True) -> tuple[str | None, list[str]]:
    """(clean heading, continuous paragraphs) of one scene; headers are the letters of the movie's running headers."""
    clean = heading
    if heading and heading.strip():
        clean = _HEADING_PAGE.sub("", _TAIL.sub("", heading.strip()))
        clean = _joined(clean, vocabulary)
        clean = re.sub(r"^[^\s-]{2,9}?[.,](?=[\s/])|(?<=/)[^\s-]{2,4}?[.,](?=\s)", lambda m: _prefix(m[0]), clean)
        clean = re.sub(r"^[^\s/-]{3}\.?/[^\s/-]{3}[.,](?=\s)", lambda m: "/".join(_prefix(x) for x in m[0].split("/")), clean)
        clean = vocabulary.repair(clean)
    kept = []
    for line in lines:
        if not line or not line.strip() or page_mark(line, numbered):
            continue
        letters = edge_line(line)
        if letters and (like_slug(letters, slug) or any(same_header(letters, h) for h in headers)):
            continue
        kept.append(_joined(line.strip(), vocabulary))
    paragraphs: list[str] = []
    for line in kept:
        if paragraphs and _CUT_END.search(paragraphs[-1]):
            paragraphs[-1] = vocabulary.join(_CUT_END.sub("", paragraphs[-1]), line)
        elif paragraphs and not re.search(r"[.!?…:\"”»)’']$", paragraphs[-1]) and (line[:1].islower() or line[:1].isdigit() or paragraphs[-1].endswith(",")):
            paragraphs[-1] += " " + line
        else:
            paragraphs.append(line)
    return clean, [vocabulary.repair(x) for x in paragraphs]


def _joined(text: str, vocabulary: Vocabulary) -> str:
    """The text with words put together that a hyphen cut within it."""
    parts = _CUT.split(text)
    whole = parts[0]
    for part in parts[1:]:
        whole = vocabulary.join(whole, part)
    return whole


def _prefix(text: str) -> str:
    """INT. or EXT., however misread; anything else as it stands."""
    letters = re.sub(r"[^a-z]", "", text.lower().translate(str.maketrans("1!|l£0", "iiiieo")).replace("f", "e"))
    return "INT." if letters in ("int", "inf", "ini") else "EXT." if letters in ("ext", "exi", "eat") else text


def vocabulary(scenes: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT) -> dict[str, int]:
    """The words of all headings and action lines that count `least` or more, with their counts; ValueError if they are more than `most`.

    A word left out would count as unseen and pass for a misreading, so none is.
    """
    texts = F.concat_ws("\n", F.col("heading"), F.concat_ws("\n", "action_lines"))
    words = scenes.select(F.explode(F.regexp_extract_all(F.lower(texts), F.lit(_JAVA_WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).limit(most + 1)
    found = {r["word"]: r["n"] for r in counted.collect()}
    if len(found) > most:
        raise ValueError(f"more than {most} words count {least} or more; give a higher bound")
    return found


def changed(before: list[str | None], after: list[str | None]) -> bool:
    """Whether texts differ in more than spacing and where their lines end."""
    flat = lambda texts: " ".join(" ".join(t for t in texts if t).split())
    return flat(before) != flat(after)


_CAPITALS = "length(regexp_replace(line, '[^\\\\p{Ll}]', '')) <= 0.25 * length(regexp_replace(line, '[^\\\\p{L}]', ''))"


def edges(scenes: DataFrame) -> DataFrame:
    """(slug, headers, numbered): the letters of each movie's running headers, and whether its bare numbers are page numbers.

    Only lines that stand out are looked at: in capitals, with a number or draft
    mark at an end. Lines meet under both ends of their letters; those of one
    meeting count together, and the commonest of them is the header.
    """
    lines = scenes.where("slug is not null").select("slug", "scene_id", "scene_number", F.explode("action_lines").alias("line")).where("line is not null")
    marked = F.col("line").rlike(_TAIL.pattern) | F.col("line").rlike(_HEAD.pattern) | F.col("line").rlike(_PAGE.pattern) | F.expr(_CAPITALS)

    def looked_at(batches):
        for batch in batches:
            out = []
            for slug, scene, place, line in zip(batch["slug"], batch["scene_id"], batch["scene_number"], batch["line"]):
                number = bare_number(line)
                if number is not None:
                    out.append((slug, scene, "", "", None if pd.isna(place) else float(place), float(number)))
                elif not page_mark(line) and (letters := edge_line(line)):
                    out += [(slug, scene, s, letters, None, None) for s in signatures(letters)]
            yield pd.DataFrame(out, columns=["slug", "scene_id", "signature", "letters", "place", "number"])

    found = lines.where(marked).mapInPandas(looked_at, "slug string, scene_id string, signature string, letters string, place double, number double").distinct()
    counted = found.groupBy("slug", "signature", "letters").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("place", "number"), F.stddev_pop("place") * F.stddev_pop("number")).alias("rising"))
    meetings = counted.groupBy("slug", "signature").agg(F.sum("n").alias("n"), F.max_by("letters", F.struct("n", "letters")).alias("letters"), F.max("rising").alias("rising"))
    header = F.when((F.col("signature") != "") & (F.col("n") >= REPEATS), F.col("letters"))
    # Few or unrelated numbers: two are no sequence, and numbers of scenes without a place have no correlation.
    scattered = (F.col("signature") == "") & (F.col("n") >= 3) & (F.col("rising") < RISING)
    movies = meetings.groupBy("slug").agg(F.sort_array(F.collect_set(header)).alias("headers"), (~F.max(scattered)).alias("numbered"))
    return movies.where("size(headers) > 0 or not numbered")


def mended(scenes: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(scene_id, heading, paragraphs, noisy) of every scene, cleaned of noise of scanning; noisy are the fields that had some.

    A scene without noise keeps its heading and its lines, blank and null lines
    left out. Null scenes give no row; null or blank headings, arrays and lines have
    no noise and null headings stay null; repeated scenes give repeated rows. Only
    scene_id, slug, scene_number (if there is one), heading and action_lines are read.
    """
    spark = scenes.sparkSession
    place = F.col("scene_number") if "scene_number" in scenes.columns else F.lit(None).cast("int")
    rows = scenes.where("scene_id is not null").select("scene_id", "slug", place.alias("scene_number"), "heading", "action_lines")
    shared = spark.sparkContext.broadcast(vocabulary(rows, most_words))
    movies = runtime.cut(edges(rows))
    few = movies.limit(FEW_HEADERS + 1).count() <= FEW_HEADERS

    def mend(batches):
        words = Vocabulary(shared.value)
        for batch in batches:
            out = []
            for scene, slug, heading, lines, headers, numbered in zip(*(batch[c] for c in ("scene_id", "slug", "heading", "action_lines", "headers", "numbered"))):
                lines = [] if lines is None else list(lines)
                clean, paragraphs = repaired(heading, lines, slug, [] if headers is None else list(headers), words, numbered is None or pd.isna(numbered) or bool(numbered))
                noisy = [f for f, before, after in (("heading", [heading], [clean]), ("action_lines", lines, paragraphs)) if changed(before, after)]
                out.append((scene, clean, paragraphs, noisy))
            yield pd.DataFrame(out, columns=["scene_id", "heading", "paragraphs", "noisy"])

    known = rows.join(F.broadcast(movies) if few else movies, "slug", "left")
    return known.select("scene_id", "slug", "heading", "action_lines", "headers", "numbered").mapInPandas(mend, "scene_id string, heading string, paragraphs array<string>, noisy array<string>")


def noisy_fields(scenes: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(scene_id, field_name) of each heading and list of action lines that the repair changes; cases as mended()."""
    return mended(scenes, most_words).select("scene_id", F.explode("noisy").alias("field_name")).distinct()


def repaired_scenes(scenes: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(scene_id, heading, paragraphs) of every scene, cleaned of noise of scanning; repeated scenes count once; cases as mended()."""
    return mended(scenes, most_words).select("scene_id", "heading", "paragraphs").distinct()
