"""Text decoded with the wrong character encoding (problem 4).

Characters are mapped back to the bytes of the legacy code page that may have
produced them. An automaton over the structure of UTF-8 runs over those bytes
and yields the maximal well-formed multibyte spans; only these are decoded, and
only if they become ordinary letters and signs. What was a single-byte text read
through another single-byte code page has no such structure: there, words that
cannot stand (mixed scripts, box drawing, inverted case) are read again through
pairs of code pages, and the pair that leaves no such word wins.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed: code pages that text is commonly decoded with by mistake, likeliest first.
WRONGLY_READ_AS = ("cp1252", "cp437", "mac_roman", "cp1251", "cp850", "cp1250", "cp866", "koi8_r")
# Fixed: (the code page it was read through, the code page it was written in).
SINGLE_BYTE = (
    ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("koi8_r", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"),
    ("cp1251", "cp866"), ("cp437", "cp1251"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp437", "cp866"), ("cp1252", "cp866"),
)
LOST = "�"


@lru_cache(maxsize=None)
def _bytes_of(page: str) -> dict[str, int]:
    """Characters of a code page's upper half; bytes that it leaves undefined stand for the control characters of that number."""
    table = {}
    for b in range(128, 256):
        table[chr(b)] = b if b < 160 else table.get(chr(b), None)
        try:
            table[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return {c: b for c, b in table.items() if b is not None}


def _classes() -> list[int]:
    """The class of each byte: 0 none, 1-3 continuations 80-8F, 90-9F, A0-BF, then the leads by what must follow."""
    kind = [0] * 256
    for b in range(0x80, 0xC0):
        kind[b] = 1 if b < 0x90 else 2 if b < 0xA0 else 3
    for b in range(0xC2, 0xF5):
        kind[b] = 4 if b < 0xE0 else 5 if b == 0xE0 else 7 if b == 0xED else 6 if b < 0xF0 else 8 if b == 0xF0 else 10 if b == 0xF4 else 9
    return kind


CLASS = _classes()
# States: 0 between characters, 1 one, 2 two, 3 three continuations to come, then those whose next byte is restricted.
_ANY = (1, 2, 3)
STEP = {
    (0, 4): 1, (0, 5): 4, (0, 6): 2, (0, 7): 5, (0, 8): 6, (0, 9): 3, (0, 10): 7,
    **{(1, c): 0 for c in _ANY}, **{(2, c): 1 for c in _ANY}, **{(3, c): 2 for c in _ANY},
    (4, 3): 1, (5, 1): 1, (5, 2): 1, (6, 2): 2, (6, 3): 2, (7, 1): 2,
}


def well_formed(codes: list[int]) -> list[tuple[int, int]]:
    """Maximal spans [begin, end) of well-formed multibyte characters; -1 stands for a character without a byte."""
    spans: list[tuple[int, int]] = []
    i = 0
    while i < len(codes):
        state, j, whole = 0, i, i
        while j < len(codes):
            after = STEP.get((state, CLASS[codes[j]] if codes[j] >= 0 else 0))
            if after is None:
                break
            state, j = after, j + 1
            if state == 0:
                whole = j
        if whole > i:
            spans.append((i, whole))
            i = whole
        else:
            i += 1
    return spans


@lru_cache(maxsize=4096)
def ordinary(c: str) -> bool:
    """Letters and signs that running text of European languages has."""
    n = ord(c)
    if 0xA0 <= n <= 0x17F:
        return n not in (0xA4, 0xA6, 0xAC, 0xAF, 0xB8)
    return 0x386 <= n <= 0x3CE or 0x400 <= n <= 0x45F or n in (0x490, 0x491, 0x20AC, 0x2122, 0x2116, 0x218, 0x219, 0x21A, 0x21B) or 0x2010 <= n <= 0x203A


def decode_spans(text: str, page: str, depth: int = 0) -> str:
    """The text with the well-formed spans under one code page decoded."""
    table = _bytes_of(page)
    out, at = [], 0
    for m in re.finditer(r"[^\x00-\x7f]{2,}", text):
        codes = [table.get(c, -1) for c in m[0]]
        for b, e in well_formed(codes):
            found = bytes(codes[b:e]).decode("utf-8")
            if not all(map(ordinary, found)) or page == "cp1252":
                again = found if depth > 2 else decode_spans(found, "cp1252", depth + 1)  # wrongly decoded more than once
                if all(map(ordinary, again)):
                    found = again
                else:
                    continue
            before = m[0][b:e]
            if page in ("cp1251", "cp866", "koi8_r") and len(found) < 2 and all("а" <= c.lower() <= "ё" for c in before):
                continue
            if page in ("cp1251", "cp866", "koi8_r") and all("а" <= c.lower() <= "ё" for c in before) and not all("а" <= c.lower() <= "ё" for c in found):
                continue
            out += [text[at : m.start() + b], found]
            at = m.start() + e
    return "".join(out) + text[at:]


def _script(c: str) -> str:
    n = ord(c)
    return "c" if 0x400 <= n <= 0x52F else "g" if 0x370 <= n <= 0x3FF else "l" if c.isalpha() and n < 0x250 else "o"


_RUSSIAN_VOWEL = re.compile("[аеёиоуыэюяіїє]", re.I)
# Fixed: French words that end in à.
_GRAVE = frozenset("voilà déjà delà holà celà revoilà".split())
#: Opening and closing quotes read through an MS-DOS code page.
_DOS_QUOTES = re.compile(r"(?:^|\s)ô(?=[^\W\d_]).*?(?<=[^\W\d_])[.,!?]?ö(?=[.,!?]*(?:\s|$))")
_PIECE = re.compile(r"\S+")
_BOX = re.compile(r"[─-╿▀-▟√∞≈≠≤≥∫∂∑∏∩⌐⌠⌡◊ⁿƒ]")


@lru_cache(maxsize=100_000)
def wrong(word: str) -> int:
    """How many things in a word cannot stand in an ordinary text."""
    if word.isascii():
        return 0
    bad = len(_BOX.findall(word)) + sum("\x80" <= c <= "\x9f" for c in word)
    for run in re.findall(r"[^\W\d_]+", word):
        scripts = {_script(c) for c in run}
        bad += len(scripts) - 1
        if scripts == {"c"}:
            bad += sum(c in "ЂЃЉЊЌЋЏђѓљњќћџѕЅјЈҐґ" for c in run) + (len(run) > 2 and not _RUSSIAN_VOWEL.search(run))
        bad += len(re.findall("(?<=[bcdfghjklmnpqrstvwxz])ß", run)) + (run.endswith("à") and len(run) > 2 and run.lower() not in _GRAVE)
        foreign = [c for c in run if ord(c) > 127]
        if scripts == {"g"} and len(run) < 3:
            bad += 1
        western = sum("À" <= c <= "ÿ" for c in run)
        if western >= 3 and western > 0.6 * len(run) or western >= 2 and western == len(run):
            bad += western
        if foreign and len(run) > 1 and any(a.islower() and b.isupper() for a, b in zip(run, run[1:])):
            bad += 1
        if scripts == {"c"} and len(run) > 1 and run[0].islower() and run[1:].isupper():
            bad += 1
        if foreign and len(run) == 1 and scripts == {"l"} and len(word) == 1 and word not in "ÀàÁáÉéÈèÓóÒòÍíÚúÖöÅåÆæØøªºÔô":
            bad += 1
    bad += len(re.findall(r"[.,!?;:][^\W\d_ -~]+$", word))  # a letter alone behind a mark
    bad += len(re.findall(r"(?<=[^\W\d_])[¤¥¦§¨©¬®¯°±²³´µ¶·¸¹¼½¾¿¡÷×¢¢ª](?=[^\W\d_])", word)) * (0 if "\xad" in word else 1)
    bad += sum(c in "¤¨¯´¸¼½¾÷×³²" for c in word if not word[0].isdigit())
    return bad


def _reread(word: str, read: str, written: str) -> str | None:
    table = _bytes_of(read)
    out = []
    for c in word:
        if ord(c) < 128:
            out.append(c)
            continue
        b = table.get(c)
        if b is None:
            return None
        try:
            out.append(bytes([b]).decode(written))
        except UnicodeDecodeError:
            return None
    return "".join(out)


#: Marks that scanning leaves in clean text; they say nothing about its encoding.
_SCAN = re.compile("[†‡|¦·¬\xad£€@§°ﬁﬂ•]")


def _clean_cyrillic(word: str) -> bool:
    letters = [c for c in word if c.isalpha()]
    return bool(letters) and all(_script(c) == "c" for c in letters) and word[1:].islower() and not wrong(word)


def _upper_cyrillic(word: str) -> bool:
    return word.isupper() and any(_script(c) == "c" for c in word)


@lru_cache(maxsize=100_000)
def repair(text: str) -> tuple[str, str]:
    """(text as restored, how): '' if nothing was wrong, 'utf-8', 'code page', or 'lost' if characters are gone."""
    if text.isascii():
        return text, ""
    fixed, how = text, ""
    for _ in range(4):
        # The code page under which most of the text decodes; between equals the likelier.
        best = min((decode_spans(fixed, page) for page in WRONGLY_READ_AS), key=len)
        if best == fixed or len(best) == len(fixed):
            break
        fixed, how = best, "utf-8"
    words = [m[0] for m in _PIECE.finditer(fixed) if not m[0].isascii()]
    quoted = {w for m in _DOS_QUOTES.finditer(fixed) for w in m[0].split() + [fixed[m.start() :].split()[len(m[0].split()) - 1]] if w.startswith("ô") or "ö" in w[-2:]}
    suspects = [w for w in words if wrong(_SCAN.sub("", w)) or w in quoted]
    if suspects:
        now = sum(wrong(_SCAN.sub("", w)) for w in suspects) + len(quoted)
        best = None
        for read, written in SINGLE_BYTE:
            tried = [_reread(w, read, written) for w in suspects]
            if any(t is None for t in tried):
                continue
            after = sum(map(wrong, tried)) + sum(not (ordinary(c) or c == "—") for t in tried for c in t if ord(c) > 127) + 0.2 * sum(len(re.findall(r"(?i)[^\W\d_ -~]{3,}", t)) for t in tried if not re.search("[а-яё]", t))
            if after < now and (best is None or after < best[0]):
                best = (after, read, written)
        if best:
            _, read, written = best
            chosen = set(suspects)
            for w in words:
                # other words of the same misreading: those that it turns into no worse ones, if they stand next to a suspect
                t = _reread(w, read, written)
                if w not in chosen and t is not None and wrong(t) <= wrong(w) and all(ordinary(c) for c in t if ord(c) > 127) and (len(suspects) >= 0.5 * len(words) and not _clean_cyrillic(w) or _upper_cyrillic(w)):
                    chosen.add(w)
            fixed = _PIECE.sub(lambda m: _reread(m[0], read, written) if m[0] in chosen else m[0], fixed)
            how = how or "code page"
        elif any(wrong(_SCAN.sub("", w)) >= 1 for w in suspects):
            how = how or "lost"
    if LOST in fixed:
        how = "lost"
    return fixed, how


def elements(scenes: DataFrame) -> DataFrame:
    """(scene_id, field_name, pos, value) of every action line and dialogue line with a character beyond ASCII; repeated scenes count once."""
    action = scenes.select("scene_id", F.lit("action_lines").alias("field_name"), F.posexplode("action_lines").alias("pos", "value"))
    spoken = scenes.select("scene_id", F.lit("dialogue").alias("field_name"), F.posexplode(F.col("dialogue.line")).alias("pos", "value"))
    return action.unionByName(spoken).where(F.col("scene_id").isNotNull() & F.col("value").rlike(r"[^\x00-\x7F]"))


def garbled(scenes: DataFrame) -> DataFrame:
    """(scene_id, field_name, pos, value, restored, how) of each garbled element.

    Null scenes, arrays, entries and lines give no row, nor do lines without
    characters beyond ASCII; repeated scenes count once. `restored` is the text as
    far as it can be brought back, with U+FFFD where a character is lost.
    """

    def run(batches):
        for batch in batches:
            fixed = [repair(v) for v in batch["value"]]
            out = batch.assign(restored=[f for f, _ in fixed], how=[h for _, h in fixed])
            yield out[out["how"] != ""]

    return elements(scenes).mapInPandas(run, "scene_id string, field_name string, pos int, value string, restored string, how string").distinct()


def restored(scenes: DataFrame) -> DataFrame:
    """garbled() with lost characters filled in from the corpus: a word with lost characters takes the commonest whole word that has other characters in their place.

    The clean words of all elements are counted, so the result grows no driver table; a word that no clean word fits keeps its U+FFFD.
    """
    broken = garbled(scenes)
    clean = elements(scenes).where(~F.col("value").contains(LOST)).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?U)([\w'’]*[^\x00-\x7F\s]+[\w'’]*)"), 1)).alias("word"))
    vocabulary = (
        clean.where(F.col("word").rlike(r"(?U)^[\p{L}'’]+$")).groupBy("word").count().where("count > 2")
        .select(F.regexp_replace("word", r"[^\x00-\x7F]", LOST).alias("gap"), "word", "count").where("length(gap) > 1")
        .groupBy("gap").agg(F.max_by("word", F.struct("count", "word")).alias("whole"))
    )
    key = ["scene_id", "field_name", "pos", "value"]
    words = broken.where(F.col("restored").contains(LOST)).select(*key, F.posexplode(F.split("restored", " ")).alias("n", "part"))
    words = words.withColumn("gap", F.regexp_extract("part", r"(?U)([\p{L}'’�]*�[\p{L}'’�]*)", 1))
    filled = words.join(vocabulary, "gap", "left").select(*key, "n", F.when(F.col("whole").isNotNull(), F.expr("replace(part, gap, whole)")).otherwise(F.col("part")).alias("part"))
    texts = filled.groupBy(*key).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"])).alias("filled"))
    return broken.join(texts, key, "left").select(*key, F.coalesce("filled", "restored").alias("restored"), "how")
