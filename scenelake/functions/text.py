"""Text functions as column expressions: tokenisers, cleaning of lines, names, titles, links, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens_ascii(text) -> Column:
    """Lower-case words of a-z and 0-9; any other character parts words. Null gives null, '' an empty array."""
    return F.array_remove(F.split(F.lower(_col(text)), "[^a-z0-9]+"), "")


def tokens_unicode(text) -> Column:
    """Lower-case words of letters, digits and underscores of any script."""
    return F.array_remove(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}_]+"), "")


def non_empty(array) -> Column:
    """The elements that are neither null nor ''."""
    return F.filter(_col(array), lambda x: F.coalesce(x, F.lit("")) != "")


# --- texts of a scene -------------------------------------------------------------------------------------------


def scene_text(heading="heading", action="action_lines") -> Column:
    """Heading and action lines, those that are not empty, joined by spaces."""
    return F.concat_ws(" ", non_empty(F.concat(F.array(_col(heading)), F.coalesce(_col(action), F.array().cast("array<string>")))))


def dialogue_text(dialogue="dialogue") -> Column:
    """'CHARACTER: line' of the entries with both, joined by spaces."""
    full = F.filter(_col(dialogue), lambda d: (F.coalesce(d["character"], F.lit("")) != "") & (F.coalesce(d["line"], F.lit("")) != ""))
    return F.concat_ws(" ", F.transform(full, lambda d: F.concat(d["character"], F.lit(": "), d["line"])))


def character_text(dialogue="dialogue") -> Column:
    """'CHARACTER: first line second line' for each speaker in order of appearance, joined by ' | '."""
    full = F.filter(_col(dialogue), lambda d: (F.coalesce(d["character"], F.lit("")) != "") & (F.coalesce(d["line"], F.lit("")) != ""))
    speakers = F.array_distinct(F.transform(full, lambda d: d["character"]))
    lines = lambda who: F.concat_ws(" ", F.transform(F.filter(full, lambda d: d["character"] == who), lambda d: d["line"]))
    return F.concat_ws(" | ", F.transform(speakers, lambda who: F.concat(who, F.lit(": "), lines(who))))


def full_text(heading="heading", action="action_lines", dialogue="dialogue") -> Column:
    """Heading, joined action lines and dialogue, the non-empty ones joined by spaces."""
    actions = F.concat_ws(" ", non_empty(F.coalesce(_col(action), F.array().cast("array<string>"))))
    return F.concat_ws(" ", non_empty(F.array(_col(heading), actions, dialogue_text(dialogue))))


def word_count(action="action_lines", dialogue="dialogue") -> Column:
    """White-space separated words of action lines and dialogue lines."""
    count = lambda text: F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    total = lambda array: F.aggregate(F.coalesce(array, F.array().cast("array<string>")), F.lit(0), lambda n, x: n + F.when(x.isNull(), 0).otherwise(count(x)))
    return total(_col(action)) + total(F.transform(_col(dialogue), lambda d: d["line"]))


def speakers(dialogue="dialogue") -> Column:
    """Distinct speakers in order of appearance."""
    return F.array_distinct(non_empty(F.transform(_col(dialogue), lambda d: d["character"])))


def scene_id(slug, number) -> Column:
    return F.format_string("%s_scene_%03d", _col(slug), _col(number))


def enough_letters(text, least: int = 3) -> Column:
    """Whether a line has at least `least` letters; fewer are scanning rubbish."""
    return F.regexp_count(_col(text), F.lit(r"\p{L}")) >= least


# --- cleaning of screenplay lines -------------------------------------------------------------------------------

# Fixed: typographic punctuation and what stands for it on a keyboard.
PUNCTUATION = (("�", "'"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."))


def fold_punctuation(text) -> Column:
    """Typographic punctuation as typed on a keyboard."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), PUNCTUATION, _col(text))


def is_doubled(line) -> Column:
    """Whether a line's visible characters come in pairs: at least 8, an even number, four fifths of the pairs equal."""
    chars = F.regexp_replace(_col(line), r"\s", "")
    pairs = F.length(chars) / 2
    same = F.regexp_count(F.regexp_replace(chars, r"(.)(.)", "$1$2\n"), F.lit(r"(.)\1\n"))
    return (F.length(chars) >= 8) & (F.length(chars) % 2 == 0) & (same >= pairs * 0.8)


def undouble(line) -> Column:
    """Every visible character takes the one behind it with it, in lines that are doubled."""
    return F.when(is_doubled(line), F.regexp_replace(_col(line), r"([^ ]).?", "$1")).otherwise(_col(line))


def strip_star(line) -> Column:
    """Without a revision mark in the right margin."""
    return F.regexp_replace(_col(line), r"\s+\*\s*$", "")


def is_page_number(line) -> Column:
    return _col(line).rlike(r"^\s*\d+\.?\s*$")


def is_continued(line, profile: str = "convert") -> Column:
    """CONTINUED marks; the ingest profile knows 'CONTINUED:' and CONT'D, the convert profile all but a bare colon."""
    if profile == "ingest":
        return _col(line).rlike(r"(?i)^\s*\(?(CONTINUED:|CONT'D)\)?\s*$")
    return _col(line).rlike(r"(?i)^\s*\(?CONTINUED(:\s*\(\d+\))?\)?\s*$")


def header_base(line) -> Column:
    """What stands before a number at the end of a line, or null."""
    found = F.regexp_extract(F.trim(_col(line)), r"^(.*?)\s+\d+\.?\s*$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def strip_scene_number(line, profile: str = "convert") -> Column:
    """A heading without the scene number on both its sides."""
    mark = "[0-9]+" if profile == "ingest" else "[A-Z0-9]+"
    kind = r"(?:INT\.?(?:/EXT\.?)?|EXT\.?(?:/INT\.?)?|I/E)"
    pattern = rf"(?i)^(\s*){mark}\s+({kind}(?:\s+.+?)?)\s+{mark}\s*$"
    return F.when(_col(line).rlike(pattern), F.concat(F.regexp_extract(_col(line), pattern, 1), F.trim(F.regexp_extract(_col(line), pattern, 2)))).otherwise(_col(line))


# --- screenplay lines -------------------------------------------------------------------------------------------

# Fixed: words of camera directions, never of names.
SHOT_WORDS = (
    "SHOT ANGLE CUT FADE DISSOLVE INSERT POV P.O.V CLOSE CLOSEUP CLOSE-UP CU ECU WIDE WS EWS ZOOM TILT PAN CRANE TRACKING DOLLY "
    "STEADICAM ESTABLISHING EST AERIAL UNDERWATER HANDHELD MOVING MEDIUM MED MS FULL LONG TWO THREE REVERSE"
).split()
# Fixed: how a scene heading begins.
HEADING = r"(?i)^\s*(INT\.?(?:/EXT\.?)?|EXT\.?|I/E)\b"
# Fixed: abbreviations that end no sentence.
ABBREVIATIONS = "Mr Mrs Ms Dr Jr Sr Lt Sgt Cpl Pvt St Vs No Vol Dept Ext Int".split()


def is_heading(line) -> Column:
    return _col(line).rlike(HEADING)


def is_speaker(line) -> Column:
    """Whether a line is a speaker's name: capitals, at most four words, no heading and no camera direction."""
    text = F.trim(_col(line))
    base = F.trim(F.regexp_replace(text, r"\s*\(.*?\)\s*$", ""))
    words = F.split(base, r"\s+")
    return (base != "") & ~is_heading(text) & base.rlike(r"^[A-Z][A-Z0-9#\s'./-]*$") & (F.size(words) <= 4) & ~F.arrays_overlap(words, F.array(*map(F.lit, SHOT_WORDS)))


def strip_dual_column(line) -> Column:
    """A line without the right column that a translation note stands in; '' if only a speaker's name is left. Lines without such a note stay."""
    # Fixed: how the note begins.
    note = r"(?i)\s{4,}\((?:CHAKOBSA|PHONETIC|[A-Z]+ TRANSLATION)[^)]*\).*$"
    left = F.trim(F.split(F.regexp_replace(_col(line), note, ""), r"\s{8,}", 2)[0])
    return F.when(~_col(line).rlike(note), _col(line)).when(is_speaker(left), "").otherwise(left)


def heading_parts(heading) -> Column:
    """Struct (int_ext, location, time_of_day) of a scene heading; time is UNSPECIFIED without a known word at the end."""
    text = F.trim(_col(heading))
    rest = F.trim(F.regexp_replace(text, r"(?i)^(INT\.?/EXT\.?|EXT\.?/INT\.?|INT\.?|EXT\.?|I/E\.?)\s*", ""))
    # Fixed: words for the time of a scene.
    time = r"^(?i:DAY|NIGHT|MORNING|EVENING|AFTERNOON|DAWN|DUSK|SUNSET|SUNRISE|NOON|MIDNIGHT|LATER|MOMENTS LATER|CONTINUOUS|SAME|SAME TIME|EARLY MORNING|LATE NIGHT)$"
    parts = F.split(rest, r"\s+[-–]\s+")
    last = F.element_at(parts, -1)
    timed = (F.size(parts) > 1) & last.rlike(time)
    return F.struct(
        F.when(text.rlike(r"(?i)^EXT"), "EXT").otherwise("INT").alias("int_ext"),
        F.when(timed, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " - ")).otherwise(rest).alias("location"),
        F.when(timed, F.upper(last)).otherwise("UNSPECIFIED").alias("time_of_day"),
    )


def sentences(block) -> Column:
    """A block of action as sentences: wrapped lines joined, cut where a sentence ends before a capital, but not after an abbreviation."""
    text = F.trim(F.regexp_replace(_col(block), r"\s*\n\s*", " "))
    held = F.regexp_replace(text, rf"\b({'|'.join(ABBREVIATIONS)})\.\s+([A-Z])", "$1.\u0001$2")
    parts = F.split(held, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda p: F.translate(F.trim(p), "\u0001", " ")), lambda p: p != "")


# --- names and titles -------------------------------------------------------------------------------------------


def plain_name(name) -> Column:
    """A character's name in lower case without voice-over and like suffixes."""
    bare = F.regexp_replace(_col(name), r"(?i)\s*\((?:V\.?O\.?|O\.?S\.?|O\.?C\.?|CONT'D|VOICE|ARCHIVE|PRE-LAP)[^)]*\)", "")
    return F.trim(F.lower(bare))


def name_tokens(name) -> Column:
    """Runs of letters of a name."""
    return F.regexp_extract_all(plain_name(name), F.lit("([a-z]+)"), 1)


def stem(filename) -> Column:
    """A file name in lower case without its ending."""
    return F.regexp_replace(F.lower(_col(filename)), r"\.[^.]*$", "")


def title_words(filename) -> Column:
    bare = F.regexp_replace(F.regexp_replace(stem(filename), r"(?<!\d)(?:19|20)\d{2}(?!\d)", ""), r"^-+|-+$", "")
    return F.filter(F.split(F.replace(bare, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")


# Fixed: words that stay lower case within a title.
SMALL_WORDS = "a an the and but or nor for so yet at by in of on to up as is".split()
# Fixed: file names from which title and slug cannot be derived.
TITLE_OVERRIDES = {
    "inglourious-bastards": ("Inglourious Basterds", "inglourious_basterds"),
    "harry-potter-and-the-deathly-hollows-part-2": ("Harry Potter and the Deathly Hallows Part 2", "harry_potter_and_the_deathly_hallows_part_2"),
}


def _overridden(filename, part: int, otherwise: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(stem(filename), r"(?<!\d)(?:19|20)\d{2}(?!\d)", ""), r"^-+|-+$", "")
    out = otherwise
    for key, value in TITLE_OVERRIDES.items():
        out = F.when((stem(filename) == key) | (bare == key), value[part]).otherwise(out)
    return out


def file_title(filename) -> Column:
    """Title from a file name: no year, hyphens as spaces, capitals but for small words within; the stem if nothing is left."""
    words = title_words(filename)
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))
    cased = F.transform(words, lambda w, i: F.when((i == 0) | (i == F.size(words) - 1) | ~w.isin(*SMALL_WORDS), capital(w)).otherwise(w))
    return _overridden(filename, 0, F.when(F.size(words) == 0, stem(filename)).otherwise(F.array_join(cased, " ")))


def file_slug(filename) -> Column:
    words = title_words(filename)
    return _overridden(filename, 1, F.when(F.size(words) == 0, stem(filename)).otherwise(F.array_join(words, "_")))


def file_year(filename) -> Column:
    """The first year of four digits that stands alone in a file name, or null."""
    return F.nullif(F.regexp_extract(_col(filename), r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit(""))


def audit_title(title) -> Column:
    return F.regexp_replace(F.lower(_col(title)), "[^a-z0-9 ]", "")


def wikitext_plain(text) -> Column:
    """Wiki markup as plain text: references, templates however deep, files, links, quotes, headers and tags go."""
    out = F.regexp_replace(_col(text), r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "")
    inner = r"\{\{[^{}]*\}\}"
    for _ in range(4):
        out = F.regexp_replace(out, inner, "")
    # What is nested deeper takes as many more passes as there are openings left at most.
    left = F.regexp_count(out, F.lit(r"\{\{"))
    out = F.when(out.rlike(inner), F.aggregate(F.sequence(F.lit(1), F.greatest(left, F.lit(1))), out, lambda held, _: F.regexp_replace(held, inner, ""))).otherwise(out)
    for pattern, to in (
        (r"(?i)\[\[(?:File|Image):[^\]]*\]\]", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"), (r"\[https?://\S+\s*([^\]]*)\]", "$1"),
        (r"'{2,}", ""), (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"), (r"<[^>]+>", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def ellipsis(text, most: int) -> Column:
    """White space collapsed; cut to `most` characters with an ellipsis at the end."""
    flat = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def candidate_id(movie, clip) -> Column:
    """An opaque id of a candidate clip."""
    return F.concat(F.lit("cand_"), F.substring(F.sha1(F.concat_ws("::", _col(movie), _col(clip))), 1, 10))


def link_seconds(link) -> Column:
    """Start of a video link (t= or start=, plain seconds or 1h2m3s) in seconds, 0 without."""
    t = F.coalesce(F.nullif(F.regexp_extract(_col(link), r"[?&#](?:t|start)=([0-9hms]+)", 1), F.lit("")), F.lit("0"))
    unit = lambda u: F.coalesce(F.expr("0") + F.nullif(F.regexp_extract(t, rf"(\d+){u}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(t.rlike(r"^\d+$"), t.cast("int")).otherwise(unit("h") * 3600 + unit("m") * 60 + unit("s"))


# --- routing of video queries -----------------------------------------------------------------------------------

# Fixed: what in a query points to which field of a clip, in this order.
FIELD_WORDS = {
    "dialogue": "says,said,quote,line,dialog,dialogue,words,speaks,spoken,yells,shouts,whispers,tells",
    "visual": "light,dark,color,colour,shot,camera,looks,visually,cinematography,setting,dim,bright,hazy,close-up,wide,framing,palette,contrast",
    "emotional": "feel,emotion,mood,tone,tense,sad,happy,scary,hopeful,dread,anxious,relief,grief,urgency,terror,awe,uplifting",
    "subjects": "wearing,costume,suit,dressed,appearance,looks like,character,props,helmet,uniform,outfit,attire,astronaut,hair,face",
    "action": "happens,does,running,fighting,jumping,chasing,escaping,sequence,event,flees,crashes,falls,explodes,launches,moves",
    "thematic": "theme,symbol,meaning,represents,metaphor,about,deeper,significance,motif,allegory",
    "plot": "plot,story,movie about,film about,narrative,synopsis",
}


def route_field(query) -> Column:
    """Field a query is about: dialogue if it is a quotation, else the first with a word of its own in it, else action."""
    low = F.lower(_col(query))
    out = F.when(F.trim(_col(query)).rlike(r'^".*"$'), "dialogue")
    for field, words in FIELD_WORDS.items():
        out = out.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words.split(",")]), field)
    return out.otherwise("action")


def known_field(field, fields) -> Column:
    """The field, or action if it is none of `fields`."""
    return F.when(_col(field).isin(*fields, "dialogue"), _col(field)).otherwise("action")


def sanitised_fields(primary, secondary, fields) -> Column:
    """Struct (primary, secondary): a field that is none of `fields` is action; secondary ones are known, once each, and not the primary."""
    first = known_field(primary, fields)
    others = F.filter(F.array_distinct(F.coalesce(_col(secondary), F.array().cast("array<string>"))), lambda f: f.isin(*fields, "dialogue") & (f != first))
    return F.struct(first.alias("primary"), others.alias("secondary"))
