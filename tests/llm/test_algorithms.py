"""Linkage, names, chunking, canonical values: small fixtures and brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenelake.llm import canonical, chunking, linkage, names

# --- chunking (problem 5) ---


def greedy(text, limit, overlap):
    """The cuts by walking from piece to piece."""
    at, kinds = (x.tolist() for x in chunking.boundaries(text))
    kind = dict(zip(at, kinds))
    for a, b in zip(at, at[1:]):
        if b - a > limit // 4:
            kind |= {i: kind.get(i, 0) for i in range(a + 1, b)}
    places = sorted(kind)
    cuts, here = [], 0
    while here < len(text):
        if len(text) - here <= limit:
            cuts.append((here, len(text)))
            break
        far = [p for p in places if here < p <= here + limit]
        end = next((max(c) for k in (3, 2, 1) if (c := [p for p in far if kind[p] >= k and p > here + limit // 2])), max(far))
        cuts.append((here, end))
        after = [p for p in places if end - overlap <= p < end and p > here]
        here = next((min(c) for k in (2, 1) if (c := [p for p in after if kind[p] >= k])), end)
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n", max_size=120), max_size=4), st.integers(8, 40), st.integers(0, 3))
def test_pointer_doubling_equals_walking(texts, limit, overlap):
    got = chunking.text_cuts(texts, limit, overlap)
    for t, cuts in zip(texts, got):
        assert cuts == greedy(t, limit, overlap)
        assert all(0 < b - a <= limit for a, b in cuts)
        joined, end = "", 0
        for a, b in cuts:
            assert a <= end
            joined, end = joined + t[end:b], b
        assert joined == t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), max_size=12), min_size=1, max_size=4), st.integers(5, 40))
def test_entries_equal_walking(sizes, limit):
    for s, cuts in zip(sizes, chunking.entry_cuts(sizes, limit)):
        want, here = [], 0
        width = lambda a, b: sum(s[a:b]) + b - a - 1
        while here < len(s):
            end = here + 1
            while end < len(s) and width(here, end + 1) <= limit:
                end += 1
            want.append((here, end))
            if end == len(s):
                break
            here = end - 1 if end - 1 > here and width(end - 1, end + 1) <= limit else end
        assert cuts == want


def test_oversized_tables(spark):
    d = "array<struct<character:string,line:string,parenthetical:string>>"
    plots = spark.createDataFrame([("1", "x" * 2001), ("1", "x" * 2001), ("2", "y" * 2000), ("3", None), (None, "z" * 3000), ("4", "A b. " * 900)], "tmdb_id string, wiki_plot string").withColumn("key", F.lit(0)).withColumn("text", F.lit(""))
    spoken = [("A", "word " * 40, None)] * 9 + [("", "lost " * 999, None), ("B", " ", None), (None, "x", None)]
    scenes = spark.createDataFrame([("s1", spoken), ("s2", spoken[:2]), ("s3", None), ("s4", [("A", "b" * 4000, None)])], f"scene_id string, dialogue {d}")
    assert sorted(map(tuple, chunking.oversized(plots, scenes).collect())) == [("dialogue", "s1"), ("dialogue", "s4"), ("wiki_plot", "1"), ("wiki_plot", "4")]
    for r in chunking.split_dialogues(scenes).collect():
        assert 0 < len(r.piece) <= 1500
    four = sorted(chunking.split_texts(plots, "tmdb_id", "wiki_plot").where("tmdb_id = '4'").collect(), key=lambda r: r.piece_no)
    assert "".join(r.piece[r.repeated :] for r in four) == "A b. " * 900 and all(0 < r.repeated <= 200 for r in four[1:])
    assert chunking.oversized(plots.limit(0), scenes.limit(0)).count() == 0


# --- canonical values (problem 6) ---

TITLES = [(1, "The Ghost of Druflis Vobar", 1990), (2, "The Ghost of Druflis Vobar 2", 1996), (3, "Rahan and Wabren", 1980), (4, "Pitho Mele: Burning Garden", 1970), (5, "Hotra Against Slachak", 1983), (6, "A House in Slekru, a Garden in Fremos", 1975)]


@pytest.mark.parametrize("typed, meant", [
    ("the ghost of druflis vobar", 1), ("Ghost of Druflis Vobar, The", 1), ("The Gohst of Druflis Vobarr (film)", 1), ("THE_GHOST_OF_DRUFLIS_VOBAR", 1), ("The Ghost of Druflis Vobar Part Two", 2), ("The Ghost of Druflis Vobar: Part 2!", 2),
    ("The Ghost of Druflis Vobar III", -1), ("The Ghost of Druflis Vobar: Part Five", -1), ("Wabren & Rahan", 3), ("Pitho Mele", 4), ("not Hotra vs. Slachak [1983]", 5), ("Hotra vs. Slachak [1960]", -1), ("AHiSaGiF", 6), ("all sequels", -1),
    ("The Ghost of Svugik Griflel", -1), ("???", -1),
])
def test_titles(typed, meant):
    assert canonical.Titles(TITLES, {}).find(typed) == meant


@pytest.mark.parametrize("typed, meant", [
    ("sci fi", 3), ("#Scifi", 3), ("SF", 3), ("romanec movies", 2), ("romantic", 2), ("genre: war", 1), ("draam", 4), ("melodrama", 4), ("dramatic", 4), ("cooking", -1), ("act1on", 5), ("action packed", 5), ("90s", -1), ("-", -1),
    ("song and dance musical", 8), ("musicals", 8), ("musica", 7), ("biopics", 9), ("docu", 10), ("whodunit", -1), ("kung fu", -1), ("any", -1), ("old", -1),
])
def test_genres(typed, meant):
    names = ["War", "Romance", "Science Fiction", "Drama", "Action", "Sport", "Music", "Musical", "Biography", "Documentary"]
    assert canonical.Genres(list(enumerate(names, 1)), {}).find(typed) == meant


def test_a_word_typed_often_is_no_misspelling():
    book = canonical.Genres([(1, "Sport"), (2, "Drama")], {1: 100, 2: 80})
    assert book.find("sprot", 1) == 1 and book.find("short", 1) == 1 and book.find("short", 30) == -1 and book.find("sporrt", 30) == 1


def plain_distance(a, b):
    """Edits without weights, neighbours swapped counting one."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcd", min_size=5, max_size=8), min_size=1, max_size=12), st.text(alphabet="abcd", min_size=5, max_size=8))
def test_symmetric_deletes_find_what_brute_force_finds(entries, word):
    found = set(canonical.Dictionary([(e, i) for i, e in enumerate(entries)], {}).near(word))
    assert {e for e in entries if plain_distance(word, e) <= 2} <= found


def test_canonical_table(spark):
    plans = spark.createDataFrame(
        [(1, ("sci fi", 1, 2), ["Pitho Mele", "", None, "Hotra Against Slachak"]), (1, ("sci fi", 1, 2), ["Pitho Mele", "", None, "Hotra Against Slachak"]), (2, None, None), (3, (None, 1, 1), []), (None, ("x", 1, 1), ["y"]), (4, ("zzz", 1, 1), None)],
        "plan_id long, filters struct<genre:string,year_min:int,year_max:int>, exclude_titles array<string>",
    ).withColumn("value", F.lit("clash"))
    genres = spark.createDataFrame([(3, "Science Fiction"), (None, "x"), (4, None)], "genre_id long, genre string")
    titles = spark.createDataFrame(TITLES, "title_id long, title string, release_year int")
    got = sorted((r.plan_id, r.field_name, r.pos, r.ref_id) for r in canonical.canonical_values(plans, genres, titles).collect())
    assert got == [(1, "exclude_titles", 0, 4), (1, "genre", 0, 3), (4, "genre", 0, -1)]
    assert canonical.canonical_values(plans.limit(0), genres, titles).count() == 0


# --- names (problem 3) ---


def pairs_of(spark, cast, said):
    characters = spark.createDataFrame([("m", None, t) for t in cast] + [("m", s, None) for s in said] or [("m", None, None)], "slug string, screenplay_name string, tmdb_character string")
    scenes = spark.createDataFrame([("m", [(said[0], "x", None)] if said else None), (None, [("LOST", "x", None)])], "slug string, dialogue array<struct<character:string,line:string,parenthetical:string>>")
    # Three other movies, from whose casts nicknames, organisations and figures are learned.
    others = [(f"o{i}", None, t) for i, n in enumerate(("Ravno", "Tulsen", "Korvic")) for t in (f"{n} Mining Switchboard", "Man in Gray Coat", "Man in Grey Coat", f"Anna {n}", f"Annie {n}", f"Anna {n}ski")]
    characters = characters.unionByName(spark.createDataFrame([*others, ("o9", None, "Anna Zelk")], characters.schema))
    return {(r.name_a, r.name_b) for r in names.same_character(characters, scenes).where("slug = 'm'").collect()}


def test_names(spark):
    cast = ["Dr. Theodore “Ted” Farnmere", "Joan Farnmere", "Juror #1", "Juror #2", "Woman in Grey Coat", "Caskovic Mining Switchboard", "", None]
    groups = [
        ["Dr. Theodore “Ted” Farnmere", "TED", "FARNMERE, THEODORE", "THEODOREFARNMERE", "T. FARNMERE", "TEODORE (V.O.)", "THEODORE F."], ["Joan Farnmere", "JOAN (CONT'D)", "JOAN FARNMEER", "J FARNMERE"],
        ["Juror #1", "JUROR ONE", "1ST JUROR", "JUROR NO. 1"], ["Juror #2", "JUROR 2"], ["Woman in Grey Coat", "GRAY COAT WOMAN"], ["Caskovic Mining Switchboard", "CMS", "CASKOVIC SWITCHBOARD"],
    ]
    got = pairs_of(spark, cast, [n for g in groups for n in g if n not in cast])
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    assert got == want


def test_ambiguous_names_stay_alone(spark):
    got = pairs_of(spark, ["Silas Elstette", "Kenji Elstette"], ["ELSTETTE", "SILAS ELSTETTE"])
    assert got == {("SILAS ELSTETTE", "Silas Elstette")}


def test_chains_merge_over_rounds(spark):
    said = ["MARA QUINN", "M. QUINN", "QUINN", "MARA", "MARRA QUINN", "QUINN, MARA", "MARAQUINN", "MARA Q."]
    assert len(pairs_of(spark, [], said)) == 28


def test_only_the_union_of_two_spellings_brings_in_a_third(spark):
    # ANNIE is learned to be ANNA; neither ANNA Q. nor A. QUILLBERG alone fits the run-together, misspelt name.
    one, two, third = "ANNA Q.", "A. QUILLBERG", "ANNIEQUILBERG"
    known = names.Known(nicknames=frozenset({"ANNA>ANNIE"}))
    assert names.compare(names.parse(one), names.parse(third), known)[0] == names.compare(names.parse(two), names.parse(third), known)[0] == 0
    assert pairs_of(spark, [], [one, third]) == pairs_of(spark, [], [two, third]) == set()
    assert pairs_of(spark, [], [one, two, third]) == {("A. QUILLBERG", "ANNA Q."), ("A. QUILLBERG", "ANNIEQUILBERG"), ("ANNA Q.", "ANNIEQUILBERG")}


def test_a_fuller_name_needs_initials_that_agree(spark):
    assert pairs_of(spark, [], ["ANNA Z.", "A. QUILLBERG", "ANNIEQUILBERG"]) == set()


@pytest.mark.parametrize("a, b", [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "axc"), ("abc", "xabc")])
def test_within_one(a, b):
    assert names.within_one(a, b) and names.within_one(b, a)
    assert not names.within_one("abcd", "badc")


# --- linkage (problem 1) ---


def test_linkage(spark):
    rng = random.Random(4)
    syllables = "ba be bi do du fra gri kle lo mu no pra ri sko su tre vo wu zi".split()
    nouns = "Bridge Garden Harbor House River Thief Winter Ghost Mirror Clock".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(3)).title()
    films = [(str(1000 + i), f"The {rng.choice(nouns)} of {word()} {word()}", 1950 + i % 60) for i in range(300)]
    films += [("9001", films[0][1], 2010), ("9002", films[1][1] + " 2", films[1][2] + 3)]
    metadata = spark.createDataFrame([(k, t, t, f"{y}-05-01", [("x", "Anna Karel"), ("y", "Boris Tamm"), ("z", "Clara Wendel")] if k == "9001" else None, None) for k, t, y in films] + [(None, "x", "x", "", None, None), ("0", "y", "y", None, None, None)],
                                     "tmdb_id string, title string, original_title string, release_date string, cast array<struct<name:string,character:string>>, fetched_at timestamp").withColumn("filename", F.lit("clash"))
    truth, files = {}, []
    for i, (k, t, y) in enumerate(films[2:160], 2):
        w = t.split()
        w[1] = "Widwo" if False else w[1]
        j = rng.randint(3, len(w) - 1)
        w[j] = w[j][:2] + w[j][3:] if i % 3 == 0 else w[j]
        title = " ".join(w)
        name = title.lower().replace(" ", "-") + (f"-{y}.pdf" if i % 2 else ".pdf")
        files.append((name, "0" if i % 4 else None, title.upper() if i % 5 == 0 else title, name[:-4]))
        truth[name] = k
    files += [("remake-2010.pdf", "", films[0][1], "r"), ("sequel.pdf", "0", films[1][1] + ": Part Two", "s"), ("third.pdf", "0", films[1][1] + " III", "t"), ("unknown.pdf", "0", "The Train of Qaxo Jivub", "u"), ("done.pdf", "1002", films[2][1], "d"), ("blank.pdf", "0", None, None)]
    files.append(files[0])
    truth |= {"remake-2010.pdf": "9001", "sequel.pdf": "9002"}
    manifest = spark.createDataFrame(files, "filename string, tmdb_id string, title string, slug string")
    characters = spark.createDataFrame([("r", n) for n in ("KAREL", "TAMM, BORIS", "CLARA WENDEL")], "slug string, screenplay_name string")
    got = {r.filename: r.tmdb_id for r in linkage.link(manifest, metadata, characters).collect()}
    assert {f: k for f, k in got.items() if truth.get(f) != k} == {}
    assert len(got) >= 0.95 * len(truth) and got["remake-2010.pdf"] == "9001" and got["sequel.pdf"] == "9002"
    assert linkage.link(manifest.limit(0), metadata, characters).count() == 0
    assert linkage.link(manifest, metadata.limit(0), characters.limit(0)).count() == 0


def test_translations_are_learned_and_the_posterior_is_shared(spark):
    places = [f"{a}{b} {c}{d}" for a in ("Sto", "Gri", "Vle") for b in ("ban", "kol") for c in ("Tra", "Mel", "Dru") for d in ("fik", "pos")]
    films = [(str(i), f"The Mirror of {p}", f"Le miroir de {p}" if i % 3 else f"The Mirror of {p}", "1970-01-01", 1.0) for i, p in enumerate(places, 1)]
    twins = [("901", "Kerel Zvoban", "Kerel Zvoban", None, 3.0), ("902", "Kerel Zvoban", "Kerel Zvoban", None, 9.0)]
    schema = "tmdb_id string, title string, original_title string, release_date string, popularity double"
    metadata = spark.createDataFrame(films + twins, schema).selectExpr("*", "cast(null as array<struct<name:string,character:string>>) as cast", "cast(null as timestamp) as fetched_at")
    assert linkage.translations(linkage.records(metadata)) == {"miroir": "miror"}
    resolved = [(f"{i}.pdf", k, t, None) for i, (k, t, *_) in enumerate(films)]
    manifest = spark.createDataFrame(resolved + [("le-miroir-de-x.pdf", "0", f"Le Miroir de {places[2]}", None), ("kerel-zvoban.pdf", None, "Kerel Zvoban", None)], "filename string, tmdb_id string, title string, slug string")
    got = {r.filename: (r.tmdb_id, r.confidence) for r in linkage.link(manifest, metadata, spark.createDataFrame([], "slug string, screenplay_name string")).collect()}
    assert got["le-miroir-de-x.pdf"][0] == "3" and got["kerel-zvoban.pdf"][0] == "902" and got["kerel-zvoban.pdf"][1] < 0.5
    seen = linkage.blocking_recall(manifest, metadata).first()
    assert seen.files == seen.met == len(films)


def test_expectation_maximisation_separates():
    patterns = {(2, 2): 90, (2, 1): 10, (0, 0): 800, (0, 1): 150, (1, 0): 40}
    posterior = linkage.fit(patterns)
    assert posterior[2, 2] > 0.95 and posterior[0, 0] < 0.05 and linkage.fit({}) == {}


def test_profiles_that_still_merge_at_the_bound_are_an_error(spark, monkeypatch):
    held = [(i, n, frozenset(), frozenset(), frozenset()) for i, n in enumerate(("MARGARET HOLLOWAY", "MARGARET HOLOWAY"))]
    assert len({at for _, at in names.Movie(held).profiles()}) == 1
    monkeypatch.setattr(names, "MOST_ROUNDS", 0)
    with pytest.raises(RuntimeError, match="still merge"):
        names.Movie(held).profiles()
    rows = spark.createDataFrame([("m", n, True) for n in ("MARGARET HOLLOWAY", "MARGARET HOLOWAY")], "slug string, name string, cast boolean")
    with pytest.raises(RuntimeError, match="still merge"):
        names.resolve(rows, most=0)


def test_joins_give_the_profiles_that_a_task_gives(spark):
    said = "MARA QUINN,M. QUINN,QUINN,MARA,MARRA QUINN,QUINN| MARA,MARAQUINN,MARA Q.,DR. QUILLBERG,ANNA Q.,A. QUILLBERG,ANNIEQUILBERG,ANNA QUILLBERG (V.O.),JUROR 1,1ST JUROR,JUROR #2,SILAS ELSTETTE,KENJI ELSTETTE,ELSTETTE,S. ELSTETTE"
    rows = [("m", n.replace("|", ","), False) for n in said.split(",")] + [("n", n.replace("|", ","), True) for n in said.split(",")[:9]]
    rows += [(f"o{i}", n, True) for i in range(3) for n in (f"Anna Zelk{'aoe'[i]}", f"Annie Zelk{'aoe'[i]}")] + [("o5", "Anna Trost", True)]
    df = spark.createDataFrame(rows, "slug string, name string, cast boolean")

    def groups(most):
        found = {}
        for r in names.resolve(df, most).collect():
            found.setdefault((r.slug, r.profile), set()).add(r.name)
        return sorted((s, sorted(g)) for (s, _), g in found.items())

    assert groups(0) == groups(1000)


def test_words_far_apart_are_not_measured(monkeypatch):
    import random

    from scenelake.llm import canonical, linkage

    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
    for letters in ("abc", "aeiouvwnmks", "abcdefghijklmnopqrstuvwxyz0145"):
        for a, b in ((word(letters), word(letters)) for _ in range(1500)):
            assert linkage.least_distance(a, b) <= canonical.distance(a, b, 99.0) + 1e-9
    measured = []
    monkeypatch.setattr(linkage, "distance", lambda a, b, most: measured.append((a, b)) or canonical.distance(a, b, most))
    linkage.word_likeness.cache_clear()
    assert [linkage.word_likeness(a, b) for a, b in (("skufrek", "hidlopt"), ("brahuk", "dempins"), ("lantern", "vrobdis"))] == [0.0] * 3
    assert measured == []
    assert linkage.word_likeness("lantern", "lamtern") == 0.85 and measured
    linkage.word_likeness.cache_clear()
