"""Encoding, scans, tokenizer ids, leaks, spam: small fixtures, brute force, exact round trips."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenelake.llm import encoding, leakage, lexicon, scans, stuffing

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public vocabulary")


# --- encoding (problem 4) ---

CLEAN = [
    "Garçon! Deux bières et un café, s’il vous plaît.", "Grüße aus Köln. Schöne Brücke.", "Где ключ от старого дома, Anna?", "Dzień dobry. Gdzie jest żółta łódź?",
    "“Leave it,” she says — “it isn’t yours.”", "Příliš pozdě. Klíč leží u řeky.", "It’s 5° below 0°C…", "PÂTÉ, PÊCHES, CRÈME", "NÃO! São João", "Fiancée or not", "£five a week",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert encoding.repair(text) == (text, "")


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("page", ["cp1252", "cp437", "mac_roman", "latin-1"])
def test_utf8_read_as_a_code_page_comes_back(text, page):
    raw = text.encode("utf-8")
    garbled = "".join(bytes([b]).decode(page) if page != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    assert encoding.repair(garbled) == (text, "utf-8")


def test_double_and_partial_damage_comes_back():
    twice = "café, déjà".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(twice)[0] == "café, déjà"
    assert encoding.repair("Grüße aus KÃ¶ln")[0] == "Grüße aus Köln"


def test_single_byte_code_pages_and_losses():
    assert encoding.repair("Никто не видел, как ушёл ночью.".encode("cp1251").decode("cp1252"))[0] == "Никто не видел, как ушёл ночью."
    assert encoding.repair("The café: crème brûlée".encode("cp1252").decode("cp1251"))[0] == "The café: crème brûlée"
    assert encoding.repair("Gar�on!")[1] == "lost"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=12))
def test_automaton_agrees_with_the_decoder(codes):
    for b, e in encoding.well_formed(codes):
        assert len(bytes(codes[b:e]).decode("utf-8")) >= 1 and all(c >= 128 for c in codes[b:e])


def test_garbled_table(spark):
    d = "array<struct<character:string,line:string,parenthetical:string>>"
    rows = [("s1", ["ok", "cafÃ©", None, ""], [("A", "isnâ€™t", None)]), ("s1", ["ok", "cafÃ©", None, ""], [("A", "isnâ€™t", None)]), (None, ["cafÃ©"], None), ("s2", None, None), ("s3", ["Ma�ana"], None)] + [(f"c{i}", ["Mañana"], None) for i in range(4)]
    df = spark.createDataFrame(rows, f"scene_id string, action_lines array<string>, dialogue {d}").withColumn("value", F.lit("clash"))
    got = sorted((r.scene_id, r.field_name, r.pos, r.restored) for r in encoding.garbled(df).collect())
    assert got == [("s1", "action_lines", 1, "café"), ("s1", "dialogue", 0, "isn’t"), ("s3", "action_lines", 0, "Ma�ana")]
    assert {r.scene_id: r.restored for r in encoding.restored(df).collect()}["s3"] == "Mañana"
    assert encoding.garbled(df.limit(0)).count() == 0


# --- scans (problem 2) ---


@pytest.mark.parametrize("line", ["- 13 -", "18.", "[24]", "Page 28 of 89", "(CONTINUED)", "CONTINUED:", "10  CONTINUED: (4)", "C0NTINUED:"])
def test_page_marks(line):
    assert scans.page_mark(line)


@pytest.mark.parametrize("line", ["Room 12. Then Room 14.", "SUPER: 1987.", "A C-130 passes.", "Beat.", "He continued.", "number 4B", "CLOSE ON: the ledger, page 41."])
def test_what_is_no_page_mark(line):
    assert not scans.page_mark(line)


def test_noisy_fields_and_repair(spark):
    clean = ["The lantern hangs in the harbor.", "She walks toward the switchboard-room.", "The door of the boardroom swings open.", "A C-130 passes number 4B."]
    rows = [(f"m_{i}", "m", "INT. HARBOR - NIGHT", clean) for i in range(60)]
    rows += [(f"n_{i}", "other_film", "EXT. HARBOR - DAY", ["OTHER FLIM RUNNING TITEL   " + str(i), "The lantern hangs."]) for i in range(4)]
    rows += [("x1", "x", "INT. HARB0R - NIGHT", ["The lan-", "- 7 -", "tern hangs in the harbor."]), ("x2", "x", "INT. HARBOR - NIGHT   9.", ["The boardroorn opens."]), ("x3", "x", None, None), ("x4", "x", "", ["", None]), (None, "x", "1", ["- 3 -"])]
    rows.append(rows[-5])
    df = spark.createDataFrame(rows, "scene_id string, slug string, heading string, action_lines array<string>").withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in scans.noisy_fields(df).collect())
    assert got == [(f"n_{i}", "action_lines") for i in range(4)] + [("x1", "action_lines"), ("x1", "heading"), ("x2", "action_lines"), ("x2", "heading")]
    fixed = {r.scene_id: r for r in scans.repaired_scenes(df).collect()}
    assert fixed["x1"].heading == "INT. HARBOR - NIGHT" and fixed["x1"].paragraphs == ["The lantern hangs in the harbor."]
    assert fixed["x2"].heading == "INT. HARBOR - NIGHT" and fixed["x2"].paragraphs == ["The boardroom opens."]
    assert fixed["n_1"].paragraphs == ["The lantern hangs."] and fixed["m_1"].paragraphs == clean
    assert fixed["x3"].heading is None and fixed["x4"].paragraphs == []


def test_headers_count_scenes_with_other_noise(spark):
    rows = [(f"h_{i}", "other_film", "EXT. HARBOR - DAY", [*(["- 7 -"] if i > 1 else []), "QUIET GARDEN OF STONES, THE", "The lantern hangs."]) for i in range(4)]
    rows += [("h_4", "other_film", "EXT. HARBOR - DAY", ["The lantern hangs."])]
    df = spark.createDataFrame(rows, "scene_id string, slug string, heading string, action_lines array<string>")
    assert sorted(tuple(r) for r in scans.noisy_fields(df).collect()) == [(f"h_{i}", "action_lines") for i in range(4)]
    assert all(r.paragraphs == ["The lantern hangs."] for r in scans.repaired_scenes(df).collect())


def test_numbers_that_do_not_rise_are_no_page_numbers(spark):
    schema = "scene_id string, slug string, scene_number int, heading string, action_lines array<string>"
    rows = [(f"a_{i}", "a", i, "INT. HARBOR - DAY", ["The lantern hangs.", str(10 + i)]) for i in range(5)] + [(f"b_{i}", "b", i, "INT. HARBOR - DAY", ["The lantern hangs.", str(n)]) for i, n in enumerate((9, 2, 7, 1, 4))]
    assert sorted(r.scene_id for r in scans.noisy_fields(spark.createDataFrame(rows, schema)).collect()) == [f"a_{i}" for i in range(5)]


def test_a_header_is_found_by_edit_distance():
    assert scans.same_header("quietgardenofstones", "qulotgardenofstanes") and scans.same_header("quietgard", "quietgardenofstones") and not scans.same_header("closeontheledger", "quietgardenofstones")


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_noise_is_what_the_repair_changes(spark):
    rows = spark.read.parquet(f"{SF}/scenes.parquet")
    before = {r.scene_id: r for r in rows.collect()}
    flat = lambda xs: " ".join(" ".join(x for x in xs if x).split())
    differ = set()
    for r in scans.repaired_scenes(rows).collect():
        if flat([r.heading]) != flat([before[r.scene_id].heading]):
            differ.add((r.scene_id, "heading"))
        if flat(r.paragraphs) != flat(before[r.scene_id].action_lines or []):
            differ.add((r.scene_id, "action_lines"))
    assert differ and differ == {tuple(r) for r in scans.noisy_fields(rows).collect()}


def test_a_vocabulary_over_its_bound_is_an_error(spark):
    df = spark.createDataFrame([(f"v_{i}", "v", "INT. HARBOR", ["lantern opens"]) for i in range(5)], "scene_id string, slug string, heading string, action_lines array<string>")
    assert scans.vocabulary(df, most=4) == {"int": 5, "harbor": 5, "lantern": 5, "opens": 5}
    with pytest.raises(ValueError, match="more than 3 words"):
        scans.vocabulary(df, most=3)


def test_hyphens_stay_where_the_corpus_has_them():
    words = scans.Vocabulary({"switchboard-room": 50, "lantern": 80})
    assert words.join("the switchboard", "room") == "the switchboard-room" and words.join("the lan", "tern") == "the lantern"


# --- tokenizer ids (problem 7) ---

TEXTS = ["", "a", "Hello world, don't  stop.\n\nNow", " lead and trail ", "½ ² Ⅷ", "a\x1cb", "日本語テキスト 🙂", "<|endoftext|>", "x" * 3000, "tab\tand nbsp", "line\n next", "İı ßẞ ﬁ", "https://a.b/c?d=1&e=2"]


@needs_vocabulary
def test_ids_equal_the_library(spark):
    import tiktoken

    ranks = lexicon.load_ranks(VOCABULARY)
    plain = tiktoken.Encoding("own", pat_str=lexicon.PIECES.pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(1000, None), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("key", F.lit(0))
    for words in (5, 1000):
        got = {r.doc_id: r.ids for r in lexicon.encode_corpus(df, lexicon_words=words).collect()}
        for k, t in rows:
            assert got[k] == plain.encode_ordinary(t or ""), t
    assert lexicon.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=40))
def test_transducer_is_exact_and_minimal(entries):
    t = lexicon.Transducer.build(entries)
    words = sorted(entries) + [b"", b"\xff\xfe\xfd\xfc\xfb\xfa\xf9"]
    found = t.find(words).tolist()
    assert [n >= 0 for n in found[:-2]] == [True] * len(entries) and found[-2:] == [-1, -1]
    assert all(t.output(n) == entries[w] for n, w in zip(found, words) if n >= 0)
    right = {b: {w[len(b):] for w in entries if w.startswith(b)} for b in {w[:i] for w in entries for i in range(len(w) + 1)}}
    assert t.states == max(1, len({frozenset(v) for v in right.values()}))


@needs_vocabulary
def test_long_pieces_merge_alike():
    ranks = lexicon.load_ranks(VOCABULARY)
    word = ("abcde" * 60).encode()
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            break
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert lexicon.merge(word, ranks) == [ranks[p] for p in parts]


# --- leaks (problem 8) ---


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(120))) for i in range(30)]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    words = items[3][1].split()
    quote = words[20:60]
    altered = [w if i % 13 else "changed" for i, w in enumerate(quote)]
    docs = [
        (1, noise(50) + "\n> " + ",  ".join(quote).upper() + "! " + noise(50)), (2, noise(30) + " " + " ".join(altered) + " " + noise(40)), (3, noise(300)), (4, " ".join(words[20:38]) + " " + noise(100)),
        (5, None), (6, ""), (7, items[7][1] + " " + items[8][1]), (1, noise(5) + " " + " ".join(quote)), (8, " ".join(w if i % 4 else "other" for i, w in enumerate(words[:80]))), (9, " ".join(words[90:115])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(0)).withColumn("passage", F.lit(""))
    held = spark.createDataFrame([*items, (99, "too short"), (98, None), items[0]], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, held).collect()}
    assert got == {(1, 3), (2, 3), (7, 7), (7, 8), (9, 3)}
    assert leakage.leaks(df.limit(0), held).count() == 0 and leakage.leaks(df, held.limit(0)).count() == 0


def test_pruning_loses_nothing():
    """Every qualifying quote reaches the threshold, held against scoring without any pruning."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    index = leakage.Index(items)
    docs = [[rng.choice(words) for _ in range(rng.randint(0, 90))] for _ in range(60)]
    for d in docs[:30]:
        item = rng.choice(items)[1].split()
        at = rng.randint(0, len(item) - 30)
        d[10:10] = item[at : at + 30]
    ids = [index.ids(" ".join(d)) for d in docs]
    found = index.candidates(ids)
    want = {(n, i) for n, d in enumerate(ids) for i in range(len(items)) if leakage.longest_quote(d, index.passages[i].tolist())}
    assert want and want <= set(found)
    # Block-max WAND against adding up every posting.
    for d in ids:
        terms = {}
        for key in leakage._grams(np.array(d, np.int64))[0]:
            t = int(np.searchsorted(index.keys, key))
            if t < len(index.keys) and index.keys[t] == key:
                terms[t] = terms.get(t, 0) + 1
        total = {}
        for t, n in terms.items():
            for k in range(index.post_at[t], index.post_at[t + 1]):
                total[index.post_item[k]] = total.get(index.post_item[k], 0.0) + n * index.post_score[k]
        assert sorted(index.wand(terms)) == sorted(i for i, x in total.items() if x >= index.threshold)


def test_single_equal_words_and_early_alterations_count():
    passage = list(range(100, 160))
    doc = passage[:40]
    doc[3] = doc[5] = 7  # a single equal word between two altered ones, early in the quote
    assert leakage.longest_quote(doc, passage) == 40
    doc = passage[:30]
    doc[2] = 7
    assert leakage.longest_quote(doc[:26], passage) == 26
    assert leakage.longest_quote([w if k % 4 else 7 for k, w in enumerate(passage)], passage) == 0


def test_question_and_answer_overlap(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    held = spark.createDataFrame([(1, passage, "who hid the lamp", ["the red lamp", None]), (2, passage + " x", None, None)], "item_id long, passage string, query_text string, ground_truth array<string>")
    docs = spark.createDataFrame([(5, passage + " and the lamp who")], "doc_id long, text string")
    got = {r.item_id: (r.words, round(r.question, 2), round(r.answer, 2)) for r in leakage.leaks(docs, held).collect()}
    assert got == {1: (40, 0.75, 0.67), 2: (40, 0.0, 0.0)}


# --- spam (problem 9) ---


def test_spam(spark):
    rng = random.Random(2)
    nouns = "lantern harbor widow mirror letter garden river winter".split()
    little = "the of a to in and it is was for on with that at by from as he she her not but who all an or so".split()
    names = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)] + nouns

    def prose(n):
        sentence = lambda: " ".join(rng.choice(little if rng.random() < 0.45 else names) for _ in range(rng.randint(5, 16))).capitalize()
        return " ".join(sentence() + rng.choice([".", ".", "?", "!"]) for _ in range(n))

    docs = [(i, prose(12), rng.choice(["en", "EN", None])) for i in range(40)]
    docs += [
        (100, " ".join(rng.choice(["rope", "lamp", "oar"]) for _ in range(300)), "en"), (101, "\n".join(f"- [rope {i}](http://a{i}.example/tag/x{i}.html)" for i in range(40)), "fr"),
        (102, "\n".join(f"Velvet rope {i} DVD SKU{i * 77} {i}.99 NEW" for i in range(40)), "de"), (103, prose(6) + "\nhttp://a.example/b", "en"),
        (104, "Filmography\n" + "\n".join(f"{1950 + i} - The {rng.choice(names)} of {rng.choice(names)}" for i in range(20)), "en"), (105, None, "en"), (106, "", None), (107, "  ", "en"), (100, "rope " * 300, "en"),
        (108, "lamp " * 20000, "es"), (109, prose(400), "en"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("key", F.lit(0))
    assert sorted(r.doc_id for r in stuffing.spam(df).collect()) == [100, 101, 102, 108]
    assert stuffing.spam(df.limit(0)).count() == 0
