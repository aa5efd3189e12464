"""Encoding, mixing and residue."""

import base64
import os

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import variants
from conftest import DATA
from dockline.llm import bpe, mixing, queries, residue

FOLDER = os.path.dirname(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder()


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def decode(encoder, ids):
    back = {v: k for k, v in encoder.ranks.items()}
    return b"".join(back[i] for i in ids).decode()


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=300))
def test_any_text_goes_round_and_equals_the_library(encoder, public, text):
    ids = encoder.encode(text)
    assert decode(encoder, ids) == text and ids == public(text)


@pytest.mark.parametrize("text", ["<|endoftext|> is text", "a" * 5000, "\n \t  x", "é" * 400, "自行車" * 300, "🚲👨‍👩‍👧", "\x00\x07", "ab" * 64 + "c", "!?" * 3000])
def test_odd_texts(encoder, public, text):
    assert encoder.encode(text) == public(text)


def test_short_and_long_words_take_the_same_merges(encoder):
    rng = np.random.default_rng(1)
    for n in (2, 3, 17, 127, 128, 129, 400):
        word = bytes(rng.choice(list(b"abcdehinorst"), n).astype(np.uint8))
        assert encoder._short(word) == encoder._long(word)


def test_another_vocabulary_is_a_parameter(spark):
    path = f"{FOLDER}/byte_bpe_multi_50k.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tiktoken = pytest.importorskip("tiktoken")
    t = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "Größere Gruppen müssen früh da sein"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(bpe.token_ids(F.col("t"), path)).first()[0] == t.encode_ordinary(text)


def test_ids_of_all_documents(spark, tiny, public):
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, tiny).collect()}
    docs = ds.dataset(f"{tiny}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    assert got == {d["doc_id"]: public(d["text"]) if d["text"] else [] for d in docs}


@settings(max_examples=60, deadline=None)
@given(p=st.lists(st.floats(0, 1), min_size=1, max_size=60), seed=st.integers(0, 99))
def test_pivot_keeps_the_expected_size(p, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 500, len(p)).astype(float)
    p = np.array(p)
    out, left = mixing._pivot(p, sizes, rng)
    assert np.isclose((out * sizes).sum(), (p * sizes).sum())
    assert all(v in (0, 1) for i, v in enumerate(out) if i != left)


def test_pivot_is_unbiased():
    p, sizes = np.array([0.3, 0.6, 0.5, 0.1]), np.array([5.0, 3.0, 2.0, 9.0])
    runs = np.mean([mixing._pivot(p, sizes, np.random.default_rng(i))[0] for i in range(6000)], axis=0)
    assert np.allclose(runs, p, atol=0.03)


def _sizes(spark, per):
    rng = np.random.default_rng(0)
    rows = [(i, s, int(n)) for s, k in per.items() for i, n in zip(range(sum(per.values())), rng.lognormal(4, 1.2, k) + 1)]
    return spark.createDataFrame(pd.DataFrame([(j, s, n) for j, (_, s, n) in enumerate(rows)], columns=["key", "source", "size"]))


def test_shares_limits_and_missing_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 50)
    monkeypatch.setattr(mixing, "FAN", 3)
    sizes = _sizes(spark, {"a": 1500, "b": 300, "c": 40, "unasked": 50}).unionByName(spark.createDataFrame([(9001, None, 5), (9002, "a", 0)], "key long, source string, size long"))
    targets = spark.createDataFrame([("a", 50.0, 1), ("b", 30.0, 3), ("c", 20.0, 4), ("none", 10.0, 1), ("zero", 0.0, 2), ("odd", None, None)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(sizes, targets)
    rows = {r.source: r for r in mixing.reached(mixed, targets).collect()}
    for s, want in (("a", 50), ("b", 30), ("c", 20)):
        assert rows[s].actual_share == pytest.approx(want, abs=0.6)
        assert rows[s].most_repeats <= rows[s].max_repeats
    assert rows["none"].tokens == rows["zero"].tokens == rows["odd"].tokens == 0
    keys = [r.key for r in mixed.collect()]
    assert len(keys) == len(set(keys)) and not {9001, 9002} & set(keys)
    assert {tuple(r) for r in mixing.mixture(sizes, targets).collect()} == {tuple(r) for r in mixed.collect()}, "same seed, same mixture"


def test_empty_mixture(spark):
    sizes = spark.createDataFrame([], "key long, source string, size long")
    targets = spark.createDataFrame([("a", 50.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixture(sizes, targets).count() == 0
    assert mixing.reached(mixing.mixture(sizes, targets), targets).first().tokens == 0


REAL = "The night ferry was repainted last spring and the gardeners brought a map. Mix 8 grams of flour with warm water and wait 15 minutes."
CASES = {
    "Welcome back, {{ first_name }}!\n" + REAL: True, "Call us at null today.\n" + REAL: True, "Posted on [ENTER DATE] in _YOUR TOWN_\n" + REAL: True, "Hello #N/A, your order is on its way. " + REAL: True,
    "Price from N/A-VALUE per day\n" + REAL: True, "Dear %%city%%, thank you.": True, "Willkommen in &company;": True, "Hello ${value}, your order {{ template }} is on its way. " + REAL: True,
    "Page not found\nTry again later.\nImprint - Privacy - Terms": True, "Home | Shop | Contact\n403 - Forbidden\nYou don't have permission to view this resource.": True,
    "Please enable JavaScript Change your browser settings and load the page again.": True, "Bitte aktivieren Sie JavaScript": True, "PÃ¡gina no encontrada\nIntÃ©ntelo mÃ¡s tarde.": True,
    "A day in Tamville\nLorem ipsum dolor sit amet velit ligula morbi.": True, "foo qwer hjkl hjkl asdf zzz bar xxx": True, "Opening hours\nSample headline Sample headline\nYour text goes here.": True,
    REAL: False, REAL + "\nSome features of this page need JavaScript.": False, REAL + "\nComments are closed. Error while loading related items.": False, "Home | Shop | Contact": False,
    "In the template language we teach, writing {{ title }} prints the value and {% if lang %} tests it. " + REAL: False, "The word undefined is used in mathematics for 1/0. " + REAL: False,
    'Our guide explains what the message "Please enable JavaScript" means and when you can ignore it.': False, "The museum's new show about error 404 asks why a page not found feels like a small loss.": False,
    REAL + " <|endoftext|> [CLS] !!!???...,,,;;;---___": False, "": False, "  \n ": False, "Caf&eacute; au lait &amp; more in Tamville was good today.": False,
}


def test_residue_cases(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "doc_id long, text string")
    got = {r.doc_id for r in residue.residue(df, "doc_id", "text").collect()}
    assert {t for i, t in enumerate(CASES) if i in got} == {t for t, bad in CASES.items() if bad}
    assert residue.without_residue(df, "doc_id", "text").count() == len(CASES) + 1 - sum(CASES.values())


def _found(spark, rows):
    return {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}


def test_a_name_of_a_missing_value_that_never_changes_is_wording(spark):
    rows = [(i, f"Each label reads size None of them here {i}.") for i in range(20)] + [(100 + i, f"Our guide sends greetings to {v} from the coast.") for i, v in enumerate(["null", "{{ name }}", "None"])]
    assert _found(spark, rows) == {100, 101, 102}


def test_unfilled_copies_are_found_however_many(spark):
    rows, want, n = [], set(), 0
    for t, k in enumerate((1, 7, 8, 20, 2000)):
        letter = f"your parcel number {'abcde'[t] * 3} has left the yard."
        for i in range(40):
            rows.append((n := n + 1, f"Dear {['Anna', 'Tom Lee', 'Eve', 'Old Jo'][i % 4]}, {letter}\n{REAL} {i}"))
        for i in range(k):
            rows.append((n := n + 1, f"Dear {{{{first_name}}}}, {letter}\n{REAL}"))
            want.add(n)
    assert _found(spark, rows) == want


@pytest.mark.parametrize("value", ["[First Name]", "<your name>", "%NAME%", "{0}", "______", "FIRSTNAME", "first_name", "", "null"])
def test_filled_records_show_what_is_left_unfilled(spark, value):
    rows = [(i, f"Dear {n}, your parcel has left.\n{REAL} {i}") for i, n in enumerate(["Anna", "Tom Lee", "Eve", "Kim", "Lea"] * 8)]
    rows += [(100 + i, f"Dear {value}, your parcel has left.\n{REAL} {i}") for i in range(10)]
    assert _found(spark, rows) == set(range(100, 110))


def test_defaults_named_like_the_variable(spark):
    rows = [(i, f"Dear {n}, your parcel has left.\n{REAL} {i}") for i, n in enumerate(["Anna", "Tom Lee", "Eve", "Kim"] * 5)]
    rows += [(100, "Dear {{first_name}}, your parcel has left.\n" + REAL), (101, "Dear First Name, your parcel has left.\n" + REAL)]
    assert _found(spark, rows) == {100, 101}


def test_marks_gaps_and_names_without_a_slot_say_nothing(spark):
    rows = [(i, t + "\n" + REAL) for i, t in enumerate(["Dear [First Name], your parcel has left.", "Dear , the red parcel has left.", "Dear FIRSTNAME, that parcel has left.", "Dear [CLS], old parcels have left.", "History [edit] of the town <b>and</b> its bridges %a% {1}."])]
    rows += [(10 + i, f"The dog , which {v} home , was old .") for i, v in enumerate(["came", "ran", "went", "saw"])]
    assert _found(spark, rows) == set()


def test_syntax_and_mirrors_are_no_wording(spark):
    rows = [(i, f"Our price is {{{{price}}}} EUR in shop {i}. " + REAL) for i in range(30)] + [(100 + i, "Call us at null today.\n" + REAL) for i in range(12)]
    rows += [(200, "Price: null EUR\n" * 9 + REAL)]
    assert _found(spark, rows) == {i for i, _ in rows}


def test_filler_and_mash_of_any_making():
    page = lambda t: (lambda o: (o["kinds"][0], o["content"][0]))(residue.PageScanner().pages([t]))
    usual = ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation "
             "ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. "
             "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.")
    for text, kind in ((usual + " " + usual, "filler"), ("heading text heading text heading text.", "filler"), ("Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia.", "filler"), ("sdfgsdfg lkjlkj oiuy.", "mash"), ("asdfgh jkl; zxcvbnm", "mash"), ("Zzzzz mmmmmm.", "mash")):
        kinds, content = page(text)
        assert kind in kinds and content == 0, text
    for text in (REAL, "We were quite pretty, true power of property.", "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae.", "Привет, это обычная страница о городе. Здесь живут люди и кошки."):
        assert page(text)[0] == [] and page(text)[1], text


def test_explaining_words_give_way_to_labels_and_slots(spark):
    rows = [(0, "Order value: {{amount}}\n" + REAL), (1, "Der Wert Ihrer Bestellung: {{ total }}\n" + REAL), (2, "Your template value is undefined. " + REAL)]
    rows += [(10, "Your template value is high. " + REAL), (11, "Your template value is 7. " + REAL), (12, "Writing {{ title }} prints the value: it is long. " + REAL)]
    assert _found(spark, rows) == {0, 1, 2}


def test_long_prompts(spark):
    rows = [(0, "[INSERT A SHORT DESCRIPTION OF YOUR COMPANY AND OF ITS HISTORY SINCE THE FOUNDING]\n" + REAL), (1, "See [insert coin here] on the wall of the arcade. " + REAL)]
    assert _found(spark, rows) == {0}


def test_a_prompt_is_bounded_by_its_bracket_in_linear_time():
    page = residue.PageScanner().pages
    assert page(["(INSERT NAME " * 20_000])["slots"] == [[]] and page(["[" * 100_000])["slots"] == [[]]


UNSEEN = [
    "Sorry, we couldn't find that page. It looks like nothing was found at this location. Maybe one of the links below or a search?",
    "502 Proxy Error\nThe proxy server received an invalid response from an upstream server.", "You have JavaScript turned off. Please turn it on to view this site.",
    "Pagina non trovata\nLa pagina che stai cercando non esiste.", "Erro 404\nA página que procura não existe.",
]


def test_unseen_error_pages(spark):
    rows = [(i, t) for i, t in enumerate(UNSEEN * 50)] + [(1000 + i, f"{REAL} The {w} lamp was lit at dusk.") for i, w in enumerate("red old new big tin".split() * 9)]
    assert _found(spark, rows) == set(range(250))


def test_one_text_under_many_addresses_is_a_template_but_mirrors_are_not(spark):
    page, article = "Nichts da heute, die Lampe bleibt aus.", "The heron stood by the old weir all morning long."
    rows = [(i, f"https://a{i % 3}.test/x/{i}?q=1", page) for i in range(30)] + [(100 + i, f"https://m{i}.test/heron", article) for i in range(30)]
    got = residue.judged(spark.createDataFrame(rows, "doc_id long, url string, text string"), "doc_id", "text", "url").collect()
    assert {(r.key, r.how) for r in got} == {(i, "addresses") for i in range(30)}


def test_sentences_seen_only_beside_cues_belong_to_the_page(spark):
    words = "amber birch cedar dove elm fern gull heron iris jay".split()
    rows = [(i, f"Page not found\nThe lamp keeper has put this leaf away for good.\nRef {w}") for i, w in enumerate(words)]
    rows += [(100 + i, f"{REAL}\nThe {w} bench was painted green by the school.") for i, w in enumerate(words)]
    assert _found(spark, rows) == set(range(10))


def test_content_without_full_stops(spark):
    table = "\n".join(f"{n} bridge built {1900 + i} length {i * 3} m" for i, n in enumerate(["North", "South", "East", "West", "Mill", "Town", "Lake", "Harbour", "Castle", "Forest", "Market", "Abbey"]))
    japanese = "この町には古い橋があり、多くの人が毎日それを渡って市場へ行きます。\n川のそばには小さな図書館もあります。"
    assert _found(spark, [(1, table + "\nPlease enable JavaScript"), (2, japanese + "\nPlease enable JavaScript"), (3, "Please enable JavaScript")]) == {3}


def test_more_hashes_than_one_reading_looks_for(spark, monkeypatch):
    rows = [(i, f"Dear {n}, the {w} parcel has left.") for w in ("red", "blue", "green") for i, n in enumerate(["Anna", "Tom", "Eve"], 10 * len(w))]
    rows += [(100 + i, f"Dear [First Name], the {w} parcel has left.") for i, w in enumerate(("red", "blue", "green"))]
    want = _found(spark, rows)
    monkeypatch.setattr(residue, "_LOOKED", 1)
    assert _found(spark, rows) == want == {100, 101, 102}


def test_page_templates_are_the_same_in_any_number_of_readings(spark, monkeypatch):
    words = "amber birch cedar dove elm fern gull heron iris jay".split()
    page = "The lamp keeper has put this leaf away for good.\nSome day the old barge may bring it home again.\nUntil then the harbour wishes you a calm evening."
    rows = [(i, f"Page not found\n{page}\nRef {words[i // 10]} {words[i % 10]}") for i in range(60)] + [(70, page), (71, page), (72, page + "\n" + page)]
    # beside one sentence of their own, or a long listing, the same sentences are no page of the template
    rows += [(80, f"{page}\nThe heron stood by the weir all morning."), (81, page + "\n" + "\n".join(f"{w} bridge {i} metres" for i, w in enumerate(words * 2)))]
    rows += [(100 + i, f"{REAL}\nThe {w} bench was painted green by the school.") for i, w in enumerate(words)]
    want = {*range(60), 70, 71, 72}
    assert _found(spark, rows) == want
    # few bits, which different hashes share, give the same as well
    for name, value in (("_BITS", 64), ("_LOOKED", 1)):
        monkeypatch.setattr(residue, name, value)
        assert _found(spark, rows) == want, name


def test_pieces_of_a_long_page_are_one_page(monkeypatch):
    text = (REAL + "\n") * 50 + "Dear {{name}}, welcome.\nPage not found\n"
    whole = residue.PageScanner().pages([text, "x", text])
    monkeypatch.setattr(residue, "_PIECE", 100)
    cut = residue.PageScanner().pages([text, "x", text])
    for c in ("kinds", "content", "suspect", "words", "templates", "slots"):
        assert list(whole[c]) == list(cut[c]), c


@pytest.mark.parametrize("change", [variants.with_null_rows, variants.with_clashes])
def test_odd_tables(spark, tiny, tmp_path, change):
    d = variants.write(tiny, str(tmp_path), change)
    for name in ("p8_ids", "p10_found", "p9_mixture"):
        q = queries.QUERIES[name]
        rows = lambda x: {str(r) for r in q(spark, x).where("doc_id is not null").collect()}
        assert rows(d) == rows(tiny), name


def test_empty_tables(spark, tiny, tmp_path):
    d = variants.write(tiny, str(tmp_path), variants.empty)
    for q in queries.QUERIES.values():
        q(spark, d).collect()


def test_repeated_documents_are_judged_alike(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    got = {r.doc_id for r in residue.residue(twice, "doc_id", "text").collect()}
    assert {i + 1_000_000 for i in got if i < 1_000_000} == {i for i in got if i >= 1_000_000}


def test_very_long_text(spark):
    text = REAL * 8000 + " Welcome back, ${user.name}!"
    df = spark.createDataFrame([(1, text), (2, REAL * 8000)], "doc_id long, text string")
    assert [r.doc_id for r in residue.residue(df, "doc_id", "text").collect()] == [1]
