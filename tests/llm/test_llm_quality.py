"""Quality rules: counts against plain versions, the distance against its definition, verdicts on planted texts."""

import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hitloom.llm import quality

SPACES = " \t\n\v\f\r"
ODD = st.text(alphabet="ab \n\t\vé#*|< \U0001f600", max_size=60)


def plain_words(text):
    found, word = [], ""
    for char in text + " ":
        if char in SPACES:
            found += [word] if word else []
            word = ""
        else:
            word += char
    return found


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)})


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_counts(text):
    words = plain_words(text)
    row = quality._judge(text, quality.References(np.zeros((0, 10)), [], np.zeros((0, 33))))
    lines = [line for line in text.split("\n") if plain_words(line)]
    assert row[:5] == (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)), plain_repeats(words),
    )
    assert row[5] == (len(words) < 50 or 100 * row[4] > 50 * len(words)) and row[8] == (not row[5])


def test_distance_by_definition():
    rng = random.Random(2)
    for _ in range(20):
        counts = [rng.choice([0, rng.randrange(50)]) for _ in range(6)] + [1]
        shares = [rng.choice([0.0, rng.random()]) for _ in range(6)] + [0.5]
        shares = [s / sum(shares) for s in shares]
        p = [c / sum(counts) for c in counts]
        sides = [sum(x * math.log2(x / ((a + b) / 2)) for x, a, b in zip(side, p, shares) if x) for side in (p, shares)]
        found = quality.distance(np.array(counts, dtype=float), np.array([shares]))[0]
        assert abs(found - math.sqrt(max(sum(sides) / 2, 0))) < 1e-9
    assert quality.distance(np.array([1.0, 1.0]), np.array([[0.5, 0.5]]))[0] == 0
    assert abs(quality.distance(np.array([1.0, 0.0]), np.array([[0.0, 1.0]]))[0] - 1) < 1e-12


def sentence(rng, n):
    stems = ["lor", "mep", "tan", "siv", "dor", "wen", "pal"]
    common = ["the", "of", "and", "to"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(stems) + rng.choice(stems) + str(rng.choice(["a", "e", "ed"])) for _ in range(n)) + "."


def test_verdicts_and_odd_rows(spark):
    rng = random.Random(4)
    clean = [sentence(rng, rng.randrange(60, 300)) for _ in range(60)]
    junk = [
        " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in sentence(rng, 120).split()),
        sentence(rng, 100).upper().replace(" ", "!! "),
        " ".join(str(rng.randrange(10**9)) for _ in range(200)),
        "abc def ghi jkl " * 50,
    ]
    odd = [None, "", " \n\t ", "word", "\x00 " * 60, clean[0], clean[0], " ".join(clean[:40])]
    rows = [(i, t, "en" if i % 5 else None, "x", False) for i, t in enumerate(clean + junk + odd)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, class_distance string, `c:text` boolean")
    out = quality.judge(df, quality.fit(df))
    assert set(out.columns) >= {"doc_id", "text", "lang", "c:text", "kept", "word_distance"} and len(set(out.columns)) == len(out.columns)
    kept = {r["doc_id"]: r for r in out.collect()}
    assert len(kept) == len(rows)
    assert all(kept[i]["kept"] and kept[i]["text"] == clean[i] for i in range(60))
    assert not any(kept[60 + i]["kept"] for i in range(4)) and [kept[60 + i]["base_failed"] for i in range(4)] == [False] * 3 + [True]
    assert [kept[64 + i]["kept"] for i in range(8)] == [False] * 5 + [True] * 3
    assert kept[64]["n_words"] == kept[65]["n_words"] == 0 and kept[67]["class_distance"] is None


def test_without_references_the_base_rules_decide(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert quality.judge(empty, quality.fit(empty)).count() == 0
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)), None), (2, "###", None)], "doc_id int, text string, lang string")
    references = quality.fit(df)
    assert len(references) == 0
    assert sorted((r["doc_id"], r["kept"]) for r in quality.judge(df, references).collect()) == [(1, True), (2, False)]
