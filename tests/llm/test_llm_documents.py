import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import fingerprints, langid, lm, mixing, packing
from hitloom.llm.queries import tokenizer_path

from test_llm_text_urls_warc import words_of

SCHEMA = "doc_id long, text string, source string, size int, taken int, _row int, start int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1, 1, 1) for i, t, s in rows], SCHEMA)


def sample_rows(n=120):
    rng = np.random.default_rng(5)
    rows = [
        (i, " ".join(f"w{x}" for x in rng.integers(0, 300, rng.integers(0, 200))), ["b", "a", None, "c", "d"][min(int(rng.exponential(1.2)), 4)])
        for i in range(n)
    ]
    return [*rows, (n, None, "a"), (n + 1, "", "e"), (n + 2, "x " * 40_000, "b"), (3, rows[3][1], rows[3][2]), (None, "lost words", "a")]


# Packing


@pytest.mark.parametrize("rows", [sample_rows(), [], [(1, None, "a")], [(1, "<|endoftext|> a\u00a0b \U0001f600", "a")] * 3])
def test_packing_is_whole_and_gapless(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(table(spark, rows), tokenizer_path()).collect()
    by_sequence, ids_of = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        ids_of.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for members in by_sequence.values():
        members.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in members])
        assert [p["offset"] for p in members] == [0, *ends[:-1]]
        assert ends[-1] == 1024 or ends[-1] & (ends[-1] - 1) == 0 and ends[-1] < 1024
    wanted, got = [], []
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        wanted += [(doc_id, i, token) for i, token in enumerate(ids)]
    for p in pieces:
        got += [(p["doc_id"], p["start"] + i, token) for i, token in enumerate(np.frombuffer(p["ids"], "<u4").tolist())]
    assert sorted(wanted, key=repr) == sorted(got, key=repr)


@pytest.mark.parametrize("seed", range(5))
def test_the_fullest_window_by_brute_force(seed):
    from itertools import product

    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 5)}
    best = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(k * x for k, x in zip(counts, c))) <= 57)
    chosen = packing.fullest(counts, 57)
    assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


def test_equal_remainders_are_cut_to_fill(spark):
    packer = packing.Packer(0, 1024)
    for i in range(5000):
        packer.add((i, 600), np.full(600, i, dtype="<u4"))
    packer.pack(0)
    lengths = {}
    for _, _, ids, sequence, _ in packer.rows:
        lengths[sequence] = lengths.get(sequence, 0) + len(ids)
    assert sum(lengths.values()) == 3_000_000
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths.values()) == 0


# Mixing


def targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words_of(text))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, set(names)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(fixed.values())
        shares = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if shares[s] > 2 * sizes[s]]
        if not over:
            return sizes, {**fixed, **shares}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left.discard(s)


@pytest.mark.parametrize("rows", [sample_rows(), [(1, None, None)], [(1, "a b", "x"), (2, "", "y")]])
def test_mixing_meets_its_targets(spark, tmp_path, rows):
    def once(name):
        return mixing.mix(spark, table(spark, rows), str(tmp_path / name), ["doc_id", "source"], block_words=64, shard_blocks=16)

    got = once("a").collect()
    sizes, wanted = targets(rows)
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted(
        (i, len(words_of(t))) for i, t, _ in rows if i is not None
    )
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(d["taken"] for d in r["draws"])
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in taken)
    again = once("b").collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(sorted((d["pass"], d["shard"]) for d in r["draws"])))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_an_empty_table(spark, tmp_path):
    assert mixing.mix(spark, table(spark, []), str(tmp_path / "m"), ["doc_id"]).count() == 0


def test_the_tree_keeps_quotas_and_shards_are_disjoint(spark):
    quotas = [100, 0, 7, 33, 900]
    sources = spark.createDataFrame([(i, q * 10) for i, q in enumerate(quotas)], "rank int, quota long")
    rows = mixing.shard_blocks_of(sources, 10, 64, 3).collect()
    assert {r["shard"] for r in rows} == set(range(17))
    for i, quota in enumerate(quotas):
        taken = sorted(b for r in rows if r["rank"] == i for b in range(r["first_block"], r["first_block"] + r["blocks"]))
        assert taken == list(range(quota))
    sizes = {s: sum(r["blocks"] for r in rows if r["shard"] == s) for s in range(17)}
    assert set(sizes.values()) <= {61, 62}


def test_draws_are_hypergeometric():
    quotas = np.array([30, 60, 10])
    drawn = np.array([mixing.split(0, 2, quotas, lambda s: 25 * s, seed) for seed in range(3000)])
    assert (drawn.sum(axis=1) == 25).all()
    assert np.abs(drawn.mean(axis=0) - [7.5, 15, 2.5]).max() < 0.15
    assert drawn[:, 1].var() == pytest.approx(25 * 0.6 * 0.4 * 75 / 99, rel=0.1)


def test_drawn_documents_keep_first_words(spark, tmp_path):
    docs = table(spark, [(1, " one\ttwo\nthree  four ", "a"), (2, "five", "b")])
    mixed = mixing.mix(spark, docs, str(tmp_path / "d"), ["doc_id", "text"])
    got = mixing.drawn_documents(mixed, "text", ["doc_id", "text"]).collect()
    assert sum(len(words_of(r["text"])) for r in got) == sum(r["taken"] for r in mixed.collect())
    assert all(" one\ttwo\nthree  four ".startswith(r["text"]) or r["text"] == "five" for r in got)


# Language


def language_rows():
    rng = np.random.default_rng(3)
    syllables = {"x": "ka zo mi tu", "y": "sch ei ung ber", "z": "ção ões ñar ll"}
    rows = []
    for i in range(300):
        lang = "xyz"[i % 3]
        parts = syllables[lang].split()
        rows.append((i, " ".join("".join(rng.choice(parts, 3)) for _ in range(rng.integers(3, 60))), lang))
    return rows


def test_copies_take_one_place_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCUMENTS_PER_LANGUAGE", 20)
    rows = [("x", f"text {chr(97 + i % 26)}{i}") for i in range(60)]
    rows += [("x", text) for _, text in rows[:50] for _ in range(9)] + [("y", "one alone")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = [(r["lang"], r["excerpt"]) for r in langid.sample(docs, "text", "lang", F.xxhash64("text")).collect()]
    assert len(got) == len(set(got)) == 21 and [t for k, t in got if k == "y"] == ["one alone"]


def test_language_accuracy_and_odd_texts(spark):
    rows = language_rows()
    taught = spark.createDataFrame([r for r in rows if r[0] % 5], "doc_id int, text string, lang string")
    model = langid.fit(taught.unionByName(spark.createDataFrame([(-1, "abc", None), (-2, None, "x"), (-3, "12", "y")], taught.schema)))
    assert model.languages == ["x", "y", "z"]
    asked = [(i, t, 1, 2) for i, t, _ in rows if i % 5 == 0] + [(900, None, 1, 2), (901, "12 ...", 1, 2), (902, "", 1, 2), (903, "é" * 200_000, 1, 2)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(asked, "doc_id int, text string, score int, _found int"), model).collect()}
    held = [i for i, *_ in rows if i % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == "xyz"[i % 3] for i in held]) > 0.95
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903]["lang_pred"] in "xyz" and all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["_found"] == 2


def test_language_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert langid.fit(empty) is None
    assert langid.identify(empty, None).count() == 0
    one = spark.createDataFrame([(1, "text")], "doc_id int, text string")
    assert langid.identify(one, None).first()["lang_pred"] == "und"


def test_tables_of_byte_pairs_equal_the_convolution():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8)
    model = langid.train(windows, np.array([0, 1, 0, 1, 0, 1]), ["a", "b"])
    positions = langid.WINDOW - max(langid.WIDTHS) + 1
    embedded, hidden = model.embedding[windows], []
    for w in langid.WIDTHS:
        patch = np.concatenate([embedded[:, j : j + positions] for j in range(w)], axis=2)
        hidden.append(np.maximum((patch @ model.filters[w] + model.biases[w]).max(axis=1), 0))
    plain = langid._log_softmax(np.concatenate(hidden, axis=1) @ model.out + model.out_bias)
    assert np.allclose(plain, langid.Predictor(model).log_probabilities(windows), atol=1e-4)


# Fingerprints


def shingles(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_and_edits(spark, tmp_path):
    rows = [r for r in sample_rows(60)]
    got = fingerprints.with_edits(spark, table(spark, rows).repartition(5), str(tmp_path / "f")).collect()
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    errors = []
    for at, (doc_id, text) in enumerate(ordered):
        if doc_id == 3:
            continue
        following = ordered[(at + 1) % len(ordered)][1]
        changed = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        r = by_id[doc_id][0]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(shingles(text), shingles(changed)), r["near_next"] - jaccard(shingles(text), shingles(following))]
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
    assert len({r["fingerprint"] for r in by_id[3]}) == 1


def test_fingerprints_of_one_or_no_document(spark, tmp_path):
    assert fingerprints.with_edits(spark, table(spark, []), str(tmp_path / "none")).count() == 0
    only = fingerprints.with_edits(spark, table(spark, [(1, "abcdef", "a")]), str(tmp_path / "one")).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and only["near_next"] == 1.0
    two = fingerprints.with_edits(spark, table(spark, [(1, None, "a"), (2, "x", "a")]), str(tmp_path / "two")).collect()
    assert {r["doc_id"]: r["near_next"] for r in two} == {1: 0.0, 2: 0.0}


def test_packed_fingerprints_unpack():
    import pyarrow as pa

    codes = fingerprints.fingerprints_of(pa.array(["a b c d e f g", "", None, "a"]))
    for code, text in zip(codes, fingerprints.packed(codes)):
        assert (fingerprints.unpacked(text) == code).all()


# Language-model scores


def test_scores_by_brute_force(spark):
    import math
    from collections import Counter

    rows = sample_rows(80)
    docs = [words_of(t) for _, t, _ in rows]
    unigrams = Counter(w for d in docs for w in d)
    pairs = Counter(p for d in docs for p in zip(d, d[1:]))
    total = sum(unigrams.values())
    wanted = []
    for (doc_id, *_), words in zip(rows, docs):
        logs = [round(1e6 * math.log(unigrams[w] / total)) for w in words[:1]]
        logs += [
            round(1e6 * math.log(pairs[a, b] / unigrams[a] if pairs[a, b] >= 2 else 0.4 * unigrams[b] / total)) for a, b in zip(words, words[1:])
        ]
        wanted.append((doc_id, len(words), sum(logs)))
    for block_chars in (1 << 30, 5_000):
        got = lm.score(table(spark, rows), block_chars=block_chars).collect()
        assert sorted(wanted, key=repr) == sorted(((r["doc_id"], r["n_words"], r["log_score"]) for r in got), key=repr)
    assert {r["mean_log_score"] for r in got if not r["n_words"]} == {None}


def test_scores_of_empty_tables(spark):
    assert lm.score(table(spark, [])).count() == 0
    assert lm.score(table(spark, [(1, None, "a")])).first()["log_score"] == 0
