import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import ann, components, html, neardup
from hitloom.llm.text import Words

from test_llm_text_urls_warc import words_of

# Near-duplicates


def brute_components(rows, size, percent):
    sets = {}
    for doc_id, text in rows:
        words = words_of(text)
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets[doc_id] = runs
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rng = np.random.default_rng(9)
    rows, base = [], [f"b{i}" for i in range(200)]
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 200, int(rng.integers(0, 14))):
            words[at] = f"n{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(words)))
    drift = [f"d{i}" for i in range(100)]
    for i in range(60, 90):
        drift[int(rng.integers(0, 100))] = f"e{i}"
        rows.append((i, " ".join(drift)))
    rows += [(i, " ".join(f"r{x}" for x in rng.integers(0, 50, rng.integers(0, 9)))) for i in range(90, 160)]
    rows += [(160, None), (161, ""), (162, "one"), (163, "ONE "), (164, "long " * 30_000), (165, rows[0][1].upper())]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_components_by_brute_force(spark, tmp_path, size):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, id int, key string, n int")
    got = neardup.find(spark, docs.repartition(4), str(tmp_path / "n"), size=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, size, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_repeated_rows_null_ids_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)], schema)
    got = neardup.find(spark, docs, str(tmp_path / "r")).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(
        [(2, 1, False), (2, 1, False), (1, 1, True), (None, None, True), (None, None, True)], key=repr
    )
    assert neardup.find(spark, spark.createDataFrame([], schema), str(tmp_path / "e")).count() == 0


def repeated_ids():
    """One id with unlike texts, of which one has a near copy under another id, which has a text of its own too."""
    texts = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "pqrs"}
    return [(1, texts["p"]), (1, texts["q"]), (1, texts["q"].upper()), (2, texts["q"] + " more"), (2, texts["r"]), (3, texts["s"]), (1, texts["s"] + " less")]


def test_texts_of_one_id_are_documents_of_their_own(spark, tmp_path):
    rows = repeated_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.find(spark, docs, str(tmp_path / "i"), keys=True).join(docs.withColumn("text_key", F.xxhash64("text")), ["doc_id", "text_key"])
    assert {(r["doc_id"], r["text"]): (r["component_id"], r["kept"]) for r in got.collect()} == {
        rows[0]: (1, True), rows[1]: (1, True), rows[2]: (1, True), rows[3]: (1, False), rows[4]: (2, True), rows[5]: (1, False), rows[6]: (1, True),
    }


def test_the_stage_keeps_each_clean_text_of_an_id(spark, tmp_path):
    import corpus_pipeline

    rows = repeated_ids()
    docs = spark.createDataFrame([(*r, "s") for r in rows + rows[:1]], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["text"].lower()) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([rows[0], rows[1], rows[4], rows[6]])


@pytest.mark.parametrize(("block", "small"), [(2000, 256), (7, 0)])
def test_members_of_a_bucket_meet_each_other(spark, tmp_path, monkeypatch, block, small):
    """With one bucket for all and nothing found through centres, every link comes from the second step."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SMALL_SET", small)
    rows = near_rows()[:40] + near_rows()[60:120]
    docs = spark.createDataFrame([(i, t or "") for i, t in rows], "id long, text string")
    search = neardup._Search(spark, docs, str(tmp_path / "b"), 2, 80)
    signed = docs.select("id", neardup._signer(2)("text").alias("_s")).select("id", "_s.n", "_s.key", "_s.registers", "_s.low")
    classes = search.stored(signed.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("low").alias("low")), "c")
    members = classes.select(F.lit(5).cast("long").alias("band"), "id")
    likely = search.stored(search._meeting(members, spark.createDataFrame([], "id long, component long"), classes), "l")
    links = search.verified(likely, classes, 0)
    got = {r["id"]: r["component"] for r in components.components(spark, links, str(tmp_path / "k")).collect()}
    wanted = brute_components([(r["id"], t) for r in classes.collect() for i, t in rows if i == r["id"]], 2, 80)
    assert {i: got.get(i, i) for i in wanted} == {i: c for i, (_, c) in wanted.items()}


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for shared, apart in ((400, 50), (300, 200), (0, 300)):
        values = rng.integers(0, 2**64, shared + 2 * apart, dtype=np.uint64)
        sets = [np.sort(np.concatenate([values[:shared], part])) for part in (values[shared : shared + apart], values[shared + apart :])]
        codes = neardup.registers(Words(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])))
        n = np.array([shared + apart])
        estimate = neardup.estimate(codes[:1], codes[1:], n, n)[0]
        assert abs(estimate - shared / (shared + 2 * apart)) < 0.15


def test_chains_and_stars_are_components(spark, tmp_path):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1300)]
    odd = [(5, 5), (None, 3), (3, None), (50, 51), (51, 50), (50, 51)]
    links = spark.createDataFrame(chain + star + odd, "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(spark, links, str(tmp_path / "c")).collect()}
    assert got == {**{b: 100 for _, b in chain}, **{b: 7 for _, b in star}, 51: 50}
    empty = spark.createDataFrame([], "a long, b long")
    assert components.components(spark, empty, str(tmp_path / "e")).count() == 0


# Nearest neighbours


def test_neighbours_and_recall(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 16))
    vectors[100:300] = vectors[0]
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(vectors)]
    rows += [(900, None, 1, 1), (920, [0.0] * 16, 1, 1), (940, [float("nan")] + [1.0] * 15, 1, 1), (960, [None] + [1.0] * 15, 1, 1)]
    rows += [(980, [1.0] * 3, 1, 1), (None, [1.0] * 16, 1, 1), (20, vectors[20].tolist(), 1, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, pivot int")
    got = ann.nearest(spark, table, str(tmp_path / "a"), F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(range(0, 600, 20))
    recall = []
    for q, ranked in found.items():
        scores = (vectors * vectors[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:20]
        assert sorted(ranked) == list(range(1, 21))
        assert all(scores[i] == s for i, s in ranked.values())
        order = [ranked[k] for k in range(1, 21)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        recall.append(len({i for i, _ in ranked.values()} & set(best)) / 20)
    assert np.mean(recall) >= 0.9
    assert [found[100][k][0] for k in range(1, 21)] == [0, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110, 111, 112, 113, 114, 115, 116, 117, 118, 119]


def test_few_or_no_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark, spark.createDataFrame([], schema), str(tmp_path / "e"), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    got = ann.nearest(spark, few, str(tmp_path / "f"), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]


# Pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">Accept</div>
<article><h1>Head &amp; more</h1><p><b>First   line<br>goes
on</b>&nbsp;here<p>Second<aside>Side</aside><form><p>Mail</p></form><ul><li>one<li>two</ul>
<div class="comments"><p>Nice!</p></div></article><div id="sidebar"><p>Links</p></div><footer>&copy; {0}</footer></body></html>"""


def test_structure_decides_where_there_is_an_article():
    lines = [line for line, inside in html.page_lines(PAGE.format("x")) if inside]
    assert lines == ["Head & more", "First line goes on here", "Second", "one", "two"]


@pytest.mark.parametrize(
    "page, lines",
    [
        ('<div class="layout has-sidebar no-comments with-ads"><article class="post category-social"><p>a</article></div>', ["a"]),
        ('<main id="content" class="no-sidebar"><p>a</main>', ["a"]),
        ('<body class="left sidebar"><main class="menu"><article class="social"><p>a</article></main>', ["a"]),
        ('<article><div class="entry-header"><h1>a</h1></div><p>b<div class="post-share">c</div></article>', ["a", "b"]),
        ('<article><p data-role="banner" data-id="ad" title="x class=ad id=nav ">a</p></article>', ["a"]),
        ('<div class="widget"><p>b</p><div class="social"><article><p>a</article></div></div><div class="ad">c</div>', ["b", "a"]),
        ('<article><p>a</article><div id="comments"><article class="comment"><p>b</article></div>', ["a"]),
        ('<p>a <span class="ad">b</span>c', ["a c"]),
        ('<article><p>a<article class="comment"><p>b</article></article>', ["a"]),
        ('<article><p>a</article><div class="top-ad x">b</div><p class="sidebar-2">c</p><p id=\'menu\'>d</p><p class=ad>e', ["a"]),
    ],
)
def test_marks_rule_out_what_they_name_only(page, lines):
    assert [line for line, _ in html.page_lines(page)] == lines


def test_pages_without_an_article_lose_shared_lines(spark, tmp_path):
    plain = "<body><p>Top bar</p><p>Welcome</p><p>Own text {0}</p><p>More {0}</p><p>Bottom</p></body>"
    rows = [(i, f"http://h.org/a/{i}", plain.format(i)) for i in range(40)]
    rows += [(50, "http://h.org/a/5", PAGE.format("y")), (60, None, None), (61, "http://other.org/", "<p>Alone</p>"), (62, "bad", ""), (3, "http://h.org/a/3", plain.format(3))]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, _url int, host int")
    got = {}
    for r in html.extract(pages.repartition(3), str(tmp_path / "h")).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0] == f"Own text {i}\nMore {i}" for i in range(40) if i not in (5, 49, 50, 51))
    assert got[50] == ["Head & more\nFirst line goes on here\nSecond\none\ntwo"]
    assert got[60] == [""] and got[61] == ["Alone"] and got[62] == [""] and got[3][0] == got[3][1]


def test_text_outside_an_article_stays_unless_it_is_shared(spark, tmp_path):
    page = "<body><p>Welcome</p><article><p>Teaser</p></article><div><p>Body {0}</p><p>Body of {0}</p></div><p>Bye</p></body>"
    pages = spark.createDataFrame([(i, f"http://h.org/a/{i}", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages.repartition(3), str(tmp_path / "o")).collect()}
    assert got == {i: f"Teaser\nBody {i}\nBody of {i}" for i in range(6)}


def test_copies_and_crawls_of_one_address_keep_their_texts(spark, tmp_path):
    def page(name, visits=0):
        return "<body><p>Welcome</p>" + "".join(f"<p>Sentence {k} of the text {name}</p>" for k in range(9)) + f"<p>{visits}</p><p>Bye</p></body>"

    rows = [(0, "http://h.org/a", page("x")), (1, "http://h.org/a?ref=2", page("x")), (2, "http://h.org/mirror/a", page("x"))]
    rows += [(i, "http://h.org/b", page("y", i)) for i in range(3, 9)] + [(9, "http://h.org/c", page("z")), (10, "http://h.org/d", page("w"))]
    rows += [(20 + i, "http://alone.org/b", page("v", i)) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract(pages.repartition(3), str(tmp_path / "c")).collect()}

    def text(name):
        return [f"Sentence {k} of the text {name}" for k in range(9)]

    assert got[0] == got[1] == got[2] and got[0][:9] == text("x")
    assert all(got[i][:9] == text("y") and "Welcome" not in got[i] and "Bye" not in got[i] for i in range(3, 9))
    assert got[9][:9] == text("z") and got[10][:9] == text("w")
    assert all(got[20 + i] == ["Welcome", *text("v"), str(i), "Bye"] for i in range(4))


def test_the_nearer_path_is_found_behind_long_starts(spark, tmp_path):
    start = "http://h.org/" + "s" * 400
    body = "<body><p>{0}</p><p>Much longer own text of page {1}</p></body>"
    rows = [(1, start + "a", body.format("Red", 1)), (2, start + "bx", body.format("Blue", 2)), (3, start + "by", body.format("Blue", 3))]
    rows += [(4, start + "c", body.format("Red", 4))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages, str(tmp_path / "n")).collect()}
    assert got[2] == "Much longer own text of page 2" and got[3] == "Much longer own text of page 3"


def test_no_pages(spark, tmp_path):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_shared_lines_are_a_longest_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(0, 14))] for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    shared = sorted(html.shared_lines(a, b))
    assert len(shared) == table[-1][-1]
    rest = iter(b)
    assert all(line in rest for line in [a[i] for i in shared])


def test_odd_markup_and_very_long_pages():
    assert html.page_lines("<p>a<p>b</div>c</p><") == [("a", False), ("b", False), ("c", False), ("<", False)]
    assert html.page_lines("<" * 100_000 + ">")
    assert html.page_lines("<article><p>x" * 2000)[0] == ("x", True)
    assert html.page_lines("") == []


def meeting_of(spark, texts, folder, every=False):
    """The pairs that one bucket for all gives, and the number of pairs that its tasks give out."""
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    search = neardup._Search(spark, docs, folder, 2, 80)
    signed = docs.select("id", neardup._signer(2)("text").alias("_s")).select("id", "_s.n", "_s.key", "_s.registers", "_s.low")
    classes = search.stored(signed, "c")
    members = classes.select(F.lit(5).cast("long").alias("band"), "id")
    return search, classes, search._meeting(members, spark.createDataFrame([], "id long, component long"), classes, every).collect()


def passages(share):
    """Long texts that have a passage in common and no other words."""
    return [" ".join([f"p{i}" for i in range(int(1000 * share))] + [f"t{k}-{i}" for i in range(int(1000 * (1 - share)))]) for k in range(40)]


def test_long_texts_below_the_threshold_stay_in_the_task(spark, tmp_path):
    """All pairs share three quarters: their registers pass, their sets don't."""
    assert meeting_of(spark, passages(0.86), str(tmp_path / "m"))[2] == []


def test_a_group_in_one_bucket_gives_as_many_pairs_as_tie_it(spark, tmp_path):
    texts = passages(0.95)
    search, classes, pairs = meeting_of(spark, texts, str(tmp_path / "m"))
    assert len(pairs) == len(texts) - 1
    links = spark.createDataFrame([(r["a"], r["b"]) for r in pairs], "a long, b long")
    tied = components.components(spark, links, str(tmp_path / "k")).collect()
    assert {r["id"]: r["component"] for r in tied} == {i: 0 for i in range(1, len(texts))}
    assert len(meeting_of(spark, texts, str(tmp_path / "e"), every=True)[2]) == len(texts) * (len(texts) - 1) // 2


def test_pairs_that_fail_bring_all_pairs_out(spark, tmp_path, monkeypatch):
    """If what ties a group fails on full sets, the pairs that it stood for are looked at."""
    asked, real = [], neardup._Search._meeting

    def meeting(self, members, labels, classes, every=False):
        asked.append(every)
        found = real(self, members, labels, classes, every)
        # A pair of texts that have nothing in common, as if their bits were equal.
        return found if every else found.limit(0).unionByName(wrong(classes))

    def wrong(classes):
        two = [r["id"] for r in classes.orderBy("doc").select("id").collect()][:2]
        n = {r["id"]: r["n"] for r in classes.select("id", "n").collect()}
        return spark.createDataFrame([(min(two), max(two), n[min(two)], n[max(two)])], "a long, b long, n_a long, n_b long")

    monkeypatch.setattr(neardup._Search, "_meeting", meeting)
    rows = [(0, "a b c d e f g h i j"), (1, "k l m n o p q r s t")] + [(i, t) for i, t in near_rows()[:60]][2:]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = neardup.find(spark, docs, str(tmp_path / "f"), size=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 2, 80)
    assert asked == [False, True]
