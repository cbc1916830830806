"""The registered queries over the small tables, against SQL or their contracts."""

import pytest

import __spark_entry__ as contract
import check
import corpus_pipeline

from test_llm_text_urls_warc import words_of

SF = "/root/testdata/sf0.001"
NAMES = [name for name in contract.queries() if name.startswith("op")]


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    verdict = check.compare(spark, connection, SF, name)
    assert verdict.startswith(("equal", "no oracle")), verdict


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in NAMES) == list(range(1, 14))
    assert "pipeline" in contract.queries()


def brute_keep(rows):
    """The smallest document of each group of texts with at least 80 of 100 runs of five words in common."""
    sets = {}
    for doc_id, text in rows:
        words = words_of(text)
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_each_stage_of_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(9001, "12 34 ...", "en", "src1", 9), (9002, None, None, None, None), (9003, "", "en", "src1", 0)], docs.schema
    )
    given = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "mixing", "packing"]

    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    named = stored(stages["language_id"](spark, given, SF), "language")
    kept = {r["doc_id"] for r in named.select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert named.columns == docs.columns and kept <= lettered and len(kept) >= 0.99 * len(lettered)

    single = stored(stages["near_dedup"](spark, named, SF), "dedup")
    rows = [(r["doc_id"], r["text"]) for r in named.collect()]
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(brute_keep(rows))

    mixed = stored(stages["mixing"](spark, single, SF), "mixed")
    assert mixed.columns == docs.columns
    total = sum(len(words_of(r["text"])) for r in single.collect())
    assert abs(sum(len(words_of(r["text"])) for r in mixed.collect()) - 1.5 * total) <= 20
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert all(texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in mixed.collect())

    pieces = stages["packing"](spark, mixed, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in mixed.collect()}
    assert all(p["offset"] + p["length"] <= 1024 for p in pieces)


def test_the_pipeline_runs_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_corpus_pipeline_and_entry_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(contract.__file__))
    shutil.copytree(os.path.join(root, "hitloom"), tmp_path / "hitloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(contract.__file__, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op') for q in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert done.stdout.split()[1:] == ["False", "False"] and int(done.stdout.split()[0]) >= 43
