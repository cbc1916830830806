"""Token alignment against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hitloom.llm import alignment
from hitloom.llm.queries import PIECES, tokenizer_path

PATHS = tokenizer_path(), tokenizer_path(PIECES)


def plain_align(first, second):
    """Groups (A places, B places) and overlaps of two lists of ends."""
    both = sorted(set(first) & set(second))
    groups, begin = [], 0
    for end in both:
        groups.append(([i for i, e in enumerate(first) if begin < e <= end], [j for j, e in enumerate(second) if begin < e <= end]))
        begin = end
    spans = [list(zip([0, *ends[:-1]], ends)) for ends in (first, second)]
    links = {(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if max(a, c) < min(b, d)}
    return groups, links


def check_align(first, second):
    found = alignment.align(first, second)
    groups, links = plain_align(first, second)
    mine = [([i + k], [j + k]) for i, j, n in found.runs.tolist() for k in range(n)]
    mine += [(list(range(i, k)), list(range(j, m))) for i, k, j, m in found.groups.tolist()]
    assert sorted(mine) == groups
    last = alignment.last_of_groups(found, len(first), len(second))
    a, b = alignment.all_links(np.array(first), np.array(second), last[1])
    assert len(a) == len(links) and set(zip(a.tolist(), b.tolist())) == links
    return found


ENDS = st.sets(st.integers(1, 60))


@settings(max_examples=400, deadline=None)
@given(ENDS, ENDS, st.integers(60, 64))
def test_align(first, second, last):
    check_align(sorted(first | {last}), sorted(second | {last}))


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8, 9, 64, 100, 1000])
def test_long_runs_are_one(length):
    ends = list(range(2, 2 * length + 2, 2))
    assert check_align(ends, ends).runs.tolist() == [[0, 0, length]]
    # A run behind a group that moves the shift, with a group at its end.
    moved = [1, *ends, 2 * length + 1, 2 * length + 2]
    found = check_align(moved, [*ends, 2 * length + 2])
    assert len(found.groups) == 2 and found.runs[:, 2].sum() == length - 1


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=PATHS[1])
    found, held = [], Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, [], [], [], []))
            continue
        whole = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(b_bytes) != whole:
            found.append((doc_id, [], [], [], []))
            continue
        table = {chr(k): k for k in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        rest = [k for k in range(256) if chr(k) not in table]
        table |= {chr(256 + k): code for k, code in enumerate(rest)}
        a_bytes = [bytes(table[c] for c in token) for token in a.tokens]
        assert b"".join(a_bytes) == whole
        ends = [[sum(map(len, side[: i + 1])) for i in range(len(side))] for side in (a_bytes, b_bytes)]
        groups, links = plain_align(*ends)
        pairs = [(a.ids[i], b[j]) for i, j in links]
        held.update(set(pairs))
        found.append((doc_id, a.ids, b, groups, pairs))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    for doc_id, a, b, groups, pairs in found:
        text = ";".join(",".join(str(a[i]) for i in left) + "|" + ",".join(str(b[j]) for j in right) for left, right in groups)
        yield (
            doc_id, len(a), len(b), len(groups), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs),
            hashlib.sha256(text.encode()).hexdigest() if a else "",
        )


def test_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = ["the", "tokenization", "Über", "naïve", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "x=1;", "1234567", "你好", "\U0001f600", "\n", "  ", "\t", "don't", "́", " ", "\x00"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(None, "null id"), (70, None), (71, ""), (72, " "), (73, "  "), (74, "a▁b"), (75, "same"), (75, "same"), (75, "other"), (76, "ab" * 2000), (77, "﻿x"), (78, "é\r\n")]
    monkeypatch.setattr(alignment, "BLOCK_DOCUMENTS", 7)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, block string, pair int").repartition(3)
    out = alignment.overlaps(spark, df, str(tmp_path / "a"), *PATHS)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = sorted(map(tuple, out.collect()), key=repr)
    assert found == sorted(plain(rows), key=repr)
    assert all(r[4] == r[1] + r[2] - r[3] for r in found) and sum(r[1] == 0 for r in found) >= 3


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.overlaps(spark, empty, str(tmp_path / "a"), *PATHS).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [r["groups_sha256"] for r in alignment.overlaps(spark, blank, str(tmp_path / "b"), *PATHS).collect()] == ["", ""]
