import random
import re

import numpy as np
import pytest

from granary.llm.leakage import align, leaks
from granary.llm.queries import p8_alignments

WORD = re.compile(r"[^\W_]+")


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] and a[i - 1] >= 0 else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def longest_run(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)


def test_alignment_against_brute_force():
    rng = np.random.default_rng(1)
    left = [rng.integers(-1, 4, int(n)).astype(np.int32) for n in rng.integers(0, 14, 30)]
    right = [rng.integers(0, 4, int(n)).astype(np.int32) for n in rng.integers(0, 12, 30)]
    score, _, run = align(left, right)
    for x, y, s, r in zip(left, right, score, run):
        assert s == smith_waterman(x.tolist(), y.tolist()) and r == longest_run([v if v >= 0 else None for v in x.tolist()], y.tolist())
    assert [a.tolist() for a in align([], [])] == [[], [], []]


def test_runs_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range([30, 10, 9, 30, 5, 30][i % 6]))) for i in range(12)] + [(90, None), (91, ""), (1, "short")]
    docs = []
    for d in range(60):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 40))]
        if d % 2:
            src = r.choice(items[:12])[1].split()
            n = r.choice([8, 9, 10, 11, 30])
            k = r.randrange(0, max(1, len(src) - n + 1))
            words[5:5] = [w.upper() if r.random() < 0.3 else w for w in src[k : k + n]]
        docs.append((d, r.choice([" ", "  ", "\n> ", " / ", ", "]).join(words)))
    docs += [(500, None), (501, ""), (None, items[3][1])]
    docs += [(600 + i, items[3][1]) for i in range(30)] + [docs[1]]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in leaks(df, it, "doc_id", "item_id", "text").where("verbatim_run >= 10 and score >= 20").collect()}
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 9):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 9):
            want |= {(d, i) for i in windows.get(tuple(w[k : k + 10]), ()) if d is not None}
    assert got == want and len(want) > 30
    assert leaks(df.limit(0), it, "doc_id", "item_id", "text").count() == 0
    assert leaks(df, it.limit(0), "doc_id", "item_id", "text").count() == 0


def test_edited_copy_scores_high(spark):
    item = "given five reels plus fourteen platters how many ruddy guava halves dims within one harvest of the year"
    edited = "so " + item.replace("ruddy", "pale").replace("halves", "halves and pits")
    got = leaks(spark.createDataFrame([(1, edited), (2, "nothing of the kind in these ten or more plain words here")], "d int, text string"), spark.createDataFrame([(7, item)], "i int, text string"), "d", "i", "text").collect()
    assert [(r.d, r.i) for r in got] == [(1, 7)] and got[0].score == 2 * 17 - 1 - 2 and got[0].verbatim_run == 8


def test_every_edited_copy_is_met_beside_a_verbatim_one(spark, tmp_path):
    word = [f"w{i}" for i in range(24)]
    docs = [(k, " ".join(f"x{k}" if i in gone else w for i, w in enumerate(word))) for k, gone in enumerate([set(), {9, 19}, {9, 18}, {9, 19, 21}])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(word))], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {r.doc_id: (r.score, r.verbatim_run) for r in p8_alignments(spark, str(tmp_path)).collect()}
    ids = {k: [int(w[1:]) if w[0] == "w" else -1 for w in t.split()] for k, t in docs}
    assert got == {k: (smith_waterman(x, list(range(24))), longest_run([v if v >= 0 else None for v in x], list(range(24)))) for k, x in ids.items()}


@pytest.mark.parametrize("clash", ["gram", "pos", "w"])
def test_clashing_columns(spark, clash):
    t = " ".join(f"x{i}" for i in range(12))
    got = leaks(spark.createDataFrame([(1, t, 5)], f"doc int, text string, {clash} int"), spark.createDataFrame([(2, t, 5)], f"item int, text string, {clash} int"), "doc", "item", "text").collect()
    assert [tuple(r) for r in got] == [(1, 2, 24, 12, 12)]
