import pytest
from hypothesis import given, settings, strategies as st

from granary.llm import tokens as T

TEXTS = [None, "", " ", "\n\n", "a", "It's we'll they'd I'M", "x  y   z\t\n q", "a b　　c d", "<|endoftext|> <s>", "1234567890" * 30, "é" * 500, "日本語 テキスト" * 40, "a" * 5000, "word " * 800, "\r\n".join(f"line {i} of text" for i in range(200)), "👩🏽‍🌾 🍎", "tab\tand space mixed", "end with blanks    "]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    from pathlib import Path

    return T._byte_encoder(Path(T.vocabulary_path("byte_bpe_50k.tiktoken")).read_bytes(), T.byte_pattern())


def test_corpus(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null key", "x"), (3, "again", "y")]
    got = [(r.doc_id, list(r.ids)) for r in T.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(((i, reference(t) if t else []) for i, t, _ in rows), key=repr)
    assert T.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string").limit(0), "doc_id", "text").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "'s", "don't", "123", "é", "　", " ", "!?", "x" * 40, "\t", "日本", "-", " The quick brown fox jumps over the lazy dog."]), max_size=60))
def test_joins_are_exact(parts):
    from pathlib import Path

    enc = T._byte_encoder(Path(T.vocabulary_path("byte_bpe_50k.tiktoken")).read_bytes(), T.byte_pattern())
    text = "".join(parts)
    raw = text.encode()
    assert enc(raw) == enc.encode(text)
    # every firm place is as good a cut
    for i in range(1, len(raw)):
        if 0x20 < raw[i - 1] < 0x7F and raw[i] in b" \n":
            assert enc.encode(raw[:i].decode()) + enc.encode(raw[i:].decode()) == enc.encode(text)


def test_batches_equal_single_texts(encoder):
    raws = [(t or "").encode() for t in TEXTS * 2]
    sizes, values = encoder.pack(raws)
    assert [values[a:b].tolist() for a, b in zip(sizes, sizes[1:])] == [encoder.encode(r.decode()) for r in raws]
    assert [a.tolist() for a in encoder.pack([])] == [[0], []]


def test_chunks_that_agree_nowhere_are_encoded_anew():
    """Tokens of two bytes, counted from the start of the text: a chunk's own tokens end at firm places only by chance."""
    import numpy as np

    enc = T.ChunkEncoder(lambda t: [len(t[i : i + 2]) for i in range(0, len(t), 2)], [0, 1, 2])
    assert enc._middle(b"abc d e fgh ijk") == (0, 0, b"") or enc._middle(b"abc d e fgh ijk")[0] % 2 == 0
    enc = T.ChunkEncoder(lambda t: [len(t)], list(range(100_000)))
    text = " ".join(f"word{i}" for i in range(500)).encode()
    assert len(T.cut_places(text)) > 5 and enc(text) == [len(text)]


def test_other_patterns_are_encoded_whole(spark):
    import tiktoken

    pattern = r"[^\s\p{L}]+[\r\n]*|\p{L}+[\r\n ]*|\s+"
    text = "\n".join(f"so, {i} lines end here!" for i in range(200))
    ranks = {T.base64.b64decode(a): int(b) for a, b in (x.split() for x in open(T.vocabulary_path("byte_bpe_50k.tiktoken"), "rb").read().splitlines() if x)}
    want = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    (got,) = T.encode_corpus(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t", pattern=pattern).collect()
    assert list(got.ids) == want


def test_equal_passages_share_chunks(encoder):
    passage = " ".join(f"the {i} brown foxes jumped over {i * 7} dogs" for i in range(60)).encode()
    a, b = b"some other beginning; " + passage, b"x " + passage
    chunks = lambda r: {bytes(r[i:j]) for i, j in zip([0, *T.cut_places(r)], [*T.cut_places(r), len(r)])}
    assert len(chunks(a) & chunks(b)) >= 0.8 * len(chunks(a))


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, name):
    df = spark.createDataFrame([(1, "Apples are ripe."), (2, None)], "i int, t string")
    got = {r.i: r.ids for r in T.encode_corpus(df, "i", "t", name).collect()}
    assert len(got[1]) > 2 and got[2] == []
