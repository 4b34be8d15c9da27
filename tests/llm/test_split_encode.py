import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import encode, split

WHITE = " \t\r\n"


def plain_finest(text, most):
    paragraphs, run = [], []
    for line in text.split("\n"):
        if line.strip(WHITE):
            run.append(line)
        elif run:
            paragraphs.append("\n".join(run))
            run = []
    if run:
        paragraphs.append("\n".join(run))
    fits = lambda parts: all(len(p.strip(WHITE)) <= most for p in parts)
    lines = text.split("\n")
    sentences = [s for x in lines for s in re.split(r"(?<=[.!?])[ \t\r]+|(?<=[。！？])", x)]
    words = [w for s in sentences for w in re.split(r"[ \t\r]+", s)]
    for name, parts in (("paragraph", paragraphs), ("line", lines), ("sentence", sentences), ("word", words)):
        if fits(parts):
            return name
    return "character"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab. \n\r\t!。？ü", max_size=80), st.integers(1, 20), st.integers(0, 12))
def test_cuts_against_plain_version(text, most, overlap):
    index = split.BoundaryIndex(text)
    assert split.KINDS[split.finest_cut(index, text, most)] == plain_finest(text, most)
    pieces = split.cut_pieces(index, most, overlap)
    assert all(b - a <= most for a, b, _ in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(x[1] >= y[0] > x[0] for x, y in zip(pieces, pieces[1:], strict=False))


def test_strongest_is_rightmost_of_strongest():
    text = "a b\nc d\ne f"
    index = split.BoundaryIndex(text)
    assert index.strongest(1, 9) == (8, split.LINE)
    assert index.strongest(1, 7) == (4, split.LINE)
    assert index.strongest(1, 3) == (2, split.WORD)
    assert index.strongest(9, 9) is None


def test_split_oversized(spark):
    docs = spark.createDataFrame(
        [(1, "x", "word " * 100, "t"), (2, None, "y" * 50, "t"), (3, "x", None, "t"), (4, "x", "", "t"), (5, "x", "fits", "t"), (5, "x", "fits", "t")],
        "doc_id long, collection string, text string, p string",
    )
    rules = spark.createDataFrame([("x", 40, 10), ("default", 20, None), ("bad", 0, 5), (None, 3, 1)], "collection string, max_chars int, overlap_chars int")
    out = {r.doc_id: r for r in split.split_oversized(docs, rules).collect()}
    assert set(out) == {1, 2} and out[1].finest_cut == "word" and out[2].finest_cut == "character"
    for i, text in ((1, "word " * 100), (2, "y" * 50)):
        assert all(text[p.start_offset : p.end_offset] == p.text for p in out[i].pieces)
    assert split.pieces_table(split.split_oversized(docs, rules)).where("doc_id = 2").count() == 3
    assert split.split_oversized(docs.where("false"), rules).count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(docs, rules.where("false"))


needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(encode.TOKENIZER_FOLDER, "byte_bpe_50k.tiktoken")), reason="no vocabulary")
ODD = ["", "  中文 's 。's don't 'x\n\n x  y", "中　　文  \t\n\r\n 。。'll", "é́ ' s\x85\x85a", "a\x1c\x1d b", "٣٤'re", "    z", "<|endoftext|> x", "x" * 5000, "😀👩‍👩‍👧 " * 50, "\x00\x00 \n"]


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab' \n 　é中。1!s", max_size=40))
def test_fragments_equal_whole_encoding(text):
    e = encode.encoder("byte_bpe_50k", encode.TOKENIZER_FOLDER)
    text = text.encode("utf-8", "replace").decode()
    assert e.encode(text) == e._encoding.encode_ordinary(text)


@needs_vocabulary
def test_encode_corpus(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(encode.TOKENIZER_FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate([*ODD, None])], "doc_id int, text string, ids int")
    got = {r.doc_id: r.ids for r in encode.encode_corpus(docs).collect()}
    for i, x in enumerate(ODD):
        assert got[i] == t.encode(x, add_special_tokens=False).ids
    assert got[len(ODD)] == []
    assert encode.encode_corpus(docs.where("false")).count() == 0
    counts = {r.doc_id: r.n_tokens for r in encode.encode_corpus(docs, counts_only=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
