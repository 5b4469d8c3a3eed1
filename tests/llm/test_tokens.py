"""Token counts against the tokenizers library."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cspulse.llm import tokens
from cspulse.llm.catalog import TOKENIZER

with open(TOKENIZER, "rb") as file:
    SPEC = file.read()


def library(text):
    return len(tokens._tokenizer(SPEC).encode(text, add_special_tokens=False).ids)


def spliced(text, chunk, overlap):
    tok = tokens._tokenizer(SPEC)
    while True:
        spans = tokens.chunk_spans(len(text), chunk, overlap)
        n = tokens.splice([tokens.encode_chunk(tok, text[a:b], a, a == 0, b == len(text), overlap)
                           for a, b in spans])
        if n is not None:
            return n
        overlap *= 4


COMMON = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0x250)]]


def test_both_engines_agree_on_common_characters():
    rnd = random.Random(2)
    texts = [x for c in COMMON for x in (c, f"a{c}", f"{c}a", f" {c}1", f"{c}{c} ", f"it{c}s 're", f"  {c}\n{c}")]
    texts += ["".join(rnd.choices(COMMON, k=rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|endoftext|>" * 3, " <|endoftext|> ", "<|endoftext"]
    assert tokens.count_tokens(SPEC, texts) == [library(t) for t in texts]


def test_rare_characters_go_through_the_library():
    texts = ["日本語 テキスト", "\u0085x​ y", "😀 👩‍👩‍👧", "\x00\x1f", "ﬁ ǆ Ω"]
    assert tokens.count_tokens(SPEC, texts) == [library(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "\n\n ", "it's", " 12", "…", "é", "日本", "😀",
                                 "<|endoftext|>", "a" * 90, " " * 70, "!!", "don't we'll"]),
                min_size=30, max_size=120))
def test_spliced_chunks_equal_the_whole(parts):
    text = "".join(parts)
    for chunk, overlap in ((150, 60), (97, 48), (64, 40)):
        assert spliced(text, chunk, overlap) == library(text)


@pytest.mark.parametrize("text", ["x" * 5000, " " * 5000, "ab " * 2000, "1" * 3000 + "a" * 3000, "\n" * 4000])
def test_runs_longer_than_the_overlaps(text):
    assert spliced(text, 400, 64) == library(text)


def test_operator_on_edge_rows(spark):
    long_text = "".join(random.Random(4).choices(["alpha ", "beta, ", "γάμμα ", "\n", "x" * 700, "  "], k=900))
    rows = [(1, "hello world"), (2, None), (3, ""), (4, long_text), (4, long_text), (None, "日本語"),
            (5, "y" * 9000), (6, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    got = tokens.token_counts(docs, TOKENIZER, chunk=1000, overlap=64).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(
        (str(i), len((t or "").encode()), library(t or "")) for i, t in rows)
    assert tokens.token_counts(docs.where("false"), TOKENIZER).count() == 0
