"""Ids and texts of byte-pair tokenizers against the library that reads the same files."""

import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.operators import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def mine():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\ta.'s1é<|>THE"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_and_texts(mine, library, text):
    for x in (text, f"{text}<|endoftext|>it's {text}"):
        ids = mine.encode(x)
        assert ids == library.encode(x, add_special_tokens=False).ids
        assert mine.decode(ids, special=True) == x
    assert mine.decode(mine.encode(text + "<|endoftext|>")) == text


def test_a_long_piece(mine, library):
    text = "ab" * 20_000
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_tables(spark, mine):
    docs = spark.createDataFrame([(1, "Hello <|endoftext|> wörld"), (2, ""), (3, None)], "doc_id long, text string")
    ids = bpe.encoded(docs, mine)
    assert {r.doc_id: r.text for r in bpe.decoded(ids, mine, special=True).collect()} == {1: "Hello <|endoftext|> wörld", 2: "", 3: ""}


def small(**changes):
    vocab = {"a": 0, "b": 1, "ab": 2, "Ġ": 3, "abab": 4}
    return {"model": {"type": "BPE", "vocab": vocab, "merges": ["a b", "ab ab"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}} | changes


def test_variants():
    assert bpe.parsed(json.dumps(small())).encode("abab b") == [4, 3, 1]
    head = small(added_tokens=[{"id": 9, "content": "<s>", "special": True}, {"id": 10, "content": "<s>b", "special": False}], post_processor={"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "<s>"}}, {"Sequence": {"id": "A"}}], "special_tokens": {"<s>": {"ids": [9]}}})
    made = bpe.parsed(json.dumps(head))
    assert made.encode("a<s>b<s>a", begin=True) == [9, 0, 10, 9, 0] and made.decode([9, 0, 10]) == "a<s>b"
    model = small()["model"] | {"merges": [["b", "a"], ["a", "b"]], "vocab": small()["model"]["vocab"] | {"ba": 5}}
    assert bpe.parsed(json.dumps(small(model=model))).encode("abab") == [0, 5, 1]
    assert bpe.parsed(json.dumps(small(model=model | {"ignore_merges": True}))).encode("abab") == [4]
    assert bpe.parsed(json.dumps(small(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": True}))).encode("ab") == [3, 2]
    assert bpe.parsed(json.dumps(small())).encode("axb") == [0, 1]


@pytest.mark.parametrize(
    "wrong",
    [{"model": {"type": "WordPiece", "vocab": {"a": 0}}}, {"model": {"type": "BPE"}}, {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": ["a a"]}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}],
)
def test_files_that_are_refused(wrong):
    with pytest.raises(ValueError):
        bpe.parsed(json.dumps(small(**wrong)))


def test_word_piece_files():
    vocabulary = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "a": 3}
    assert tokens.word_piece_file(json.dumps({"model": {"type": "WordPiece", "vocab": vocabulary}, "normalizer": {"lowercase": False}})) == (vocabulary, False)
    for wrong in ({"type": "BPE", "vocab": vocabulary}, {"type": "WordPiece", "vocab": {"a": 0}}, {"type": "WordPiece", "vocab": vocabulary, "continuing_subword_prefix": "@@"}):
        with pytest.raises(ValueError):
            tokens.word_piece_file(json.dumps({"model": wrong}))
