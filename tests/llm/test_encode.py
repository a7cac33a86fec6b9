import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.encode import count_tokens, decode, decode_texts, encode, encode_texts, encoding, parts, VOCABULARIES

TEXTS = ["", None, " ", "Hello world", "don't 12ab  \n\n x", "日本語 ✅👩\u200d🔬", "a\x1cb \x85c", "<|endoftext|>", "x" * 100_000, " " * 70_000, "word 123 " * 20_000, "ab12" * 30_000, "\r\n\t" * 30_000]


def plain(text):
    return encoding("byte_bpe_50k", VOCABULARIES).encode_ordinary(text or "")


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_the_library_and_back(text):
    ids = encode(text)
    assert ids.dtype == np.int32 and ids.tolist() == plain(text) and decode(ids) == (text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab1 2'st\n\t\x1c\x85\xa0!é日"), st.characters(exclude_categories=["Cs"])), max_size=60), st.integers(1, 5))
def test_cuts_never_change_ids(text, long):
    assert "".join(parts(text, long)) == text
    assert encode(text, long=long).tolist() == plain(text)


def test_against_the_other_library_of_the_same_vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in filter(None, TEXTS):
        assert encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_tables(spark):
    df = spark.createDataFrame([(k, text, [1], 5) for k, text in enumerate(TEXTS)] + [(None, "x", [2], 6), (0, "x", None, 7)], "doc_id long, text string, ids array<int>, n_tokens int")
    rows = encode_texts(df).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.ids is not None for r in rows)
    assert {r.doc_id: r.ids for r in rows[: len(TEXTS)]} == {k: plain(t) for k, t in enumerate(TEXTS)}
    assert [r.n_tokens for r in count_tokens(df).collect()] == [len(r.ids) for r in rows]
    assert [r.text for r in decode_texts(encode_texts(df)).collect()] == [*(t or "" for t in TEXTS), "x", "x"]
    assert encode_texts(df.limit(0)).collect() == [] and encode_texts(df).schema["ids"].dataType.simpleString() == "array<int>"
    with pytest.raises(ValueError):
        encode_texts(df.drop("text"))


def test_special_strings_are_text():
    assert 50256 not in encode("<|endoftext|>").tolist() and tiktoken.__version__
