"""Counts against the tokenizer library's unigram model over the same pieces and scores."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from millrace.llm import token_counts
from millrace.llm.token_counts import MARK, Counter

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = token_counts.unigram_vocabulary(PATH)
LIBRARY = Tokenizer(models.Unigram(VOCABULARY, unk_id=0, byte_fallback=True))
PLAIN = [x for x in VOCABULARY if not x[0].startswith("<0x")]
REAL, WITHOUT, WITHOUT_LIBRARY = Counter(VOCABULARY), Counter(PLAIN), Tokenizer(models.Unigram(PLAIN, unk_id=0))


def expected(text, library=LIBRARY):
    return len(library.encode(MARK + text.replace(" ", MARK)).ids) if text else 0


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abctheing é  \n▁<unk>日🙂", max_size=60)))
def test_any_text_as_the_library(text):
    assert REAL.count(text) == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abctheing é  \n▁<unk>日🙂", max_size=60)))
def test_without_pieces_for_bytes(text):
    assert WITHOUT.count(text) == expected(text, WITHOUT_LIBRARY)


@settings(max_examples=200, deadline=None)
@given(
    st.dictionaries(st.text("ab▁", min_size=1, max_size=4), st.integers(-4, -1), min_size=1, max_size=12),
    st.text("abc ", max_size=25),
)
def test_ties_of_small_vocabularies(pieces, text):
    vocabulary = [("<unk>", min(pieces.values())), *((p, float(s)) for p, s in pieces.items())]
    assert Counter(vocabulary).count(text) == expected(text, Tokenizer(models.Unigram(vocabulary, unk_id=0)))


def test_documents_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"], 1) for r in docs] + [(None, None, 1), (7000, "", 1), (7001, "  a   b ", 1), (7002, "wörd" * 30000, 1), (7001, "  a   b ", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(df, PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, expected(t)) for i, t, _ in rows], key=str)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0
