"""Encoding and decoding against the tokenizer library, and the lexicon against a dictionary."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "  ", "a  b", "a   b\n \n c", "x  y", "  x", "\n  x", "it's 's 'S we'll", "\x1cq \x1c", "a<|endoftext|>b <|endoftext|>", "日本 語　テ", "é́ ́", "1234 a1b2", "\t\tx", "!!! ?", "🙂 👨‍👩‍👧"]


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)


def small_lexicon(tmp_path, words):
    vocab = bpe.vocabulary(PATH)
    compile_lexicon({w.encode(): vocab.encode_word(w) for w in words}, str(tmp_path / "lex"))
    return Lexicon(str(tmp_path / "lex"))


def test_lexicon_is_a_minimal_dictionary(tmp_path):
    entries = {w.encode(): [k, k + 1][: k % 3] for k, w in enumerate(["", "a", "tap", "taps", "top", "tops", "stops", "é"])}
    compile_lexicon(entries, str(tmp_path / "x"))
    lexicon = Lexicon(str(tmp_path / "x"))
    asked = [*entries, b"t", b"ta", b"tapsx", b"z", b"stop"]
    places = lexicon.places(asked)
    assert (places >= 0).tolist() == [w in entries for w in asked]
    for w, p in zip(asked, places, strict=True):
        if p >= 0:
            assert np.frombuffer(lexicon.outputs(np.array([p]))[0], "<u4").tolist() == entries[w]
    # tap, top and their plurals share the states after the vowel: t, s and the end are three states, not twelve
    assert len(lexicon.finals) - 1 <= 12
    compile_lexicon({}, str(tmp_path / "none"))
    assert Lexicon(str(tmp_path / "none")).places([b"", b"a"]).tolist() == [-1, -1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab 'sé\n\t 　.<|>1", max_size=40)), max_size=5))
def test_any_text_as_the_library(tmp_path_factory, texts):
    lexicon = small_lexicon(tmp_path_factory.mktemp("l"), [" the", "a", " a", "\n"])
    for text, ids in zip(texts, bpe.encode_texts(texts, PATH, lexicon), strict=True):
        assert (ids, bpe.decode_ids(ids, PATH)) == expected(text)


def test_documents_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"], 0) for r in docs] + [(1000 + k, t, 0) for k, t in enumerate(ODD)] + [(None, None, 0), (5000, "x yz " * 50000, 0), (5000, "x yz " * 50000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.round_trip_digests(df, PATH).collect()
    want = []
    for i, t, _ in rows:
        ids, back = expected(t or "")
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("aehint ", max_size=60))
def test_long_tokens_merge_alike(text):
    vocab = bpe.vocabulary(PATH)
    token = text.encode()
    assert not token or vocab._merge_long(token) == vocab.merge(token)


def test_words_that_the_lexicon_lacks_are_merged_in_step():
    vocab = bpe.vocabulary(PATH)
    rng = random.Random(5)
    words = ["", "a", " ", "aaaa", "x" * 64, "x" * 65, "y" * 300, "don't", " it's1234,", "é" * 40, "퟿日本 "]
    words += ["".join(rng.choice(["th", "er", "on", "a", "Z", "7", ".", "ß", " "]) for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    assert vocab.encode_words(words) == [np.array(vocab.encode_word(w), "<u4").tobytes() for w in words]
    assert vocab.encode_words([]) == []


def test_a_task_has_one_worker_that_holds_few_texts_at_once(spark, monkeypatch):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    plan = bpe.round_trip_digests(df, PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each step in Python has a worker with a vocabulary of its own

    held = []
    real = bpe.encode_texts
    monkeypatch.setattr(bpe, "encode_texts", lambda texts, *rest: held.append(len(texts)) or real(texts, *rest))
    monkeypatch.setattr(bpe, "_lexicon", lambda name: small)
    small = type("None_", (), {"places": lambda self, words: np.full(len(words), -1), "outputs": lambda self, places: []})()
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([f"text {k}" for k in range(2000)])], names=["id", "text"])
    got = [x for b in bpe._encoded(iter([batch]), PATH, "none") for x in zip(b["id"].to_pylist(), b["ids"].to_pylist(), strict=True)]
    assert got == [(k, expected(f"text {k}")[0]) for k in range(2000)]
    assert max(held) <= 512
