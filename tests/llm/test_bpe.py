import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamdex.llm import bpe, lexicon
from loamdex.llm.queries import vocabulary

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
V = bpe.Vocabulary(vocabulary())
TEXTS = [
    "", " ", "Hello  World's <|endoftext|> 12 ÉéÀ!!  ok ... \xa0x​ İ ﬁ É", "<|startoftext|>hi<|endoftext|>", "A\x00b \x1c \x85 x",
    "ΑΣ ΣΑΣ. Σ", "😀 naïve don't I'LL we'Re", "a" * 500, "ab" * 200 + " " + "é" * 99, "!?" * 80, "한국어 검색 日本語", "<| x |>",
]


def encoder(pieces=()):
    entries = [(p.encode(), V.merge(p)) for p in set(pieces)]
    return bpe.Encoder(V, lexicon.Lexicon(lexicon.dump(lexicon.build(entries))))


def same(e, text):
    found = LIBRARY.encode(text, add_special_tokens=False).ids
    assert e.encode(text) == found, text
    assert e.decode(found) == LIBRARY.decode(found, skip_special_tokens=False)


def test_texts_match_the_library():
    e = encoder(["hello", "world", "ok", "a", "ab"])
    for text in TEXTS:
        same(e, text)


def test_many_at_once():
    pieces = sorted({p for t in TEXTS for p in V.pieces(t)} | {"a" * n for n in range(1, 70)} | {"ab" * n + "a" for n in range(40)} | {"!" * n for n in range(1, 50)})
    assert V.merge_many(pieces) == [V.merge(p) for p in pieces]
    e = encoder(["hello", "world"])
    assert [bpe.unpack(x) for x in e.encode_many(TEXTS)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=500, deadline=None, derandomize=True)
@given(st.text(st.characters(max_codepoint=0x260), max_size=40))
def test_twin_pattern_finds_the_same_pieces(text):
    assert V.twin is not None
    if not bpe._RARE.search(text):
        assert V.twin(text.lower()) == V.find(text.lower())
    same(encoder(), text)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text_matches_the_library(text):
    same(encoder(), text)


@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.dictionaries(st.binary(min_size=0, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=40))
def test_lexicon_gives_back_its_words(words):
    x = lexicon.Lexicon(lexicon.dump(lexicon.build(list(words.items()))))
    assert dict(zip(words, x.get_many(list(words)), strict=True)) == words
    assert sorted(x.numbers(list(words)).tolist()) == list(range(len(words)))
    assert x.get_many([b"not a word"]) == [None]


def test_suffixes_are_shared():
    words = [a + b"ation" for a in (b"n", b"st", b"rel", b"vari")]
    arrays = lexicon.build([(w, [1]) for w in words])
    assert len(arrays["final"]) < 6 + sum(len(w) - 5 for w in words)


def test_encode_rows(spark):
    rows = [(1, "Hello hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "a " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted(bpe.encode_digests(docs, vocabulary()).collect(), key=str)
    assert len(found) == 5
    for row in found:
        text = {1: rows[0][1], None: rows[4][1]}.get(row.doc_id, "")
        e = LIBRARY.encode(text, add_special_tokens=False)
        assert row.n_tokens == len(e.ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e.ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), vocabulary()).count() == 0
    assert [r.decoded for r in bpe.encode(docs.filter("doc_id = 1"), vocabulary()).collect()] == ["hello</w> hello</w> world</w>"]


def test_lexicon_of_the_most_frequent_pieces(spark):
    text = " ".join(f"w{chr(97 + i)}x " * (2 * i + 2) for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    words = lexicon.Lexicon(bpe.compile_lexicon(docs, vocabulary(), 4))
    found = words.get_many([f"w{chr(97 + i)}x".encode() for i in range(20)])
    assert [f is not None for f in found] == [False] * 16 + [True] * 4
    assert found[19] == LIBRARY.encode("wtx", add_special_tokens=False).ids
