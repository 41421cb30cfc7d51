import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import bpe, tokens

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys(spark, odd, sample):
    lib = Tokenizer.from_file(WORDS)
    for docs in (odd, sample):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, WORDS).collect()) == want
    none = tokens.count_tokens(sample, WORDS, frequent={}).collect()  # the first tier only saves work
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in none) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aA'sStTlL dD1²½Σσς İıſßÀééİ　  \n\t!?<|>—漢🎉")) | st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_counts_of_any_text(text):
    lib = Tokenizer.from_file(WORDS) if not hasattr(test_counts_of_any_text, "lib") else test_counts_of_any_text.lib
    test_counts_of_any_text.lib = lib
    split, _ = tokens.splitter(tokens.read_vocabulary(WORDS))
    for t in (text, f"{text}<|endoftext|>{text}", f"<|STARTOFTEXT|>{text}"):
        got = sum(1 if part == [None] else sum(split.lengths(part)) for part in split.pretokens(t))
        assert got == len(lib.encode(t, add_special_tokens=False).ids)


def test_characters_of_another_version_of_unicode(spark):
    """What is a letter or number for one of ``regex`` and the library only is split as the library does."""
    lib = Tokenizer.from_file(WORDS)
    plain, every = tokens._PLAIN, sorted(tokens.unsure())
    assert not any(map(plain.fullmatch, every))
    chars = ["\U0003d000", "\u0558", "\ua7ce", "\U00011de0", *every[::200]]
    texts = [t for c in chars for t in (f"¢{c}", f"a{c}b 1{c}2", f"!{c}{c}? 漢{c}'s é{c}")] + [" ".join(chars) * 2, "".join(chars)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for frequent in (None, {}):
        got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, WORDS, frequent=frequent).collect()}
        assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_marks_after_a_dotted_capital_i():
    """Lower case gives it a mark of its own, which NFC would put behind those of a lower class: texts are normalized once."""
    split, _ = tokens.splitter(tokens.read_vocabulary(WORDS))
    lib = Tokenizer.from_file(WORDS)
    for t in ("İ\u0abc", "a İ\u1ab9 b", "İ\u0323\u0301İ"):
        assert sum(sum(split.lengths(part)) for part in split.pretokens(t)) == len(lib.encode(t, add_special_tokens=False).ids)


def test_frequent_words_cover_all_texts(spark):
    docs = spark.createDataFrame([(i, "the the rare%d" % i) for i in range(50)], "doc_id bigint, text string")
    assert tokens.frequent_words(docs, top=1) == ["the"] and len(tokens.frequent_words(docs.repartition(9), top=99)) == 51


def test_empty_tables(nothing):
    assert tokens.count_tokens(nothing, WORDS).collect() == []
    assert bpe.encode_documents(nothing, RANKS).collect() == []


def test_ids_are_the_librarys_and_round_trip(odd, sample):
    lib = library()
    for docs in (odd, sample):
        enc = bpe.encode_documents(docs, RANKS, keep=("doc_id", "text"), digests=True)
        for r in enc.collect():
            ids = lib.encode_ordinary(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        for r in bpe.decode_documents(enc, RANKS, keep=("text",)).collect():
            assert bytes(r.bytes) == (r.text or "").encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'sreéß1²½\n\t 　!?—漢🎉")), min_size=5, max_size=120))
def test_safe_chunks_encode_alike(text):
    enc = bpe.encoder(bpe.read_ranks(RANKS), P.PATTERN)
    parts = list(bpe.safe_chunks(text, 7))
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
