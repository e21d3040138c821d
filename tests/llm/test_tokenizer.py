from __future__ import annotations

import os
import random

import pytest

from tracelode.llm.tokenizer import VOCABULARY, Encoder, encode_corpus, merge_long, merge_short

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
TEXTS = [
    None, "", " ", "   \n\n  x\t\ty  ", "I'll don't 'S 's we've", "\x1c \x1d x\x85y  z  　q", "naïve café — „ja“ ½ ²x Ⅷ १२३", "漢字かな交じり文 안녕하세요 🙂👩‍🔧",
    "é ​ ok", "<|endoftext|>", "a" * 5000, "ab" * 3000 + " " * 700 + "!?" * 900, "x" * 255 + "é" * 300, "�﻿\u0000", "0123456789" * 60, "CRLF\r\nCR\rLF\n",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def test_ids_equal_those_of_a_public_library(spark, encoder):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("tokenizers")
    from tracelode.llm.tokenizer import PATTERN

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    full = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    full.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    for i, text in enumerate(TEXTS):
        want = full.encode(text, add_special_tokens=False).ids if text else []
        assert got[i] == want, text[:20]
        assert own.decode(got[i]) == (text or "")
    assert encode_corpus(df.limit(0)).count() == 0


def test_both_merges_agree(encoder):
    rnd = random.Random(0)
    for _ in range(500):
        word = bytes(rnd.choice(b"abcdefthe in0\xc3\xa9") for _ in range(rnd.randint(1, 80)))
        assert merge_short(word, encoder.ranks) == merge_long(word, encoder.ranks)


def test_round_trip(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    rnd = random.Random(1)
    for _ in range(50):
        text = "".join(chr(rnd.choice([32, 10, rnd.randrange(33, 127), rnd.randrange(160, 1500), rnd.randrange(0x3040, 0x9FFF)])) for _ in range(300))
        assert b"".join(back[i] for i in encoder.encode(text)).decode() == text
