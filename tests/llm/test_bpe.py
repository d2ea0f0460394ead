"""BPE against the tokenizers library, on given texts and on random ones."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm import bpe
from quillmill.llm.queries import tokenizer_path

PATH = tokenizer_path()
REAL = Tokenizer.from_file(PATH)
REAL.no_truncation()
REAL.no_padding()
OURS = bpe.Encoder(bpe.load_vocabulary(PATH))

TEXTS = [
    "",
    " ",
    "Hello, world! It's 2024's TEST we'll don't",
    "a<|endoftext|>b<|startoftext|><|endoftext|>",
    "<|EndOfText|> < |endoftext|>",
    "ÄÖÜ ß Σας ΟΔΟΣ ΣΑΣ İstanbul",
    "é ñ ẛ̣",
    "日本語 テスト 12345 ½ ⅷ",
    "tab\tnew\nline\r\n nbsp em　ideographic\x85nel\x1cfs\x1fus",
    "👩‍👩‍👧 emoji 🎉🎉🎉",
    "x" * 3000,
    "ab" * 700 + "%%%***" * 400,
    "\x00\x01 control ﻿ bom ​ zero",
]


def check(text):
    want = REAL.encode(text, add_special_tokens=False).ids
    ids, decoded, n = OURS.encode(text)
    assert [int(x) for x in ids.split()] == want
    assert n == len(want)
    assert decoded == REAL.decode(want, skip_special_tokens=False)
    assert OURS.decode(want) == decoded


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeéßñ '.,!%0123\n\tsSΣtm"), st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"))), max_size=80))
def test_random(text):
    check(text)


def test_fragments_are_cut_where_no_token_spans():
    symbols = [OURS.bytes[b] for b in "qxzjqé".encode()]
    cut = list(OURS.fragments(symbols))
    assert [s for f in cut for s in f] == symbols and len(cut) > 1


def test_long_merge_equals_short_merge():
    for word in ("internationalisation" * 5, "aaaa" * 40, "banana" * 20):
        f = tuple(OURS.bytes[b] for b in word.encode())
        assert OURS.merge(f) == OURS._merge_long(f)


def test_dataframe(spark):
    rows = [(1, "Hello world"), (2, None), (None, "a<|endoftext|>"), (3, ""), (1, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, bpe.encode(df, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = REAL.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(REAL.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, PATH, what="ids"), PATH)
    assert sorted((r[0], r[1]) for r in back.where("doc_id is not null").collect()) == sorted((i, REAL.decode(REAL.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows if i is not None)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_a_file_of_another_kind_is_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.load_vocabulary(str(tmp_path / "other.json"))


def test_words_side_by_side(monkeypatch):
    """Words that repeat seldom are merged in arrays, not one by one; a table that fills up changes nothing."""
    import random

    draw = random.Random(7)
    texts = [" ".join("".join(draw.choices("aeinorstlhé'ñ日9", k=draw.randint(1, 30))) for _ in range(300)) for _ in range(20)] + TEXTS
    want = [REAL.encode(t, add_special_tokens=False).ids for t in texts]
    for kept in (0, 500, 60_000):
        monkeypatch.setattr(bpe, "KEPT_WORDS", kept)
        encoder, turns, alone = bpe.Encoder(bpe.load_vocabulary(PATH)), [], []
        monkeypatch.setattr(encoder, "_rank", lambda a, b, rank=encoder._rank: turns.append(len(a)) or rank(a, b))
        monkeypatch.setattr(encoder, "merge", lambda f, merge=encoder.merge: alone.append(f) or merge(f))
        got = [x for k in range(0, len(texts), 7) for x in encoder.encode_all(texts[k : k + 7])]
        assert [([int(x) for x in ids.split()], decoded, n) for ids, decoded, n in got] == [(w, REAL.decode(w, skip_special_tokens=False), len(w)) for w in want]
        assert len(turns) < 400  # of some 6,000 words
        assert {c for f in alone for c in "".join(f).removesuffix("</w>")} <= set("xab%*")  # of the long words only
