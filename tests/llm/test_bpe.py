from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinfold.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's don't WE'LL 'sfoo 's", "<|endoftext|>Hello<|startoftext|><|endoftext", "a" * 500, "ΑΣ ΣΑΣ Ωσ", "", "  \n", "\x00\x1c\x1da\x1f", "🤦🏽‍♀️é e\u0301 İ ẞ ﬁ", "12345 1,000.50 ½ ٣", "\xa0\u2003x\u3000y\x85z", "<|<|endoftext|>|>", "aaa" * 100 + " " + "ab" * 333, "日本語 テスト", "\ufeffx \u200b"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rnd = random.Random(9)
    alphabet = "abcdeABC '’.,!?-_0123é ß ñ\n\t😀中ÅΣ"
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(500)]


def test_equals_the_library(library):
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    for part in (texts(), texts()[::-1]):  # the second time most words are known
        ids, offsets, decoded = encoder.encode(part)
        for k, t in enumerate(part):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[offsets[k] : offsets[k + 1]].tolist() == want
            assert decoded[k] == library.decode(want, skip_special_tokens=False)


def test_every_code_point_equals_the_library(library):
    """Each in five neighbourhoods: alone, after a letter, before marks, after marks, and among digits and capitals."""
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 1 << 16):
        part = [f"{c} a{c}b a{c}\u0327\u0301x e\u0301\u0327{c} 1{c}Z" for c in points[start : start + (1 << 16)]]
        encoder.forget()
        ids, offsets, _ = encoder.encode(part)
        for k, got in enumerate(library.encode_batch(part, add_special_tokens=False)):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == got.ids, hex(ord(points[start + k]))


def test_new_composites_stay_apart(library):
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    texts = ["\U00011935\U00011930", "\U00011938\u0301", "x\U00011935\u0327\U00011930y", "\u1df6\u0301e\u0301", "\U00016ea0\U00016eb8 \u1c89"]
    ids, offsets, _ = encoder.encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_table(spark, clash, library, sf_dir, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 50)
    df = clash(spark.createDataFrame([(i, t) for i, t in enumerate([None, *texts()[:60]])] + [(None, "x")], "doc_id long, text string"))
    rows = bpe.bpe(df, PATH).collect()
    assert len(rows) == 62
    for r in rows:
        text = "x" if r["doc_id"] is None else [None, *texts()[:60]][r["doc_id"]] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
    assert bpe.bpe(df.limit(0), PATH).count() == 0


def test_decoding_inverts_encoding():
    vocab = bpe.load_vocabulary(PATH)
    ids, _ = bpe.encode_words(vocab, [b"hello", b"zzzz"])
    assert "".join(bpe.decode_ids(vocab, ids).split()).replace("</w>", " ") == "hello zzzz "


def test_long_words_take_little_time(library):
    import time

    rnd = random.Random(3)
    words = ["".join(rnd.choice(a) for _ in range(n)) for a, n in (("abcdefghijklmnopqrstuvwxyz", 80_000), ("ab", 30_000), ("a", 30_000), ("äöü", 3000))]
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    started = time.process_time()
    ids, offsets, _ = encoder.encode(words)
    assert time.process_time() - started < 8
    for k, w in enumerate(words):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(w, add_special_tokens=False).ids
