"""Exact round trips against the library."""

import hashlib
import random

import public_tokenizers
import sentencepiece

from engram.llm import spiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def samples():
    rng = random.Random(3)
    alphabet = "abcdeithnors  .,\n\t▁éüß漢梦🙂\x00<s>0x1‍"
    runs = [" " * k + w for k in (*range(1, 40), 64, 139) for w in ("", "x", "漢🙂")]
    return ["", "   a", " a  ", "<s>", "</s> <unk>", "<0x41>", "�", "a" * 3000, "the" * 500, *runs,
            *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000))]


def test_ids_and_text_equal_the_library():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), spiece.Codec(spiece.vocabulary(MODEL))
    for t in samples():
        ids = sp.encode(t)
        assert own.encode(t) == ids, t
        assert own.decode(ids) == sp.decode(ids), t


def test_decoding_of_any_ids():
    rng = random.Random(5)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), spiece.Codec(spiece.vocabulary(MODEL))
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(1, 12))]
        assert own.decode(ids) == sp.decode(ids), ids


def test_small_caches_change_nothing(monkeypatch):
    own = spiece.Codec(spiece.vocabulary(MODEL))
    want = [own.encode(t) for t in samples()[-200:]]
    monkeypatch.setattr(spiece, "REMEMBERED", 3)
    small = spiece.Codec(spiece.vocabulary(MODEL))
    assert [small.encode(t) for t in samples()[-200:]] == want


def test_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "The cat\nsat.", "k"), (1, "The cat\nsat.", "k"), (2, None, "k"), (None, "x", None), (3, "", "k"), (4, "word " * 20000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = spiece.tokenized(df, "doc_id", "text", MODEL, digests=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(next(x for y, x, _ in rows if y == r["doc_id"]) or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert spiece.tokenized(df.limit(0), "doc_id", "text", MODEL).count() == 0
