"""Token counts against the libraries, text by text."""

import random

import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from engram.llm import queries, token_counts as T

JSON = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    alphabet = "abc  de1.,'\n\t  \x1c<|éß漢🙂_½"
    return ["", " ", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "a" * 5000, "don't stop 's 12 ½ x", "\n\n a  b", " lead",
            *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(2000))]


def test_pieces_add_up_to_the_library():
    library = Tokenizer.from_file(JSON)
    whole = T.Counter("json", open(JSON, "rb").read())
    assert whole.cut
    rng = random.Random(4)
    longer = ["".join(rng.choices(texts()[8:], k=40)) for _ in range(60)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts() + longer]
    for batch, chars in ((1 << 18, 1 << 15), (50, 1), (1, 7)):
        assert whole.count(pa.array(texts() + longer), batch, chars).tolist() == want
    cut = [list(T.pieces(t, 5)) for t in longer]
    assert ["".join(c) for c in cut] == longer and sum(map(len, cut)) > 500


def test_only_safe_vocabularies_are_cut():
    safe = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True}, "added_tokens": [{"content": "<x>"}]}
    assert T.divisible(safe)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None},
                   {"added_tokens": [{"content": "<x>", "lstrip": True}]}, {"added_tokens": [{"content": "a b"}]}):
        assert not T.divisible(safe | change)


def test_table(spark):
    library = Tokenizer.from_file(JSON)
    rows = [(1, "The cat sat."), (1, "The cat sat."), (2, None), (None, "é<|endoftext|>"), (3, ""), (4, "word " * 30000), (5, "a" * 600), (6, ("a b " * 256).strip())]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_tokens string")
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    want = sorted([(i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n)], key=str)
    for size in (T.BATCH_BYTES, 1):
        got = T.token_counts(df, "doc_id", "text", JSON, batch_bytes=size)
        assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert 512 in n and dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert T.token_counts(df.limit(0), "doc_id", "text", JSON).count() == 0


def test_other_vocabularies(spark):
    df = spark.createDataFrame([(1, "The cat <s> sat 漢."), (2, None), (3, "Ab  Cd " * 9000)], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(df, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in kept.items()}
    words = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(words)
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(df, "doc_id", "text", words).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in kept.items()}


def test_fixture(spark):
    library = Tokenizer.from_file(JSON)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op13(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        n = len(library.encode(d["text"], add_special_tokens=False).ids)
        assert got[d["doc_id"]] == (len(d["text"].encode()), n, n > 512)
