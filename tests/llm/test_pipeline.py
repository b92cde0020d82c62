"""The pipeline against a plain version of each stage on its own input, and the registry."""

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
import sentencepiece

from engram.llm import line_dedup, pipeline
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_layout_and_search import brute_lines
from tests.llm.test_near_duplicates import brute as near

SF = "/root/testdata/sf0.001"


def plain_documents(texts):
    """Plain version of line_dedup.dedup_documents: earlier lines go; exact copies go whole, and documents that lost lines and keep
    nothing but white space or short lines which all stand earlier."""
    cut, seen, short, out = brute_lines(list(texts.items())), set(), set(), {}
    long = lambda line: len(line.strip(" ")) >= line_dedup.MIN_CHARS
    for i, text in sorted(texts.items()):
        copy = text in seen and bool(text.strip())
        lines = text.split("\n")
        fresh = {x for x in lines if not long(x) and x.strip()} - short
        short |= fresh
        seen.add(text)
        left = cut[i]
        if not copy and (left == text or left.strip() and (any(map(long, left.split("\n"))) or fresh)):
            out[i] = left
    return out


def test_stages_follow_the_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    junk = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        if name == "tokens":
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {r["doc_id"]: r["ids"] for r in rows} == {i: sp.encode(t) for i, t in kept.items()}
            break
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality":
            assert not junk & set(got) and len(good - set(got)) <= 1
            want = {i: t for i, t in kept.items() if i in got}
        elif name == "line_dedup":
            want = plain_documents(kept)
        elif name == "near_duplicates":
            want = {i: kept[i] for i, (_, c) in near(list(kept.items()), 5, 80).items() if i == c}
        else:
            want = {i: kept[i] for i, h in hits(list(kept.items()), bench, 10).items() if not h[1]}
        assert got == want, name
        kept = got


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a), (5, a), (5, b), (4, b), (None, a), (None, "lone words that stand in no other text"), (None, "Lone words that stand in no other text"), (6, None), (6, ""), (None, None), (7, a.upper())]
    docs = spark.createDataFrame([(i, t, "k", "x", 1) for i, t in rows], "doc_id long, text string, doc string, __n string, th int")
    out = pipeline.near_stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted([(r["doc_id"], (r["text"] or "").lower()) for r in out.collect()], key=str)
    assert got == sorted([(5, a), (4, b), (None, "lone words that stand in no other text"), (6, ""), (6, ""), (None, "")], key=str)


def test_decontamination_with_clashing_names_and_missing_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").first()["text"]
    rows = [(1, item), (1, "clean text"), (None, item), (None, "clean too"), (2, None)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, doc string, item int")
    got = pipeline.decontamination_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted([(1, "clean text"), (None, "clean too"), (2, None)], key=str)


def test_no_stub_of_a_copy_is_left(spark):
    a, b = "the first long line of a text", "another line which is long enough"
    texts = {1: f"{a}\nshort\n{b}", 2: f"{a}\n\n{b}", 3: f"{a}\n\u3000\t\n{b}\n", 4: "tiny\ntext", 5: "", 6: None, 7: f"{a}\nunseen\n{b}"}
    copies = {i + 10 * k: t for k in range(3) for i, t in texts.items() if i != 7 or k}   # 7 itself comes later, with a short line of its own
    copies |= {40: f"{b}\nshort", 41: f"{a}\nshort\nlast one", 42: "tiny"}
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in copies.items()], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.line_stage(spark, docs, SF).collect()}
    same = [1, 4, 5, 15, 25, 42]
    assert got == {i: (copies[i], len(copies[i])) for i in same} | {i: (None, 0) for i in (6, 16, 26)} | {17: ("unseen", 6), 41: ("short\nlast one", 14)}


def test_fixture_copies_end_with_the_first(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {}
    for i, t in sorted((r["doc_id"], r["text"]) for r in docs.filter("trim(text) <> ''").collect()):
        first.setdefault(t, []).append(i)
    got = {r["doc_id"] for r in pipeline.line_stage(spark, docs, SF).collect()}
    assert not got & {i for ids in first.values() for i in ids[1:]}


def test_later_stages_follow_the_plain_versions_without_copies(spark):
    docs = pipeline.line_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).cache()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = pipeline.near_stage(spark, docs, SF).cache()
    kept = {i: kept[i] for i, (_, c) in near(list(kept.items()), 5, 80).items() if i == c}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept
    docs = pipeline.decontamination_stage(spark, docs, SF).cache()
    kept = {i: kept[i] for i, h in hits(list(kept.items()), bench, 10).items() if not h[1]}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["ids"] for r in pipeline.token_stage(spark, docs, SF).collect()} == {i: sp.encode(t) for i, t in kept.items()}
