"""Hits against a direct search on a small fixture, proximity matches and edge cases."""

import random
import re

from engram.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def brute(docs, items, width):
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(width, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(k))
        out[i] = (len(w), len(hit), sorted(names))
    return out


def test_hits_equal_direct_search(spark):
    rng = random.Random(8)
    pick = lambda n: " ".join(rng.choice(["the", "of", "Ünder", "x9", "éa", "Cat", "b", "zz"]) for _ in range(n))
    items = [(k, pick(rng.choice([1, 2, 3, 9, 10, 11, 14]))) for k in range(30)] + [(77, None), (78, ""), (79, "!!"), (80, "the of the of the of the of the of the"), (81, "the of the of the of the of the of the"), (None, "zz zz")]
    docs = []
    for i in range(120):
        extra = rng.choice(items)[1] or ""
        docs.append((i, f"{pick(rng.randrange(0, 50))}, {extra.upper()}; {pick(rng.randrange(0, 5))}"))
    docs += [(900, None), (901, ""), (902, "..."), (903, "the of " * 3000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(d, "doc_id", "text", b, "item_id", "text").collect()}
    assert got == {i: (n, h, [k for k in names if k != "None"]) for i, (n, h, names) in brute(docs, items, 10).items()}


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    d = spark.createDataFrame([(1, item), (2, item.replace("gamma", "gamma also")), (3, "alpha filler " * 10 + "kappa"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontam.matches(d, "doc_id", "text", b, "item_id", "text", slop=2).select("doc", "near").distinct().collect()
    assert {(r["doc"], r["near"]) for r in got} >= {(1, False), (2, True)}
    assert not any(r["doc"] in (3, 4) for r in got)


def test_empty_tables_and_repeated_rows(spark):
    d, b = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    rows = decontam.contamination(d, "doc_id", "text", b, "item_id", "text").collect()
    assert len(rows) == 3 and [r["n_hit"] for r in rows] == [2, 2, 2]
    assert decontam.contamination(d.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0
    assert not any(r["contaminated"] for r in decontam.contamination(d, "doc_id", "text", b.limit(0), "item_id", "text").collect())


def test_ids_that_repeat_or_are_missing(spark):
    item = "a b c d e f g h i j"
    docs = [(1, item), (1, "x y z w"), (2, f"x {item}"), (None, item), (None, "x"), (None, None)]
    d = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, doc string, item int")
    b = spark.createDataFrame([(None, item), (7, "x y z w"), (7, "x"), (8, item.upper())], "item_id long, text string")
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["n_items"]) for r in decontam.contamination(d, "doc_id", "text", b, "item_id", "text").collect()], key=str)
    want = [(1, 10, 10, ["8"], 2), (1, 4, 4, ["7"], 1), (2, 11, 11, ["7", "8"], 3), (None, 10, 10, ["8"], 2), (None, 1, 1, ["7"], 1), (None, 0, 0, [], 0)]
    assert got == sorted(want, key=str)


def test_every_word_of_a_proximity_match_is_near(spark):
    item = [f"w{k}" for k in range(10)]
    moved = [*item[:4], item[5], item[4], *item[6:]]                 # two words change places
    broken = [*item[:4], "other", *item[5:]]                         # one word is missing
    rows = [(1, item), (2, moved), (3, broken), (4, ["lead", *moved, "end"]), (5, moved[:-1]), (6, item * 30)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    # counted from the rarest word, w4, the other words are one place off and w5 two
    for slop, near in ((0, set()), (1, set()), (2, {2, 4}), (3, {2, 4})):
        got = decontam.matches(d, "doc_id", "text", b, "item_id", "text", slop=slop).collect()
        assert {r["doc"] for r in got if not r["near"]} == {1, 6} and {r["doc"] for r in got if r["near"]} - {1, 6} == near
