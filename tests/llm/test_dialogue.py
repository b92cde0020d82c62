"""Conversation repair against a plain forward search, on random conversations, cut ones and odd rows."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from engram.llm import dialogue as D, queries


def plain(rows):
    """(cost, audit) of (initial, fault) rows by trying all edits, state by state."""
    far, nothing = 10 ** 9, (10 ** 9, "")
    after = {"s": 1, "u": 2, "a": 3}
    goes = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    def inserted(now):
        for _ in range(3):
            for old in range(4):
                for new in goes[old]:
                    if new != 1 and now[old][0] < far:
                        now[new] = min(now[new], (now[old][0] + 3, now[old][1] + "I"))
        return now

    now = inserted([(0, ""), nothing, nothing, nothing])
    for initial, fault in rows:
        then = [(c + 4, a + "D") for c, a in now]
        if fault in "-t":
            extra = 3 if fault == "t" else 0
            for old in range(4):
                for new in goes[old]:
                    c, a = now[old]
                    if after.get(initial) == new:
                        then[new] = min(then[new], (c + extra, a + "K"))
                    if new != 1:
                        then[new] = min(then[new], (c + 3 + extra, a + "R"))
        now = inserted([x if x[0] < far else nothing for x in then])
    return min(now[0], now[3])


def random_rows(rng, n):
    return [(rng.choice("suauauo"), rng.choice("---btd")) for _ in range(rng.randint(0, n))]


def test_search_equals_the_plain_version():
    rng = random.Random(4)
    for _ in range(1500):
        rows = random_rows(rng, 9)
        got = D.best_edits("".join(r for r, _ in rows), "".join(f for _, f in rows))
        assert got == plain(rows), rows


def test_stretches_join_to_the_same():
    rng = random.Random(5)
    for _ in range(150):
        rows = random_rows(rng, 14) or [("u", "-")]
        size, tables = rng.randint(1, 4), []
        for i in range(0, len(rows), size):
            roles, faults = ("".join(x) for x in zip(*rows[i:i + size]))
            tries = {(e, x): D.best_edits(roles, faults, e, (x,)) for e in range(4) for x in range(4)}
            tables.append({k: v for k, v in tries.items() if v})
        assert D.joined_edits(tables) == plain(rows), (rows, size)


def brute(rows):
    """Contract of op11 for rows (turn, role, text) of one conversation after damage."""
    white = " \t\n\x0b\x0c\r"
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, coded = set(), []
    for _, role, text in rows:
        fault = "b" if not text.strip(white) else "d" if (role, text) in seen else "t" if text.rstrip(white)[-1] not in ".!?" else "-"
        seen.add((role, text))
        coded.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(coded, coded[1:]))
    cost, audit = plain(coded)
    lines, i, last = [], 0, ""
    for letter in audit:
        if letter in "KR":
            last = coded[i][0] if letter == "K" else "a" if last == "u" else "u"
            lines.append((rows[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[last]) + ":" + rows[i][2])
        elif letter == "I":
            last = "a" if last == "u" else "u"
            lines.append({"u": "user:", "a": "assistant:"}[last])
        i += letter != "I"
    count = lambda f: sum(x == f for _, x in coded)
    return gaps, count("b"), count("d"), count("t"), illegal, cost, audit, "\n".join(lines)


def odd_rows():
    rng = random.Random(6)
    texts = ["Yes.", "No", " \t\n", "", None, "漢。", "so?  \n", "x" * 5000 + "!", "A.\nB", "　"]
    rows = []
    for conv in [None, *range(12)]:
        for _ in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["system", "user", "assistant", "user", "assistant", "", None, "tool", "User"]), rng.choice(texts)))
    return rows + rows[:5] + [(50, t, r, f"{t}.") for t, r in enumerate(["system"] + ["user", "assistant"] * 20)]


def test_tables_equal_the_plain_version(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, n string, conv int")
    for stretch in (1024, 3):
        summary, repaired = D.repair(df, stretch=stretch)
        lines = {}
        for r in sorted(repaired.collect(), key=lambda r: (r["conv"] is not None, r["conv"] or 0, r["place"])):
            lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
        hashes = {r["conv"]: r["repaired_sha256"] for r in D.digests(repaired).collect()}
        got = {r["conv"]: tuple(r)[1:] for r in summary.collect()}
        want = {c: brute([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
        assert {c: (*v, "\n".join(lines.get(c, []))) for c, v in got.items()} == want
        assert hashes == {c: hashlib.sha256(w[-1].encode()).hexdigest() for c, w in want.items() if w[-1]}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    summary, repaired = D.repair(df)
    assert summary.count() == 0 and D.digests(repaired).count() == 0


def test_query_with_odd_rows(spark, tmp_path):
    rows = odd_rows() + [(77, 0, "user", "Gone.")]
    assert zlib.crc32(b"77:0") % 20 != 0
    dropped = next(c for c in range(100, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11(spark, str(tmp_path)).collect()}
    after = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        after[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    want = {}
    for conv, left in after.items():
        *counts, lines = brute(left) if left else (0, 0, 0, 0, 0, 0, "", "")
        want[conv] = (*counts, hashlib.sha256(lines.encode()).hexdigest())
    assert got == want and got[dropped][:7] == (0, 0, 0, 0, 0, 0, "")
