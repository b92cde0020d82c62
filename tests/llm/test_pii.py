"""Base spans against Python's regular expressions; added spans; edge cases."""

import random
import re

from engram.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for order, (kind, p) in enumerate(BASE.items(), 1):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(4)
    alphabet = ["a", "Z9", "@", ".", "é", "🙂", " ", "-", "+", "1", "25", "0", "(", ")", "_", "192.168.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "x.y@mail.example.com", "\n", "%"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return out + [None, "", "7" * 20000, "a" * 20000 + "@b.c", "1." * 5000, "@" * 300, "x@y.z_q@w.v", "1.2.3.4.5.6.7.8", "x@a.b@c.d", "000000000000000000001.2.3.4", "9" * 400 + ".1.1.1"]


def test_base_spans_equal_regular_expressions(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in pii.scan(df).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = brute(t)
        assert [tuple(x) for x in got[i]["base_spans"]] == want, (t, want)
        assert set(want) <= {tuple(x) for x in got[i]["spans"]}
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[2] == k for w in want) for k in pii.KINDS]


def test_added_spans_and_edges(spark):
    clean = [(i, f"call us at 555-010-{1000 + i} or mail a{i}.b@site.com today, tel: +1 (555) 010-{2000 + i}") for i in range(40)]
    extra = [(100, "phone: (555) 010-7788 now"), (101, "reach joe.doe [at] site [dot] com soon"), (None, "mail q@r.com"), (102, None), (103, ""), (104, "mail q@r.com"), (104, "mail q@r.com")]
    df = spark.createDataFrame(clean + extra, "doc_id long, text string")
    rows = pii.scan(df).collect()
    assert len(rows) == len(clean) + len(extra)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [len(r["spans"]) for r in by[102] + by[103]] == [0, 0]
    assert by[None][0]["n_email"] == 1 and [r["n_email"] for r in by[104]] == [1, 1]
    assert [(x["kind"], x["s"], x["e"]) for x in by[100][0]["spans"]] == [("phone", 7, 21)]
    assert len(by[0][0]["spans"]) == 3 and len(by[0][0]["base_spans"]) == 2


def test_empty_table(spark):
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reliabilities_find_the_bad_labeler():
    # four labelers tell the truth nine times in ten, one votes at random
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = tuple(int(y if rng.random() < 0.9 else not y) for _ in range(4)) + (rng.randint(0, 1),)
        counts[v] = counts.get(v, 0) + 1
    post = pii.reliabilities([("ip", v, n) for v, n in counts.items()])
    assert post[("ip", (1, 1, 1, 1, 0))] > 0.95 and post[("ip", (0, 0, 0, 0, 1))] < 0.05
    assert abs(post[("ip", (1, 1, 0, 1, 0))] - post[("ip", (1, 1, 0, 1, 1))]) < 0.1
