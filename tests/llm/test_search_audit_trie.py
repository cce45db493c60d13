"""Top-k search, filter audit and conversation trie against plain Python on small hard cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import filter_audit, prefix_trie, topk_search

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_top_k(rows, k, asked):
    usable = [(r, i, [math.floor(256 * float(np.float32(x))) for x in v]) for r, (i, v, *_) in enumerate(rows)
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, i, q in usable:
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for s, j, c in usable if s != r and len(c) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)], i % 3) for i in range(400)]
    rows += [(400 + i, rows[50][1], 0) for i in range(60)]  # a very common vector: ties in numbers
    rows += [(100, rows[7][1], 1), (100, [0.5] * 12, None)]  # repeated ids
    rows += [(500, None, 0), (550, [], 0), (600, [], 1), (650, [0.1] * 11 + [None], 0), (700, [float("nan")] * 12, 0), (750, [float("inf")] * 12, 0)]
    rows += [(None, [0.9] * 12, 0), (800, [0.0] * 12, 0), (850, [-0.3] * 12, 0), (900, [1.0, 2.0, 3.0], 0), (-50, [0.25] * 12, 0), (950, [3e7] * 12, 0)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", row int, shard string").repartition(5)
    got = topk_search.top_k(frame, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top_k(rows, 5, lambda i: i % 50 == 0)
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [0.5, 0.5], 0)], VECTORS)
    assert topk_search.top_k(one, F.lit(True)).count() == 0  # its only candidate is itself
    assert topk_search.top_k(frame, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("n,m,dim", [(60, 3000, 32), (9, 4, 6), (5, 300, 1), (4, 90, 0)])
def test_max_score(n, m, dim):
    rng = np.random.default_rng(n)
    held = np.floor(rng.normal(0, 0.12, (m, dim)) * 256)
    held[: m // 8] = held[0]
    asked, same, ids = held[rng.integers(0, m, n)], rng.integers(-1, m, n), rng.permutation(m) // 2
    best = topk_search.max_score(asked, held, ids, same, 5)
    for q in range(n):
        want = sorted((-float(asked[q] @ held[j]), int(ids[j])) for j in range(m) if j != same[q])[:5]
        assert [(-s, i) for s, i, a in zip(best.score.tolist(), best.id.tolist(), best.query.tolist()) if a == q] == want


def test_very_large_components(spark):
    rows = [(0, [1e15, -2e15], 0), (1, [3e15, 1e3], 0), (2, [1e15, 1e15], 0), (3, [0.5, 0.25], 0), (4, [-1e30, 1.0], 0)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0, k=9)
    limit = (1 << 63) - 1
    cells = {i: [max(-limit - 1, min(limit, math.floor(256 * x))) for x in v] for i, v, _ in rows}
    want = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(cells[0], cells[i])))), i) for i in (1, 2, 3, 4))
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(i, -s) for s, i in want]


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    parts = {}
    for d, t, lang, *_ in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > first.get(text, d),
        }
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out = []
    for part, rows in parts.items():
        removed = {}
        for order in itertools.permutations("ABCDE"):
            alive = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in alive if f in r[0]], [r for r in alive if f not in r[0]]
                removed.setdefault(f, []).append(len(gone))
                out.append([part, "".join(order), step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                            sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f])
                alive = left
        for row in out:
            if row[0] == part:
                row[9] = sum(removed[row[9]])
    return sorted(map(tuple, out))


def test_filter_audit(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \t", "A B C", "#", "word " * 9000, " ".join(rng.choices(words, k=260)), " ".join(rng.choices(words[:40], k=260)), "É" * 50, "X" * 20000]
    texts += [" ".join(rng.choices(words, k=rng.randint(150, 260))) + rng.choice(["", " $", " LOUD" * 9]) for _ in range(25)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(150)]
    docs += [(3, texts[6], "en"), (3, texts[6], "en"), (None, texts[6], "en"), (None, texts[7], "de"), (-4, texts[6], "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, "m") for d in docs], "doc_id long, text string, lang string, part int, mask string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame, marks)
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    unlabelled = filter_audit.audit(frame, marks.limit(0)).agg(F.sum("good_lost").alias("g"), F.sum("toxic_lost").alias("t")).first()
    assert (unlabelled["g"], unlabelled["t"]) == (0, 0)


@pytest.mark.parametrize("n", [2, 3, 5])
def test_shapley_rows(n):
    """The least squares solution is the mean over all orders."""
    rng = random.Random(n)
    value = [0, *(rng.randint(-50, 50) for _ in range((1 << n) - 1))]
    for i, row in enumerate(filter_audit.shapley_rows(n)):
        total = 0
        for order in itertools.permutations(range(n)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += value[before | 1 << i] - value[before]
        assert sum(a * b for a, b in zip(row, value)) == total == Fraction(total)


def plain_trie(paths):
    """``paths``: id -> list of (role, text)."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)

    def below(key):
        found = [key]
        for k in found:
            found += kids.get(k, [])
        return found

    out = []
    for key, ids in members.items():
        nodes = below(key)
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in nodes if k)
        ends = ",".join(map(str, sorted(c for c in ids if len(paths[c]) == len(key))))
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(kids.get(key, [])),
                    sum(k not in kids for k in nodes), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations_of(rng):
    lines = [("user", "hi"), ("assistant", "hello"), ("user", "é"), ("assistant", ""), ("user", "bye"), (None, "x"), ("user", None)]
    rows = []
    for c in [*range(-7, 90), 1000, 1003, 5001, *range(6001, 6060, 5)]:
        # a third begins and goes on alike; lengths from one to many; some repeat others whole
        turns = lines[:5] if c % 3 == 0 else rng.choices(lines, k=rng.choice([1, 2, 3, 5, 12]))
        rows += [(c, t if t else (None if c % 2 else 0), *turn) for t, turn in enumerate(turns)]
    rows += [(5000, t, "user", f"long {t}") for t in range(150)]
    rows += [(8000 + c, t, "user", f"deep {t}" if t < 20 or c < 2 else f"own {c} {t}") for c in range(4) for t in range(30)]  # two equal ones, two that leave
    return rows + [(None, 0, "user", "nobody")]


def in_order(rows):
    plain = {}
    for c, turn, role, text in rows:
        if c is not None:
            plain.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in plain.items()}


def test_prefix_trie(spark, tmp_path):
    rows = conversations_of(random.Random(9))
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, n int").repartition(4)
    original = in_order(rows)
    got = prefix_trie.conversation_trie(frame)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(original)
    assert prefix_trie.conversation_trie(frame.limit(0)).count() == 0

    def rebuilt(c):
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        return original.get(base, [])[:h] + original[c][h:]

    paths = {c: rebuilt(c) for c in original}
    assert any(not turns for turns in paths.values())  # turnless ones are members of the root only
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op13_prefix_trie(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(paths)


def test_digest_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rng = random.Random(2)
    rows = [(c, rng.choice([0, 0, 0, c]), 1) for c in rng.sample(range(-5000, 5000), 900)]
    got = prefix_trie.ends_digest(spark.createDataFrame(rows, "conv_id long, k1 long, k2 long").repartition(6)).collect()
    want = {}
    for c, k, _ in sorted(rows):
        want.setdefault(k, []).append(str(c))
    assert {r["k1"]: r["ends_sha256"] for r in got} == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
