"""Exact duplicates and source mixing against plain Python."""

import collections
import hashlib
import random
import re

import pytest
from docloom.llm.exact_dedup import exact_groups, without_exact_copies
from docloom.llm.mixing import mix, mixed_documents, seats
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize(("keep", "best", "fan_in_bits"), [("smallest", min, 1), ("largest", max, 2), ("largest", max, 5)])
def test_exact_groups(spark, keep, best, fan_in_bits):
    draw = random.Random(3)
    texts = ["", None, "A", "a", "Ä", "ä", "x y", "X y", "long " * 3000]
    rows = [(i, draw.choice(texts) if i % 3 else "hot") for i in range(400)]
    got = {r.doc_id: r for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(11), keep=keep, fan_in_bits=fan_in_bits).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    for i, t in rows:
        g, r = groups[low(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best(g), len(g), best(g) == i, hashlib.sha256(low(t).encode()).hexdigest())


def test_exact_edges(spark):
    schema = "doc_id long, text string, _kept_id int, _KEPT_SHA string"
    assert exact_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a", 1, "x"), (5, "a", 1, "x"), (None, "A", 2, None), (None, None, None, None), (7, "b", 0, "y")]
    df = spark.createDataFrame(rows, schema)
    got = exact_groups(df, keep="largest").collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3 and {r.group_size for r in got if r.keep_id == 5} == {3}
    kept = without_exact_copies(df, keep="largest")
    assert kept.columns == df.columns and sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4]]))


def sequential(votes, n):
    given = [0] * len(votes)
    for _ in range(n if sum(votes) > 0 else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[i] += 1
    return given


def test_seats(spark):
    draw = random.Random(1)
    cases = [([draw.choice([0.0, draw.random() * 100, 5.0, 10.0]) for _ in range(draw.randint(1, 9))], draw.randint(0, 60)) for _ in range(60)] + [([1.0] * 4, 2), ([3.0, 1.0], 2), ([0.0, 0.0], 5), ([5.0], 7)]
    df = spark.createDataFrame(cases, "v array<double>, n long")
    for r in df.select("v", "n", seats(F.col("v"), F.col("n")).alias("s")).collect():
        assert list(r.s) == sequential(list(r.v), r.n)


def targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """By resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, full, rest = share * sum(sizes.values()), {}, set(names)
    while rest:
        level = (goal - sum(full.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if w[s] * level > cap * sizes[s]]
        if not over:
            return {**full, **{s: w[s] * level for s in rest}}
        for s in over:
            full[s] = cap * sizes[s]
            rest.remove(s)
    return full


def test_mix(spark):
    draw = random.Random(9)
    rows = [(i, " ".join("w" * draw.randrange(1, 9) for _ in range(draw.randrange(120))) or None, draw.choice(["a", "b", "hot", "hot", "Z", "é", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mix(df, shard_words=3000, block_words=16).collect()
    again = {r.doc_id: r.taken for r in mix(df.repartition(7), shard_words=3000, block_words=16).collect()}
    text = {i: (len(WORD.findall(t or "")), s) for i, t, s in rows}
    sizes = collections.Counter()
    for n, s in text.values():
        sizes[s] += n
    aim, taken = targets(sizes), collections.Counter()
    for r in out:
        assert r.size == text[r.doc_id][0] and r.source_size == sizes[r.source] and r.target == pytest.approx(aim[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.taken == again[r.doc_id] == r.rounds * r.size + r.arc_words + r.wrap_words
        taken[r.source] += r.taken
    assert len(out) == len(rows)
    for s, n in taken.items():
        assert abs(n - aim[s]) <= 16 * 8
    mixed = mixed_documents(df, shard_words=3000, block_words=16)
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in dict((i, t) for i, t, _ in rows)[r.doc_id] and r.text
    assert mixed.columns == df.columns and {r.doc_id: words[r.doc_id] for r in out} == {r.doc_id: r.taken for r in out}


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string, size int, _p int"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, None, None, 1, 1), (None, "", None, 1, 1), (2, " ", "s", 1, 1)], schema)
    assert [r.taken for r in mix(df).collect()] == [0, 0, 0] and mixed_documents(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", 1, 1), (1, "a b", "s", 1, 1), (None, "c d e", "t", 1, 1)], schema)
    assert sum(r.taken for r in mix(df, block_words=1).collect()) in (10, 11) and mixed_documents(df, block_words=1).columns == df.columns


def test_rows_alike_are_taken_as_planned(spark):
    rows = [(i, f"t{i} " * (5 + i % 7), "s" if i % 3 else "t", i) for i in range(60)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int").repartition(3)
    planned = sum(r.taken for r in mix(df, block_words=8, shard_words=100).collect())
    given = mixed_documents(df, block_words=8, shard_words=100)
    assert given.columns == df.columns and sum(len(WORD.findall(r.text)) for r in given.collect()) == planned


def test_many_shards_go_down_a_tree(spark):
    """Shards beyond one array: quotas still add up to the source's, each near its share."""
    from docloom.llm import mixing

    rows = [(i, "w " * 20, "a") for i in range(900)]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = base.select(*mixing._sized(base, "doc_id", "text", "source"))
    flat, deep = ({r._id: r.taken for r in mixing._planned(sized, 1.5, 2.0, (5.0, 2.0, 1.0), 8, 300, 17, fan_out=f).collect()} for f in (512, 4))
    assert sum(flat.values()) == sum(deep.values()) and abs(sum(deep.values()) - 27000) <= 8
    assert all(0 <= t <= 40 for t in deep.values())
