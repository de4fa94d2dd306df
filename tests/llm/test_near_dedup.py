"""Near-duplicate groups against all pairs of plain Python sets."""

import random
import re

import pytest
from docloom.llm import near_dedup
from docloom.llm.lineage import staged
from docloom.llm.near_dedup import components, near_groups, needed, without_near_copies
from docloom.sources.files import Files, shared_root

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, threshold):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-12 and root(a) != root(b):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(draw, size, base, edits):
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(draw.choice(edits)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: f"t{draw.randrange(4000)}"
    texts = family(draw, 150, [word() for _ in range(120)], [0, 1, 1, 2, 2, 3, 4, 6])
    passage = [word() for _ in range(60)]
    for _ in range(60):  # a passage that makes up most of many texts that are otherwise their own
        texts.append(" ".join([word() for _ in range(25)] + passage + [word() for _ in range(draw.randrange(25))]))
    for n in (2, 3, 9, 12):
        texts += family(draw, n, [word() for _ in range(draw.randrange(8, 200))], [0, 0, 1, 2])
    chain = [word() for _ in range(100)]
    for k in range(14):  # each near the next one only
        texts.append(" ".join(chain[2 * k :] + [f"c{i}" for i in range(2 * k)]))
    texts += ["", " \n", None, "One two", "one TWO", "one two three", "É é", "é é", *texts[:5], texts[1].upper()]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "threshold", "small"), [(1, 0.85, 8), (2, 0.8, 2)])
def test_against_all_pairs(spark, seed, threshold, small):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in near_groups(df, threshold=threshold, small_list=small).collect()}
    expected = brute(rows, threshold)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_families_of_copies_stay_linear(spark, monkeypatch):
    """Edited copies of one text: what the joins form at production parameters grows with the family, and nothing is lost."""
    formed = {}

    def counted(df, name):
        out = staged(df, name)
        formed[name] = formed.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "staged", counted)
    sizes = []
    for n in (200, 400):
        draw = random.Random(n)
        rows = list(enumerate(family(draw, n, [f"t{draw.randrange(4000)}" for _ in range(120)], [1, 2, 3, 4])))
        formed.clear()
        got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.85).collect()
        sizes.append(sum(formed[x] for x in ("likely", "keys", "pairs")))
        assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute(rows, 0.85).items()}
    assert max(sizes) < 20 * 400


def test_near_texts_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words, "more"]), " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(None, a, 1), (None, b, 2), (None, c, 3), (9, c + " y", 4), (9, a + " z", 5), (None, None, 6)], "doc_id long, text string, _row int")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_groups(df).collect()}
    assert got == {(None, 56): 9, (None, 57): 9, (9, 57): 9, (None, 36): 9, (9, 37): 9, (None, 0): None}
    kept = without_near_copies(df)
    assert kept.columns == df.columns and sorted(r._row for r in kept.collect()) == [4, 5, 6]


def test_edges(spark):
    schema = "doc_id long, text string, n string, values int, fp string"
    assert near_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", "x", 1, "y"), (1, "a b c d e f", "x", 1, "y"), (None, "a b c d e f", None, None, None), (None, None, None, None, None), (4, "z", "x", 1, "y")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, near_groups(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (4, 1, 4, True)], key=str)
    kept = without_near_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]


def test_needed():
    assert needed(48, 0.85) == 24 and needed(1, 0.85) == 1


def test_components_keep_one_table(spark):
    """A chain needs several rounds; the tables of all but the last are removed."""
    folder = Files(spark, f"{shared_root(spark)}/docloom")
    before = set(folder.names(""))
    found = components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long"))
    assert {r.node: r.label for r in found.collect()} == {**dict.fromkeys(range(41), 0), 90: 90, 91: 90}
    assert [n.split("-")[0] for n in set(folder.names("")) - before] == ["labels"]
