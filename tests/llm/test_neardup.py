"""Near duplicates against comparing all pairs of sets."""

import random
import re
from collections import Counter

from llm_rows import clashing, documents, empty, ordered, plan, prose  # noqa: F401

from shelfline.llm import neardup
from shelfline.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text):
    words = re.findall(rb"[^ \t-\r]+", (text or "").encode().translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def linked(rows, percent=85):
    """(set, number of its component) of each row."""
    sets = [shingles(text) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [(s, find(i)) for i, s in enumerate(sets)]


def plain(rows, percent=85):
    found = linked(rows, percent)
    least = {}
    for (doc_id, *_), (_, root) in zip(rows, found, strict=True):
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    out = [(r[0], len(s), least.get(root), r[0] == least.get(root)) for r, (s, root) in zip(rows, found, strict=True)]
    return sorted(out, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def kept(rows, percent=85):
    """How often each id stays if one row of each component does, and all without words."""
    stay, groups = Counter(), {}
    for (doc_id, *_), (own, root) in zip(rows, linked(rows, percent), strict=True):
        if own:
            groups.setdefault(root, []).append((doc_id is None, doc_id or 0))
        else:
            stay[doc_id] += 1
    for ids in groups.values():
        none, doc_id = min(ids)
        stay[None if none else doc_id] += 1
    return stay


def test_messy_rows(documents, clashing, empty):
    want = plain([tuple(r) for r in documents.collect()])
    assert ordered(neardup.near_duplicates(documents)) == want
    assert ordered(neardup.near_duplicates(clashing)) == want
    assert neardup.near_duplicates(empty).count() == 0


def test_drifting_copies_and_a_large_group(spark, monkeypatch):
    """Copies of copies, each a little further off, so that links reach where similarity does not."""
    rng, rows, text = random.Random(5), [], prose(9, 200).split(" ")
    for i in range(80):
        rows.append((1000 - i, " ".join(text)))
        text = list(text)
        text[rng.randrange(len(text))] = f"w{i}"
    base = prose(10, 100).split(" ")
    for i in range(150):
        words = list(base)
        for k in range(rng.randint(0, 4)):
            words[rng.randrange(100)] = f"v{i}{k}"
        rows.append((2000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert ordered(neardup.near_duplicates(df)) == want
    monkeypatch.setattr(neardup, "UNIT_ROWS", 20)  # the group is many blocks
    assert ordered(neardup.near_duplicates(df)) == want


def test_sizes_that_can_match_share_a_unit(spark):
    sizes = [1, 2, 3, 4, 5, 13, 14, 15, 16, 17, 18, 19, 55, 63, 64, 70, 75, 76, 250, 256, 300, 301]
    nodes = spark.createDataFrame([(n, 0, n) for n in sizes], "node long, family long, n_shingles long")
    groups = {r.node: {u.sizes for u in r.units} for r in neardup._units(nodes, 85).collect()}
    for a in sizes:
        for b in sizes:
            if a < b and 100 * a >= 85 * b:
                assert groups[a] & groups[b], (a, b)


def test_one_of_each_group_stays(documents, clashing):
    out = neardup.keep_one(clashing)
    assert out.columns == clashing.columns
    want = kept([tuple(r) for r in documents.collect()])
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == want
    # 3, the second row of 2 and a copy without an id are near 1, 8 equals 7; 10's first text holds 1's but is not near it.
    assert want == Counter([1, 4, 5, 6, 7, 9, 10, 10, 11, 12, 13, None])


def test_repeated_and_missing_ids_stay_linear(spark):
    """20 000 equal rows of one id and 5000 different texts without one: no more rows on the way than there are."""
    base, other = prose(20, 60), prose(21, 120)
    near = " ".join(w if k != 30 else "x" for k, w in enumerate(other.split()))
    rows = [(7, base)] * 20_000 + [(None, prose(10_000 + i, 8)) for i in range(5000)] + [(1, other), (None, near), (8, base), (8, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    made, real = [], neardup.components

    def counted(links):
        found = real(links)
        made.append(links.count())
        return found

    neardup.components = counted
    try:
        out = Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect())
    finally:
        neardup.components = real
    assert out[7, 7] == 20_000 and out[8, 7] == out[8, 8] == out[1, 1] == out[None, 1] == 1
    assert max(made) < 100
    left = Counter(r.doc_id for r in neardup.keep_one(docs).collect())
    assert left == Counter({7: 1, None: 5000, 1: 1, 8: 1})


def test_pruning_is_by_posterior():
    steps = dict(neardup.least_matches(85, 1e-7))
    assert steps[40] < 0.85 * 40 and steps[240] > steps[40]
    assert all(least <= 0.85 * n for n, least in steps.items())


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 400)] + [(500, 500)]
    rows = components(spark.createDataFrame(links, "a long, b long"))
    found = dict(map(tuple, rows.collect()))
    assert found == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 400)}}
    assert "CartesianProduct" not in plan(rows)
