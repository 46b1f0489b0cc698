"""Snapshot collapse and license scan against plain loops."""

import pickle
import random
import re

from llm_rows import clashing, documents, empty, ordered  # noqa: F401
from pyspark.sql import functions as F

from shelfline.llm import chat, licenses, notices


def plain(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    talks = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in talks.items()}
    out = []
    for c, own in talks.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in talks.values())
        earlier = any(o == own and d < c for d, o in talks.items())
        if not longer and not earlier:
            out += [(c, n, len(own), f"<|{'unknown' if r is None else r}|>\n{t or ''}<|end|>\n") for n, (r, t) in enumerate(own, 1)]
    return sorted(out)


def test_snapshots_collapse(spark):
    rng, rows = random.Random(4), []
    for conv in range(60):
        start = [("user", f"q{rng.randrange(3)}"), ("assistant", f"a{rng.randrange(2)}"), (None, None), ("user", ""), ("unknown", "x"), ("user", None)]
        rows += [(conv, n, *turn) for n, turn in enumerate(start[: rng.randint(1, 6)])]
    rows += [(None, 1, "user", "q"), (70, None, "user", "first"), (70, 3, "user", "last"), (71, 1, "user", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.withColumns({c: F.lit("x") for c in ("n", "one", "two", "n_turns", "rendered", "_one")})
    assert ordered(chat.render(df)) == plain(rows) == ordered(chat.render(clash))
    assert chat.render(df.limit(0)).count() == 0



def test_copies_are_found(documents, clashing, empty, spark):
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0-notice"]
    broken = apache.replace("Licensed under", "// Licensed\n// under").replace("compliance", "accordance")
    rows = [
        (1, f"some text. {mit}"),
        (2, f"{mit} {mit}\nthe end {mit.upper()}"),
        (3, broken),
        (4, "the license is not here, under no version of the apache tribe"),
        (5, None),
        (6, ""),
        (None, mit),
        (7, " ".join(["under the license"] * 3000)),
        (8, "All rights reserved? " + apache + " All, rights; reserved!"),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = ordered(found, "doc_id", "license", "first_word", "end_word")
    assert [r[:2] for r in got if r[0] is None] == [(None, "mit")]
    names = [(r[0], r[1]) for r in got if r[0]]
    assert names == [
        (1, "mit"), (2, "mit"), (2, "mit"), (2, "mit"), (3, "apache-2.0-notice"), (8, "apache-2.0"), (8, "apache-2.0-notice"),
        (8, "reserved"), (8, "reserved"),
    ] or names == [(1, "mit"), (2, "mit"), (2, "mit"), (2, "mit"), (3, "apache-2.0"), (3, "apache-2.0-notice"), (8, "apache-2.0"), (8, "apache-2.0-notice"), (8, "reserved"), (8, "reserved")]
    assert [r[2:] for r in got if r[0] == 1] == [(2, 7)]
    assert licenses.scan(documents).count() == licenses.scan(clashing).count() == 0
    assert licenses.scan(empty).count() == 0 and licenses.scan(documents, templates={}).count() == 0


def test_common_licenses(spark):
    """Whole texts, notices and lines; of versions of a license only the right one."""
    texts, said = notices.texts(), notices.notices()
    gpl = texts["gpl-3.0-text"].replace("free", "libre").splitlines()
    rows = [
        ("gpl-3.0-text", "\n".join(f" * {line}" for k, line in enumerate(gpl) if k % 50)),
        *[(name, f"Copyright 2020 A. Nobody\n{text}\nmore words") for name, text in texts.items()],
        *[(name, f"before {text} after") for name, text in said.items()],
        *[(name, f"before {text} after") for name, text in licenses.TEMPLATES.items()],
    ]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {}
    for r in licenses.scan(docs.repartition(8)).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    plain_words = lambda text: f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "
    spelled = {name: plain_words(text) for name, text in licenses.known().items()}
    for i, (name, text) in enumerate(rows):
        assert name in found[i], name
        # What a text holds word for word is there too, but nothing that is only alike.
        inside = {n for n, words in spelled.items() if words in plain_words(text) and ("spdx" not in n or n == name)}
        assert found[i] <= inside | {name} | ({"apache-2.0-notice"} if "apache" in name else set()), (name, found[i])
    either = "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0 OR GPL-2.0-or-later AND Apache-2.0) MIT-0"
    got = licenses.scan(spark.createDataFrame([(1, either), (2, "All rights of the GPL are free text")], docs.schema)).collect()
    want = [(1, f"spdx:{name}") for name in ("Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "MIT")]
    assert sorted((r.doc_id, r.license) for r in got) == want
    assert len(pickle.dumps(licenses.Scanner(licenses.known(), 0.9))) < 1 << 20  # goes to each task


def test_seeds_miss_no_copy():
    """With and without the choice of rare words the same texts have copies."""
    rng = random.Random(8)
    scanner = licenses.Scanner({"t": "a b c a d e f g h i"}, 0.8)
    template = scanner.templates["t"]
    import numpy as np

    for _ in range(300):
        text = [rng.choice(template) if rng.random() < 0.5 else -1 for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            own = list(template)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(10)] = -1
            text[5:5] = own
        found = scanner.find(np.array(text, dtype=np.int64))
        for _, matched, begin, end in found:
            assert matched >= 8 and len(licenses.align(template, text[begin:end])) >= 1
        planted = any(sum(x == y for x, y in zip(text[a : a + 10], template, strict=False)) >= 8 for a in range(len(text)))
        if planted:
            assert found


def test_patience_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        values = rng.sample(range(30), rng.randint(0, 12))
        best = [1] * len(values)
        for i in range(len(values)):
            best[i] += max((best[j] for j in range(i) if values[j] < values[i]), default=0)
        found = [values[i] for i in licenses.increasing(values)]
        assert found == sorted(found) and len(found) == max(best, default=0)
