import random
import re

import numpy as np
from kinmark.llm import license_scan as ls

from .cases import awkward, empty, prose


def shingles(text):
    w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", text.lower())
    return [tuple(w[i : i + ls.WIDTH]) for i in range(max(1, len(w) - ls.WIDTH + 1))] if w else []


def brute(text):
    """Best containment of each template over all windows of its class's length, at every word."""
    own, out = shingles(text), {}
    for i, (_, t) in enumerate(ls.TEMPLATES):
        want = set(shingles(t))
        span = ls.LEAST_CLASS
        while span < len(want) + ls.WIDTH - 1:
            span *= 2
        best = max((len(want & set(own[a : a + span])) / len(want) for a in range(max(1, len(own)))), default=0)
        if best >= ls.CONTAINMENT:
            out[i] = best
    return out


def test_every_contained_template_is_found(spark):
    r = random.Random(1)
    rows = []
    for i in range(120):
        text = prose(r.randint(0, 150), i)
        if i % 3:
            words = r.choice(ls.TEMPLATES)[1].split()
            if i % 3 == 2 and len(words) > 30:
                words[r.randrange(len(words))] = "changed"
            text += "\n" + " ".join(words) + "\n" + prose(r.randint(0, 150), 1000 + i)
        rows.append((i, text))
    got = {}
    for m in ls.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(m.doc_id, []).append(m)
    for i, text in rows:
        want = brute(text)
        assert (i in got) == bool(want)
        if want:
            # Overlapping templates leave the best one.
            top = max(want.values())
            assert any(np.isclose(m.containment, top) and m.template in want for m in got[i])


def test_spans_are_the_notices(spark):
    text = prose(40, 1) + " Released under the MIT License. " + prose(40, 2) + "\nLicensed under the Apache License, Version 2.0. é " + prose(9, 3) + " Licensed under CC BY-NC 4.0."
    got = ls.license_matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(m.license, text[m.start : m.end]) for m in got] == [("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0")]


def test_bands_guarantee():
    for s in (0.1, 0.2, 0.5, 0.9):
        b = ls.bands_needed(s, ls.CERTAINTY)
        assert 1 - (1 - s) ** b >= ls.CERTAINTY > 1 - (1 - s) ** (b - 1)


def test_awkward_and_empty(spark):
    assert ls.license_matches(awkward(spark)).count() == 0
    assert ls.license_matches(empty(spark)).count() == 0
    assert ls.license_matches(awkward(spark), templates=[]).count() == 0
    notice = "Released under the MIT License."
    rows = spark.createDataFrame([(1, prose(60_000, 1) + " " + notice), (2, notice), (2, notice), (None, notice)], "doc_id long, text string")
    assert sorted(str(m.doc_id) for m in ls.license_matches(rows).collect()) == ["1", "2", "2", "None"]


def test_dual_adjacent_and_repeated_notices(spark):
    r = random.Random(7)
    rows, want = [(0, "Licensed under the MIT License. Licensed under the Apache License, Version 2.0.")], {0: [("MIT", 0, 30), ("Apache-2.0", 32, 78)]}
    english = "of the work in the shop to the river and in the of any kind of the other to any person at the time "
    for i in range(1, 60):
        text, spans = english * r.randint(0, 2), []
        for k in [r.randrange(len(ls.TEMPLATES)) for _ in range(r.randint(1, 4))] * (1 + i % 2):
            name, notice = ls.TEMPLATES[k]
            words = [m.span() for m in re.finditer(r"[0-9A-Za-z]+", notice)]
            spans.append((name, len(text) + words[0][0], len(text) + words[-1][1]))
            text += notice + r.choice([" ", "\n\n", " " + english * r.randint(1, 3)])
        rows.append((i, text))
        want[i] = spans
    got = {}
    for m in sorted(ls.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda m: m.start):
        got.setdefault(m.doc_id, []).append((m.license, m.start, m.end))
    assert got == want


def test_tightest_stretches_against_brute_force():
    r = np.random.default_rng(5)
    for _ in range(300):
        own, want = r.integers(0, 12, r.integers(1, 30)).astype(np.uint64), np.arange(r.integers(1, 7), dtype=np.uint64)
        need = int(r.integers(1, len(want) + 1))
        reach = {(i, j) for i in range(len(own)) for j in range(i, len(own)) if len(set(own[i : j + 1].tolist()) & set(want.tolist())) >= need}
        least = sorted((i, j) for i, j in reach if (i + 1, j) not in reach and (i, j - 1) not in reach)
        got = ls.tightest(own, want, need)
        assert got == least
        full = {int(v): int(r.integers(1, 3)) for v in want}
        for i, j in got:
            size = max(sum(full.values()), j - i + 1)
            score = lambda x, y: (len(set(own[x : y + 1].tolist()) & set(full)), sum(min(own[x : y + 1].tolist().count(v), n) for v, n in full.items()))  # noqa: B023, E731
            around = [(x, y) for x in range(i + 1) for y in range(j, len(own)) if y - x < size]
            x, y = ls.widened(own, (i, j), full)
            assert (x, y) in around and score(x, y) == max(score(*s) for s in around)
