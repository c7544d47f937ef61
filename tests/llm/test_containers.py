from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import containers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_no_sequence_overflows(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    place = containers.assign(sizes, 50)
    used = np.bincount(place, sizes) if len(sizes) else np.zeros(0)
    assert (used <= 50).all() and (used > 0).all()
    assert len(used) <= 1.5 * np.ceil(sizes.sum() / 50) + 1


def test_frames(spark):
    rng = np.random.default_rng(3)
    sizes = [*rng.integers(1, 700, 3000).tolist(), 0, 0, 5000, 1023, 1024, 2048, None]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)] + [(7, 100, 1)], "doc_id bigint, n_tokens bigint, n bigint")
    rows = containers.pack(df, group=1000).collect()
    spans, of = defaultdict(list), defaultdict(int)
    for r in rows:
        spans[r.sequence].append((r.position, r.position + r.n))
        of[r.doc_id] += r.n
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= containers.CAPACITY
        assert all(a[1] == b[0] for a, b in zip(s, s[1:]))
    expected = defaultdict(int)
    for i, s in [*enumerate(sizes), (7, 100)]:
        if s is not None:
            expected[i] += s + containers.FRAME
    assert of == expected
    cut = {r.doc_id for r in rows if r.fragment > 0}
    assert cut == {i for i, s in enumerate(sizes) if s is not None and s + 2 > containers.CAPACITY}
    filled = sum(expected.values()) / (len(spans) * containers.CAPACITY)
    assert filled > 0.97
    report = containers.report(containers.pack(df, group=1000)).first()
    assert report.sequences == len(spans) and report.fullest <= containers.CAPACITY
    assert containers.pack(df.limit(0)).count() == 0
