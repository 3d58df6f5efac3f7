import random

import numpy as np

from loomspan.llm.suffix import Strings, common_prefixes, repeated, suffix_array


def test_against_sorting():
    r = random.Random(3)
    for trial in range(200):
        parts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 8))]
        parts += parts[:2] if trial % 3 == 0 else []
        s = Strings.of(parts)
        order = suffix_array(s)
        want = sorted((p[j:], i, int(s.offsets[i]) + j) for i, p in enumerate(parts) for j in range(len(p)))
        assert order.tolist() == [x[2] for x in want]
        lcp = common_prefixes(s, order)
        for k in range(1, len(want)):
            a, b, m = want[k - 1][0], want[k][0], 0
            while m < min(len(a), len(b)) and a[m] == b[m]:
                m += 1
            assert lcp[k] == m
        suffix = {x[2]: x[0] for x in want}
        flags, first = repeated(s, order, lcp, 3)
        for p, f in enumerate(flags):
            assert f == (len(suffix[p]) >= 3 and sum(q[:3] == suffix[p][:3] for q in suffix.values()) > 1)
        assert len({suffix[p][:3] for p in first}) == len(first) == len({q[:3] for q in suffix.values() if len(q) >= 3})


def test_empty():
    s = Strings.of([])
    assert len(suffix_array(s)) == len(common_prefixes(s, suffix_array(s))) == 0


def test_copies_count_as_places():
    parts = [b"abcabd", b"xyzzy", b"yzz"]
    s = Strings.of(parts)
    order = suffix_array(s)
    flags, _ = repeated(s, order, common_prefixes(s, order), 3, np.array([2, 1, 1]))
    assert flags.tolist() == [True] * 4 + [False] * 3 + [True] + [False] * 3 + [True] + [False] * 2
