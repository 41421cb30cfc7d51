import math
import re
from collections import Counter

import pytest

from skein.llm import ngrams as N

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("options", [{}, {"max_words": 300}, {"max_words": 3}, {"max_words": 1}])
def test_against_brute_force(spark, sample, odd, monkeypatch, options):
    monkeypatch.setattr(N, "HOT", 40)
    docs = sample.select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(3)
    rows = [(r.doc_id, WORD.findall((r.text or "").encode().lower())) for r in docs.collect()]
    one, two = Counter(w for _, x in rows for w in x), Counter(p for _, x in rows for p in zip(x, x[1:], strict=False))
    total = sum(one.values())
    want = []
    for d, x in rows:
        score, back = (math.log(one[x[0]] / total), 0) if x else (0.0, 0)
        for v, w in zip(x, x[1:], strict=False):
            if two[v, w] >= N.MIN_COUNT:
                score += math.log(two[v, w] / one[v])
            else:
                score, back = score + math.log(N.BACKOFF * one[w] / total), back + 1
        want.append((str(d), len(x), back, score))
    got = sorted((str(r.doc_id), r.n_words, r.n_backoff, r.log_score, r.mean_log_score) for r in N.stupid_backoff(docs, **options).collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-6)
        assert (g[4] is None) == (g[1] == 0)


def test_empty_table(nothing):
    assert N.stupid_backoff(nothing).collect() == []
