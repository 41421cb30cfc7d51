import random

from skein.llm import license as L

PHRASES = [tuple(p.encode().split()) for p in L.PHRASES]


def brute_places(w):
    return sorted((i, n) for n, p in enumerate(PHRASES) for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)


def test_matching_statistics():
    s = L.scanner(L.PHRASES, L.NOTICES)
    texts = [L.words(t.encode()) for t in [*L.PHRASES, *L.NOTICES.values()]]
    parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(1)
    for _ in range(100):
        w = []
        while len(w) < 50:
            t = rng.choice(texts)
            i = rng.randrange(len(t))
            w += t[i : i + rng.randrange(1, 18)] + [b"zzz"] * (rng.random() < 0.3)
        longest = [max((k for k in range(1, i + 2) if tuple(w[i - k + 1 : i + 1]) in parts), default=0) for i in range(len(w))]
        want = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= L.MIN_MATCH and (i + 1 == len(w) or longest[i + 1] != n + 1)]
        places, matches = s.scan(w)
        assert [(a, n) for a, n, _ in matches] == want and sorted(places) == brute_places(w)


def test_templates_with_edits():
    s = L.scanner(L.PHRASES, L.NOTICES)
    for name, text in L.NOTICES.items():
        w = L.words(("some words before " + text.replace("copies", "copy") + " and after").encode())
        best = max(s.spans(s.scan(w)[1]), key=lambda x: x[3])
        assert s.templates[best[0]][0] == name.split("/")[0] and best[3] > 0.8 and best[1] == 3
    # a template's words in another order are no span
    w = L.words(" ".join(reversed(L.NOTICES["mit/grant"].split())).encode())
    assert all(c < L.MIN_COVER for *_, c in s.spans(s.scan(w)[1]))


def test_whole_texts():
    texts = L.whole_texts()
    assert {n.split("/")[0] for n in texts} >= {"mit", "bsd", "isc", "apache", "gpl", "lgpl", "mpl", "cc0", "unlicense", "zlib", "bsl", "artistic"}
    s = L.scanner(L.PHRASES, L.NOTICES | texts)
    names = [*L.NOTICES, *texts]
    for name, text in texts.items():
        w = L.words(f"one two {text} three".encode())
        assert any(names[t] == name and (a, z) == (2, len(w) - 1) and c == 1.0 for t, a, z, c in s.spans(s.scan(w)[1])), name


def test_spans_of_cuts():
    """A cut of a template between words that no template has is a span of just these words."""
    texts = L.whole_texts()
    s = L.scanner(L.PHRASES, L.NOTICES | texts)
    names = [*L.NOTICES, *texts]
    rng = random.Random(4)
    for name, text in texts.items():
        t = L.words(text.encode())
        for _ in range(5):
            n = rng.randrange(L.MIN_MATCH, len(t) + 1)
            i = rng.randrange(len(t) - n + 1)
            w = [b"zzz"] * 4 + t[i : i + n] + [b"zzz"] * 3
            found = [(a, z) for k, a, z, _ in s.spans(s.scan(w)[1]) if names[k] == name]
            covers = [c for k, *_, c in s.spans(s.scan(w)[1]) if names[k] == name]
            assert (4, 4 + n) in found and max(covers) >= n / len(t) - 1e-9


def test_rows(spark, odd, sample, nothing):
    for docs in (odd, sample):
        for r in L.scan_licenses(docs, keep=("doc_id", "text")).collect():
            w = L.words((r.text or "").encode())
            places = brute_places(w)
            starts = [i for i, _ in places]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
            base = {list(L.PHRASES.values())[n] for _, n in places}
            assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert L.scan_licenses(nothing).collect() == []
