"""Language identification against a plain scorer over the raw counts."""

import math
from collections import Counter

import pytest
import regex

from loomwork.llm import langid
from tests.llm.data import corpus, frame


def plain_model(rows, max_terms):
    names = sorted({r[2] for r in rows})
    counts = [Counter() for _ in range(langid.LONGEST + 1)]
    for _, text, lang, _, _ in rows:
        for word in regex.findall(r"\p{L}+", text.lower()):
            counts[0][word, lang] += 1
            for n in range(1, langid.LONGEST + 1):
                marked = word if n == 1 else f" {word} "
                for i in range(len(marked) - n + 1):
                    counts[n][marked[i : i + n], lang] += 1
    tables, totals = [], []
    for n, found in enumerate(counts):
        total = Counter()
        for (term, _), times in found.items():
            total[term] += times
        limit = max_terms if n in (0, langid.LONGEST) else max_terms // 2
        kept = sorted((t for t in total if total[t] > 1), key=lambda t: (-total[t], t))[:limit]
        sums = [sum(found[t, lang] for t in kept) + 0.1 * (len(kept) + 1) for lang in names]
        tables.append({t: [math.log((found[t, x] + 0.1) / s) for x, s in zip(names, sums)] for t in kept})
        totals.append(sums)
    return names, tables, [math.log(0.1 / s) for s in totals[1]]


def plain_prediction(model, text):
    names, tables, unseen = model
    words = regex.findall(r"\p{L}+", text.lower())
    if not words:
        return "und", 0.0
    sums = [0.0] * len(names)
    for word in words:
        vector = tables[0].get(word)
        for n in range(langid.LONGEST, 0, -1):
            if vector is None:
                marked = word if n == 1 else f" {word} "
                hits = [tables[n][marked[i : i + n]] for i in range(len(marked) - n + 1)
                        if marked[i : i + n] in tables[n]]
                if hits:
                    vector = [sum(h[k] for h in hits) / len(hits) for k in range(len(names))]
        sums = [a + b for a, b in zip(sums, vector or unseen)]
    best = sums.index(max(sums))
    return names[best], 1 / sum(math.exp((s - sums[best]) / math.sqrt(len(words))) for s in sums)


@pytest.mark.parametrize("max_terms", [60, 60_000])
def test_scores_of_the_plain_model(spark, max_terms):
    rows = corpus(seed=4, documents=70)
    predictor = langid.Predictor(langid.fit(frame(spark, rows), max_terms=max_terms))
    model = plain_model(rows, max_terms)
    texts = [r[1] for r in corpus(seed=11, documents=40)] + ["qqqq xyz", "ß", "über the zzz"]
    langs, scores = predictor.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        want = plain_prediction(model, text)
        assert score == pytest.approx(want[1], abs=1e-9)
        assert lang == want[0] or score == pytest.approx(0.5)


def test_numerals_are_no_letters(spark):
    predictor = langid.Predictor(langid.fit(frame(spark, corpus())))
    langs, scores = predictor.predict(["½ ²", "① ②", "Ⅷ", "12_3", "ª", "x"])
    assert langs[:4] == ["und"] * 4 and not scores[:4].any()
    assert "und" not in langs[4:]
