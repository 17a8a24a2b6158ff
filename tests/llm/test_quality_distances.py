"""Distances and verdicts of the quality rules against plain counting."""

import math
import random
from collections import Counter

from corpusloom.llm import quality

CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\n\x0b\x0c\r ", ".,;:!?'\"()-", "#*$%&|<>"]


def class_counts(text):
    n = [0] * 8
    for c in text:
        n[next((i for i, s in enumerate(CLASSES) if c in s), 6 if ord(c) < 128 else 7)] += 1
    return n


def bare(word):
    while word and ord(word[0]) < 128 and not word[0].isalnum():
        word = word[1:]
    while word and ord(word[-1]) < 128 and not word[-1].isalnum():
        word = word[:-1]
    return "".join(c.lower() if ord(c) < 128 else c for c in word)


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(max(0.0, sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m) if b) / 2))


def references(rows):
    found = []
    for lang in sorted({lang or "*" for _, _, lang in rows}):
        texts = [t or "" for _, t, x in rows if (x or "*") == lang]
        classes = [sum(c) for c in zip(*map(class_counts, texts))]
        times, n = Counter(bare(w) for t in texts for w in words(t)), sum(len(words(t)) for t in texts)
        del times[""]
        common = [w for w, _ in sorted(times.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]]
        if sum(classes) and n:
            found.append(([c / sum(classes) for c in classes], common, [times[w] / n for w in common] + [(n - sum(times[w] for w in common)) / n]))
    return found


def test_distances(spark, odd_docs):
    rng = random.Random(8)
    vocabulary = {lang: ["".join(rng.choice("abcdeé" if lang == "fr" else "mnopqr") for _ in range(rng.randint(2, 6))) for _ in range(40)] for lang in ("fr", "de")}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]).capitalize() + rng.choice(["", "", ".", ",", "!"]) for _ in range(rng.choice([3, 55, 90, 200]))), lang) for i, lang in enumerate(["fr", "de"] * 15)]
    rows += [(100, "### $$$ 12 " * 40, "fr"), (101, None, "de"), (102, "", None), (103, "x", None), (104, "WORD " * 70, "de")]
    got = {r.doc_id: r.quality for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    refs, verdicts = references(rows), set()
    for i, text, _ in rows:
        text = text or ""
        own, w = class_counts(text), words(text)
        chars = sum(len(x) for x in w)
        near_class = min(distance([c / sum(own) for c in own], ref[0]) for ref in refs) if chars >= quality.GUARD_CHARS else 0.0
        times = Counter(map(bare, w))
        near_word = 0.0
        if len(w) >= quality.GUARD_WORDS:
            near_word = 1.0
            for _, common, histogram in refs:
                mine = [times[c] for c in common]
                near_word = min(near_word, distance([x / len(w) for x in [*mine, len(w) - sum(mine)]], histogram))
        q = got[i]
        assert abs(q.class_distance - near_class) < 1e-9 and abs(q.word_distance - near_word) < 1e-9, i
        assert q.kept == (not q.base_failed and near_class <= quality.MAX_CLASS and near_word <= quality.MAX_WORD)
        verdicts.add((q.base_failed, q.kept))
    assert verdicts >= {(True, False), (False, True)}
