"""The pattern grammar by hand and against plain rules, learned stems and weights, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import toxicity as tox

SF = "/root/testdata/sf0.1"
PLAIN = tox.Lexicon({})


def kinds(text):
    found = []
    for words in PLAIN.clauses(text):
        found.append([out for out, _ in tox.grammar().read(PLAIN.symbol(w)[0] for w in words) if out in tox.MATCHES])
    return found


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("What a moron.", [["insult"]]),
        ("You absolute moron!", [["aimed"]]),
        ("Moron, you lose. A fine day.", [["insult", "aimed"]]),
        ("a stupid, pathetic loser", [["insult", "piled", "piled"]]),
        ("I will kill you", [["threat", "directed"]]),
        ("she is not a moron; you are a moron", [["denied"], ["aimed"]]),
        ("he isn't stupid", [["denied"]]),
        ("He said they were all idiots", [["reported"]]),
        ("Du bist ein Trottel? Nein, kein Trottel.", [["aimed"], ["denied"]]),
        ("IDIOT!!! $$$moron%%%", [["insult"], ["insult"]]),
        ("the oxymoron is a figure of speech", []),
        ("", []),
        (None, []),
    ],
)
def test_clauses(text, want):
    assert kinds(text) == want


def test_composition_reads_like_its_parts():
    """The composed machine against its transducers run one after the other, over all short and many long sequences."""
    first = tox.within({"insult"}, 2, {"insult": ("piled", 0.5)})
    second = tox.within({"target"}, 3, {"insult": ("aimed", 1.0), "piled": ("aimed", 1.5)})
    third = tox.within({"negation"}, 1, {"aimed": ("denied", -1.0)})
    both, rng = first.then(second).then(third), random.Random(5)
    for seq in [*itertools.product(tox.WORDS[:5], repeat=4), *([rng.choice(tox.WORDS) for _ in range(60)] for _ in range(50))]:
        want = [(s, 0.0) for s in seq]
        for part in (first, second, third):
            want = [(out, w + v) for (out, v), (_, w) in zip(part.read(s for s, _ in want), want)]
        assert list(both.read(seq)) == want


def rules(symbols):
    """The five transducers as plain rules over places."""
    out = list(symbols)

    def near(openers, source, place, reach):
        return any(source[j] in openers for j in range(max(0, place - reach), place))

    bare = ("insult", "piled", "aimed", "threat", "directed")
    for openers, reach, source, to in (({"insult"}, 3, ("insult",), "piled"), ({"threat"}, 3, ("target",), "directed"), ({"target", "directed"}, 3, ("insult", "piled"), "aimed"), ({"insult", "piled"}, 2, ("target",), "aimed"), ({"negation"}, 3, bare, "denied"), ({"reporting"}, 8, bare, "reported")):
        out = [to if x in source and near(openers, out, i, reach) else x for i, x in enumerate(out)]
    return out


def test_grammar_is_the_rules():
    rng = random.Random(9)
    for _ in range(400):
        seq = [rng.choice(tox.WORDS) for _ in range(rng.randint(1, 30))]
        assert [out for out, _ in tox.grammar().read(seq)] == rules(seq)


def test_clauses_found_are_all(spark):
    """The stem automaton finds the clauses that reading every clause finds."""
    lexicon = tox.Lexicon({"zorg": 4.0, "blip ": 3.5, "éclat": 5.0})
    rng = random.Random(3)
    vocabulary = ["zorgian", "blip", "blipper", "éclats", "moron", "oxymoron", "you", "fine", "zor", "x"]
    for _ in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ". ", "\n", ", ", "--", "!"]) for _ in range(rng.randint(0, 25)))
        want = [c.split() for c in tox.plain(text).translate(tox._CLAUSES).split(b"\n")]
        want = [c for c in want if any(lexicon.symbol(w)[0] in ("insult", "threat") for w in c)]
        assert list(lexicon.clauses(text)) == want


def test_weights():
    """Newton's weights make the gradient zero; without labels the prior stays."""
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(500, len(tox.PRIOR) - 1)))
    y = (x[:, 0] + x[:, 3] + 0.3 * rng.normal(size=500) > 1.8).astype(float)
    w = tox.fit_weights(x, y)
    z = np.c_[x, np.ones(500)]
    assert np.abs(z.T @ (y - 1 / (1 + np.exp(-z @ w))) - tox.FIRM * (w - tox.PRIOR)).max() < 1e-5
    assert np.allclose(tox.fit_weights(x[:0], y[:0]), tox.PRIOR)


def test_learned_stems(spark):
    """A family of words that marks toxic texts is learned; a passage in many copies is not, nor a word of both kinds of texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = [(" ".join([*(word() for _ in range(20)), f"zogra{word()}", *(word() for _ in range(5)), "commonword"]), 1) for _ in range(40)]
    rows += [("exactly this wortwort passage copied", 1)] * 40 + [(" ".join([*(word() for _ in range(30)), "commonword"]), 0) for _ in range(200)] + [(None, 0), ("", 1)]
    stems = tox.learn_stems(spark.createDataFrame(rows, "text string, toxic int"))
    assert "zogr" in stems and not any(s.startswith(("wort", "comm")) for s in stems)
    assert tox.learn_stems(spark.createDataFrame([("a b", 1)], "text string, toxic int")) == {}


def test_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empties, a very long text, repeated rows, clashing columns; labels of one kind, of no document, none at all."""
    some = spark.createDataFrame([(1, 1), (1, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    for labels in (some, some.where("false")):
        model = tox.train(odd_docs, labels)
        got = tox.score_texts(odd_docs, model, col="score")
        assert got.columns == [*odd_docs.columns, "score"] and got.count() == odd_docs.count()
        assert all(0 <= r.score < tox.THRESHOLD for r in got.collect())
    model = tox.train(no_docs, some)
    assert tox.score_texts(no_docs, model).count() == 0
    texts = spark.createDataFrame([("You pathetic moron, you worthless loser!",), ("word " * 200_000 + "you moron",), (None,)], "text string")
    high, long, none = [r.score for r in tox.score_texts(texts, model, col="score").collect()]
    assert high > long > none
    found = tox.matched_clauses(texts, model).collect()
    assert found[0].clauses[0].kinds.split()[0] == "aimed" and len(found[1].clauses) == 1 and found[2].clauses == []


def test_held_out(spark):
    """Of held-out rows of sf0.1, nearly all toxic documents are found and nearly all others left alone; labels of the held-out fold are not read."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = tox.op11_query(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(toxic) > 100 and np.mean([r.predicted for r in toxic]) > 0.85
    assert np.mean([r.predicted for r in clean]) < 0.01
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = tox._fold(F.col("doc_id"))
    a = tox.train(docs, labels.where(fold != 1))
    b = tox.train(docs.where(fold != 1), labels.where(fold != 1))
    assert a.lexicon.weight == b.lexicon.weight and np.allclose(a.weights, b.weights)
