import random

import numpy as np
from pyspark.sql import functions as F

from stratalog.llm.reading import Model, Tokens, levels, split_sentences

EASY = "the team found a short note|we saw the old list|my page lost one row|the box sent two lines".split("|")
HARD = "the canonicalization apparatus circumscribes evidentiary commensurability|an asynchronous reconciliation necessitates probabilistic idempotence|each retrospective audit obfuscates referential monotonicity".split("|")


def text(level, r, sentences=20):
    out = []
    for _ in range(sentences):
        n = 1 + (r.random() < (level - 1) / 3) + (level == 4)
        out.append(", and ".join(r.choice(HARD if r.random() < (level - 0.8) / 3.4 else EASY) for _ in range(n)).capitalize() + ".")
    return " ".join(out)


def test_held_out_accuracy():
    r = random.Random(1)
    train, test = [1 + i % 4 for i in range(240)], [1 + i % 4 for i in range(120)]
    model = Model([text(k, r) for k in train], np.eye(4)[[k - 1 for k in train]])
    p = model([text(k, r) for k in test])
    assert (p.argmax(axis=1) + 1 == test).mean() > 0.85 and (abs(p.argmax(axis=1) + 1 - test) <= 1).all()
    assert np.allclose(p.sum(axis=1), 1)


def test_machine_lines_change_nothing():
    r = random.Random(2)
    train = [1 + i % 4 for i in range(120)]
    model = Model([text(k, r) for k in train], np.eye(4)[[k - 1 for k in train]])
    own = [text(k, r) for k in (1, 2, 3, 4)]
    assert np.allclose(model(own), model([t.replace(". ", ".\ntoro-77/payload-0001.json:ab12 rows=5 state=OK\n", 5) for t in own]))


def test_sentences():
    tokens = Tokens()
    number, _, first, owner = split_sentences(["One two. Three\nfour\nFive x=1", "", "12 --", "six"], tokens)
    words = list(tokens.words)
    parts = [[words[k] for k in s] for s in np.split(number, first[1:])]
    assert parts == [["one", "two"], ["three", "four"], ["five"], ["six"]] and owner.tolist() == [0, 0, 0, 3]


def test_tables(spark):
    r = random.Random(3)
    rows = [(i, text(1 + i % 4, r)) for i in range(80)] + [(100, None), (101, ""), (102, "few words"), (103, "12 " * 50), (104, text(4, r, 3000)), (105, text(1, r)), (105, text(1, r)), (None, text(2, r))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"level": F.lit(9), "words": F.lit("x"), "rater": F.lit("y")})
    rated = [(i, "a", 1 + i % 4) for i in range(80)] * 2 + [(i, "b", None) for i in range(80)] + [(999, "a", 1), (None, "a", 1), (3, "c", 7)]
    ratings = spark.createDataFrame(rated, "doc_id bigint, rater string, level int")
    got = levels(docs, ratings).collect()
    by = {x.doc_id: x.level for x in got}
    assert len(got) == 80 + 1 + 1 + 2 + 1 and not {100, 101, 102} & set(by) and by[104] == 4 and by[105] == 1 and by[103] in (1, 2, 3, 4)
    assert np.mean([by[i] == 1 + i % 4 for i in range(80)]) > 0.85
    assert {x.level for x in levels(docs, ratings.where("false")).collect()} == {None}
    assert levels(docs.where("false"), ratings).collect() == []
