import random

import numpy as np
from pyspark.sql import functions as F

from stratalog.llm import leaks
from stratalog.llm.leaks import SHARE, STRETCH, Numbers, Probe, edited, edits, leaked, words


def brute(text, item):
    """Whether half of the item's words stand in the text, in order, in stretches of eight at least: by dynamic programming over places."""
    t, w = words(text), words(item)
    n, m = len(w), len(t)
    run = np.zeros((n + 1, m + 1), int)
    for i in range(n):
        for j in range(m):
            run[i + 1, j + 1] = run[i, j] + 1 if w[i] == t[j] else 0
    best = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j], best[i, j - 1])
            for k in range(STRETCH, run[i, j] + 1):
                best[i, j] = max(best[i, j], best[i - k, j - k] + k)
    return n >= STRETCH and best[n, m] >= SHARE * n


def test_against_brute_force():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(6, 50)))) for i in range(20)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(1, 5)):
            own = r.choice(items[:8])[1].split()
            a = r.randrange(len(own))
            parts += own[a : a + r.randrange(5, 40)] if r.random() < 0.7 else [r.choice(vocabulary) for _ in range(10)]
        texts.append(" ".join(parts))
    got = {(t, i) for t, i, _ in Probe(items).leaks(texts)}
    want = {(t, i) for t, text in enumerate(texts) for i, p in items if brute(text, p)}
    assert got == want and len(want) > 20


def test_layout_markup_and_odd_characters_make_no_difference(spark):
    passage = "The night reader (Torun) opened the old ledger, while our archive kept every link in content-addressed rows."
    odd = {
        1: passage,
        2: f"before {passage.upper()} after",
        3: "> " + passage.replace(" ", "\n> ", 5),
        4: "<p>" + passage.replace(" ", "&nbsp;") + "</p>",
        5: "* **" + passage.replace(" ", " ").replace("archive", "аrchive").replace("ledger", "le­dger") + "**",
        6: "The night reader (Torun) opened the old ledger, while other things happened",
        7: "The night reader opened the old ledger, while our archive lost all",
        8: None, 9: "", 10: "link in rows. " * 50_000 + passage,
    }
    docs = spark.createDataFrame([*odd.items(), (None, passage), (1, passage)], "doc_id bigint, text string").withColumns({"item_id": F.lit(0), "passage": F.lit("x"), "share": F.lit(1)})
    items = spark.createDataFrame([(5, passage, "q"), (6, None, "q"), (7, "too short", "q"), (8, "", "q"), (5, passage, "q")], "item_id bigint, passage string, query_text string")
    got = sorted(((r.doc_id, r.item_id) for r in leaked(docs, items).collect()), key=repr)
    assert got == sorted([(1, 5), (1, 5), (2, 5), (3, 5), (4, 5), (5, 5), (6, 5), (10, 5), (None, 5)], key=repr)
    assert leaked(docs, items.where("false")).collect() == [] and leaked(docs.where("false"), items).collect() == []


def test_blocks_of_items_and_batches_of_texts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(f"x{i}y{k}" for k in range(12))) for i in range(5)]
    docs = spark.createDataFrame([(i, f"a b {p} c") for i, p in items], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaked(docs, spark.createDataFrame(items, "item_id bigint, passage string")).collect()) == [(i, i) for i in range(5)]


def test_a_changed_word_keeps_windows_close():
    probe = Probe([(1, " ".join(f"w{i}" for i in range(40)))])
    row, lengths = probe.numbers.rows([" ".join("other" if i % 13 == 12 else f"w{i}" for i in range(40))])
    assert probe.candidates(row, lengths) == [(0, 0)]


def test_numbers_of_tokens():
    row, lengths = Numbers({"a": 1, "b": 2}).rows(["a, b-a -- c", "", "(B)"])
    assert row.tolist() == [1, 2, 1, 0, 2] and lengths.tolist() == [4, 0, 1]


def test_edited_passages_are_found(spark):
    """Passages with one word in ten replaced, inserted or left out, anywhere; no stretch needs to be whole."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30, 70)))) for i in range(60)]
    rows, truth = [], set()
    for i, p in items:
        w = p.split()
        for _ in range(len(w) // 10):
            at, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.4:
                w[at] = rng.choice(words)
            elif kind < 0.7:
                w.insert(at, rng.choice(words))
            else:
                del w[at]
        before, after = (" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(2))
        rows.append((i, f"{before} {' '.join(w).upper()}, {after}"))
        truth.add((i, i))
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(300))) for k in range(40)] + [(2000, None), (2001, ""), (2002, "one two")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    queries = spark.createDataFrame(items + [(900, None), (901, ""), (902, "three words only")], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id): r for r in edited(documents, queries).collect()}
    assert len(truth & got.keys()) >= 0.9 * len(truth) and got.keys() <= truth
    assert all(r.edits <= 0.15 * len(dict(items)[r.item_id].split()) for r in got.values())
    assert edited(documents.where("false"), queries).collect() == [] and edited(documents, queries.where("false")).collect() == []


def test_edit_distance_inside_a_text():
    r = random.Random(1)
    for _ in range(40):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, n))] for n in (7, 12))
        best = min(_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert edits(np.array(a), np.array(b)) == best


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]
