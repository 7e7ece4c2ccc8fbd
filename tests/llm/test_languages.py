import pytest
from pyspark.sql import functions as F

from stratalog.llm.languages import LANGUAGES, Automaton, Classifier, detect, fit, label_language, mislabelled, sentences
from stratalog.llm.canonical import canonical_form

TEXTS = {
    "en": ["The night reader opened the old ledger before lunch.", "Our archive lost every link in the new batch.", "The team checked the first page once more."],
    "de": ["Der nächtliche Dienst öffnete das alte Verzeichnis vor dem Essen.", "Unser Archiv verlor jeden Verweis in der neuen Aufnahme.", "Die Gruppe prüfte die erste Seite noch einmal."],
    "fr": ["Le lecteur de nuit a ouvert le vieux registre avant midi.", "Notre archive a perdu chaque lien dans le nouveau lot.", "Notre équipe a vérifié la première page encore une fois."],
    "es": ["El lector nocturno abrió el viejo registro antes de comer.", "Nuestro archivo perdió cada enlace en el lote nuevo.", "Nuestro equipo revisó la primera página otra vez."],
    "it": ["Il lettore notturno ha aperto il vecchio registro prima di pranzo.", "Il nostro archivio ha perso ogni collegamento nel nuovo gruppo.", "Il nostro gruppo ha controllato la prima pagina ancora una volta."],
    "pt": ["O leitor noturno abriu o velho registro antes do almoço.", "Nosso arquivo perdeu cada ligação no novo lote.", "Nossa equipe verificou a primeira página mais uma vez."],
    "ru": ["Ночной сборщик открыл старый журнал до обеда.", "Наш архив потерял каждую ссылку в новой партии.", "Наш отдел проверил первую страницу ещё раз."],
    "uk": ["Нічний читач відкрив старий журнал до обіду.", "Наш архів втратив кожне посилання в новій партії.", "Наш відділ перевірив першу сторінку ще раз."],
}


def test_pieces_are_the_fewest():
    a = Automaton(["night", "nightly", "archive"])
    assert a.pieces("night") == 1 and a.pieces("archly") == 2 and a.pieces("zz") == 4
    text = {" night ", " nightly ", " archive "}
    subs = {w[i:j] for w in text for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def brute(w):
        best = [0] + [10**9] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(j):
                if w[i:j] in subs or j - i == 1:
                    best[j] = min(best[j], best[i] + 1)
        return best[-1]

    for w in ("nig", "chive", "tarch", "ghtlynight", "", "évè", "ight"):
        assert a.pieces(w) == brute(f" {w} ")


def test_sentences_leave_out_program_text():
    text = 'one two. three four: "five six." seven\n```\ncode here\n```\n- eight nine'
    assert [text[a:b].strip('"- ') for a, b in sentences(text)] == ["one two.", "three four:", "five six.", "seven", "eight nine"]


@pytest.fixture(scope="module")
def classifier():
    return Classifier(fit([(k, t) for k, v in TEXTS.items() for t in v] + [("en", TEXTS["de"][0])]))


def of(classifier, text):
    return [s[2] for s in classifier.classify([canonical_form(text)])[0][1]]


def test_each_language_and_its_other_spellings(classifier):
    for k, v in TEXTS.items():
        for t in v:
            assert of(classifier, t) == [k], t
            assert of(classifier, t.upper()) == [k], t
    assert of(classifier, "Nochnoy sborshchik otkryl staryy zhurnal do obeda.") == ["ru"]
    assert of(classifier, "Der naechtliche Dienst oeffnete das alte Verzeichnis.") == ["de"]
    assert of(classifier, "El lector nocturno abrio el viejo registro. Nuestro equipo reviso la primera pagina.") == ["es"]
    assert of(classifier, "Ｔｈｅ night re­ader оpened the old ledger.") == ["en"]


def test_stretches_and_what_has_no_language(classifier):
    mixed = f'{TEXTS["en"][0]} {TEXTS["de"][1]}\n{TEXTS["ru"][0]}'
    assert of(classifier, mixed) == ["en", "de", "ru"]
    assert of(classifier, f'{TEXTS["en"][0]} The team said: "{TEXTS["fr"][0]}" {TEXTS["en"][1]}') == ["en", "fr", "en"]
    for text in ("", "ok", "danke!", "12 34 56 78", "```\nselect the old ledger from archive\n```", "👩‍💻 ✅", "​"):
        assert of(classifier, text) == [], text
    assert of(classifier, f"{TEXTS['it'][0]} danke!") == ["it"]
    (letters, found), = classifier.classify([canonical_form(TEXTS["en"][0])])
    assert letters == 43 and 0.5 < found[0][3] <= 1


def test_tables_with_wrong_and_missing_labels(spark):
    rows = [(i * 10 + j, t) for i, v in enumerate(TEXTS.values()) for j, t in enumerate(v)]
    labels = [(r, list(TEXTS)[r // 10]) for r, _ in rows]
    texts = spark.createDataFrame([*rows, (900, TEXTS["fr"][0]), (901, TEXTS["fr"][1]), (902, f"{TEXTS['en'][0]} {TEXTS['fr'][0]}"), (903, None), (904, ""), (905, "danke"), (906, TEXTS["en"][0]), (906, TEXTS["en"][0]), (907, (TEXTS["en"][0] + " ") * 3000)], "row_id bigint, text string")
    texts = texts.withColumns({"key": F.lit("x"), "lang": F.lit("de"), "letters": F.lit(0)})
    said = spark.createDataFrame([*labels, (900, "en-GB"), (902, "eng"), (905, None), (906, "und"), (907, "EN")], "row_id bigint, lang string")
    found = detect(texts, said).cache()
    got = {r.row_id: r for r in found.collect()}
    assert got[903].lang is None and got[904].stretches == [] and got[907].lang == "en" and got[902].confidence > 0.5
    assert sorted(map(tuple, mislabelled(found, said).collect())) == [(900, "fr"), (901, "fr"), (902, "en"), (902, "fr"), (906, "en")]
    assert {r.lang for r in detect(texts, said.where("false")).collect()} == {None}
    assert detect(texts.where("false"), said).collect() == []


def test_labels(spark):
    df = spark.createDataFrame([("EN",), ("de_AT",), ("ger",), ("FR-ca",), ("und",), ("zxx",), ("",), (None,), ("n/a",), ("pol",), (" ukr ",), ("pt-Latn-BR",)], "l string")
    assert [r.x for r in df.select(label_language(F.col("l")).alias("x")).collect()] == ["en", "de", "de", "fr", None, None, None, None, None, None, "uk", "pt"]
    assert set(TEXTS) == set(LANGUAGES)
