from pyspark.sql import functions as F

from stratalog.llm.canonical import analyse, canonical, odd_records

ODD = {
    "ｆｉｌｅ": ("file", {"compatibility"}),
    "𝗻𝗲𝗮𝗿 the ﬁle": ("near the file", {"compatibility"}),
    "été": ("été", {"decomposed"}),
    "re­start​": ("restart", {"invisible"}),
    "﻿": ("", {"invisible"}),
    "a b　c": ("a b c", {"space"}),
    "SΗARD": ("shard", {"look_alike"}),
    "xapaктеpистику": ("характеристику", {"look_alike"}),
    "audıt messaɡes": ("audit messages", {"look_alike"}),
    "нοчью": ("ночью", {"look_alike"}),
    "b‍а ｄ": ("ba d", {"invisible", "look_alike", "space", "compatibility"}),
}
PLAIN = ["", " \t\n\r", "plain", "Élan straße", "Ночь and day", "👨‍👩‍👧 ❤️ ✅ 👍🏽", "μ Δ ™ m² 2º ½", "Wi-Fi роутер", "می‌خواهم", "Δt", "日本語", "ё й ї", "\U0001f3f4\U000e0067\U000e0062\U000e007f", "naïve café"]


def test_kinds_and_forms():
    for text, (form, kinds) in ODD.items():
        assert (analyse(text)[0], set(analyse(text)[1])) == (form, kinds), text
    for text in PLAIN:
        assert analyse(text)[1] == (), text


def test_the_form_is_a_fixed_point():
    for text in [*ODD, *PLAIN, "ﷺ", "ǅ", "ϓ", "ß", "İ", "̈́"]:
        form = analyse(text)[0]
        assert analyse(form)[0] == form, text


def test_same_looks_same_form():
    assert analyse("The Ｎew bаtch")[0] == analyse("the new batch")[0]


def test_columns_with_nulls_repeats_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "ｆ"), (3, "ｆ"), (None, "ｆ"), (5, "é" * 500_000 + "​")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumns({"form": F.lit(1), "c": F.lit(2), "record_key": F.lit(3)})
    got = [(r.record_key, r.form if len(r.form) < 9 else len(r.form), tuple(r.kinds)) for r in odd_records(df, "t", "id", "text").collect()]
    assert sorted(got, key=repr) == sorted([("3", "f", ("compatibility",)), ("3", "f", ("compatibility",)), (None, "f", ("compatibility",)), ("5", 500_000, ("invisible",))], key=repr)
    assert [r.c for r in df.where("id <= 2").select(canonical(F.col("text")).alias("c")).collect()][0].form is None
    assert odd_records(df.where("false"), "t", "id", "text").collect() == []


def test_decomposed_letters_of_other_scripts():
    for text, form in (("か\u3099", "が"), ("\u1112\u1161\u11ab", "한"), ("ا\u0653", "آ")):
        assert analyse(f"so {text}") == (f"so {form}", ("decomposed",)) and analyse(f"so {form}") == (f"so {form}", ())
