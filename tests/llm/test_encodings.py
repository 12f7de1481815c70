from __future__ import annotations

import pytest
from conftest import rows

from corbel.llm.encodings import EAST, MISREAD, _read, find_garbled, garbled_documents, garbled_spans, restore, restored_documents

GOOD = "Größere Übung – “l’été” à Łódź, ¿qué año? Привет, мир… 200 × 40"


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r"])
def test_utf8_read_wrongly_comes_back(wrong):
    for passage in ("Größere Übung kostet", "l’été est à côté", "el año pasado – “sí”"):
        try:
            bad = passage.encode().decode(wrong)
        except UnicodeDecodeError:
            continue
        assert restore(f"correct é and {bad} end")[0] == f"correct é and {passage} end"


@pytest.mark.parametrize("wrong", [e for e in MISREAD if e not in EAST] + ["gbk"])
def test_emoji_read_wrongly_come_back(wrong):
    for emoji in "👍🚀🤖😀🎉":
        if wrong == "gbk" and emoji == "🤖":
            continue  # gbk can't read it
        bad = emoji.encode().decode("gbk") if wrong == "gbk" else _read(emoji.encode(), wrong, None)
        assert restore(f"all done {bad} end") == (f"all done {emoji} end", 1, True)
    assert garbled_spans("π’s digits, “π‘, all done 👍 end") == []


def test_twice_and_entities():
    bad = "déjà – “vu”".encode().decode("latin_1").encode().decode("latin_1")
    assert restore(bad)[0] == "déjà – “vu”"
    assert restore("caf&#195;&#169; & &#233;")[0] == "café & &#233;"  # a correct entity is no part of a garbled span


@pytest.mark.parametrize("passage", ["Größere Übung – “l’été”", "naïve", "Łódź… 5 €"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin_1"])
def test_any_number_of_layers(wrong, passage):
    bad = passage
    for _ in range(5):
        bad = "".join(_read(c.encode(), wrong, None) for c in bad)
        assert restore(f"è {bad} ê")[::2] == (f"è {passage} ê", True)


@pytest.mark.parametrize("passage", ["Tiếng Việt rất hay", "người dùng", "שלום עולם", "مرحبا بالعالم", "한국어 문서", "日本語のテキスト", "中文文档", "ἄνθρωπος ἐστίν", "ความ", "Беларусь"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp437"])
def test_any_script(wrong, passage):
    bad = "".join(_read(c.encode(), wrong, None) for c in passage)
    assert restore(f"see {bad} end")[::2] == (f"see {passage} end", True)
    assert garbled_spans(f"see {passage} end") == []


def test_entities_only_inside_spans():
    assert restore("price &#8364;5 then cafÃ©") == ("price &#8364;5 then café", 1, True)
    assert restore("&#xE9; caf&#xC3;&#xA9; &#xC3;&#169; &#55296; &#1114112;") == ("&#xE9; café é &#55296; &#1114112;", 2, True)
    assert restore("only &#8364;5 and &#xe9;") == ("only &#8364;5 and &#xe9;", 0, True)


def test_lost_parts_stay_and_are_told():
    text, n, whole = restore("We�ve seen cafÃ©")
    assert text == "We�ve seen café" and n >= 2 and not whole


@pytest.mark.parametrize("text", [GOOD, "ATENÇÃO, NÃO e PÂTÉ: Â, Ã, É", "If it shows `Ã©` or `â€™`, tell us (`ÃƒÂ¼`, `Ð¿Ñ€`)", "The glyph `�` marks a byte", "├── src\n│   └── a", "Prices in £, €, ¥; ª and º, «x»", "東京の猫", "—à bientôt –été", "",
     "voilà » et « cassé », « été »", "«её» діїв твоєї узнаё… “моё”", "OÙ… Où est-ce ?", "ÅÄÖ Êtes créée ÎLES “Så…”", "╔══╗ ║é║ ╚══╝ └┐ ├──┤", "5 × 3 µm², 2½ £"])
def test_correct_texts_are_no_case(text):
    assert garbled_spans(text) == []


def docs(spark):
    good = ["Zespół sprawdził już wszystko – We’ve seen 96 × 4 px"] * 12
    bad = ["Zespó³ sprawdzi³ ju¿ to", "WeÆve seen 64 Î 10 px", "It is cafÃ© time", "Labels: Â, Ã and É", "Itâs lost", None, ""]
    data = list(enumerate(good + ["It’s fine"] * 4 + bad))
    return spark.createDataFrame(data + [(None, "cafÃ©"), (18, "It is cafÃ© time")], "doc_id long, text string"), 16


def test_eight_bit_mixups_by_corpus_counts(spark):
    df, at = docs(spark)
    assert sorted(r[0] for r in rows(garbled_documents(df))) == [at, at + 1, at + 2]
    _, found = find_garbled(df, times=4)
    assert (at + 4, "Itâs", "It’s") in rows(found)
    assert rows(garbled_documents(df.limit(0))) == []


def test_restored_documents(spark):
    df, at = docs(spark)
    got = {r[0]: r[1] for r in rows(restored_documents(df))}
    by = {r[0]: r[4] for r in rows(restored_documents(df))}
    assert by == {at: "words", at + 1: "words", at + 2: "sequences"}
    assert got[at] == "Zespół sprawdził już to" and got[at + 1] == "We’ve seen 64 × 10 px" and got[at + 2] == "It is café time"


def test_frequent_mixups_and_copies_do_not_outvote_themselves(spark):
    good = ["Zespół już wczoraj sprawdził też całość nr %d" % i for i in range(20)]
    bad = [t.encode("cp1250").decode("cp1252") for t in good[:10]]
    copied = ["We’ve seen %d" % i for i in range(12)] + ["WeÆve lost it"] * 3
    df = spark.createDataFrame(list(enumerate(good + bad + copied)), "doc_id long, text string")
    assert sorted(r[0] for r in rows(garbled_documents(df))) == [*range(20, 30), 42, 43, 44]
    got = {r[0]: r[1] for r in rows(restored_documents(df))}
    assert [got[i] for i in range(20, 30)] == good[:10] and got[44] == "We’ve lost it"
