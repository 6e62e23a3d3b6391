import pytest

from lexigrid.llm import mojibake as M

FRENCH = "Le comité a adopté son rapport à Genève, « sans être mis aux voix » – enfin."
SPANISH = "¿Quién pagará la exposición? Preguntó el niño en el año 2012."
RUSSIAN = "Проект текста был принят без голосования на следующем заседании."
CHINESE = "决议草案未经表决获得通过。代表要求把海关表格列入议程。"


def wrong(text, meant, read):
    return "".join(c for c in text.encode(meant).decode(read, "surrogateescape")) if meant != "utf-8" else "".join(chr(b) if read == "latin-1" else _sloppy(b, read) for b in text.encode("utf-8"))


def _sloppy(b, read):
    try:
        return bytes([b]).decode(read)
    except UnicodeDecodeError:
        return chr(b)


CASES = [(FRENCH, "utf-8", e) for e in ("latin-1", "cp1252", "cp437", "mac_roman")] + [(SPANISH, "utf-8", e) for e in ("latin-1", "cp1252", "cp437", "mac_roman")]
CASES += [(RUSSIAN, "utf-8", e) for e in ("latin-1", "cp1252", "cp1251")] + [(CHINESE, "utf-8", e) for e in ("latin-1", "cp1252")]
CASES += [(RUSSIAN, "koi8_r", "cp1251"), (RUSSIAN, "cp1251", "cp866"), (RUSSIAN, "cp1251", "latin-1"), (RUSSIAN, "cp1251", "koi8_r"), (CHINESE, "gbk", "latin-1"), (SPANISH, "cp1252", "cp850")]


@pytest.mark.parametrize("text, meant, read", CASES)
def test_restored(text, meant, read):
    garbled = wrong(text, meant, read)
    assert garbled != text
    kind, back, layers = M.repair(f"Plain words before. {garbled} And after.")
    assert kind == "restored" and layers >= 1 and back == f"Plain words before. {text} And after."


def test_two_layers():
    twice = wrong(wrong(FRENCH, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert M.repair(twice) == ("restored", FRENCH, 2)
    mixed = f"{wrong(SPANISH, 'utf-8', 'cp1252')} {wrong(SPANISH, 'utf-8', 'mac_roman')}"
    assert M.repair(mixed) == ("restored", f"{SPANISH} {SPANISH}", 1)


@pytest.mark.parametrize("text", [FRENCH, SPANISH, RUSSIAN, CHINESE, "", "plain", "IRMÃ Ana, À JAMAIS : ÊTRE OU NE PAS ÊTRE", "SÃO Paulo and the ÂNGEL quarter", "15 °C , ± 2 °C", "Þórir and Ðaði with £ 40", "КОНЕЦ ЧАСТИ ПЕРВОЙ", "the sign ¿ X ? ¡ sí ! « oui »", "👍🏽 ok 🙂", "á́", "café naïve façade – “ X ” – Ångord", "80 €uro , piñata , déjà vu"])
def test_harmless(text):
    assert M.repair(text) == (None, text, 0)


def test_lost_characters_are_found_though_not_restored():
    assert M.repair("r�solution") == ("lost", "r�solution", 0)
    assert M.repair("r�solution " + wrong(FRENCH, "utf-8", "cp1252"))[0] == "partly"


def test_frame(spark):
    bad = wrong(FRENCH, "utf-8", "cp1252")
    rows = [(1, bad, "x"), (1, bad, "x"), (2, None, "x"), (3, "", "x"), (4, FRENCH, "x"), (5, "word " * 40_000 + bad, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, layers string")
    got = sorted((r.doc_id, r.kind or "", r.restored) for r in M.repaired(df).fillna("-", ["restored"]).collect())
    assert [x[:2] for x in got] == [(1, "restored"), (1, "restored"), (2, ""), (3, ""), (4, ""), (5, "restored")]
    assert got[0][2] == FRENCH and got[2][2] == "-" and got[5][2].endswith(FRENCH)
    assert sorted(r.doc_id for r in M.repaired(df, found_only=True).collect()) == [1, 1, 5]
    assert M.repaired(df.limit(0)).count() == 0


@pytest.mark.parametrize("read", ["cp1251", "koi8_r"])
@pytest.mark.parametrize("text", [FRENCH.replace("«", "").replace("»", "").replace("–", "-"), "El niño y la exposición, mañana y después"])
def test_latin_text_read_as_cyrillic(text, read):
    garbled = text.encode("cp1252").decode(read)
    kind, back, _ = M.repair(garbled)
    assert M.suspicious(garbled) and kind and [c for c in back if c.isascii()] == [c for c in text if c.isascii()] and sum(a != b for a, b in zip(back, text)) <= 1


def test_mac_text_read_as_western():
    text = "la exposición y la reunión del niño"
    assert M.repair(text.encode("mac_roman").decode("cp1252")) == ("restored", text, 1)


@pytest.mark.parametrize("text", ["the bаnk and the pаper of the stаte", "the rule—which failed—was kept—so far", "IT-отдел, MP3-плеер и USBшный порт", "webный и webный порт"])
def test_harmless_neighbours(text):
    assert M.repair(text) == (None, text, 0)


SOUND = {
    "en": "The café’s naïve façade – “a fiancé” cost £40 or €50.",
    "fr": "Le comité a adopté son rapport à Genève, où l’été fut très chaud.",
    "es": "¿Quién pagará la exposición? Preguntó el niño en el año 2012.",
    "de": "Die Größe der Straße überraschte die Mädchen; schöne Grüße aus Köln.",
    "pt": "A comissão não aprovou a resolução sobre a educação das crianças.",
    "it": "La città è più bella perché c’è il sole, però così sarà.",
    "ro": "Ședința comisiei a adoptat rezoluția privind învățământul și sănătatea.",
    "pl": "Komisja przyjęła wniosek, że żółte łódki są zbyt drogie.",
    "cs": "Výbor přijal návrh usnesení a žádá členy, aby zvážili příští kroky.",
    "hu": "A bizottság elfogadta a határozatot, és kérte a tagállamok közreműködését.",
    "tr": "Komisyon, çalışmaların değerlendirilmesi için İstanbul’da toplandı.",
    "sv": "Kommittén antog förslaget på mötet i Göteborg år 2012.",
    "fi": "Valiokunta hyväksyi päätöslauselman äänestyksen jälkeen.",
    "vi": "Ủy ban đã thông qua nghị quyết về giáo dục và y tế.",
    "is": "Nefndin samþykkti tillöguna á fundi sínum í Reykjavík í maí.",
    "ru": "Проект текста был принят без голосования на следующем заседании.",
    "uk": "Комітет прийняв резолюцію щодо освіти її членів і їхніх дітей.",
    "bg": "Комитетът прие резолюцията относно образованието на децата.",
    "sr": "Комитет је усвојио резолуцију о образовању деце и њихових породица.",
    "el": "Η επιτροπή ενέκρινε το ψήφισμα για την εκπαίδευση των παιδιών. ΑΘΗΝΑ ΕΛΛΑΔΑ",
    "he": "הוועדה אימצה את ההחלטה בנושא חינוך הילדים.",
    "ar": "اعتمدت اللجنة القرار المتعلق بتعليم الأطفال.",
    "fa": "کمیته قطعنامه مربوط به آموزش کودکان را تصویب کرد.",
    "hi": "समिति ने बच्चों की शिक्षा पर प्रस्ताव को मंजूरी दी।",
    "bn": "কমিটি শিশুদের শিক্ষা বিষয়ে প্রস্তাব গ্রহণ করেছে।",
    "ta": "குழு குழந்தைகளின் கல்வி குறித்த தீர்மானத்தை ஏற்றுக்கொண்டது.",
    "th": "คณะกรรมการได้รับรองมติเกี่ยวกับการศึกษาของเด็ก",
    "ka": "კომიტეტმა მიიღო რეზოლუცია ბავშვთა განათლების შესახებ.",
    "hy": "Հանձնաժողովը ընդունեց բանաձևը երեխաների կրթության մասին։",
    "ko": "결의안은 표결 없이 채택되었다. 안녕하세요 세계",
    "ja": "委員会は子どもの教育に関する決議を採択した。カタカナも使う。",
    "zh": "决议草案未经表决获得通过。代表要求把海关表格列入议程。",
    "zt": "委員會通過了關於兒童教育的決議，並要求會員國提供資料。",
    "am": "ኮሚቴው የልጆች ትምህርትን በተመለከተ የውሳኔ ሐሳብ አጽድቋል።",
}


@pytest.mark.parametrize("lang", SOUND)
def test_sound_text_of_many_languages_stays(lang):
    assert M.repair(SOUND[lang]) == (None, SOUND[lang], 0)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp850", "koi8_r"])
def test_most_languages_come_back(read):
    garbled = {k: M.garble(t, read, "utf-8") for k, t in SOUND.items()}
    assert all(M.repair(g)[0] for g in garbled.values())
    assert sum(M.repair(garbled[k])[1] == t for k, t in SOUND.items()) >= 0.9 * len(SOUND)


def test_accuracy_counts(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate([*SOUND.items(), ("x", None), ("x", ""), ("x", "plain"), ("x", wrong(FRENCH, "utf-8", "cp1252"))])]
    got = M.accuracy(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.n for r in got) == sum(r.found for r in got) == len(SOUND) and sum(r.restored for r in got) >= 0.9 * len(SOUND)
    assert "x" not in {r.by for r in got}


def test_passes_end():
    for text in ("Ã" * 3000, "Â\xa0" * 500, "ÃƒÂ©" * 200, "�é" * 300):
        M.repair(text)
