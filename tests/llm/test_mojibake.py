import pytest

from quirefold.llm import mojibake as M

TEXTS = ["Élan – “café” d’été", "Größe der Türme", "Coração de Amanhã", "¿Quién robó la canción?", "Księga i zaginiona źródło", "Дорога, Стекло и Ключ", "霧の河と夜の約束", "少年在塔夜醒来，发现影夜已经消失。", "Güneş ve Kılıç", "Sau một đêm dài"]


def wrong(text, read_as):
    raw = text.encode("utf-8")
    return "".join(bytes([b]).decode(read_as, "ignore") or chr(b) for b in raw)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251"])
def test_restored(text, read_as):
    assert M.judged(wrong(text, read_as)) == (text, False)


@pytest.mark.parametrize("text", TEXTS)
def test_twice_wrong(text):
    assert M.judged(wrong(wrong(text, "cp1252"), "cp1252")) == (text, False)


@pytest.mark.parametrize("text", [*TEXTS, "plain", "À LA CROISÉE", "Ångdal & Ærø", "★ Void ★", "‰ Promille Knight", "caf&eacute;", "caf&#233;", "Ταξίδι στην Ιθάκη", "한국어 제목", "Ünïcödé Ñandú", "A “B” — C…", "IRMÃ DE SÃO"])
def test_correct_text_is_no_case(text):
    assert M.judged(text) is None


def test_other_cases():
    assert M.judged("A na&#195;&#175;ve one") == ("A naïve one", False)
    assert M.judged("Ana, Стекло и " + wrong("Дорога", "cp1252")) == ("Ana, Стекло и Дорога", False)
    assert M.judged("can\x92t, \x93so\x94") == ("can’t, “so”", False)
    assert M.judged("少年在塔".encode("gb18030").decode("latin-1") + "!")[0] == "少年在塔!"
    assert M.judged("Колодец и Ночь".encode("koi8_r").decode("cp1251")) == ("Колодец и Ночь", False)
    assert M.judged("R�verie") == (None, True)
    assert M.judged("") is None
    assert M.judged("é" * 100_000) is None


def test_table(spark):
    df = spark.createDataFrame(
        [(1, "CafÃ©", None, "fine"), (1, "CafÃ©", None, "fine"), (2, None, None, ""), (None, "CafÃ©", "Café", None)], "entry_id long, title string, value string, lost string"
    )
    got = M.garbled(df, "entry_id", ["title", "value"]).collect()
    assert sorted((r.entry_id or 0, r.field_name, r.restored, r.lost) for r in got) == [(0, "title", "Café", False), (1, "title", "Café", False), (1, "title", "Café", False)]
    assert M.garbled(df.limit(0), "entry_id", ["title"]).count() == 0


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (wrong("霧の桥と镜の約束", "cp1252"), ("霧の桥と镜の約束", False)),  # kanji rare in Japanese: the text found is not beyond doubt
        ("".join(f"&#{ord(c)};" if c > "\x7f" else c for c in wrong("Мельница и Дорога", "cp1252")), ("Мельница и Дорога", False)),
        (wrong(wrong("Дорога, Зеркало и Башня", "cp1252"), "cp1252"), ("Дорога, Зеркало и Башня", False)),
        (wrong("霧の桥と镜の約束", "cp437"), ("霧の桥と镜の約束", False)),
        (wrong("霧の桥と镜の約束", "cp1252") + "�", (None, True)),
    ],
)
def test_search_ends(monkeypatch, value, expected):
    expanded, neighbours = [], M.utf8_neighbours

    def counted(text):
        expanded.append(text)
        assert len(expanded) <= 1000, "the search goes on"
        return neighbours(text)

    monkeypatch.setattr(M, "utf8_neighbours", counted)
    assert M.judged(value) == expected


def test_run_read_as_a_whole():
    assert M._reread("Âåëàð ÂåŒ", "cp1252", "cp1251") == "Велар ВеЊ"
    assert M._reread("Âåëàð Âå霧", "cp1252", "cp1251") == "Велар Âå霧"
