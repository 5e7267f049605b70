import unicodedata

import pytest
from pyspark.sql import functions as F

from quernstone.functions import stem, text as T
from quernstone.functions.vectors import cosine


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tokenize(spark):
    got = apply(spark, T.tokenize, [None, "", "Ёлка НЕ a b1-c2 été", "Не я и мы 5"])
    assert got == [[], [], ["лка", "не", "b1", "c2"], ["не", "мы"]]
    assert apply(spark, T.tokenize_long, ["one to мир не"]) == [["one", "мир"]]
    assert apply(spark, lambda c: T.tokenize(c, stem.stem_tokens), ["государственная служба не прошла"]) == [["государствен", "служб", "не", "прошл"]]


def test_stems_of_odd_lists(spark):
    df = spark.createDataFrame([(0, ["службы", None, "не"]), (1, None), (2, []), (3, ["службе"])], "i int, t array<string>")
    assert [r.s for r in df.coalesce(1).orderBy("i").select(stem.stem_tokens("t").alias("s")).collect()] == [["служб", None, "не"], None, [], ["служб"]]


def test_tokens_are_whole_runs(spark):
    assert apply(spark, T.tokenize, ["a bc-я не\x0bx9\u00a0ЁЖ 字ab", None]) == [["bc", "не", "x9", "ab"], []]
    assert apply(spark, T.tokenize_long, ["ab abc-абвг"]) == [["abc", "абвг"]]


@pytest.mark.parametrize(
    ("word", "root"),
    [("важная", "важн"), ("важнейшими", "важн"), ("вазы", "ваз"), ("валентина", "валентин"), ("бегавшими", "бега"), ("падший", "падш"), ("противоестественном", "противоестествен"), ("уверенность", "уверен"), ("понимаешь", "понима"), ("проявившись", "прояв"), ("ёлка", "елк"), ("в", "в"), ("xyz", "xyz")],
)
def test_published_stems(word, root):
    assert stem.stem_russian(word) == root


def test_guard_form_and_nfkc(spark):
    assert apply(spark, T.guard_form, ["ＡＢＣ  ааааа xx ", None]) == ["abc а xx", None]
    words = ["ﬁne", "①", "é", "é"]
    assert apply(spark, T.nfkc, words) == [unicodedata.normalize("NFKC", w) for w in words]


def test_synonyms_go_longest_first(spark):
    table = {"ab": "c", "abc": "ab", "d": "abd"}
    assert apply(spark, lambda c: T.rewrite_synonyms(c, table), ["ABC d"]) == ["c abd"]
    assert apply(spark, T.rewrite_synonyms, ["Отпуск на госслужбе"]) == ["ежегодный оплачиваемый отпуск на гражданской службе"]


def test_legal_cleaning(spark):
    dirty = "# Заголовок тут\r\n[ссылка](http://x) и ](y) <b>тег</b>.\nпере\n- нос строки,\nдальше (В редакции закона) тут.\n\nАбзац.\n5 1 . Пункт\nk6clabc:=x 95ФЗ"
    clean = apply(spark, T.clean_legal, [dirty, None, ""])
    assert clean[1:] == ["", ""]
    assert clean[0].startswith("Заголовок тут") and "ссылка и тег" in clean[0] and "строки, дальше" in clean[0] and "(В редакции" not in clean[0] and "Абзац." not in clean[0] and "5.1." in clean[0] and "k6cl" not in clean[0] and "95-ФЗ" in clean[0]
    for version in T.LEGAL_PROGRAMS:
        once = apply(spark, lambda c, v=version: T.clean_legal(c, v), [dirty])
        assert apply(spark, lambda c, v=version: T.clean_legal(c, v), once) == once
    assert apply(spark, lambda c: T.clean_legal(c, 5, True), ["текст 4."]) == ["текст"] and apply(spark, T.clean_legal, ["текст 4."]) == ["текст 4."]


def test_lines_and_headers(spark):
    assert apply(spark, T.drop_garbage_lines, ["Поиск\nтекст тут\nhttp://x\nx\n YouTube "]) == ["текст тут"]
    assert apply(spark, T.drop_service_lines, ["###\nАБЗАЦ.\n \n(Наименование в редакции)\nтекст"]) == ["\nтекст"]
    assert apply(spark, T.drop_repeated_header, ["A\nb\n A \nc", "", None]) == ["A\nb\nc", "", ""]
    assert apply(spark, T.normalize_heading, ["** Раздел   1 **"]) == ["Раздел 1"]
    assert apply(spark, T.roman_numeral, ["**IV. Общие", "Иное", "XI. x"]) == ["IV", None, "XI"]
    assert apply(spark, T.is_table_start, ["Таблица № 3", "Пример 1", "Текст"]) == [True, True, False]
    assert apply(spark, T.is_orphan_number, ["[A] [B]\n\n5.1.", "[A] 5.1. текст", "12"]) == [True, False, True]


def test_article_numbers_and_titles(spark):
    assert apply(spark, T.article_number, ["59-1", "5<sup>3</sup> 1", " 7. "]) == ["59.1", "53.1", "7"]
    assert apply(spark, T.split_article_number, ["591", "5910", "59", "59-1"]) == ["59.1", "59.10", "59", "59.1"]
    got = apply(spark, T.article_title, ["### Статья 5 1. Отпуск", "Глава 2"])
    assert (got[0].number, got[0].title) == ("5.1", "Статья 5.1. Отпуск") and got[1] is None


def test_entities_and_types(spark):
    assert apply(spark, T.entity_name, ["«ФНС  России»", " Конкурсный отбор "]) == ["фнс", "конкурс"]
    assert apply(spark, T.document_type, ["Федеральный закон", "РЕГЛАМЕНТ", "нет"]) == ["законодательство", "инструкция", None]


def test_json_and_charts(spark):
    got = apply(spark, T.json_object, ['```json\n{"a": 1}\n```', "x {bad", "text", None])
    assert got == ['{"a": 1}\n'.strip(), None, None, None]
    charts = ["[CHART_JSON]{title: 'T', 'data': [1,2[/CHART_JSON]", "[chart_json]{\"a\":1,}[/chart_json]", "none"]
    got = apply(spark, T.repair_chart, charts)
    assert got[0] and '"title":{"text":"T"}' in got[0].replace(" ", "") and got[1] == '{"a":1}' and got[2] is None


def test_markup_out(spark):
    assert apply(spark, T.markdown_to_html, ["**b** x\n* i\n## H"]) == ["<b>b</b> x\n• i\n<b>H</b>"]
    assert apply(spark, T.escape_markdown, ["a_b*c.", None]) == ["a\\_b\\*c\\.", ""]
    assert apply(spark, T.percent_encode, ["Имя Ф.jpg"]) == ["%D0%98%D0%BC%D1%8F%20%D0%A4.jpg"]
    assert apply(spark, T.scrub_summary, ["Вывод: Министерство налогов и сборов ведёт учёт", "мало"])[0] == "ФНС России ведёт учёт"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.x for r in df.select(cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None
