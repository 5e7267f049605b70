import random
import re

import pytest
from pyspark.sql import functions as F

from quernstone.operators import chunk as C

SCHEMA = "id long, text string"


def texts(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Aa", "bb", "ccc", "Dd"])
    out = [None, "", "  ", "one", "x " * 95]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 9)):
            mark = rng.choice(["", "", "1. ", "2.3. ", "а) ", "4) "])
            parts.append(mark + " ".join(word() + rng.choice(["", "", ".", "!", ";"]) for _ in range(rng.randint(1, 45))))
        out.append(rng.choice(["\n", "\n\n"]).join(parts))
    return out


def by_doc(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def slow_pack(units, limit):
    """units: (text, tokens, break, repeat, separator)"""
    chunks, cur = [], []
    total = lambda us: sum(u[1] for u in us)
    join = lambda us: "".join((u[4] if i else "") + u[0] for i, u in enumerate(us))
    for u in units:
        if cur and (u[2] or total(cur) + u[1] > limit):
            chunks.append((join(cur), total(cur)))
            tail = [] if u[2] or not u[3] else cur[-u[3] :]
            cur = tail if total(tail) + u[1] <= limit else []
        cur = [*cur, u]
    return [*chunks, (join(cur), total(cur))] if cur else chunks


def sentences(t):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t or "") if s.strip()]


@pytest.mark.parametrize(("repeat", "repeat_words"), [(0, 0), (1, 6), (2, 3)])
def test_sentence_packing_against_brute_force(spark, repeat, repeat_words):
    docs = dict(enumerate(texts()))
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    got = by_doc(C.overlapping_sentences(df, "id", "text", 30, repeat, repeat_words), "idx", "text", "n")
    want = {}
    for i, t in docs.items():
        units = []
        for s in sentences(t):
            words = s.split()
            units += [(s, len(words), False, repeat, " ")] if len(words) <= 30 else [(w, 1, k == 0, repeat_words, " ") for k, w in enumerate(words)]
        if chunks := [(k + 1, *c) for k, c in enumerate(slow_pack(units, 30))]:
            want[i] = chunks
    assert got == want


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(23)))), (2, ""), (3, None), (4, "a b c")], SCHEMA)
    got = by_doc(C.fixed_windows(df, "id", "text", 10, 3), "idx", "text", "n")
    assert [len(x[1].split()) for x in got[1]] == [10, 10, 9] and got[1][1][1].split()[0] == "7" and got[4] == [(1, "a b c", 3)] and set(got) == {1, 4}


@pytest.mark.parametrize("version", sorted(C.LEGAL))
def test_legal_chunks_keep_their_limits(spark, version):
    docs = dict(enumerate(texts(40, version)))
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    spec = C.LEGAL[version]
    got = by_doc(C.legal_chunks(df, "id", "text", version, limit=60), "idx", "text", "n")
    assert got
    for i, chunks in got.items():
        assert [c[0] for c in chunks] == list(range(1, len(chunks) + 1))
        body = re.sub(r"\s+", "", docs[i])
        for _, text, n in chunks:
            assert text.strip() and len(text) >= spec.get("least_chars", 0) and len(text.split()) == n >= spec.get("least_tokens", 0)
            assert n <= 60 or len(spec["finer"]) == 1 or spec["finer"][-1] is C.legal_sentences
            if version and not spec.get("repeat"):
                assert re.sub(r"\s+", "", text)[:20] in body
        if spec.get("unique"):
            assert len({c[1] for c in chunks}) == len(chunks)


def test_merge_small(spark):
    rows = [(1, [("a", 5), ("b", 50), ("c", 3), ("d", 90), ("e", 4)]), (2, [("a", 200)]), (3, [("a", 60), ("b", 60), ("c", 2)]), (4, [])]
    df = spark.createDataFrame(rows, "id long, c array<struct<text:string,n:int>>")
    got = {r.id: [(x.text, x.n) for x in r.m] for r in df.select("id", C.merge_small(F.col("c"), 10, 100).alias("m")).collect()}
    assert got == {1: [("a\n\nb", 55), ("c\n\nd\n\ne", 97)], 2: [("a", 200)], 3: [("a", 60), ("b\n\nc", 62)], 4: []}


def test_atomic_parts(spark):
    law = "Вводная часть документа\n# Глава 2. Служба\n### Статья 7. Отпуск\nвступление статьи\n1. Первая часть статьи\n2. Вторая\n3. Третья часть тут\nРаздел 5 Иное\n### Статья 8\nтело статьи восемь"
    got = by_doc(C.atomic_parts(spark.createDataFrame([(1, law), (2, None)], SCHEMA), "id", "text", F.lit("ФЗ")), "article", "idx", "chapter", "text")
    assert [(a, i, c) for a, i, c, _ in got[1]] == [("7", 1, "2"), ("7", 2, "2"), ("7", 4, "2"), ("8", 1, "5")]
    assert got[1][1][3] == "[ФЗ] [Глава 2. Служба] [Статья 7. Отпуск]\n1. Первая часть статьи"


def test_registry(spark):
    text = "Раздел 1\nДолжности категории A\nВысшая группа должностей\n| Советник | 01-1-1-001 |\n|---|---|\nСистема ГАРАНТ 01-1-1-009\n| Без кода | - |\nРаздел 2\n| Помощник | 02-2-2-002* |"
    df = spark.createDataFrame([(1, text)], SCHEMA)
    got = [r[1] for r in by_doc(C.registry_rows(df, "id", "text"), "pos", "text")[1]]
    assert got == ["• Советник | КОД: `01-1-1-001` | ГРУППА: Высшая группа должностей | КАТЕГОРИЯ: Должности категории A | Раздел 1", "• Помощник | КОД: `02-2-2-002*` | ГРУППА: Высшая группа должностей | КАТЕГОРИЯ: Должности категории A | Раздел 2"]
    assert [x[0] for x in by_doc(C.registry_chunks(df, "id", "text", 20), "idx")[1]] == [1, 2]


def test_colon_context(spark):
    text = "Преамбула закона\n1. Суды рассматривают дела:\nо налогах\nо сборах\nКороткое:\nВ других случаях решают:\nиначе"
    got = by_doc(C.colon_context(spark.createDataFrame([(1, text), (2, "")], SCHEMA), "id", "text", 50), "part", "context", "text")
    assert got == {1: [(0, "Преамбула закона", "Преамбула закона"), (1, "1. Суды рассматривают дела:", "о налогах\nо сборах\nКороткое:"), (2, "В других случаях решают:", "иначе")]}


def test_method_recommendations(spark):
    text = "# Раздел А\nПростой текст достаточной длины тут\nкоротко\n## Подраздел\n1. Первый **пункт**\nпродолжение пункта\n2. Второй пункт\nТаблица № 1\nстрока таблицы\n# Раздел Б\n1. Снова первый"
    got = by_doc(C.method_recommendations(spark.createDataFrame([(1, text)], SCHEMA), "id", "text"), "path", "kind", "text")[1]
    assert got == [
        ("Раздел А", "text", "Простой текст достаточной длины тут"), ("Раздел А → Подраздел → Пункт 1", "point", "Первый пункт\nпродолжение пункта"), ("Раздел А → Подраздел → Пункт 2", "point", "Второй пункт"),
        ("Раздел А → Подраздел → Таблица", "table", "Таблица № 1\nстрока таблицы"), ("Раздел Б → Пункт 1", "point", "Снова первый"),
    ]


def test_decrees_sections_ids_and_audit(spark):
    text = "Вступление указа, длинное достаточно для порога в пятьдесят\n1. " + "слово " * 30 + "\n" + "ещё " * 30 + "\n2. мало"
    df = spark.createDataFrame([(1, text)], SCHEMA)
    got = by_doc(C.decree_points(df, "id", "text", 40), "idx", "n")[1]
    assert [n for _, n in got] == [8, 31, 30]
    rows = C.section_points(spark.createDataFrame([(1, "### Раздел 1\n1. a b\n2. c d\n3. e f\n**Жирный**\nтекст")], SCHEMA), "id", "text", 6)
    assert by_doc(rows, "section", "idx", "title", "text")[1] == [(0, 1, "Раздел 1", "1. a b\n\n2. c d"), (0, 2, "Раздел 1", "2. c d\n\n3. e f"), (1, 1, "Жирный", "текст")]
    assert [r.id for r in C.chunk_ids(spark.createDataFrame([("Раздел  №1!", 2)], "t string, n int"), "doc", "t", "n").collect()] == ["doc_раздел_1_2"]
    assert tuple(C.audit(spark.createDataFrame([(1, "a b"), (2, "c")], SCHEMA)).first()) == (2, 2, 1.5, 0, 2)
