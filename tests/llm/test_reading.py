import random

import pytest

from matchloom.llm.queries import p10_found, p10_levels
from matchloom.llm.reading import reading_levels

WORDS = {level: [f"{c}{x}{y}" for c in cs for x in "aeiou" for y in ("la", "mo", "ri")] for level, cs in {1: "bd", 2: "fg", 3: "hk", 4: "ln", 5: "rs"}.items()}
COMMON = ["the", "and", "of", "to", "in"]


def text(r, level, n):
    near = [level] * 6 + [max(1, level - 1)] * 2 + [min(5, level + 1)]
    return " ".join(r.choice(COMMON) if r.random() < 0.3 else r.choice(WORDS[r.choice(near)]) for _ in range(n))


def corpus(r, n=400):
    true = {i: r.randrange(1, 6) for i in range(n)}
    return true, [(i, text(r, true[i], r.randrange(25, 90)).capitalize() + ".") for i in range(n)]


def test_held_out_accuracy(spark):
    r = random.Random(4)
    true, docs = corpus(r)
    labels = [(i, min(5, max(1, true[i] + (r.choice([-1, 1]) if r.random() < 0.15 else 0)))) for i in range(120)]
    labels += [(0, None), (None, 3), (99999, 2), (1, 9)]
    extra = [(1000, ""), (1001, None), (1002, "zzqq xxyy"), (1003, "12 = 4 <b></b> &nbsp;"), (1004, text(r, 5, 40_000)), (1005, "x" * 300_000), (1006, "=" * 300_000)]
    d = spark.createDataFrame(docs + extra, "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in reading_levels(d, spark.createDataFrame(labels, "doc_id bigint, level int")).collect()}
    assert len(got) == len(docs) + len(extra)
    held = [i for i in true if i >= 120]
    assert sum(got[i]["level"] == true[i] for i in held) >= 0.95 * len(held)
    assert all(got[i]["level"] is None for i in (1000, 1001, 1002, 1003, 1005, 1006)) and got[1004]["level"] == 5


def test_salted_words_give_the_same(spark, monkeypatch):
    from matchloom.llm import reading

    r = random.Random(5)
    true, docs = corpus(r, 80)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, true[i]) for i in range(60)], "doc_id bigint, level int")
    plain = sorted(map(tuple, reading_levels(d, labels).collect()))
    monkeypatch.setattr(reading, "ROWS_PER_KEY", 10)
    monkeypatch.setattr(reading, "SMALL", 0)
    salted = sorted(map(tuple, reading_levels(d, labels).collect()))
    assert [(a[0], a[2]) for a in plain] == [(a[0], a[2]) for a in salted]


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, level int")
    assert reading_levels(spark.createDataFrame([], "doc_id bigint, text string"), none).count() == 0
    with pytest.raises(ValueError):
        reading_levels(spark.createDataFrame([(1, "word word word")], "doc_id bigint, text string"), none)


def test_every_document_has_a_row(spark, tmp_path):
    r = random.Random(6)
    true, docs = corpus(r, 120)
    german = lambda: " ".join(r.choice(["und", "der", "nicht", "the", "mit", "einheit"]) for _ in range(40))
    rows = [(i, t, "en") for i, t in docs] + [(200 + i, german(), "de") for i in range(10)]
    rows += [(300 + k, text(r, k, 60), None) for k in (1, 5)] + [(400, german(), None), (401, "", None), (402, None, None), (403, "", "en"), (404, "zzqq", None), (None, "the", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, true[i]) for i in range(80)], "doc_id bigint, level int").write.parquet(f"{tmp_path}/reading_labels.parquet")
    got = {x["doc_id"]: x for x in p10_levels(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(x[0] for x in rows if x[0] is not None)
    assert all((x["level"] is None) == (x["reason"] is not None) == (x["difficulty"] is None) for x in got.values())
    assert (got[301]["level"], got[305]["level"]) == (1, 5) and got[301]["language"] == "en"
    assert {got[i]["reason"] for i in (200, 400)} == {"no labels in this language"} and got[400]["language"] == "de"
    assert {got[i]["reason"] for i in (401, 402, 404)} == {"language unknown"} and got[403]["reason"] == "no words to go by"
    five = {x["doc_id"] for x in p10_found(spark, str(tmp_path)).collect()}
    assert five == {i for i, x in got.items() if x["level"] == 5 and i < 200}
