"""Rules of language identification that hold whatever the number of languages."""

import pytest
from lexispark.llm import language
from lexispark.llm import queries as Q
from pyspark.sql import functions as F

FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura",
    "Litwo! Ojczyzno moja! ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler",
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
    "xqzv kkwjq zzxqp vbnmq wqxzj kjhgf qzwxv pqlmz xxkq jvwq zqxj bvkz",
]


@pytest.mark.parametrize("languages", [["en", "fr", "de", "es"], ["en", "de"], ["en"]])
def test_the_pipeline_rejects_unlearned_languages(spark, languages):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = Q.read_table(spark, "/root/testdata/sf0.01", "documents").where(F.col("lang").isin(languages))
    foreign = spark.createDataFrame([(-1 - i, t, len(t)) for i, t in enumerate(FOREIGN)], "doc_id bigint, text string, n_chars bigint")
    mixed = docs.unionByName(foreign.select(*(F.col(c) if c in foreign.columns else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes)))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, mixed, "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 90) * 3} {chr(0x4E00 + i % 90)}word {i // 90}", f"l{i % 90:02}") for i in range(450)] + [(9999, "ɣɣɣ ɣʘ", "rare")]
    docs = spark.createDataFrame(rows, "key bigint, text string, lang string")
    model = language.KernelModel.fit(*language.labelled_sample(docs))
    assert len(model.languages) == 91
    got = language.predict(docs, model).select("lang", "lang_pred").collect()
    assert len(got) == 451 and all(r.lang == r.lang_pred for r in got)


def test_the_sample_is_bounded_in_all(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS_PER_LANGUAGE", 10)
    monkeypatch.setattr(language, "ROWS_IN_ALL", 40)
    rows = [(i, f"text {i}", f"l{i % 20:02}") for i in range(2000)]
    texts, labels = language.labelled_sample(spark.createDataFrame(rows, "key bigint, text string, lang string"))
    assert sorted(labels) == sorted([f"l{i:02}" for i in range(20)] * 2) and len(texts) == 40


def test_long_texts_and_copies_leave_no_language_out(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS_PER_LANGUAGE", 10)
    long = "übermäßig öde " * 8000
    rows = [(i, f"{i} {long}", "long") for i in range(3)] + [(7, "the same text again", "copies")] * 3000 + [(100 + i, f"{i} another text", "copies") for i in range(30)] + [(5000, "seul", "few"), (5001, f"x {long}", "few")]
    texts, labels = language.labelled_sample(spark.createDataFrame(rows, "key bigint, text string, lang string"))
    assert {x: labels.count(x) for x in labels} == {"long": 3, "copies": 10, "few": 1}
    period = ("übermäßig öde " * 2).encode()
    whole = {n << 24 | int.from_bytes(period[i : i + n], "big") for n in (1, 2, 3) for i in range(len(period) - n)}
    assert all(whole <= set(codes.tolist()) for codes, x in zip(texts, labels, strict=True) if x == "long")  # of whole texts
    assert sum(len(codes) < 40 for codes, x in zip(texts, labels, strict=True) if x == "copies") == 10
