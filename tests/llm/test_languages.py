import pytest
from pyspark.sql import functions as F

from lodestrata.llm import langmix

TEXTS = {
    "en": "We are looking for a person who can plan the work of the team and explain the results to our customers. You will write reports and help your colleagues every week.",
    "fr": "Nous cherchons une personne capable de préparer le travail de l'équipe et d'expliquer les résultats à nos clients. Vous allez rédiger des rapports et aider vos collègues chaque semaine.",
    "de": "Wir suchen eine Person, die die Arbeit der Gruppe planen und unseren Kunden die Ergebnisse erklären kann. Sie schreiben jede Woche Berichte und helfen Ihren Kollegen.",
    "es": "Buscamos una persona capaz de preparar el trabajo del equipo y de explicar los resultados a nuestros clientes. Vas a redactar informes y ayudar a tus compañeros cada semana.",
    "it": "Cerchiamo una persona capace di preparare il lavoro della squadra e di spiegare i risultati ai nostri clienti. Dovrai scrivere relazioni e aiutare i colleghi ogni settimana.",
    "pt": "Procuramos uma pessoa capaz de preparar o trabalho da equipa e de explicar os resultados aos nossos clientes. Deverá escrever relatórios e ajudar os colegas todas as semanas.",
    "nl": "Wij zoeken iemand die het werk van de ploeg kan voorbereiden en onze klanten de resultaten goed uitlegt. Je schrijft elke week verslagen en helpt je collega's.",
}


@pytest.fixture(scope="module")
def model():
    texts, labels = [], []
    for code, text in TEXTS.items():
        texts += [text] * 6
        labels += [code] * 5 + ["en" if code != "en" else "fr"]  # a sixth is labelled wrongly
    return langmix.fit(texts, labels)


@pytest.mark.parametrize("code", TEXTS)
def test_single_language(model, code):
    (row,) = langmix.label_texts([TEXTS[code]], model)[0]
    assert row[:2] == (0, code) and row[2] > 0.9


def test_mixed_text_has_segments_by_position(model):
    text = f"{TEXTS['en']}\n\nShort one.\n\n{TEXTS['de']}\n \n{TEXTS['en']}"
    rows = langmix.label_texts([text], model)[0]
    assert [r[:2] for r in rows] == [(0, "en"), (1, "en"), (3, "de"), (4, "en")]
    upper = langmix.label_texts([text.upper()], model)[0]
    assert [r[:2] for r in upper] == [r[:2] for r in rows]


def test_batches_do_not_mix(model):
    texts = ["", TEXTS["fr"], "   ", "123 456", TEXTS["nl"], "x"]
    alone = [langmix.label_texts([t], model)[0] for t in texts]
    assert langmix.label_texts(texts, model) == alone
    assert alone[0] == [(0, None, 0.0, 0)] and alone[1][0][1] == "fr" and alone[4][0][1] == "nl"


@pytest.mark.parametrize("declared,code", [("en_GB", "en"), ("EN", "en"), ("fra", "fr"), ("Deutsch", "de"), ("español", "es"), ("it-CH", "it"), (" nl ", "nl"), ("Portuguese", "pt"), ("pt (Brasil)", "pt"),
                                           ("und", None), ("n/a", None), ("-", None), ("", None), (None, None), ("sv", None), ("end", None)])
def test_declared(spark, declared, code):
    df = spark.createDataFrame([(declared,)], "d string")
    assert df.select(langmix.declared_language(F.col("d"))).first()[0] == code


def test_table(spark, model):
    df = spark.createDataFrame([("a", TEXTS["it"], "x"), ("b", None, "x"), ("a", TEXTS["it"], "x"), (None, "word " * 30_000, "x")], "id string, text string, lang string")
    rows = langmix.assign_languages(df, model, ["id"], "text").collect()
    assert [r["lang"] for r in rows if r["id"] == "a"] == ["it", "it"] and len(rows) == 4
    assert next(r for r in rows if r["id"] == "b")["lang"] is None and next(r for r in rows if r["id"] is None)["words"] == 30_000
    assert langmix.assign_languages(df.limit(0), model, ["id"], "text").count() == 0


def test_sample_is_by_language(spark):
    df = spark.createDataFrame([(str(i), TEXTS[c], c) for i, c in enumerate(["en", "de"] * 20)], "id string, t string, l string")
    texts, labels = langmix.sample(df, "id", "t", F.col("l"), rows=100)
    assert len(texts) == 40 and set(labels) == {"en", "de"}


@pytest.mark.parametrize("text", [
    "Мы ищем человека, который сможет планировать работу команды и объяснять результаты нашим клиентам.",
    "私たちはチームの仕事を計画し、結果をお客様に説明できる人を探しています。毎週報告書を書きます。",
    "Szukamy osoby, która potrafi zaplanować pracę zespołu i wyjaśnić wyniki naszym klientom. Będziesz pisać raporty i pomagać kolegom każdego tygodnia.",
    "Vi söker en person som kan planera gruppens arbete och förklara resultaten för våra kunder. Du skriver rapporter och hjälper dina kollegor varje vecka.",
])
def test_none_of_these(spark, text):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langmix.fit(*langmix.sample(docs, "doc_id", "text", langmix.declared_language(F.col("lang"))))
    assert langmix.label_texts([text], model)[0][0][1:3] == (None, 0.0)
    for code, own in TEXTS.items():
        assert langmix.label_texts([own], model)[0][0][1] == code


def test_confidence_of_short_texts_is_moderate(model):
    (short,), (long,) = langmix.label_texts(["in die", TEXTS["de"]], model)
    assert short[2] < long[2] <= 1


def test_languages_are_those_of_the_labels():
    model = langmix.fit([TEXTS["de"], TEXTS["fr"]] * 10, ["x", "y"] * 10)
    assert [langmix.label_texts([TEXTS[c]], model)[0][0][1] for c in ("de", "fr")] == ["x", "y"]
    assert langmix.label_texts(["some words"], langmix.fit([], [])) == [[(0, None, 0.0, 2)]]
