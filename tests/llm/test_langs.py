import pytest

from quernstone.llm import langs, queries


@pytest.mark.parametrize("tag,code", [("en-GB", "en"), (" DE_at ", "de"), ("Deutsch", "de"), ("français", "fr"), ("English", "en"), ("por", "pt"), ("und", None), ("Unknown", None), ("", None), (None, None), ("sv", "?"), ("nl-BE", "nl")])
def test_tags(tag, code):
    assert langs.named(tag) == code


EN = "The weekly report is written by the people who know the customers and their questions best."
DE = "Der wöchentliche Bericht wird von den Leuten geschrieben, die ihre Kunden und deren Fragen am besten kennen."
FR = "Le rapport de la semaine est écrit par les personnes qui connaissent le mieux les clients et leurs questions."
ES = "El informe semanal lo escriben las personas que mejor conocen a los clientes y sus preguntas de cada día."


@pytest.fixture(scope="module")
def profiles():
    return langs.fit([])  # the seeds alone


def run(spark, rows, profiles=None):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, description string, title string, lang string, parts int, main string")
    return langs.classify(df, "id", "description", "title", "lang", profiles)


def test_sentences_of_each_language(profiles):
    held = {**langs.SEEDS, "en": EN, "de": DE, "fr": FR, "es": ES, "nl": "Het wekelijkse verslag wordt geschreven door de mensen die de klanten en hun vragen het beste kennen.", "it": "Il rapporto della settimana è scritto dalle persone che conoscono meglio i clienti e le loro domande.", "pt": "O relatório da semana é escrito pelas pessoas que conhecem melhor os clientes e as suas perguntas."}
    assert [c for c, _ in profiles.read(list(held.values()))] == list(held)
    assert [c for c, _ in profiles.read([t.upper() for t in held.values()])] == list(held)
    assert all(0 <= s <= 1 for _, s in profiles.read([*held.values(), "", "1 2 3", "☃"]))


def test_mislabelled_and_mixed(spark, profiles):
    rows = [
        ("right", EN, "t", "en-GB"), ("missing", EN, "t", "und"), ("wrong", DE, "t", "EN"), ("mixed", f"{EN} {FR}\n\n{EN}", "t", "en"), ("blank", " ", DE, None), ("blankright", None, DE, "Deutsch"), ("short", "Zu kurz.", "The title says nothing here about it", "fr"),
        ("list", f"{EN}\n\n- {DE}\n* {FR}\n\nÜber uns\n", "t", "en"), ("html", f"<p>{EN}</p><ul><li>{DE}</li></ul>", "t", "en"), ("missing", EN, "t", "und"), (None, EN, "t", "und"), ("nothing", None, None, None), ("long", f"{EN} " * 2000, "t", "de"),
    ]
    got = {tuple(r) for r in langs.mislabelled(run(spark, rows, profiles)).collect()}
    assert got == {("missing", "en"), ("wrong", "de"), ("mixed", "en"), ("mixed", "fr"), ("blank", "de"), ("long", "en")}


def test_parts(spark, profiles):
    r = run(spark, [("m", f"{EN} {EN} {FR}", "t", "en")], profiles).first()
    assert (r.main, [p.lang for p in r.parts]) == ("en", ["en", "fr"]) and 0 < r.confidence <= 1 and r.parts[0].words == 2 * r.parts[1].words - 6 or r.parts[0].words == 32


def test_short_sentences_and_entries_are_classified(spark, profiles):
    rows = [("mixed", f"{EN} Und das ist nicht einfach.\n- {FR}\n1. {DE}\n***", "t", "en"), ("list", f"- {DE}\n- {DE}", "t", "de"), ("short", "Das ist nicht einfach.", "t", "en")]
    got = {r.id: r for r in run(spark, rows, profiles).collect()}
    assert [(p.lang, p.counted) for p in got["mixed"].parts] == [("en", True), ("de", False), ("fr", False), ("de", False)] and got["mixed"].main == "en"
    assert [(got[i].main, len(got[i].parts), got[i].confidence > 0) for i in ("list", "short")] == [("de", 1, True)] * 2
    assert langs.mislabelled(run(spark, rows, profiles)).collect() == []


def test_parts_have_every_posting(spark, tmp_path):
    spark.createDataFrame([("a", f"- {DE}", "t", "de"), ("b", None, None, None), ("c", EN, "t", "en")], "id string, description string, title string, lang string").write.parquet(f"{tmp_path}/criterion_postings.parquet")
    got = {(r.id, r.main, r.part, r.lang, r.counted) for r in queries.p1_parts(spark, str(tmp_path)).collect()}
    assert got == {("a", "de", 0, "de", False), ("b", None, None, None, None), ("c", "en", 0, "en", True)}


def test_wrong_labels_do_not_spoil_profiles():
    rows = [("en", EN)] * 6 + [("de", DE)] * 6 + [("en", DE)] * 2
    assert [c for c, _ in langs.fit(rows).read([EN, DE])] == ["en", "de"]


def test_the_sample_is_not_cut(spark, monkeypatch):
    monkeypatch.setattr(langs, "fit", lambda labelled: labelled)
    df = spark.range(2100).selectExpr("cast(id as string) AS id", "'text' AS text", "'en' AS lang")
    assert len(langs.fit_on(df, "id", "text", "lang")) == 2000


def test_fitted_on_the_table(spark):
    got = run(spark, [(str(i), t, "t", l) for i, (t, l) in enumerate([(EN, "en"), (DE, "de"), (DE, "en")] * 3)])
    assert {(r.stated, r.main) for r in got.collect()} == {("en", "en"), ("de", "de"), ("en", "de")}
    assert run(spark, []).collect() == []
