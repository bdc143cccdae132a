import pytest

from feedloom.llm import mojibake as m

CLEAN = [
    "Über größere Bücher und schöne Häuser, die wir gern mögen: „Ja“, sagte er — ganz plötzlich.",
    "L’été à la bibliothèque était très agréable, où l’équipe a répété « ses excuses » après dîner.",
    "A canção já não está no ar: ATENÇÃO, não há ligação até amanhã, às três.",
    "¿Quién cuidará la próxima galería? Mañana será otro día, según él.",
    "Команда исправила ошибки, и новая лента вышла с задержкой, сообщает город.",
    "日曜に新しい市場が倍になりました。「静かな番組でした」と語った。",
    "“It was a café” — nobody didn’t mind the naïve façade…",
] * 30


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CLEAN)] + [(999, None), (1000, "")], "id bigint, text string")
    got, report = m.train(df, "text", "id")
    assert report["margin"] >= m.LEAST_MARGIN and report["words"] > 20 and report["found_utf8"] > 0.9
    return got


def test_the_margin_comes_from_words_held_out(spark, monkeypatch):
    """Records of the sixteenth that is held out are in no count, and a model that knows nothing of the text fails its validation."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, f"żółć{chr(0x100 + k % 200)}x é") for k in range(3000)], "id bigint, text string")
    held = F.pmod(F.xxhash64("id"), F.lit(m.HELD_OUT)) == 0
    alone = df.where(held)
    empty, report = m.train(alone, "text", "id")
    assert not empty.logs and report["words"] > 0
    assert m.train(df, "text", "id")[0].logs == m.train(df.where(~held), "text", "id")[0].logs
    # clean words that look garbled raise the margin until hardly any changes
    odd = spark.range(2000).select("id", F.when(held, "CafÃ© für").otherwise("Café ist schön über").alias("text"))
    model, report = m.train(odd, "text", "id")
    assert report["margin"] > m.LEAST_MARGIN and report["false_rate"] == 0
    monkeypatch.setattr(m, "ENOUGH", 1)
    monkeypatch.setattr(m, "LEAST_RECALL", 1.01)
    with pytest.raises(ValueError, match="don't tell"):
        m.train(df, "text", "id")


def test_every_record_counts_and_every_word_is_judged(spark, tmp_path):
    """All folds are in the model and each is held out once; long words are judged as well."""
    from pyspark.sql import functions as F

    from feedloom.llm import queries

    fold, long = F.pmod(F.xxhash64("doc_id"), F.lit(m.HELD_OUT)), "日曜に新しい市場が倍になりました。" * 5
    text = F.when(fold == 0, "żółw").when(fold == 5, "CafÃ© für").when(fold == 7, long).otherwise("Café ist schön über")
    docs = spark.range(2000).select(F.col("id").alias("doc_id")).withColumn("text", text)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.p5_validation(spark, str(tmp_path)).first()
    assert got.words == 1 + 2 + 1 + 13 * 3 and got.garbled_utf8 + got.garbled_other > 0
    model, report = m.train_whole(docs, "text", "doc_id")
    assert {ord(a) << 21 | ord(z) for a, z in ("żó", "Ã©", "日曜", "ön")} <= set(model.logs)
    assert report["margin"] == model.margin == got.margin > m.LEAST_MARGIN and report["false_rate"] == 0
    # the odd words of fold 5 are judged by counts without them, and no chain of theirs may pass
    without, _ = m.train_whole(docs.where(fold != 5), "text", "doc_id")
    assert without.best("CafÃ©")[0] <= model.margin


def test_the_margin_is_the_rate_over_all_words(spark, monkeypatch):
    """With a rate that lets some words change, the margin is the gain of the first that may not."""
    df = spark.createDataFrame([(k, "Café ist schön über" if k % 40 else f"CafÃ© {'Ã¼' * (k // 40 + 1)}") for k in range(800)], "id bigint, text string")
    monkeypatch.setattr(m, "FALSE_RATE", 0.05)
    rows = m._folds(df, "text", "id")
    tried = m._tried(rows, m._tallied(rows), range(m.HELD_OUT), False)
    clean = [r.gain for r in tried.where("utf8 is null").collect()]
    gains = sorted((g for g in clean if g is not None), reverse=True)
    model, report = m.train_whole(df, "text", "id")
    assert report["words"] == len(clean) and 0 < int(len(clean) * 0.05) < len(gains)
    assert report["margin"] == max(m.LEAST_MARGIN, gains[int(len(clean) * 0.05)] + 0.1)
    assert report["false_rate"] == sum(g > report["margin"] for g in gains) / len(clean) <= 0.05


def test_clean_stays(model):
    for t in set(CLEAN) | {"", "plain", "ÃO, ÇÃO e ÕES: lição 189", "Ångström 587 °C ± 2 £9 ½ № ™"}:
        assert not m.check(t, model), t
        assert m.restore(t, model) == t
    assert not m.check(None, model) and m.restore(None, model) is None


@pytest.mark.parametrize("wrong", ["cp1252", "cp1250", "cp437", "cp850", "mac_roman", "cp1251"])
def test_utf8_taken_for_a_code_page(model, wrong):
    for t in dict.fromkeys(CLEAN):
        bad = " ".join(m.garble(w, "utf-8", wrong) for w in t.split(" "))
        assert m.check(bad, model), bad
        if wrong != "cp1252" or "日" not in t:
            assert m.restore(bad, model) == t


def test_twice_and_by_reference(model):
    bad = m.garble(m.garble("größer", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert m.restore(f"Das ist {bad} als", model) == "Das ist größer als"
    assert m.restore("caf&#195;&#169; &#226;&#8364;&#8221; now", model) == "café — now"
    assert not m.check("caf&#233; now", model)


@pytest.mark.parametrize("true, wrong, t", [("cp1251", "cp1252", CLEAN[4]), ("koi8_r", "cp1251", CLEAN[4]), ("shift_jis", "cp1252", CLEAN[5]), ("euc_jp", "cp1252", CLEAN[5])])
def test_other_encodings(model, true, wrong, t):
    bad = " ".join(m.garble(w, true, wrong) for w in t.split(" "))
    assert m.check(bad, model)
    assert sum(a == b for a, b in zip(m.restore(bad, model), t)) / len(t) > 0.7


def test_lost_characters(model):
    assert m.check("caf� now", model) and m.check("it\x92s", model)
    assert m.restore("caf� now", model) == "caf� now"


def test_operator(spark, model):
    rows = [(1, "CafÃ© notes", None), (2, "Café", "<p>naÃ¯ve</p>"), (3, None, ""), (4, "x" * 100_000 + " Ã©", "plain")]
    df = spark.createDataFrame(rows, "item_row bigint, title string, content_html string").selectExpr("*", "1 as field", "2 as restored")
    got = {(r.item_row, r.field): (r.restored, r.complete) for r in m.restored(df, "item_row", ("title", "content_html"), model).collect()}
    assert got[1, "title"] == ("Café notes", True) and got[2, "content_html"] == ("<p>naïve</p>", True)
    assert {tuple(r) for r in m.found(df, "item_row", ("title", "content_html"), model).collect()} == set(got)
    assert (2, "title") not in got and (3, "content_html") not in got
    assert m.found(df.limit(0), "item_row", ("title",), model).count() == 0
    empty, _ = m.train(spark.createDataFrame([], "id bigint, text string"), "text", "id")
    assert not m.check("plain", empty)
