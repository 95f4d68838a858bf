import random

from clauselake.llm import language


def test_a_language_of_two_long_texts_is_fitted(spark):
    rng = random.Random(4)
    stock = {"aa": "kala mara tano sika vilo perun".split(), "zz": "qwyx zhurg bxolt vrymp jzekk".split()}
    rows = [(i, " ".join(rng.choice(stock["aa"]) for _ in range(60)), "aa") for i in range(300)]
    rows += [(i, " ".join(rng.choice(stock["zz"]) for _ in range(20_000)), "zz") for i in (1000, 1001, 1002, 1003, 1004, 1005)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    zz = df.where("lang = 'zz'").where(~language.held_out(df.doc_id)).orderBy("doc_id").limit(2)
    found = language.fit(df.where("lang = 'aa'").union(zz), sample_chars=2_000)
    assert found.model.langs == ["aa", "zz"]
    assert all(x < float("inf") for x in found.limits)
    assert {(r.lang_pred, r.rejected) for r in language.predict(df.where("lang = 'zz'"), found).collect()} == {("zz", False)}
