from clauselake.llm import secrets


def test_a_weak_part_inside_a_long_secret_is_linked(spark):
    for size in (150, 700, 5000):
        text = "secret=" + "a" * size + "/access_id=abcdefgh/" + "b" * size
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        assert [s.kind for s in secrets.scan(df).first().weak] == ["client"], size
