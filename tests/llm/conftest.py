import pytest

LONG = " ".join(f"w{i % 977} tail{i % 13}" for i in range(30_000))

# null in any column, empty and blank texts, a very long text, ties, repeated rows
ROWS = [
    (1, "The cat sat on the mat", "en", 10),
    (1, "The cat sat on the mat", "en", 10),
    (2, None, None, None),
    (3, "", "de", 0),
    (None, "a row without an id", None, 1),
    (None, "a row without an id", None, 1),
    (None, None, None, None),
    (4, " \n\t ", "fr", 4),
    (5, LONG, "en", 5),
    (6, LONG, "en", 5),
    (-7, "Ünïcode 日本語 \U0001F600 text\n\nwith  spaces \n", "xx", 9),
]

# two words of 2,048 bytes that collide in polynomial hashes modulo 2^64, whatever the base
_MORSE = [bin(i).count("1") & 1 for i in range(2048)]
MORSE = tuple("".join("ab"[b ^ s] for b in _MORSE) for s in (0, 1))

# columns whose names clash with those the operators make for themselves
CLASHING = ("fp key row id body marks is_text part kept places words size n least root group_least "
            "component_id bucket secrets spans n_words start before ref_lang n_docs base ids "
            "kept_id _text_hash around a b node value").split()


@pytest.fixture(scope="session")
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def edge_docs(spark, checkpoints):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_chars long")
    for name in CLASHING:
        df = df.withColumn(name, df["n_chars"])
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
