import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    from quadhap.llm.common import ship

    ship(spark)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, lang) rows, with columns whose names operators use inside."""

    def build(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 7, "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", row bigint, spans string").repartition(parts)

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


ODD_TEXTS = [None, "", " ", "\n\n", "a", "ä", "É", "1", "…", "word", "two words", "x " * 3000, "q" * 70_000, "  lead", "tail  ", "a\tb \n c", "中文 テキスト", "😀 a 😀", "é́ x", "don't we'll 'S 's", "<|endoftext|> a<|endoftext|>", " x　 y  z", "A" * 300 + " " * 300 + "1" * 300]
