import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, cls string, spans array<int>, token double"


def edge_rows():
    """Rows no job may stumble over: no text, no words, ties, repeats, long texts, no id, bare secrets."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    line = "The same line of a licence text that many documents share, word by word and blank by blank, to its end."
    return [
        (1001, None), (1002, ""), (1003, " \n\t "), (1004, "..."), (1005, "one"), (1006, "one two"), (1007, "One TWO"),
        (1008, long), (1009, long), (1010, long + " more"), (1011, "a" * 350), (1012, "a" * 120), (1013, line), (1014, "x " + line + " y"),
        (1015, line + line), (1016, "é" * 130), (1017, " wide blanks " * 30), (1018, 'PassWord = "abc123" token:x secret=abcdefg'),
        (1019, "AKIA" + "Z9" * 10 + " " + "0f" * 14 + " api_key=" + "0f" * 14), (1020, "AKIASHORT deadbeef password=12345"),
        (1021, line), (1021, line), (1022, "<|endoftext|> It's 3 o'clock ＡＢＣ ǅ İ ſecret=abcdefgh"), (None, line), (None, None),
    ]


@pytest.fixture(scope="session")
def rows():
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in table] + edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The smallest documents and the edge rows, with further columns whose names clash."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    full = [(d, t, "en", "s", len(t or ""), k, None, None, float("nan")) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


def pulled(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
