import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shipped(spark):
    from vigilframe.session import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def documents(shipped):
    return shipped.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(shipped, documents):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(20000))
    rows = [
        (10_001, None, None, None, None),
        (10_002, "", "en", "src1", 0),
        (10_003, " \n\t ", "en", None, 4),
        (10_004, long, None, "src2", len(long)),
        (10_005, "one", "en", "src2", 3),
        (10_006, "One", "en", "src2", 3),
        (None, "a text without a number that has a few words", "en", "src1", 44),
    ]
    extra = shipped.createDataFrame(rows, documents.schema)
    all_rows = documents.union(extra).union(documents.where("doc_id < 5"))
    clash = {c: F.lit(1) for c in ("node", "size", "bucket", "pos", "tok", "h", "w", "t", "s", "g", "cell", "n", "file", "text_hash")}
    return all_rows.withColumns(clash).cache()


@pytest.fixture(scope="session")
def none(documents):
    return documents.where("false")
