import pytest
from llm_support import TEXTS


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts under ids that repeat, clash and are missing, with a column whose name clashes with results."""
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 8, None]
    return spark.createDataFrame([(i, t, "en", f"s{k}", 0, "clash") for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")
