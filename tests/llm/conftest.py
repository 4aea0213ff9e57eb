import pytest

from cases import CLASHING, prose
from usageloom.llm.queries import reachable


@pytest.fixture(scope="session")
def make_docs(spark):
    reachable(spark)

    def make(texts, first=0, clash=False):
        rows = [(first + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for i, t in enumerate(texts)]
        schema = "doc_id long, text string"
        if clash:
            rows = [(*r, *[f"{name}-{i}" for name in CLASHING]) for i, r in enumerate(rows)]
            schema += "".join(f", `{name}` string" for name in CLASHING)
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties, repeated rows, a null doc_id, a very long text."""
    long = prose(99, 30_000)
    copy = prose(1, 120)
    return [
        (0, copy), (1, None), (2, ""), (3, " \t\n\x0b "), (4, copy), (4, copy), (None, prose(2, 60)), (None, None),
        (5, copy.replace("the", "THE", 1)), (6, "one"), (7, "日本語 テスト"), (8, long), (9, long + " end"), (10, "!!! ### 123"),
        (11, copy + "\n" + prose(3, 40)), (12, "a" * 5000), (13, "\n\n\n"),
    ]
