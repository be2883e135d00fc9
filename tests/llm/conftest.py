import pytest

#: Columns that operators do not read, named like their own.
CLASHING = "score double, spans string, node long, word string, n_tokens int, `print` binary, samples binary"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with further columns of clashing names."""

    def make(rows, text="text"):
        return spark.createDataFrame([(i, t, 0.5, "x", 1, "w", 3, b"p", b"s") for i, t in rows],
                                     f"doc_id long, {text} string, {CLASHING}")

    return make


@pytest.fixture(scope="session")
def awkward(frame):
    """Null id, null and empty texts, repeated rows, a very long text, a long run without spaces, line ends."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[(k * k + k // 7) % 10] + str(k % 97) for k in range(60_000))
    return frame([(1, None), (2, ""), (3, "  \n\t "), (4, "one two three four five six"), (4, "one two three four five six"),
                  (None, "one two three four five six"), (5, long), (6, "x" * 30_000), (7, "!!! ... ???"),
                  (8, "é ß\r\n漢字 🙂 <|endoftext|> tail"), (9, "one two")])


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
