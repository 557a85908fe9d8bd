import pytest

#: Nulls, empty and white-space texts, one word, repeats, unusual white space, and a text far longer than a block.
LONG = " ".join(f"word{k % 9973}x{k}" for k in range(250_000))
TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "One two three four", "a b c d e f g h " * 6, "line\nline\nline\nother words here", "naïve café — ünïcode 漢字 😀 words", "tab\tsep\x0bvt\x0cff\rcr", "same text here for all five words", "same text here for all five words", "Same Text here for all FIVE words", LONG]


def rows():
    out = [(k, t, "x" if k % 3 else None, k) for k, t in enumerate(TEXTS)]
    out += [out[9], (None, "same text here for all five words", "x", 1), (None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names operators use themselves."""
    names = "doc_id long, text string, source string, n_words long"
    df = spark.createDataFrame(rows(), names)
    for clash in ("kept", "digest", "node", "size", "position", "before", "part", "target", "shard", "id", "row", "key"):
        df = df.selectExpr("*", f"cast(null as string) as `{clash}`")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
