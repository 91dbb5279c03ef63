import pytest

SF = "/root/testdata/sf0.001"

#: Nulls, empty and odd texts, repeated rows and ids, ties.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (None, "no id here at all"), (None, None),
    (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40), (9, "x" * 1500), (10, "é ü ß 中文 \U0001f600 ÀÉ <|endoftext|> it's"), (11, "Apache License and MIT license; cc-by cc by cc by. SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause text"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with extra columns whose names clash with those of results."""
    rows = [(i, t, None if i == 2 else "en", "s", None, 5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, n_words int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
