import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node int, base string"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = []
    for i in range(0, n, 12):
        out.append(" ".join(words[i : i + 12]).capitalize() + ".")
    return "\n".join(" ".join(out[i : i + 4]) for i in range(0, len(out), 4))


def odd_rows() -> list[tuple]:
    """Nulls in each column, empty and long texts, ties and repeated rows, columns of clashing names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    text = prose(rng, 80)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, text, None, "a", 9), (4, text, "en", None, 9), (None, text, "en", "a", 9), (None, None, None, None, None),
        (5, long, "de", "b", len(long)), (6, " \n\t ", "de", "b", 4), (7, text, "en", "a", 9), (7, text, "en", "a", 9), (8, "x" * 50_000, "fr", "c", 50_000), (9, "Word " * 300, "fr", "c", 1500),
        (10, "漢字 \U0001f600 é ß " * 40, "zz", "c", 1), (11, text.replace("a", "b", 1), "en", "a", 9), (12, "one two three", "en", "", 13), (13, "one two three", "en", "", 13),
    ]
    return [(*r, "s", 1, "b") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables with odd rows."""
    top = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 1, 0), (8, 0, 0), (9, 0, 0), (99, 1, 0), (None, 1, 0), (4, None, 0), (5, 1, None), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    pages = [(1, None, None), (2, "", ""), (3, "http://a.example.com/en/1", "<p>Hi"), (3, "http://a.example.com/en/1", "<p>Hi"), (None, "nothing", "<" * 1000), (4, "HTTPS://u@A.Example.com:80/en/2?x#y", "<div>" * 3000 + "deep"), (5, "http://x/", "<article><p>" + "word " * 40_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="session")
def bare(spark, tmp_path_factory):
    """A folder of empty tables."""
    top = str(tmp_path_factory.mktemp("bare"))
    spark.createDataFrame([], DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="session")
def some(spark, tmp_path_factory):
    """A folder of made-up documents with copies, near copies, junk and personal data."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        text, good = prose(rng, rng.randint(15, 400)), 1
        if i % 7 == 0 and rows:
            text = rng.choice(rows)[1]
        elif i % 5 == 0 and rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        elif i % 11 == 0:
            text, good = " ".join(w + "$$$" for w in text.split()), 0
        elif i % 13 == 0:
            text, good = text.upper().replace(" ", "!! "), 0
        if i % 6 == 0:
            text += f" mail me.{i}@mail.example.com or +1 (555) 555-{1000 + i}, 10.0.{i}.1, 4111 1111 1111 1111."
        good = int("$$$" not in text and "!! " not in text)
        rows.append((i, text, rng.choice(("en", "de")), f"src{rng.randint(0, 4)}", len(text), "s", 1, "b"))
        labels.append((i, good, 0))
    top = str(tmp_path_factory.mktemp("some"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top
