import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 5, n: int = 160) -> list:
    """Rows with copies, near copies, shared passages, benchmark passages, personal data, nulls, empties and a long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage, item = say(60), say(25)
    out = []
    for i in range(n):
        w = say(rng.randint(1, 120))
        if i % 7 == 0:
            w = w[:5] + passage[rng.randint(0, 10) : rng.randint(45, 60)] + w[5:]
        if i % 11 == 0:
            w[3:3] = item[rng.randint(0, 8) : 20]
        if i % 13 == 0:
            w += ["mail", "a.b@c-d.example.com", "+1", "(212)", "555-0100", "4111", "1111", "1111", "1111", "10.0.0.256", "1.2.3.4.5.6.7.8"]
        out.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    out += [(n + i, out[i][1]) for i in range(0, 30, 2)]  # exact copies
    out += [(n + 50 + i, out[i][1] + " tail") for i in range(1, 30, 3)]  # near copies
    out += [(900, None), (901, ""), (902, "  \t\n"), (903, None), (904, "one"), (905, "one two three"), (906, "x " * 300), (907, " ".join(say(6000))), (908, "A b C d " * 30), (5, out[5][1]), (5, out[5][1]), (6, "same id, other text")]
    return out, [(1, " ".join(item)), (2, "one two three"), (3, None), (4, ""), (10, " ".join(item[:12]).upper()), (2, "one two three")]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def sf_dir(spark, rows, tmp_path_factory):
    """A folder of tables; labels mark rows with a bad word."""
    d = tmp_path_factory.mktemp("tables")
    docs, items = rows
    spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 5}" if i % 3 else None, len(t) if t else None) for i, t in docs], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(bool(t) and "ab" in t)) for i, t in docs if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)
