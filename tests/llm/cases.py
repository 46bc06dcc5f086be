"""Small tables with every awkward case, and the texts behind them."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score string, size string, doc string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed=0):
    rng = random.Random(seed)
    base = words(rng, 120)
    passage = words(rng, 60)
    run = "same " * 200
    return [
        base,
        base,
        base + " end",
        base.upper(),
        None,
        "",
        " \n\t ",
        "one",
        "two words",
        words(rng, 50) + " " + passage + " " + words(rng, 50),
        words(rng, 10) + "\n" + passage.replace(" ", "\n", 5) + "\n" + words(rng, 30),
        run,
        run + "tail",
        "x" * 5000 + " " + words(rng, 3000),
        "Ünïcödé façade " * 30,
        words(rng, 300, 5),
        words(rng, 300, 2),
        "a b " * 100,
        *[words(rng, rng.randrange(1, 200)) for _ in range(40)],
    ]


def documents(spark, rows=None):
    """Rows with a null id, a repeated row, a null source and columns whose names the operators use inside."""
    made = []
    for k, t in enumerate(texts() if rows is None else rows):
        made.append((k, t, "en", None if k % 7 == 3 else f"s{k % 4}", None if t is None else len(t), "fp", "s", "z", "d"))
    if rows is None:
        made.append((None, "text without an id and some more words", None, "s1", 38, None, None, None, None))
        made.append(made[9])
    return spark.createDataFrame(made, DOCS)
