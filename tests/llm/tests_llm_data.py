"""Small tables for the tests of this folder."""

WORDS = "the of and to in alpha beta gamma delta river stone cloud amber forest quiet signal marble harbor velvet copper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing"]) for _ in range(n))


def documents(spark, rows):
    """A documents table with extra columns that carry names the operators use inside."""
    data = [(i, t, "en", "s", len(t or ""), 1, "x", 0.5) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n int, digest string, score double")
