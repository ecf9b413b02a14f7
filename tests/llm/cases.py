"""Documents that try an operator's patience."""

HARD = [
    (1, "A first text with some words in it.\nAnd a second line, which is long enough.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (3, "", "en", "b"),
    (4, "and a second line, which is long enough.  \n\n\tx", None, "a"),
    (None, "No id at all, but words.\nAnd a second line, which is long enough.", "en", None),
    (5, "word " * 60_000, "en", "a"),
    (6, "\n\n\n", "de", "b"),
    (7, "Ein Satz auf Deutsch mit Ümläuten, 日本語 und \U0001f600 \0 Zeichen.", "de", "c"),
    (7, "Another text of the same id, which is not a copy of the one before.", "en", "c"),
    (8, "A first text with some words in it.\nAnd a second line, which is long enough.", "en", "a"),
]
CLASH = "same h at keep id id_ key_ n node fp key start lane root first least c1 c2 hull kind runs marks score predicted spans ids letter x quality label tie best what __id __keep".split()


def hard(spark):
    """HARD with extra columns whose names the operators may use themselves."""
    rows = [(*r, *(f"{c}{i}" for c in CLASH)) for i, r in enumerate(HARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def empty(spark):
    return hard(spark).limit(0)


def documents(spark, *texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
