"""Small tables with the awkward rows that every operator has to bear."""

import random

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, None, "en"),
    (2, "", None),
    (3, "one and the same text of some words, twice in this table and once more", "en"),
    (4, "one and the same text of some words, twice in this table and once more", "en"),
    (4, "one and the same text of some words, twice in this table and once more", "en"),
    (None, "a row without an id", "en"),
    (5, LONG, "la"),
    (6, "?! 12 ...", "en"),
    (7, "Größe über alles und die Straße", "de"),
    (8, "\ttabs\nand  lines \r\n end ", None),
]
# Names that operators use inside, holding what must not be read.
CLASHING = "body string, word string, node long, n long, bucket long, rejected_id long, kept boolean, length long, part long, rank int, count long, url string"


def documents(spark, rows=ROWS):
    found = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for column in CLASHING.split(", "):
        name, kind = column.split()
        found = found.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return found


def prose(seed: int, words: int) -> str:
    dice = random.Random(seed)
    parts = "ka lo mi re tu sa ne po vi du ran tel mon ist erg".split()
    return " ".join("".join(dice.choices(parts, k=dice.randint(1, 4))) for _ in range(words))
