"""Small inputs for the tests of the llm operators: real texts and awkward rows."""

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, spans string, row int"


def words(t):
    return WORD.findall(t or "")


def documents(spark, n=60):
    """Texts of the documents table, edited copies, nulls, empty, white space, very long, ties, repeated rows; more columns
    whose names operators use inside."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]
    rows = [(i, t, "en", f"s{i % 5}") for i, t in enumerate(texts)]
    long = max(texts, key=len).split(" ")
    near = list(long)
    near[len(near) // 2] = "CHANGED"
    rows += [
        (1000, " ".join(near), "en", "s1"), (1001, texts[1], "de", "s2"), (1001, texts[1], "de", "s2"), (1002, texts[1] + " \n", None, None),
        (1003, None, "en", "s0"), (1004, "", "en", "s0"), (1005, " \t\n\x0b\x0c\r ", "en", "s0"), (None, "no id here at all", None, None),
        (None, None, None, None), (1006, "one two", "en", "ß"), (1007, "one  two", "en", "ß"), (1008, "x" * 5000, "en", "s3"),
        (1009, "word " * 3000, "en", "s3"), (1010, "a b c d e f g h i j k l m n", "en", "s4"),
        (1011, "z a b c d e f g h i j k l m n y", "en", "s4"), (1012, "ΑΣ Café <|endoftext|>   don't 日本 😀", "xx", "s4"),
        (-5, "negative id " + texts[2], "en", "s4"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, 7, "n", "s", 1) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)
