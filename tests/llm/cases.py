"""Texts and rows that every operator must take."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"

TRICKY = [
    None,
    "",
    " ",
    "\n\n \n",
    "a",
    "a  b   c\n d\n \ne \n",
    "word " * 300,
    "x" * 5000,
    "don't we'll I'd  've 's\t\ttab\x0bvt\x0cff\rcr",
    "Ünïcode été ß ñandú İstanbul Kelvin ſharp 日本語 テキスト 🙂🙂 é  nbsp  em",
    "<|endoftext|> mid <|endoftext|>text<|startoftext|>",
    "1234567890 12.5% #$%&*|<> $$$",
    "trailing space ",
    " leading space",
    "newline then space\n next",
    "\x1c\x1d \x1e a\x1fb",
    "same line\nsame line\nother\nsame line\n",
]


def rows(texts, start=0):
    return [(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, texts, start=0):
    return spark.createDataFrame(rows(texts, start), DOC)
