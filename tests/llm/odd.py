"""Texts that operators must survive."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

PII = [
    "mail a.b@c.de and x@y, then p@q.r.s_t@u.v end",
    "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 00099.0.0.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559",
    "call +1 (017) 555-7713 or +49 1 or +1 234567890123456789",
    'key token = "186661156f3f9905942d70850a01cbf23a203f82" here',
    "12 - 34 5  6 7-8--9 1.1.1 +() 9 @ a@b.",
    "😀 é a@b.co ü 10.0.0.1 ß +1 (222) 555-1234\n\t4111111111111111",
    "1" * 3000 + " " + "9 " * 500,
    "a" * 3000 + "@" + "b." * 300 + "c",
]
PLAIN = [
    "",
    " ",
    "\n\n\t",
    "one",
    "one two three four",
    "the same line\nthe same line\n\nthe same line\n x",
    "a b c d e f g h " * 6,
    "x " * 40 + "y",
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5 w6 w7 w8 q " + "z z z z z z z z z",
    "Ünïcödé über straße " * 5 + "\x0b\x0c\r end\xa0of line",
    "# * $ % & | < > ### </turn> \\ \\h \\\\e",
    "<|endoftext|> a <|endoftext|>  b \n \n c▁d ▁▁ e",
    "supercali" * 2000,
]


def texts(n: int = 60, seed: int = 5) -> list:
    rnd = random.Random(seed)
    words = ["alpha", "beta", "Gamma,", "delta.", "é", "ß", "the", "of", "und", "x1", "#", "||", "\n", "\t", "  "]
    made = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80))) for _ in range(n)]
    return [*PII, *PLAIN, *made, *made[:5], None, None]


def documents(spark, rows=None, extra=True):
    rows = texts() if rows is None else rows
    data = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, DOCS)
