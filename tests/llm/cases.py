"""Documents with every awkward case, and what tests share."""

from __future__ import annotations

import random

LONG = 40_000


def documents(seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages and lines,
    null, empty, blank, one-word, very long and repetitive texts, other scripts, odd white space."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n: int) -> str:
        words = [rng.choice(vocabulary) for _ in range(n)]
        return "".join(w + (".\n" if rng.random() < 0.1 else " ") for w in words).strip()

    passage, line = prose(60), prose(12).replace("\n", " ")
    texts: list[str | None] = [prose(rng.randint(5, 160)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " more", texts[2].replace(" ", "  ", 1), texts[3].upper()]
    texts += [f"{prose(20)}\n{passage}\n{prose(20)}" for _ in range(8)]
    texts += ["\n".join([prose(4), line, "second line here", "third line here", prose(4)]) for _ in range(6)]
    texts += [None, None, "", "", " \t\n", "word", "word", "two words", "a\nb", "\n\n\n\n\n", "x\ny\nz\nx\ny\nz\nx\ny\nz"]
    texts += ["ab " * LONG, "z" * LONG, "same " * 30, "éêè 日本語の文 " * 40, "a b c \x1c d\x85e",
              "it's <|endoftext|> here <|endoftext|>", "\U0001f600 \U0001f600\U0001f600 ok", "a" * 50, "a" * 49, "a" * 51]
    rows = [(i * 3 + 1, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[5])                              # a repeated row
    rows.append((None, texts[6], None, None, None))   # no id
    rows.append((None, "no id at all " * 6, None, None, None))
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = ("fp", "size", "block", "start", "length", "offset", "bin", "fill", "hits", "pos", "key", "kept", "toxic",
            "quality", "score", "root", "least", "n_lines", "n_removed", "sequence_id", "stream", "refers_to", "record_type")


def frame(spark, rows=None, clashing: bool = False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if clashing:
        from pyspark.sql import functions as F
        df = df.select("*", *(F.lit("x").alias(c) for c in CLASHING))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
