import random

import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHES = ["row", "mark", "doc", "hash", "print", "text_hash", "words", "n", "first", "key", "null_", "id_", "wanted", "kept", "score", "lang_pred"]


def prose(draw, words, letters="aeio", least=1, most=2):
    return " ".join("".join(draw.choices(letters, k=draw.randint(least, most))) for _ in range(words))


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Null ids and texts, empty and long texts, copies, repeated rows, shared passages, odd characters."""
    draw = random.Random(3)
    passage, line = prose(draw, 90, "abcdefghij", 3, 9), prose(draw, 25, "abcdefghij", 3, 9)
    copied = prose(draw, 120, "klmnopqrs", 3, 8)
    texts = [
        None, "", " \t\n", "...", "One", "A b", copied, copied, copied, copied + " x", "y " + copied,
        f"{prose(draw, 60)} {passage} {prose(draw, 50)}", f"{prose(draw, 10)}\n{passage}", f"{passage} {line} {line} {prose(draw, 8)}",
        f"{line} é ü {line}", "\x1c\x1d one\x85two", "<|endoftext|> it's <|startoftext|>", "日本語 テキスト ñandú ÀÉ İ ſ",
        prose(draw, 6000, "abc", 1, 3), passage * 2, "z" * 3000, "zz " * 900, "ab" * 700,
    ]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(5 * 3, "A b"), (6 * 3, copied), (None, "no id at all"), (None, copied), (6 * 3, "same id, other text")]
    rows = [(i, t, None if i is None or i % 2 else "en", "s", 0, *(f"{c}{i}" for c in CLASHES)) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def unique_docs(spark):
    """As many texts without null or repeated ids: what brute force answers plainly."""
    draw = random.Random(5)
    shared = [prose(draw, draw.randint(20, 140), "abcdefghij", 2, 9) for _ in range(4)]
    texts = []
    for _ in range(70):
        parts = [prose(draw, draw.randint(0, 40), "abcdefg", 1, 7)]
        for _ in range(draw.randint(0, 2)):
            parts += [draw.choice(shared), prose(draw, draw.randint(0, 30), "abcdefg", 1, 7)]
        texts.append(" ".join(parts))
    texts += texts[:9] + ["", "a", "ab " * 600] + [shared[0]] * 2
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
