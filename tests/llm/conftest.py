import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"{'aeiou'[k % 5]}{'tnrsl'[k // 5 % 5]}w{k}" for k in (rng.randrange(vocabulary) for _ in range(n))]


@pytest.fixture(scope="session")
def texts():
    """Plain, copied, nearly copied, short, empty, null, long and odd texts."""
    rng = random.Random(5)
    out = [" ".join(words(rng, rng.randrange(3, 400))).replace(" a", "\nA", 3) for _ in range(60)]
    long = words(rng, 900)
    out += [" ".join(long), " ".join(long), " ".join(long + ["more"]), " ".join(["less"] + long)]
    out += ["", None, " ", "\n\n\n", "one", "one two", "One\ttwo\x0bthree", "é\u0301 ñ Ñ İ ß ﬁ", "a\u00a0b \u2003 c\n\u00a0\n\nd", "日本語 テキスト", "'s don't we'll 12 3.5 £5 ½"]
    out += ["header\n" + " ".join(words(rng, 30)) + "\n  HEADER \nfooter" for _ in range(12)]
    out += ["🙂 " * 30 + "x" * 5000, " ".join(words(rng, 30_000)), "<|endoftext|> a"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs = ["en", "fr", None]
    rows = [(k, t, langs[k % 3], f"src{k % 5}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
