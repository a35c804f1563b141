"""Small documents with every awkward case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, component_id long"


def words(rng, n):
    return " ".join(rng.choice("the of tion and ver une der que los mit ing al pour con sch ent ment ado".split()) + rng.choice("abcdefghij") for _ in range(n))


def rows():
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), base.upper(), words(rng, 4), words(rng, 4), "", None, "   \n\t ", words(rng, 30_000), "x" * 50_000, "1" * 30_000, "ein", "你好 \U0001f600 café " * 20]
    texts += [words(rng, rng.randint(1, 300)) for _ in range(60)]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3 if i % 7 else 0], None if t is None else len(t), "k", 5, -1) for i, t in enumerate(texts)]
    out += [out[0], out[9], out[9], (None, base, "en", "a", len(base), "k", 5, -1), (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
