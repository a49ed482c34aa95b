import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, row bigint, bucket int, carry_0 string, score double, text_hash string, at int"


def awkward_rows():
    """Nulls, empty, very long and repeated texts, ties, copies, shared passages, repeated rows and columns with internal names."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeßé") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(240)]
    passage = " ".join(word() for _ in range(70))
    texts = {1: " ".join(base), 2: " ".join(base), 3: " ".join(base[:200] + [word() for _ in range(5)]), 4: None, 5: "", 6: "   \n\t ", 7: "a", 8: " ".join(base[:49]), 9: " ".join(base[10:60]), 10: "x" * 5000}
    texts |= {11: passage, 12: f"{' '.join(base[100:130])} {passage}\n{' '.join(word() for _ in range(30))}", 13: " ".join(["same"] * 300), 14: " ".join(["same"] * 120), 15: f"lead {passage}", 16: "\n\n".join(["p1 one.", "p2 two!\nline", passage]), 17: " ".join(word() for _ in range(6000))}
    texts |= {18: "nbsp wide　space end   x", 19: "tab\tnew\nline \x0b\x0c end\x1c.", 20: "İstanbul ΣΑΣ ﬁ é <|endoftext|> don't 123 !!"}
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 0, 1, 2, "c", 0.5, "h", 3) for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, " ".join(base), None, None, None, *[None] * 7), (None, "no id here", "en", None, 0, *[None] * 7)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
