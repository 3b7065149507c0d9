from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon été niño".split()


#: Column names that some operator uses itself.
OWN_NAMES = """row row_id key text_ bands band centre label class class_id class_size rows_of least head_key n id gone gone_key h h_bit
h_bucket h_bits h_in spans window windows item items clean found n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines
n_upper base_failed kept stratum good bins own cuts_of cut_upper score offending toxic quality sentence start end length ids deal
offset sequence_id doc_tokens gram run cell common whole dlo dhi m done chunk cells grams logp part rare known size block blocks words
template rank step lone example formatted w full k train head body __n_words __bytes __key __spans __items __h""".split()


@pytest.fixture(scope="session")
def make(spark):
    """(doc_id, text, ...) rows to a documents frame; extra columns have names that operators use themselves."""

    def build(rows, columns="doc_id long, text string"):
        df = spark.createDataFrame(rows, columns)
        extra = [("lang", "'en'"), ("source", "'s'"), *((name, str(i)) for i, name in enumerate(OWN_NAMES))]
        return df.selectExpr("*", *[f"{value} AS `{name}`" for name, value in extra if name not in df.columns])

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empties, one-word and long texts, marks and non-Latin."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    passage = say(60)
    rows: list[tuple[int | None, str | None]] = [(i, say(rng.randrange(30, 120))) for i in range(30)]
    rows += [(30 + i, rows[i][1]) for i in range(4)]  # exact copies
    rows += [(40 + i, rows[0][1]) for i in range(6)]
    for i in range(6):  # near copies
        words = rows[10 + i][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((50 + i, " ".join(words)))
    rows += [(60 + i, f"{say(20)}\n{passage}\n{say(25)}") for i in range(5)]
    rows += [(70, None), (71, ""), (72, "one"), (73, " \n\t "), (74, "日本語 текст Ünïcödé Ǆ <|startoftext|> it's 12's... J̌"), (75, "x" * 700), (76, say(6000)),
             (77, "a b c d e f g h " * 30), (78, "the same line\n" * 40), (79, "é" * 300), (80, "é" * 300)]
    rows += [(0, rows[0][1]), (90, rows[5][1]), (90, rows[5][1]), (None, "a row without id " + passage)]
    return rows
