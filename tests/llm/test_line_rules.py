"""Rules of line dedup, stated with numbers of their own."""

import collections
import random

import pytest
from lexispark.llm import line_dedup
from lexispark.llm import queries as Q

from .common_data import frame


def kept(spark, rows):
    return {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(frame(spark, rows)).collect()}


def repeats(rows, takes):
    """(texts that have it, words) of lines that more than one text has, of those that takes(words) takes; case and spaces don't count."""
    have = collections.defaultdict(set)
    for _, t in rows:
        for line in (t or "").split("\n"):
            w = tuple(line.lower().split())
            if takes(w):
                have[w].add(t)
    return {w: v for w, v in have.items() if len(v) > 1}


@pytest.mark.parametrize("texts", [2, 3])
def test_lines_of_two_texts(spark, texts):
    passage = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"only {'abcdefg'[i]} has this line\n{passage}\nSee section 4 of it") for i in range(texts)] + [(8, "Call 555 0101 for help today"), (9, "Call 555 0102 for help today")]
    got = kept(spark, rows)
    assert [passage in got[i] for i in range(texts)] == [True] + [False] * (texts - 1)
    assert [got[i].count("\n") for i in range(texts)] == [2] + [0] * (texts - 1)
    assert [got[8], got[9]] == [rows[-2][1], rows[-1][1]]  # not the same lines


def test_no_line_of_four_words_stays_in_two_texts(spark):
    rows = [(r.doc_id, r.text) for r in Q.read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert repeats(rows, lambda w: len(w) >= 4)
    got = kept(spark, rows)
    twins = collections.Counter(t for _, t in rows)
    alone = [(d, got[d]) for d, t in rows if twins[t] == 1]
    assert not repeats(alone, lambda w: len(w) >= 4)
    had, have = ({tuple(x.lower().split()) for _, t in some for x in t.split("\n")} for some in (rows, got.items()))
    assert {w for w in repeats(rows, lambda w: len(w) >= 4) if not any(any(c.isdigit() for c in x) for x in w)} <= have <= had | {()}


def fields(n, seed=1):
    """Documents of one line of twelve tokens, two of which, behind the leading ones, have a hundred values each, without digits."""
    rng = random.Random(seed)
    values = [[a + b + f for a in "bcdfghjklm" for b in "aeiouyzvwx"] for f in ("ton", "berg")]
    return [(i, f"the visit of last year by {rng.choice(values[0])} to {rng.choice(values[1])} was noted here") for i in range(n)]


@pytest.mark.parametrize("n", [50, 400, 1000, 10_000])
def test_a_template_is_found_at_every_size(spark, n):
    got = kept(spark, fields(n))
    assert sum(bool(t) for t in got.values()) <= 0.05 * n


def test_short_lines_and_scripts_without_spaces(spark):
    passage = "この一節は空白を含まない長い行であり二つの文書に繰り返し現れるものである"
    numbered = "第{}章ではこの一節とは別の長い行が空白なしで書かれているだけである"
    rows = [(i, f"own words {'abcdefghi'[i]}\nAll rights reserved.\nPage {i}") for i in range(9)] + [(20 + i, f"{'abcdefg'[i]} own words\nThe end.") for i in range(7)]
    rows += [(30 + i, f"mine {'ab'[i]}\n{passage}\n{numbered.format(i)}") for i in range(2)]
    got = kept(spark, rows)
    assert ["All rights reserved." in got[i] for i in range(9)] == [True] + [False] * 8
    assert all("The end." in got[20 + i] for i in range(7)) and all(f"Page {i}" in got[i] for i in range(9))
    assert [passage in got[30 + i] for i in range(2)] == [True, False] and all(numbered.format(i) in got[30 + i] for i in range(2))
