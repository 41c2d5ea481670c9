"""Operators on documents against brute force, on odd rows and on the smallest driver tables."""

import collections
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from lexispark.llm import decontaminate, jaccard_join, line_dedup, ngrams
from lexispark.llm import queries as Q

from .common_data import WORDS, frame, odd_rows, prose

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    """(number of shingles, smallest id) of each row, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, t, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else d) for i, (d, t) in enumerate(rows)]


def test_shingle_hashes_are_sets():
    texts = [None, "", " ", "a", "A", "a b", "a  b\n", "a b c d", *(t for _, t in odd_rows())]
    got = list(ngrams.shingle_sets(pa.array(texts, pa.string()), 3, most=5000))
    by = {}
    for t, s in zip(texts, got, strict=True):
        assert len(s) == len(shingles(t, 3))
        assert by.setdefault(frozenset(shingles(t, 3)), s.tolist()) == s.tolist()
    assert len({tuple(v) for v in by.values()}) == len(by)


@pytest.mark.parametrize(("k", "percent", "clash"), [(3, 90, False), (5, 80, True), (2, 50, False)])
def test_jaccard_components(spark, k, percent, clash, no_broadcast):
    rows = odd_rows(k)
    with no_broadcast(k == 2):
        got = jaccard_join.link_components(frame(spark, rows, clash), k, percent).collect()
    want = collections.Counter((d, n, c) for d, _, n, c in components(rows, k, percent))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_chains_and_hot_groups(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAST_FREQUENCY", 4)
    monkeypatch.setattr(jaccard_join, "ROWS_TOGETHER", 8)
    monkeypatch.setattr(jaccard_join, "SHINGLES_TOGETHER", 200)
    monkeypatch.setattr(jaccard_join, "CARRIED", seed % 3)  # pairs meet again and again with few
    rng, rows = random.Random(seed), []
    text = [rng.choice(WORDS) for _ in range(60)]
    for i in range(60):  # a chain: neighbours link, its ends don't
        text[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(text)))
    base = [rng.choice(WORDS) for _ in range(50)]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(50)] = rng.choice(WORDS)
        rows.append((100 + i, " ".join(copy)))
    rng.shuffle(rows)
    got = jaccard_join.link_components(frame(spark, rows), 3, 80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, c) for d, _, _, c in components(rows, 3, 80)}


def test_jaccard_empty(spark):
    assert jaccard_join.link_components(frame(spark, [])).count() == 0
    assert jaccard_join.one_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_one_of_each(spark, shuffled, no_broadcast):
    rows = odd_rows(4)
    with no_broadcast(shuffled):
        got = collections.Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(frame(spark, rows)).collect())
    placed = components(rows, 5, 80)
    without = [(d, t) for d, t, n, _ in placed if not n]
    assert {k: v for k, v in got.items() if k in without} == dict(collections.Counter(without))
    groups = {}
    for d, t, n, c in placed:
        if n:
            # Groups whose rows have no id are told apart by their text.
            groups.setdefault((c, t if c is None else None), set()).add((d, t))
    kept = {k: v for k, v in got.items() if k not in without}
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    for members in groups.values():
        (one,) = members & set(kept)
        assert one[0] == min((d for d, _ in members), key=lambda d: (d is not None, d or 0))


def test_query_op8(spark):
    rows = [(r.doc_id, r.text) for r in Q.read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in Q.op8_ngram_jaccard_join(spark, SMALL).collect()}
    assert got == {(d, n, c) for d, _, n, c in components(rows, 3, 90)}


# --- leaks ----------------------------------------------------------------


def plain_shingles(text, k):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def leaks(docs, items):
    out = collections.Counter()
    for item, text in items:
        w, own = plain_shingles(text, 5)
        k = min(len(w), 5)
        own = own or ({tuple(w)} if w else set())
        for d, t in docs:
            shared = own & plain_shingles(t, k)[1] if own else set()
            if own and 100 * len(shared) >= 80 * len(own):
                out[d, item, len(own), len(shared)] += 1
    return out


@pytest.mark.parametrize("block", [8 << 20, 300])
@pytest.mark.parametrize("clash", [False, True])
def test_leaks(spark, clash, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(3)
    items = [(1, prose(rng, 30)), (2, prose(rng, 14)), (3, "two words"), (4, ""), (5, None), (6, "..."), (None, prose(rng, 20)), (7, prose(rng, 300))]
    docs = odd_rows()
    for i, (_, t) in enumerate(items):
        docs += [(200 + i, f"{prose(rng, 500)}, {(t or '').upper()}! {prose(rng, 200)}"), (300 + i, prose(rng, 40) + " " + " ".join((t or "").split()[:-3])), (None, t)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in decontaminate.contained_items(frame(spark, docs, clash), table).collect())
    assert got == leaks(docs, items)
    kept = collections.Counter((r.doc_id, r.text) for r in decontaminate.drop_contaminated(frame(spark, docs, clash), table).collect())
    hit = lambda t: bool(leaks([(0, t)], items))
    assert kept == collections.Counter((d, t) for d, t in docs if not hit(t))


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contained_items(frame(spark, odd_rows()), none).count() == 0
    assert decontaminate.contained_items(frame(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0


def test_lookup_takes_no_longer_with_more_items():
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, 7))
    doc = pa.array([" ".join(word() for _ in range(300)) for _ in range(50)])
    _, _, data, offsets = next(ngrams.chunks(doc))
    shingles = decontaminate.document_shingles(data, offsets, 5, [5])
    took = {}
    for n in (200, 10_000):
        index = decontaminate.ItemIndex(list(range(n)), [" ".join(word() for _ in range(30)) for _ in range(n)], 5, 80)
        began = time.perf_counter()
        for _ in range(20):
            assert not list(index.found_in(*shingles))
        took[n] = time.perf_counter() - began
    assert took[10_000] < 8 * took[200] + 0.05


def test_query_op4(spark):
    docs = [(r.doc_id, r.text) for r in Q.read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in Q.read_table(spark, SMALL, "benchmark").collect()]
    assert collections.Counter((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in Q.op4_decontamination(spark, SMALL).collect()) == leaks(docs, items)


# --- lines ----------------------------------------------------------------


def brute_lines(rows):
    """Texts without recurring lines, by the definition, with numbers of its own.

    A line as it is recurs in two texts, or in eight if it has less than four words and 24 characters. Lines of four words or more recur with words
    that have digits masked in four texts, and so do templates: those words of a line that at least 5 % and four of its leaf's different lines have, if they are 75 % of it.
    """
    small = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    lines = []  # (text, number, words, masked words)
    for t in texts:
        for i, line in enumerate(t.split("\n")):
            if w := tuple(small(x.decode()) for x in WORD.findall(line.encode())):
                lines.append((t, i, w, tuple("<*>" if re.search("[0-9]", x) else x for x in w)))

    def owners(pairs, least):
        have = collections.defaultdict(set)
        for key, t in pairs:
            have[key].add(t)
        first = lambda t: min((d for d in texts[t] if d is not None), default=-1)
        return {k: min(v, key=first) for k, v in have.items() if len(v) >= least(k)}

    whole = owners(((w, t) for t, _, w, _ in lines), lambda w: 8 if len(w) < 4 and sum(map(len, w)) < 24 else 2)
    long_lines = [x for x in lines if len(x[2]) >= 4]
    masked = owners(((m, t) for t, _, _, m in long_lines), lambda _: 4)
    leaves = collections.defaultdict(set)
    for *_, m in long_lines:
        leaves[len(m), m[:3]].add(m)
    template = {}
    for leaf, members in leaves.items():
        count = collections.Counter((i, x) for m in members for i, x in enumerate(m))
        for m in members if len(members) >= 4 else ():
            fixed = tuple((i, x) for i, x in enumerate(m) if count[i, x] >= 4 and 100 * count[i, x] >= 5 * len(members))
            if fixed and 100 * len(fixed) >= 75 * len(m):
                template[m] = (leaf, fixed)
    general = owners(((template[m], t) for t, _, _, m in long_lines if m in template), lambda _: 4)
    gone = collections.defaultdict(set)
    for t, i, w, m in lines:
        if any(o not in (None, t) for o in (whole.get(w), masked.get(m) if len(w) >= 4 else None, general.get(template.get(m)))):
            gone[t].add(i)
    return [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[t]), 0 if t is None else len(t.split("\n")), len(gone[t or ""])) for d, t in rows]


def line_rows(seed):
    rng = random.Random(seed)
    footer, rows = prose(rng, 8), odd_rows(seed)
    base = [rng.choice(WORDS) for _ in range(16)]
    for i in range(14):
        log = f"user {rng.randrange(999)} opened {rng.randrange(99)}.{rng.randrange(9)} from gate"
        varied = list(base)
        varied[rng.randrange(4, 16)] = rng.choice(WORDS) + rng.choice("qxz")
        rows.append((500 + i, "\n".join([prose(rng, 10), log, footer, "", prose(rng, 3), " ".join(varied)])))
    return rows


@pytest.mark.parametrize(("seed", "clash", "shuffled"), [(0, False, False), (1, True, False), (2, False, True)])
def test_lines(spark, seed, clash, shuffled, no_broadcast):
    rows = line_rows(seed)
    df = frame(spark, rows, clash)
    with no_broadcast(shuffled):
        got = line_dedup.drop_recurring_lines(df)
        found = got.collect()
    n_lines, n_dropped = (("n_lines_", "n_dropped_") if clash else ("n_lines", "n_dropped"))
    assert got.columns == [*df.columns, n_lines, n_dropped]
    want = collections.Counter(brute_lines(rows))
    assert collections.Counter((r.doc_id, r.text, r[n_lines], r[n_dropped]) for r in found) == want
    assert sum(x[3] > 1 for x in want) > 5


def test_text_of_very_many_lines(spark):
    lines = [f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} of a long text" for i in range(17_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(x for i, x in enumerate(lines) if i % 2)), (3, "alone")]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "alone"}


def test_lines_of_nothing(spark):
    assert line_dedup.drop_recurring_lines(frame(spark, [])).count() == 0


def test_query_op9(spark):
    rows = [(r.doc_id, r.text) for r in Q.read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_chars) for r in Q.op9_line_dedup(spark, SMALL).collect()}
    assert got == {(d, n, k, len(t)) for d, t, n, k in brute_lines(rows)}
