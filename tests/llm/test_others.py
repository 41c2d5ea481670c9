"""Language, secrets, packing, archives and media: exact round trips, brute force and held-out accuracy, on odd rows and the smallest driver tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from lexispark.llm import language, media, packing, secrets, warc
from lexispark.llm import queries as Q
from lexispark.llm.common import Scratch, kept_tables, release
from pyspark.sql import functions as F

from .common_data import frame, odd_rows, prose
from .test_documents import brute_lines, components, leaks

SMALL = "/root/testdata/sf0.001"

# --- language -------------------------------------------------------------


def grams(text):
    b = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def test_presences_are_sets():
    texts = ["", "a", "ab", "aAbab", "né à", prose(random.Random(1), 50)]
    got = language._rows(texts)
    for t, codes in zip(texts, got, strict=True):
        want = {len(g) << 24 | int.from_bytes(g, "big") for g in grams(t)}
        assert set(codes.tolist()) == want and len(codes) == len(want)


def test_values_are_kernel_ridge_regression():
    rng = random.Random(2)
    texts = [prose(rng, 6) for _ in range(20)] + [prose(rng, 6).translate(str.maketrans("aeiou", "öäüßx")) for _ in range(20)]
    labels = ["p"] * 20 + ["q"] * 20
    m = language.KernelModel.fit(texts, labels, landmarks_per_language=10, ridge=1e-3)
    k = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    marks = texts[:10] + texts[20:30]
    kmm = np.array([[k(a, b) for b in marks] for a in marks])
    knm = np.array([[k(a, b) for b in marks] for a in texts])
    values, vectors = np.linalg.eigh(kmm)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi, y = knm @ root, np.array([[1.0, -1.0]] * 20 + [[-1.0, 1.0]] * 20)
    beta = np.linalg.solve(phi.T @ phi + 1e-3 * 40 * np.eye(phi.shape[1]), phi.T @ (y - y.mean(axis=0)))
    want = phi @ beta + y.mean(axis=0)
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    assert np.allclose(m.values(data, at), want, atol=1e-3)


@pytest.mark.parametrize("clash", [False, True])
def test_language_of_odd_rows(spark, clash):
    rows = odd_rows()
    m = language.KernelModel.fit(["der die das und", "the of and to"] * 3, ["de", "en"] * 3)
    got = language.predict(frame(spark, rows, clash), m).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    pred, score = ("lang_pred_", "score_") if clash else ("lang_pred", "score")
    for r in got:
        assert 0 <= r[score] <= 1
        assert (r[pred] == "und") == (not any(map(str.isalpha, r.text or "")))
        assert not clash or r.score is r.lang_pred is None  # as they were
    none = language.KernelModel.fit([], [])
    assert {r.lang_pred for r in language.predict(frame(spark, rows), none).collect()} == {"und"}
    assert language.predict(frame(spark, []), m).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS_PER_LANGUAGE", 10)
    rows = [(i, f"text {i}", "aa" if i % 3 else "bb") for i in range(600)] + [(None, None, "aa"), (1, "x", None), (2, "", "bb")]
    texts, labels = language.labelled_sample(spark.createDataFrame(rows, "key bigint, text string, lang string"))
    assert 4 <= len(texts) <= 40 and set(labels) == {"aa", "bb"}
    assert language.labelled_sample(spark.createDataFrame([], "key bigint, text string, lang string")) == ([], [])


def judged(labelled, texts):
    """(language, score, evidence, share of known n-grams) of texts, from sets of n-grams and the definition of the kernel and the regression."""
    import xxhash

    place = lambda t: (lambda h: (h - (h >> 63 << 64)) % (1 << 53))(xxhash.xxh64(t.encode(), seed=42).intdigest())
    labelled = sorted(set(labelled), key=lambda x: (place(x[0]), x[1]))
    names = sorted({lang for _, lang in labelled})
    marks = [x for n in names for x in [x for x in labelled if x[1] == n][:64]]
    sets = {t: grams(t) for t in {t for t, _ in labelled} | set(texts)}
    kernel = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a]) * len(sets[b])) ** 0.5
    k_mm = np.array([[kernel(a, b) for b, _ in marks] for a, _ in marks])
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    phi = lambda some: np.array([[kernel(a, b) for b, _ in marks] for a in some]) @ root
    x, y = phi([t for t, _ in labelled]), np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in labelled])
    bias = y.mean(axis=0)
    over = phi(texts) @ np.linalg.solve(x.T @ x + 1e-4 * len(labelled) * np.eye(x.shape[1]), x.T @ (y - bias))
    known = set().union(*(sets[t] for t, _ in marks))
    plain = lambda g: all(chr(b).isalpha() or chr(b).isspace() or b >= 128 for b in g) and not any(28 <= b <= 31 for b in g)
    out = []
    for t, f in zip(texts, over, strict=True):
        best, own = int((f + bias).argmax()), [g for g in sets[t] if plain(g) or g.strip(b"\0") == b""]
        out.append((names[best], min(1, max(0, (f[best] + bias[best] + 1) / 2)), f[best] / max(1 - bias[best], 1e-9), sum(g in known for g in own) / max(1, len(own))))
    return out


def test_query_op7(spark):
    rows = Q.read_table(spark, SMALL, "documents").collect()
    learned = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang and r.text]
    want = dict(zip([r.doc_id for r in rows], judged(learned, [r.text or "" for r in rows]), strict=True))
    for r in Q.op7_language_id(spark, SMALL).collect():
        lang, score, *_ = want[r.doc_id]
        if r.lang_pred != "und":
            assert r.lang_pred == lang and abs(r.score - score) < 2e-3


def test_held_out_accuracy(spark):
    docs = Q.read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    got = Q.op7_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(held) > 200 and sum(held) >= 0.97 * len(held)


# --- secrets --------------------------------------------------------------

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def markov(spark):
    """Log-likelihood ratios by pair of characters, counted from the sample's tokens one by one."""
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    counts = {True: collections.Counter(), False: collections.Counter()}
    for r in secrets.sample_tokens(spark).collect():
        counts[r.random].update(zip(r.token, r.token[1:], strict=False))
    chance = lambda kind, a, b: (counts[kind][a, b] + 1) / (sum(counts[kind][a, c] for c in alphabet) + len(alphabet))
    return {(a, b): math.log(chance(True, a, b) / chance(False, a, b)) for a in alphabet for b in alphabet}


def brute_model(t, table, base):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t):
        steps = [table[x] for x in zip(m[0], m[0][1:], strict=False)]
        if sum(steps) / len(steps) > 0.5 and not any(a <= m.start() and m.end() <= b for a, _, b in base):
            out.append((m.start(), 3, m.end()))
    return out


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.train(secrets.sample_tokens(spark))


@pytest.mark.parametrize("clash", [False, True])
def test_secrets(spark, ratios, clash):
    rng = random.Random(5)
    pieces = ["password", "PASSWD", "secret", "token", "api_key", "ApiKey", '"', "'", " ", ":", "=", "abcdefgh", "x" * 9, "AKIA", "AKIA" * 2, "ABCDEFGH1234", "0f" * 16, "0f" * 15, "é", "日", "\n", ".", "deadbeef", "+/="]
    rows = odd_rows() + [(1000 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(2000 + i, " ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest()[: rng.randrange(15, 33)].upper() for j in range(rng.randrange(1, 700)))) for i in range(5)]
    base_name, name = ("base_spans_", "spans_") if clash else ("base_spans", "spans")
    got = secrets.scan(frame(spark, rows, clash), ratios).select("doc_id", "text", F.col(base_name).alias("base"), F.col(name).alias("all")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    table = markov(spark)
    for r in got:
        base = brute_spans(r.text or "")
        assert [tuple(s) for s in r.base] == base
        assert [tuple(s) for s in r["all"]] == sorted(base + brute_model(r.text or "", table, base))
    assert sum(s.kind == 3 for r in got for s in r["all"]) > 50


def test_model_tells_random_from_names(spark, ratios):
    rng = random.Random(6)
    made = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(rng.randrange(24, 48))) for _ in range(300)] + [hashlib.sha1(bytes([i])).hexdigest() for i in range(100)]
    names = ["getDefaultUserProfileSettings", "internationalization_configuration_file", "src/main/resources/application/config", "MAXIMUM_CONNECTION_TIMEOUT_SECONDS", "erberbeeinheitkeiter", "thanbleshaningtionnt", "handle-incoming-websocket-message"]
    rows = [(i, f"see {t}, there") for i, t in enumerate(made + names)]
    got = {r.doc_id: {s.kind for s in r.spans} for r in secrets.scan(frame(spark, rows), ratios).collect()}
    assert sum(bool(got[i]) for i in range(len(made))) >= 0.97 * len(made)
    assert not any(got[len(made) + i] for i in range(len(names)))


def test_places_of_repeated_tokens(spark, ratios):
    t = hashlib.sha1(b"x").hexdigest().upper()
    text = f"é{t}x {t} {t}-{t} {t}"
    got = secrets.scan(frame(spark, [(1, text)]), ratios).first().spans
    found = [text[s.start : s.end] for s in got if s.kind == 3]
    assert all(re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}", x) for x in found)
    assert [(s.start, s.end) for s in got if s.kind == 3] == [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)]


def test_secrets_of_a_long_text(spark, ratios):
    text = "\n".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(30_000))  # about 1 MB
    began = time.perf_counter()
    r = secrets.scan(frame(spark, [(1, text)]), ratios).selectExpr("size(base_spans) AS n", "base_spans[29999].end AS far", "size(spans) AS all").first()
    assert tuple(r) == (30_000, len(text), 30_000) and time.perf_counter() - began < 60


def test_secrets_stay_in_the_jvm(spark, ratios):
    plan = secrets.scan(frame(spark, []), ratios)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("LogicalRDD", "")


def test_query_op10(spark):
    texts = {r.doc_id: r.text for r in Q.read_table(spark, SMALL, "documents").collect()}
    for r in Q.op10_secret_scans(spark, SMALL).collect():
        want = brute_spans(texts[r.doc_id])
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))


# --- packing --------------------------------------------------------------


def test_tree_is_first_fit():
    rng = random.Random(7)
    for capacity in (10, 64):
        sizes = np.array([rng.randrange(1, capacity + 1) for _ in range(200)])
        bins, offsets = packing.first_fit_decreasing(sizes, capacity)
        free, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            b = next((j for j, f in enumerate(free) if f >= sizes[i]), len(free))
            if b == len(free):
                free.append(capacity)
            want[int(i)] = (b, capacity - free[b])
            free[b] -= sizes[i]
        assert [want[i] for i in range(200)] == list(zip(bins.tolist(), offsets.tolist(), strict=True))


def test_word_ids_are_the_tokenizers():
    rng = random.Random(8)
    coder = packing.WordTokenizer(Q.tokenizer_path())
    alphabet = list("aAbBé É.,'<|> \n\t_!sStT1²½́ ñİKH̱-")
    texts = ["", None, "It's we'll 'still can't.", "<|endoftext|> x", "foo<|endoftext|>. Bar", "<|EndOfText|>", "İstanbul", "\x1cfoo\x1d. bar", "½ Ⅷ x².", "日本語。", "\x00 a\x00.", "é a.́ b", "FOO'S bar's. 'S"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)]
    for t, ids in zip(texts, coder.encode(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids


def check_packing(rows, got, capacity):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(Q.tokenizer_path())
    want = collections.Counter()
    for d, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), capacity):
            piece = ids[a : a + capacity]
            want[d, a, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(x for _, x in s[:i]) for i in range(len(s))] and sum(x for _, x in s) <= capacity
    return len(by), sum(r.length for r in got)


@pytest.mark.parametrize("clash", [False, True])
def test_packing(spark, clash, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCUMENTS", 20)
    rows = odd_rows()
    check_packing(rows, packing.pack(frame(spark, rows, clash), Q.tokenizer_path(), capacity=512).collect(), 512)
    assert packing.pack(frame(spark, []), Q.tokenizer_path()).count() == 0


def test_groups_do_not_depend_on_how_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCUMENTS", 20)
    df = frame(spark, odd_rows() + [(8000, "same id and text")] * 50)
    one, other = (collections.Counter(map(tuple, packing.pack(df.repartition(n), Q.tokenizer_path(), capacity=512).collect())) for n in (1, 7))
    assert one == other
    groups = collections.defaultdict(set)
    for (d, _, _, _, total, sequence, _), _ in one.items():
        groups[d, total].add(sequence >> 32)
    assert len(groups[2, max(t for d, t in groups if d == 2)]) == 1 and len(groups[8000, max(t for d, t in groups if d == 8000)]) > 1


def test_query_op5(spark):
    rows = [(r.doc_id, r.text) for r in Q.read_table(spark, SMALL, "documents").collect()]
    sequences, tokens = check_packing(rows, Q.op5_packing(spark, SMALL).collect(), 2048)
    assert sequences <= 1.03 * tokens / 2048 + 1


# --- archives -------------------------------------------------------------


def check_pages(rows, got):
    """rows: (page_id, url, html)."""
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = collections.Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and (h or "") in least and p != least[h or ""]
        want[p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", least[h] if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


@pytest.mark.parametrize("size", [16 << 20, 2000])
def test_archives(spark, size, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    rng = random.Random(9)
    same, big = "<p>" + prose(rng, 40), "<p>" + prose(rng, 30_000)
    rows = [(i, f"http://a/{i}", f"<html>{prose(rng, 30)}</html>") for i in range(60)]
    rows += [(100, None, same), (90, "u\r\nX: y", same), (90, "u", same), (90, "u", same), (90, None, same), (100, "v", same), (100, "v", same), (None, "u", same), (101, "u", "short"), (102, "u", "short"), (103, "u", None), (104, "u", ""), (None, None, None), (105, "u", big), (106, "u", big), (None, "u", "z" * 200), (None, "u", "z" * 200), (107, "é", "WARC/1.1\r\n\r\nnot a record\x00")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "first", "size", "revisit", "archive")})
    archives = warc.write_archives(df)
    check_pages(rows, warc.read_records(archives).collect())
    for r in archives.collect():  # each record can be read alone
        assert r.records == len(r.offsets) == len(list(warc.read_archive(bytes(r.archive))))
    warc.export(archives, 0, str(tmp_path / "a.warc.zst"))
    assert list(warc.read_archive((tmp_path / "a.warc.zst").read_bytes()))
    found = warc.read_records(archives).collect()
    assert {r.html for r in found if r.record_type == "response"} == {h or "" for _, _, h in rows}
    names = {r.record_id: r for r in found}
    assert len(names) == len(found)
    for r in found:
        if r.record_type == "revisit":
            assert names[r.refers_to_record].page_id == r.refers_to and names[r.refers_to_record].record_type == "response" and names[r.refers_to_record].payload_digest == r.payload_digest


def test_no_archives(spark):
    assert warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_query_op6(spark):
    check_pages([(r.page_id, r.url, r.html) for r in Q.read_table(spark, SMALL, "pages").collect()], Q.op6_warc(spark, SMALL).collect())


# --- media ----------------------------------------------------------------


def test_sequences():
    html = '<head><title>t</title></head><body>one &amp; <b>two</b><script>x<p></script><p>three<figure><img src="media:sha256/aa" alt="old"><figcaption>cap <i>tion</i></figcaption></figure>four<img src="media:sha256/bb" alt="side"><img src="http://x/y.png"><br>five'
    got = [(e["kind"], e["text"] or e["digest"], e["caption"]) for e in media._Sequence.of(html)]
    assert got == [("text", "one & two", None), ("text", "three", None), ("media", "aa", "cap tion"), ("text", "four", None), ("media", "bb", "side"), ("text", "five", None)]
    assert [e["position"] for e in media._Sequence.of(html)] == list(range(6))
    assert media._Sequence.of(None) == media._Sequence.of("") == [] and media._Sequence.of("<p") is not None


def captions(html):
    return [(e["text"] or e["digest"], e["caption"]) for e in media._Sequence.of(html)]


def test_captions_belong_to_their_figures():
    img = lambda x: f'<img src="media:sha256/{x}">'
    assert captions(f"<figure><figcaption>before</figcaption>{img('a')}{img('b')}</figure>{img('c')}") == [("a", "before"), ("b", "before"), ("c", None)]
    assert captions(f"{img('a')}<figcaption>stray</figcaption>{img('b')}") == [("a", None), ("stray", None), ("b", None)]
    assert captions(f"<figure>{img('a')}<figcaption>open</figure><p>rest of the page") == [("a", "open"), ("rest of the page", None)]
    assert captions(f"<figure>{img('a')}<figcaption>open<div>rest of the page") == [("a", "open"), ("rest of the page", None)]
    assert captions("<html><head><title>t</title><p>text without an end of the head") == [("text without an end of the head", None)]
    assert captions("<head><title>t</title>plain text") == [("plain text", None)]
    assert captions(f"<template>{img('a')}no</template>{img('b')}") == [("b", None)]
    assert captions(f"<figure>{img('a')}<figure>{img('b')}<figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>") == [("a", "outer"), ("b", "inner")]


def test_pages_are_parsed(spark):
    pages = Q.read_table(spark, SMALL, "pages")
    got = {r.id: r.elements for r in media.parse_sequences(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        text = " ".join(e.text for e in got[r.page_id] if e.text)
        assert [e.position for e in got[r.page_id]] == list(range(len(got[r.page_id]))) and "<p" not in text and (text or "<p>" not in (r.html or ""))


def test_payloads_are_stored_once(spark):
    store = media.store_payloads(spark.createDataFrame([("aa", "x")] * 9 + [("bb", None)] * 2, "digest string, text string"), Scratch(spark, "test"))
    assert sorted(r.digest for r in store.collect()) == ["aa", "bb"]


def test_images_are_lossless():
    for n in (0, 1, 63, 64, 65, 1000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        got = media.image_samples(media.image_bytes(data))
        assert got[:n] == data and len(got) % 64 == 0 and len(got) > 0 and not any(got[n:])
    with pytest.raises(ValueError):
        media.image_samples(b"P5\n64 2\n255\nshort")


def test_positions_and_captions_stay(spark):
    scratch = Scratch(spark, "test")
    payloads = media.described(media.store_payloads(spark.createDataFrame([("aa", "x"), ("aa", "x"), ("bb", None)], "digest string, text string"), scratch))
    pages = spark.createDataFrame([(1, '<p>t<img src="media:sha256/bb" alt="B">u<img src="media:sha256/aa">'), (1, '<img src="media:sha256/cc">'), (None, '<img src="media:sha256/aa" alt="N">'), (2, None), (3, "")], "page_id bigint, html string")
    got = {(r.id, r.position, r.caption, r.digest, r.n_bytes) for r in media.resolve(media.parse_sequences(pages), payloads, ["n_bytes"]).collect()}
    assert got == {(1, 1, "B", "bb", 0), (1, 3, None, "aa", 1), (1, 0, None, "cc", None), (None, 0, "N", "aa", 1)}
    assert media.parse_sequences(pages.limit(0)).count() == 0


def check_media(rows, got):
    want = collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_query_op1(spark, tmp_path):
    rows = [(d, t) for d, t in odd_rows() if t is None or "\x00" not in t] + [(99, "</p><img src=x>&amp; <figure> &lt; & ]]> <!-- ")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    check_media(rows, Q.op1_media_columns(spark, str(tmp_path)).collect())
    check_media([(r.doc_id, r.text) for r in Q.read_table(spark, SMALL, "documents").collect()], Q.op1_media_columns(spark, SMALL).collect())


# --- pipeline -------------------------------------------------------------


NAMES = ("language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing")


def brute_chain(rows, items):
    """The rows that each stage leaves, of (doc_id, text, lang), by the stages' definitions."""
    learned = [(t, lang) for _, t, lang in rows if t and lang]
    found = judged(learned, [t or "" for _, t, _ in rows])
    after = [[(d, t) for (d, t, _), (_, _, evidence, share) in zip(rows, found, strict=True) if any(map(str.isalpha, t or "")) and (evidence >= 0.3 or share >= 0.85)]]
    after.append([(d, t) for d, t, _, n in brute_lines(after[-1]) if not n or t.strip()])
    best = {}
    for d, t, n, c in components(after[-1], 5, 80):
        if n:
            best[c] = min(best.get(c, (d, t)), (d, t), key=lambda x: x[0])
    after.append([(d, t) for d, t, n, c in components(after[-1], 5, 80) if not n or best[c] == (d, t)])
    held = {d for d, *_ in leaks(after[-1], items)}
    after.append([x for x in after[-1] if x[0] not in held])
    return after


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert tuple(n for n, _ in corpus_pipeline.STAGES) == NAMES
    docs = Q.read_table(spark, SMALL, "documents")
    items = [(r.item_id, r.text) for r in Q.read_table(spark, SMALL, "benchmark").collect()]
    want = brute_chain([(r.doc_id, r.text, r.lang) for r in docs.collect()], items)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = Scratch(spark, "test").table(stage(spark, docs, SMALL), str(i), keep=True)
        assert made.dtypes == docs.dtypes, name
        docs = made
        assert collections.Counter((r.doc_id, r.text) for r in made.collect()) == collections.Counter(want[i]), name
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_packing(want[3], packed, 2048)
    before = kept_tables()
    run = corpus_pipeline.run(spark, SMALL)
    assert len(kept_tables()) == len(before) + 1  # the result's own
    rows = run.select("doc_id", "start", "length", "ids_crc32").collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)
    release(spark, [t for t in kept_tables() if t not in before])


def test_stages_take_odd_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    german = [(900 + i, f"der die das und ist nicht ein kleines Haus am See Nummer {i} mit Garten") for i in range(9)]
    for rows in (odd_rows() + german, []):
        docs = frame(spark, rows, clash=True).withColumns({"lang": F.when(F.col("doc_id") >= 40, "xx"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("mine"), "lang_pred": F.lit("mine"), "n_lines": F.lit("mine"), "n_dropped": F.lit("mine")})
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            made = Scratch(spark, "test").table(stage(spark, docs, SMALL), str(i), keep=True)
            assert made.dtypes == docs.dtypes, name
            assert made.where("score <> 'mine' OR lang_pred <> 'mine' OR n_lines <> 'mine' OR n_dropped <> 'mine'").count() == 0
            assert made.count() <= docs.count() and (not rows or made.count() > 0)
            docs = made
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
        check_packing([(r.doc_id, r.text) for r in docs.collect()], packed, 2048)
