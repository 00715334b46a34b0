"""Operators against brute force on small fixtures, with nulls, empty tables, repeated rows
and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import chat_format, chunking, common, decontaminate, fingerprints, language_id, mixing, ngram_join, quality, secret_scan, suffix_dedup, url_filter
from lexiquarry.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, host string, p string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "w") for i, t, lang, s in rows], DOCS)


WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "größe", "naïve"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage = prose(rng, 40)
    rows = []
    base = [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    for i in range(90):
        t = rng.choice(base) if i % 3 else prose(rng, rng.randint(1, 100))
        w = t.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        t = " ".join(w)
        if i % 5 == 0:
            t = t[: len(t) // 2] + "\n" + passage + " " + t[len(t) // 2 :]
        rows.append((i * 7 % 1000, t, "en", f"s{i % 4}"))
    rows += [(2000, None, None, None), (2001, "", "en", "s1"), (2002, "a", "en", "s0"), (2003, " \t\n", "en", "s0"), (2004, "one two", "en", None)]
    rows += [(2005, "One  two", "en", "s2"), (2006, prose(rng, 4000), "en", "s2"), (None, base[0], "en", "s1"), rows[4], rows[4]]
    return rows


def judged_url(u, rules):
    """Brute force: all rules are tried on one url."""
    rest = u.split("://", 1)[1] if u and "://" in u else None
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0]) if rest is not None else ""
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1] if rest is not None else ""
    fit = [(len(h + p), h + p, v) for v, h, p in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = ["http://a.com/", "http://A.EXAMPLE.com/en/x?q#f", "https://www.example.com/en/1", "http://x.net/fr/", "http://net/es/1", "ftp://b.net/de", "nourl", None, "", "http://", "http://com", "x://example.com/en", "http://..com/a", "http://u@example.com:80/en/", "http://www.example.com/en/1"]
URLS += ["http://exam.com/", "http://exam.com", "http://example.com/x", "http://a.exam.com/x", "http://exam.com.evil.net/", "http://notexam.com/", "http://exam.comx/", "http://com.exam/", "http://a\0exam.com/", "http://a\1b.exam.com/x", "http://exam.com./", "http://x.y.exam.com/de/ä/" + "z" * 5000, "http://éxam.com/", "http://EXAM.COM?q", "http://b.org/aa", "http://x.b.org/aa", "http://enx.exam.com/"]
RULES = {
    "paths": [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "net", "/fr/")],
    "hosts": [("block", "exam.com", ""), ("allow", "a.exam.com", ""), ("block", "com", "/x"), ("allow", "example.com", "/x"), ("block", "y.exam.com", "/de/"), ("allow", "exam.com", "en")],
    "equal lengths": [("allow", "b.org", "/aa"), ("block", "x.b.org", "/"), ("block", "exam.com", "/x"), ("allow", "a.exam.com", ""), ("block", "net", ""), ("allow", None, "/"), ("block", "com", None)],
    "none": [],
}


@pytest.mark.parametrize("name", list(RULES))
def test_url_filter(spark, name, monkeypatch):
    rules = RULES[name]
    pages = spark.createDataFrame([(i % 13, u, "h", "p") for i, u in enumerate(URLS)] + [(7, URLS[16], "h", "p")] * 5, "page_id int, url string, host string, n string")
    want = sorted(str((r.page_id, *judged_url(r.url, rules))) for r in pages.collect())
    table = url_filter.rules_frame(spark, rules)
    found = lambda: sorted(str(tuple(r)) for r in url_filter.judge_urls(pages, table).collect())
    assert found() == want
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", 1)
    monkeypatch.setattr(url_filter, "partitions", lambda _: 17)
    assert found() == want
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


@pytest.mark.parametrize("parts", [1, 13, 40])
def test_nested_rules_over_ranges(spark, monkeypatch, parts):
    """Rules in rules, open over many ranges of keys, and many hosts with one path."""
    rng = random.Random(parts)
    hosts = ["a", "b.a", "c.b.a", "ab", "a.ab", "b"]
    path = lambda n: "".join(rng.choice(["/", "x", "xy", "é"]) for _ in range(n))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((rng.choice(hosts), path(rng.randrange(7))) for _ in range(80))}.values())
    urls = [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}/{path(rng.randrange(9))}" for _ in range(300)] + [f"http://h{i}.b.a/x" for i in range(100)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    monkeypatch.setattr(url_filter, "partitions", lambda _: parts)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    found = [tuple(r) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules)).collect()]
    assert sorted(found) == sorted((i, *judged_url(u, rules)) for i, u in enumerate(urls))


def test_join_spread(spark):
    """A hot key is dealt to several rows of the other side, and no row is lost or doubled."""
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 5, i) for i in range(200)], "k int, v int")
    one = rows.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"))
    plain = sorted(map(str, rows.join(one.drop("m").withColumnRenamed("k", "j"), F.col("k").eqNullSafe(F.col("j"))).select("k", "v", "least").collect()))
    for hot in (3, 1000):
        assert sorted(map(str, common.join_spread(rows, one, ["k"], "m", hot=hot).select("k", "v", "least").collect())) == plain


def test_chat_format(spark):
    rng = random.Random(2)
    talks = []
    for c in range(12):
        long_ = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", None])) for _ in range(rng.randint(1, 9))]
        talks += [long_, long_[: rng.randint(1, len(long_))], long_]
    rows = [(c, t, role, text, "x") for c, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    rows += [(None, 0, "user", "lost", "x"), (99, None, "user", "b", "x"), (99, 1, "user", "c", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    whole = {c: tuple(talk) for c, talk in enumerate(talks)} | {99: (("user", "b"), ("user", "c"))}
    first = {}
    for c in sorted(whole):
        first.setdefault(whole[c], c)
    kept = {c: t for t, c in first.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in first)}
    for turns in (64, 2):
        found = {}
        for r in chat_format.format_chats(table, turns).orderBy("conv_id", "part").collect():
            found[r.conv_id] = found.get(r.conv_id, "") + r.chat
        assert found == {c: "".join(f"<|{role or 'unknown'}|>\n{text or ''}<|end|>\n" for role, text in t) for c, t in kept.items()}
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"aa": ["ta", "ko", "mi"], "bb": ["schr", "ung", "eit"], "cc": ["ção", "nh", "que"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang, "s"))
    rows += [(900, None, "aa", "s"), (901, "123 ... ²", "aa", "s"), (902, "", None, "s"), (None, "takomi", None, "s")]
    found = language_id.identify_languages(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows}
    for r in found:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 900:
            assert r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1
        elif r.doc_id is not None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    empty = frame(spark, rows).limit(0)
    assert language_id.identify_languages(empty).count() == 0
    untrained = language_id.identify_languages(frame(spark, [(1, "abc", None, "s")])).first()
    assert untrained.lang_pred == "und"


def test_words_of_code_switched_text(spark):
    rng = random.Random(2)
    parts = {"aa": ["ta", "ko", "mi"], "bb": ["schr", "ung", "eit"]}
    say = lambda lang, n: ["".join(rng.choices(parts[lang], k=3)) for _ in range(n)]
    rows = [(i, " ".join(say("ab"[i % 2] * 2, 60)), "ab"[i % 2] * 2, "s") for i in range(80)]
    switched = [("aa", w) for w in say("aa", 40)] + [("bb", w) for w in say("bb", 40)] + [("aa", w) for w in say("aa", 40)]
    rows += [(900, ", ".join(w.upper() for _, w in switched), None, "s"), (901, None, "aa", "s"), (902, "12 !", "aa", "s")]
    found = language_id.identify_words(frame(spark, rows)).where("doc_id >= 900").orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.place, r.word) for r in found] == [(900, i, w) for i, (_, w) in enumerate(switched)]
    assert sum(r.lang == lang for r, (lang, _) in zip(found, switched)) >= 0.95 * len(switched)
    assert all(0.5 <= r.score <= 1 for r in found)
    alone = language_id.identify_words(frame(spark, [(1, "abc def", None, "s")])).collect()
    assert [(r.word, r.lang, r.score) for r in alone] == [("abc", "und", 0.0), ("def", "und", 0.0)]
    assert language_id.identify_words(frame(spark, rows).limit(0)).count() == 0


def test_code_switching():
    rng = random.Random(0)
    make = lambda parts, n: ["".join(rng.choices(parts, k=3)) for _ in range(n)]
    a, b = ["ta", "ko", "mi"], ["schr", "ung", "eit"]
    model = language_id.train({"aa": [make(a, 60) for _ in range(20)], "bb": [make(b, 60) for _ in range(20)]})
    found = language_id.label_words(model, make(a, 30) + make(b, 30)).argmax(axis=1)
    assert (found[:28] == 0).all() and (found[32:] == 1).all()
    k = model.step
    assert k[0, 0] > k[0, 1] and k[1, 1] > k[1, 0]


def test_forward_backward():
    """Against the sum over all labellings."""
    import itertools

    rng = np.random.default_rng(0)
    crf = language_id.Crf(["a", "b"], {})
    crf.step = rng.normal(size=(2, 2)).astype(np.float32)
    scores = rng.normal(size=(7, 2)).astype(np.float32)
    found = crf.marginals(scores, np.array([0, 0, 0, 0, 1, 1, 1]), np.array([0, 1, 2, 3, 0, 1, 2]))
    for own in (slice(0, 4), slice(4, 7)):
        s = scores[own]
        total = np.zeros(s.shape)
        for y in itertools.product((0, 1), repeat=len(s)):
            w = np.exp(sum(s[i, k] for i, k in enumerate(y)) + sum(crf.step[i, j] for i, j in zip(y, y[1:])))
            for i, k in enumerate(y):
                total[i, k] += w
        assert np.allclose(found[own], total / total.sum(axis=1, keepdims=True), atol=1e-5)


def removed(rows, length=50):
    """Brute force of the removal of byte strings that start in documents of smaller id."""
    starts = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                g = b[k : k + length]
                starts[g] = min(i, starts.get(g, i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - length + 1):
                if starts[b[k : k + length]] < i:
                    gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("many", [512, 0])
def test_suffix_dedup(spark, corpus, many):
    found = suffix_dedup.dedup_suffixes(frame(spark, corpus).repartition(5), many=many).collect()
    assert sorted(str(tuple(r)) for r in found) == removed(corpus)


def test_suffix_dedup_edges(spark, corpus):
    assert suffix_dedup.dedup_suffixes(frame(spark, corpus).limit(0)).count() == 0
    rows = [(2, "x" * 120, "", ""), (1, "x" * 49, "", ""), (3, "x" * 50 + "y", "", ""), (5, "ab" * 30, "", ""), (4, "ba" * 40, "", "")]
    found = suffix_dedup.dedup_suffixes(frame(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in found) == removed(rows)
    kept = {r.doc_id: r for r in suffix_dedup.kept_texts(frame(spark, rows)).collect()}
    assert kept[3].text == "y" and kept[3].spans == [[0, 50]]


@pytest.mark.parametrize("letters", ["ab", "abc"])
def test_suffix_dedup_in_pieces(spark, letters, monkeypatch):
    """Documents longer than a chunk, on small alphabets, where strings repeat everywhere."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 130)
    monkeypatch.setattr(chunking, "GROUP_BYTES", 400)
    monkeypatch.setattr(chunking, "BUCKET_BYTES", 500)
    rng = random.Random(len(letters))
    parts = ["".join(rng.choices(letters, k=rng.randint(5, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12))), "", "") for i in range(25)]
    rows += [(None, parts[0] * 9, "", ""), (30, parts[0] * 9, "", ""), (30, parts[0] * 9, "", ""), (31, "ä" * 300, "", ""), (32, "xä" + "ä" * 250, "", "")]
    found = suffix_dedup.dedup_suffixes(frame(spark, rows).repartition(3), many=4).collect()
    assert sorted(str(tuple(r)) for r in found) == removed(rows)


def test_previous_factors():
    rng = np.random.default_rng(0)
    for size in (1, 2, 50, 50, 50, 400):
        data = rng.integers(97, 99, size + 10).astype(np.uint8)
        at, doc = np.arange(size), rng.integers(0, 5, size)
        order, common = suffix_dedup.suffix_order(data, at, 10)
        raw = data.tobytes()
        assert [raw[k : k + 10] for k in at[order]] == sorted(raw[k : k + 10] for k in at)

        def alike(i, j):
            return next((k for k in range(10) if raw[i + k] != raw[j + k]), 10)

        assert common.tolist() == [0, *(alike(i, j) for i, j in zip(order, order[1:]))]
        want = [max((alike(i, j) for j in at if doc[j] < doc[i]), default=0) for i in at]
        assert suffix_dedup.longest_previous_factors(order, common, doc).tolist() == want
    none = np.zeros(0, np.int64)
    assert len(suffix_dedup.longest_previous_factors(*suffix_dedup.suffix_order(np.zeros(0, np.uint8), none, 50), none)) == 0


def test_fingerprints(spark, corpus):
    found = fingerprints.fingerprint_edits(frame(spark, corpus).repartition(6)).collect()
    rows = sorted(((i, t or "") for i, t, *_ in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = (fingerprints.canonical(x) for x in (t, e, n))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.digest(a), fingerprints.digest(b), float(a == b), float(a == c)))
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, want))
    assert fingerprints.fingerprint_edits(frame(spark, corpus).limit(0)).count() == 0
    assert fingerprints.canonical("Ａ  b\u00a0C\n") == fingerprints.canonical("a B c") == b"a b c"
    edges = fingerprints.fingerprint_edits(frame(spark, [(1, "ab cd", "", "")])).collect()
    assert [(r.doc_id, r.near_next, r.n_chars) for r in edges] == [(1, 1.0, 5)]
    groups = {r.digest: r.n_docs for r in fingerprints.exact_groups(frame(spark, corpus)).collect()}
    assert sum(groups.values()) == len(corpus) and fingerprints.collisions(fingerprints.exact_groups(frame(spark, corpus))).count() == 0


@pytest.mark.parametrize("many", [False, True])
def test_fingerprint_collisions(spark, many, monkeypatch):
    """A digest of few values: unlike texts must not share a fingerprint."""
    digest = lambda form: f"{len(form) % (9 if not many else 1200):04d}"
    monkeypatch.setattr(fingerprints, "FEW_CLASHES", 3 if many else 1000)
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 6)) for _ in range(60)]
    texts += [t.upper() for t in texts[:10]] + ["same", " Same "]
    rows = sorted((i, t) for i, t in enumerate(texts))
    found = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, [(i, t, "", "") for i, t in rows]), digest).collect()}
    assert any("-" in r.fingerprint for r in found.values())
    forms = {}
    for i, t in rows:
        n = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        for form, mark in ((fingerprints.canonical(t), found[i].fingerprint), (fingerprints.canonical(t[: len(t) - half] + n[:half]), found[i].edited_fingerprint)):
            forms.setdefault(form, set()).add(mark)
    assert all(len(x) == 1 for x in forms.values())
    marks = [next(iter(forms[fingerprints.canonical(t)])) for t in {fingerprints.canonical(t): t for t in texts}.values()]
    assert len(marks) == len(set(marks))


def test_mixing(spark, corpus):
    rows = [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix_sources(frame(spark, corpus)).collect()]
    again = [tuple(r) for r in mixing.mix_sources(frame(spark, corpus).repartition(3)).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sizes = {}
    for i, t, _, s in corpus:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    listed = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(listed)}
    left, target, free = 1.5 * sum(sizes.values()), {}, list(listed)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] >= 2 * sizes[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    assert {(n, round(t, 6)) for _, _, n, t, _ in rows} == {(sizes[s], round(target[s], 6)) for s in listed}
    taken = {}
    for _, size, n, _, k in rows:
        assert 0 <= k <= 2 * size
        taken[n] = taken.get(n, 0) + k
    for s in listed:
        # Rows that share an id may lose a word each where the words run out.
        assert abs(taken[sizes[s]] - target[s]) <= 3
    assert mixing.mix_sources(frame(spark, corpus).limit(0)).count() == 0
    # At most one document of a source is taken in part.
    parts = {}
    for i, size, n, _, k in rows:
        if size and k % size:
            parts.setdefault(n, set()).add(i)
    assert all(len(x) == 1 for x in parts.values())
    kept = mixing.mix_sources(frame(spark, corpus), keep=("text", "size", "source"))
    assert kept.columns == ["doc_id", "size", "source_size", "target", "taken", "text", "size", "source"]
    assert sorted(str(tuple(r)[:5]) for r in kept.collect()) == sorted(map(str, rows))
    other = {r.doc_id: r.taken for r in mixing.mix_sources(frame(spark, corpus), seed="another").collect()}
    assert any(other[i] != k for i, *_, k in rows)
    nothing = mixing.mix_sources(frame(spark, [(1, None, "", "s"), (2, " ", "", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        t = prose(rng, rng.randint(5, 80))
        rows.append((i, " ".join(w.upper() + "!!###" for w in t.split()) if bad else t, "en", f"s{i % 5}"))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    labels += [(None, 1, 0), (5000, 1, 0), (2, None, 0), (4, 0, 0)]
    rows += [(900, None, None, None), (901, "", "en", "s1")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify_quality(frame(spark, rows), table).collect()}
    assert len(found) == len(rows)
    assert all(found[i].keep == bool(i % 4) for i in range(300))
    assert all(0 <= r.quality <= 1 for r in found.values())
    kept = quality.keep_quality(frame(spark, rows), table)
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.keep}
    assert quality.classify_quality(frame(spark, rows).limit(0), table).count() == 0
    plain = quality.classify_quality(frame(spark, rows), table.limit(0)).collect()
    assert len({round(r.p_doc, 6) for r in plain}) == 1


def posteriors(rows):
    """Brute force of the sites' posteriors: ``rows`` of (host, path, evidence); for each row
    the means of its host and path by the other rows."""
    paths, hosts = {}, {}
    for h, p, e in rows:
        paths.setdefault((h, p), []).append(e)
        hosts.setdefault(h, []).append(e)
    m = min(max(sum(e for _, _, e in rows) / len(rows), 0.01), 0.99)

    def strength(groups):
        w = sum(len(es) for es, _ in groups)
        t = sum(len(es) * ((sum(es) / len(es) - mean) ** 2 - mean * (1 - mean) / len(es)) for es, mean in groups) / w
        return min(max(m * (1 - m) / max(t, 1e-9) - 1, 1.0), 1e4)

    k1 = strength([(es, m) for es in hosts.values()])
    k2 = strength([(es, (sum(hosts[h]) + k1 * m) / (len(hosts[h]) + k1)) for (h, _), es in paths.items()])
    out = []
    for i, (h, p, _) in enumerate(rows):
        others = [e for j, (x, _, e) in enumerate(rows) if j != i and x == h]
        near = [e for j, (x, y, e) in enumerate(rows) if j != i and (x, y) == (h, p)]
        host = (sum(others) + k1 * m) / (len(others) + k1)
        out.append((host, (sum(near) + k2 * host) / (len(near) + k2)))
    return out, m


@pytest.mark.parametrize("few", [20_000, 1])
def test_quality_posteriors(spark, few, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", few)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = random.Random(2)
    rows = [(h, p, min(1.0, max(0.0, rng.gauss(0.2 + 0.15 * k + 0.05 * j, 0.1)))) for k, h in enumerate(["a", "b", None, "d"]) for j, p in enumerate(["x", None, "z"]) for _ in range(1 + 7 * k * j)]
    want, mean = posteriors(rows)
    sums, found, k1, k2 = quality.site_sums(spark.createDataFrame(rows, "host string, path string, e double"))
    assert abs(found - mean) < 1e-9
    own = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {quality.HOST} string, {quality.PATH} string, {quality.OWN} double")
    got = {r.i: (r[quality.HOST_MEAN], r[quality.PATH_MEAN]) for r in quality._with_sites(own, sums, found, k1, k2).collect()}
    assert len(got) == len(rows) and all(abs(a - b) < 1e-9 for i, w in enumerate(want) for a, b in zip(got[i], w))
    # The only document of its path takes its host's mean: its own evidence is no one else's.
    assert all(abs(got[i][0] - got[i][1]) < 1e-9 for i, r in enumerate(rows) if sum(x[:2] == r[:2] for x in rows) == 1)


def test_quality_sites_decide_unclear_documents(spark):
    """Documents alike, of a good and of a bad site: the sites' labels decide."""
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(200)]
    rows = [(i, t, "en", "good" if i % 2 else "bad") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify_quality(frame(spark, rows), labels).collect()}
    unseen = range(150, 200)
    assert sum(found[i].keep == bool(i % 2) for i in unseen) >= 48 > sum((found[i].p_doc >= 0.5) == bool(i % 2) for i in unseen)


def test_quality_clashing_columns(spark):
    rows = [(i, prose(random.Random(i), 20), "en", "s") for i in range(12)]
    clash = frame(spark, rows).withColumns({c: F.lit("x") for c in ("path_mean", "host_mean", "quality", "label", "label_id", "path", "h", "e", "keep")})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] * 2, "doc_id long, quality int, toxic int")
    kept = quality.keep_quality(clash.unionByName(clash.limit(3)), labels)
    assert kept.columns == clash.columns
    assert quality.classify_quality(clash, labels).count() == 12
    assert quality.keep_quality(clash, labels, threshold=0.0).count() == 12 and quality.keep_quality(clash.limit(0), labels).count() == 0


def test_decontaminate(spark, corpus):
    rng = random.Random(9)
    items = [(1, " ".join(corpus[0][1].split()[:30])), (2, "Alpha, BETA9"), (10, None), (11, "..."), (None, corpus[5][1]), (3, prose(rng, 30)), (3, " ".join(corpus[8][1].split()[:14]))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n string")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("null" if i is None else str(i))
    want = []
    for i, t, *_ in corpus:
        w, hit, ids = split(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= own
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    docs = frame(spark, corpus).repartition(3)
    assert sorted(str(tuple(r)) for r in decontaminate.decontaminate(docs, table).collect()) == sorted(map(str, want))
    held, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, 20
    try:
        assert sorted(str(tuple(r)) for r in decontaminate.decontaminate(docs, table).collect()) == sorted(map(str, want))
    finally:
        decontaminate.BLOCK_WORDS = held
    clean = decontaminate.decontaminate(docs, table.limit(0)).collect()
    assert len(clean) == len(corpus) and not any(r.contaminated for r in clean)
    assert decontaminate.decontaminate(docs.limit(0), table).count() == 0
    exact = {(r.doc_id, r.start, r.item_id) for r in decontaminate.find_matches(docs, table).collect()}
    near = {(r.doc_id, r.start, r.item_id) for r in decontaminate.find_matches(docs, table, slop=1).collect()}
    assert exact and exact <= near


def test_decontaminate_long_texts_and_common_terms(spark):
    """A text of several segments' size in one segment; many windows of one rarest term, asked
    a few at a time; most of the vocabulary in no document."""
    passage = " ".join(f"p{k}" for k in range(13))
    long_text = " ".join(f"w{k % 5000}" for k in range(900_000)) + " " + passage + " end"
    items = [(f"i{k}", f"{passage} x{k}") for k in range(40)] + [(f"n{k}", " ".join(f"absent{k}_{j}" for j in range(20))) for k in range(200)]
    docs = spark.createDataFrame([(1, long_text), (2, passage), (3, "w1 w2"), (4, None), (5, "")], "doc_id long, text string")
    held, decontaminate.LIKELY = decontaminate.LIKELY, 3
    try:
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    finally:
        decontaminate.LIKELY = held
    assert len(long_text) > decontaminate.SEGMENT_BYTES
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (900_014, 13, 40, False)
    assert (got[2].n_words, got[2].n_hit, got[2].n_items, got[2].contaminated) == (13, 13, 40, True)
    assert all((got[d].n_hit, got[d].n_items) == (0, 0) for d in (3, 4, 5))


def near_matches(rows, items, window, slop):
    """Brute force of proximity matches: every word within ``slop`` of its place from the
    rarest word (by all documents)."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    texts = [(i, split(t)) for i, t, *_ in rows]
    counts = {}
    for _, w in texts:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    owners = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[k : k + window]), set()).add("null" if i is None else str(i))
    out = []
    for win, own in owners.items():
        rare = min(range(len(win)), key=lambda k: (counts.get(win[k], 0), k))
        for i, w in texts:
            for at in (k for k, x in enumerate(w) if x == win[rare]):
                start = at - rare
                if all(win[k] in w[max(0, start + k - slop) : max(0, start + k + slop + 1)] for k in range(len(win))):
                    out += [(i, x, start, len(win)) for x in own]
    return sorted(map(str, out))


@pytest.mark.parametrize("slop", [0, 1, 3])
@pytest.mark.parametrize("block", [2_000_000, 3])
def test_proximity(spark, slop, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(9)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), "", "") for i in range(30)] + [(None, "w1 w2 w3 w4", "", ""), (40, None, "", "")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 7)))) for k in range(6)] + [(1, "w1 w2"), (None, "w3 w4 w5 w6 w7"), (9, None), (10, "absent w1")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(frame(spark, rows).repartition(3), table, 4, slop)
    assert sorted(str(tuple(r)) for r in found.collect()) == near_matches(rows, items, 4, slop)
    assert decontaminate.find_matches(frame(spark, rows), table.limit(0), 4, slop).count() == 0


def test_keep_clean_edges(spark):
    item = prose(random.Random(1), 20)
    rows = [(1, item, "", ""), (1, "clean", "", ""), (2, None, "", ""), (3, "", "", ""), (None, item, "", ""), (4, "fine", "", ""), (4, "fine", "", "")]
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.keep_clean(frame(spark, rows), table)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, None), (3, ""), (None, item), (4, "fine"), (4, "fine")], key=str)
    assert decontaminate.keep_clean(frame(spark, rows), table.limit(0)).count() == 7 and decontaminate.keep_clean(frame(spark, rows).limit(0), table).count() == 0


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, corpus, n, percent):
    sets = [(i, shingles(t, n)) for i, t, *_ in corpus]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = sorted(str((i, len(s), None if i is None else find(i))) for i, s in sets)
    found = ngram_join.join_ngrams(frame(spark, corpus).repartition(7), n, percent).drop("class_id", "class_key").collect()
    assert sorted(str(tuple(r)) for r in found) == want


def test_ngram_join_in_blocks(spark, corpus, monkeypatch):
    """Blocks of two sets, spread keys and small groups give the same rows."""
    judge = lambda: sorted(map(str, ngram_join.join_ngrams(frame(spark, corpus).repartition(3), 2, 50).collect()))
    want = judge()
    for module, name, value in ((ngram_join, "STAR_SETS", 2), (ngram_join, "BLOCK_SETS", 3), (common, "HOT_ROWS", 3), (chunking, "GROUP_BYTES", 2000), (ngram_join, "CHUNK_BYTES", 900)):
        monkeypatch.setattr(module, name, value)
    assert judge() == want


def test_class_links(spark, corpus):
    """All links, against all pairs of documents."""
    docs = [(i, shingles(t, 2)) for i, t, *_ in corpus]
    like = lambda s, t: bool(s) and 100 * len(s & t) >= 60 * len(s | t)
    known = [(i, s) for i, s in docs if i is not None and s]
    want = sorted((i, sum(like(s, t) for _, t in known) - 1) for i, s in known)
    pairs, rows = ngram_join.class_links(frame(spark, corpus), 2, 60)
    assert sorted((r.doc_id, r.n_links) for r in rows.collect()) == want
    classes = {r.class_key: r.doc_id for r in rows.collect()}
    first = {}
    for i, s in sorted(known, key=lambda x: x[0]):
        first.setdefault(frozenset(s), i)
    linked = {(first[frozenset(s)], first[frozenset(t)]) for _, s in known for _, t in known if s != t and like(s, t)}
    assert sorted((r.a.rep, r.b.rep) for r in pairs.collect()) == sorted((a, b) for a, b in linked if a < b)
    assert len(classes) == len(first)
    pairs, rows = ngram_join.class_links(frame(spark, corpus).limit(0))
    assert pairs.count() == rows.count() == 0


def test_ngram_join_edges(spark, corpus):
    assert ngram_join.join_ngrams(frame(spark, corpus).limit(0)).count() == 0
    kept = ngram_join.keep_firsts(frame(spark, corpus))
    assert kept.columns == frame(spark, corpus).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 2000 in ids


def test_repeated_ids_with_different_texts(spark):
    """Rows with one doc_id are documents of their own."""
    rng = random.Random(6)
    a, b, c = (prose(rng, 30) for _ in range(3))
    rows = [(5, a, "", ""), (5, b, "", ""), (5, b, "", ""), (3, b + " more", "", ""), (7, a, "", ""), (8, c, "", ""), (8, None, "", ""), (8, "", "", ""), (9, None, "", "")]
    found = ngram_join.join_ngrams(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (5, 3), (5, 3), (5, 5), (7, 5), (8, 8), (8, 8), (8, 8), (9, 9)]
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_firsts(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(3, b + " more"), (5, a), (8, c), (8, None), (9, None)], key=str)


def test_trie():
    rng = np.random.default_rng(0)
    for _ in range(150):
        universe = int(rng.integers(5, 40))
        base = [rng.permutation(universe)[: int(rng.integers(1, universe))] for _ in range(3)]
        found = {}
        for _ in range(int(rng.integers(2, 25))):
            s = set(base[int(rng.integers(3))].tolist())
            for _ in range(int(rng.integers(0, 3))):
                s ^= {int(rng.integers(universe))}
            if s:
                found[tuple(sorted(s))] = np.array(sorted(s))
        sets = list(found.values())
        trie = ngram_join.Trie(sets)
        for s in sets:
            for first in (0, 3):
                got = sorted(trie.partners(s, universe, 80, lambda i: False, first))
                both = [set(s.tolist()) & set(o.tolist()) for o in sets]
                assert got == [i for i, (o, k) in enumerate(zip(sets, both)) if k and 100 * len(k) >= 80 * (len(s) + len(o) - len(k)) and (not first or min(k) >= first)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


SECRETS = ['token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', "password: hunter2", "API_KEY=abcd1234efgh", "AKIAABCDEFGHIJKL", "AKIA1234", "token: secret : longvalue123", "Token=secret=abcdefghij", "ſecret=abcdefgh1", "a" * 40, "deadbeef" * 5]


def test_secret_scan(spark):
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 5)} {rng.choice(SECRETS)} é {prose(rng, 3)} {rng.choice(SECRETS)}", "en", "s") for i in range(60)]
    rows += [(900, None, "", ""), (901, "", "", ""), rows[0]]
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r, (i, t, *_) in zip(sorted(secret_scan.scan_secrets(frame(spark, rows)).collect(), key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0])):
        t = t or ""
        base = [("assign", *m.span()) for m in assign.finditer(t) if len(m[1]) >= 8]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        kinds = ["assign", "access", "hex"]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(base, key=lambda x: (x[1], kinds.index(x[0]))))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, *_ in base) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert secret_scan.scan_secrets(frame(spark, rows).limit(0)).count() == 0
    clean = secret_scan.redact_secrets(frame(spark, rows)).collect()
    assert all(not secret_scan.base_spans(r.text) and r.n_chars == len(r.text) for r in clean if r.text)


def test_automaton_likelihood(monkeypatch):
    """Without merging, against counts of prefixes; the probabilities of each state add up to one."""
    rng = random.Random(4)
    samples = ["".join(rng.choices("ab9Z-+", k=rng.randint(1, 5))) for _ in range(200)]
    spelled = ["".join(map(secret_scan.symbol, s)) for s in samples]
    monkeypatch.setattr(secret_scan.Automaton, "_compatible", lambda *_: False)
    tree = secret_scan.Automaton(samples)
    share = lambda n, of, kinds: 0.99 * n / of + 0.01 / kinds

    def likelihood(token):
        of = "".join(map(secret_scan.symbol, token)) + "$"
        total = np.log(share(sum(len(s) == len(token) for s in spelled), len(spelled), 256))
        for i, c in enumerate(of):
            n, seen = sum(s.startswith(of[:i]) for s in spelled), sum((s + "$").startswith(of[: i + 1]) for s in spelled)
            if not seen:
                return -np.inf
            total += np.log(share(seen, n, 7) / secret_scan.WIDTH.get(c, 1))
        return total

    for token in [*samples[:50], "zz", "99999999", "aZ-+9b", "+" * 12]:
        a, b = tree.score(token), likelihood(token)
        assert a == b == -np.inf or abs(a - b) < 1e-9
    monkeypatch.undo()
    merged = secret_scan.Automaton(samples)
    reached = {0} | {t for step in merged.next for t in step.values()}
    assert len(reached) < len({s[:k] for s in spelled for k in range(len(s) + 1)})
    for state in reached:
        assert sum(merged.out[state].values()) == merged.total[state] > 0
    chain = secret_scan.Chain(secret_scan.steps({"abc": 3, "Zz9": 1}))
    for last in "^haA9":
        assert abs(sum(np.exp(chain.cost[last + c]) * secret_scan.WIDTH.get(c, 1) for c in "9haA-+$") - 1) < 1e-9


def ordinary_words(rng, n):
    return ["".join(rng.choices(["tion", "er", "ing", "an", "th", "ed", "con", "es"], k=rng.randint(2, 6))) for _ in range(n)]


def test_ordinary_formats_are_left_alone():
    """Paths, identifiers, ids, rules of punctuation and dates, of which the corpus has shown
    nothing, are no credentials; new credentials of the learned formats are."""
    rng = random.Random(6)
    take = lambda chars, n: "".join(rng.choices(chars, k=n))
    upper, digits, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    formats = {"assign": lambda: take(hexes, 40), "access": lambda: "AKIA" + take(upper + digits, 16), "hex": lambda: take(hexes, 32)}
    grammar = secret_scan.Grammar({k: [make() for _ in range(300)] for k, make in formats.items()} | {"word": ordinary_words(rng, 3000)})
    ordinary = """getElementById src/main/java/org/App ========== -------- ________ ------------------------ 2024-01-31 20240131 1234567890 31/12/2023
        550e8400-e29b-41d4-a716-446655440000 xoxb-123456789012 internationalization Donaudampfschifffahrt com.example.project.Main README_en.md
        snake_case_identifier CamelCaseIdentifier __init__.py /usr/local/share/doc aGVsbG8gd29ybGQgZm9vYmFy+/= UPPERCASE_CONSTANT MAX_VALUE_2 v1.2.3-beta.4
        deadbeef cafebabe effaced0 +49/30/1234567 INTERNATIONAL ABCDEFGHIJKLMNOP 192.168.100.200 1,000,000 user_name_2024 a=b=c=d=e=f=g ./././././. abababababab""".split()
    text = " ".join(ordinary)
    base, more = grammar.spans(text)
    assert [text[s:e] for _, s, e in more] == [] and base == []
    found = {k: sum(grammar.is_secret(make()) for _ in range(200)) for k, make in formats.items()}
    assert all(n >= 198 for n in found.values())
    assert sum(grammar.is_secret("ASIA" + take(upper + digits, 16)) for _ in range(200)) >= 198
    assert not any(map(grammar.is_secret, ordinary_words(rng, 3000)))


def test_redact_edges(spark):
    key = "AKIA" + "Q" * 16
    rows = [(i, f"see {key} and {key}", "", "") for i in range(12)] + [(20, None, "", ""), (21, "", "", ""), (22, "plain " * 3000, "", "")]
    for kind in ("string", "long", "int", "double"):
        docs = frame(spark, rows).withColumn("n_chars", F.lit(7).cast(kind)).withColumn("spans", F.lit("x"))
        kept = {r.doc_id: r for r in secret_scan.redact_secrets(docs).collect()}
        assert kept[3].text == "see [SECRET] and [SECRET]" and kept[20].text is None and kept[21].text == "" and kept[22].text == "plain " * 3000
        assert kept[3].n_chars == {"string": "7", "double": 7.0}.get(kind, 25)
    assert secret_scan.redact_secrets(frame(spark, rows).limit(0)).count() == 0


def test_grammar_finds_unmarked_credentials():
    rng = random.Random(0)
    key = lambda n: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", k=n))
    words = ["".join(rng.choices(["tion", "er", "ing", "an", "th"], k=5)) for _ in range(300)]
    grammar = secret_scan.Grammar({"assign": [], "access": ["AKIA" + key(16) for _ in range(200)], "hex": [], "word": words})
    text = f"see ASIA{key(16)} and {words[0]} or internationalization2024"
    base, more = grammar.spans(text)
    assert not base and [text[s:e] for _, s, e in more] == [text[4:24]]


@pytest.mark.parametrize("form", ["AA99AA99A", "AA9A.A99A.9AAA9A9A", "AAAA-AAAA-AAAA"])
def test_grammar_finds_short_dotted_and_digit_free_credentials(form):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice({"A": "GHJKLMNPQRSTUVWXYZ", "9": "0123456789"}.get(c, c)) for c in form)
    words = ["".join(rng.choices(["tion", "er", "ing", "an", "th", "ed"], k=5)) for _ in range(300)]
    grammar = secret_scan.Grammar({"assign": [key() for _ in range(200)], "access": [], "hex": [], "word": words})
    secret = key()
    text = f"It was {secret}. Then {words[0]} and {words[1]}.{words[2]} came"
    base, more = grammar.spans(text)
    assert not base and [text[s:e] for _, s, e in more] == [secret]
    # Glued to a word by a dot, a secret is found as a piece.
    if "." not in form:
        text = f"{words[0]}{words[1]}{words[2]}{words[3]}.{secret}"
        assert [text[s:e] for _, s, e in grammar.spans(text)[1]] == [secret] or grammar.is_secret(text)


def test_ordinary_tokens_are_learned_from_all_documents(spark):
    rows = [(i, f"ordinary{i:05d} and token = abcdefgh{i:05d}", "en", "s") for i in range(3000)]
    found = secret_scan.labelled_tokens(frame(spark, rows))["word"]
    assert isinstance(found, dict) and found["^a"] == 3000 and found["9$"] == 3000 and found["99"] == 12000 and found["#13"] == 3000


def pipeline_tables(spark, folder):
    """Documents for all stages: bad ones, near copies, benchmark passages, secrets, nulls,
    empty texts and repeated rows."""
    rng = random.Random(8)
    good = [prose(rng, 60) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(100 + i, good[i] + " more", "en", "s1", 1) for i in range(5)]
    rows += [(200 + i, " ".join(w.upper() + "!!###" for w in prose(rng, 40).split()), "en", "s2", 1) for i in range(20)]
    item = prose(rng, 20)
    rows += [(300, item + " tail", "en", "s0", 1), (301, prose(rng, 30) + ' token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', "en", "s0", 1)]
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, prose(rng, 50), "en", "s1", 1), rows[3], rows[3], (402, prose(rng, 3000), None, "s1", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(200 + i, 0, 0) for i in range(10)] + [(400, 1, 0), (401, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """What each stage keeps of its own input."""
    import corpus_pipeline

    item = pipeline_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{tmp_path}/labels.parquet")
    lines = lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)
    held, given = lines(docs), docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]

    judged = {(r.doc_id, r.p_doc): r.keep for r in quality.classify_quality(given, labels).collect()}
    keeps = {i: k for (i, _), k in judged.items()}
    now = stages["quality classifier"](spark, given, str(tmp_path))
    assert now.columns == columns
    want = [r for r in held if keeps[r[0]]]
    assert lines(now) == want and not any(200 <= (r[0] or 0) < 220 for r in want) and {i for i, *_ in want} >= set(range(40)) | {301, 402, None}

    held, given = want, common.materialise(now)
    sets = [shingles(r[1], 5) for r in held]
    like = lambda s, t: bool(s) and bool(t) and 100 * len(s & t) >= 80 * len(s | t)
    group = list(range(len(held)))
    for a, s in enumerate(sets):
        for b in range(a):
            if held[a][0] is not None and held[b][0] is not None and like(s, sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {g: min(held[k][0] for k in range(len(held)) if group[k] == g and held[k][0] is not None) for k0, g in enumerate(group) if held[k0][0] is not None}
    want = sorted({r for r, g in zip(held, group) if r[0] is not None and r[0] == first[g]} | {r for r in held if r[0] is None}, key=str)
    now = stages["n-gram Jaccard join"](spark, given, str(tmp_path))
    assert now.columns == columns and lines(now) == want and len(want) < len(held)

    held, given = want, common.materialise(now)
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    windows = {tuple(split(item)[k : k + 13]) for k in range(len(split(item)) - 12)}

    def contaminated(text):
        w, hit = split(text), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit.update(range(k, k + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    want = [r for r in held if r[0] is None or not contaminated(r[1])]
    now = stages["benchmark decontamination"](spark, given, str(tmp_path))
    assert now.columns == columns and lines(now) == want and 300 not in {r[0] for r in want}

    held, given = want, common.materialise(now)
    redact = lambda t: None if t is None else re.sub('token = "[0-9a-f]{40}', "[SECRET]", t)
    want = sorted(((i, redact(t), lang, source, n if t is None else len(redact(t))) for i, t, lang, source, n in held), key=str)
    now = stages["secret scans"](spark, given, str(tmp_path))
    assert now.columns == columns and lines(now) == want

    given = common.materialise(now)
    found = stages["mixing sources"](spark, given, str(tmp_path)).collect()
    sizes = {}
    for _, t, _, source, _ in want:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(map(str, ((r.doc_id, r.text, r.lang, r.source) for r in found))) == sorted(map(str, (r[:4] for r in want)))
    taken = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in found) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert sorted(map(str, found)) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    full = tmp_path / "full"
    pipeline_tables(spark, full)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{full}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    # Without labels and benchmark only repeats go.
    spark.read.parquet(f"{full}/documents.parquet").write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/none").collect()]
    assert {300, 301, 400, 401, None} <= set(kept) and len(kept) == len(set(kept))
