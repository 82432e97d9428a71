"""Operators against brute force, on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import common, components, decontaminate, langid, linededup, merkle, mixing, pii, repeats, simhash, substring_bwt, substring_sam, toxicity

from .conftest import passage

BLANK = r"[^\x20\x09-\x0D]+"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def want(rows):
    return sorted(map(tuple, rows), key=repr)


# ---- 1 decontamination

ITEMS = [(1, passage(1, 60)), (2, passage(103, 12)), (3, passage(104, 4)), (4, "x"), (5, None), (6, "?!"), (None, passage(105, 11)), (2, passage(106, 12)), (70, passage(7, 30))]


def brute_hits(table, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = []
    for item, text in items:
        w = re.findall(word, lower(text))
        m = min(window, len(w))
        windows += [(item, w[i : i + m]) for i in range(len(w) - m + 1)] if m else []
    for doc_id, text, *_ in table:
        w, hit, found = re.findall(word, lower(text)), set(), set()
        at = {}
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        for item, g in windows:
            for i in at.get(g[0], ()):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found |= {str(item)} if item is not None else set()
        yield doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_decontamination(spark, docs, none, table, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.hit_report(docs, items, block_bytes=block_bytes)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want(brute_hits(table, ITEMS))
    assert decontaminate.hit_report(none, items).count() == 0
    assert decontaminate.hit_report(docs, items.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not x[5] for x in brute_hits(table, ITEMS))


def test_words_of_one_letter_patterns():
    words = lambda data, *off: decontaminate.Words(np.frombuffer(data, np.uint8), np.array(off))
    table = decontaminate.WuManber(1, words(b"a bb", 0, 4), np.array([0, 1]))
    at, pattern = table.search(words(b"a bb c abb", 0, 8, 8, 10))
    assert sorted((i, table.order[table.members[p]].item()) for i, p in zip(at.tolist(), pattern.tolist())) == [(0, 0), (1, 1), (3, 0), (4, 1)]


def test_many_patterns_keep_their_shifts(monkeypatch):
    """Shifts stay long and tables small as items grow, and blocks of three words find what blocks of two find."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    items = [(" ".join(word() for _ in range(100)).encode(), [str(i)]) for i in range(1000)]
    items += [(items[0][0][:300], ["x"])]
    patterns = decontaminate.Patterns(items, 10)
    table = patterns.tables[-1][0]
    text = " ".join([*(word() for _ in range(5000)), items[7][0].decode(), *(word() for _ in range(50))]).encode()
    words = decontaminate.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    block = words.windows(np.arange(4990), table.B)
    assert table.B == 3 and table.shift[table._slot(block)].mean() > 5
    size = sum(x.nbytes for x in (table.shift, table.whole, table.at, table.suffixes, table.bucket, table.members, table.order, table.words.hashes, table.words.at, table.words.bytes))
    assert size < 40 * sum(len(t) for t, _ in items)
    hit, found = patterns.hits(words)
    monkeypatch.setattr(decontaminate, "MANY", 10**9)
    again = decontaminate.Patterns(items, 10)
    assert again.tables[-1][0].B == 2 and found == [{"7"}] and hit.sum() == 100
    assert np.array_equal(again.hits(words)[0], hit) and again.hits(words)[1] == found
    first = decontaminate.Words(np.frombuffer(items[0][0], np.uint8), np.array([0, len(items[0][0])]))
    assert patterns.hits(first)[1] == [{"0", "x"}]


def test_segments_of_long_texts_hold_every_window():
    text = passage(7, 400).encode()
    whole = decontaminate.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    n = 0
    for first, data, off in decontaminate._segments(text, 10, 50):
        words = decontaminate.Words(data, off)
        assert first == (n - 9 if n else 0) and np.array_equal(words.hashes, whole.hashes[first : first + len(words.hashes)])
        n = first + len(words.hashes)
    assert n == len(whole.hashes)


# ---- 2 and 4 repeated passages


def covered(sequences, length):
    counts = Counter(tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if counts[tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length]] > 1:
                gone[i : i + length] = True
        yield gone


@pytest.mark.parametrize("options", [{}, {"most_units": 250}, {"batch_units": 1, "kept": 1}])
def test_substring_bwt(docs, none, table, options):
    texts = [(t or "").encode() for _, t, *_ in table]
    expected = []
    for (doc_id, *_), text, gone in zip(table, texts, covered(texts, 200)):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        expected.append((doc_id, len(text), int(gone.sum()), spans, sha(bytes(b for b, g in zip(text, gone) if not g))))
    out = substring_bwt.removal_report(docs, **options)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(expected)
    assert substring_bwt.removal_report(none).count() == 0


@pytest.mark.parametrize("options", [{}, {"most_units": 40}, {"batch_units": 1, "kept": 1}])
def test_substring_automaton(docs, none, table, options):
    words = [re.findall(BLANK, t or "") for _, t, *_ in table]
    expected = [(row[0], len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone) if not g))) for row, w, gone in zip(table, words, covered(words, 35))]
    out = substring_sam.removal_report(docs, **options)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(expected)
    assert substring_sam.removal_report(none).count() == 0


def test_merged_transforms_by_brute_force():
    r = random.Random(5)
    for alphabet in ("a", "ab", "abcdefgh"):
        pieces = [bytes(ord(r.choice(alphabet)) for _ in range(r.randint(200, 399))) for _ in range(20)]
        pieces += [pieces[0][50:] + pieces[1][:100], pieces[2][:205], b"z" + pieces[3][:210]]
        pieces = list(dict.fromkeys(p for p in pieces if len(p) >= 200))
        weights = np.array([r.choice((1, 1, 1, 2)) for _ in pieces])
        counts = Counter()
        for p, w in zip(pieces, weights):
            for i in range(len(p) - 199):
                counts[p[i : i + 200]] += int(w)
        flags = substring_bwt.repeated_windows(pieces, weights)
        assert [[counts[p[i : i + 200]] > 1 for i in range(len(p) - 199)] for p in pieces] == [f.tolist() for f in flags]


def test_many_shards(monkeypatch):
    monkeypatch.setattr(substring_bwt, "SHARD_UNITS", 600)
    test_merged_transforms_by_brute_force()


def test_automaton_counts_and_matches():
    r = random.Random(6)
    sequences = [[r.randint(0, 2) for _ in range(r.randint(1, 40))] for _ in range(12)]
    automaton = substring_sam.Automaton(sequences, [1] * len(sequences))
    text = [r.randint(0, 3) for _ in range(200)]
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for i, (size, _) in enumerate(automaton.matches(text, 1000)):
        best = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in inside), default=0)
        assert size == best


def test_match_reference(spark, docs):
    out = substring_sam.match_reference(docs, spark.createDataFrame([(passage(1, 60),), (None,)], "text string"), shard_words=1).collect()
    assert max(r.longest for r in out) == 60 and {r.covered for r in out} >= {0, 60, 120}
    again = substring_sam.match_reference(docs, spark.createDataFrame([(passage(1, 60),), (None,), (passage(2, 40),)], "text string"), shard_words=36, sent_bytes=1).collect()
    assert sorted(r.covered for r in again) == sorted(r.covered for r in out) and min(60, max(r.longest for r in again)) >= 35


def thue_morse(n):
    w = [0]
    while len(w) < n:
        w += [1 - x for x in w]
    return "".join("ab"[x] for x in w[:n]), "".join("ba"[x] for x in w[:n])


def test_long_words_that_differ_in_a_pattern_are_not_equal(spark):
    """Polynomial hashes modulo a power of two take such words for equal, whatever their letters stand for."""
    one, other = thue_morse(2048)
    stem = " ".join(f"w{i}" for i in range(34))
    rows = spark.createDataFrame([(1, f"{stem} {one}"), (2, f"{stem} {other}"), (3, one), (4, other)], "doc_id long, text string")
    assert {r.n_removed for r in substring_sam.removal_report(rows).collect()} == {0}
    texts = [r.text.encode() for r in rows.collect()]
    expected = {i: int(gone.sum()) for (i, _), gone in zip(rows.collect(), covered(texts, 200))}
    assert {r.doc_id: r.n_removed for r in substring_bwt.removal_report(rows).collect()} == expected


def test_segments_of_long_texts(monkeypatch):
    r = random.Random(9)
    text = "".join(r.choice("ab \n\t") * r.choice((1, 1, 1, 30)) for _ in range(3000)).encode()
    words = text.split()
    for limit, again in ((1, 0), (50, 3), (200, 34), (10**6, 34)):
        n, out = 0, []
        for run, _ in repeats.word_runs(text, limit, again):
            assert run == words[n : n + len(run)]
            out, n = out[: n] + run, n + len(run) - again
        assert out == words
    units = repeats.Bytes(20, 4)
    parts = list(units.segments(text, 100))
    assert all(text[a : a + len(x)] == x for a, x in parts) and [x for a, p in parts for x in range(a, a + len(p) - 19)] == list(range(len(text) - 19))


def test_sliding_min():
    r = np.random.default_rng(1)
    for n, w in ((10, 3), (7, 7), (100, 1), (64, 16)):
        x = r.integers(0, 50, n).astype(np.uint64)
        assert repeats.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(n - w + 1)]


# ---- 3 toxicity


def test_toxicity(spark, docs, none):
    r = random.Random(3)
    bad = ["grumpf", "blorgh", "snarkle"]
    rows = [(i, " ".join([passage(1000 + i, r.randint(5, 60)), *(r.sample(bad, 2) if i % 3 == 0 else [])]), i % 3 == 0) for i in range(600)]
    many = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(x), None) for i, _, x in rows] + [(0, 0, 1), (None, 1, 1), (10**9, 1, 1)], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity_report(many, marks, fit_each=200).collect()
    held = [x for x in out if x.held_out]
    assert 60 < len(held) < 180 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    assert sum((x.predicted == 1) == (x.doc_id % 3 == 0) for x in held) / len(held) > 0.95
    assert toxicity.toxicity_report(docs, marks).count() == docs.count()
    assert toxicity.toxicity_report(none, marks).count() == 0
    flat = toxicity.toxicity_report(docs, marks.limit(0)).collect()
    assert {x.score for x in flat} == {0.5}
    joined = toxicity.labelled(many, marks, most_sent=0)
    assert got(joined, "doc_id", "toxic") == got(toxicity.labelled(many, marks), "doc_id", "toxic")


# ---- 5 personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = ["a@b.c_x@d.e@f.g", "a@b..c@d.e.", "1.2.3.4.5.6.7.8", "1.2.3.400 1.2.3.4", "+1 234 567 890 +44-20 7946 0958", "4111-1111-1111-1111 4111 1111 1111 11114111", "@@a@b-c.d-e", "0000000000000 0.0.0.0", "é@b.c ü+12345678901", "+1", "1.1.1." * 20_000, "a" * 50_000 + "@b" + ".c" * 20_000, "9 " * 30_000, "GB82 WEST 1234 5698 7654 32 konto", "GB82 WEST 1234 5698 7654 33"]


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs, none, table):
    rows = [(r[0], r[1]) for r in table] + [(1000 + i, t) for i, t in enumerate(ODD)]
    out = pii.pii_report(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(table) :], "doc_id long, text string"))).collect()
    expected = []
    for doc_id, text in rows:
        spans = base_spans(text or "")
        n = Counter(k for k, _, _ in spans)
        expected.append((doc_id, *(n[k] for k in KINDS), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    assert want((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want(expected)
    ibans = {r.doc_id: r.n_iban for r in out if r.n_iban}
    assert ibans == {1013: 1} | {r[0]: 1 for r in table if r[1] and "IBAN" in r[1]}
    assert pii.pii_report(none).count() == 0
    assert all(s.value == r.text[s.start : s.end] for r in pii.find_spans(docs).collect() for s in r.spans)


# ---- 6 language


def test_language(spark, docs, none):
    r = random.Random(4)
    letters = {"aa": "abcde ", "bb": "efghi ", "cc": "ijklm "}
    rows = [(i, "".join(r.choice(letters[lang]) for _ in range(200)), lang) for i in range(150) for lang in [list(letters)[i % 3]]]
    extra = [(1000, None, "aa"), (1001, "?! 12", "bb"), (1002, "ABC DE", None), (None, "", None)]
    out = {x.doc_id: x for x in langid.language_report(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")).collect()}
    held = [x for x in rows if out[x[0]].held_out]
    assert held and all(out[i].lang_pred == lang for i, _, lang in held)
    assert (out[1000].lang_pred, out[1000].score, out[1001].lang_pred, out[1002].lang_pred) == ("und", 0.0, "und", "aa")
    assert langid.language_report(docs).count() == docs.count() and langid.language_report(none).count() == 0
    kept = langid.keep_known(docs)
    assert kept.schema == docs.schema and kept.filter("text IS NULL OR text = ''").count() == 0
    one = langid.train(docs.filter("lang = 'en'")).collect()
    two = langid.train(docs.filter("lang = 'en'").repartition(3)).collect()
    assert [x.lang for x in one] == ["en"] and one == two
    few = langid.language_report(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string"), sent=1).collect()
    assert {(x.doc_id, x.lang_pred, x.score) for x in few} == {(x.doc_id, x.lang_pred, x.score) for x in out.values()}


def test_language_stage_judges_by_length(spark):
    """Clean texts of every length stay; long ones like no learned language go."""
    r = random.Random(14)
    letters = {"aa": "abcde ", "bb": "efghi ", "cc": "ijklm "}
    rows = [(i, "".join(r.choice(letters[lang]) for _ in range(r.choice((6, 12, 30, 90, 300, 1000)))), lang) for i in range(1500) for lang in [list(letters)[i % 3]]]
    odd = [(5000 + i, "".join(r.choice("qrstuvwxyzäöü ") for _ in range(600)), None) for i in range(5)]
    kept = {x.doc_id for x in langid.keep_known(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert kept == {i for i, t, _ in rows if t.strip()}


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_quality(spark):
    """On the test tables: language accuracy, and precision and recall of toxic labels on texts not learned from."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    told = langid.language_report(docs).filter("held_out AND lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x.lang == x.lang_pred for x in told) / len(told) > 0.98
    found = toxicity.toxicity_report(docs, labels).join(labels.filter("toxic IS NOT NULL"), "doc_id").filter("held_out").collect()
    right = sum(x.toxic == 1 and x.predicted == 1 for x in found)
    assert right / max(1, sum(x.predicted for x in found)) > 0.8 and right / sum(x.toxic for x in found) > 0.5
    ranks = [(x.score, x.toxic) for x in found]
    pairs = [(a > b) + (a == b) / 2 for a, x in ranks if x for b, y in ranks if not y]
    assert sum(pairs) / len(pairs) > 0.95


def test_fit_against_plain_descent():
    """The accelerated fit reaches the loss that many plain steps reach."""
    r = np.random.default_rng(3)
    ratio = np.zeros(toxicity.SLOTS)
    ratio[:40] = r.normal(0, 2, 40)
    texts, toxic = [], np.array([float(i % 3 == 0) for i in range(120)])
    for y in toxic:
        places = np.unique(r.choice(40, 12, p=np.where(ratio[:40] * (2 * y - 1) > 0, 2.0, 1.0) / np.where(ratio[:40] * (2 * y - 1) > 0, 2.0, 1.0).sum()))
        texts.append((places.astype(np.int32), r.integers(1, 5, len(places)).astype(np.uint8)))
    rows = np.zeros((120, 40))
    for i, (f, n) in enumerate(texts):
        rows[i, f] = np.rint(16 * np.log2(1 + n.astype(int))) * ratio[f]
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    weigh = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    ridge = 1e-3 / 120
    loss = lambda w, b: (weigh * np.logaddexp(0, -(2 * toxic - 1) * (rows @ w + b))).sum() + ridge / 2 * (w @ w)
    w, b = np.zeros(40), 0.0
    for _ in range(4000):
        e = (1 / (1 + np.exp(-(rows @ w + b))) - toxic) * weigh
        w, b = w - 2 * (rows.T @ e + ridge * w), b - 2 * e.sum()
    weight, bias = toxicity.fit(texts, toxic, ratio, rounds=1000)
    assert loss(weight[:40] / ratio[:40], bias) < loss(w, b) + 0.001


def test_bundle_by_definition():
    bundler, text = langid.Bundler(256), "Ab c!dé"
    got_vector = bundler.bundles([text, ""])[0]
    vector = {c: langid.letter_vectors(np.array([ord(c)]), 256)[0].astype(int) for c in " abcdé"}
    line = " ab c dé "
    expected = sum(np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c] for a, b, c in zip(line, line[1:], line[2:]))
    assert np.array_equal(got_vector[0], expected) and not got_vector[1].any()


# ---- 7 near duplicates


def brute_print(text):
    w = re.findall(BLANK, lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """prints: (doc_id, fingerprint); the smallest doc_id of each row's component."""
    left, comp = set(range(len(prints))), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if (prints[i][1] ^ prints[j][1]).bit_count() <= 4}
            left -= near
            todo += near
        ids = [prints[i][0] for i in group if prints[i][0] is not None]
        comp |= dict.fromkeys(group, min(ids) if ids else None)
    return [comp[i] for i in range(len(prints))]


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash(docs, none, table, tile):
    prints = [(r[0], brute_print(r[1])) for r in table]
    expected = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))]
    assert got(simhash.near_duplicates(docs, tile), "doc_id", "fingerprint", "component_id") == want(expected)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, c in expected if i == c} | {None}


@pytest.mark.parametrize("tile, n", [(4096, 300), (8, 300), (16, 10**7), (16, 10**9), (4096, 10**12)])
def test_links_of_a_chain_and_a_crowd(spark, tile, n):
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(150)}
    centre = r.getrandbits(64)
    for _ in range(120):  # a crowd around one value, all pairs near
        prints.add(centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    x = r.getrandbits(64)
    for _ in range(30):  # a chain, each 4 bits on
        prints.add(x)
        for b in r.sample(range(64), 4):
            x ^= 1 << b
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), n, tile)
    roots = {r.node: r.root for r in components.components(found).collect()}
    comp = brute_components(list(enumerate(prints)))
    groups = {}
    for s, c in zip(signed, comp):
        groups.setdefault(c, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5)], "u long, v long")
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert all(roots.get(i, 0) == 0 for i in range(301)) and roots[1001] == 1000
    assert components.components(links.limit(0)).count() == 0


# ---- 8 fingerprints


def test_merkle(docs, none, table):
    out = merkle.fingerprint_report(docs).collect()
    order = sorted((r for r in table), key=lambda r: (r[0] is None, -(r[0] or 0)))
    ids = [r[0] for r in order]
    sole = [i for i in range(len(ids)) if ids.count(ids[i]) == 1 and ids.count(ids[(i + 1) % len(ids)]) == 1]
    by = {r.doc_id: r for r in out}
    assert len(out) == len(table) and len(sole) > 30
    for i in sole:
        text, nxt = order[i][1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        r = by[ids[i]]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited)) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited) == (r.near_edited == 1.0) or set(text) <= set(edited)
    same = {}
    for r in table:
        if ids.count(r[0]) == 1:
            same.setdefault(r[1] or "", set()).add(by[r[0]].fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)
    assert merkle.fingerprint_report(none).count() == 0


def test_merkle_ranges_and_changes(spark):
    rows = spark.createDataFrame([(i * i, f"text {i}. One more.\nline {i % 3}") for i in range(200)], "doc_id long, text string")
    nexts = {r.doc_id: r.next_text for r in merkle.with_next(rows, bytes_each=100).collect()}
    assert all(nexts[i * i] == f"text {(i - 1) % 200}. One more.\nline {(i - 1) % 200 % 3}" for i in range(200))
    marks = spark.createDataFrame([("a. b.\nc\nd",), ("a. b.\nC\nd",)], "t string").select(merkle.rooted(merkle.fingerprint(F.col("t"))).alias("m")).collect()
    pair = spark.createDataFrame([(marks[0].m, marks[1].m)], "a string, b string")
    assert pair.select(merkle.changed_sections(F.col("a"), F.col("b")), merkle.changed_sections(F.col("a"), F.col("a"))).first()[:] == ([1], [])


def test_merkle_tells_texts_of_equal_short_hashes_apart(spark):
    seen, i, short = {}, 0, lambda t: hashlib.md5(t.encode()).hexdigest()[:8]
    while (t := f"Paragraph {i}") not in seen and short(t) not in seen:
        seen[short(t)], i = t, i + 1
    pair = [(1, seen[short(t)]), (2, t)]
    assert pair[0][1] != t
    rows = spark.createDataFrame(pair, "doc_id long, text string")
    whole = merkle.fingerprint_report(rows).orderBy("doc_id").collect()
    assert whole[0].fingerprint[:32] != whole[1].fingerprint[:32] and [r.near_next for r in whole] == [0.0, 0.0]
    cut = merkle.fingerprint_report(rows, digits=8).orderBy("doc_id").collect()
    assert [r.near_next for r in cut] == [0.0, 0.0] and [r.fingerprint[:32] for r in cut] == [r.fingerprint[:32] for r in whole]
    marks = spark.createDataFrame([(whole[0].fingerprint, whole[1].fingerprint)], "a string, b string")
    assert marks.select(merkle.changed_sections(F.col("a"), F.col("b"))).first()[0] == [0]


# ---- 9 mixing


@pytest.mark.parametrize("rows_each", [2, 20_000])
def test_mixing(spark, docs, none, table, rows_each):
    quality = spark.createDataFrame([(1, 2.0), (2, 0.5), (2, 0.1), (None, 3.0)], "doc_id long, weight double")
    out = mixing.mix(docs, quality, rows_each=rows_each)
    again = mixing.mix(docs.repartition(3), quality, rows_each=rows_each)
    assert got(out, *out.columns) == got(again, *out.columns) == got(mixing.mix(docs, quality, rows_each=7), *out.columns)
    rows = out.collect()
    sizes = Counter()
    for r in table:
        sizes[r[3]] += len(re.findall(BLANK, r[1] or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left = {}, dict(sizes)
    budget = 1.5 * sum(sizes.values())
    while left:  # share by weight, settle those above their cap, share the excess again
        level = (budget - sum(target.values())) / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weights[s] for s in left}
        for s in over or list(left):
            del left[s]
    by = {(len(re.findall(BLANK, r[1] or "")), r[0]): r[3] for r in table}
    taken, biggest = Counter(), Counter()
    for r in rows:
        s = by[(r["size"], r.doc_id)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s], abs=1e-5) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1 for s in sizes)
    assert mixing.mix(none, quality).count() == 0
    kept = mixing.take(docs, quality)
    assert kept.columns == [c for c in docs.columns if c != "taken"] + ["size", "source_size", "target", "taken"] and kept.filter("taken <= 0").count() == 0


# ---- 10 lines


def brute_lines(table, least=40, many=5):
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t, *_ in table]
    holders = {}
    for (doc_id, *_), ks in zip(table, keys):
        for k in {k for k in ks if len(k) >= least}:
            holders.setdefault(k, []).append(-(1 << 63) if doc_id is None else doc_id)
    for (doc_id, text, *_), ks in zip(table, keys):
        own = -(1 << 63) if doc_id is None else doc_id
        drop = [k in holders and len(holders[k]) >= many and max(holders[k]) != own for k in ks]
        yield doc_id, len(ks), sum(drop), sha("\n".join(x for x, d in zip((text or "").split("\n"), drop) if not d))


@pytest.mark.parametrize("options", [{}, {"keys_each": 1}, {"broadcast_bytes": 0, "probes_each": 3}])
def test_line_dedup(docs, none, table, options):
    out = linededup.line_report(docs, **options)
    expected = want(brute_lines(table))
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected and any(r[2] for r in expected)
    assert linededup.line_report(none).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_dropped_lines(docs, table, broadcast_bytes):
    kept = linededup.drop_lines(docs, broadcast_bytes=broadcast_bytes)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert want((r.doc_id, sha(r.text or "")) for r in rows) == want((r[0], r[3]) for r in brute_lines(table))
    changed = {r[0] for r in brute_lines(table) if r[2]}
    assert all(r.n_chars == len(r.text) for r in rows if r.doc_id in changed and r.n_chars is not None)


def test_perfect_hash():
    r = np.random.default_rng(2)
    h1, h2 = (r.integers(-(1 << 63), (1 << 63) - 1, 5000) for _ in range(2))
    h1[:50] = h1[0]  # equal halves
    shard = linededup.build_shard(h1, h2, np.arange(5000), np.arange(5000) * 3)
    index = linededup.probe_shard(shard, h1, h2)
    assert sorted(index) == list(range(5000)) and (shard["n"][index] == np.arange(5000)).all() and (shard["last"][index] == np.arange(5000) * 3).all()
    assert (linededup.probe_shard(shard, h1, r.integers(-(1 << 63), (1 << 63) - 1, 5000)) == -1).all()
    assert sum(len(bits) * 64 for bits, _ in shard["levels"]) < 5000 * 6


# ---- helpers


def test_extra_columns_of_any_name(spark):
    """Columns named like those that operators add for themselves, in large or small letters, pass through."""
    names = ["__n", "__HITS", "__items", "__digest", "__own", "__Id", "__drop", "__lang", "__score", "__class", "Size", "TAKEN", "__of"]
    rows = spark.createDataFrame([(i, passage(300 + i, 40), "en", "s", *[f"{n}{i}" for n in names]) for i in range(6)], ["doc_id", "text", "lang", "source", *names])
    items = spark.createDataFrame([(1, passage(301, 12)), (2, passage(9, 12))], "item_id long, text string")
    own = {i: tuple(f"{n}{i}" for n in names) for i in range(6)}
    same = lambda df: {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}
    assert same(langid.keep_known(rows)) == own
    for size in (64 << 20, 0):
        assert same(linededup.drop_lines(rows, broadcast_bytes=size)) == own
    for size in (8 << 20, 10):
        assert same(decontaminate.drop_contaminated(rows, items, block_bytes=size)) == {i: x for i, x in own.items() if i != 1}
    kept = mixing.take(rows)
    assert [c for c in kept.columns if c.lower() in ("size", "taken")] == ["size", "taken"] and kept.filter("__n IS NULL").count() == 0
    for report in (pii.pii_report, merkle.fingerprint_report, simhash.near_duplicates, substring_bwt.removal_report, substring_sam.removal_report):
        assert report(rows).count() == 6


def test_word_spans_do_not_cross_texts():
    data, off = np.frombuffer(b"ab cd" + b"ef" + b"" + b" g", np.uint8), np.array([0, 5, 7, 7, 9])
    starts, ends, first = common.word_spans(data, off, common.BLANK_WORDS)
    assert [(a, b) for a, b in zip(starts, ends)] == [(0, 2), (3, 5), (5, 7), (8, 9)] and first.tolist() == [0, 2, 3, 3, 4]
