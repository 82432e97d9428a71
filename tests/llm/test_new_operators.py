"""Operators 3 and 11 to 13 against brute force."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common, components, langid, linededup, merkle, negatives, packing, periodic, pii, simhash, toxicity

tokenizer = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


# ---- periodic runs


def brute_runs(words, least=24):
    """(start, period, end): every maximal stretch of every period, the smallest period of each."""
    found, n = {}, len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 3 * p):
                found.setdefault((start, i + p), p)
    return sorted((a, p, z) for (a, z), p in found.items())


def brute_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def brute_report(doc_id, text):
    words = brute_planted(doc_id, [w.decode() for w in (text or "").encode().split()])
    runs = brute_runs(words)
    dropped = {i for a, p, z in runs for i in range(a + p, z)}
    best = min(((-Fraction(z - a, p), a, p, z) for a, p, z in runs), default=None)
    first = (best[1], best[3] - best[1], best[2], 1000 * (best[3] - best[1]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{z - a},{p}\n" for a, p, z in runs)
    return (doc_id, len(runs), *first, sha256(listed.encode()).hexdigest(), sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(400):
        words = []
        for _ in range(r.randint(0, 40)):
            words += [r.choice("ab") for _ in range(r.randint(1, 9))] * r.choice([1, 1, 2, 3, 4, 12])
        start, end, period = periodic.find(np.array([ord(w) for w in words], np.int64))
        assert sorted(zip(start.tolist(), period.tolist(), end.tolist())) == brute_runs(words)


def test_run_grid_in_slices(monkeypatch):
    words = np.tile(np.arange(7), 40)
    whole = periodic.find(words)
    monkeypatch.setattr(periodic, "PAIRS", 5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, periodic.find(words))) and whole[2].tolist() == [7]


def test_a_hash_that_is_wrong_is_noticed(monkeypatch):
    made = []

    class FirstBlind(periodic.RollingHash):
        def __init__(self, symbols):
            super().__init__(symbols)
            made.append(self)

        def spans(self, starts, ends):
            return np.zeros(len(starts), np.uint64) if self is made[0] else super().spans(starts, ends)

    monkeypatch.setattr(periodic, "RollingHash", FirstBlind)
    words = np.array([1, 2] * 20 + list(range(10, 40)), np.int64)
    assert [x.tolist() for x in periodic.find(words)] == [[0], [40], [2]] and len(made) == 2


def test_run_report(docs, table, none):
    few = docs.filter("text IS NULL OR length(text) < 20000")
    got = sorted(map(tuple, periodic.run_report(periodic.planted(few)).collect()), key=repr)
    want = sorted((brute_report(r[0], r[1]) for r in table if r[1] is None or len(r[1]) < 20000), key=repr)
    assert got == want
    assert periodic.run_report(periodic.planted(none)).count() == 0


def test_collapse_and_runs(spark, docs):
    text = "x " + "a b c " * 12 + "y"
    own = spark.createDataFrame([(1, text, "k"), (2, "no runs \n here", "k"), (3, None, "k"), (1, text, "k")], "doc_id long, text string, start string")
    got = {(r["doc_id"], r["text"], r["start"]) for r in periodic.collapse(own).collect()}
    assert got == {(1, "x a b c y", "k"), (2, "no runs \n here", "k"), (3, None, "k")}
    assert sorted(map(tuple, periodic.find_runs(own).collect())) == [(1, 1, 36, 3), (1, 1, 36, 3)]
    assert periodic.collapse(docs).columns == docs.columns


def test_very_long_text_of_one_word(spark):
    text = "word " * 500_000
    own = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periodic.run_report(own).first()
    assert (row["n_runs"], row["length"], row["period"]) == (1, 500_000, 1) and row["collapsed_sha256"] == sha256(b"word").hexdigest()


# ---- packing


def brute_ids(text):
    from tokenizers import Tokenizer

    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(tokenizer)
    return [*_tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["a  b", "<|endoftext|> x<|endoftext|>y <|endoftext|>", "it's  don't 'S\n\n x", "日本 語 x é", "😀 😀 a", "a\x1cb \x1c c", " lead", "trail ", "1 2 a1 're '", "x　y   z", "\t\x0b\x0c\r\n", "ﬁ ǅ á b"]


def test_ids_are_the_tokenizer_s(monkeypatch):
    with open(tokenizer, encoding="utf-8") as f:
        tokens = packing.Tokens(f.read())
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("ab é,.'’ \n日1<|") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for stretch, kept in ((1 << 20, 1 << 19), (7, 40)):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        monkeypatch.setattr(packing, "KEPT", kept)
        for t in texts:
            assert tokens.ids(t) + b"\2\0\0\0" == np.array(brute_ids(t), "<u4").tobytes(), t


def check_packing(rows, table):
    """Every text's pieces come back, in sequences without gaps."""
    want, seen = [], {}
    for r in table:
        ids = brute_ids(r[1])
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in seen.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(seen)


def test_pack_report(docs, table, none):
    rows = packing.pack_report(docs, tokenizer).collect()
    n = check_packing(rows, table)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack_report(none, tokenizer).count() == 0


def test_batches_islands_and_rounds(spark):
    r = random.Random(1)
    lengths = [r.choice([r.randint(1, 99), r.randint(200, 700)]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long").repartition(3)
    rows = packing.pack(items, 1000, batch=150, islands=3, epochs=2, generations=15).collect()
    fill, ends = {}, {}
    for x in rows:
        fill[x["sequence_id"]] = fill.get(x["sequence_id"], 0) + lengths[x["uid"]]
        ends[x["sequence_id"]] = max(ends.get(x["sequence_id"], 0), x["offset"] + lengths[x["uid"]])
    assert sorted(x["uid"] for x in rows) == list(range(3000)) and fill == ends and max(fill.values()) <= 1000
    bound = packing.lower_bound(np.array(lengths), 1000)
    assert bound <= len(fill) <= bound * 1.01 + 1


def least_sequences(lengths, capacity):
    """By trying all packings."""
    best = len(lengths)

    def go(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(lengths):
            best = len(fill)
            return
        for k in range(len(fill)):
            if fill[k] + lengths[i] <= capacity:
                go(i + 1, fill[:k] + [fill[k] + lengths[i]] + fill[k + 1 :])
        go(i + 1, [*fill, lengths[i]])

    go(0, [])
    return best


def test_lower_bound_and_evolution():
    r = random.Random(2)
    for t in range(40):
        lengths = [r.randint(1, 20) for _ in range(9)]
        best = least_sequences(sorted(lengths, reverse=True), 20)
        packed = packing.evolve(np.array(lengths), [packing.first_packing(np.array(lengths), 20)], np.random.default_rng(t), 20)[0]
        assert packing.lower_bound(np.array(lengths), 20) <= best == packed.max() + 1
        assert np.bincount(packed, lengths).max() <= 20
    # best fit decreasing needs three here, two are enough
    hard = np.array([6, 5, 5, 4, 3, 3, 4])
    assert packing.first_packing(hard, 15).max() + 1 >= 2
    assert packing.evolve(hard, [packing.first_packing(hard, 15)], np.random.default_rng(0), 15)[0].max() + 1 == 2


# ---- hard negatives


def brute_negatives(rows, anchor, positives=5, k=3):
    rows = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in rows:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:k]
            out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n=240, width=6):
    r = np.random.default_rng(seed)
    rows = [(i, (np.round(r.normal(size=width) * 4) / 8).tolist(), int(r.integers(0, 3)) if i % 3 else 1) for i in range(n)]
    rows += [(10, rows[3][1], 2), (10, rows[3][1], 2), (None, rows[1][1], 1), (500, None, 1), (501, [None] * width, 1), (502, [float("nan")] * width, 2), (503, [float("inf")] * width, 2), (504, rows[2][1], None), (505, [0.5], 1), (506, [], 2), (507, [0.0] * 9, 0)]
    return rows


NAMES = "vec_id long, embedding array<double>, label int"


def test_hard_negatives(spark, monkeypatch):
    rows = vectors(1)
    own = spark.createDataFrame([(*r, "x", 1) for r in rows], NAMES + ", score string, rank int").repartition(4)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 100
    for size, block in ((1 << 24, 1 << 15), (400, 1 << 15), (1 << 24, 17)):
        monkeypatch.setattr(negatives, "ROWS", block)
        got = negatives.hard_negatives(own, F.col("id") % 10 == 0, block_bytes=size)
        assert sorted(map(tuple, got.collect())) == want
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], NAMES)
    assert negatives.hard_negatives(none, F.col("id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], NAMES)
    assert negatives.hard_negatives(alone, F.col("id") == 0).count() == 0


def test_large_components():
    big = np.array([[2.0**40, 3.0], [-(2.0**40), 1.0], [2.0**20, 2.0**20]])
    assert negatives.inner(big, big).tolist() == [[negatives.LIMIT, -negatives.LIMIT, (1 << 60) + 3 * (1 << 20)], [-negatives.LIMIT, negatives.LIMIT, -(1 << 60) + (1 << 20)], [(1 << 60) + 3 * (1 << 20), -(1 << 60) + (1 << 20), 1 << 41]]
    middle = np.array([[2.0**29, 1.0]])
    assert negatives.inner(middle, middle).tolist() == [[(1 << 58) + 1]]


# ---- toxicity


def brute_features(text):
    """Counts by place: every run of 4, 5 and 6 characters, one by one."""
    text = " " + "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "") + " "
    counts = {}
    for n in (4, 5, 6):
        for i in range(len(text) - n + 1):
            raw = np.frombuffer(text[i : i + n].encode(), np.uint8)
            place = int(common.mix(common.RollingHash(raw).spans(np.array([0]), np.array([len(raw)])) ^ np.uint64(n))[0] >> np.uint64(44))
            counts[place] = counts.get(place, 0) + 1
    return counts


def brute_scores(rows, labels, least, flat):
    """Counts, ratios and scores in dictionaries; the fit itself is tested by its own."""
    toxic_ids = {}
    for i, y in labels:
        toxic_ids[i] = max(y, toxic_ids.get(i, 0))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    value = lambda n: round(16 * np.log2(1 + n))
    known = [(brute_features(t), toxic_ids[i]) for i, t in rows if i in toxic_ids and not held(i)]
    sums = ({}, {})
    for features, y in known:
        for place, n in features.items():
            sums[y][place] = sums[y].get(place, 0) + value(n) / 16
    n_clean, n_toxic = (sum(y == c for _, y in known) for c in (0, 1))
    ratio = {}
    for place in sums[0].keys() | sums[1].keys():
        q, p = (sums[c].get(place, 0) for c in (0, 1))
        r = np.log(((p + 1) / (n_toxic + 2)) / ((q + 1) / (n_clean + 2)))
        if p + q >= least and abs(r) >= flat and r:
            ratio[place] = r
    texts = sorted((np.array(sorted(k for k in f if k in ratio), np.int32).tobytes(), np.array([f[k] for k in sorted(f) if k in ratio], np.int32).tobytes(), y) for f, y in known)
    dense = np.zeros(toxicity.SLOTS)
    dense[list(ratio)] = list(ratio.values())
    weight, bias = toxicity.fit([(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b, _ in texts], np.array([float(y) for *_, y in texts]), dense)
    bias += np.log(n_toxic / n_clean) / 2
    out = {}
    for i, t in rows:
        f = {k: value(n) for k, n in brute_features(t).items() if k in ratio}
        length = np.sqrt(max(sum((ratio[k] * v) ** 2 for k, v in f.items()), 1e-9))
        out[i] = 1 / (1 + np.exp(-(bias + sum(weight[k] * v for k, v in f.items()) / length)))
    return out


@pytest.mark.parametrize("least, flat", [(3.0, 0.5), (0.0, 0.0)])
def test_toxicity_is_brute_force(spark, least, flat):
    r = random.Random(6)
    words = ["nice", "Bad é", "vile\tthing", "tree", "stone", "awful", "plain", "日本"]
    rows = [(i, " ".join(r.choice(words[1:3] + words[5:6] if i % 3 == 0 else words) for _ in range(r.randint(0, 9)))) for i in range(70)]
    rows += [(70, None), (71, "vile " * 700), (72, "tree " * 900)]  # counts far above 255
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(71, 1), (72, 0), (0, 0)]
    got = toxicity.toxicity_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), least=least, flat=flat).collect()
    want = brute_scores(rows, labels, least, flat)
    assert {x["doc_id"]: x["score"] for x in got} == {i: pytest.approx(s, abs=1e-9) for i, s in want.items()}
    assert all(x["predicted"] == int(x["score"] >= 0.5) for x in got)


# ---- personal data: context decides; fingerprints: edits are located; texts of some megabytes


def test_context_decides_over_added_spans(spark):
    iban, ssn = "DE89 3704 0044 0532 0130 00", "123-45-6789"
    texts = {
        f"pay to {iban} today": ("iban", 0.7),
        f"bank account {iban} today": ("iban", 1.0),
        f"serial part {iban} serial part": None,
        f"bank serial {iban}": ("iban", 0.7),
        f"my social security number is {ssn}": ("ssn", 0.7),
        f"number {ssn} here": None,
        f"ssn of part {ssn}": None,
        "ssn 000-45-6789, 123-00-6789, 987-65-4321 and 123-45-0000": None,
        f"ssn {ssn}" + " x" * 60 + f" {ssn}": ("ssn", 0.7),
    }
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in pii.pii_report(own).collect()}
    for i, (text, want) in enumerate(texts.items()):
        kind_and_score = [tuple(s) for s in zip((p.split(":")[0] for p in got[i]["spans"].split(",") if p), map(float, filter(None, got[i]["scores"].split(","))))]
        assert [s for s in kind_and_score if s[0] in ("iban", "ssn")] == ([want] if want else []), text
    assert got[4]["n_ssn"] == 1 and got[0]["n_iban"] == 1 and got[2]["top_score"] is None


def test_edits_are_located(spark):
    lines = [f"Line {i}. It has two sentences." for i in range(9)]
    edited = lines[:3] + ["Line 3. It has other sentences."] + lines[4:8]
    rows = [("\n".join(lines), "\n".join(edited)), ("\n".join(lines), "\n".join(lines)), ("", "a"), ("a\nb", "b\na")]
    marks = spark.createDataFrame(rows, "a string, b string").select(merkle.changed_sections(merkle.rooted(merkle.fingerprint(F.col("a"))), merkle.rooted(merkle.fingerprint(F.col("b")))).alias("c"))
    assert [r["c"] for r in marks.collect()] == [[3, 8], [], [0], [0, 1]]
    docs = spark.createDataFrame([(2, "\n".join(lines)), (1, "zzz"), (0, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_changed"], r["first_changed"], r["last_changed"]) for r in merkle.fingerprint_report(docs).collect()}
    kept = "\n".join(lines)[: -(len("\n".join(lines)) // 2)]
    first = kept.count("\n")
    assert got == {2: (9 - first, first, 8), 1: (1, 0, 0), 0: (0, None, None)}


def test_texts_of_megabytes(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(500)]
    line = lambda: " ".join(r.choice(words) for _ in range(12))
    text = "\n".join(f"{line()} user{i}@mail.example.org." for i in range(30_000))
    assert len(text) > 2_500_000
    docs = spark.createDataFrame([(1, text, "en"), (2, line(), "en"), (3, line(), "fr"), (5, line(), "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    one = lambda out: {x["doc_id"]: x for x in out.collect()}[1]
    assert one(pii.pii_report(docs))["n_email"] == 30_000
    assert (one(merkle.fingerprint_report(docs, 8))["n_chars"], one(linededup.line_report(docs))["n_lines"]) == (len(text), 30_000)
    assert int(one(simhash.near_duplicates(docs))["fingerprint"], 16) == int.from_bytes(simhash.fingerprint(text.encode()), "big")
    assert 0 <= one(toxicity.toxicity_report(docs, marks))["score"] <= 1 and one(langid.language_report(docs))["lang_pred"] in ("en", "fr", "und")
    assert one(periodic.run_report(docs))["n_runs"] == 0


# ---- components with a node that most links share


def test_components_around_a_frequent_node(spark):
    r = random.Random(12)
    pairs = [(0, i) for i in range(1, 700)] + [(i, 5000 + i) for i in range(300)] + [(8000 + i, 8001 + i) for i in range(60)] + [(r.randint(9000, 9400), r.randint(9000, 9400)) for _ in range(250)]
    roots = {x: x for p in pairs for x in p}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        roots[b] = a
    links = spark.createDataFrame(pairs, "u long, v long").repartition(4)
    got = {x["node"]: x["root"] for x in components.components(links).collect()}
    joined = {x for a, b in pairs if a != b for x in (a, b)}
    assert {x: got.get(x, x) for x in joined} == {x: root(x) for x in joined}
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = common.join_hot(both, least, "u", "n").filter("u = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) >= 3 and max(h["count"] for h in held) < 400  # its 699 links stay where they are
