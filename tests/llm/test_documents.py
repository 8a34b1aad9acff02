import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from utterline.llm import components, lm, ngram_join, pii, quality, rules, substrings
from utterline.llm.common import hot_join


def plain_removal(rows, length=100):
    """[(doc_id, covered bytes)] of distinct (doc_id, text), in order of doc_id, nulls first."""
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        cover = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                cover[p : p + length] = True
            seen.add(data[p : p + length])
        out.append((i, data, cover))
    return out


def _digests(rows):
    out = set()
    for i, data, cover in plain_removal(rows):
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.add((str(i), len(data), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~cover])).hexdigest()))
    return out


def test_substrings_equal_brute_force(docs):
    assert {(str(r[0]), *r[1:]) for r in substrings.digests(docs).collect()} == _digests([(r.doc_id, r.text) for r in docs.collect()])
    taken = docs.withColumn("n_spans", F.lit("x")).withColumn("_spans", F.lit(7))
    kept = substrings.remove_repeats(taken)
    assert kept.columns == [*docs.columns, "_spans", "n_bytes", "n_removed", "n_spans"]
    assert sorted(r._id for r in kept.collect()) == sorted(r._id for r in docs.collect()) and {r._spans for r in kept.collect()} == {7}
    assert substrings.digests(docs.limit(0)).count() == 0


def test_substrings_in_many_surroundings(spark):
    """A line shorter than a repeat between others, so its trigger has a phrase in each document; some of the surroundings repeat."""
    rng = np.random.default_rng(6)
    line, words = "a line that a third of all documents hold, shorter than a repeat is", [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, 12)) + "\n" + line + "\n" + " ".join(rng.choice(words[: 2 + i % 9], 12))) for i in range(150)]
    rows += [(1000 + i, rows[i][1][30:]) for i in range(0, 150, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for most in (substrings.HOT, 3):
        assert {(str(r[0]), *r[1:]) for r in substrings.digests(df, most=most).collect()} == _digests(rows)


def test_suffix_runs_are_those_of_a_sorted_list():
    rng = np.random.default_rng(8)
    for length in (8, 13, 100):
        blobs = [bytes(rng.integers(97, 99, rng.integers(length, length + 40)).astype(np.uint8)) for _ in range(60)]
        blobs += [b[: length + 2] for b in blobs[:20]]
        data, ends = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([len(b) for b in blobs])
        starts = np.concatenate([np.arange(e - len(b), e - length + 1) for b, e in zip(blobs, ends, strict=True)])
        group = np.repeat(np.arange(len(blobs)) % 3, [len(b) - length + 1 for b in blobs])
        rest, run = substrings.suffix_runs(data, starts, group, length)
        named = sorted((g, bytes(data[s : s + length]), k) for k, (g, s) in enumerate(zip(group.tolist(), starts.tolist(), strict=True)))
        sizes = collections.Counter(x[:2] for x in named)
        assert rest.tolist() == [k for g, b, k in named if sizes[g, b] > 1]
        assert np.diff(run, prepend=-1).astype(bool).sum() == sum(n > 1 for n in sizes.values())


def test_ngram_join_equals_brute_force(docs, spark):
    base = [f"w{i}" for i in range(60)]
    near = [(100 + k, " ".join(base[:30] + [f"x{k}"] + base[31:])) for k in range(30)]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    grams = {}
    for i, t in sorted({(r.doc_id, r.text) for r in all_docs.where("doc_id IS NOT NULL").collect()}):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = collections.Counter()
    for a in grams:
        for b in grams:
            if a != b and grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                links[a] += 1
    links[8] += 1  # the repeated row
    for block in (256, 4):
        got = ngram_join.join(all_docs, block=block).collect()
        assert len(got) == all_docs.count()
        for r in got:
            if r.doc_id is not None:
                assert r.n_links == links[r.doc_id], r
        assert {r.class_id for r in got if r.doc_id in (1, 2, 3)} == {1} or not links[3]
    kept = ngram_join.keep_one(docs.withColumn("_row", F.lit(1)).withColumn("first", F.lit(2)))
    assert kept.columns == [*docs.columns, "_row", "first"] and kept.where("doc_id IN (1, 2)").count() == 1 and kept.where("doc_id IN (4, 5, 10)").count() == 3 and kept.where("doc_id IS NULL").count() == 1
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_large_buckets_keep_their_pairs(spark):
    """Classes that share most words but are no links of their hub, beside pairs that are links of each other."""
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(120)]
    rows, groups = [], 40
    for g in range(groups):
        own = list(base)
        for k in rng.choice(120, 3, replace=False):
            own[k] = f"g{g}x{k}"
        rows.append((2 * g, " ".join(own)))
        own[int(rng.integers(120))] = f"g{g}y"
        rows.append((2 * g + 1, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert all((2 * g, 2 * g + 1) in links for g in range(groups)) and len(links) < len(rows) * (len(rows) - 1)
    want = collections.Counter(a for a, _ in links)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_links for r in got.collect()} == dict(want)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 1500)] + [(2499, 5000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(1500)} | {5000: 1000}


def test_hot_keys_join_like_others(spark):
    many = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 7, id) AS k")
    one = many.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = hot_join(many, one, ["k"], "n").select("id", "v").collect()
    assert sorted(map(tuple, got)) == [(i, 14 if i % 3 == 0 else 2 * i) for i in range(3000)]


def test_bands_reach_the_recall():
    b, r = ngram_join.choose_bands(0.8, 0.9995, 160)
    assert 1 - (1 - 0.8**r) ** b >= 0.9995 and b * r <= 160


def test_pseudonyms(spark, docs):
    text = 'mail a.b1@mail.example.com, +1 (509) 555-6973 or (212) 555-0123; 1984-02-29, 31.12.1999; 4111 1111 1111 1111, bad 4111111111111112; 10.0.0.1, 999.1.1.1; 123-45-6789; GB82 WEST 1234 5698 7654 32; token = "ab8ca1b325bc4f85"; v 2.0.'
    p = pii.Pseudonyms(b"k")
    new, kinds = p.replace(text)
    assert p.replace(new, inverse=True)[0] == text and sum(kinds.values()) == 10
    assert "4111111111111112" in new and "999.1.1.1" in new and "2.0" in new and "a.b1@mail" not in new
    digits = re.sub(r"\D", "", re.search(r"(?<=; )\d{4} \d{4} \d{4} \d{4}", new)[0])
    assert pii.luhn(digits[:-1]) == int(digits[-1]) and digits[0] == "4"
    taken = docs.withColumn("n_pii", F.lit(9)).withColumn("pii_kinds", F.lit("k"))
    out = pii.pseudonymize(taken, b"k").collect()
    assert len(out) == docs.count() and all(r.n_pii == 0 and r.pii_kinds == {} for r in out) and any(r.text is None for r in out)
    plain = pii.pseudonymize(taken, b"k", counts=False)
    assert plain.columns == taken.columns and {(r.n_pii, r.pii_kinds) for r in plain.collect()} == {(9, "k")}
    assert pii.pseudonymize(docs.limit(0), b"k").count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymize(docs, b"")


def test_permutations_of_small_domains_are_one_to_one():
    f, p = pii.Feistel(b"key"), pii.Pseudonyms(b"k")
    for size in (1, 2, 7, 97, 1000):
        assert sorted(f.permute(x, size, b"t") for x in range(size)) == list(range(size))
    odd = lambda d: int(d) % 2
    out = [p.number("n", f"{x:03}", like=odd) for x in range(1000)]
    assert sorted(out) == [f"{x:03}" for x in range(1000)] and all(odd(o) == x % 2 for x, o in enumerate(out))
    assert [int(p.number("n", o, True, odd)) for o in out] == list(range(1000))


def test_pseudonyms_keep_to_their_plans():
    rng, p = np.random.default_rng(9), pii.Pseudonyms(b"k")
    for _ in range(1500):
        area, exchange, line = rng.integers(200, 1000), rng.integers(200, 1000), rng.integers(0, 10000)
        for shape in (f"({area}) {exchange}-{line:04}", f"+1 {area}-{exchange}-{line:04}", f"{area}.{exchange}.{line:04}"):
            new = p.replace(shape)[0]
            own = re.sub(r"\D", "", new)[-10:]
            assert own[0] > "1" and own[3] > "1" and new != shape and p.replace(new, True)[0] == shape
    texts = "call +44 20 7946 0958 or +49 (30) 901820; ssn ١٢٣-٤٥-٦٧٨٩"
    new = p.replace(texts)[0]
    assert new.endswith("ssn ١٢٣-٤٥-٦٧٨٩") and new.startswith("call +44 ") and p.replace(new, True)[0] == texts


def test_secrets_and_long_addresses_go_whole():
    p = pii.Pseudonyms(b"k")
    for text, value in (("password = hunterhunter", "hunterhunter"), ("passwd: 12345678901", "12345678901"), ("api_key='abcdefghijkl'", "abcdefghijkl"), ("x" * 90 + "@mail.example.org", "x" * 90)):
        new, kinds = p.replace(text)
        assert sum(kinds.values()) == 1 and value[:12] not in new and p.replace(new, True)[0] == text
    for text in ("The secret: everything is clean here", "auth: required for all"):
        assert p.replace(text) == (text, {})


def test_quality_learns_and_handles_nothing_to_learn(spark, docs):
    rows = [(i, ("alpha beta gamma delta. " if i % 3 else "alpha$$$ beta%%% gamma### ") * (3 + i % 5)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(df, labels, training=~quality.held_out())
    got = quality.score(df, model).where(quality.held_out()).collect()
    assert got and all((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in got)
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    kept = quality.keep_good(docs.withColumn("_score", F.lit(2)), none)
    assert kept.columns == [*docs.columns, "_score"] and kept.count() == docs.count() and {r.score for r in kept.collect()} == {1.0}


def _tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [x for x in re.split("[ \t-\r]+", t) if x] + ["\0"]


def _trained(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def _level_count(n):
    """A count as the filter gives it back."""
    return float(lm.level_counts(lm.levels(np.array([n])))[0]) if n else 0.0


def plain_scores(rows, trained):
    """{text: (tokens, known, base score, score)} of a model with exact, quantised counts."""
    one, two, three = (collections.Counter() for _ in range(3))
    for t in trained:
        k = _tokens(t)
        one.update([*k, "start"])
        two.update(zip(["start", *k], k, strict=False))
        three.update(zip(["start", *k], k, k[1:], strict=False))
    n, v = sum(one.values()) - one["start"], len(one) - (one["start"] > 0)
    out = {}
    for t in rows:
        k, total = _tokens(t), 0.0
        for i, w in enumerate(k):
            before = k[i - 1] if i else "start"
            c = lambda a, *b: _level_count(a[b if len(b) > 1 else b[0]])
            pair = min(c(two, before, w), c(one, before), c(one, w))
            p = (pair + lm.PAIR * (c(one, w) + 1) / (n + v + 1)) / (c(one, before) + lm.PAIR)
            if i:
                first = k[i - 2] if i > 1 else "start"
                context = min(c(two, first, before), c(one, first), c(one, before))
                p = (min(c(three, first, before, w), context, pair) + lm.TRIPLE * p) / (context + lm.TRIPLE)
            total += math.log10(min(p, 1))
        known = {w: one[w] for w in k}
        out[t] = (len(k), sum(one[w] > 0 for w in k), n, sum(math.log10((known[w] + 1) / (n + v + 1)) for w in k), total)
    return out


def test_language_model_equals_plain_counts(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_scores([t for _, t in rows], [t for i, t in rows if _trained(i)])
    for head, broadcast in ((50, lm.BROADCAST), (1 << 17, lm.BROADCAST), (50, 0)):
        model, table = lm.fit(docs, ~lm.held_out(), head=head, hashes=30, broadcast=broadcast)
        assert (model.bloom.name is None) == (broadcast == 0) and len(model.head) <= head
        got = lm.score(docs, model, table).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 4)) for r in got) == sorted((str(i), not _trained(i), *want[t][:3], round(want[t][3], 5), round(want[t][4], 4)) for i, t in rows)
    assert lm.score(docs.limit(0), *lm.fit(docs.limit(0), ~lm.held_out())).count() == 0
    none = lm.score(docs, *lm.fit(docs, F.lit(False))).collect()
    assert {(r.n_known, r.train_tokens) for r in none} == {(0, 0)} and all(r.score == 0 for r in none)


def test_the_model_beats_the_base(spark):
    """On held-out texts of the sample table."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.score(d, *lm.fit(d, ~lm.held_out())).where("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("own"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).first()
    assert held.own > held.base + 0.4


def test_filter_never_loses_a_key(spark):
    rows = [(i, " ".join([f"w{i}"] * (1 + i % 40))) for i in range(3000)]
    f = lm.build_filter(spark.createDataFrame(rows, "doc_id long, text string"))
    h = np.array([lm.tokens(pa.array([t]))[0][0] for _, t in rows])
    level, want = f.level(h), lm.levels(np.array([1 + i % 40 for i in range(3000)]))
    assert (level >= want).all() and (level == want).mean() > 0.93
    assert (f.level(h + np.uint64(12345)) > 0).mean() < 0.05


def test_words_are_hashed_alike_wherever_they_stand():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "Bc", "ü漢", "x" * 40, "\n", "\x1c"], rng.integers(0, 30))) for _ in range(80)] + [None, "", " \t", "AB ab"]
    flat, size = lm.tokens(pa.array(["skipped", *texts])[1:])
    words = [_tokens(t) for t in texts]
    assert size.tolist() == [len(w) for w in words]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip([w for own in words for w in own], flat.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    before = lm.CHUNK
    for lm.CHUNK in (7, 64):
        lm._TABLES.clear()
        assert (lm.tokens(pa.array(texts))[0] == flat).all()
    lm.CHUNK = before
    lm._TABLES.clear()


def test_rule_measures_and_learning(spark, docs):
    want = []
    for r in docs.collect():
        t = r.text or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        c, cover = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if c[tuple(w[i : i + 5])] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
        want.append((str(r.doc_id), len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)))
    assert sorted((str(r[0]), *r[1:6]) for r in rules.measures(docs).collect()) == sorted(want) and rules.measures(docs.limit(0)).count() == 0
    rows = [(i, f"w{i} some words here that go on and on for a while now " + ("$$$ %%% &&& ###" if i % 4 == 0 else "and end")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    measured = rules.measures(spark.createDataFrame(rows, "doc_id long, text string"))
    learned = rules.learn(measured, labels)
    assert learned and all(r["k"] == (r.doc_id % 4 > 0) for r in measured.select("doc_id", rules.verdict(learned).alias("k")).collect())
    assert rules.learn(measured, labels.limit(0)) == []


def test_segments_grow_with_the_text(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    sizes = [len(lm.build_filter(spark.range(n).select(F.lit(text).alias("text"))).ends) for n in (10, 2000)]
    assert sizes[0] == 1 and sizes[1] == -(-2000 * len(text) // lm.SEGMENT_TEXT)


def test_rules_equal_plain_covering(spark):
    """A grid of cells in which the best first rule can be found by looking at all of them."""
    rng = np.random.default_rng(10)
    names, cuts = list(rules.SHARES), {s: [0.1, 0.2] if k < 2 else [] for k, s in enumerate(rules.SHARES)}
    cells = [(a, b, *[0] * (len(names) - 2)) for a in range(3) for b in range(3)] * 2
    prune = [False] * 9 + [True] * 9
    counts = [(40, 1) if c[0] == 2 and c[1] >= 1 else (int(rng.integers(0, 2)), 50) for c in cells]
    found = rules.cover(cells, counts, prune, cuts, 12, 0.8)
    tests = [(s, up, k) for s in (0, 1) for k in (0, 1) for up in (True, False)]

    def gain(inside, test):
        now = [c for c in inside if (c[0][test[0]] > test[2]) == test[1]]
        p, n = (sum(c[1][k] for c in inside) for k in (0, 1))
        q, m = (sum(c[1][k] for c in now) for k in (0, 1))
        return q * (math.log2(q / (q + m)) - math.log2(p / (p + n))) if q else 0.0

    grown = [(c, n) for c, n, late in zip(cells, counts, prune, strict=True) if not late]
    best = max(tests, key=lambda t: gain(grown, t))
    assert str(found[0].conditions[0]) == str(rules.Condition(names[best[0]], best[1], cuts[names[best[0]]][best[2]]))
    assert {(c.share, c.at_least, c.threshold) for c in found[0].conditions} == {(names[0], True, 0.2), (names[1], True, 0.1)} and (found[0].bad, found[0].good) == (80, 2)


def test_pseudonyms_of_whole_secrets():
    rng, p = np.random.default_rng(5), pii.Pseudonyms(b"k")
    text = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    for value in ("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0." + text(43), "SG." + text(22) + "." + text(43), text(230), text(400), text(5000) + "=="):
        new, kinds = p.replace(f"token = {value}. And more")
        own = new.removeprefix("token = ").removesuffix(". And more")
        assert kinds == {"secret": 1} and len(own) == len(value) and p.replace(new, inverse=True)[0] == f"token = {value}. And more"
        assert all(a != b for a, b in zip(re.findall(r"\w{8,}", value), re.findall(r"\w{8,}", own), strict=True))
        assert all(own[i : i + 12] != value[i : i + 12] for i in range(len(value) - 12))
    f = pii.Feistel(b"key")
    for size in (1 << 1030, 1 << 3000):
        assert f.permute(f.permute(size - 5, size, b"t"), size, b"t", True) == size - 5


def test_keep_one_decides_each_row(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(8, "one two"), (8, "one two"), (3, near), (5, near.replace("w30", "x")), (5, "a text of its own that no other row has"), (6, near), (6, "six more words stand here alone"), (4, None), (4, None), (None, near)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[6], *rows[7:]]))
