"""Each operator against a plain version on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import golay
from fleetlens.llm.common import bucket5
from fleetlens.llm.decontam import drop_contaminated, find_contamination
from fleetlens.llm.exact_dedup import exact_duplicates, golomb_decode, golomb_encode
from fleetlens.llm.hmm_lm import Settings as LmSettings
from fleetlens.llm.hmm_lm import score_documents
from fleetlens.llm.line_dedup import dedup_lines
from fleetlens.llm.mixing import flight, land, mix
from fleetlens.llm.quality import keep_good, kth_largest, rate_quality
from fleetlens.llm.simhash import components, fingerprint, keep_one, near_duplicates
from fleetlens.llm.toxicity import score_toxicity
from fleetlens.llm.url_filter import host_rule, judge_urls, pattern_rule

SPACE = " \t\n\r\x0b\x0c"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, source string, n bigint, kept string"


def words(text):
    return [w.decode() for w in (text or "").translate(FOLD).encode().split()]


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = ["", None, " \t ", "One two", "one TWO", "É one", "é one", "a b c", line(5000)]
    common = "This line is shared by several documents."
    for _ in range(40):
        body = [line(rng.randint(3, 30)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.4:
            body.insert(rng.randrange(len(body) + 1), rng.choice([common, f"  {common.upper()}\r", "short"]))
        out.append("\n".join(body))
    out += [out[-1], out[-1].upper(), out[-2] + " extra", out[8] + " w1", out[8].replace("w2 ", "w3 ", 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i * 3 % 101, t, [None, "b", "a", "ä"][i % 4], i, "x") for i, t in enumerate(texts())]
    return [*found, (None, "null id", "a", 1, None), (None, "Null ID", None, 1, None), (7000, "twin", "a", 1, ""), (7000, "twin", "a", 2, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3, "n").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, k in ((0, 3), (1, 0), (1000, 5), (777, 20)):
        values = np.unique(rng.integers(0, 1 << 30, n).astype(np.uint64))
        if k == 0:
            values = values % np.uint64(50)
        assert (golomb_decode(len(values), k, *golomb_encode(values, k)) == values).all()


def test_exact_duplicates(docs, rows, empty):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    got = exact_duplicates(docs, stable=False).collect()
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)  # one row a group, also where a row is repeated
    assert exact_duplicates(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(FOLD)
            if len(key) >= 20:
                held.setdefault(key, set()).add(i)
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keys = [line.strip(SPACE).translate(FOLD) for line in lines]
        stay = [a for a, k in zip(lines, keys, strict=True) if not (len(held.get(k, ())) >= 3 and i != max(held[k], key=lambda x: (x is not None, x)))]
        want.append((str(i), "\n".join(stay), len(lines), len(lines) - len(stay)))
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted(want)
    assert any(w[3] for w in want)
    assert dedup_lines(empty).count() == 0


def test_decontamination(spark, docs, rows, empty):
    import re

    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))
    long = [t for _, t, *_ in rows if t and len(t) > 300]
    items = [(1, " ".join(long[0].split()[5:25])), (2, long[1][10:130]), (2, long[1][10:130]), (3, "One, TWO!"), (4, ""), (5, None), (None, "é... one"), (10, "twin")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).update([] if i is None else [str(i)])
    want = []
    for i, t, *_ in rows:
        w, hit, found = cut(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if (x := tuple(w[k : k + n])) in windows and len(x) == n:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        want.append((str(i), len(w), len(hit), sorted(found)))
    got = find_contamination(docs, benchmark).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    by_text = {r[1]: r for r in rows}
    spans = {r.doc_id: r.spans for r in got if r.spans}
    for i, t, *_ in by_text.values():
        for s in spans.get(i, []):
            if t and len(t) > s.end:
                assert cut(t[s.start : s.end])
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, benchmark).collect()) == sorted(w[0] for w in want if not w[2])
    assert find_contamination(empty, benchmark).count() == 0
    assert {r.n_hit for r in find_contamination(docs, benchmark.limit(0)).collect()} == {0}


URLS = [None, "", "no scheme", "http://a.org", "https://A.ORG/x", "http://example.org/es/1", "http://sub.example.org/en/123?q=/es/", "http://example.org/en/2", "ftp://x.com/fr/", "http://x.com/FR/", "http://com/de/#a",
        "http://notorg/x", "http://a.org:80/x", "http://ads.example.net/ads/1", "http://b.net/a/ads", "http://spam-farm.example.com/en", "http://b.net/x\ny/track/z", "://", "http://u@x.org/", "http://b.net/Casino/", "http://öorg/x", "http://b.net/" + "long/" * 2000]


def test_url_filter(spark):
    rules = (host_rule("allow", "org"), host_rule("block", "example.org", "/es/"), host_rule("block", "example.org", "/en/1"), host_rule("allow", "com", "/fr/"), host_rule("block", "com", "/de/"))
    patterns = (pattern_rule("block", "/ads/"), pattern_rule("block", "/track/"), pattern_rule("block", "/casino/"), pattern_rule("block", "/spam-farm."), pattern_rule("allow", "/a/*s"))
    plain = {"org/": ("org", "/", "allow"), "example.org/es/": ("example.org", "/es/", "block"), "example.org/en/1": ("example.org", "/en/1", "block"), "com/fr/": ("com", "/fr/", "allow"), "com/de/": ("com", "/de/", "block")}
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(0, URLS[4], "h", "p")], "page_id int, url string, host string, rule string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(FOLD), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [n for n, (h, p, _) in plain.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits, key=len), plain[max(fits, key=len)][2]
        text = ("/" + host + path).translate(FOLD)
        hits = [(len(p), -i) for i, p in enumerate(("/ads/", "/track/", "/casino/", "/spam-farm.")) if p in text]
        if "/a/" in text and "s" in text[text.index("/a/") + 3 :]:
            hits.append((5, -4))
        return host, path, None, "allow" if not hits or max(hits)[1] == -4 else "block"

    for inline in (500, 0):
        got = judge_urls(pages, rules, patterns, inline=inline).collect()
        assert len(got) == len(URLS) + 1
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == judge(r.url), (r.url, inline)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, (), ()).collect()} == {"allow"}


def test_golay_code():
    every = np.arange(1 << 12) << 11
    codewords = every ^ np.array([golay._remainder(int(x)) for x in every])
    assert (golay.decode(codewords) == np.arange(1 << 12)).all()
    rng = np.random.default_rng(2)
    for w in codewords[rng.integers(0, 4096, 300)].tolist():
        flips = rng.permutation(23)[:3]
        assert golay.decode(np.array([w ^ sum(1 << int(f) for f in flips)]))[0] == w >> 11
    x = rng.integers(0, 1 << 23, 500)
    keys, there = golay.near(x)
    for i, v in enumerate(x.tolist()):
        mine = set(keys[i][there[i]].tolist())
        assert len(mine) in (1, 6)
        for b in range(23):
            assert int(golay.decode(np.array([v ^ (1 << b)]))[0]) in mine


def simhash(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_is_exact(spark, docs, rows, empty):
    prints = [simhash(t) for _, t, *_ in rows]
    for (_, t, *_), p in zip(rows, prints, strict=True):
        assert fingerprint((t or "").encode()).hex() == f"{p:016x}"
    at = grouped(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for i, (d, *_) in enumerate(rows):
        least.setdefault(at[i], []).append(d)
    want = sorted((str(r[0]), f"{p:016x}", str(min((x for x in least[at[i]] if x is not None), default=None))) for i, (r, p) in enumerate(zip(rows, prints, strict=True)))
    got = near_duplicates(docs, 3, None).collect()
    assert sorted((str(r.doc_id), r.fp.hex(), str(r.component_id)) for r in got) == want
    assert near_duplicates(empty, 3, None).count() == 0 and near_duplicates(empty).count() == 0


def test_simhash_finds_every_close_pair_and_hot_keys(spark, monkeypatch):
    from fleetlens.llm import simhash as module

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = list(dict.fromkeys(base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(12)]))
    want = grouped(prints, [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3])
    nodes = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fp binary")
    for hot in (4096, 5):
        monkeypatch.setattr(module, "HOT", hot)
        found = {bytes(r.node): bytes(r.root) for r in components(module.find_links(nodes, 1, 3, True)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(found.get(p.to_bytes(8, "big"), p.to_bytes(8, "big")), set()).add(p)
        plain = {}
        for p in prints:
            plain.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_components_of_a_long_chain(spark):
    n = 300
    key = lambda i: f"{i:08d}".encode()
    links = spark.createDataFrame([(key(i), key(i + 1)) for i in range(n) if i != 150], "a binary, b binary")
    found = {bytes(r.node): bytes(r.root) for r in components(links).collect()}
    assert len({found[key(i)] for i in range(151)}) == 1 and len({found[key(i)] for i in range(151, n + 1)}) == 1 and len(set(found.values())) == 2


def linked_ids(spark, texts, **how):
    rows = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), **how).collect()
    return {r.doc_id: r.component_id for r in rows}


def jaccard_components(texts, least=0.8):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(words, texts)]
    return grouped(range(len(texts)), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= least * len(a | b) - 1e-9])


def test_a_link_is_verified_whatever_lies_between(spark, monkeypatch):
    from fleetlens.llm import simhash as module

    rng = random.Random(11)
    texts = []
    for f in range(12):  # families around one text, most pairs near 0.8 and on either side of it
        body = [f"f{f}w{i}" for i in range(300)]
        for _ in range(25):
            own = list(body)
            for at in rng.sample(range(len(own)), rng.randint(3, 9)):
                own[at] = f"x{rng.getrandbits(30)}"
            texts.append(" ".join(own))
    want = jaccard_components(texts)
    nodes = spark.createDataFrame([(i, t, fingerprint(t.encode(), 5, 4, True)) for i, t in enumerate(texts)], "doc_id bigint, text string, fp binary")
    reps = nodes.select("fp", F.struct("doc_id", F.xxhash64("text").alias("t")).alias("rep"))
    prints = [r.fp for r in nodes.orderBy("doc_id").collect()]
    star = spark.createDataFrame([(prints[i - 1], prints[i]) for i in range(len(texts)) if i % 25], "a binary, b binary")  # a forest that has few of the true links
    for block in ((512, 8 << 20), (7, 8 << 20)):
        monkeypatch.setattr(module, "BLOCK", block)
        found = module.similar_links(nodes.select("doc_id", "text"), reps, star, 5, 0.8).collect()
        at = {bytes(p): i for i, p in enumerate(prints)}
        assert grouped(range(len(texts)), [(at[bytes(r.a)], at[bytes(r.b)]) for r in found]) == want


def test_similarity_search_finds_all_that_brute_force_finds(spark, monkeypatch):
    from fleetlens.llm import simhash as module

    rng = random.Random(13)
    texts, word = ["", "a b", "A  b"], lambda: f"x{rng.getrandbits(30)}"
    for _ in range(200):  # four of five shingles
        w = [word() for _ in range(8)]
        texts += [" ".join(w), " ".join([*w, word()])]
    for _ in range(150):  # just at 0.8 or above, and just below
        w, n = [word() for _ in range(rng.randint(40, 120))], 5
        size = len(w) - 4
        cut = size - math.ceil(0.8 * size)
        texts += [" ".join(w), " ".join(w[cut:]), " ".join([word() for _ in range(n)])]
    want = jaccard_components(texts)
    assert len(set(want.values())) < len(texts) - 340
    for hot in (4096, 3):
        monkeypatch.setattr(module, "HOT", hot)
        assert linked_ids(spark, texts) == want


def test_keep_one(docs, rows):
    kept = keep_one(docs, shingle=5, similarity=0.8).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and docs.columns == kept[0].__fields__
    long = [i for i, t, *_ in rows if t and len(t) > 10000]
    assert len(long) == 3 and len(set(long) & set(ids)) == 1


def test_keep_one_decides_by_row(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"}
    rows = [(1, "a"), (None, "a"), (None, "b"), (None, "c"), (None, "c"), (5, "d"), (5, "e"), (6, "d"), (7, "f"), (7, "f"), (7, "a"), (8, "g"), (None, None), (9, None)]
    found = keep_one(spark.createDataFrame([(i, text.get(c)) for i, c in rows], "doc_id bigint, text string").repartition(3), shingle=5, similarity=0.8).collect()
    name = {t: c for c, t in text.items()}
    assert sorted((str(r.doc_id), str(name.get(r.text))) for r in found) == sorted([("1", "a"), ("None", "b"), ("None", "c"), ("5", "d"), ("5", "e"), ("7", "f"), ("8", "g"), ("9", "None")])


def test_flight_keeps_totals():
    rng = random.Random(7)
    sizes = [rng.randint(1, 3000) for _ in range(400)]
    p = [0.37] * 400
    out = flight(sizes, p, rng)
    assert sum(0 < x < 1 for x in out) <= 2
    assert math.isclose(sum(out), sum(p), abs_tol=1e-6) and math.isclose(sum(a * b for a, b in zip(sizes, out, strict=True)), 0.37 * sum(sizes), rel_tol=1e-9)
    assert land([5, 5], [0.0, 1.0], rng) == [0.0, 1.0]
    means = np.mean([flight([1, 2, 3, 4, 5, 6], [0.5] * 6, random.Random(s)) for s in range(3000)], axis=0)
    assert np.abs(means - 0.5).max() < 0.04  # every document keeps its probability


def test_mix(spark, docs, rows, empty):
    got = mix(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(words(t))) for i, t, *_ in rows)
    total = Counter()
    for _, t, s, *_ in rows:
        total[s] += len(words(t))
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * total[s]]
        if not above:
            break
        for s in above:
            target[s] = 2 * total[s]
            left -= target[s]
            free.remove(s)
    target |= share
    taken = Counter()
    for r in got:
        assert r.source_size == total[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - target[s]) <= max(0.1 * target[s], 60) for s in order)
    again = mix(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.size, r.copies) for r in again) == sorted((str(r.doc_id), r.size, r.copies) for r in got)
    assert mix(empty).count() == 0


def test_mix_in_levels(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int") + 1).alias("text"), F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("source"))
    found = {r.source: r for r in mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()}
    assert found["a"].n + found["b"].n == 4000
    for r in found.values():
        assert abs(r.taken - r.target) <= 40


def labelled(spark, n=240):
    rng = random.Random(11)
    plain, bad, junk = [f"p{i}" for i in range(80)], [f"vile{i}" for i in range(4)], ["%%%", "###", "!!"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        if poor:
            text = [w + rng.choice(junk) for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(n, ""), (n + 1, None)]
    labels += [(None, 1, 1), (5000, 0, 0), (1, None, None), (2, 7, 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), n


def test_toxicity(spark):
    docs, labels, n = labelled(spark)
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels, bucket5("doc_id") != 0).collect()}
    assert len(got) == n + 2 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.9
    changed = labels.withColumn("toxic", F.when(bucket5("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in score_toxicity(docs, changed, bucket5("doc_id") != 0).collect()} == got  # held-out labels change nothing
    assert {r.score for r in score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


def test_toxic_phrases_of_ordinary_words(spark):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(500):
        w = [f"w{rng.randrange(40)}" for _ in range(40)]
        for at in (5, 15, 25):  # the same words in both classes, but side by side only in the toxic one
            w[at : at + 4] = ["blue", "moon", "a", "b"] if i % 4 == 0 else ["blue", "a", "moon", "b"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels, bucket5("doc_id") != 0).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95


def test_quality(spark):
    docs, labels, n = labelled(spark)
    got = {r.doc_id: r.kept for r in rate_quality(docs, labels).collect()}
    good = [i for i in range(n) if i % 5]
    assert len(got) == n + 2 and np.mean([got[i] for i in good]) > 0.97 and np.mean([got[i] for i in range(0, n, 5)]) < 0.1
    kept = keep_good(docs.withColumn("kept", F.lit("mine")), labels)
    assert kept.columns == ["doc_id", "text", "kept"] and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in got.items() if k)
    assert all(r.kept for r in rate_quality(docs, labels.limit(0)).collect())
    assert rate_quality(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    values = [1.5, 2.5, 2.5, -7.0, 1e9, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [kth_largest(df, "v", k, bins=4) for k in range(1, 7)] == sorted(values, reverse=True)


def test_language_model(spark, docs, rows, empty):
    got = score_documents(docs, bucket5("doc_id") == 1, LmSettings(states=3, classes=20, listed=40, shares=(0.5, 0.5), least=10, rounds=2)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update([*words(t), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in rows:
        w = [*words(t), "\n"]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        want.append((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_documents(empty, bucket5("doc_id") == 1).count() == 0
    alone = score_documents(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and abs(r.score) < 1e-9 and abs(r.base_score) < 1e-9 for r in alone)


def test_language_model_is_a_distribution():
    """Over all sequences of a length, with the end in its place, probabilities add up; likelihoods match the plain sum over paths."""
    from itertools import product

    from fleetlens.llm.hmm_lm import Model, expected, forward

    rng = np.random.default_rng(4)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((4, 3)), 0))
    total = 0.0
    for s in product(range(4), repeat=3):
        scale = forward(model, np.array(s)[:, None], np.array([1, 1, 1]))[2]
        path = sum(model.start[a] * model.emit[s[0], a] * model.move[a, b] * model.emit[s[1], b] * model.move[b, c] * model.emit[s[2], c] for a, b, c in product(range(3), repeat=3))
        assert math.isclose(scale.prod(), path, rel_tol=1e-9)
        total += path
    assert math.isclose(total, 1.0, rel_tol=1e-9)
    counts = Model(np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3)))
    expected(model, [np.array([0, 1, 2]), np.array([3]), np.array([1, 1])], counts)
    assert math.isclose(counts.start.sum(), 3) and math.isclose(counts.move.sum(), 3) and math.isclose(counts.emit.sum(), 6)
