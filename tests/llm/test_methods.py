"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from thermoload.llm import (chat_format, context_tree, language_id, mixture, ngram_join, packing, quality_rules,
                            secret_ledger, warc_bundles)
from thermoload.llm import text_hash
from thermoload.llm.common import read_table
from thermoload.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def words(t):
    return (t or "").encode().lower().split()


# --- word hashes ------------------------------------------------------------------------------

def test_word_hashes_follow_words():
    texts = ["Ab c", "", None, "c\n\tab", " ab", "x" * 5000 + " ab", "é AB "]
    seen = {}
    for b, edges in text_hash.text_chunks(pa.array(texts, pa.string())):
        h, at, starts, ends = text_hash.word_hashes(b, edges)
        for i, t in enumerate(texts):
            ws = words(t)
            assert at[i + 1] - at[i] == len(ws)
            for w, x in zip(ws, h[at[i]:at[i + 1]]):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- n-gram join ------------------------------------------------------------------------------

def brute_sets(texts):
    out = []
    for t in texts:
        ws = words(t)
        out.append({tuple(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set())
    return out


def brute_components(ids, sets):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(ids))}


def edited(ws, n, rng):
    ws = list(ws)
    for _ in range(n):
        k = rng.randrange(len(ws))
        kind = rng.randrange(3)
        if kind == 0:
            ws[k] = f"e{rng.randrange(40)}"
        elif kind == 1:
            del ws[k]
        else:
            ws.insert(k, f"e{rng.randrange(40)}")
    return ws


def test_join_matches_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for size, copies in ((6, 20), (12, 25), (40, 30), (90, 60), (150, 160), (400, 30), (1500, 6)):
        base = [f"b{size}x{i}" for i in range(size)]
        passage = [f"p{i}" for i in range(60)]
        for c in range(copies):
            ws = edited(base, rng.randrange(0, max(2, size // 9)), rng)
            texts.append(" ".join(ws + passage if c % 7 == 3 else ws))
    texts += ["a", "A", "a b", "", "  "]
    ids = list(range(len(texts)))
    want = brute_components(ids, brute_sets(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in ngram_join.components(df).collect()}
    assert got == want and len(set(want.values())) < len(ids)


def test_marked_signatures():
    """Common signatures of a run are marked, two rows of each are repeated as proof, nothing else changes."""
    rng = np.random.default_rng(6)
    sig = rng.choice(np.r_[np.arange(5), np.arange(100, 400)], 600, p=np.r_[np.full(5, 0.1), np.full(300, 0.5 / 300)])
    node, info = np.arange(600) + 7, np.full(600, (3 << 32) + (1 << 8) + 5)
    s, n, i = ngram_join.marked(sig, node, info)
    count = collections.Counter(sig.tolist())
    common = {x for x, k in count.items() if k >= ngram_join.COMMON}
    assert len(common) >= 5 and (s[:600] == sig).all() and (n[:600] == node).all()
    assert all(bool(x & ngram_join.HOT) == (y in common) for x, y in zip(i[:600].tolist(), sig.tolist()))
    assert (i[:600] & (ngram_join.HOT - 1) == info).all()
    proof = collections.Counter(s[600:].tolist())
    assert set(proof) == common and set(proof.values()) == {2} and (i[600:] & ngram_join.PROOF != 0).all()
    assert len(set(zip(s[600:].tolist(), n[600:].tolist()))) == 2 * len(common)


@pytest.mark.parametrize("common,run", [(2, 300), (2, 10 ** 6), (3, 2000)])
def test_marked_signatures_lose_no_link(spark, monkeypatch, common, run):
    """Nearly every shared signature is marked in some runs and not in others; copies of sets in several tasks."""
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "RUN", run)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    rng = random.Random(common * run)
    texts = []
    for size, copies in ((12, 12), (90, 25), (150, 40), (400, 8)):
        base = [f"h{size}x{i}" for i in range(size)]
        passage = [f"q{i}" for i in range(50)]
        for c in range(copies):
            ws = edited(base, rng.randrange(0, max(2, size // 9)), rng)
            texts += [" ".join(ws + passage if c % 5 == 3 else ws)] * (3 if c % 4 == 0 else 1)
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    want = brute_components(ids, brute_sets(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(6)
    assert {r.id: r.component_id for r in ngram_join.components(df).collect()} == want
    assert 4 < len(set(want.values())) < 0.7 * len(ids)


def test_linked_sets_share_a_signature():
    """The pigeonhole, with and without one-deletion neighbourhoods, on random linked pairs."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        drop, add = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        band = max(ngram_join.band_of(len(a)), ngram_join.band_of(len(b)))
        c = max(ngram_join.neighbourhoods_needed(x, band) for x in (a, b))
        for extra in (0, 3):
            sa, _, slack_a = ngram_join.signatures(a, band, max(c, extra) if c < ngram_join.NEVER else c)
            sb, _, _ = ngram_join.signatures(b, band, max(c, extra) if c < ngram_join.NEVER else c)
            assert len(np.intersect1d(sa, sb))


def test_neighbourhoods_make_up_for_empty_segments():
    """A set whose shingles crowd into few segments asks for neighbourhoods; then links are found."""
    rng = np.random.default_rng(4)
    band = ngram_join.band_of(100)
    m = ngram_join.segments(band)
    crowded = np.unique(rng.integers(0, (1 << 64) // m * 28, 100, np.uint64))
    c = ngram_join.neighbourhoods_needed(crowded, band)
    assert c > 0
    other = np.delete(crowded, rng.permutation(len(crowded))[:10])
    sa, whole, _ = ngram_join.signatures(crowded, band, c)
    sb, _, _ = ngram_join.signatures(other, band, c)
    assert len(np.intersect1d(sa, sb)) and (c >= ngram_join.NEVER or not whole.all())


def test_sets_short_of_segments_keep_their_links(spark, monkeypatch):
    """End to end with so few segments that every set of the band depends on neighbourhoods."""
    monkeypatch.setitem(ngram_join._SEGMENTS, (1, ngram_join.THRESHOLD), 30)
    rng = random.Random(11)
    texts = []
    for k in range(8):
        base = [f"n{k}x{i}" for i in range(100)]
        texts += [" ".join(base)] + [" ".join(edited(base, rng.randrange(1, 4), rng)) for _ in range(4)]
    for t in texts:
        s = ngram_join.shingle_set(t)
        c = ngram_join.neighbourhoods_needed(s, 1)
        assert 0 < c < ngram_join.NEVER and ngram_join.signatures(s, 1, c)[2] < 0
    ids = list(range(len(texts)))
    want = brute_components(ids, brute_sets(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    assert {r.id: r.component_id for r in ngram_join.components(df).collect()} == want
    assert len(set(want.values())) < len(ids) / 2


# --- quality rules -------------------------------------------------------------------------------

def test_quality_rules_follow_the_labels(spark):
    docs = read_table(spark, SF2, "documents")
    good = {r.doc_id: r.quality for r in read_table(spark, SF2, "labels").collect()}
    kept = {r.doc_id for r in quality_rules.clean(docs).collect()}
    share = [np.mean([i in kept for i, q in good.items() if q == k]) for k in (0, 1)]
    assert share[0] < 0.1 and share[1] > 0.97
    glued = [r.doc_id for r in docs.collect() if len(re.findall(r"\w[#$%&*]|[#$%&*]\w", r.text or "")) > 0.3 * len(words(r.text)) > 15]
    assert len(glued) > 20 and not kept & set(glued)


def made_up(rng, n, letters="bdgklmoprtuz"):
    """Texts of a made-up language: its own frequent words among random ones."""
    own = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)]
    word = lambda: rng.choice(own) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randrange(3, 10)))
    return [" ".join(word() for _ in range(200)).capitalize() + "." for _ in range(n)]


def test_quality_rules_of_a_further_language(spark):
    """Common words are learned: a language of its own is kept, with a reference or without, and its junk goes."""
    rng = random.Random(9)
    docs = read_table(spark, SF2, "documents").select("doc_id", "text", "lang")
    want = set(range(10_000, 10_050))
    new = [(i, t, "xx") for i, t in zip(want, made_up(rng, 50))]
    junk = [(20_000 + i, " ".join(w.upper() + "!!" for w in t.split()), "xx") for i, t in enumerate(made_up(rng, 9))]
    rare = [(30_000 + i, t, lang) for i, (t, lang) in enumerate(zip(made_up(rng, 6, "абвгдежз"), [None, "yy"] * 3))]
    both = docs.unionByName(spark.createDataFrame(new + junk + rare, docs.schema))
    langs = list(quality_rules.languages(both))
    words_of = quality_rules.common_words(quality_rules.word_counts(both, langs), langs)
    assert sorted(words_of) == ["de", "en", "es", "fr", "xx"] and all(len(x) == quality_rules.WORDS for x in words_of.values())
    kept = {r.doc_id for r in quality_rules.clean(both).collect()}
    assert want <= kept and {r[0] for r in rare} <= kept and not kept & {r[0] for r in junk}
    before = {r.doc_id for r in quality_rules.clean(docs).collect()}
    assert len(before ^ {i for i in kept if i < 10_000}) <= 5


def test_common_words_match_a_count(spark):
    docs = read_table(spark, SF2, "documents")
    count = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        count[r.lang].update(re.findall(r"[^\x20\x09-\x0D]+", r.text.lower()))
    want = {x: [w for w, _ in sorted(c.items(), key=lambda e: (-e[1], e[0].encode()))[:quality_rules.WORDS]] for x, c in count.items()}
    chars = quality_rules.languages(docs)
    assert quality_rules.common_words(quality_rules.word_counts(docs, list(chars)), list(chars)) == want
    assert chars == {x: sum(len(r.text) for r in docs.collect() if r.lang == x) for x in sorted(count)}


# --- mixture -------------------------------------------------------------------------------------

def test_targets():
    t = mixture.targets([100, 10, 1000, 0], [1, 2, 3, 1])
    assert abs(sum(t) - 1110) < 1e-9 and t[1] == 30 and t[3] == 0 and abs(t[2] / t[0] - 3) < 1e-9 or t[0] == 300


@given(st.integers(1, 3000), st.integers(0, 50))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    assert sorted(mixture.permute(np.arange(n), n, key).tolist()) == list(range(n))


def plain_permute(i, n, key):
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    m64, mask = (1 << 64) - 1, (1 << half) - 1
    keys = [int(k) for k in np.random.SeedSequence(key).generate_state(4, np.uint64)]
    while True:
        left, right = i >> half, i & mask
        for k in keys:
            f = (((right + k) & m64) * 0x9E3779B97F4A7C15) & m64
            f = ((f ^ (f >> 31)) * 0xBF58476D1CE4E5B9) & m64
            left, right = right, left ^ ((f >> 32) & mask)
        i = (left << half) | right
        if i < n:
            return i


def plain_draw(counts, shards, shard, seed):
    """A shard's counts and first indexes, down the tree of halves."""
    low, high, total = 0, shards, sum(counts)
    c, first = list(counts), [0] * len(counts)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng((seed, low, high))
        left = rng.multivariate_hypergeometric(c, total * mid // shards - total * low // shards, method="marginals").tolist()
        if shard < mid:
            c, high = left, mid
        else:
            first = [f + x for f, x in zip(first, left)]
            c, low = [x - y for x, y in zip(c, left)], mid
    return c, first


def test_mixture_replayed(spark):
    """Offsets, draws, permutations and the join of blocks again, slot by slot, give every document's words."""
    docs = read_table(spark, SF2, "documents").select("doc_id", "text", "source")
    extra = [(5000, "one row three times " * 9, "src1")] * 3 + [(5001, None, "src1"), (None, "a b c", None), (5002, "x y", "tiny")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    slots, block = 64, mixture.BLOCK
    placed, _ = mixture.mixture(docs, slots=slots)
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("__id", "__hash"), F.lit(mixture.BUCKETS))).collect()
    streams = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.bucket, r["__id"] is not None, r["__id"] or 0, r["__hash"], r["__offset"])):
        streams[r.number].append(r)
    sizes, target = {}, {}
    for number, stream in streams.items():
        at = 0
        for r in stream:
            assert r["__offset"] == at
            at += r["__size"]
        sizes[number], target[number] = at, stream[0].target
    numbers = sorted(sizes)
    counts = [min(round(target[k] * -(-sizes[k] // block) / sizes[k]), 3 * -(-sizes[k] // block)) if sizes[k] else 0 for k in numbers]
    shards = round(sum(counts) / slots)
    taken, seen, spread = collections.Counter(), collections.Counter(), []
    for shard in range(shards):
        c, first = plain_draw(counts, shards, shard, mixture.SEED)
        spread.append(c)
        for k, n, f in zip(numbers, c, first):
            n_blocks = -(-sizes[k] // block)
            for i in range(f, f + n):
                e, at = i // n_blocks, plain_permute(i % n_blocks, n_blocks, (mixture.SEED * 1009 + k) * 31 + i // n_blocks)
                seen[k, e, at] += 1
                taken[k, at] += 1
    assert max(seen.values()) == 1 and [sum(c) for c in zip(*spread)] == counts and shards > 20
    by_hand = collections.Counter()
    for k, stream in streams.items():
        for r in stream:
            a, z = r["__offset"], r["__offset"] + r["__size"]
            for at in range(a // block, -(-z // block) if z > a else a // block):
                by_hand[r["__id"], k] += taken[k, at] * (min(z, (at + 1) * block) - max(a, at * block))
    got = collections.Counter()
    of_source = {r["__id"]: r.number for r in rows}
    for r in mixture.taken_words(docs, slots=slots).collect():
        got[r["__id"], of_source[r["__id"]]] += r.taken
    assert +got == +by_hand and len(rows) == docs.count()
    # the counts are drawn, not shared out: over the shards they spread as a multinomial does
    p = np.array(counts) / sum(counts)
    z = (np.array(spread) - slots * p) ** 2 / np.maximum(slots * p * (1 - p), 1e-9)
    assert 0.7 < z[:, p > 0.02].mean() < 1.3


def test_huge_splits_keep_their_sums():
    counts = np.array([3 * 10 ** 11, 7, 0, 10 ** 9 + 1, 12345])
    total = int(counts.sum())
    for n in (0, 1, total // 3, total // 2 + 1, total):
        left = mixture.split(counts, n, (1, 2, n % 97))
        assert left.sum() == n and (left >= 0).all() and (left <= counts).all()
    drawn = list(mixture.shard_draws(np.array([900, 100]), 10, 3, 6, 1))
    assert [d[0] for d in drawn] == [3, 4, 5] and all(d[1].sum() == 100 for d in drawn)
    assert (drawn[0][2] + drawn[0][1] == drawn[1][2]).all()


def test_mixture_of_a_hot_row(spark, monkeypatch):
    """A third of the rows are one row: they are expanded in chunks, each gets its own place in the stream."""
    monkeypatch.setattr(mixture, "CHUNK", 50)
    docs = spark.range(0, 1500, 1, 4).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"),
                                             F.when(F.col("id") % 3 == 0, "hot words in a row").otherwise(F.concat(F.lit("other "), "id")).alias("text"),
                                             F.concat(F.lit("s"), (F.col("id") % 3 == 0).cast("int")).alias("source"))
    placed, _ = mixture.mixture(docs)
    hot = sorted(r["__offset"] for r in placed.filter("__id = -1").collect())
    assert hot == [5 * i for i in range(500)]
    got = mixture.mixed_documents(docs).collect()
    assert sum(len(words(r.text)) for r in got) == mixture.taken_words(docs).agg(F.sum("taken")).first()[0]
    assert all(r.text in "hot words in a row" for r in got if r.doc_id == -1)


def test_mixture_against_its_targets(spark):
    docs = read_table(spark, SF2, "documents")
    got = mixture.taken_words(docs).toPandas().set_index("__id").sort_index()
    text = {r.doc_id: r for r in docs.collect()}
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for i, r in got.iterrows():
        assert r["size"] == len(words(text[i].text)) and r.taken <= 3 * r["size"]
        x = by[text[i].source]
        x[0] += r["size"]
        x[1] += r.taken
        x[2] = r.target
    for i, (name, x) in enumerate(sorted(by.items())):
        assert x[0] == got[got.index.map(lambda k: text[k].source == name)].source_size.iloc[0]
        assert abs(x[1] - x[2]) <= 0.03 * x[2]
    want = mixture.targets([by[s][0] for s in sorted(by)], [1 + i % 3 for i in range(len(by))])
    assert np.allclose(want, [by[s][2] for s in sorted(by)])
    again = mixture.taken_words(docs.repartition(7)).toPandas().set_index("__id").sort_index()
    assert again.taken.equals(got.taken)
    mixed = mixture.mixed_documents(docs).toPandas()
    counted = mixed.assign(w=mixed.text.map(lambda t: len(words(t)))).groupby("doc_id").w.sum()
    assert counted.equals(got.taken[got.taken > 0].rename("w").rename_axis("doc_id"))


# --- packing ---------------------------------------------------------------------------------------

@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.sampled_from([(64,), (16, 64), (8, 32, 64)]))
@settings(max_examples=60, deadline=None)
def test_best_fit(sizes, lengths):
    sizes = np.array(sorted(sizes, reverse=True))
    bins, used = packing.best_fit(sizes, lengths)
    assert np.bincount(bins, sizes).astype(int).tolist() == used and max(used) <= max(lengths)
    caps = packing.downsized(used, lengths)
    for u, c in zip(used, caps):
        assert u <= c and not [x for x in lengths if u <= x < c]
    assert len(used) <= 2 * math.ceil(sizes.sum() / min(c for c in lengths if c >= sizes[0])) + 1


def slow_best_fit(sizes, permitted, overhead):
    """The packing rules bin by bin: (bin of each piece, words of each bin, opened lengths)."""
    room, used, bins, opened, touched = [], [], [], [], []
    for i, n in enumerate(sizes):
        fits = [(room[b], -touched[b], b) for b in range(len(room)) if room[b] >= n]
        if fits:
            b = min(fits)[2]  # the least room; of equal ones the bin that got it last
        else:
            costs = []
            for c in permitted:
                if c >= n:
                    to_come = sum(m for m in sizes[i + 1:] if m <= c - n)
                    costs.append(((c + overhead) / (n + min(c - n, to_come)), -c))
            b, best = len(room), -min(costs)[1]  # the least cost; of equal ones the longest
            room.append(best)
            opened.append(best)
            used.append(0)
            touched.append(0)
        room[b] -= n
        used[b] += n
        touched[b] = i
        bins.append(b)
    return bins, used, opened


@given(st.lists(st.integers(1, 40), min_size=1, max_size=80), st.sampled_from([(40,), (41, 64), (48, 64, 100), (40, 80, 120, 160)]),
       st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_best_fit_is_the_slow_one(sizes, permitted, overhead):
    sizes = sorted(sizes, reverse=True)
    bins, used = packing.best_fit(np.array(sizes), permitted, overhead)
    want_bins, want_used, opened = slow_best_fit(sizes, permitted, overhead)
    assert bins.tolist() == want_bins and used == want_used
    assert all(u <= o for u, o in zip(used, opened))


def test_packing_query_packs_whole_texts(spark):
    """The registered query's sequences: every shard again with the slow best fit, every text word for word."""
    text = {r.doc_id: words(r.text) for r in read_table(spark, SF, "documents").collect()}
    left = collections.defaultdict(list)
    shards = collections.defaultdict(list)
    for r in QUERIES["op7_best_fit_packing"](spark, SF).collect():
        assert len(r.doc_ids) == len(r.texts) and r.n_words == sum(len(words(t)) for t in r.texts) <= r.capacity
        assert r.capacity == min(c for c in packing.LENGTHS if c >= r.n_words)
        shards[r.bin_id >> 32].append(sorted((len(words(t)) for t in r.texts), reverse=True))
        for i, t in zip(r.doc_ids, r.texts):
            left[i].append(words(t))
    longest = max(packing.LENGTHS)
    for i, ws in text.items():
        pieces = [ws[k:k + longest] for k in range(0, len(ws), longest)]
        assert sorted(left.pop(i, [])) == sorted(pieces)
    assert not left
    for bins in shards.values():
        sizes = sorted((n for b in bins for n in b), reverse=True)
        want, used, _ = slow_best_fit(sizes, packing.LENGTHS, packing.OVERHEAD)
        again = [[n for n, b in zip(sizes, want) if b == k] for k in range(len(used))]
        assert sorted(bins) == sorted(again)


def test_repeated_rows_are_spread_over_shards(spark):
    """Half of all rows are one row: no shard holds much more than its share, and nothing is lost."""
    df = spark.range(0, 8000, 1, 5).select(F.when(F.col("id") % 2 == 0, -7).otherwise(F.col("id")).alias("doc_id"),
                                           F.when(F.col("id") % 2 == 0, "one and the same text " * 5).otherwise(
                                               F.concat(F.lit("text "), F.col("id"), F.lit(" a b c d e f"))).alias("text"))
    total = 4000 * 25 + 4000 * 8
    got = packing.pack(df, permitted=(128, 512), shard_words=4000).toPandas()
    by_shard = got.groupby(got.bin_id // 2 ** 32).n_words.sum()
    assert got.n_words.sum() == total and len(by_shard) == -(-total // 4000) and by_shard.max() < 1.5 * 4000
    assert (got.doc_id == -7).sum() == 4000


def test_packing_places_each_word_once(spark):
    docs = read_table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = packing.pack(docs, permitted=(128, 512), shard_words=20_000, with_text=True).toPandas()
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        ws = re.findall(r"[^\x20\x09-\x0D]+", text[i])
        assert [w for t in g.text for w in re.findall(r"[^\x20\x09-\x0D]+", t)] == ws
    for _, g in got.groupby("bin_id"):
        assert g.n_words.sum() == g.used.iloc[0] <= g.capacity.iloc[0] and sorted(g.slot) == list(range(len(g)))
    assert got.n_words.sum() == sum(len(words(t)) for t in text.values())


# --- context tree -------------------------------------------------------------------------------------

def brute_tree(streams, depth):
    """Counts of every (context, prefix), and weights by the definition."""
    n = collections.defaultdict(lambda: [0, 0])
    for s in streams:
        s = bytes([10]) * depth + s
        for i in range(depth, len(s)):
            for j in range(8):
                for d in range(depth + 1):
                    n[s[i - d:i], 1 << j | s[i] >> (8 - j)][s[i] >> (7 - j) & 1] += 1

    def log_kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    deeper, share = collections.defaultdict(float), {}
    for (ctx, node), (a, b) in sorted(n.items(), key=lambda x: -len(x[0][0])):
        pe = log_kt(a, b)
        if len(ctx) == depth:
            share[ctx, node], pw = 1.0, pe
        else:
            other = deeper[ctx, node]
            share[ctx, node] = 1 / (1 + math.exp(min(other - pe, 700)))
            pw = np.logaddexp(pe, other) - math.log(2)
        if ctx:
            deeper[ctx[1:], node] += pw
    return n, share


def test_context_tree_matches_brute_force(spark):
    texts = ["the cat sat", "the hat", "a cat a hat a mat", "thé", "", "the the the"]
    train, depth = [0, 1, 2, 3], 2
    streams = [b" ".join(words(t)) + b"\n" for t in texts]
    n, share = brute_tree([streams[i] for i in train], depth)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.id: r for r in context_tree.score(df, F.col("doc_id").isin(train), depth=depth).collect()}
    for i, s in enumerate(streams):
        s, total = bytes([10]) * depth + s, 0.0
        for k in range(depth, len(s)):
            for j in range(8):
                node, bit, p, seen = 1 << j | s[k] >> (8 - j), s[k] >> (7 - j) & 1, 0.5, False
                for d in range(depth, -1, -1):
                    key = (s[k - d:k], node)
                    if key in n:
                        a, b = n[key]
                        w = share[key] if seen else 1.0
                        p, seen = w * (b + .5) / (a + b + 1) + (1 - w) * p, True
                total += math.log10(p if bit else 1 - p)
        assert got[i].score == pytest.approx(total, rel=1e-4) and got[i].bytes == len(streams[i])


def test_context_tree_scores_every_gram(spark, monkeypatch):
    """The scores don't depend on what the broadcast cache has room for."""
    docs = read_table(spark, SF, "documents")
    out = ~context_tree.held_out("doc_id")
    want = {r.id: r.score for r in context_tree.score(docs, out).collect()}
    monkeypatch.setattr(context_tree, "GRAM_SLOTS", 40)
    monkeypatch.setattr(context_tree, "SLOT_BITS", 6)
    got = {r.id: r.score for r in context_tree.score(docs, out).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_context_tree_learns(spark):
    got = QUERIES["op2_context_tree"](spark, SF).toPandas()
    rows = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    count = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            count.update(words(r.text) + [b"\n"])
    total, v = sum(count.values()), len(count)
    got = got.set_index("doc_id")
    for r in rows:
        x, ts = got.loc[r.doc_id], words(r.text) + [b"\n"]
        assert x.base_score == pytest.approx(sum(math.log10((count[t] + .5) / (total + .5 * (v + 1))) for t in ts), rel=1e-9)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(ts), sum(count[t] > 0 for t in ts), total)
    assert got[got.held_out].score.sum() * math.log2(10) > -3 * got[got.held_out].bytes.sum()


def test_frequent_rows_by_bins(spark):
    rng = np.random.default_rng(8)
    n = np.unique(rng.pareto(0.7, 4000).astype(np.int64) * 3, return_inverse=False)
    counts = rng.choice(n, 5000)
    df = spark.createDataFrame([(int(i), int(c), float(i) / 2) for i, c in enumerate(counts)], "key long, n long, v double")
    for most in (0, 40, 700, 4999, 10_000):
        keys, values = context_tree.frequent(df, "n", "v", most)
        assert len(keys) <= most and (values == keys.astype(float) / 2).all()
        got = counts[keys.astype(int)]
        assert (np.diff(got) <= 0).all() and (len(got) == 0 or got.min() > np.delete(counts, keys.astype(int)).max(initial=0))
    bins = df.groupBy(F.floor(F.log2(F.col("n").cast("double")) * context_tree.BINS)).count().count()
    assert bins <= 64 * context_tree.BINS
    assert len(context_tree.frequent(df, "n", "v", 10_000)[0]) == (counts > 0).sum()


def test_the_cache_prefers_frequent_grams(monkeypatch):
    monkeypatch.setattr(context_tree, "SLOT_BITS", 12)
    keys = np.random.default_rng(2).permutation(1 << 20)[:2900].astype(np.uint64)  # in order of falling count
    logs = -np.arange(len(keys), dtype=float)
    cache = context_tree.gram_cache(keys, logs)
    found, hit = context_tree.cached_logs(keys, cache)
    assert (found[hit] == logs[hit]).all() and 0.8 < hit.mean() < 1
    assert hit[:300].all() and hit[:1000].mean() > 0.99 and hit[-700:].mean() < 0.95


# --- language id -----------------------------------------------------------------------------------------

def test_code_matrix():
    for n in (2, 3, 5, 9, 40):
        m = language_id.code_matrix(n)
        apart = (m.shape[1] - m @ m.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2) and (np.abs(m.sum(0)) < n).all()


def plain_grams(text):
    """Buckets of a text's byte bigrams and trigrams, one by one."""
    m = (1 << 32) - 1

    def bucket(h):
        return (((h ^ (h >> 15)) * 0x2C1B3C6D) & m) >> 16
    raw = b" " + re.sub(rb"[\x09-\x0D\x20]+", b" ", text.lower().encode()) + b" "
    out = []
    for i in range(len(raw) - 1):
        two = ((raw[i] * 0x9E3779B1) & m) ^ ((raw[i + 1] * 0x85EBCA77) & m)
        out.append(bucket(two))
        if i + 2 < len(raw):
            three = two ^ ((((raw[i + 2] * 0xC2B2AE3D) & m) * 0x27D4EB2F) & m)
            out.append(bucket((three + 1) & m))
    return out


def test_codeword_decoder_matches_brute_force(spark):
    """Counts, log-odds, error rates, scales and loss-weighted decoding again in plain loops."""
    rng = random.Random(12)
    letters = {"aa": "abcdef gh", "bb": "cdefgh ij", "cc": "efghij kl", "dd": "ghijklm n"}
    rows = [(i, "".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 60))) + "x", x)
            for i, x in enumerate(rng.choice(sorted(letters)) for _ in range(120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, code = sorted(letters), language_id.code_matrix(4)
    counts = {x: collections.Counter(g for _, t, y in rows if y == x for g in plain_grams(t)) for x in langs}
    share = {x: lambda g, c=c: (c[g] + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS) for x, c in counts.items()}

    def log_odds(g, k):
        side = {1: [], -1: []}
        for j, x in enumerate(langs):
            side[int(code[j, k])].append(share[x](g))
        return math.log((sum(side[1]) / len(side[1])) / (sum(side[-1]) / len(side[-1])))
    bits = range(code.shape[1])
    margin = [[sum(log_odds(g, k) for g in plain_grams(t)) / len(plain_grams(t)) for k in bits] for _, t, _ in rows]
    weight, scale = [], []
    for k in bits:
        wrong = sum(m[k] * code[langs.index(x), k] <= 0 for m, (_, _, x) in zip(margin, rows))
        e = (wrong + 1) / (len(rows) + 2)
        weight.append(max(0.05, math.log((1 - e) / e)) if e < 0.5 else 0.05)
        scale.append(max(sum(abs(m[k]) for m in margin) / len(rows) / 2, 1e-6))
    got = {r.id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    unsure = 0
    for (i, _, _), m in zip(rows, margin):
        z = [max(-language_id.CLIP, min(language_id.CLIP, m[k] / scale[k])) for k in bits]
        loss = [sum(weight[k] * math.exp(-z[k] * code[j, k]) for k in bits) / sum(weight) for j in range(4)]
        first, second = sorted(loss)[:2]
        assert got[i].lang_pred == langs[loss.index(first)]
        assert abs(got[i].score - 1 / sum(math.exp(first - x) for x in loss)) < 1e-4
        close = (second - first) / second - language_id.AMBIGUOUS
        assert abs(close) < 1e-3 or got[i].ambiguous == (close <= 0)
        unsure += got[i].ambiguous
    assert 0 < unsure < len(rows)


def test_calibration_sample_of_a_hot_text(spark, monkeypatch):
    """A text in a third of the rows, and a tiny share: copies are chosen one by one, never all or none."""
    rows = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"),
                                               F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t "), "id")).alias("text"))
    monkeypatch.setattr(language_id, "CALIBRATION", 600)
    got = collections.Counter(r.text == "hot text" for r in language_id.calibration_sample(rows, 30_000).collect())
    assert 130 < got[True] < 280 and 300 < got[False] < 500
    assert language_id.calibration_sample(rows, 300).count() == 30_000  # fewer rows than the sample: all of them
    share = language_id.calibration_sample(rows, 10 ** 15)._jdf.queryExecution().optimizedPlan().toString()
    assert "6.0E-13" in share  # above zero at any size


def test_held_out_languages(spark):
    got = QUERIES["op4_language_codes"](spark, SF2).toPandas()
    lang = {r.doc_id: r.lang for r in read_table(spark, SF2, "documents").collect()}
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.98 and got.score.between(0, 1).all()


# --- secrets ------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


PIECE = st.sampled_from(["token", "Secret", "api_key", "APIKEY", "paſſword", "PASSWORD", "=", ": ", "'", '"', "abcdefgh", "x1",
                         "AKIA", "ABCDEFGHIJKL", "AKIAQ", "0123456789abcdef", "deadbeef", " ", "\n", "é", "🎉", "K"])


@given(st.lists(PIECE, max_size=14))
@settings(max_examples=300, deadline=None)
def test_spans_match_brute_force(parts):
    text = "".join(parts)
    got = [x for x in secret_ledger.find(text, secret_ledger.RULES) if x[0] in ("assign", "access", "hex")]
    assert got == brute_spans(text)


def test_ledger_scans_only_what_is_new(spark, tmp_dir):
    path, rules = f"{tmp_dir}/ledger", secret_ledger.RULES[:2]
    one = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "token=abcdefgh1"), (3, None)], "doc_id int, text string")
    two = one.unionByName(spark.createDataFrame([(4, "secret: zzzzzzzz9")], "doc_id int, text string"))
    secret_ledger.update(one, path, rules=rules)
    assert spark.read.parquet(path).count() == 2
    secret_ledger.update(one, path, rules=rules)
    assert spark.read.parquet(path).count() == 2
    secret_ledger.update(two, path, rules=rules)
    assert spark.read.parquet(path).count() == 3
    newer = (secret_ledger.Rule("assign", 2, rb"(tok)(en)", (b"tok",)), rules[1])
    secret_ledger.update(two, path, rules=newer)
    rows = [r.scanned for r in spark.read.parquet(path).collect()]
    assert sorted(map(tuple, rows)) == [("assign@1", "access@1")[:2]] * 3 + [("assign@2",)] * 3
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_ledger.report(two, path, rules=newer).collect()}
    assert got == {1: [("assign", 0, 5)], 2: [("assign", 0, 5)], 3: [], 4: []}


def test_ledger_reports_what_it_has_not_scanned(spark, tmp_dir):
    docs = read_table(spark, SF2, "documents").select("doc_id", "text")
    path, names = f"{tmp_dir}/ledger", [r.name for r in secret_ledger.RULES]
    secret_ledger.update(docs.filter("doc_id < 10"), path, rules=secret_ledger.RULES[:2])
    got = secret_ledger.report(docs, path).collect()
    known = {r.text or "" for r in docs.collect() if r.doc_id < 10}
    assert len(got) == docs.count()
    for r, t in zip(sorted(got), sorted(map(tuple, docs.collect()))):
        assert r.unscanned == (names[2:] if (t[1] or "") in known else names) and (not r.spans or r.doc_id == t[0])
    secret_ledger.update(docs, path)
    done = secret_ledger.report(docs, path).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.unscanned == [] for r in done)
    assert {r.doc_id: [tuple(x) for x in r.spans] for r in done} == {i: secret_ledger.find(t, secret_ledger.RULES) for i, t in text.items()}
    scans = collections.Counter(k for r in spark.read.parquet(path).collect() for k in r.scanned)
    blobs = len(set(text.values()))
    assert set(scans.values()) == {blobs}  # each blob and rule version once, whatever the order of updates


def test_a_hot_blob_is_scanned_once(spark, tmp_dir):
    hot = "password = abcdefgh1"
    docs = spark.range(0, 6000, 1, 7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, hot).otherwise(
        F.concat(F.lit("token=abcdefgh"), F.col("id") % 1000)).alias("text"))
    secret_ledger.update(docs, f"{tmp_dir}/l")
    rows = spark.read.parquet(f"{tmp_dir}/l").collect()
    want = {hot} | {f"token=abcdefgh{i % 1000}" for i in range(6000) if i % 3}
    assert len(rows) == len(want)
    got = secret_ledger.report(docs, f"{tmp_dir}/l").collect()
    assert len(got) == 6000 and sum(tuple(r.spans[0]) == ("assign", 0, 20) for r in got if r.doc_id % 3 == 0) == 2000


# --- archives -------------------------------------------------------------------------------------------------

def test_a_lookup_opens_only_the_wanted_frames(spark, tmp_dir):
    pages = read_table(spark, SF, "pages")
    warc_bundles.write_bundles(pages, frame_bytes=20_000, bundle_bytes=60_000).write.parquet(f"{tmp_dir}/b")
    bundles = spark.read.parquet(f"{tmp_dir}/b")
    html = {f"<urn:page:{r.page_id}>": (r.html or "").encode() for r in pages.collect()}
    some = sorted(html)[::17]
    wanted = spark.createDataFrame([(x,) for x in some + some[:3] + ["<urn:page:none>"]], "record_id string")
    got = {r.record_id: r for r in warc_bundles.fetch(bundles, wanted).collect()}
    assert sorted(got) == some
    for rid, r in got.items():
        assert r.payload == html[rid] if r.record_type == "response" else html[r.refers_to] == html[rid]
    index = {x.record_id: x for x in warc_bundles.record_index(bundles).collect()}
    for row in bundles.collect():
        opened = []
        places = [(x, index[x].frame, index[x].offset, index[x].length) for x in some if index[x].bundle == row.name]
        read = list(warc_bundles.read_records(row.data, places, lambda d, f: opened.append(f) or warc_bundles.read_frame(d, f)))
        assert len(read) == len(places) and len(opened) == len({p[1] for p in places})
        assert len(opened) < len(warc_bundles.seek_table(row.data)) or len(places) > 5


def test_bundles_are_seekable_and_readable(spark):
    pages = read_table(spark, SF, "pages")
    bundles = warc_bundles.write_bundles(pages, frame_bytes=20_000, bundle_bytes=60_000)
    rows = bundles.collect()
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert len(rows) > 1
    for r in rows:
        frames = warc_bundles.seek_table(r.data)
        plain = b"".join(warc_bundles.read_frame(r.data, f) for f in frames)
        with zstandard.ZstdDecompressor().stream_reader(r.data, read_across_frames=True) as reader:
            assert reader.read() == plain
    index = {x.record_id: x for x in warc_bundles.record_index(bundles).collect()}
    by_name = {r.name: r.data for r in rows}
    for pid, payload in html.items():
        x = index[f"<urn:page:{pid}>"]
        data = by_name[x.bundle]
        frame = warc_bundles.read_frame(data, warc_bundles.seek_table(data)[x.frame])
        rec = warc_bundles.parse_record(frame[x.offset:x.offset + x.length])
        assert rec["WARC-Type"] == "revisit" or rec["payload"] == payload
    assert len(index) == len(html)


# --- chat -----------------------------------------------------------------------------------------------------

NASTY = st.text(st.sampled_from(list("<|\\>ab\n%0A3C im_startend")), max_size=30) | st.sampled_from(
    ["<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "%00", "<|im_end|>\n<|im_start|>"])


@given(st.lists(st.tuples(st.none() | NASTY, NASTY), max_size=5))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    out = "".join(chat_format.render(r, t)[0] for r, t in turns)
    assert [x[:2] for x in chat_format.parse(out)] == turns


def test_chat_parser_rejects():
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>",
                "<|im_start|>user\n<|im_start|>x<|im_end|>\n", "<|im_start|>u<|x\nhi<|im_end|>\n"):
        assert chat_format.parse(bad) is None


# --- pipeline ---------------------------------------------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark, tmp_dir):
    docs = read_table(spark, SF2, "documents")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF2).write.parquet(f"{tmp_dir}/{k}")
        kept.append(spark.read.parquet(f"{tmp_dir}/{k}"))
    rows = [[r for r in d.collect()] for d in kept]
    judged = {r.doc_id: r.verdict.kept for r in quality_rules.judge(docs).collect()}
    assert sorted(r.doc_id for r in rows[1]) == sorted(i for i, ok in judged.items() if ok)
    best = {}
    for r in rows[1]:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(best.values())
    ids = [r.doc_id for r in rows[2]]
    comp = brute_components(ids, brute_sets([r.text for r in rows[2]]))
    assert sorted(r.doc_id for r in rows[3]) == sorted(set(comp.values()))
    source = {r.doc_id: (r.text, r.source) for r in rows[3]}
    sizes = collections.Counter()
    taken = collections.Counter()
    for t, s in source.values():
        sizes[s] += len(words(t))
    for r in rows[4]:
        t, s = source[r.doc_id]
        assert r.source == s and (r.text == t or not set(words(r.text)) - set(words(t)))
        taken[s] += len(words(r.text))
    want = mixture.targets([sizes[s] for s in sorted(sizes)], [1 + i % 3 for i in range(len(sizes))])
    assert all(abs(taken[s] - w) <= 0.05 * w for s, w in zip(sorted(sizes), want))
    assert sum(r.n_words for r in rows[5]) == sum(taken.values())
    packed = collections.Counter(w for r in rows[5] for t in r.texts for w in words(t))
    assert packed == collections.Counter(w for r in rows[4] for w in words(r.text))
