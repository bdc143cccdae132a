import random

from feedloom.llm import minhash, spans


def brute(docs, n=spans.SPAN):
    pairs, cover = set(), {d: set() for d, _ in docs}
    win = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            win.setdefault(t[i : i + n], []).append((d, i))
    for hits in win.values():
        if len({d for d, _ in hits}) > 1:
            for d, i in hits:
                cover[d].update(range(i, i + n))
                pairs.update((min(d, e), max(d, e)) for e, _ in hits if e != d)
    return pairs, {d: len(c) for d, c in cover.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "дом", "木", "\n", "delta", "é"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))
    out = [text(rng.randrange(0, 120)) for _ in range(30)]
    for _ in range(12):
        a, b = rng.randrange(30), rng.randrange(30)
        n = rng.choice([150, 199, 200, 201, 350])
        s = out[a][rng.randrange(0, max(1, len(out[a]) - n)) :][:n]
        at = rng.randrange(len(out[b]) + 1)
        out[b] = out[b][:at] + s + out[b][at:]
    out += [out[0]] * 3 + [None, "", "x" * 199, "ab" * 300, "ab" * 310, "ab" * 300]
    return list(enumerate(out))


def test_pairs_and_shares_against_brute_force(spark):
    for seed in range(2):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as doc", "2 as key", "'x' as ctx")
        pairs, cover = brute(docs)
        got = [tuple(r) for r in spans.span_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
        label = {d: d for d, _ in docs}
        for _ in docs:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        assert {r.doc_id: r.class_id for r in spans.classes(df).collect()} == label
        rows = spans.shares(df).collect()
        assert {r.doc_id: r.shared_chars for r in rows} == cover
        assert all(r.n_chars == len(docs[r.doc_id][1] or "") for r in rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.span_pairs(df).count() == spans.shares(df).count() == spans.method_classes(df).count() == spans.classes(df).count() == 0


def test_pieces_change_no_anchor():
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(97, 123, 5000).astype(np.uint32)
    whole = set(spans.anchors_of(codes)[0].tolist())
    parts = set()
    for a in range(0, 5000 - spans.SPAN + 1, 700):
        parts |= {a + p for p in spans.anchors_of(codes[a : a + 700 + spans.SPAN - 1])[0].tolist()}
    assert parts == whole
    # every window has an anchor
    at = sorted(whole)
    for i in range(5000 - spans.SPAN + 1):
        assert any(i <= p <= i + spans.SPAN - spans.GRAM for p in at)


def test_paragraph_classes(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    near = base + " extra"
    docs = [(1, base + "\nother words only here in this place"), (2, near), (3, base), (4, "nothing alike at all in these words of mine"), (5, None), (6, "")]
    got = {(r.doc_id, r.par_no): (r.class_id, r.remove) for r in spans.method_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0)}
    assert len({c for c, _ in got.values()}) == 1 and [got[k][1] for k in sorted(got)] == [False, True, True]


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(40)] + [(1, k, k + 1) for k in range(3)], "scope int, a bigint, b bigint")
    got = {(r.scope, r.key): r.label for r in minhash.components(edges, "t").collect()}
    assert got == {(0, k): 0 for k in range(41)} | {(1, k): 0 for k in range(4)}


def test_banding_recall():
    """Measured recall of banding at similarity 0.8 and above."""
    rng = random.Random(5)
    hit = total = 0
    for _ in range(400):
        w = [str(rng.randrange(10**6)) for _ in range(60)]
        v = [*w]
        v[rng.randrange(60)] = "changed"
        if minhash.jaccard(" ".join(w), " ".join(v)) >= 0.8:
            total += 1
            k = minhash.band_keys([w, v])
            hit += bool((k[0] == k[1]).any())
    assert total > 200 and hit / total >= 0.98


def test_short_texts_need_one_bucket():
    """Fewer than four different shingles: the bucket is shared just by texts of the same shingles."""
    rng = random.Random(2)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(120)] + [[str(k)] * 9 for k in range(3)] + [[str(k)] * 30 for k in range(3)]
    got = minhash.bucket_lists(texts).to_pylist()
    assert {len(x) for x in got} == {1, minhash.BANDS} and minhash.bucket_lists([]).to_pylist() == []
    for i, a in enumerate(texts):
        for j in range(i):
            if len(got[i]) == 1 and minhash.jaccard(" ".join(a), " ".join(texts[j])) >= 0.8:
                assert got[i] == got[j]


def test_members_of_shared_buckets(spark):
    """Exact, whether the filter is large enough or lets everything pass."""
    rng = random.Random(6)
    rows = [(rng.randrange(60), [rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(40)]) for _ in range(rng.randrange(5))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "key bigint, buckets array<bigint>")
    by = {}
    for k, bs in rows:
        for b in bs:
            by.setdefault(b, set()).add(k)
    want = {(k, b) for b, ks in by.items() if len(ks) > 1 for k in ks}
    got = [tuple(r) for r in minhash.members(df).collect()]
    assert len(got) == len(want) and set(got) == want
    real, minhash.bucket_filter = minhash.bucket_filter, lambda m: real(m, 64)
    try:
        assert {tuple(r) for r in minhash.members(df).collect()} == want
    finally:
        minhash.bucket_filter = real
    assert minhash.members(df.limit(0)).count() == 0


def test_links_of_paragraphs_against_brute_force(spark):
    """Recall of the links end to end, with a third of all paragraphs equal and a notice in many of the others."""
    rng = random.Random(11)
    word = lambda: str(rng.randrange(10**6))
    notice = [f"n{k}" for k in range(30)]
    base = [(notice if k % 2 else []) + [word() for _ in range(rng.randrange(4, 60))] for k in range(150)]
    pars = [" ".join(w) for w in base]
    for w in base:
        for _ in range(rng.randrange(3)):
            v = [*w]
            v[rng.randrange(len(v))] = word()
            pars.append(" ".join(v))
    pars += ["the same words in a third of all the rows there are"] * (len(pars) // 2)
    rng.shuffle(pars)
    docs = spark.createDataFrame([(k, "\n".join(pars[k :: 40])) for k in range(40)], "doc_id bigint, text string")
    got = {(r.doc_id, r.par_no): r.class_id for r in spans.method_classes(docs).collect()}
    place = {(k, n): p for k in range(40) for n, p in enumerate(pars[k::40])}
    distinct = sorted(set(pars))
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if minhash.jaccard(a, b) >= 0.8]
    cls = {place[k]: c for k, c in got.items()}
    hit = sum(a in cls and cls.get(a) == cls.get(b) for a, b in pairs)
    assert len(pairs) > 50 and hit / len(pairs) >= 0.95
    assert all(place[k] == distinct[-1] or pars.count(place[k]) > 1 or any(place[k] in p for p in pairs) for k in got)


def test_a_common_text_below_the_length_makes_no_pairs(spark):
    """150 characters that every document has, and a third with 60 more: only the latter share a span."""
    from pyspark.sql import functions as F

    def noise(n):
        return F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{n}-{k}")), 256) for k in range(3)])

    same = "the same notice for all of us " * 5
    more = F.when(F.col("id") % 3 == 0, F.lit("and this is a longer part that only a third of all has here!")).otherwise(noise(9))
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(noise(1), F.lit(same), more, noise(2)).alias("text"))
    assert spans.span_pairs(df).count() == 200 * 199 // 2
    # the noise beside the span is equal by chance for a few characters
    assert all(r.shared_chars in range(210, 225) if r.doc_id % 3 == 0 else r.shared_chars == 0 for r in spans.shares(df).collect())


def test_unlike_texts_in_a_bucket_hide_no_pair(spark):
    """Paragraphs with a common notice collide with unlike ones; the similar pairs among them are found all the same, in one block or many."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    word = lambda: str(rng.randrange(10**6))
    notice = [f"notice{k}" for k in range(55)]
    rows = [notice + [word() for _ in range(12)] for _ in range(500)]
    rows += [[*w[:-6], word(), *w[-5:]] for w in rows[:60]]
    key = lambda k: k * 7919 % 1009
    text = {key(k): " ".join(w) for k, w in enumerate(rows)}
    assert all(minhash.jaccard(text[key(k)], text[key(500 + k)]) >= 0.8 > minhash.jaccard(text[key(k)], text[key(k + 1)]) for k in range(60))
    bands = minhash.band_keys(rows)
    want = {frozenset((key(k), key(500 + k))) for k in range(60) if (bands[k] == bands[500 + k]).any()}
    buckets = spark.createDataFrame([(0, key(k), int(v)) for k, r in enumerate(bands) for v in r], "scope bigint, key bigint, bucket bigint")
    texts = spark.createDataFrame([(0, k, t) for k, t in text.items()], "scope bigint, key bigint, text string")
    for block in (minhash.BLOCK, 100):
        assert {frozenset((r.a, r.b)) for r in minhash.links(buckets, texts, block).collect()} == want
    docs = spark.createDataFrame(list(text.items()), "doc_id bigint, text string")
    classes = spans.method_classes(docs).groupBy("class_id").agg(F.collect_set("doc_id").alias("docs")).collect()
    assert {frozenset(r.docs) for r in classes} == want


def test_block_links_connect_what_all_pairs_connect():
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        w = [str(rng.randrange(30)) for _ in range(rng.choice([3, 5, 9, 30, 31]))]
        for _ in range(rng.randrange(1, 8)):
            texts.append(" ".join(w))
            w = [*w]
            w[rng.randrange(len(w))] = str(rng.randrange(30))

    def classes(pairs):
        label = list(range(len(texts)))
        for _ in texts:
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
        return label

    pairs = [(x, y) for x in range(len(texts)) for y in range(x) if minhash.jaccard(texts[x], texts[y]) >= 0.8]
    for small in (0, 24, 10**6):  # with the index, and pair by pair
        minhash.SMALL, real = small, minhash.SMALL
        got = minhash.block_links(texts, [False] * len(texts), [0] * len(texts))
        minhash.SMALL = real
        assert set(map(frozenset, got)) <= set(map(frozenset, pairs)) and classes(got) == classes(pairs)
