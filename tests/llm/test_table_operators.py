"""Dedup, Jaccard join, mixing and the pipeline: against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import exact_dedup, mixing, ngram_jaccard, quality_rules, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string, unit string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "k", "d", "u") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    rows = [(10, "same  text", "a"), (3, "same\ttext", "b"), (7, "same text", None), (7, "same text", None), (9, None, "a"),
            (2, "", "b"), (None, "same text", "c"), (None, "only null", "c"), (None, "only null", "c"), (4, " ", "b")]
    rows += [(100 + k, "hot copy of a text with several words in it", "hot") for k in range(300)]
    rows += [(500 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), rng.choice(["a", "b", "hot"])) for k in range(120)]
    rows += [(900, "w " * 60_000, "a")]
    return docs_of(spark, rows)


# --- exact dedup ---


def test_exact_dedup(spark, odd):
    got = exact_dedup.exact_dedup(odd, salts=4).collect()
    rows = odd.collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    kept = Counter()
    for r in got:
        kept[r.text_sha256] += r.kept
    for norm, ids in groups.items():
        digest = hashlib.sha256(norm.encode()).hexdigest()
        keep = min((i for i in ids if i is not None), default=None)
        of = [r for r in got if r.text_sha256 == digest]
        assert len(of) == len(ids) and kept[digest] == 1
        assert {(r.keep_id, r.group_size) for r in of} == {(keep, len(ids))}
        assert all(r.doc_id == keep for r in of if r.kept)
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0
    first = exact_dedup.keep_first(odd)
    assert first.columns == odd.columns
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in first.collect()) == sorted(groups)


def test_exact_dedup_spreads_null_ids(spark):
    rows = [(None, f"text {k % 9000}", "s") for k in range(10_000)] + [(k, f"text {k}", "s") for k in range(500)]
    # A fixed number of partitions, as a large table has.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = exact_dedup.exact_dedup(docs_of(spark, rows)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == 9000 == len({r.text_sha256 for r in got if r.kept})
    assert all(r.kept == (r.doc_id is not None) for r in got if r.keep_id is not None)
    tasks = Counter(r.task for r in got if r.doc_id is None)
    assert len(tasks) > 1 and max(tasks.values()) < 6000


def test_exact_dedup_stays_in_the_jvm(odd):
    plan = exact_dedup.exact_dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("ArrowEval", "Python")) and "CartesianProduct" not in plan


def test_colliding_digests_fail(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.rpad(F.lit("0"), 64, "0"))
    with pytest.raises(Exception, match="texts differ"):
        exact_dedup.exact_dedup(docs_of(spark, [(1, "a", "s"), (2, "b", "s")])).collect()


# --- Jaccard join ---


def plain_components(rows, n, percent):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    out = Counter()
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in members[find(i)] if x is not None]
        out[(doc_id, len(sets[i]), min(ids) if ids else None)] += 1
    return out


def near_copies(rng, count):
    """Texts in families: edits, shared passages, chains of small changes."""
    words = [f"w{k}" for k in range(400)]
    line = [rng.choice(words) for _ in range(30)]
    texts, base = [], None
    for k in range(count):
        kind = rng.random()
        if base is None or kind < 0.25:
            base = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if kind > 0.8:
            t += line
        if kind > 0.95:
            t = line + t[: rng.randint(0, 6)]
        if rng.random() < 0.3:
            base = t
        texts.append(" ".join(t) if k % 7 else " \n".join(t).upper())
    return texts


@pytest.mark.parametrize(("n", "percent", "units", "members", "common"), [(4, 85, 64, 256, 32), (5, 80, 3, 2, 4), (2, 70, 2, 3, 2)])
def test_jaccard_join(spark, monkeypatch, n, percent, units, members, common):
    # Small constants: every round and every way of a large table is taken.
    monkeypatch.setattr(ngram_jaccard, "TOKEN_UNITS", units)
    monkeypatch.setattr(ngram_jaccard, "GROUP_MEMBERS", members)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT_FROM", common)
    monkeypatch.setattr(ngram_jaccard, "PART_UNITS", units)
    rng = random.Random(n)
    rows = list(enumerate(near_copies(rng, 160)))
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "b a"), (None, rows[0][1]), (None, "lone null id text here"), rows[5], rows[5]]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    got = Counter(tuple(r) for r in ngram_jaccard.jaccard_components(docs, n=n, percent=percent).collect())
    assert got == plain_components(rows, n, percent)
    kept = ngram_jaccard.keep_one(docs, n=n, percent=percent)
    assert kept.columns == docs.columns
    classes = plain_components(rows, n, percent)
    want = {c for (i, size, c) in classes if size and c is not None}
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(want | {1000, 1001})


def test_jaccard_empty_and_hot(spark):
    assert ngram_jaccard.jaccard_components(docs_of(spark, []).limit(0)).count() == 0
    assert ngram_jaccard.keep_one(docs_of(spark, []).limit(0)).count() == 0
    base = [f"v{k}" for k in range(120)]
    rng, rows = random.Random(2), []
    for k in range(600):  # one large group of near copies, all different
        t = list(base)
        t[rng.randrange(120)] = f"x{k}"
        rows.append((k + 5, " ".join(t), "s"))
    got = ngram_jaccard.jaccard_components(docs_of(spark, rows)).collect()
    assert {r.component_id for r in got} == {5}


def test_jaccard_common_lines_without_links(spark, monkeypatch):
    # 2,000 texts of six out of 60 common lines: every token is one of many
    # units, few texts link. A tenth differs from another one in a word or two.
    rng = random.Random(8)
    lines = [" ".join(f"l{k}w{j}" for j in range(12)) for k in range(60)]
    texts = []
    for k in range(2000):
        if k % 10 == 9:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(1, 2)):
                t[rng.randrange(len(t))] = f"own{rng.randrange(3)}"
        else:
            t = " ".join(rng.sample(lines, 6)).split()
        texts.append(" ".join(t))
    tried, agreeing = [], ngram_jaccard.agreeing_pairs

    def counted(*args):
        pairs = agreeing(*args)
        tried.append(pairs.count())
        return pairs

    monkeypatch.setattr(ngram_jaccard, "agreeing_pairs", counted)
    rows = list(enumerate(texts))
    got = Counter(tuple(r) for r in ngram_jaccard.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows])).collect())
    assert got == plain_components(rows, 4, 85)
    assert len(tried) == 1 and tried[0] < 20_000  # of two million pairs, most of which share a token


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_linked_sets_agree_in_a_part(percent):
    rng = np.random.default_rng(percent)
    borders = ngram_jaccard.size_classes(percent, 2000)
    for a in range(1, 1000):
        b = 100 * a // percent  # the largest partner
        of = [int(np.searchsorted(borders, n, side="right")) - 1 for n in (a, b)]
        assert of[1] - of[0] in (0, 1)
        both = -(-percent * (a + b) // (100 + percent))
        if both > a or a % 7:
            continue
        tokens = rng.integers(0, 2**63, a + b - both).astype(np.uint64)
        m = ngram_jaccard.part_count(percent, borders, of[1])
        for seed in range(3):
            x, y = (ngram_jaccard.set_parts(t, m, seed) for t in (tokens[:a], tokens[a - both :]))
            assert (x == y).any()


def test_jaccard_units_of_several_sizes(spark):
    # x and y link (23 of 27 words) and share one prefix token. y2 makes the
    # sizes of y's unit 26 to 27: at 24 and 27 alone two would be needed.
    shingle = ngram_jaccard.Shingler(1)
    words = sorted((f"w{k}" for k in range(40)), key=lambda w: int(shingle(w)[0]))
    shared = words[4:27]
    sets = {1: [*shared, words[30]], 2: words[:3] + shared, 3: words[:4] + shared}
    docs = docs_of(spark, [(i, " ".join(t), "s") for i, t in sets.items()])
    got = ngram_jaccard.jaccard_components(docs, n=1, percent=85).collect()
    assert sorted(map(tuple, got)) == [(1, 24, 1), (2, 26, 1), (3, 27, 1)]


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_least_overlap_holds_between_the_extremes(spark, percent):
    def exact(a, b):
        return max(1, -(-percent * (a + b) // (100 + percent)) + (-percent * b // 100) + 1)

    sizes = [(a, b) for a in range(1, 200) for b in range(a, min(a + 8, 100 * a // percent + 1))]
    table = spark.createDataFrame(sizes, "lo long, hi long")
    got = table.select("lo", "hi", F.expr(ngram_jaccard.least_overlap(percent))).collect()
    for lo, hi, least in got:
        assert 1 <= least <= min(exact(a, b) for a in range(lo, hi + 1) for b in range(a, hi + 1) if 100 * a >= percent * b)


# --- mixing ---


def plain_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > most * sizes[s]}
        if not over:
            return t | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def check_mix(got, slack=0.02):
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        p = per[r.source]
        p[0], p[1], p[2] = p[0] + r.size, p[1] + r.copies * r.size, r.target
        assert 0 <= r.copies <= 3 and r.source_size >= r.size
    targets = plain_targets({s: p[0] for s, p in per.items()})
    for s, (_, taken, target) in per.items():
        assert target == pytest.approx(targets[s])
        assert abs(taken - target) <= slack * max(target, 1) + max((r.size for r in got if r.source == s), default=0) * 0.6
    return per


def test_mixing(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # Blocks of 20 rows, so that several rounds are needed.
    got = mixing.mix(docs, block_rows=20).collect()
    per = check_mix(got)
    assert len(got) == docs.count() and len(per) == 20
    again = mixing.mix(docs.repartition(5), block_rows=20).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)
    some = mixing.mix(odd).collect()
    assert len(some) == odd.count() and len({r.source for r in some}) == 5
    assert mixing.mix(odd.limit(0)).count() == 0
    copies = Counter((r.doc_id, r.source) for r in got for _ in range(r.copies))
    taken = mixing.take(docs, block_rows=20)
    assert taken.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in taken.collect()) == copies
    assert mixing.take(odd.limit(0)).count() == 0


def test_mixing_blank_documents(spark):
    got = mixing.mix(docs_of(spark, [(1, None, "a"), (2, " ", "b"), (3, "", None)])).collect()
    assert [r.copies * r.size for r in got] == [0, 0, 0] and all(r.target == 0 for r in got)


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(1, 900, 400).astype(float), rng.random(400)
    q = mixing.flight(p, sizes, rng.random(400))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * sizes).sum() == pytest.approx((p * sizes).sum())
    assert set(np.unique(mixing.landing(q, sizes, 0.5))) <= {0.0, 1.0}


@pytest.mark.parametrize("chance", [0.1, 0.3, 0.7])
def test_flight_leaves_every_expectation_as_it_was(chance):
    rng = np.random.default_rng(5)
    sizes, runs = np.round(rng.lognormal(4, 1.2, 60)) + 1, 3000
    p = np.full(60, chance)
    q = np.array([mixing.flight(p, sizes, rng.random(60)) for _ in range(runs)])
    z = (q.mean(axis=0) - chance) / np.sqrt(chance * (1 - chance) / runs)
    # Units are not independent (the words stay), so each is held against its own error.
    assert (np.abs(z) < 3).sum() >= 58 and np.abs(z).max() < 4


def test_settled_units_keep_their_chance_and_the_words():
    rng = np.random.default_rng(6)
    sizes, runs = np.round(rng.lognormal(4, 1.2, 300)) + 1, 1000
    p = np.full(300, 0.3)
    q = np.array([mixing.settle(p, sizes, rng.random(301)) for _ in range(runs)])
    assert set(np.unique(q)) == {0.0, 1.0}
    # The last dozen may bend a little; all others keep their chance.
    assert np.abs(q.mean(axis=0) - 0.3).max() < 0.12 and np.abs(q.mean(axis=0) - 0.3).mean() < 0.015
    assert np.abs(q @ sizes - (p * sizes).sum()).max() < sizes.mean()
    assert np.std(q.sum(axis=1)) < 3


def test_landing_takes_a_near_rounding():
    got = np.array([mixing.landing(np.array([0.5, 0.5]), np.array([10, 11]), d) for d in np.linspace(0, 0.999, 50)])
    assert (got.sum(axis=1) == 1).all() and 20 <= got[:, 0].sum() <= 30
    assert mixing.landing(np.array([0.0, 1.0]), np.array([3, 4]), 0.5).tolist() == [0, 1]


def test_flight_with_one_giant():
    rng = np.random.default_rng(7)
    sizes = np.concatenate([[8_000.0], rng.integers(20, 120, 400)])
    p = np.full(401, 0.4)
    q = np.array([mixing.settle(p, sizes, rng.random(402)) for _ in range(300)])
    assert abs(q[:, 0].mean() - 0.4) < 0.1
    assert np.abs((q - p) @ sizes).max() < 150


# --- pipeline ---


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    crf = quality_rules.train_crf(docs, labels)
    judge = quality_rules.verdicts(crf)
    state = [tuple(r) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard", "mix_sources", "byte_bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = [tuple(r) for r in docs.collect()]
        if name == "quality_rules":
            want = [r for r in state if judge(r[1])[6]]
        elif name == "exact_dedup":
            best = {}
            for r in sorted(state):
                best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
            want = list(best.values())
        elif name == "ngram_jaccard":
            keep = {c for _, _, c in plain_components([(r[0], r[1]) for r in state], 5, 80)}
            want = [r for r in state if r[0] in keep]
        elif name == "mix_sources":
            copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(state, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
            want = [r for r in state for _ in range(copies[r[0]])]
        else:
            from tests.llm.test_text_operators import reference_codec

            enc = reference_codec()
            want = [(r[0], len(enc.encode_ordinary(r[1])), bytearray(np.array(enc.encode_ordinary(r[1]), "<u4").tobytes())) for r in state]
            got.sort(key=lambda r: (r[0], bytes(r[2]))), want.sort(key=lambda r: (r[0], bytes(r[2])))
            assert got == want
            break
        assert Counter(got) == Counter(want) and got
        state = got
    assert corpus_pipeline.run(spark, sf).count() == len(state)


def test_pipeline_stages_on_odd_rows(spark, odd):
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, "/root/testdata/sf0.001")
            assert got.count() >= 0 and (name == "byte_bpe" or got.columns == rows.columns)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLES) == {"op3_ngram_jaccard", "op5_warc", "op9_exact_dedup"}


def test_most_frequent_is_a_threshold(spark):
    from driftline.llm.common import most_frequent

    counts = spark.createDataFrame([(k, 1 + 1000 // (k + 1)) for k in range(200)], "w long, c long")
    for limit in (1, 5, 20, 150, 1000):
        got = [r.c for r in most_frequent(counts, "c", limit).collect()]
        rest = sorted((r.c for r in counts.collect()), reverse=True)[len(got) :]
        assert len(got) <= limit and (not got or not rest or min(got) > rest[0])
    assert most_frequent(counts, "c", 1000).count() == 200
