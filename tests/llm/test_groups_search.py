"""SimHash groups, spelling variants and ranked search: against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from driftline.llm import lexical_search, queries, simhash, spelling

SCHEMA = "doc_id long, text string, fp string, word string, prefix string, item int, score double, h long, id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "f", "w", "p", 1, 0.5, 3, "x") for i, t in rows], SCHEMA)


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def plain_components(names, linked):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


# --- SimHash ---


def plain_print(text):
    words = words_of(text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(rows):
    prints = [plain_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    linked = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 3]
    names = plain_components(distinct, linked)
    lowest = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            lowest[names[p]] = min(i, lowest.get(names[p], i))
    return sorted(((i, f"{p:016x}", lowest.get(names[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def near_texts(seed=5, n=500):
    rng = random.Random(seed)
    base = [[rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randint(0, 30)) for _ in range(rng.randint(2, 90))] for _ in range(40)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"Edit{rng.randint(0, 9)}"
        rows.append((k, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


def test_simhash_groups(spark):
    rows = near_texts()
    rows += [(900, None), (901, ""), (902, " \t"), (None, "one two"), (None, None), (903, "one two"), (904, "ONE TWO"), (903, "one two"), (905, "É é"), (906, "word")]
    got = simhash.simhash_groups(docs_of(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_simhash(rows)
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0
    only = simhash.simhash_groups(docs_of(spark, [(None, "a b c d")])).collect()
    assert only[0].component_id is None


def test_simhash_in_pieces_equals_the_whole():
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "bb", "ccc"]) + str(rng.randint(0, 999)) for _ in range(4000)) + "  " * 3000 + "tail word"
    whole = simhash.shingle_hashes(text.encode().split())
    parts = []
    for words in simhash.word_pieces(text.encode(), 100):
        if len(words) > 2:
            parts.append(simhash.shingle_hashes(words))
    assert np.array_equal(whole, np.concatenate(parts))
    counts = simhash.bit_counts(whole, np.array([len(whole)]))[0]
    assert counts.tolist() == [sum(int(h) >> b & 1 for h in whole) for b in range(64)]
    assert [len(h) for h in simhash.text_hashes(b"  " * (1 << 20) + b"a b")] == [1]


def test_golay_indices_meet_at_one_error():
    code = simhash.Golay()
    assert sorted(set((code.patterns >= 0).sum(axis=1).tolist())) == [1, 6]
    words = np.random.default_rng(1).integers(0, 1 << 16, 3000)
    single = code.nearest(words)
    for bit in range(-1, 16):
        other = words ^ (1 << bit) if bit >= 0 else words
        at, index = code.near(other)
        held = defaultdict(set)
        for a, x in zip(at.tolist(), index.tolist(), strict=True):
            held[a].add(x)
        assert all(int(s) in held[k] for k, s in enumerate(single))


def cluster_prints(rng, dense):
    prints = []
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(dense):
            x = center
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    return sorted({p - (1 << 64) if p >> 63 else p for p in prints + [rng.getrandbits(64) for _ in range(300)] + [0, 1, 15]})


@pytest.mark.parametrize("hot", [simhash.HOT_COMPARISONS, 20])
def test_links_lose_no_pair_also_when_keys_are_split(spark, hot):
    prints = cluster_prints(random.Random(hot), 60)
    found = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), hot)
    links = {(r.a, r.b) for r in found.collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    near = [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert near and plain_components(prints, links) == plain_components(prints, near)


def test_dense_cluster_gives_a_forest():
    fp = np.arange(8, dtype=np.int64)
    k = np.concatenate([np.zeros(8, dtype=np.int64), np.ones(8, dtype=np.int64)])
    a, b, hot = simhash.compare_runs(k, np.concatenate([fp, fp]), 1000)
    assert len(a) == 7 and not hot.any()


# --- spelling ---


def edits_once(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted([a, b], key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_spelling(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % 97 == 0:
                    p = h % len(run)
                    run = run[:p] + run[p + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if edits_once(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_groups(spark):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcñé") for _ in range(rng.randint(4, 8))) for _ in range(25)]
    rows = []
    for k in range(400):
        words = []
        for _ in range(rng.randint(1, 30)):
            w = rng.choice(stems[: rng.randint(1, 25)])
            p = rng.randrange(len(w))
            w = rng.choice([w, w, w.upper(), w[:p] + w[p + 1 :], w[:p] + rng.choice("abñ") + w[p:], w[:p] + "z" + w[p + 1 :]])
            words.append(w)
        rows.append((k, rng.choice([" ", "-", "€", "7"]).join(words)))
    rows += [(None, "aabbb " * 5), (500, None), (501, ""), (502, "×÷ÿÀÀ " * 4), (503, "no letters 123"), (7, rows[7][1]), (7, rows[7][1])]
    long = "".join(rng.choice("xyz") for _ in range(90))
    rows += [(600 + k, long) for k in range(8)] + [(620 + k, long[:40] + long[41:]) for k in range(3)] + [(630 + k, long[:40] + "q" + long[41:]) for k in range(3)]
    # around the border between whole and named rotations
    edge = long[:64]
    rows += [(640 + k, edge) for k in range(6)] + [(650 + k, edge[:-1]) for k in range(3)] + [(660 + k, edge + "z") for k in range(3)]
    got = spelling.spelling_groups(docs_of(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == plain_spelling(rows)
    assert spelling.spelling_groups(docs_of(spark, [])).count() == 0


def test_very_long_runs_stay_small():
    names = list(spelling.rotation_names("ab" * 20_000))
    assert len(names) == 2 * 40_000 + 1 and max(len(n) for n, _, _ in names) < 60


def test_chain_of_forms_ends_at_its_root(spark):
    texts = []
    for k, w in enumerate(["abcdefgh", "abcdefgi", "abcdefji", "abcdekji", "abcdlkji"]):
        texts += [(None, w)] * (3 * 2**k)
    got = {r.word: r.root for r in spelling.spelling_groups(docs_of(spark, texts)).collect()}
    assert set(got.values()) == {"abcdlkji"}


# --- search ---


def plain_search(rows, items, top=50):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(i, c) for i, t in rows if (c := Counter(pattern.findall(lower(t))))]
    n_docs, n_words = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for key, text in set(items):
        terms = set(pattern.findall(lower(text)))
        scored = []
        for i, c in docs:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_words
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms if t in c
            )
            if s > 0:
                scored.append((-s, i is None, i or 0, i, s))
        out += [(key, r + 1, i, s) for r, (_, _, _, i, s) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeñ") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    pick = lambda n: [vocabulary[int(rng.paretovariate(0.6)) % 300] for _ in range(n)]
    rows = [(k, rng.choice([" ", "-", "\n"]).join(pick(rng.choice([1, 5, 40, 200])))) for k in range(700)]
    rows += [(700, None), (701, ""), (702, "!!"), (5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1]), (None, rows[9][1]), (703, "zz " * 3000), (704, " ".join(vocabulary * 20))]
    rows += [(1000 + k, "the same few words of a copy") for k in range(90)]
    items = [(k, " ".join(pick(12)).title()) for k in range(8)] + [(20, None), (21, "??"), (22, "unheardof"), (23, "COPY words"), (23, "COPY words"), (None, "few same"), (24, "zz")]
    return rows, items


@pytest.mark.parametrize(("top", "chars"), [(50, lexical_search.ITEM_CHARS), (3, 150)])
def test_ranked_search(spark, monkeypatch, top, chars):
    monkeypatch.setattr(lexical_search, "CELLS", 1 << 12)
    rows, items = search_rows()
    asked = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical_search.ranked_search(docs_of(spark, rows), asked, top=top, item_chars=chars)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows, items, top)


def test_search_without_rows(spark):
    rows, items = docs_of(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked_search(rows.limit(0), items).count() == 0
    assert lexical_search.ranked_search(rows, items.limit(0)).count() == 0


def test_bounds_are_never_below_the_scores(spark):
    rows, items = search_rows()
    index = lexical_search.SearchIndex(docs_of(spark, rows))
    terms = [(k, sorted(lexical_search.term_counts(t))) for k, t in items if t]
    df = Counter(t for _, text in rows for t in lexical_search.term_counts(text))
    query = lexical_search.ItemBlock(terms, {t: df[t] for _, own in terms for t in own if df[t]}, index)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    seen, close = 0, 0
    for b in index.blocks.collect():
        sizes = np.array(b.sizes)
        for start, bound in query.bounds(b.width, sizes, bytes(b.slices)):
            for column in range(bound.shape[1]):
                counts = lexical_search.term_counts(next(t for t in texts[b.ids[start + column]] if t))
                for item in range(len(terms)):
                    score = query.score(counts, item)
                    assert bound[item, column] >= score
                    close += bound[item, column] <= 1.3 * score
                    seen += 1
    assert seen and close > 0.9 * seen


def test_queries_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op11_simhash"](spark, sf).collect()), key=repr)
    assert got == plain_simhash(rows)
    small = rows[:]
    assert sorted(tuple(r) for r in queries.QUERIES["op12_spelling"](spark, sf).collect()) == plain_spelling(small)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_lexical_search"](spark, sf).collect()), key=repr) == plain_search(rows, items)
