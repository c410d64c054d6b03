import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import codes, imatch, queries, tries

# -- conversation prefix trie


def rebuilt(rows):
    """Conversations by id as lists of (role, text), rebuilt by hand."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            key = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, key), said))
    own = {c: [said for _, said in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def trie_by_hand(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = {}
    for node, ms in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below)
        children = sum(len(m) == len(node) + 1 and m[: len(node)] == node for m in members)
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(ms), len(node), parent, len(ms), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def trie_rows(spark, rows, **extra):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    found = tries.trie(tries.regrafted(tries.marked(turns))).drop("node")
    return sorted([tuple(r) for r in found.collect()], key=str)


def test_trie_as_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(0, 40), *range(100, 130), 250, 251, -3, -100]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é😀", "", None])))
    rows += [(7, None, None, None), (7, None, "user", "null turn"), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "user", "other"), (None, 0, "user", "nobody")]
    assert trie_rows(spark, rows) == trie_by_hand(rebuilt(rows))


def test_trie_of_nothing_and_of_long_conversations(spark):
    assert trie_rows(spark, []) == []
    rows = [(c, t, "user", "same" if t < 1500 else f"{c} {t}") for c in (1, 2) for t in range(3000)]
    found = trie_rows(spark, rows)
    by_hand = rebuilt(rows)
    assert len(found) == 1 + len({tuple(by_hand[c][:d]) for c in (1, 2) for d in range(1, len(by_hand[c]) + 1)})
    root = next(r for r in found if r[1] == 0)
    assert root[:6] == (1, 0, None, 2, 1, 2) and root[6] == 4 * sum(a == b for a, b in zip(by_hand[1], by_hand[2], strict=False))


def test_trie_packs_the_ends_of_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(tries, "PACKED", 20)
    rows = [(c, 0, "user", "hello") for c in range(1, 2000)]
    assert trie_rows(spark, rows) == trie_by_hand(rebuilt(rows))


# -- document fingerprints


def compared_by_hand(rows):
    """(doc_id, text) -> rows as the operator's, by plain loops over sets of words."""
    texts = [t or "" for _, t in rows]
    found = [imatch.terms(t) for t in texts]
    df = defaultdict(int)
    for words in found:
        for w in words:
            df[w] += 1
    low, high = max(2, math.ceil(len(rows) / 1000)), max(2, len(rows) / 20)
    printer = imatch.Printer(sorted(w for w, n in df.items() if low <= n <= high))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, xxhash.xxh64_intdigest(texts[k], 42) >> 1))
    out = []
    for at, k in enumerate(order):
        after = texts[order[(at + 1) % len(order)]]
        half = len(texts[k]) // 2
        other = texts[k][: len(texts[k]) - half] + after[:half]
        a, b, c = printer.of(texts[k]), printer.of(other), printer.of(after)
        out.append((rows[k][0], len(texts[k]), hashlib.sha256(other.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(600)]
    out = [" ".join(rng.choice(words[k % 5 * 100 :][:200]) for _ in range(rng.randint(0, 120))) for k in range(300)]
    return [*out, None, "", "  \n", "!!!", "x" * 70, out[3], out[3], "É" * 5 + " 😀", "lorem ipsum " * 20_000]


def test_fingerprints_as_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(imatch, "CHUNK", 20)  # many chunks, so many seams
    rows = [(3 * k - 50, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, "nor here"), (7, "a second seven"), (7, "a third"), (-50, "again the first")]
    docs = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fingerprint string, chunk int").repartition(5)
    found = [tuple(r) for r in imatch.compared(docs).collect()]
    assert sorted(found, key=str) == sorted(compared_by_hand(rows), key=str)
    alone = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs.filter("doc_id > 10"), imatch.lexicon(docs)).collect()}
    assert all(alone[r[0]] == r[3] for r in found if r[0] in alone)


def test_fingerprints_of_few(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert imatch.compared(docs([])).count() == 0
    one = imatch.compared(docs([(4, "alone in the world")])).first()
    assert (one.near_next, one.n_chars) == (1.0, 18)
    two = imatch.compared(docs([(None, None), (1, "abc")])).collect()
    assert sorted(r.edited_sha256 for r in two) == sorted(hashlib.sha256(t).hexdigest() for t in (b"", b"ab"))


def test_likeness_follows_what_is_shared():
    words = [f"term{k}" for k in range(3000)]
    printer = imatch.Printer(sorted(words))
    rng, gone = random.Random(2), []
    for share in (0.0, 0.5, 0.8, 1.0):
        likes = []
        for _ in range(40):
            a = rng.sample(words, 200)
            b = a[: int(200 * share)] + rng.sample([w for w in words if w not in set(a)], 200 - int(200 * share))
            likes.append(printer.of(" ".join(a)).likeness(printer.of(" ".join(b))))
        gone.append(sum(likes) / 40)
    assert gone[0] < 0.03 < 0.15 < gone[1] < gone[2] - 0.15 and gone[2] < gone[3] == 1.0


# -- vector codes


def codes_by_hand(rows):
    """(vec_id, vector, label) -> rows as the operator's, by exact integers of Python."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 16
    ids = sorted({i for i, _, _ in kept if i is not None})[:64]
    seeds = [min(v for i, v, _ in kept if i == wanted) for wanted in ids]
    books = [[s[p * width :][:width] for s in seeds] for p in range(16)]
    cut = [[v[p * width :][:width] for p in range(16)] for _, v, _ in kept]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(part, e), k) for k, e in enumerate(books[p])) for p, part in enumerate(parts)] for parts in cut]
    for _ in range(2):
        groups = defaultdict(list)
        for parts, near in zip(cut, assign(), strict=True):
            for p in range(16):
                groups[p, near[p][1]].append(parts[p])
        for (p, k), some in groups.items():
            books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    near = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    labels = defaultdict(int)
    for (_, _, label), n in zip(kept, near, strict=True):
        labels[label] += sum(d for d, _ in n)
    return sorted([(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), labels[label], digest) for (i, _, label), n in zip(kept, near, strict=True)], key=str)


def code_rows(spark, rows):
    vectors = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    return sorted([tuple(r) for r in codes.compressed(vectors.repartition(3)).collect()], key=str)


def test_codes_as_brute_force(spark):
    rng = np.random.default_rng(4)
    for dim in (16, 64, 112):
        rows = [(int(k) - 7, rng.normal(size=dim).astype(np.float32).tolist(), int(rng.integers(4)) if k % 9 else None) for k in rng.permutation(150)]
        rows += [(rows[0][0], rows[1][1], 2), (rows[3][0], rows[3][1], 1), (None, rows[5][1], 3), (900, [0.25] * dim, 1), (901, [0.25] * dim, 1)]
        bad = [(-90, None, 1), (-91, [math.nan] * dim, 1), (-92, [math.inf, *[0.0] * (dim - 1)], 2), (-93, [None, *[0.5] * (dim - 1)], 2)]
        assert code_rows(spark, rows + bad) == codes_by_hand(rows)


def test_codes_of_few_and_of_odd_sizes(spark):
    assert code_rows(spark, []) == [] and code_rows(spark, [(1, None, 1), (2, [], 1), (3, [1.0] * 5, 2)]) == []
    assert code_rows(spark, [(5, [1.0] * 16, None)]) == codes_by_hand([(5, [1.0] * 16, None)])
    mixed = code_rows(spark, [(1, [1.0] * 32, 1), (2, [1.0] * 16, 1), (3, [2.0] * 32, 1), (4, [], 1)])
    assert [(r[0], r[1] is None) for r in sorted(mixed)] == [(1, False), (2, True), (3, False), (4, True)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 8), st.randoms(use_true_random=False), st.sampled_from([3, 50, codes.MOST]))
def test_nearest_keeps_the_first_of_the_nearest(m, width, rng, most):
    point = lambda: [rng.randint(-most, most) for _ in range(width)]
    entries = [point() for _ in range(m)]
    points = [rng.choice(entries) if rng.random() < 0.3 else point() for _ in range(20)]
    index, far = codes.nearest(np.array(points, np.int64), np.array(entries, np.int64))
    want = [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(entries)) for p in points]
    assert list(zip(far.tolist(), index.tolist(), strict=True)) == want


def test_queries_of_the_new_operators_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted([tuple(r) for r in queries.op11_conversation_trie(spark, sf).collect()], key=str) == trie_by_hand(rebuilt(map(tuple, turns)))
    prints = queries.op12_document_fingerprints(spark, sf).toPandas()
    assert (prints.near_edited > prints.near_next).mean() > 0.85
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert sorted([tuple(r) for r in queries.op13_vector_codes(spark, sf).collect()], key=str) == codes_by_hand([tuple(v) for v in vectors])
