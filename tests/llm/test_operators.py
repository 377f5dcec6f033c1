"""Training-data operators against brute force, on small tables with every odd case."""

import bisect
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F
from textloom.llm import ann, boosting, common, components, dac, exact_dedup, language_id, mixing, secrets, sentencepieces, simhash, token_output, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text[, source[, lang]]), with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None, 7, 8, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def words(rnd, n, letters="abcdefghij"):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n)]


ODD = [(None, "a null id"), (1, None), (2, ""), (3, " \t\n "), (4, "x"), (4, "x"), (5, "a  b"), (6, "a\nb"), (7, "ü 漢字 \U0001f600 e\u0301"), (8, "A b C d"), (9, "a b c d"), (10, None), (None, "a null id")]


# --- fingerprints and near copies


def brute_fingerprint(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_near_dedup_odd_cases(docs):
    rows = simhash.near_dedup(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    prints = {t: brute_fingerprint(t) for _, t in ODD}
    root = classes(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in ODD:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    by_id = dict(ODD)
    for r in rows:
        text = by_id[r["doc_id"]]
        assert r["fingerprint"] == f"{prints[text]:016x}" and r["component_id"] == least.get(root[prints[text]])
    assert simhash.near_dedup(docs([])).collect() == []


def test_near_dedup_clusters(spark, docs):
    rnd = random.Random(5)
    rows, i = [], 0
    for _ in range(6):
        base = words(rnd, 120)
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice("abc")
            rows.append((i, " ".join(w)))
            i += 1
    rnd.shuffle(rows)
    prints = {d: brute_fingerprint(t) for d, t in rows}
    root = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = {d: min(x for x in root if root[x] == root[d]) for d in root}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs(rows)).collect()} == want
    left = {r["doc_id"] for r in simhash.without_near_copies(docs(rows)).collect()}
    assert left == set(want.values())


@pytest.mark.parametrize("block, few", [(2048, 64), (4, 2), (16, 2)])
def test_links_by_brute_force(spark, monkeypatch, block, few):
    """Dense clusters, with buckets dealt in blocks: the components are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "FEW", few)
    rnd = random.Random(9)
    prints = set()
    for _ in range(8):
        center = rnd.getrandbits(64)
        for _ in range(25):
            x = center
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(100)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in sorted(prints)]
    found = simhash.edges(spark.createDataFrame(signed, "fp long")).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in found)
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    got = classes_of_edges(prints, [(r["a"] % 2**64, r["b"] % 2**64) for r in found])
    groups = lambda c: {frozenset(k for k in c if c[k] == v) for v in c.values()}
    assert groups(want) == groups(got)


def classes_of_edges(keys, links):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_pigeonring_keeps_every_link():
    rnd = np.random.default_rng(2)
    for _ in range(2000):
        x = 0
        for b in rnd.choice(64, rnd.integers(0, 5), replace=False):
            x |= 1 << int(b)
        assert any(simhash.chain_ok(np.array([x], dtype=np.uint64), np.array([s]))[0] for s in range(5))


def test_fingerprint_in_pieces(monkeypatch):
    rnd = random.Random(1)
    text = "  ".join(words(rnd, 300, "abc é")) + " Trailing WORD"
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", size)
        for t in (text, "", "one", "a b c", "x" * 200, " " * 30, text + "\n"):
            assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 175), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 150, 150: 150, 175: 150}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- exact copies


def test_exact_dedup(docs, spark):
    rows = exact_dedup.exact_dedup(docs(ODD)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert len(rows) == len(ODD)
    by_id = {}
    for i, t in ODD:
        by_id.setdefault(norm(t), []).append(i)
    text_of = dict(ODD)
    for r in rows:
        group = by_id[norm(text_of[r["doc_id"]])]
        keep = min((i for i in group if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(norm(text_of[r["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs([])).collect() == []
    left = exact_dedup.without_copies(docs(ODD))
    assert left.columns == docs([]).columns
    assert sorted(((r["doc_id"] is None, r["doc_id"]), norm(r["text"])) for r in left.collect() if r["doc_id"] is not None) == sorted({((False, min(i for i in g if i is not None)), t) for t, g in by_id.items() if any(i is not None for i in g)})
    assert sum(r["doc_id"] is None for r in left.collect()) == 1


def test_one_row_of_a_repeated_id_may_go(docs):
    rows = [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "c")]
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.without_copies(docs(rows)).collect()) == [(0, "a"), (1, "b"), (3, "c")]


def test_fingerprints_combine():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 4095, 4096, 4097, 20_000, 1 << 21):
        data = rnd.integers(0, 256, n).astype(np.uint8)
        cut = n // 3
        whole = exact_dedup.poly_hash(data)
        assert exact_dedup.combine((exact_dedup.poly_hash(data[:cut]), cut), (exact_dedup.poly_hash(data[cut:]), n - cut)) == (whole, n)
        if n and n < 5000:
            assert whole[0] == sum((int(b) + 1) * pow(int(exact_dedup.BASES[0]), n - 1 - i, exact_dedup.P[0]) for i, b in enumerate(data)) % exact_dedup.P[0]


def test_equal_fingerprints_of_unequal_texts_are_told_apart(docs, monkeypatch, spark):
    """With a fingerprint that knows only the length, the comparison has to do it all."""
    real = exact_dedup.fingerprints

    def weak(d):
        return real(d).withColumn("f1", F.lit(0).cast("long")).withColumn("f2", F.lit(0).cast("long"))

    monkeypatch.setattr(exact_dedup, "fingerprints", weak)
    long = "z" * 20_000
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (5, long + "1"), (6, long + "2"), (7, long + "1")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs(rows)).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1), 5: (5, 2), 6: (6, 1), 7: (5, 2)}


def test_unequal_texts_of_one_fingerprint_are_split_by_their_chunks(docs, monkeypatch, spark):
    monkeypatch.setattr(exact_dedup, "COMPARE", 3)
    rows = [(1, "abcdefgh"), (2, "abcdefgX"), (3, "abXdefgh"), (4, "abcdefgh"), (4, "abXdefgX"), (None, "abXdefgX"), (7, "abXdefgX")]
    d = docs(rows)
    members = exact_dedup.fingerprints(d).withColumn("f1", F.lit(0).cast("long")).withColumn("f2", F.lit(0).cast("long")).distinct()
    got = {(r["doc_id"], r["text_sha256"]): r["class"] for r in exact_dedup.classes(d, members).collect()}
    by = {(i, t): got[i, hashlib.sha256(t.encode()).hexdigest()] for i, t in rows}
    assert all((x == y) == (a[1] == b[1]) for a, x in by.items() for b, y in by.items())


def test_huge_texts_are_hashed_in_parts(docs, monkeypatch):
    rows = [(1, "ab  c" * 200), (2, "ab c" * 200), (3, "short"), (3, "ab c" * 200), (None, "ab c" * 200), (5, None), (6, "x" * 500), (6, "x" * 500), (7, " " * 300)]
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(map(tuple, exact_dedup.all_fingerprints(docs(rows)).collect()), key=key)
    whole = sorted(map(tuple, exact_dedup.exact_dedup(docs(rows)).collect()), key=key)
    monkeypatch.setattr(exact_dedup, "HUGE", 64)
    assert sorted(map(tuple, exact_dedup.all_fingerprints(docs(rows)).collect()), key=key) == want
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs(rows)).collect()), key=key) == whole


# --- secrets

ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def weak_spans(t, scope):
    """Every pair of parts is looked at."""
    kinds = {"ident": re.compile(r"\b(?:access_key_id|client_id|user_?name|login|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", re.I | re.A), "opaque": re.compile(secrets.OPAQUE), "endpoint": re.compile(secrets.ENDPOINT)}
    base = base_spans(t)
    weak = [(m.start(), 3 + k, m.end(), kind) for k, (kind, rx) in enumerate(kinds.items()) for m in rx.finditer(t)]
    every = base + weak

    def near(s, part):
        return any(secrets.PART[o[3]] == part and (o[2] <= s[0] <= o[2] + scope or s[2] <= o[0] <= s[2] + scope) for o in every)

    need = {"ident": "s", "opaque": "a", "endpoint": "as"}
    kept = [s for s in weak if all(near(s, p) for p in need[s[3]])]
    return [s for s in kept if not any(b[0] < s[2] and s[0] < b[2] for b in base)]


def secret_texts():
    rnd = random.Random(11)
    part = lambda: rnd.choice(
        [
            "AKIA" + "".join(rnd.choice("ABC123") for _ in range(rnd.randint(10, 18))), "password = " + "x" * rnd.randint(8, 16), "token: password: abcdefghijklmnop", "deadbeef" * rnd.randint(1, 3), "login=bob.smith",
            "Zx9" + "".join(rnd.choice("abcXYZ019") for _ in range(rnd.randint(18, 30))), "https://db.example.com:5432", "client_id: 'abc123'", "ü漢" * 3, "API_KEY=\"AbCdEfGhIjKl\"", "word " * rnd.randint(1, 120),
        ]
    )
    return [" ".join(part() for _ in range(rnd.randint(1, 12))) for _ in range(150)]


def test_secrets(docs):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(secret_texts())), (99, "pass token=deadbeefdeadbeefdeadbeef"), (99, "other")]
    got = secrets.secret_spans(docs(rows)).collect()
    assert len(got) == len(rows)
    listed = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))
    want = sorted(((i is None, i or 0), listed(base_spans(t or "") + weak_spans(t or "", secrets.SCOPE)), hashlib.sha256(listed(base_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["spans"], r["base_sha256"]) for r in got) == want
    assert sum(r["n_weak"] for r in got) > 30 and any("endpoint" in r["spans"] for r in got)
    assert sum(r["n_assign"] for r in got) == sum(len([s for s in base_spans(t or "") if s[1] == 0]) for _, t in rows)
    assert secrets.secret_spans(docs([])).collect() == []


def links_by_brute_force(t, scope):
    """Of each reported weak span its partners, as listed, and how many parts complete it."""
    kinds = {"ident": re.compile(r"\b(?:access_key_id|client_id|user_?name|login|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", re.I | re.A), "opaque": re.compile(secrets.OPAQUE), "endpoint": re.compile(secrets.ENDPOINT)}
    every = base_spans(t) + [(m.start(), 3 + k, m.end(), kind) for k, (kind, rx) in enumerate(kinds.items()) for m in rx.finditer(t)]
    name = lambda s: f"{s[3]}:{s[0]}:{s[2]}"
    count, pairs = 0, []
    for s in sorted(weak_spans(t, scope)):
        for part in {"ident": "s", "opaque": "a", "endpoint": "as"}[s[3]]:
            near = [(s[0] - o[2], -1, o) for o in every if secrets.PART[o[3]] == part and o[2] <= s[0] <= o[2] + scope]
            near += [(o[0] - s[2], 1, o) for o in every if secrets.PART[o[3]] == part and s[2] <= o[0] <= s[2] + scope]
            count += len(near)
            pairs.append(f"{name(s)}<{name(min(near)[2])}")
    return count, ",".join(pairs)


def test_partners_of_weak_parts(docs):
    rows = list(enumerate(secret_texts()))
    got = {r["doc_id"]: (r["n_links"], r["partners"]) for r in secrets.secret_spans(docs(rows)).collect()}
    assert got == {i: links_by_brute_force(t, secrets.SCOPE) for i, t in rows} and sum(n for n, _ in got.values()) > 50


def test_sums_in_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, [rnd.randint(0, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 3, 4, 5, 16, 17, 70))]
    df = spark.createDataFrame(rows, "i long, a array<int>")
    monkeypatch.setattr(secrets, "BLOCK", 4)
    for levels in (0, 1, 2):
        got = {r["i"]: r["s"] for r in df.select("i", secrets.running(F.col("a"), levels).alias("s")).collect()}
        assert got == {i: [sum(a[:k]) for k in range(len(a))] for i, a in rows}


def test_a_very_long_text_takes_linear_time(docs):
    unit = "user login=bob.smith password = abcdefghijklmnop and AKIAABCDEFGHIJKLMN "
    n = 10_000_000 // len(unit)
    (r,) = secrets.secret_spans(docs([(1, unit * n)])).collect()
    assert (r["n_assign"], r["n_weak"]) == (n, n) and r["spans"].count(",") == 3 * n - 1
    assert r["partners"].endswith(f"assign:{len(unit) * (n - 1) + 21}:{len(unit) * (n - 1) + 48}")


def test_opaque_runs_show_their_classes_anywhere(docs):
    tails = ["A1", "1A", "Aa", "11", "A1==", "A1==="]
    runs = ["x" * 300 + t for t in tails] + ["X" * 300 + "1-" * 150 + "x", "x1" * 5000 + "A", "x" * 1_000_000 + "A1"]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(docs([(i, f"login=bob {t}") for i, t in enumerate(runs)])).collect()}
    want = {i: f"ident:0:9,opaque:10:{10 + len(t)}" if i not in (2, 3, 5) else "" for i, t in enumerate(runs)}
    assert got == want


def test_a_weak_part_alone_is_not_reported(docs):
    alone = [(1, "login=bob"), (2, "https://a.example.com"), (3, "Zx9abcXYZ019abcXYZ019abcXYZ"), (4, "login=bob " + "w " * 300 + "password=abcdefghijkl")]
    assert all(r["n_weak"] == 0 for r in secrets.secret_spans(docs(alone)).collect())


# --- nearest neighbours


def test_nearest_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((300, 16)).round(2)
    x[10:40] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (1200, [math.inf] * 16), (1250, [1.0] * 3), (None, [1.0] * 16), (50, x[50].tolist())]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, part int")
    got = ann.nearest(df).collect()
    want = []
    for q in range(0, 300, 50):
        s = sorted((-ann.cosine(x[q], x[j]), j) for j in range(300) if j != q)[:5]
        want += [(q, k + 1, j, -d) for k, (d, j) in enumerate(s)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert ann.nearest(df.where("vec_id in (0, 1, 2)")).count() == 2 and ann.nearest(df.limit(0)).count() == 0


def test_repeated_neighbours_take_one_place(spark):
    x = np.random.default_rng(4).standard_normal((40, 8))
    x[7] = x[0] + 0.01
    # the nearest id five times with one vector, the next with several vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 5 + [(8, (x[0] + 0.02 * (i + 1)).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -2), ann.cosine(x[0], np.array(v)))
    want = [(k + 1, i, s) for k, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda p: (-p[0], p[1]))[:5])]
    assert [i for _, i, _ in want[:2]] == [7, 8]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, every=100).collect()) == want
    # in one block, without the merge before
    ids, v = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert sorted((-s, j) for _, j, s in ann.best(np.array([0]), x[:1], ids, v, 5)) == [(-s, i) for _, i, s in want]


@pytest.mark.parametrize("most_parts", [256, 4])
def test_recall_through_learned_parts(spark, monkeypatch, most_parts):
    """In one level of 16 parts, and in 4 parts that are divided again."""
    monkeypatch.setattr(ann, "MOST_PARTS", most_parts)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "MOST_QUERIES", 10)
    rnd = np.random.default_rng(8)
    centers = rnd.standard_normal((12, 16))
    x = centers[rnd.integers(0, 12, 3000)] + 0.5 * rnd.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, most_fit=1500).collect()}
    u = ann.unit(x)
    s = u[::50] @ u.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -2
    want = {(50 * q, int(j)) for q, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    assert len(got) == 300 and len(got & want) / 300 >= 0.9
    good = ann.reliable(ann.usable(df))
    model = ann.fit(good, 3000, most_fit=1500)
    assert (len(model.below) > 0) == (most_parts == 4) and 8 <= model.parts <= 20 and 2 * model.probes < model.parts
    order = model.order(x[:100])
    assert (order[:, 0] == model.home(x[:100])).all() and all(sorted(o) == list(range(model.parts)) for o in order.tolist())


def test_parts_grow_with_the_root():
    assert [ann.parts_of(n) for n in (0, 3, 4, 500, 50_000, 10**9, 10**12)] == [1, 1, 2, 4, 64, 8192, 262144]


def test_parts_are_balanced():
    x = ann.unit(np.random.default_rng(1).standard_normal((512, 8)))
    assert np.bincount(ann.balanced_parts(ann.neighbours(x, x, 6, np.arange(512)), 8)).tolist() == [64] * 8


# --- tokens


def test_token_output(docs, spark, tmp_path):
    end = "<|endoftext|>"
    rows = [*ODD, (11, "don't  stop\tnow,, (really)... 12,000 x_y"), (12, "word " * 3000 + "end."), (13, "a.b, c! \n\nd"), (14, end), (15, f"{end} a {end}{end}\nb{end}c d{end}"), (16, end[:-1] + " |> <| endoftext")]
    got = token_output.token_output(docs(rows), str(tmp_path / "t")).collect()
    tok = tokenizers.Tokenizer.from_file(token_output.tokenizer_path())
    assert tok.encode(end, add_special_tokens=False).ids == [50256]
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.token_output(docs([])).collect() == []
    # small segments, any of whose tokens can be read by itself
    token_output.write_tokens(docs(rows), str(tmp_path / "u"), segment=50)
    blobs = [bytes(r["blob"]) for r in spark.read.parquet(str(tmp_path / "u")).collect()]
    assert len(blobs) > 3
    for s in map(dac.Segment, blobs):
        every = np.concatenate([s.document(k) for k in range(s.n_docs)])
        assert [s.token(i) for i in range(0, s.n_tokens, 7)] == every[::7].tolist()
    # and by its place among all, from either folder
    every = [i for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")) for i in [*tok.encode(t or "", add_special_tokens=False).ids, 2]]
    places = [0, 1, len(every) - 1, *range(5, len(every), 500)]
    for folder in "tu":
        assert token_output.read_at(spark, str(tmp_path / folder), places) == [every[p] for p in places]
    assert token_output.read_token(spark, str(tmp_path / "u"), 17) == every[17] and token_output.read_at(spark, str(tmp_path / "u"), []) == []
    with pytest.raises(IndexError):
        token_output.read_at(spark, str(tmp_path / "u"), [3, len(every)])


def test_codes_lie_in_the_files_as_they_are(docs, tmp_path):
    """A segment's bytes are in the file in one piece, uncompressed, each in a page of its own."""
    token_output.write_tokens(docs([(i, f"text number {i} " * 50) for i in range(40)]), str(tmp_path / "t"), segment=100)
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    for f in files:
        data = f.read_bytes()
        blobs = pq.read_table(f)["blob"].to_pylist()
        assert len(blobs) > 3 and all(b in data for b in blobs)


def test_codes_round_trip():
    rnd = np.random.default_rng(6)
    ids = rnd.integers(0, 2**32, 3000, dtype=np.uint32) >> rnd.integers(0, 32, 3000, dtype=np.uint32)
    s = dac.Segment(dac.pack([5, None, 7], [1000, 0, 2000], ids))
    assert [s.token(i) for i in range(3000)] == ids.tolist() and s.doc_ids == [5, None, 7] and len(s.document(1)) == 0
    for a, b in ((0, 0), (3, 9), (511, 513), (700, 2999), (0, 3000)):
        assert (s.slice(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        s.token(3000)
    with pytest.raises(ValueError):
        dac.Segment(b"x" * 40)


def test_unit_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 20)
    rnd = random.Random(4)
    enc = token_output.UnitEncoder(token_output.tokenizer_path())
    plain = tokenizers.Tokenizer.from_file(token_output.tokenizer_path())
    texts = ["".join(rnd.choice([*"ab cd.,'s\n\t  é²1—_", "<|endoftext|>", "<|", "|>"]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_sentencepiece_is_the_library(docs, spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    enc = sentencepieces.encoder(sentencepieces.model_path())
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdefghiétnrsoab  \n.▁thein漢") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += [" " * k + w for k in range(70) for w in ("", "x", "the", "漢", " the", "\n  the", "▁")]
    texts += ["".join(rnd.choice(["  ", "   ", " ", "the", "a", "漢", "\n", "▁", " " * 13]) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts += ["a" * 30, " " * 17 + "x", "Internationalization of tokenizers", "\x00", "<s> <0x41>", "\n \n"]
    for t, ids in zip(texts, enc.encode(texts)):
        want = lib.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert enc.decode(ids).decode() == lib.decode(want), t
    rows = sentencepieces.encode_documents(docs(ODD), with_ids=True).collect()
    assert len(rows) == len(ODD)
    text_of = dict(ODD)
    for r in rows:
        assert r["ids"] == lib.encode(text_of[r["doc_id"]] or "") and r["round_trip"] and r["text_crc32"] == zlib.crc32((text_of[r["doc_id"]] or "").encode())
    assert sentencepieces.encode_documents(docs([])).collect() == []


def test_suffix_array_finds_every_occurrence():
    enc = sentencepieces.encoder(sentencepieces.model_path())
    text = "▁the▁internal▁thing"
    at, which = enc.edges(np.concatenate((enc.table[[ord(c) for c in text]], np.zeros(1, np.uint16))))
    got = {(int(a), enc.model.pieces[enc.piece_ids[w]]) for a, w in zip(at, which)}
    assert got == {(i, text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in enc.model.ids}


# --- toxicity and language


def learnable(n=600):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = words(rnd, rnd.randint(5, 60))
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(2):
                w[rnd.randrange(len(w))] = rnd.choice(["grumblefax", "snorkwit", "blathershin"]) + rnd.choice(["", ".", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(docs, spark):
    rows, labels = learnable()
    odd = [(None, "null id"), (9001, None), (9002, ""), (9003, "grumblefax snorkwit " * 50), (9003, "same id")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs([*rows, *odd]), lab).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    none = toxicity.toxicity(docs(rows[:5]), lab.limit(0)).collect()
    assert len(none) == 5 and {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(docs([]), lab).collect() == []


def test_features_see_through_disguise():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d10t and a l.o.s.e.r! STUUUPID YOU", toxicity.SEED_LEXICON, frozenset())))
    assert f["hidden_log"] > 0 and f["you_rate"] > 0 and f["shouted"] > 0
    near = dict(zip(toxicity.FEATURES, toxicity.features("you idiot", toxicity.SEED_LEXICON, frozenset())))
    far = dict(zip(toxicity.FEATURES, toxicity.features("you " + "word " * 50 + "idiot", toxicity.SEED_LEXICON, frozenset())))
    assert near["near_you"] > far["near_you"] > 0 and not any(toxicity.features("", frozenset(), frozenset()))


def test_boosting_and_isotonic():
    rnd = np.random.default_rng(0)
    x = rnd.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.Boosted(rounds=60).fit(x, y, np.ones(800))
    assert ((m.margin(x) > 0) == (y == 1)).mean() > 0.97
    s, p = boosting.isotonic(np.array([1, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(p) >= 0).all() and np.interp(2.5, s, p) == 0.5 and p[-1] == 1


SAMPLES = {"en": "the people of this town and their houses were what they had thought", "de": "die leute und ihre schönen häuser waren nicht das was sie gedacht hatten", "fr": "les gens de cette ville et leurs maisons étaient ce que nous avions pensé"}


def test_language(docs):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        lang = rnd.choice(list(SAMPLES))
        w = SAMPLES[lang].split()
        rows.append((i, " ".join(rnd.choice(w) for _ in range(rnd.randint(8, 40))), "s", lang))
    odd = [(None, "die schönen häuser"), (901, None), (902, "12 %%% "), (903, ""), (904, "the people")]
    d = docs([*rows, *odd]).withColumn("lang", F.when(F.col("doc_id") < 900, F.col("lang")))
    got = language_id.language_id(d).collect()
    assert len(got) == 305 and all(0 <= r["score"] <= 1 for r in got)
    truth = {r[0]: r[3] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (901, 902, 903)] == [("und", 0.0)] * 3 and by[904]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"
    left = language_id.known_language_only(d)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in got if r["lang_pred"] != "und"}
    assert language_id.language_id(docs([])).collect() == []
    assert [r["lang_pred"] for r in language_id.language_id(docs([(1, "x")]).withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"]


def test_out_of_place_distance():
    g, n = language_id.count_grams("ab ab, b")
    top = language_id.ranked(g, n, 3).tolist()
    assert [t for t in top][0] == ord("b") and n.tolist()[bisect.bisect_left(g.tolist(), ord("b"))] == 3
    p = language_id.Profiles({"x": top, "y": top[::-1]}, 3)
    # the three most frequent n-grams of the text are x's, in order; y has the outer two swapped
    assert p.distances("ab ab, b").tolist() == [0.0, 4 / 9]


def test_counts_in_pieces(monkeypatch):
    text = "Ünïcode wörds and, more words " * 40
    want = language_id.count_grams(text)
    monkeypatch.setattr(language_id, "PIECE", 37)
    got = language_id.count_grams(text)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_counts_of_a_run_without_spaces_do_not_depend_on_pieces(monkeypatch):
    texts = ["ab" * 5000 + "\u0130ı\u03a3", "x" * 7, "漢字" * 40 + ". a", ". .", ""]
    want = [language_id.count_grams(t) for t in texts]
    for size in (1, 2, 3, 50, 64):
        monkeypatch.setattr(language_id, "PIECE", size)
        for t, (g, n) in zip(texts, want):
            got = language_id.count_grams(t)
            assert (got[0] == g).all() and (got[1] == n).all()


def test_the_sample_of_toxicity_is_bounded_in_bytes(docs, spark, monkeypatch):
    rows, labels = learnable(300)
    rows += [(i, "grumblefax " * 20_000) for i in range(300, 330)] * 2
    labels += [(i, 1, 1) for i in range(300, 330)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "ToxicityModel", lambda texts, toxic, weights: seen.append((sum(map(len, texts)), len(texts), weights)))
    for most in (100_000, 1_000_000, 100_000_000):
        toxicity.fit(docs(rows), lab, most_bytes=most)
    assert all(size <= most for (size, _, _), most in zip(seen, (100_000, 1_000_000, 100_000_000))) and seen[0][1] < seen[1][1] < seen[2][1] and (seen[2][2] == 1).all()


def test_very_long_texts(docs, spark):
    """5 MB of one text, whole: its last words count."""
    long = "plain words " * 400_000
    d = docs([(1, long + "THE end"), (2, "a b")])
    assert {r["doc_id"]: r["size"] for r in mixing.mix(d).collect()} == {1: 800_002, 2: 2}
    assert [r["rule"] for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://a.net/" + "x/" * 2_000_000), (2, "http://" + "a." * 500_000 + "example.com/de/")], "page_id long, url string")).orderBy("page_id").collect()] == ["net/", "example.com/de/"]
    lexicon = frozenset(["moron"])
    assert toxicity.features(long + "you moron", lexicon, frozenset())[toxicity.FEATURES.index("near_you")] == 0.5
    assert exact_dedup.exact_dedup(docs([(1, long), (2, long + " "), (3, long.replace(" ", "\n\t"))])).where("keep_id = 1").count() == 3


# --- mixing


def brute_mix(rows):
    size = lambda t: len(WORDS.findall(t or ""))
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    own = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in names}
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(own.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * own[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * own[s] for s in over}
        left -= sum(3.0 * own[s] for s in over)
        free -= over
    return own, target


def test_mix(docs):
    rnd = random.Random(3)
    rows = [(i, " ".join(words(rnd, rnd.randint(0, 30))), rnd.choices(["a", "b", "é", "z", None, "tiny"], [30, 5, 20, 30, 10, 1])[0]) for i in range(400)]
    rows += [(None, "null id here", "a"), (500, None, "a"), (501, "x", "only"), (502, "", "empty"), (503, "same row", "b"), (503, "same row", "b")]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    own, target = brute_mix(rows)
    for s in own:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == own[s] and r["target"] == pytest.approx(target[s], rel=1e-9) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    assert [tuple(r) for r in got] == [tuple(r) for r in mixing.mix(docs(rows[::-1])).collect()]
    assert mixing.mix(docs([])).collect() == []
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places) and all(len(r["positions"]) == r["copies"] for r in got)


def test_curriculum_moves_documents(docs):
    """One source early, the other late: positions invert the integrated weights."""
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(200)]
    early = ((0.5, (3.0, 1.0)), (1.0, (1.0, 3.0)))
    got = mixing.mix(docs(rows), weights=(1.0, 1.0), phases=early).collect()
    mean = lambda s: sum(r["position"] for r in got if r["source"] == s) / 100
    assert mean("a") < 900 < 1100 < mean("b")
    by = sorted((r for r in got if r["source"] == "a"), key=lambda r: r["position"])
    # source a is consumed three times as fast in the first half: half its tokens are gone after a third of the run
    assert by[50]["position"] == pytest.approx(2000 / 3, rel=0.02)
    with pytest.raises(ValueError):
        mixing.mix(docs(rows), phases=((0.5, (1, 1, 1)),))


def test_mixed_documents(docs):
    rows = [(i, "w " * 4, "a" if i < 90 else "b" if i < 96 else "c") for i in range(100)]
    out = mixing.mixed_documents(docs(rows))
    assert out.columns == docs([]).columns
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs(rows)).collect()}
    got = [r["doc_id"] for r in out.collect()]
    assert {i: got.count(i) for i in taken} == taken and taken[99] == 3 and sum(taken[i] for i in range(90)) == 70


def test_mixed_documents_odd_cases(docs, spark):
    rows = [(None, "null id here", "a"), (1, None, "a"), (2, "", "b"), (3, "x y", None), (3, "x y", None), (4, "one two three", "b"), (5, "one two three", "b")]
    out = mixing.mixed_documents(docs(rows))
    assert out.columns == docs([]).columns and mixing.mixed_documents(docs([])).collect() == []
    got = [r["doc_id"] for r in out.collect()]
    taken = [(r["doc_id"], r["copies"]) for r in mixing.mix(docs(rows)).collect()]
    want = {i: max(n for j, n in taken if j == i) * sum(r[0] == i for r in rows) for i, _ in taken}
    assert {i: got.count(i) for i in want} == want and not {1, 2} & set(got) and None in got


def test_order_of_a_written_mix(docs, tmp_path, spark):
    rows = [(i, "w " * 5, "ab"[i % 2]) for i in range(300)]
    mixed = mixing.mixed_documents(docs(rows), phases=mixing.CURRICULUM)
    want = [r["doc_id"] for r in mixed.collect()]
    mixed.write.option("maxRecordsPerFile", 20).parquet(str(tmp_path / "m"))
    for table in (spark.read.parquet(str(tmp_path / "m")), mixed):
        got = mixing.in_order(table)
        assert got.columns == [*docs([]).columns, "_order"]
        assert [(r["doc_id"], r["_order"]) for r in got.orderBy("_order").collect()] == list(zip(want, range(len(want))))
    assert mixing.in_order(docs([])).collect() == []


# --- urls

URLS = [
    ("http://a.net/x", "net/", "block"), ("http://a.net", None, "allow"), ("https://Example.NET/en/x?q#f", "example.net/en/", "allow"), ("https://w.example.net/en", "net/", "block"), ("http://example.com/de/a", "example.com/de/", "block"),
    ("http://notexample.com/de/a", None, "allow"), ("http://x.org/fr/", "org/fr/", "allow"), ("http://x.org/french", None, "allow"), ("net/", None, "allow"), ("", None, "allow"), (None, None, "allow"), ("a://net/", "net/", "block"),
    ("x://://net/", None, "allow"), ("http://a.net?u=/", None, "allow"), ("http://a.net:80/", None, "allow"), ("http://\u212aa.net/\n", "net/", "block"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, (u, _, _) in enumerate(URLS)] + [(None, "http://a.net/x", "", "")], "page_id long, url string, rule string, host string")
    got = url_filter.judge_urls(df).collect()
    assert [(r["rule"], r["verdict"]) for r in sorted((r for r in got if r["page_id"] is not None), key=lambda r: r["page_id"])] == [u[1:] for u in URLS]
    assert len(got) == len(URLS) + 1 and url_filter.judge_urls(df.limit(0)).collect() == []


def test_trie_is_longest_match():
    rnd = random.Random(6)
    label = lambda n: ".".join(rnd.choice("ab") for _ in range(rnd.randint(1, n)))
    path = lambda: "/" + "".join(rnd.choice(["a/", "b", "c/", ""]) for _ in range(rnd.randint(0, 4)))
    rules = [(rnd.choice(["allow", "block"]), label(3), path()) for _ in range(40)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    trie = url_filter.UrlTrie(rules)
    for _ in range(500):
        h, p = label(5), path()
        fit = [(len(rh), len(rp), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        want = max(fit, default=(0, 0, None, None))
        assert trie.find(h, p) == (want[2], want[3])


def test_sides_are_broadcast_by_rows_and_bytes(spark):
    marked = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().analyzed().toString()
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "i long, s string")
    assert marked(common.small_side(df)) and not marked(common.small_side(df, most=49)) and not marked(common.small_side(df, most_bytes=5000))
    assert marked(common.small_side(df.limit(0)))


def test_checkpoints_go_where_the_session_says(spark):
    assert common.shared_folder(spark).startswith("file:") and spark.conf.get("spark.checkpoint.dir") in common.shared_folder(spark)
