"""The operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import byte_bpe, jaccard_join, language_id, license_scan, perfect_hash, quality
from tickloom.llm.components import connected_components
from tickloom.llm.decontaminate import MASKS, SHORT_MASKS, best_leak, diagonals, find_leaks, longest_stretch
from tickloom.llm.embedding_dedup import embedding_components, plan_tables
from tickloom.llm.jaccard_join import Classes, jaccard_components, least_difference, parity_sketch
from tickloom.llm.line_dedup import line_dedup
from tickloom.llm.substring_dedup import substring_dedup
from tickloom.llm.url_filter import DEFAULT_RULES, Rule, filter_urls, site_rule
from tickloom.llm.words import ALNUM, cut

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("Ka", "lo", "mi", "É", "ß") for b in ("x", "yy", "z", "ng")]
    shared = ["This line stands in several documents here.", "  this LINE stands in several documents here.\t", "short", "Another shared line of some length."]
    passage = " ".join(f"p{i}" for i in range(30))
    out: list[tuple[int | None, str | None]] = [(None, shared[0]), (0, None), (1, ""), (2, " \n\t"), (3, LONG), (4, LONG)]
    for i in range(5, 45):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 4))]
        lines += rng.sample(shared, rng.randint(0, 3))
        if i % 4 == 0:
            lines.append(passage + " " + passage)
        out.append((i, "\n".join(lines)))
    out += [(50, out[10][1]), (51, out[10][1] + " one more"), (52, out[20][1].replace("Kax", "Kaq", 1)), (53, "a b"), (54, "A  b"), (55, "solo")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string, doc int").repartition(5)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_line_dedup(docs):
    keys: dict[str, set] = {}
    rows = texts()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    order = lambda i: -1 if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                keys.setdefault(key(line), set()).add(order(i))
    want = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(keys.get(key(x), ())) >= 3 and max(keys[key(x)]) != order(i))]
        want[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "doc", "n_lines", "n_dropped"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    assert got == want and sum(x[1] for x in want.values()) > 20
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup(df).collect()] == [0, 0, 0]
    df = df.unionAll(spark.createDataFrame([(3, line + "\n" + line)], df.schema))
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 0)]


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    k = np.array(sorted(keys), dtype=np.uint64)
    sizes, bits = perfect_hash.build(k)
    assert sorted(perfect_hash.index(sizes, bits, k).tolist()) == list(range(len(k)))


CODEC = byte_bpe.Codec(byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encode():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={}).encode_ordinary


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "th", "the", "ing", " ", "  ", "\n", "'", "'re", "r", "e", "1", "é", "漢", "!", "=", "😀", "\t "]), max_size=40).map("".join) | st.text(max_size=40))
def test_bpe_equals_tiktoken_with_tiny_leaves(text):
    import tiktoken

    small = (byte_bpe.LEAF_CHARS, byte_bpe.LEAF_BYTES)
    byte_bpe.LEAF_CHARS, byte_bpe.LEAF_BYTES = 5, 3
    try:
        codec = byte_bpe.Codec(CODEC.ranks, public_tokenizers.PATTERN)
        ids = codec.encode(text)
        assert codec.decode(ids) == text.encode()
    finally:
        byte_bpe.LEAF_CHARS, byte_bpe.LEAF_BYTES = small
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
    assert ids.tolist() == enc.encode_ordinary(text)


def test_bpe_on_long_runs_and_tables(docs, tiktoken_encode):
    for t in ("a" * 20_000, "ab" * 7000, " " * 9000 + "x", "=" * 10_000, "qxz" * 5000):
        assert CODEC.encode(t).tolist() == tiktoken_encode(t)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    for r in out.collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == tiktoken_encode(r.text or "") and r.n_tokens == len(r.ids) // 4
        assert bytes(r.decoded) == (r.text or "").encode()
    again = byte_bpe.bpe_decode(out.drop("decoded"), path, public_tokenizers.PATTERN)
    assert again.where("decoded <> cast(coalesce(text, '') as binary)").count() == 0
    assert byte_bpe.bpe_encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_joins_run_on_the_query_s_texts(spark):
    """What the query encodes is reduced up the tree: pieces and texts are joined from leaves, not encoded at once."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    codec = byte_bpe.Codec(CODEC.ranks, public_tokenizers.PATTERN)
    pieces = sum(len(codec.pieces(r.text or "")[0]) for r in rows)
    assert codec.joins[0] > len(codec.packed) / 2 and codec.joins[1] > len(rows) and pieces > codec.joins[0]


def brute_substrings(rows, window=20):
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return want


def test_substring_dedup(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(docs).collect()}
    want = brute_substrings(texts())
    assert got == want and sum(x[1] for x in want.values()) > 30_000


def test_substring_dedup_short_windows_repeats_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_substrings(rows, 8)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(df, window=8, base=4).collect()} == want
    t = " ".join(f"u{i}" for i in range(25))
    twice = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(twice).collect()) == [(1, 0), (1, 0), (2, 25)]
    assert substring_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(df, window=20, base=6)


def brute_licenses(rows, templates):
    """Every template compared with every place of every file."""
    import math

    every = [*((label, p, p, True) for p, label in license_scan.BASE_PHRASES.items()), *((t.label, t.text, t.key, False) for t in templates)]
    files = [words_of(t) for _, t in rows]
    idf = {w: math.log(1 + len(files) / (1 + sum(w in f for f in files))) for _, text, *_ in every for w in words_of(text)}
    out = []
    for f in files:
        places, base, labels, score = [], set(), set(), 0.0
        for label, text, key, is_base in every:
            w, k = words_of(text), words_of(key)
            at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            for p in range(len(f) - len(k) + 1):
                if f[p : p + len(k)] != k:
                    continue
                share = sum(idf[x] for i, x in enumerate(w) if 0 <= p - at + i < len(f) and f[p - at + i] == x) / sum(idf[x] for x in w)
                if is_base:
                    places.append(p)
                    base.add(label)
                    labels.add(label)
                else:
                    score = max(score, share)
                    labels |= {label} if share >= license_scan.LABEL_SCORE - 1e-9 else set()
        out.append((len(f), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(min(score, 1.0), 9)))
    return out


def test_license_scan_against_brute_force(spark):
    from tickloom.llm.license_texts import TEMPLATES

    rng = random.Random(6)
    texts_ = ["Released under the MIT License.", None, "", "gnu GNU General Public License cc by CC-BY", "mit. license; apache\nlicense", "Gnu general public licence", "cc bye " * 2000 + "cc by", "mit license " * 3000, "the of and to in " * 50]
    for t in TEMPLATES:
        w = t.text.split()
        texts_ += [t.text, "// " + t.text.upper() + " tail", " ".join(w[3:]), " ".join(w[:-3]), t.key, " ".join("zzz" if rng.random() < 0.15 else x for x in w), t.text + "\n" + rng.choice(TEMPLATES).text]
    rows = list(enumerate(texts_))
    df = spark.createDataFrame([(i, t, 5.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in license_scan.scan_licenses(df).collect()}
    want = brute_licenses(rows, TEMPLATES)
    for (i, t), w in zip(rows, want, strict=True):
        assert got[i] == w, t
    assert sum(w[5] != w[4] for w in want) > 80
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(df, templates=(license_scan.Template("x", "some words", "others"),))


def test_license_plan_does_not_grow_with_templates(spark):
    from tickloom.llm.license_texts import TEMPLATES

    df = spark.createDataFrame([(1, "Released under the MIT License notice3."), (2, "x")], "doc_id long, text string")
    many = tuple(license_scan.Template(f"{t.label}-{k}", f"{t.text} notice{k}", t.key) for k in range(20) for t in TEMPLATES)
    plans = []
    for templates in (TEMPLATES[:10], many):
        out = license_scan.scan_licenses(df, templates=templates)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(many) > 500 and plans[1] < 1.1 * plans[0]
    assert {r.doc_id: "mit-3" in r.labels.split(",") for r in out.collect()} == {1: True, 2: False}


def brute_components(sets: dict, linked) -> dict:
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(t: str | None, n: int) -> frozenset:
    w = WORDS.findall((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent", "few_pairs"), [(4, 85, 20_000_000), (2, 60, 20_000_000), (2, 60, 0)])
def test_jaccard_components(spark, monkeypatch, n, percent, few_pairs):
    """few_pairs 0: members are drawn until the turns are over, and blocks compare the rest."""
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", few_pairs)
    monkeypatch.setattr(jaccard_join, "MOST_TURNS", 2)
    rng = random.Random(n)
    base = [[f"v{rng.randint(0, 60)}" for _ in range(rng.randint(4, 40))] for _ in range(25)]
    rows = texts()[1:] if n == 4 else []
    for k in range(120):  # chains and near copies
        w = list(base[k % 25])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 60)}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t, n) for i, t in rows}
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)
    want = brute_components(sets, link)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, n=n, percent=percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets} and any(want[i] != i for i in want)


def test_jaccard_repeated_and_null_ids(spark):
    a = "one two three four five six seven"
    df = spark.createDataFrame([(None, a), (None, a), (1, a), (2, a.upper()), (2, None), (3, "other words here entirely apart from those")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(df, n=4, percent=85).collect()}
    assert got == {None: None, 1: None, 2: None, 3: 3}
    assert jaccard_components(df.limit(0)).count() == 0


def test_jaccard_links_every_text_of_an_id(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve", "apart from all other words")
    rows = [(None, a), (None, b), (None, c), (None, c), (7, b), (7, a), (7, ""), (7, None), (9, c), (9, "x y z u v"), (3, "X y z u  v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_components(df, n=4, percent=85).collect())
    assert got == sorted([(-1, 4, -1), (-1, 2, -1), (-1, 2, -1), (7, 2, -1), (7, 4, -1), (7, 0, 7), (7, 0, 7), (9, 2, -1), (9, 2, 3), (3, 2, 3)])


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80))
def test_sketches_never_exceed_the_difference(a, b):
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    assert least_difference(parity_sketch(x), parity_sketch(y)) <= len(a ^ b)
    assert least_difference(parity_sketch(x), parity_sketch(x)) == 0


def test_classes_leave_room_for_every_difference():
    c = Classes(85, 5000)
    for k, (low, high) in enumerate(zip(c.low, c.low[1:], strict=False)):
        worst = max((m + high - 1 - 2 * (-(-85 * (m + high - 1) // 185)) for m in range(int(low), int(high))), default=0)
        assert c.fragments[k] > worst + c.spare[k] - 1 and c.fragments[k] - c.spare[k] > worst


def test_embedding_components(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = []
    for i in range(150):
        v = centres[i % 30] + 0.15 * rng.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, rows[0][1][:8], 0), (206, rows[3][1], None), (207, [], 0), (208, [None] + rows[0][1][1:], 0), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(i, v, label, 9) for i, v, label in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(4)

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    items = {(-1 if i is None else i): (unit(v), label) for i, v, label in rows}
    link = lambda a, b: a[0] is not None and b[0] is not None and a[1] == b[1] and a[1] is not None and len(a[0]) == len(b[0]) and a[0] @ b[0] >= 0.93
    want = brute_components(items, link)
    got = {(-1 if r.vec_id is None else r.vec_id): r for r in embedding_components(df).collect()}
    assert set(got) == set(items)
    n = {k: sum(link(items[k], items[j]) for j in items if j != k) for k in items}
    found = sum(r.n_links for r in got.values())
    assert all(got[k].n_links <= n[k] for k in items) and found >= 0.9 * sum(n.values()) > 0
    if found == sum(n.values()):
        assert {k: (-1 if r.component_id is None else r.component_id) for k, r in got.items()} == want
    assert all(got[k].kept == (got[k].component_id == got[k].vec_id) for k in got)
    assert embedding_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 40])
def test_embedding_recall_at_the_threshold(spark, monkeypatch, block):
    """Pairs planted at a cosine of 0.93 to 0.94, many labels' worth of buckets, large buckets cut into blocks."""
    from tickloom.llm import embedding_dedup as E

    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "BUCKET_VECTORS", 40)
    rng = np.random.default_rng(8)
    n, dim, rows = 600, 32, []
    for k in range(n):
        u, w = rng.standard_normal(dim), rng.standard_normal(dim)
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        c = rng.uniform(0.9301, 0.94)
        v = c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)
        rows += [(2 * k, u.astype(np.float32).tolist(), k % 2), (2 * k + 1, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), k % 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in embedding_components(df).collect()}
    found = sum(got[2 * k + 1].component_id <= 2 * k for k in range(n)) / n
    assert found >= 0.9 and plan_tables(n, 0.93)[0] >= 4
    m = np.array([r[1] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = ((m @ m.T >= 0.93) & (label[:, None] == label[None, :])).sum(1) - 1
    assert all(got[i].n_links <= links[i] for i in range(2 * n)) and sum(r.n_links for r in got.values()) >= 0.9 * links.sum()


def test_components_of_a_long_path(spark):
    n = 70
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (502, 502)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 500: 500, 501: 500}


def test_url_filter(spark):
    rules = [site_rule("allow", "com", "/"), site_rule("block", "example.com", "/en/"), site_rule("allow", "www.example.com", "/en/"), site_rule("block", "net", "/es/"), Rule("any", "block", r"\.exe$", ()), *DEFAULT_RULES]
    urls = {
        "http://A.EXAMPLE.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/?q#f": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "ftp://casino-win.org/a": ("casino-win.org", "/a", None, "block"),
        "ftp://casinos.org/a": ("casinos.org", "/a", None, "allow"),
        "http://a.net/es/b://c": ("a.net", "/es/b://c", "net/es/", "block"),
        "http://a.org/b.exe?x": ("a.org", "/b.exe", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://é.net/ES/": ("é.net", "/ES/", None, "allow"),
        "http://h\nx.net/es/\ny": ("h\nx.net", "/es/\ny", "net/es/", "block"),
    }
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, *urls])], "page_id long, url string, rule string")
    out = filter_urls(df, rules)
    assert out.count() == 2 * len(urls)
    for r in out.collect():
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r.url
    assert filter_urls(df.limit(0), rules).count() == 0


def test_quality_network_covers_whole_texts_and_learns(spark):
    good = [f"the quick words of text {i} stand here " * 20 for i in range(60)]
    bad = [f"!!$$ ||| %%% {i} ### " * 30 for i in range(60)]
    net = quality.learn([x.encode() for x in good[:40] + bad[:40]], [1] * 40 + [0] * 40)
    p = lambda t: float(net.probability(net.combined(quality.chunk_peaks(net, np.frombuffer(t.encode(), np.uint8)))))
    assert all(p(t) > 0.5 for t in good[40:]) and all(p(t) < 0.5 for t in bad[40:])
    rng = np.random.default_rng(0)
    for n in (0, 1, 505, 506, 507, 512, 513, 5000, 200_000):  # blocks and chunks against the plain definition
        data = rng.integers(0, 256, n, dtype=np.uint8)
        r = net.responses(quality.byte_pairs(data))
        want = np.stack([r[s : s + quality.CHUNK].max(0) for s in quality.chunk_starts(len(r))])
        assert (quality.chunk_peaks(net, data) == want).all() and quality.chunk_starts(len(r))[-1] + quality.CHUNK >= len(r)
    df = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, LONG, 3.0), (4, "x", None)], "doc_id long, text string, score double")
    rows = {r.doc_id: r for r in quality.score_quality(df, net).collect()}
    assert rows[1].score == rows[2].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert quality.score_quality(df.limit(0), net).count() == 0
    empty = quality.learn_quality(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score_quality(df, empty).collect()} == {0.5}


def test_quality_scores_whole_tables_as_defined(spark):
    """Every score against the plain definition: all chunks of the whole text, their largest responses, one layer."""
    net = quality.learn([b"good words stand here " * 9] * 8 + [b"$$ ## !! %% " * 9] * 8, [1] * 8 + [0] * 8)
    df = spark.createDataFrame([(i, t) for i, t in texts()], "doc_id long, text string").repartition(4)

    def plain(t: str | None) -> float:
        r = net.responses(quality.byte_pairs(np.frombuffer((t or "").encode(), np.uint8)))
        peaks = np.stack([r[s : s + quality.CHUNK].max(0) for s in range(0, max(1, len(r) - (quality.CHUNK - quality.STRIDE)), quality.STRIDE)])
        h = np.tanh(peaks)
        z = np.concatenate([h.mean(0), h.max(0), h.min(0)]) @ net.weights + net.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    got = {(r.doc_id, r.text): (r.score, r.predicted) for r in quality.score_quality(df, net).collect()}
    assert len(got) == len(texts())
    for (i, t), (score, predicted) in got.items():
        assert score == pytest.approx(plain(t), abs=1e-6) and predicted == int(score >= 0.5), i


def test_learning_takes_stretches_of_long_texts(spark, monkeypatch):
    """A label or language that has long texts alone is learned all the same."""
    long_good, long_bad = "calm words stand in order here " * 3000, "$$$ ### !!! %%% " * 5000
    docs = spark.createDataFrame([(i, (long_good if i % 2 else long_bad) + str(i)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda texts, y: seen.append((texts, y)))
    quality.learn_quality(docs, labels, chars=500)
    assert set(seen[0][1]) == {0, 1} and {len(t) for t in seen[0][0]} == {500} and len(seen[0][0]) > 15
    monkeypatch.setattr(language_id, "learn", lambda texts, names: seen.append((texts, names)))
    language_id.learn_languages(docs.withColumn("lang", docs.doc_id % 2), chars=700)
    assert set(seen[1][1]) == {"0", "1"} and {len(t) for t in seen[1][0]} == {700}


def test_many_languages_are_learned(spark):
    rng = random.Random(1)
    rows = [(k * 3 + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('xyz')}" for _ in range(12)), f"l{k:03d}") for k in range(230) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn_languages(df, most_texts=300)
    assert 150 < len(model.languages) <= 300 and len(model.weights) == language_id.slots_for(len(model.languages))
    assert language_id.slots_for(200) == language_id.SLOTS and language_id.slots_for(201) == language_id.SLOTS // 2 and language_id.slots_for(1000) == language_id.SLOTS // 8


def test_chains_see_beyond_what_they_label():
    """A text of several chains is labelled like one chain, but for what CONTEXT words away still weighs."""
    rng = np.random.default_rng(2)
    model = language_id.Chain(["a", "b"], rng.standard_normal((1 << 10, 2)) * 0.6, np.array([[1.0, -1.0], [-1.0, 1.0]]), np.zeros(2))
    words = cut(pa.array([" ".join(f"w{rng.integers(0, 300)}" for _ in range(300)), "one", ""]))
    got = language_id.label_words(model, words)
    slots, first, which = language_id._slots_of(words, 1 << 10)
    whole, _ = model.forward_backward(model.emissions(slots, first)[which[:300]][None], np.array([300]))
    assert np.abs(got[:300] - whole[0]).max() < 0.02 and len(got) == 301


def test_language_field_against_enumeration():
    """Forward-backward equals summing over all label paths."""
    import itertools

    rng = np.random.default_rng(1)
    m = language_id.Chain(["a", "b", "c"], np.zeros((1, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3))
    scores = rng.standard_normal((2, 5, 3))
    got, _ = m.forward_backward(scores, np.array([5, 3]))
    for c, n in ((0, 5), (1, 3)):
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(m.start[path[0]] + sum(scores[c, t, path[t]] for t in range(n)) + sum(m.moves[path[t], path[t + 1]] for t in range(n - 1)))
            for t in range(n):
                total[t, path[t]] += w
        assert np.allclose(got[c, :n], total / total.sum(1, keepdims=True))


def test_language_id_labels_code_switched_text(spark):
    rng = random.Random(4)
    make = {"xx": "ba bo bi", "yy": "ku kel kim", "zz": "sho sher shan"}
    words = {k: [a + b for a in v.split() for b in ("", "na", "tor", "lim", "ver")] for k, v in make.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(["xx", "yy", "zz"] * 60)]
    df = spark.createDataFrame(rows + [(1000, "lost", None), (None, "x", "xx")], "doc_id long, text string, lang string")
    model = language_id.learn_languages(df)
    assert model.languages == ["xx", "yy", "zz"]
    mixed = text("xx", 40) + " " + text("yy", 40)
    p = language_id.label_words(model, cut(pa.array([mixed]), lower=True))
    assert (p[:40].argmax(1) == 0).mean() > 0.9 and (p[40:].argmax(1) == 1).mean() > 0.9
    ask = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, text("zz", 9000)), (5, text("yy", 1)), (6, mixed + " " + text("yy", 20))], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.predict_language(ask, model).collect()}
    assert [rows[i].lang_pred for i in range(1, 7)] == ["und", "und", "und", "zz", "yy", "yy"]
    assert all(0 <= r.score <= 1 for r in rows.values())
    none = language_id.learn_languages(df.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict_language(ask, none).collect()} == {"und"}


def test_masks_find_every_pattern_of_substitutions():
    import itertools

    for n in range(6, 19):
        for wrong in itertools.combinations(range(n), n // 5):
            assert any(all(at + o not in wrong for o in mask) for mask in MASKS for at in range(n - mask[-1]))
    for wrong in range(5):
        assert any(all(at + o != wrong for o in mask) for mask in SHORT_MASKS[5] for at in range(5 - mask[-1]))


def brute_leak(text: list[str], item: list[str], min_words: int = 13, similarity: float = 0.8):
    """(start, words, equal words) by trying every diagonal and every stretch."""
    n, m, best = len(text), len(item), None
    for d in range(1 - m, n):
        start, end = max(0, d), min(n, m + d)
        eq = [text[k] == item[k - d] for k in range(start, end)]
        if sum(eq) < 1 or sum(eq) < 0.8 * min(min_words, m) - 1e-9:
            continue
        found = [(sum(eq), -start, m)] if len(eq) == m and sum(eq) >= similarity * m - 1e-9 else []
        spans = [(e - s + 1, -s, sum(eq[s : e + 1])) for s in range(len(eq)) for e in range(s + min_words - 1, len(eq)) if eq[s] and eq[e] and sum(eq[s : e + 1]) >= similarity * (e - s + 1) - 1e-9]
        if spans:
            length, at, same = max(spans)
            found.append((same, -(start - at), length))
        best = max([*found, *([best] if best else [])], default=None)
    return (-best[1], best[2], best[0]) if best else None


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t: str | None) -> list[str]:
    return WORD.findall((t or "").translate(LOW))


def test_decontaminate(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
    hit = " ".join(item)
    wrong = lambda *at: " ".join("zzz" if i in at else w for i, w in enumerate(item))
    docs = [
        (1, "before it " + hit.upper() + " after"), (2, wrong(3, 9)), (3, wrong(1, 5, 9, 13, 17)), (4, " ".join(item[:12])), (5, " ".join(item[:13])), (6, None), (7, ""),
        (8, hit + " filler " * 5000 + hit), (9, " ".join(reversed(item))), (10, "one two three four five six"), (11, "one two zzz four five six"), (12, "one two zzz zzz five six"), (13, wrong(1, 4, 7, 10, 13, 16)), (None, hit),
        (14, "what is two plus two"), (15, "is two minus two"), (16, "say: red green blue white zzz!"), (17, "zzz green blue white black"), (18, "red green zzz white zzz"), (19, "Solo"), (20, wrong(0, 17)), (None, "solos"),
    ]
    bench = [(7, hit), (8, "one two three four five six"), (9, None), (None, hit), (10, ""), (11, hit), (12, "is two plus two"), (13, "red green blue white black"), (14, "solo"), (15, "!!"), (7, "other words of item seven")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, leaks string, t1 int").repartition(3)
    out = find_leaks(df, spark.createDataFrame(bench, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "t1", "leaks"]
    got = {(r.doc_id, r.text): {x.item_id: (x.start, x.n_words, x.n_equal) for x in r.leaks} for r in out.collect()}
    assert got[(1, docs[0][1])] == {7: (2, 18, 18), 11: (2, 18, 18)} and got[(3, docs[2][1])][7] == (2, 15, 12) and got[(20, wrong(0, 17))][7] == (0, 18, 16)
    assert got[(14, "what is two plus two")] == {12: (1, 4, 4)} and got[(15, "is two minus two")] == {} and got[(19, "Solo")] == {14: (0, 1, 1)}
    assert got[(16, docs[18 - 2][1])] == {13: (1, 5, 4)} and got[(17, docs[19 - 2][1])] == {13: (0, 5, 4)} and got[(18, docs[20 - 2][1])] == {}
    for (i, t), leaks in got.items():
        want: dict = {}
        for item_id, text in bench:
            if item_id is not None and words_of(text) and (leak := brute_leak(words_of(t)[:60], words_of(text))):
                want[item_id] = max(want.get(item_id, leak), leak, key=lambda x: (x[2], -x[0], x[1]))
        assert leaks == want, (i, t)
    assert len(got) == len(docs)
    rng = random.Random(3)
    for _ in range(300):
        eq = np.array([rng.random() < 0.75 for _ in range(rng.randint(1, 40))])
        spans = [(e - s + 1, -s) for s in range(len(eq)) for e in range(s, len(eq)) if eq[s] and eq[e] and eq[s : e + 1].mean() >= 0.8 - 1e-12]
        n, s = max(spans, default=(0, 0))
        assert longest_stretch(eq, 0.8)[:2] == (-s, n)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(df, empty).where("size(leaks) > 0").count() == 0 and find_leaks(df.limit(0), spark.createDataFrame(bench, empty.schema)).count() == 0


def test_decontaminate_finds_all_planted_substitutions(spark):
    """Random texts of few words, so that seeds repeat, with items planted under substitutions: all that brute force finds."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench = [(i, make(rng.choice([1, 2, 3, 4, 5, 6, 9, 13, 16, 20, 30]))) for i in range(40)]
    docs = []
    for i in range(60):
        w = make(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            own = list(rng.choice(bench)[1])
            for _ in range(rng.randint(0, len(own) // 4)):
                own[rng.randrange(len(own))] = "zzz"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((i, w))
    out = find_leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in bench], "item_id long, text string"))
    got = {r.doc_id: {x.item_id: (x.start, x.n_words, x.n_equal) for x in r.leaks} for r in out.collect()}
    want = {i: {k: leak for k, item in bench if (leak := brute_leak(w, item))} for i, w in docs}
    assert got == want and sum(map(len, want.values())) > 100


def test_decontaminate_is_linear_in_repeated_words():
    import time

    rng = random.Random(0)
    same = cut(pa.array(["a " * 20_000, "a " * 9000 + "b " + "a " * 9000, "a b c d e " * 4000]), ALNUM).hashes
    a, b, c = same[:20_000], same[20_000:38_001], same[38_001:]
    began = time.time()
    assert best_leak(a, a, MASKS, 13, 0.8) == (0, 20_000, 20_000) and best_leak(a, b, MASKS, 13, 0.8) == (0, 18_001, 18_000)
    assert best_leak(c, c[:15_000], MASKS, 13, 0.8) == (0, 15_000, 15_000)
    assert time.time() - began < 60
    for _ in range(50):  # by transform and by expansion, the same diagonals
        x, y = (np.array([rng.choice([1, 1, 1, 2]) for _ in range(rng.randint(0, 300))], dtype=np.uint64) for _ in "xy")
        for mask in ((0, 1, 2), (0, 2, 3)):
            fits = lambda v: [tuple(v[p + o] for o in mask) for p in range(len(v) - mask[-1])]  # noqa: B023, E731
            want = {p - q for p, s in enumerate(fits(x)) for q, u in enumerate(fits(y)) if s == u}
            assert set(diagonals(x, y, (mask,)).tolist()) == want


CLASHES = ["__doc", "doc", "__drops", "drops", "survivors", "firsts", "__host", "host_0", "path_0", "best", "__x", "row", "words", "w", "t1", "places", "key", "id", "label_", "Text2"]


def test_columns_of_any_name_stay(spark):
    """Whatever else the rows carry comes back as it was."""
    texts_ = [(i, t, f"http://casino.example/{i}") for i, t in texts()[:4] + texts()[6:20]]
    rows = [(i, t, u, *(k + 0.5 for k in range(len(CLASHES)))) for i, t, u in texts_]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, " + ", ".join(f"`{c}` double" for c in CLASHES))
    bench = spark.createDataFrame([(1, "some item that nobody has")], "item_id long, text string")
    net, model = quality.Network(), language_id.Chain([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    outs = {
        "lines": line_dedup(df), "substrings": substring_dedup(df), "licences": license_scan.scan_licenses(df), "leaks": find_leaks(df, bench), "urls": filter_urls(df, DEFAULT_RULES),
        "quality": quality.score_quality(df, net), "language": language_id.predict_language(df, model), "bpe": byte_bpe.bpe_encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    }
    for name, out in outs.items():
        assert set(df.columns) <= set(out.columns), name
        assert all(r[c] == k + 0.5 for r in out.collect() for k, c in enumerate(CLASHES)), name
        assert out.count() == len(rows), name
    assert license_scan.scan_licenses(df, keep_text=False).columns[: len(df.columns) - 1] == [c for c in df.columns if c != "text"]


def test_written_tables_can_be_removed(spark):
    import os

    from tickloom.llm.shared import CLEANUP, removed, written

    before = spark.conf.get(CLEANUP, "false")
    df = written(spark.range(3), "test")
    assert os.path.isdir(df.written_to) and spark.conf.get(CLEANUP) == before
    removed(df)
    assert not os.path.exists(df.written_to)
