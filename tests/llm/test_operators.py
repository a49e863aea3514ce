"""Each operator on small tables with hard rows, against brute force."""

import hashlib
import re
import textwrap
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from nearplane.llm import _common, components, decontamination, fingerprints, jaccard_join, language_id, license_scan, secret_scan, source_mixing, substring_dedup, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string"  # start clashes with inner names
rng = np.random.default_rng(5)
VOCAB = [f"w{i}" for i in range(60)]
LONG = " ".join(rng.choice(VOCAB, 3000))
BASE = " ".join(f"a{i}" for i in range(120))
ROWS = [
    (0, BASE), (1, BASE), (2, BASE.replace("a60 ", "zz ")), (3, None), (4, ""), (5, "one two"), (6, "One TWO"), (7, LONG), (8, LONG[:9000] + " tail"),
    (9, "x " * 90), (10, "p q\nr\n" + BASE), (11, " ".join(rng.choice(VOCAB, 200))), (12, "été 日本 <|endoftext|> 'll don't\n\n a  b"), (13, "1 2 3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t or ""), "s") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring_dedup(docs, empty):
    seen, want = set(), {}
    for i, t in ROWS:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == want
    assert substring_dedup.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, empty, k, num):
    sets = {}
    for i, t in ROWS:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a] += 1
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs, k, num, 100).collect()}
    assert got == {i: (len(s), root[i], links[i]) for i, s in sets.items()}
    assert jaccard_join.jaccard_join(empty, k, num, 100).count() == 0


def test_one_per_group_repeated_ids(spark):
    other = " ".join(f"b{i}" for i in range(120))
    rows = [(3, BASE), (7, BASE.replace("a60 ", "zz ")), (7, other), (9, other.replace("b60 ", "zz ")), (None, "one two three"), (None, BASE + " end"), (5, None)]
    kept = jaccard_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {tuple(r) for r in kept} == {(None, BASE + " end"), (7, other), (None, "one two three"), (5, None)}
    kept = jaccard_join.one_per_group(spark.createDataFrame(rows[:4], "doc_id long, text string"), 4, 85, 100).collect()
    assert {tuple(r) for r in kept} == {(3, BASE), (7, other)}


@pytest.mark.parametrize("small", [0, 200_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    e = spark.createDataFrame([(5, 6), (6, 7), (7, 1), (9, 9), (10, 12), (12, 11)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(e).collect()} == {(1, 1), (5, 1), (6, 1), (7, 1), (9, 9), (10, 10), (11, 10), (12, 10)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(chain).collect()} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)}


def distance_inside(item, text):
    best = list(range(len(item) + 1))
    low = best[-1]
    for c in text:
        row = [0]
        for i, p in enumerate(item, 1):
            row.append(min(best[i] + 1, row[-1] + 1, best[i - 1] + (p != c)))
        best = row
        low = min(low, best[-1])
    return low


def test_decontamination(spark, empty):
    item = "the quick brown fox jumps over the lazy dog near the river bank today"
    cases = {1: "before " + item + " after", 2: "x " + item.replace("lazy", "laxy") + " y", 3: item.replace("brown", "blue").replace("river", "lake").replace("today", ""), 4: "clean", 5: None, 6: "", 7: item.upper().replace(" ", "\n")}
    d = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = {r["doc_id"]: r["n_edits"] for r in decontamination.contaminated(d, items).collect()}
    n = {i: distance_inside(item, decontamination.normal(t)) for i, t in cases.items() if t}
    assert got == {i: x for i, x in n.items() if x <= int(0.05 * len(item))}
    assert {r["doc_id"] for r in decontamination.decontaminate(d, items).collect()} == set(cases) - set(got)
    assert decontamination.contaminated(empty, items).count() == 0


def test_secret_scan(spark, empty):
    key = "AKIA" + "B2" * 8
    text = f"é api_key = 'abcdefghijkl' {key} aB3dE6gH9jK2mN5pQ8rS1t https://db.internal/x token=secret:abcdefghijklmnop " + "0af" * 6
    rows = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark.createDataFrame([(1, text), (2, None), (3, "aB3dE6gH9jK2mN5pQ8rS1t alone")], "doc_id long, text string")).collect()}
    assert (rows[1]["n_assign"], rows[1]["n_access"], rows[1]["n_hex"]) == (1, 1, 1)
    assert "weak:" in rows[1]["spans"] and "endpoint:" in rows[1]["spans"]
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["spans"] == ""
    assert secret_scan.scan_secrets(empty).count() == 0


def test_secret_scan_weak_parts(spark):
    key = "aB3dE6gH9jK2mN5pQ8rS1tU4" * 2
    far = "x " * 300
    texts = [f"account_name=storage1 {key} https://store.example.org/blob", f"{key} {far} account_name=storage1 {far} https://store.example.org/a", f"AKIA{'B2' * 8} {'x ' * 110}https://db.example.org/{'p' * 60}", "account_name=one user_id=someone"]
    got = [r["spans"] for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    end = len(texts[0])
    assert got[0] == f"ident:0:21,weak:22:70,endpoint:71:{end}" and got[1] == "" and got[3] == ""
    assert got[2] == f"access:0:20,endpoint:241:{len(texts[2])}"
    rng = np.random.default_rng(3)
    parts = ["account_name=storage1", key, "https://store.example.org/blob", "token=abcdefghijklmnop", "AKIA" + "B2" * 8, "0af" * 6]
    for _ in range(200):
        t = " ".join("y " * int(rng.integers(0, 120)) + parts[i] for i in rng.integers(0, 6, 6))
        base = secret_scan.base_spans(t)
        weak = [w for w in secret_scan._weak_spans(t) if all(e <= w[0] or w[1] <= s for s, e, _ in base)]
        want = {w for w in weak if any(k in secret_scan.NEEDS[w[2]] and s <= w[1] + secret_scan.SCOPE and e >= w[0] - secret_scan.SCOPE for s, e, k in base + weak)}
        assert set(secret_scan.linked_spans(t, base)) == want


def test_language_id(spark, docs, empty):
    model = {"aa": b"lorem ipsum dolor sit amet " * 40, "bb": b"qwert zuiop asdfg hjkl yxcvb " * 40}
    d = spark.createDataFrame([(1, "Lorem IPSUM dolor sit!"), (2, "qwert zuiop asdfg"), (3, "12 !"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_language(d, model).collect()}
    assert got == {1: "aa", 2: "bb", 3: "und", 4: "und"}
    assert language_id.identify_language(empty, model).count() == 0 and set(language_id.train_dictionaries(docs)) == {"en"}


def test_token_output(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t, start, want = Tokenizer.from_file(path), 0, {}
    for i, text in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_output.token_output(docs, path).collect()} == want
    assert token_output.token_output(empty, path).count() == 0


def test_token_output_one_id_in_many_tasks(spark):
    public = pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([(None if i % 2 else 7, f"text number {i} {i * i}") for i in range(400)], "doc_id long, text string").repartition(8)
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_output.token_output(d, public.path("byte_bpe_50k.json")).collect())
    assert len(got) == 400 and [x[2] for x in got] == [None] * 200 + [7] * 200
    assert [x[0] for x in got] == [0, *np.cumsum([x[1] for x in got])[:-1].tolist()]


def test_repair_round_trip():
    counts = np.array([400, 1, 599])
    ids = np.tile(rng.integers(0, 9, 100), 10).astype(np.int32)
    s = token_output.Shard(token_output.pack([1, None, 3], counts, ids, 50257))
    assert len(s.rules) and np.array_equal(np.concatenate([s.ids(i) for i in range(3)]), ids)
    assert s.doc_ids == [1, None, 3] and np.array_equal(s.ids(2), ids[401:])


def test_toxicity(spark, empty):
    plain = [" ".join(rng.choice(VOCAB, 30)) for _ in range(120)]
    bags = spark.createDataFrame([(i, t + (" zorgblat" if i % 3 == 0 else "")) for i, t in enumerate(plain)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(bags, labels)
    hard = {1: "a zorgblat", 2: "you zorXgblat", 3: "z.o.r.g.b.l.a.t", 4: "w1 w2", 5: None, 6: "", 7: "z o r g b l a t"}
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame(list(hard.items()), "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1}
    assert toxicity.score_toxicity(empty, model).count() == 0 and toxicity.train(empty, labels).stems == []


def test_toxicity_many_rare_and_short_insults():
    r = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda n: "".join(r.choice(letters, n))
    plain, insults = [word(int(n)) for n in r.integers(2, 9, 400)], [*(word(8) for _ in range(40)), "zqx"]
    common, rare = insults[:36] + insults[40:], insults[36:40]
    use = [common[i % len(common)] for i in range(1200)] + [w for w in rare for _ in range(3)] + [""] * 2400
    texts = [" ".join([*r.choice(plain, 20), w]) for w in use]
    bags = []
    for t, w in zip(texts, use, strict=True):
        bags.append((int(w != ""), toxicity.strings(pa.array([t]))[1]))
    model = toxicity.fit(bags)
    assert len(model.stems) > 24
    score = model.score(pa.array([" ".join([*r.choice(plain, 20), w]) for w in [*insults, *[""] * 40]]))
    assert (score[:41] >= 0.5).all() and (score[41:] < 0.5).all()


def test_fingerprints(docs, empty):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    texts = [t or "" for _, t in ROWS]
    for n, (i, _) in enumerate(ROWS):
        t, nxt = texts[n], texts[(n + 1) % len(texts)]
        cut = len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"] and got[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_license_scan(spark, empty):
    d = spark.createDataFrame([(1, "prose\nReleased under the MIT license"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["line"], r["license"]) for r in license_scan.scan_licenses(d).collect()} == {(1, 1, "MIT"), (1, -1, "MIT"), (2, 0, "CC-BY-NC-4.0")}
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_at_threshold(spark):
    for b in range(1, 200):
        fits = [n for n in range(1, 500) if 2.0 * min(n, b) / (n + b) >= license_scan.THRESHOLD]
        assert license_scan.size_bounds(b, license_scan.THRESHOLD) == (fits[0], fits[-1])
    d = spark.createDataFrame([(1, "Code is released under the MIT License.")], "doc_id long, text string")
    assert [tuple(r) for r in license_scan.scan_licenses(d).collect()] == [(1, 0, "MIT", 0.8)]


def test_license_scan_texts_and_runs(spark):
    text = license_scan.TEMPLATES["MIT-text"].strip()
    wrapped = "\n".join(textwrap.wrap(text, 70))
    notice = "We like prose here. Released under the MIT License. More prose comes after that one."
    d = spark.createDataFrame([(1, text), (2, "def f(x):\n    return x\n\n" + wrapped + "\n\nand a long tail of words that is no licence"), (3, notice), (4, "Some code\nLicensed under the\nApache License, Version 2.0.\nmore words of code follow"), (5, "prose " + license_scan.TEMPLATES["GPL-3.0-text"].replace("\n", " "))], "doc_id long, text string")
    got = {(r["doc_id"], r["line"], r["license"]) for r in license_scan.scan_licenses(d).collect()}
    assert {(1, -1, "MIT-text"), (2, 3, "MIT-text"), (3, 0, "MIT"), (4, 1, "Apache-2.0"), (5, 0, "GPL-3.0-text")} <= got
    assert {r for r in got if r[0] in (2, 3, 4, 5)} == {(2, -1, "MIT-text"), (2, 3, "MIT-text"), (3, 0, "MIT"), (4, 1, "Apache-2.0"), (5, 0, "GPL-3.0-text")}


def test_source_mixing(docs, empty):
    rows = source_mixing.mix_sources(docs, {"domain": {"domain0": 3}}, 0.5, 2).collect()
    total = sum(len(words(t)) for _, t in ROWS)
    assert sum(r["taken_tokens"] for r in rows) == total // 2
    assert all(r["taken_tokens"] <= 2 * r["n_tokens"] and r["copies"] <= 2 for r in rows)
    assert source_mixing.mixture(docs, {}, 2.0, 2).count() == 2 * sum(bool(words(t)) for _, t in ROWS)
    assert source_mixing.mix_sources(empty, {}).count() == 0


@pytest.mark.parametrize(("master", "named"), [("yarn", None), ("local-cluster[3,2,1000]", None), ("spark://host:7077", None), ("yarn", "s3a://bucket/x/")])
def test_a_cluster_needs_a_shared_folder(master, named):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    if named:
        assert _common.shared_dir(session) == "s3a://bucket/x"
    else:
        with pytest.raises(ValueError):
            _common.shared_dir(session)


def test_bits_of_a_bitmap_follow_the_memory_of_executors():
    bits = lambda memory: _common.table_bits(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: memory or default)))
    assert [bits(m) for m in (None, "1800m", "16g", "64G", "odd")] == [29, 29, 32, 34, 29]
