"""Every operator on one table of hard rows: null and repeated ids, equal rows, ties, empty and null texts, a text of
20,000 words, and columns named as the operators' inner ones; each against brute force, by row."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from nearplane.llm import decontamination, fingerprints, jaccard_join, language_id, license_scan, secret_scan, source_mixing, substring_dedup, token_output, toxicity

CLASH = ["start", "sig", "key", "bucket", "row", "rid", "th", "oid", "id", "score", "n_tokens", "domain", "guest", "range", "toxic", "root", "node", "a", "line", "lines", "part", "copies", "text_key", "base", "model"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
rng = np.random.default_rng(17)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "te", "zo", "pi", "ven", "dor")]
say = lambda n: " ".join(rng.choice(WORDS, n))
LONG = " ".join(f"{w}{i % 977}" for i, w in enumerate(rng.choice(WORDS, 20_000)))
PASSAGE = " ".join(f"p{i}" for i in range(60))
NEAR = PASSAGE.replace("p30 ", "q30 ")
ITEM = "the museum opened its eastern wing in the spring of that year"
SECRET = f"password = 'abcdefghijklmnop' and {'x ' * 100} https://store.example.org/{'q' * 40} AKIA{'Z9' * 8}"
ROWS = [
    (None, PASSAGE), (None, say(40)), (None, NEAR), (None, None), (None, ""), (None, say(40)), (7, PASSAGE), (7, say(30)), (7, say(30)), (7, PASSAGE),
    (1, LONG), (2, LONG + " end"), (3, "one"), (4, "One"), (5, " \n\t "), (6, ""), (8, None), (9, NEAR + " " + say(50)), (10, "a " * 300), (10, "a " * 300), (10, "a " * 301),
    (11, "before " + ITEM + " after"), (12, ITEM.replace("eastern", "eastrn").upper()), (13, SECRET), (14, "0123 456"), (15, "Released under the MIT License."), (16, say(25) + "\nReleased under the MIT License.\n" + say(25)),
    (-5, say(25)), (1 << 62, PASSAGE + " " + PASSAGE), (17, "été 日本 <|endoftext|>\n\nx  y"), (18, "a" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, [None, "en", "de"][n % 3], [None, "src1", "src2", "web"][n % 4], len(t or ""), *["c"] * len(CLASH)) for n, (i, t) in enumerate(ROWS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


LOW = -(1 << 63)


def at(i):
    return LOW if i is None else i


def dealt(budget, children):
    """Shares by weight; a child that cannot fill its share takes its supply, until none is left that cannot."""
    left, share = dict(children), {}
    while True:
        total = sum(w for _, w in left.values())
        full = [n for n, (supply, w) in left.items() if Fraction(budget * w, total) >= supply]
        if not full:
            break
        # the one that falls short most is settled first
        n = min(full, key=lambda n: (Fraction(left[n][0], left[n][1]), n))
        share[n] = left.pop(n)[0]
        budget -= share[n]
        if not left:
            return share
    total, upto = sum(w for _, w in left.values()), 0
    for n in sorted(left):
        w = left[n][1]
        share[n] = budget * (upto + w) // total - budget * upto // total
        upto += w
    return share


def mixed(table, weights, part, epochs, seed):
    """Rows (doc_id, domain, lang, source, n_tokens, copies, taken_tokens) and the texts of the mixture."""
    leaves, plan = {}, {(): None}
    for i, t, lang, source in table:
        source = source or "(none)"
        tail = re.search("([0-9]+)$", source)
        key = (f"domain{int(tail[1]) % 4}" if tail else "domain?", lang or "(none)", source)
        if words(t):
            leaves.setdefault(key, []).append((i, t, len(words(t))))
    weight = lambda depth, name: weights.get(("domain", "lang", "source")[depth], {}).get(name, 1)
    supply = {k: sum(n for *_, n in v) for k, v in leaves.items()}
    plan[()] = min(sum(supply.values()) * epochs, int(sum(supply.values()) * part))
    for depth in range(3):
        for above in [k for k in plan if len(k) == depth]:
            names = {k[depth] for k in supply if k[:depth] == above}
            got = dealt(plan[above], {n: (epochs * sum(s for k, s in supply.items() if k[: depth + 1] == (*above, n)), weight(depth, n)) for n in names})
            plan |= {(*above, n): s for n, s in got.items()}
    out, texts = Counter(), Counter()
    for key, held in leaves.items():
        whole, rest = divmod(plan[key], supply[key])
        name = lambda r: (hashlib.md5(f"{seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), hashlib.md5(r[1].encode()).hexdigest())  # noqa: E731, B023
        for i, t, n in sorted(held, key=name):
            take = min(n, rest)
            rest -= take
            if whole or take:
                out[(i, *key, n, whole + (take > 0), whole * n + take)] += 1
                texts[(i, t)] += whole
                if take:
                    texts[(i, t if take == n else re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % take, t)[0])] += 1
    return out, +texts


@pytest.mark.parametrize(("weights", "share", "epochs"), [({"domain": {"domain1": 3}, "lang": {"en": 4}}, 0.55, 2), ({}, 0.013, 1), ({"source": {"web": 9}}, 1.9, 3)])
def test_source_mixing(docs, empty, weights, share, epochs):
    table = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    want, texts = mixed(table, weights, share, epochs, 13)
    assert rows(source_mixing.mix_sources(docs, weights, share, epochs), "doc_id", "domain", "lang", "source", "n_tokens", "copies", "taken_tokens") == want
    mixture = source_mixing.mixture(docs, weights, share, epochs)
    assert mixture.columns == docs.columns and rows(mixture, "doc_id", "text") == texts
    assert all(r["n_chars"] == len(r["text"]) for r in mixture.select("text", "n_chars").collect())
    assert not source_mixing.mix_sources(empty, weights).count() and not source_mixing.mixture(empty, weights).count()


@pytest.mark.parametrize("share", [0.05, 0.37, 0.5])
def test_source_mixing_of_equal_rows(spark, share):
    """Rows that are equal, of one id, or of none, around every cut: the budget is met to the token."""
    table = [(3, "a b c", "en", "src1")] * 40 + [(None, f"n {i}", "en", "src1") for i in range(30)] + [(4, "d e", None, "src1")] * 25
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string").repartition(4)
    want, texts = mixed(table, {}, share, 1, 13)
    assert rows(source_mixing.mix_sources(df, {}, share, 1), "doc_id", "domain", "lang", "source", "n_tokens", "copies", "taken_tokens") == want
    assert rows(source_mixing.mixture(df, {}, share, 1), "doc_id", "text") == texts


def edits_inside(item, text):
    best = list(range(len(item) + 1))
    low = best[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(best[i] + 1, new[-1] + 1, best[i - 1] + (p != c)))
        best, low = new, min(low, new[-1])
    return low


def test_decontamination(spark, docs, empty):
    items = [(1, ITEM), (1, ITEM), (None, "p10 p11"), (2, "one"), (3, None), (4, "")]
    frame = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, start string")
    norm = decontamination.normal
    short = [(i, t) for i, t in ROWS if len(t or "") < 6000]
    want = Counter()
    for i, t in short:
        for j, x in items:
            if t and x and (d := edits_inside(norm(x), norm(t))) <= int(0.05 * len(norm(x))):
                want[i, j, d] += 1
    few = docs.where("text is null or length(text) < 6000")
    assert rows(decontamination.contaminated(few, frame), "doc_id", "item_id", "n_edits") == want
    found = {t for i, t in short if any(t and x and edits_inside(norm(x), norm(t)) <= int(0.05 * len(norm(x))) for _, x in items)}
    assert rows(decontamination.decontaminate(few, frame), "doc_id", "text") == Counter(r for r in short if r[1] not in found)
    long = decontamination.contaminated(docs.where("doc_id in (1, 2)"), spark.createDataFrame([(9, " ".join(words(LONG)[-30:]))], "item_id long, text string"))
    assert rows(long, "doc_id", "n_edits") == Counter({(1, 0): 1, (2, 0): 1})
    assert not decontamination.contaminated(empty, frame).count() and not decontamination.contaminated(docs, frame.limit(0)).count()
    assert decontamination.decontaminate(docs, frame.limit(0)).count() == len(ROWS)


def test_substring_dedup(docs, empty):
    first = {}
    for i, t in ROWS:
        w = words(t)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            first[k] = min(first.get(k, (at(i), a)), (at(i), a))
    want = Counter()
    for i, t in ROWS:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            if first[tuple(w[a : a + 20])] < (at(i), a):
                gone[a : a + 20] = [True] * 20
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    assert rows(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert not substring_dedup.dedup_substrings(empty).count()


def test_substring_dedup_around_a_hot_anchor(spark, monkeypatch):
    """A common phrase in ever other surroundings, with some passages that repeat, dealt by the windows' own hashes."""
    monkeypatch.setattr(substring_dedup, "HOT_LOCAL", 5)
    monkeypatch.setattr(substring_dedup, "HOT", 20)
    phrase = "a common phrase of nineteen words that stands in all of these documents and is longer than most such phrases"
    table = [(i, f"{say(12)} {phrase} {say(12)}") for i in range(120)]
    table += [(1000 + i, table[i % 7][1]) for i in range(30)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert len(substring_dedup.merged_sketch(df, 20, 8, 20)[1])
    first, want = {}, Counter()
    for i, t in sorted(table):
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in first:
                gone[a : a + 20] = [True] * 20
            first.setdefault(k, i)
        want[i, sum(gone)] += 1
    assert rows(substring_dedup.dedup_substrings(df), "doc_id", "n_removed") == want


def tree(text):
    """Sections as lists of (hash, leaves) of paragraphs."""
    out, open_ = [], False
    for p in text.split("\n"):
        h = hashlib.sha256(p.encode()).hexdigest()
        leaves = [hashlib.md5(x.encode()).hexdigest()[:8] for x in re.findall(r"[^.!?]{1,64}[.!?]*|[.!?]+", p)]
        if not open_:
            out.append([])
        out[-1].append((h, leaves))
        open_ = h[-1] not in "0123"
    return out


def test_fingerprints(docs, empty):
    order = sorted(ROWS, key=lambda r: (at(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest()))
    texts = [t or "" for _, t in order]
    leaves = lambda t: {x for s in tree(t) for _, ls in s for x in ls}
    dice = lambda a, b: 1.0 if a == b else 2 * len(leaves(a) & leaves(b)) / max(1, len(leaves(a)) + len(leaves(b)))
    want, prints = Counter(), {}
    for n, (i, _) in enumerate(order):
        t, nxt = texts[n], texts[(n + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        lost = [s for s in tree(t) if s not in tree(edited)]
        there = {h for s in tree(edited) if s not in tree(t) for h, _ in s}
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(dice(t, edited), 9), round(dice(t, nxt), 9), ",".join(sorted({h[:8] for s in lost for h, _ in s if h not in there}))] += 1
    got = fingerprints.fingerprint_documents(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), r["edited_paragraphs"]) for r in got) == want
    for r in got:
        prints.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert len(prints) == len(set(texts))  # equal texts, and only they, have equal fingerprints
    trees = {r["doc_id"]: r for r in fingerprints.merkle_trees(docs.where("doc_id in (16, 8)")).collect()}
    assert trees[16]["paragraphs"] == [h for s in tree(ROWS[26][1]) for h, _ in s] and trees[8]["paragraphs"] == [hashlib.sha256(b"").hexdigest()]
    assert len(trees[16]["sections"]) == len(tree(ROWS[26][1])) and trees[16]["root"] == next(r["fingerprint"] for r in got if r["doc_id"] == 16)[:64]
    assert not fingerprints.fingerprint_documents(empty).count() and not fingerprints.merkle_trees(empty).count()


def test_next_rows_of_one_id_in_many_ranges(spark):
    """An id, or none, that has most rows is cut into ranges by text; the order stays whole across them."""
    table = [(None, f"none {i}") for i in range(70)] + [(5, f"five {i}") for i in range(200)] + [(i, f"other {i}") for i in range(6, 40)] + [(5, "same")] * 3
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert len(fingerprints.ranges(df, 16)[1]) >= 2
    order = sorted(table, key=lambda r: (at(r[0]), hashlib.md5(r[1].encode()).hexdigest()))
    want = Counter((*r, order[(n + 1) % len(order)][1]) for n, r in enumerate(order))
    assert rows(fingerprints.with_next(df), "doc_id", "text", "next_text") == want


def test_license_scan(docs, empty):
    known = {n: license_scan.TEMPLATES[n] for n in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-4.0")} | {"MIT-again": license_scan.TEMPLATES["MIT"]}
    grams = {n: set(license_scan.template_bigrams(t)) for n, t in known.items()}
    want = Counter()
    for i, t in ROWS:
        lines = (t or "").split("\n")
        for no, unit in [*enumerate(lines), *([(-1, t)] if len(lines) > 1 else [])] if t is not None else []:
            g = set(license_scan.template_bigrams(unit))
            least, name = min((-round(2 * len(g & b) / (len(g) + len(b)), 6) if g else 0.0, n) for n, b in grams.items())
            dice = -least
            if dice >= license_scan.THRESHOLD:
                want[i, no, name, dice] += 1
    assert rows(license_scan.scan_licenses(docs, known), "doc_id", "line", "license", "dice") == want and want
    assert not license_scan.scan_licenses(empty).count()


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, empty, k, num):
    sets = []
    for _, t in ROWS:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set())
    root, links = list(range(len(ROWS))), [0] * len(ROWS)
    for x, y in itertools.permutations(range(len(ROWS)), 2):
        if sets[x] and 100 * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
            links[x] += 1
            a, b = root[x], root[y]
            root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for n, (i, _) in enumerate(ROWS):
        least[root[n]] = min(least.get(root[n], at(i)), at(i))
    name = lambda n: None if least[root[n]] == LOW else least[root[n]]
    assert rows(jaccard_join.jaccard_join(docs, k, num, 100), "doc_id", "n_shingles", "component_id", "n_links") == Counter((i, len(sets[n]), name(n), links[n]) for n, (i, _) in enumerate(ROWS))
    kept = jaccard_join.one_per_group(docs, k, num, 100)
    assert kept.columns == docs.columns and rows(kept, "doc_id", "text") == Counter((i, t) for n, (i, t) in enumerate(ROWS) if i == name(n))
    assert not jaccard_join.jaccard_join(empty, k, num, 100).count() and not jaccard_join.one_per_group(empty).count()


def test_jaccard_join_of_large_blocks(spark, monkeypatch):
    """Near copies in one block that is cut into many cells and tiles, found through chains, with exact degrees."""
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    monkeypatch.setattr(jaccard_join, "CELL_TOKENS", 700)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    body = [f"b{i}" for i in range(70)]
    table = []
    for i in range(90):
        w = list(body)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 70))] = f"z{int(rng.integers(0, 9))}"
        table.append((i, " ".join(w[: 70 - int(rng.integers(0, 9))])))
    sets = [{tuple(t.split()[a : a + 4]) for a in range(len(t.split()) - 3)} for _, t in table]
    link = lambda x, y: 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])
    root, n_links = list(range(90)), [sum(x != y and link(x, y) for y in range(90)) for x in range(90)]
    for x, y in itertools.combinations(range(90), 2):
        if link(x, y):
            a, b = root[x], root[y]
            root = [min(a, b) if r in (a, b) else r for r in root]
    got = jaccard_join.jaccard_join(spark.createDataFrame(table, "doc_id long, text string").repartition(3), 4, 85, 100)
    assert rows(got, "doc_id", "component_id", "n_links") == Counter((i, root[i], n_links[i]) for i in range(90))
    monkeypatch.setattr(jaccard_join, "CUT_ROWS", 0)
    got = jaccard_join.jaccard_join(spark.createDataFrame(table, "doc_id long, text string"), 4, 85, 100)
    assert rows(got, "doc_id", "component_id", "n_links") == Counter((i, root[i], n_links[i]) for i in range(90))


def base_spans(text):
    """By scanning from each character, without the operator's patterns."""
    out = []
    low = "".join(c.lower() if c.isascii() else c for c in text)
    names = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        end = None
        for n in names:
            if not low.startswith(n, i):
                continue
            for quote, mark in itertools.product((1, 0), (1, 0)):
                j = i + len(n)
                if quote:
                    if text[j : j + 1] not in ('"', "'"):
                        continue
                    j += 1
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                if mark:
                    if text[j : j + 1] not in ('"', "'"):
                        continue
                    j += 1
                e = j
                while e < len(text) and text[e] in value:
                    e += 1
                if e > j:
                    end = e, e - j
                    break
            if end:
                break
        if end:
            if end[1] >= 12:
                out.append((i, end[0], 0))
            i = end[0]
        else:
            i += 1
    for kind, opening, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), (2, "", "0123456789abcdef", 16)):
        i = 0
        while i < len(text):
            e = i + len(opening)
            if text.startswith(opening, i):
                while e < len(text) and text[e] in chars:
                    e += 1
            if text.startswith(opening, i) and e > i + len(opening):
                if e - i >= least:
                    out.append((i, e, kind))
                i = e
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_secret_scan(spark, docs, empty):
    said = lambda spans: ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, e, k in spans)
    bits = ["password", "API_KEY", "apikey", "Token", "=", ":", " ", '"', "'", "abcdefghijkl", "0af" * 6, "AKIA", "Q1" * 9, "é", "\n", "x", "deadbeefdeadbeef", "secret=", "passwd:", "token= '"]
    table = ROWS + [(100 + i, "".join(rng.choice(bits, 14))) for i in range(300)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(table[len(ROWS) :], "doc_id long, text string"))
    want = Counter()
    for i, t in table:
        own = base_spans(t or "")
        want[(i, *(sum(k == kind for *_, k in own) for kind in range(3)), hashlib.sha256(said(own).encode()).hexdigest())] += 1
    got = secret_scan.scan_secrets(df)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    for r in got.collect():  # the method adds spans, base ones stay
        base = [x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
        assert len(r["spans"].split(",")) * bool(r["spans"]) == r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_linked"]
    assert not secret_scan.scan_secrets(empty).count()


def test_secret_scan_at_the_edges_of_a_scope(spark):
    """Whatever touches a scope is reported whole, on both sides; whatever lies a character beyond is not."""
    key, url = "AKIA" + "B2" * 8, "https://db.example.org/" + "p" * 60
    reach = secret_scan.SCOPE
    far = lambda n: " " * n
    table = [(0, key + far(reach) + url), (1, key + far(reach + 1) + url), (2, url + far(reach) + key), (3, url + far(reach + 1) + key)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    a, u = len(key), len(url)
    assert got == {0: f"access:0:{a},endpoint:{a + reach}:{a + reach + u}", 1: f"access:0:{a}", 2: f"endpoint:0:{u},access:{u + reach}:{u + reach + a}", 3: f"access:{u + reach + 1}:{u + reach + 1 + a}"}


def test_language_id(spark, docs, empty):
    zs = pytest.importorskip("zstandard")
    model = {"aa": (say(400)).encode(), "bb": b"qwert zuiop asdfg hjkl " * 60, "cc": (say(400)).encode(), "dd": b""}
    made = {n: zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), level=language_id.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False) for n, d in model.items()}
    want = Counter()
    for i, t in ROWS:
        if not re.search(r"[^\W\d_]", t or ""):
            want[i, "und", True] += 1
            continue
        data = re.sub(r"[\W\d_]+", " ", t.lower()).encode()
        size = sorted((len(c.compress(data)), n) for n, c in made.items())
        want[i, size[0][1], (size[1][0] - size[0][0]) / size[1][0] < language_id.MARGIN] += 1
    got = language_id.identify_language(docs, model)
    assert rows(got, "doc_id", "lang_pred", "rejected") == want
    assert all(0 <= r["score"] <= 1 for r in got.collect()) and not language_id.identify_language(empty, model).count()
    assert language_id.train_dictionaries(empty) == {} and rows(language_id.identify_language(docs, {}), "lang_pred") == Counter({("und",): len(ROWS)})


def test_language_id_training(spark):
    """Repeated and null ids, and a language that has only very long texts."""
    long = " ".join(f"{w}{chr(97 + i % 26)}" for i, w in enumerate(rng.choice(WORDS, 40_000)))
    table = [(1, "eins zwei drei vier", "de"), (1, "fünf sechs sieben", "de"), (1, "eins zwei drei vier", "de"), (None, "acht neun zehn", "de"), (None, "elf zwoelf", "de"), (5, long, "xx"), (6, None, "yy"), (7, "", "yy"), (8, "text", None), (9, "123", "nn")]
    made = [language_id.train_dictionaries(spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(n)) for n in (1, 4)]
    assert made[0] == made[1] and set(made[0]) == {"de", "xx", "nn"}
    assert sorted(made[0]["de"].split(b"\n")) == sorted(t.encode() for t in {x for _, x, lang in table if lang == "de"})
    assert len(made[0]["xx"]) == language_id.DICT_BYTES and long.encode().startswith(made[0]["xx"][:1000])
    df = spark.createDataFrame([(1, "sechs sieben acht neun"), (2, long[5000:9000])], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify_language(df, made[0]).orderBy("doc_id").collect()] == ["de", "xx"]


def test_token_output(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in ROWS]
    got = sorted(token_output.token_output(docs, path).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert [at(r["doc_id"]) for r in got] == sorted(at(i) for i, _ in ROWS)
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    assert not token_output.token_output(empty, path).count()


def test_encoder_with_a_small_cache(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_output, "CACHE_UNITS", 60)
    monkeypatch.setattr(token_output, "SLOT_BITS", 7)  # slots run out, so some units are never found
    monkeypatch.setattr(token_output, "PROBES", 2)
    enc = token_output.Encoder(public.path("byte_bpe_50k.json"))
    for _ in range(40):
        texts = [None if rng.random() < 0.1 else " ".join(f"{rng.choice(WORDS)}{rng.integers(0, 40)}" for _ in range(int(rng.integers(0, 30)))) for _ in range(5)]
        ids, n = enc.encode(pa.array(texts, pa.string()))
        want = [enc.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == list(itertools.chain(*want))


def test_unknown_units_share_calls_of_the_tokenizer(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    enc = token_output.Encoder(public.path("byte_bpe_50k.json"))
    edges = ["", " ", "a ", " a", "  b\t", "\n c", "it's", " it's 's", "n\n\n d", "é  É\u00a0x", " \u3000y", "\u2028z ", "🙂 🙂", "<|endoftext", "d, e.\nf", None]
    new = [" ".join(f"{rng.choice(WORDS)}{rng.choice(WORDS)}é{i}" for i in range(1000)), "x <|endoftext|> y z<|endoftext|>"]
    asked = []
    ids_of = token_output.Encoder._ids
    monkeypatch.setattr(token_output.Encoder, "_ids", lambda self, texts: asked.append(len(texts)) or ids_of(self, texts))
    for texts in (new[:1], edges, [rng.choice(edges[:-1]) + rng.choice(edges[:-1]) for _ in range(300)], new):
        ids, n = enc.encode(pa.array(texts, pa.string()))
        want = [enc.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == list(itertools.chain(*want))
        assert texts != new[:1] or sum(asked) < 50  # of 1000 units
    enc.clear()
    enc.width += 1  # widths that tell nothing: unit by unit
    ids, n = enc.encode(pa.array(new[:1]))
    assert ids.tolist() == enc.tokenizer.encode(new[0], add_special_tokens=False).ids


def test_unit_hashes_are_word_hashes():
    buf = rng.integers(0, 256, 300_000).astype(np.uint8)
    edges = np.unique(np.concatenate([[0, 1, 2, 290_000, 300_000], rng.integers(0, 120_000, 40_000)]))
    assert np.array_equal(token_output.unit_hashes(buf, edges), token_output.W.word_hashes(buf, edges[:-1], edges[1:]))


@pytest.mark.parametrize("vocab", [500, 65_000, 70_000])
def test_repair_of_any_vocabulary(vocab):
    for n, alphabet in ((0, 3), (1, 3), (5000, 1), (5000, 3), (5000, vocab)):
        counts = np.append(rng.multinomial(n, [0.25] * 4), 1)
        ids = rng.integers(0, alphabet, n + 1).astype(np.int32)
        counts = counts[counts > 0]
        s = token_output.Shard(token_output.pack(list(range(len(counts))), counts, ids, vocab))
        edge = np.cumsum(counts)
        assert np.array_equal(s.decode(s.symbols), ids) and all(np.array_equal(s.ids(i), ids[e - c : e]) for i, (c, e) in enumerate(zip(counts, edge, strict=True)))
        if alphabet == 1:
            assert len(s.symbols) < 100  # long runs shrink to a few symbols


def kernel_by_hand(s, t):
    """All common subsequences of P letters, each by LAMBDA to its spans."""
    total = 0.0
    for x in itertools.combinations(range(len(s)), toxicity.P):
        for y in itertools.combinations(range(len(t)), toxicity.P):
            if all(s[i] == t[j] for i, j in zip(x, y, strict=True)):
                total += toxicity.LAMBDA ** (x[-1] - x[0] + 1 + y[-1] - y[0] + 1)
    return total


def test_kernel_and_decisions_by_enumeration():
    texts = [bytes([toxicity.START, *rng.integers(97, 101, int(n))]) for n in rng.integers(3, 9, 12)]
    x = toxicity.as_rows(texts, toxicity.ROW)
    marks = texts[:4]
    hand = np.array([[kernel_by_hand(a, b) for a in texts] for b in marks])
    assert np.allclose(toxicity.kernel(x, toxicity.as_rows(marks, toxicity.LAND_WIDTH)), hand, rtol=1e-4)
    own = np.array([kernel_by_hand(a, a) for a in texts])
    assert np.allclose(toxicity.self_kernel(x), own, rtol=1e-4)
    model = toxicity.Model([], [], marks, np.array([1.0, -0.5, 0.25, 2.0]), -0.7, np.zeros(toxicity.TOP + 1))
    short = np.array([len(t) <= toxicity.P for t in texts])
    same = np.array([[a == b for a in texts] for b in marks])
    norm = hand / np.maximum(np.sqrt(own[:4])[:, None] * np.sqrt(own)[None, :], 1e-12)
    want = np.where(short[None, :] | short[:4, None], same, norm).T @ model.weights + model.bias
    assert np.allclose(model.decide(x), want, atol=1e-4)


def test_toxicity(spark, docs, empty):
    insult = ["grubnak", "zorgblat feen"]
    plain = [say(30) for _ in range(240)]
    train = [(i, t + (f" {insult[i % 2]}" if i % 3 == 0 else "")) for i, t in enumerate(plain)]
    labels = [(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (None, 0), (5, None), (9999, 1)]
    bags = spark.createDataFrame([(*r, "c") for r in train + [(None, "null id"), (3, train[3][1]), (4, None), (5, "")]], "doc_id long, text string, strings string")
    model = toxicity.train(bags, spark.createDataFrame(labels, "doc_id long, toxic int"))
    again = toxicity.train(bags.repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3))
    assert model.landmarks == again.landmarks and np.allclose(model.weights, again.weights)
    assert model.score(pa.array(["a grubnak", "grXubnak", "g.r.u.b.n.a.k", "zorgblat feen", say(50), "", None, "12 34"])).round().tolist() == [1, 1, 1, 1, 0, 0, 0, 0]
    # a text by its worst strings, here one string at a time, without a memo
    for text in [say(20), "you grubnak " + say(10), "x zorgblat y"]:
        value = sorted((float(model.decide(toxicity.as_rows([s], toxicity.ROW))[0]) for s in {bytes([toxicity.START]) + w.encode() for w in text.split() if len(w) > 1}), reverse=True)[: toxicity.TOP]
        top = np.array([[*(max(v, model.bias) for v in value), *[model.bias] * (toxicity.TOP - len(value))]])
        assert abs(model.calibrated(top)[0] - model.score(pa.array([text]))[0]) < 1e-4
    scored = toxicity.score_toxicity(docs, model)
    assert rows(scored, "doc_id", "predicted") == Counter((i, int(model.score(pa.array([t], pa.string()))[0] >= 0.5)) for i, t in ROWS)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and rows(kept, "doc_id", "text") == Counter(r for r in ROWS if model.score(pa.array([r[1]], pa.string()))[0] < 0.5)
    assert not toxicity.score_toxicity(empty, model).count() and not toxicity.drop_toxic(empty, model).count()
    none = toxicity.train(bags, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert none.stems == [] and none.score(pa.array(["grubnak"]))[0] < 0.5
