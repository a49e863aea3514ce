"""The pipeline's five stages against brute force, on planted toxic texts, copies, benchmark passages and repeated ids."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_hard_rows import at, edits_inside, mixed, rows, words

from nearplane.llm import decontamination, queries, toxicity

rng = np.random.default_rng(29)
VOCAB = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]
ITEMS = ["the old lighthouse keeper counted nine ships before the storm", "a triangle with sides of three four and five has a right angle"]
INSULT = "grubnaxer"


def prose(n):
    return " ".join(rng.choice(VOCAB, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    table, labels = [], []
    for i in range(150):
        toxic = i % 5 == 0
        table.append((i, prose(40) + (f" {INSULT} " + prose(5) if toxic else "")))
        if i % 2 or toxic:
            labels.append((i, 1, int(toxic)))
    copies = [(200 + i, table[7][1]) for i in range(12)] + [(220 + i, table[8][1] + f" zz{i}") for i in range(4)]
    table += copies
    table += [(300, prose(20) + " " + ITEMS[0] + " " + prose(20)), (301, prose(20) + " " + ITEMS[1].replace("sides", "side") + " " + prose(9)), (302, prose(30) + " " + ITEMS[0][:30])]
    table += [(None, prose(30)), (None, prose(30)), (None, table[9][1]), (11, prose(30)), (11, prose(30)), (12, table[12][1]), (400, None), (401, ""), (402, "  \n")]
    full = [(i, t, ["en", "de", None, "fr"][n % 4], ["src0", "src1", "src5", None, "web"][n % 5], None if t is None else len(t), "extra") for n, (i, t) in enumerate(table)]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, start string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [r[:4] for r in full]


def test_pipeline(spark, folder):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, table = folder
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    import pyarrow as pa

    score = model.score(pa.array([r[1] for r in table], pa.string()))
    assert [s >= 0.5 for s in score] == [INSULT in (r[1] or "") for r in table]  # toxic ones go, clean ones stay
    docs = [r for r, s in zip(table, score, strict=True) if s < 0.5]

    sets = []
    for r in docs:
        w = words((r[1] or "").lower())
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = root[x], root[y]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for n, r in enumerate(docs):
        least[root[n]] = min(least.get(root[n], at(r[0])), at(r[0]))
    docs = [r for n, r in enumerate(docs) if at(r[0]) == least[root[n]]]
    assert not any(r[0] in range(200, 224) for r in docs) and {7, 8, 300, 301, 302, 400, 401, 402} <= {r[0] for r in docs}

    norm = decontamination.normal
    docs = [r for r in docs if not any(r[1] and edits_inside(x, norm(r[1])) <= int(decontamination.RATE * len(x)) for x in ITEMS)]
    assert {r[0] for r in docs} & {300, 301, 302} == {302}

    _, texts = mixed(docs, queries.MIX_WEIGHTS, corpus_pipeline.PIPELINE_SHARE, queries.MIX_EPOCHS, queries.MIX_SEED)
    assert sum(n * len(words(t)) for (_, t), n in texts.items()) == int(corpus_pipeline.PIPELINE_SHARE * sum(len(words(r[1])) for r in docs))

    tokenizer = Tokenizer.from_file(public.path(queries.TOKENIZER))
    want = Counter()
    for (i, t), n in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += n
    got = corpus_pipeline.run(spark, path)
    assert rows(got, "doc_id", "n_tokens", "ids_crc32") == want
    got = sorted(got.collect(), key=lambda r: r["start"])
    assert [at(r["doc_id"]) for r in got] == sorted(at(r["doc_id"]) for r in got)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, table = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == corpus_pipeline.COLUMNS and stage(spark, empty, path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, path).count() == 0
