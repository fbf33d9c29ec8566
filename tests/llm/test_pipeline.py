import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401
import corpus_pipeline
from tidemark.llm import graph, mixing, packing, toxicity
from tidemark.llm.queries import tokenizer_path, tuned


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    linked = {n for a, b in edges for n in (a, b) if a != b}
    assert {r["node"]: r["component"] for r in got} == {n: find(n) for n in linked}
    assert len(got) == len(linked)
    assert graph.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[2] < counts[1] <= counts[0] and all(counts)
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_near_duplicates_and_odd_rows(spark, odd_docs, odd_rows):
    kept = corpus_pipeline.drop_near_duplicates(spark, odd_docs, "").collect()
    ids = sorted((repr(r["doc_id"]) for r in kept))
    gone = {"2", "3", "8"}
    want = sorted(repr(r[0]) for r in odd_rows if repr(r[0]) not in gone)
    assert ids == want


def test_mixing_takes_whole_texts_and_first_words(spark, odd_docs, odd_rows):
    taken = {(r["doc_id"], r["size"]): 0 for r in mixing.mix(odd_docs).collect()}
    want = {}
    for r in mixing.mix(odd_docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    texts = {r[0]: r[1] for r in odd_rows}
    got = {}
    for r in corpus_pipeline.mix_sources(spark, odd_docs, "").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len((r["text"] or "").encode().split())
        assert (texts[r["doc_id"]] or "").startswith(r["text"] or "")
        assert r["n_chars"] == len(r["text"] or "")
    assert taken and {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


def test_stages_of_no_documents(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0, name


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def without_near_copies(rows):
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def mixed(rows):
    """Texts as often as the mix takes them, from the SQL of the mix."""
    con = duckdb.connect()
    con.register("kept", pa.table({c: [r[c] for r in rows] for c in ("doc_id", "source", "text")}))
    taken = dict(con.sql(mixing.oracle(docs="kept")).project("doc_id, taken").fetchall())
    out = []
    for r in rows:
        spans = [m.end() for m in WORD.finditer(r["text"] or "")]
        whole, rest = divmod(taken[r["doc_id"]], len(spans)) if spans else (1, 0)
        out += [(r["doc_id"], r["text"] or "")] * whole + ([(r["doc_id"], r["text"][: spans[rest - 1]])] if rest else [])
    return out


def test_pipeline_against_plain_code(spark):
    """All stages on a whole small table; only the trained weights are taken from the operator."""
    sf_dir = "/root/testdata/sf0.001"
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    classifier = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    scores = classifier.score(pa.array([r["text"] for r in rows], pa.string()))
    clean = [r for r, s in zip(rows, scores) if s < 0.5]
    kept = without_near_copies(clean)
    assert len(kept) < len(clean) < len(rows)
    texts = mixed(kept)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text in texts:
        want[doc_id, np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()] += 1
    pieces, sequences = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [at for at, _ in sorted(placed)] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.WINDOW
    # Every copy of a text is made up of pieces that lie end to end.
    for (doc_id, data), copies in want.items():
        total = len(data) // 4
        for _ in range(copies):
            at = 0
            while at < total:
                found = next(
                    p for p, n in pieces.items()
                    if n and p[:3] == (doc_id, total, at) and zlib.crc32(data[4 * at : 4 * (at + p[3])]) == p[4])
                pieces[found] -= 1
                at += found[3]
    assert not +pieces


def test_toxic_stage_of_odd_rows(spark, odd_docs, odd_rows):
    """Nulls, repeats and clashing names: what is not flagged stays as it was, columns of documents only."""
    classifier = toxicity.Classifier(np.full(toxicity.DIMENSIONS, -1), np.zeros(0), -10.0)
    kept = corpus_pipeline.keep_clean(odd_docs, classifier)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, odd_rows))
    everything = toxicity.Classifier(np.full(toxicity.DIMENSIONS, -1), np.zeros(0), 10.0)
    assert corpus_pipeline.keep_clean(odd_docs, everything).count() == 0
