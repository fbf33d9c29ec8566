import duckdb
import pytest

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401
from tidemark.llm import mixing


def by_sql(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return con.sql(mixing.oracle()).fetchall()


def same(df, want):
    key = lambda r: repr((r[0], r[1], r[2]))
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])
    assert sorted(map(repr, (g[0:1] + g[5:] for g in got))) == sorted(map(repr, (w[0:1] + w[5:] for w in want)))


def test_odd_rows_match_sql(odd_docs, odd_rows):
    same(mixing.mix(odd_docs), by_sql(odd_rows))


def test_targets_are_met_and_carried_columns_stay(odd_docs):
    rows = mixing.mix(odd_docs, carry=["text", "lang"]).collect()
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        at = taken.setdefault(r["source"], [0, r["target"], r["source_size"]])
        at[0] += r["taken"]
    for words, target, size in taken.values():
        assert abs(words - target) <= 0.5 and target <= 2 * size
    assert sum(t[1] for t in taken.values()) == pytest.approx(1.5 * sum(t[2] for t in taken.values()))


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1000], [0, 5, 0], [1000, 1, 1, 1], [7]])
def test_water_filling_matches_redistribution(spark, sizes):
    weights, caps = [(5, 2, 1)[i % 3] for i in range(len(sizes))], [2 * s for s in sizes]
    left, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = [i for i in open_ if share[i] > caps[i]]
        if not full:
            for i in open_:
                target[i] = share[i]
            break
        for i in full:
            target[i] = caps[i]
            left -= caps[i]
            open_.discard(i)
    rows = [(i, weights[i], sizes[i]) for i in range(len(sizes))]
    df = spark.createDataFrame(rows, "_rank int, weight int, size long")
    got = mixing.water_fill(df, "weight", "size", 1.5, 2).orderBy("_rank").collect()
    assert [r["target"] for r in got] == pytest.approx(target)


def test_no_documents(no_docs):
    assert mixing.mix(no_docs).count() == 0
