"""Each stage against brute force on its own input."""

import importlib

import pytest
from test_dedup import brute_groups, brute_repeats

from tessella.llm import fertility, longest_match

pipeline = importlib.import_module("corpus_pipeline")


def rows_of(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, found = [docs], docs
    for name, stage in pipeline.STAGES:
        found = pipeline.materialize(stage(spark, found, ""), name)
        out.append(found)
    return out


def test_quality_keeps_what_the_rules_keep(stages, docs):
    kept = fertility.fertility(docs.select(*pipeline.COLUMNS)).filter("kept")
    assert sorted(rows_of(stages[1]), key=str) == sorted(rows_of(kept), key=str)


def test_one_document_of_each_group_stays(stages):
    before = [(r[0], r[1]) for r in rows_of(stages[1])]
    groups, _ = brute_groups(before)
    assert sorted(r[0] for r in rows_of(stages[2]) if r[0] is not None) == sorted({c for c in groups.values()})


def test_near_duplicates_take_five_words(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join("v" if i in at else w for i, w in enumerate(words)) for at in ((), (10, 30, 50), (30,))]
    df = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r[0] for r in rows_of(pipeline.near_duplicates(spark, df, ""))) == [0, 1]


def test_repeats_are_cut(stages):
    before, after = rows_of(stages[2]), {r[0]: r for r in rows_of(stages[3]) if r[0] is not None}
    want = brute_repeats([(r[0], r[1]) for r in before if r[0] is not None])
    for i, (n, removed, _, _) in want.items():
        if n > removed:
            assert n - removed - 6 * 3 <= len(after[i][1].encode()) <= n - removed and after[i][4] == len(after[i][1])
        else:
            assert i not in after


def test_mix_repeats_documents(stages):
    before, after = {r[0]: r for r in rows_of(stages[3])}, rows_of(stages[4])
    assert all(before[r[0]] == r for r in after)
    assert max(sum(x[0] == i for x in after) for i in before) <= 2


def test_packing_takes_every_token(stages):
    want = sum(r["n_tokens"] for r in longest_match.token_counts(stages[4].select("doc_id", "text")).collect())
    assert sum(r["tokens"] for r in stages[5].collect()) == want


def test_columns_and_run(spark, folder, stages):
    for df in stages[1:5]:
        assert df.columns == list(pipeline.COLUMNS)
    assert pipeline.run(spark, folder).count() == stages[5].count()


def test_empty_documents(spark, nothing):
    found = nothing
    for _, stage in pipeline.STAGES:
        found = stage(spark, found, "")
    assert found.count() == 0


def test_mix_meets_the_targets_of_its_input(stages):
    from collections import Counter

    from test_mix_and_packing import water_fill, words

    before, after = rows_of(stages[3]), rows_of(stages[4])
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += words(r[1])
    for r in after:
        taken[r[3]] += words(r[1])
    largest, target = max(words(r[1]) for r in before), water_fill(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in target)


def test_mix_of_repeated_and_null_rows(spark):
    rows = [(1, "a b c", "en", "s1", 5)] * 3 + [(1, "other words", "en", "s1", 5), (None, "x y", None, None, None), (None, "x y", None, None, None), (2, None, "de", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = rows_of(pipeline.mixing(spark, df, ""))
    assert set(after) <= set(rows) and all(after.count(r) <= 2 * rows.count(r) for r in set(rows))
    assert after.count(rows[-1]) == 1


def test_the_row_that_stays_does_not_depend_on_partitions(spark):
    rows = [(1, f"text {i} of the same identifier", "en", f"s{i}", i) for i in range(9)]
    found = set()
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        found.add(tuple(rows_of(pipeline.near_duplicates(spark, df, ""))))
    assert len(found) == 1 and len(next(iter(found))) == 1
