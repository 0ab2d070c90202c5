"""The near-dedup stage against all pairs of shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline
from cases import frame, odd_rows, words
from corpuslab.llm import shingles
from corpuslab.llm.common import table


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_stay(rows):
    """Ids that name their component, over all pairs."""
    sets, group = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                group = [group[i] if g == group[j] else g for g in group]
    first = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            first[g] = min(first.get(g, doc), doc)
    return {doc for (doc, _), g in zip(rows, group) if doc == first.get(g)}


def edited_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = words(rng, rng.choice([1, 4, 20, 45, 50, 100, 200, 500])).split(" ")
        for k in range(4):
            copy = list(base)
            for _ in range(k * len(base) // 60 if k < 3 else len(base) // 6):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_near_stage_finds_all_that_are_alike(spark):
    rows = edited_rows(5, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, "").collect()}
    want = plain_stay(rows)
    assert got == want
    assert 40 < len(rows) - len(want)


def test_near_stage_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, sf_dir).collect()} == plain_stay(rows)


def test_odd_rows(spark):
    rows = odd_rows()
    got = {r["doc_id"] for r in shingles.keep_one_per_group(frame(spark, rows)).collect()}
    assert got - {None} == plain_stay([r[:2] for r in rows]) - {None}
    assert shingles.keep_one_per_group(frame(spark, [])).count() == 0


def test_documents_are_not_shuffled_for_few_that_go(spark):
    rows = edited_rows(5, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Spark itself broadcasts nothing.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = shingles.keep_one_per_group(docs)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert {r["doc_id"] for r in left.collect()} == plain_stay(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_bands_agree_at_the_similarity():
    rng = random.Random(8)
    missed = 0
    for _ in range(2000):
        common, rest = [rng.getrandbits(64) for _ in range(80)], [rng.getrandbits(64) for _ in range(20)]
        a, b = (shingles.np.array(common + part, shingles.np.uint64) for part in (rest[:10], rest[10:]))
        missed += not set(shingles.band_keys(a)) & set(shingles.band_keys(b))
    assert missed <= 2


def test_common_counts():
    rng = random.Random(2)
    sets = [sorted({rng.randrange(9000) for _ in range(n)}) for n in (0, 1, 50, 4000, 6000, 6000)]
    arrays = [shingles.np.array(s, shingles.np.int64) for s in sets]
    got = shingles.common_counts(arrays[:3], arrays[2:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[2:]] for a in sets[:3]]


def clustered(n, most=4, seed=3):
    """Copies of one text with up to ``most`` of its 120 words changed; each change breaks five shingles."""
    rng = random.Random(seed)
    base = words(rng, 120).split(" ")
    rows = []
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randint(0, most)):
            copy[at] = words(rng, 1)
        rows.append((k * 7 % n, " ".join(copy)))
    return rows


def test_large_groups_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(shingles, "TILE_ROWS", 8)
    rows = clustered(150) + [(i + 1000, t) for i, t in edited_rows(6, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in shingles.keep_one_per_group(docs).collect()} == plain_stay(rows)


def test_rows_of_the_comparison_grow_with_the_group(spark, monkeypatch):
    """Twice the members of a group that coheres, about twice the rows that tasks compare."""
    monkeypatch.setattr(shingles, "TILE_ROWS", 16)
    links, counts = shingles._links, []

    def counted(dealt, similarity):
        counts[-1] += dealt.count()
        return links(dealt, similarity)

    monkeypatch.setattr(shingles, "_links", counted)
    for n in (200, 400):
        counts.append(0)
        shingles.near_groups(spark.createDataFrame(clustered(n, 2), "doc_id long, text string")).count()
    assert counts[1] < 2.4 * counts[0]
