from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
import xxhash

from cases import frame, odd_rows
from corpuslab.llm import common, components, exact, simhash
from corpuslab.llm.common import table


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, radius=3):
    """Index of the group of each row by comparing all pairs."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def plain_groups(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    ids = defaultdict(list)
    groups = plain_components(prints)
    for r, g in zip(rows, groups):
        if r[0] is not None:
            ids[g].append(r[0])
    return Counter((r[0], f"{p:016x}", min(ids[g], default=None)) for r, p, g in zip(rows, prints, groups))


def check_exact(rows, got):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(rows)
    kept = Counter()
    for g in got:
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == g["text_sha256"])
        assert g["group_size"] == len(ids)
        assert g["keep_id"] == max((i for i in ids if i is not None), default=None)
        if g["kept"]:
            kept[g["text_sha256"]] += 1
            assert g["doc_id"] == g["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_odd_rows(spark):
    rows = odd_rows()
    check_exact(rows, exact.exact_groups(frame(spark, rows)).collect())


def test_exact_keeps_columns(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len({r[1] or "" for r in rows})
    assert not Counter(map(tuple, kept.collect())) - Counter(rows)


def test_exact_rows_leave_without_their_columns(spark, monkeypatch):
    """No text is written beside the bytes still to be split, and what goes meets the rows where they are."""
    written, write = [], exact.saved
    monkeypatch.setattr(exact, "saved", lambda df: written.append(df) or write(df))
    rows = odd_rows()
    # Spark itself broadcasts nothing.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = exact.drop_exact_copies(frame(spark, rows))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert len(kept.collect()) == len({r[1] or "" for r in rows})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written and not any("n_chars" in df.schema.simpleString() for df in written)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_exact_repeated_ids_and_rows(spark, monkeypatch, few):
    """One row of each text stays, however often id and text come, for few keys and many."""
    monkeypatch.setattr(common, "FEW_KEYS", few)
    rows = [(i, t) for i in (None, 1, 1, 2, 2) for t in (None, "", "a", "b" * 70)] + [(None, "n"), (None, "n"), (3, "a"), (3, "c"), (3, "c")]
    kept = exact.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in kept) == Counter([(2, ""), (3, "a"), (2, "b" * 70), (None, "n"), (3, "c")])


def test_exact_third_of_all_rows(spark):
    rows = [(k, "same text " * 20 if k % 3 == 0 else f"text {k} " * 20, *[None] * 9) for k in range(600)]
    check_exact(rows, exact.exact_groups(frame(spark, rows)).collect())


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact.exact_groups(empty).count() == 0
    assert exact.drop_exact_copies(empty).columns == empty.columns
    assert simhash.near_groups(empty).count() == 0
    assert simhash.keep_one_per_group(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_odd_rows(spark, seed):
    rows = odd_rows(seed)
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == plain_groups(rows)


def test_simhash_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, simhash.near_groups(docs).collect())) == plain_groups(rows)


def test_links_with_small_tiles(spark):
    """Chains of fingerprints a few bits apart, with tiles of two rows: no link is lost."""
    import random

    rng = random.Random(4)
    prints = set()
    for _ in range(40):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(fp)
            for _ in range(rng.randint(1, 4)):
                fp ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 3, tile_rows=2)
    roots = {r["node"]: r["root"] for r in components.connected(links, "a", "b").collect()}
    got, want = defaultdict(set), defaultdict(set)
    for s, g in zip(signed, plain_components(prints)):
        got[roots.get(s, s)].add(s)
        want[g].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_keep_one_per_group(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    want = {i for i, _, c in plain_groups(rows) if i == c}
    assert {r["doc_id"] for r in simhash.keep_one_per_group(docs).collect()} == want


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 200)] + [(7, k) for k in range(300, 700)] + [(5, 5), (None, 3), (1, None)]
    roots = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert roots == {k: 100 for k in range(101, 201)} | {k: 7 for k in range(300, 700)}
