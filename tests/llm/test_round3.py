"""Merkle manifest, grid order join, hard negatives, components; brute force for the pipeline, language scores and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.llm import fingerprints, graph, grid_join, hard_negatives, language_id, merkle, near_dedup, packing, quality
from docweft.llm.shared import heavy_keys, join_split, keep_rows, numbered, text_key, written
from llm.test_llm import docs_of, odd_rows

NEW_LINES = [(20, "a\nb\n\nc", "en", "a"), (22, "\n", "en", "new"), (24, "x\ny", None, None), (26, "no line feed", "en", "")]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    i, _, lang, source = row
    n = len(row[1] or "")
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def plain_manifest(rows, arity):
    """doc_id -> leaf, subroot, root, proof, folded, verified; by lists alone."""
    def climb(nodes):
        paths, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(place):
                start = at // arity * arity
                run = nodes[start : start + arity]
                paths[k].append(("".join(run[: at - start]), "".join(run[at - start + 1 :])))
                place[k] = at // arity
            nodes = [H(*nodes[s : s + arity]) for s in range(0, len(nodes), arity)]
        return nodes[0], paths

    by = defaultdict(list)
    for row in rows:
        by[row[3]].append((row[0] is not None, row[0] or 0, plain_leaf(row, row[1]), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, above = climb([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for (_, _, leaf, row), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = plain_leaf(row, text)
            for before, after in path + up:
                folded = H(before, folded, after)
            out.append((row[0], leaf, trees[s][0], root, H(*[a + b for a, b in path + up]), folded, folded == root))
    return out


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_against_lists(spark, arity):
    rows = odd_rows() + NEW_LINES + [(100 + i, f"line {i}\nmore" if i % 3 else f"text {i}", "en", f"s{i % 4}" if i % 5 else "a") for i in range(120)]
    got = merkle.verified_documents(docs_of(spark, rows), arity).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows, arity))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, None, None, None)], [(2, "a", "en", "s"), (2, "a", "en", "s")], [(1, "x", "en", "a"), (2, "y", "en", "b")], [(None, "p", "en", "s"), (None, "q", "en", "s"), (5, "r", "en", "s")]):
        assert Counter(map(tuple, merkle.verified_documents(docs_of(spark, rows)).collect())) == Counter(plain_manifest(rows, 3) if rows else [])


def test_a_changed_row_changes_its_path_alone(spark):
    rows = [(i, f"text {i}", "en", "a" if i < 40 else "b") for i in range(60)]
    before, after = ({r[0]: r for r in map(tuple, merkle.verified_documents(docs_of(spark, x)).collect())} for x in (rows, [(i, t + "!" if i == 7 else t, la, s) for i, t, la, s in rows]))
    assert {i for i in before if before[i][1] != after[i][1]} == {7} and {i for i in before if before[i][2] != after[i][2]} == set(range(40)) and before[0][3] != after[0][3]


# ---- vectors ------------------------------------------------------------------------------------
VECTOR_DDL = "vec_id long, embedding array<{}>, label int, component_id long, n_links int, size long, row string"


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, lab, -1, -1, -1, "x") for i, v, lab in rows], VECTOR_DDL.format(kind))


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain_links(rows, cosine):
    links = defaultdict(set)
    for a, (_, v, _) in enumerate(rows):
        for b, (_, w, _) in enumerate(rows):
            if a < b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, dtype=float), np.array(w, dtype=float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if (x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    return links


def plain_components(rows, links):
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(links[a]), least, i == least))
    return out


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [], 1), (902, [0.0] * 6, 2), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (904, [nan] * 6, 3), (905, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], 3),
            (906, [1.0, 2.0], 4), (907, [2.0, 4.0], 4), (None, [1.0, 2.0], None), (908, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (909, [1e-30, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (910, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (910, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_grid_join_against_all_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(30):
        centre = rng.normal(size=6)
        for _ in range(1 + g % 9):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=6) * (0.05 + 0.05 * (g % 4))], g))
    rows += [(len(rows) + i, [1.0, 0.5, 0.25, 0.0, 0.0, 1.0], 1) for i in range(40)] + odd_vectors()  # a group of equal vectors
    rng.shuffle(rows := [tuple(r) for r in rows])
    rows = [(None if i is None else int(i), v, int(lab) if lab is not None else None) for i, v, lab in rows]
    for name, value in (("LEAF", 8), ("TILE_ROWS", 64)):  # many intervals
        monkeypatch.setattr(grid_join, name, value)
    got = grid_join.near_vectors(vectors_of(spark, rows, kind)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_components(rows, plain_links(rows, 0.95)))


def test_dense_groups_are_counted_whole(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=32)
    rows = [(i, (centre + rng.normal(size=32) * 0.01).tolist(), 0) for i in range(1500)] + [(1500 + i, rng.normal(size=32).tolist(), 0) for i in range(700)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.near_vectors(vectors_of(spark, rows)).collect()}
    assert all(got[i] == (1499, 0) for i in range(1500)) and all(got[i] == (0, i) for i in range(1500, 2200))


def test_intervals_are_linked_or_skipped_without_comparing(monkeypatch):
    """Two tight clusters far from each other: everything inside is linked by bounds, nothing between them is compared."""
    rng = np.random.default_rng(1)
    axes = np.eye(16)[: grid_join.GRID]
    raw = np.concatenate([np.eye(16)[k] + rng.normal(size=(600, 16)) * 0.001 for k in (0, 1)])
    monkeypatch.setattr(grid_join._Linker, "_compare", lambda *a: pytest.fail("compared"))
    part = grid_join._Intervals(raw, axes, 0)
    linker = grid_join._Linker(np.ones(1200, dtype=np.int64), 0.95)
    for a, b in (((0, 600), (0, 600)), ((600, 1200), (600, 1200)), ((0, 600), (600, 1200))):
        linker.join(part, a, part, b)
    assert (linker.links == 599).all() and len(np.unique(linker.labels)) == 2
    child, parent = linker.forest()
    assert len(child) == 1198 and max(Counter(parent.tolist()).values()) <= 2


def test_empty_vector_tables(spark):
    none = vectors_of(spark, [])
    assert grid_join.near_vectors(none).count() == 0 and hard_negatives.hard_negatives(none, F.lit(True)).count() == 0
    alone = grid_join.near_vectors(vectors_of(spark, [(900, None, 1), (902, [0.0], 1)])).collect()
    assert sorted(map(tuple, alone)) == [(900, 0, 900, True), (902, 0, 902, True)]


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    names = rng.sample(range(10**6), 400)
    chain, star, cycle = names[:150], names[150:300], names[300:400]
    links = list(zip(chain, chain[1:])) + [(star[0], x) for x in star[1:]] + list(zip(cycle, cycle[1:] + cycle[:1])) + [(cycle[0], cycle[0])]
    rng.shuffle(links)
    got = {r.row: r["class"] for r in graph.smallest_connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(group) for group in (chain, star, cycle) for x in group}
    assert graph.smallest_connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heavy_keys_are_split(spark):
    left = written(spark.range(6_000).select((F.col("id") % 7 * (F.col("id") % 3 == 0).cast("int")).alias("k"), "id"), "left")
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    heavy = heavy_keys(left, "k", 6_000)
    assert [r.k for r in heavy.collect()] == [0]
    for how in ("inner", "left"):
        assert Counter(map(tuple, join_split(left, right, "k", heavy, how).collect())) == Counter(map(tuple, left.join(right, "k", how).collect()))


# ---- hard negatives -----------------------------------------------------------------------------
def plain_negatives(rows, anchor, positives=5, negatives=3):
    took = []
    for at, (i, v, lab) in enumerate(rows):
        if lab is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v):
            took.append((at, i, lab, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for at, i, lab, q in took:
        if i is None or not anchor(i):
            continue
        scored = sorted(((sum(a * b for a, b in zip(q, p)), j, other, l2) for other, j, l2, p in took if other != at and len(p) == len(q)), key=key)
        for ps, pid, *_ in [x for x in scored if x[3] == lab][:positives]:
            fitting = [x for x in scored if x[3] != lab and 50 * ps <= 100 * x[0] <= 95 * ps][:negatives]
            out += [(i, pid, rank, nid, ps, ns) for rank, (ns, nid, *_) in enumerate(fitting, 1)]
    return out


def test_hard_negatives_against_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 6))
    rows = [(i, (centres[i % 6] + rng.normal(size=6) * 0.4).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(700 + i, [0.5] * 6, i % 2) for i in range(30)] + odd_vectors()[:8] + [(914, [1.0, 2.0], 4), (None, [0.5] * 6, 1)]
    rows = [(i, v, lab) for i, v, lab in rows if v is None or len(v) != 6 or all(x is None or not math.isfinite(x) or abs(x) < 1e6 for x in v)]
    for name, value in (("BLOCK", 32), ("GROUP", 16), ("PAGE", 4), ("FIRST", 2)):  # many blocks, groups and pages
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(hard_negatives, "_chunk", lambda most: F.lit(most))
    got = hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 7 == 0).collect()
    assert Counter(map(tuple, got)) == Counter(plain_negatives(rows, lambda i: i % 7 == 0)) and len(got) > 300


def test_blocks_that_cannot_help_are_not_read(spark, monkeypatch):
    """Labels in far corners: an anchor's positives are read from its own label's blocks only."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] * 4 + rng.normal(size=8) * 0.01], i % 8) for i in range(800)]
    read, plain = [], hard_negatives._read

    def counted(groups, blocks, pairs, *rest):
        read.append((pairs.count(), groups.count() * blocks.count()))
        return plain(groups, blocks, pairs, *rest)

    monkeypatch.setattr(hard_negatives, "_read", counted)
    monkeypatch.setattr(hard_negatives, "_chunk", lambda most: F.lit(25))
    hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 8 == 3).count()
    assert read[0][0] <= read[0][1] / 7 and read[1][0] == 0


def test_hilbert_curve_goes_step_by_step():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ---- repeated rows, ranges, languages -----------------------------------------------------------
@pytest.mark.parametrize("k", range(6))
def test_as_many_repeated_rows_stay_as_are_decided(spark, k):
    rows = [(1, "same", "en", "a")] * 3 + [(1, "same", "fr", "b"), (2, "other", "en", "a"), (None, "same", "en", "a"), (None, "same", "en", "a")]
    docs = docs_of(spark, rows)
    marked = docs.select("doc_id", text_key().alias("text_key"), "text", F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    want, seen, decided = Counter(), Counter(), []
    for r in marked:
        group = (r.doc_id, r.text)
        kept = seen[group] < k
        seen[group] += 1
        want[group] += kept
        decided.append((r.doc_id, r.text_key, kept))
    got = keep_rows(docs, spark.createDataFrame(decided, "doc_id long, text_key long, kept boolean"))
    assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == +want


def test_numbers_run_through_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i // 50) for i in range(3000)]
    got = numbered(written(spark.createDataFrame(rows, "group string, n int"), "rows"), "group", ["n"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.group].append((r.idx, r.n, r.of))
    for group, own in by.items():
        assert sorted(x[0] for x in own) == list(range(len(own))) and {x[2] for x in own} == {len(own)}
        assert [n for _, n, _ in sorted(own)] == sorted(n for g, n in rows if g == group)


def test_short_pieces_fill_their_sequences(spark):
    rng = random.Random(6)
    for lengths in ([1 + rng.randint(0, 9) for _ in range(20_000)], [1] * 5_000 + [rng.randint(1, 900) for _ in range(10_000)], [7] * 30_000):
        pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, start long, length long")
        ids = [r.n for r in packing.packed(pieces).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
        assert max(ids) <= 4096 and sum(ids) == sum(lengths) and sum(lengths) / (4096 * len(ids)) >= 0.95


def plain_bayes(rows, learn):
    """Language and score of each text, gram by gram."""
    size, counts, total = 1 << language_id.BUCKET_BITS, defaultdict(Counter), Counter()
    grams = lambda t: [b for part in language_id._grams(t or "", language_id.BUCKET_BITS) for b in part.tolist()]
    for text, lang in learn:
        if lang is not None:
            counts[lang].update(grams(text))
    for lang in counts:
        total[lang] = sum(counts[lang].values())
    out = []
    for text in rows:
        if text is None or not any(map(str.isalpha, text)) or not counts:
            out.append(("und", 0.0))
            continue
        own = grams(text)
        logs = {lang: sum(math.log((counts[lang][b] + 1) / (total[lang] + size)) for b in own) / math.sqrt(len(own)) for lang in sorted(counts)}
        best = max(sorted(logs), key=lambda x: logs[x])
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


@pytest.mark.parametrize("slice_", [128, 2])
def test_languages_against_plain_bayes(spark, monkeypatch, slice_):
    monkeypatch.setattr(language_id, "SLICE", slice_)  # one broadcast, or several slices one after another
    rng = random.Random(8)
    letters = {"en": "etaoin shr", "de": "enisra tdhu", "fr": "esaitn rulo", "xx": "zqxjk vw"}
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(0, 200))), lang, "a") for i, lang in enumerate(list(letters) * 30)]
    rows += [(500, None, "en", "a"), (501, "", None, "a"), (502, "123", "en", "a"), (503, rows[0][1], None, "b"), (503, rows[0][1], None, "b"), (None, "no id here", "en", "a")]
    learn = [(t, lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 4 != 2]
    want = plain_bayes([t for _, t, *_ in rows], learn)
    got = language_id.identified(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 3)) for r in got) == Counter((i, lang, round(score, 3)) for (i, *_), (lang, score) in zip(rows, want))


def test_any_number_of_languages(spark):
    word = lambda i: "".join(chr(97 + (i // 17**k) % 17 + k) for k in range(3))
    rows = [(4 * i, f"{word(i)} " * 30, f"l{i:04d}", "a") for i in range(300)]
    got = language_id.identified(docs_of(spark, rows)).collect()
    assert len(got) == 300 and sum(r.lang_pred == f"l{r.doc_id // 4:04d}" for r in got if not r.held_out) >= 0.95 * sum(not r.held_out for r in got)


def test_far_ids_and_repeated_ids_keep_their_order(spark):
    rows = [(i, f"text number {i} " * (1 + i % 5), "en", "a") for i in range(60)] + [(1 << 60, "far away " * 9, "en", "a"), (-(1 << 60), "far below " * 9, "en", "a")]
    rows += [(None, f"no id {i % 3} " * 20, "en", "a") for i in range(30)] + [(7, "again " * 30, "en", "a")] * 20
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = fingerprints.edited_fingerprints(docs_of(spark, rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(rows)
    after = {}
    ordered = sorted({i for i, *_ in rows if i is not None}, reverse=True)
    texts = {i: t for i, t, *_ in rows if i is not None and i != 7}
    for i, j in zip(ordered, ordered[1:]):
        if 7 not in (i, j):
            after[i] = texts[j]
    for r in got:
        if r.doc_id in after:
            text = texts[r.doc_id]
            edited = text[: len(text) - len(text) // 3] + after[r.doc_id][: len(text) // 3]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert sum(r.doc_id is None for r in got) == 30 and sum(r.doc_id == 7 for r in got) == 21


def test_weights_depend_on_shares_alone():
    """A shingle in 1 % of the rows weighs less than one in 0.01 %, and weighs the same in a table of any size."""
    rng = np.random.default_rng(3)
    found = []
    for rows in (20_000, 10_000_000):
        counts = rng.poisson(rows * 200 / (1 << near_dedup.IDF_BITS), 1 << near_dedup.IDF_BITS).astype(float)
        counts[:3] += [rows / 3, rows / 100, rows / 10_000]
        found.append(near_dedup.levels_by_share(counts, rows)[:3].tolist())
    assert found[0] == found[1] and found[0][0] < found[0][1] < found[0][2] == near_dedup.IDF_LEVELS - 1


# ---- the pipeline -------------------------------------------------------------------------------
def pipeline_rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    good = [" ".join(word() for _ in range(rng.randint(40, 90))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None) for i, t in enumerate(good)]
    rows += [(100 + i, good[i], "en", "s0") for i in range(0, 30, 3)] + [(200 + i, good[i].replace(" ", "  "), "en", "s1") for i in range(0, 12, 4)]
    for i in range(0, 40, 5):  # near copies
        words = good[i].split()
        words[rng.randrange(len(words))] = word()
        rows.append((300 + i, " ".join(words), "en", "s2"))
    rows += [(400 + i, "### $$$ !!! " * rng.randint(10, 30), "en", "s3") for i in range(20)]
    return [(1000 + i, *rest) for i, *rest in rows] + odd_rows()


def test_pipeline_against_plain_stages(spark, tmp_path):
    from corpus_pipeline import run

    import public_tokenizers
    from tokenizers import Tokenizer

    rows = pipeline_rows()
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(60)] + [(1400 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = run(spark, str(tmp_path)).collect()
    # quality: its decisions are held against plain counts in test_quality_against_brute_force
    kept = Counter()
    for r in quality.importance_resampled(docs, labels).collect():
        kept[r.doc_id, r.text_key] += r.kept
    keys = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", text_key().alias("k")).collect()}
    now = []
    for row in rows:
        if kept[row[0], keys[row[0], row[1]]] > 0:
            kept[row[0], keys[row[0], row[1]]] -= 1
            now.append(row)
    # exact copies: most code points, then the smallest id
    groups = defaultdict(list)
    for at, row in enumerate(now):
        groups["".join(c for c in row[1] or "" if c not in " \t\n\x0b\x0c\r")].append((-len(row[1] or ""), row[0] is None, row[0] or 0, at))
    now = [now[min(g)[3]] for g in groups.values()]
    # near copies: components of pairs, the smallest id stays
    stage = docs_of(spark, now)
    levels = near_dedup.idf_levels(stage)
    sets = []
    for _, text, *_ in now:
        own, level = near_dedup.leveled(near_dedup.shingles(near_dedup.word_hashes(text or "")), levels)
        sets.append(((own & ~np.uint64(63)) | level.astype(np.uint64)).astype("<u8").tobytes())
    label = list(range(len(now)))
    for a in range(len(now)):
        for b in range(a):
            if (now[a][1] or "").lower().split() == (now[b][1] or "").lower().split() or near_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8:
                label = [label[b] if x == label[a] else x for x in label]
    classes = defaultdict(list)
    for at, x in enumerate(label):
        classes[x].append((now[at][0] is None, now[at][0] or 0, at))
    now = [now[min(c)[2]] for c in classes.values()]
    # mixing: whole hashes in order until the source's target is nearest
    size = lambda t: len((t or "").split()) if not any(ord(c) > 127 for c in t or "") else len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w])
    sums = defaultdict(int)
    for row in now:
        sums[row[3]] += size(row[1])
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = 1.5 * sum(sums.values()) - sum(target.values())
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * unit > 2 * sums[s]}
        if not over:
            break
        target |= {s: 2.0 * sums[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * unit for s in open_}
    taken = defaultdict(int)
    times = Counter((r.doc_id) for r in got if r.start == 0)
    by_row = {row[0]: row for row in now}
    assert set(times) <= set(by_row) and max(times.values()) <= 2
    for i, n in times.items():
        taken[by_row[i][3]] += n * size(by_row[i][1])
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size(row[1]) for row in now if row[3] == s)
    assert {row[0] for row in now if size(row[1]) and target[row[3]] >= 2 * sums[row[3]]} <= set(times)
    # packing: every id of every copy once
    whole = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for i, n in times.items():
        ids = [*whole.encode(by_row[i][1] or "", add_special_tokens=False).ids, 2]
        own = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert sum(length for _, length, _ in own) == n * len(ids) and {r.doc_tokens for r in got if r.doc_id == i} == {len(ids)}
        for start, length, crc in own:
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    from corpus_pipeline import STAGES

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], odd_rows()):
        docs = docs_of(spark, rows)
        for name, stage in STAGES:
            after = written(stage(spark, docs, str(tmp_path)), name)
            assert (after.count() == 0) == (not rows)
            if name != "packing":
                assert after.columns == docs.columns and [f.dataType for f in after.schema.fields] == [f.dataType for f in docs.schema.fields]
                docs = after


def test_every_labelled_document_is_a_target(spark):
    """More good labels than any sample would take: each is found by bitmaps of near ids, and by a join where ids lie far apart."""
    rows = spark.range(0, 60_000, 1, 4)
    near = rows.select((F.col("id") - 30_000).alias("doc_id"))
    for spread, most in ((1, quality.MOST_BITMAPS), (10**13, quality.MOST_BITMAPS), (1, 0)):
        docs = near.select((F.col("doc_id") * spread).alias("doc_id"), F.lit("a b").alias("text")).unionByName(
            spark.createDataFrame([(None, "x"), (7 * spread, "again")], "doc_id long, text string"))
        labels = docs.filter(F.col("doc_id") % 2 == 0).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).unionByName(
            docs.filter(F.col("doc_id") % 2 == 1).select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))) if spread == 1 else docs.filter(
            F.col("doc_id") % (2 * spread) == 0).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
        want = {r["__target"]: r["__fit"] for r in quality.target_sample(labels).collect()}
        assert len(want) == 30_000 and 14_000 < sum(want.values()) < 16_000
        got = [(r.doc_id, r["__fit"]) for r in quality.marked_targets(docs, labels, most).collect()]
        assert len(got) == 60_002 and all(fit == want.get(doc_id) for doc_id, fit in got)
