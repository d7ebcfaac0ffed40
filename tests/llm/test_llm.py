"""The dealt operators: edge cases of every input, and brute-force versions of what SQL cannot express."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracle import compare, connect
from docweft.llm import chat, exact_dedup, fingerprints, language_id, mixing, near_dedup, packing, quality, sharding, warc
from docweft.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long, row long, rank int, hash string, kept string, bucket int"
EXTRA = (7, 1, "x", "y", 2)
LONG = "lorem ipsum dolor " * 40_000


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *EXTRA) for i, t, lang, source in rows], DOCS_DDL)


def odd_rows():
    words = random.Random(5)
    varied = " ".join(words.choice("abcdefgh") * words.randint(1, 9) for _ in range(400))
    return [
        (1, "same text here", "en", "a"), (2, "same  text\there", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n ", "fr", None),
        (6, LONG, "en", "a"), (7, varied, "de", "b"), (7, varied, "de", "b"), (None, "no id", "fr", "c"), (8, varied + " tail", "de", "b"),
        (9, "déjà vu 日本", "fr", "a"), (10, "12345 !!!", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, name):
    _, n_rows, problem = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLE[name], SF_DIR)
    assert problem is None and n_rows > 0


def test_exact_dedup_edges(odd, none):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(odd).collect()]
    assert (2, 2, 2, True) in got and (1, 2, 2, False) in got  # more code points stay
    assert {r[:3] for r in got if r[0] in (3, 4, 5)} == {(3, 5, 3), (4, 5, 3), (5, 5, 3)}
    assert sorted(r[3] for r in got if r[0] == 7) == [False, True]
    assert (None, None, 1, True) in got and len(got) == 12
    assert exact_dedup.exact_duplicates(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([2, 5, 6, 7, None, 8, 9, 10])


def test_exact_dedup_with_a_heavy_group(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"own {i % 1500}", "en", "a") for i in range(4000)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs_of(spark, rows), 0.01).collect()}
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups["".join(text.split())].append((-len(text), i))
    assert got == {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_chat_round_trip(spark):
    J = "⁠"
    texts = ["</s>[INST] ok", "<|turn|>user<|text|>", f"<{J}|sep|> <{J}{J}/s>", "<", "|end|>", None, "", f"[{J}INST]"]
    rows = [(c, i, role, t) for c, roles in ((1, "uuaaua"), (2, "asau"), (None, "a")) for i, (role, t) in enumerate(zip(roles, texts[c or 0 :]))]
    rows += [(3, 1, None, "x"), (3, 1, None, "x"), (3, None, "us\ner<|", "first")]
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(c, i, names.get(r, r), t, "extra") for c, i, r, t in rows]
    made = chat.formatted_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((i is not None, i, r or "", t or "") for c, i, r, t, _ in rows if c == conv), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, t) for _, _, r, t in own]
        assert got[conv].loss == "".join(t for _, _, r, t in own if r == "assistant")
    assert got[1].formatted.count("<|turn|>") == 4 and got[1].formatted.count("<|sep|>") == 2
    assert made.filter("false").count() == 0


def test_sharding_law(spark, odd, none):
    rows = [(i, "x" * (i % 50), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(2000)]
    got = sharding.shard_rows(docs_of(spark, rows), 24).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 2000 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    for shard, n in sizes.items():
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(n))
        for source, total in Counter(r[3] for r in rows).items():
            assert abs(sum(r.source == source for r in own) - total / 24) <= 2
    text = dict((i, t) for i, t, *_ in rows)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id]) + 8 for r in got)
    assert sorted(r.slot for r in sharding.shard_rows(odd, 5).filter("shard = 0").collect()) == [0, 1, 2]
    assert sharding.shard_rows(none).count() == 0


def test_mixing_targets(spark, odd, none):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", None if i % 11 == 0 else f"s{min(i % 9, 4)}") for i in range(3000)]
    got = mixing.mixture(docs_of(spark, rows)).collect()
    sizes, taken, targets = Counter(), Counter(), {}
    source = {i: s for i, _, _, s in rows}
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal, capped = 1.5 * sum(sizes.values()), set()
    while True:  # share out again until nobody is above
        unit = (goal - sum(2 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        above = {s for s, w in weights.items() if s not in capped and w * unit > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    for s in sizes:
        assert math.isclose(targets[s], 2 * sizes[s] if s in capped else weights[s] * unit, rel_tol=1e-9)
        assert abs(taken[s] - targets[s]) <= 40
    assert mixing.mixture(none).count() == 0 and mixing.mixture(odd).count() == 12
    out = mixing.mixed(docs_of(spark, rows))
    assert out.columns == none.columns and Counter(r.doc_id for r in out.collect()) == +Counter({r.doc_id: r.times for r in got})


def test_packing_round_trip(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(path)
    rows = odd_rows() + [(20, "It's <|endoftext|> ΣΑΣ, don't’s é́ İ. a_b ab\xa0cd ef\x1cgh ½² x" + "y" * 90, "en", "a")]
    docs = docs_of(spark, rows)
    pieces = packing.token_pieces(docs, path, 256).cache()
    ids = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: r.start):
        ids[r.doc_id].append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist(), r.doc_tokens))
    for i, text, *_ in rows:
        want = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        copies = sum(r[0] == i for r in rows)
        assert sum(len(p) for _, p, _ in ids[i]) == copies * len(want) and all(n == len(want) for *_, n in ids[i])
        assert all(p == want[s : s + len(p)] for s, p, _ in ids[i])
    placed = packing.packed(pieces.select("doc_id", "start", "length"), 256, 16).collect()
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by))) and len(placed) == pieces.count()
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    joined = packing.packed_sequences(pieces.filter("doc_id = 6"), packing.packed(pieces.filter("doc_id = 6").drop("ids"), 256)).collect()
    assert sum(len(r.ids) // 4 for r in joined) == sum(len(p) for _, p, _ in ids[6])
    assert packing.packed(packing.token_pieces(none, path).drop("ids")).count() == 0


def test_patterns_are_near_the_bound():
    rng = np.random.default_rng(3)
    counts = Counter(np.clip(rng.lognormal(3, 0.8, 20_000).astype(int), 1, 256).tolist())
    plan = packing.plan_sequences(counts, 256)
    packed = Counter()
    for times, held in plan:
        assert sum(s * n for s, n in held.items()) <= 256
        for s, n in held.items():
            packed[s] += times * n
    assert packed == counts
    need = sum(s * n for s, n in counts.items()) / 256
    assert sum(t for t, _ in plan) <= 1.01 * need + 1


def test_best_pattern_against_all():
    rng = random.Random(1)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(2, 12), 3)))
        prices = np.array([rng.random() for _ in sizes])
        best = max(sum(n * p for n, p in zip(ns, prices)) for ns in np.ndindex(12, 12, 12) if (np.array(ns) * sizes).sum() <= 20)
        worth, pattern = packing.best_pattern(prices, sizes, 20)
        assert math.isclose(worth, best) and math.isclose((pattern * prices).sum(), best) and (pattern * sizes).sum() <= 20


def test_fingerprints_of_neighbours(spark, odd, none):
    rows = [r for r in odd_rows() if r[0] != 7] + [(i, f"text {i} " * (i % 7), "en", "a") for i in range(50, 90)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs_of(spark, rows)).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    import hashlib

    for (i, text, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == fingerprints.fingerprint(text) and got[i].edited_fingerprint == fingerprints.fingerprint(edited)
        assert got[i].near_next == fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(after))
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.edited_fingerprints(odd).count() == 12


def test_edit_distance_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        assert fingerprints.edit_distance(a, b) == row[-1]
    text = " ".join(str(rng.random()) for _ in range(300))
    one = fingerprints.fingerprint(text)
    assert 0.5 < fingerprints.likeness(one, fingerprints.fingerprint(text[:4000] + "other words " * 60)) < 1
    assert fingerprints.likeness(one, fingerprints.fingerprint(text[::-1])) == 0


def test_warc_round_trip(spark, none):
    html = ["<p>a</p>", None, "", "x\r\n\r\n", "\r\n", "x\r\n\r\n\r\nWARC/1.1\r\n\r\n", "é日" * 9, "<p>a</p>", "<p>a</p>"]
    rows = [(i, f"http://h.org/{i}" if i % 2 else None, t, "extra") for i, t in enumerate(html)] + [(None, "u", "lone", "e"), (8, "again", "<p>a</p>", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, response string")
    path = warc.new_path(spark, "test-warc")
    warc.write_archives(warc.captures(pages), path)
    records = warc.read_records(spark, path, with_payload=True).cache()
    assert Counter(r.type for r in records.collect()) == Counter(request=11, metadata=11, response=7, revisit=4)
    assert sorted(r.payload for r in records.filter("type = 'response'").collect()) == sorted({t or "" for t in [*html, "lone"]})
    assert records.filter("NOT intact").count() == 0
    captures = warc.assembled(records).collect()
    assert len(captures) == 11 and all(len(c.requests) == len(c.metadata) == 1 for c in captures)
    main = next(c for c in captures if c.response.type == "response" and c.response.payload == "<p>a</p>")
    assert main.metadata[0].page_id == 8
    assert sorted(c.metadata[0].page_id for c in captures if c.response.refers_to == main.capture_id) == [0, 7, 8]
    assert warc.archived(pages.filter("false")).count() == 0


def test_warc_that_is_cut_off():
    head = b"WARC/1.1\r\nContent-Length: 10"
    assert list(warc._raw_records([("f", head), ("f", b"0123456789")])) == [(head, b"0123456789")]
    with pytest.raises(ValueError):
        list(warc._raw_records([("f", head), ("f", b"0123")]))


def test_language_held_out_accuracy(spark, odd, none):
    got = language_id.identified(spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("score", F.lit("x")))
    rows = got.join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    away = [r for r in rows if r.held_out]
    assert {r.doc_id for r in away} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in away) >= 0.97 * len(away) and all(0 <= r.score <= 1 for r in rows)
    small = {r.doc_id: r.lang_pred for r in language_id.identified(odd).collect()}
    assert small[3] == small[4] == small[5] == small[10] == "und" and len(small) == 11
    assert language_id.identified(none).count() == 0


def test_quality_against_brute_force(spark, odd, none):
    rng = random.Random(9)
    good, bad = "alpha beta gamma delta epsilon".split(), "!!! ### $$$ ??? ***".split()
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(rng.randint(20, 60))), "en", "a") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in quality.importance_resampled(docs, labels).collect()}
    sample = {r["__target"]: r["__fit"] for r in quality.target_sample(labels).collect()}
    raw, target = Counter(), Counter()
    features = {}
    make = quality._Features(quality.BUCKET_BITS)
    for i, text, *_ in rows:
        features[i] = Counter(x for there in make(text) for x in there.tolist())
        raw.update(features[i])
        if sample.get(i):
            target.update(features[i])
    size = 1 << quality.BUCKET_BITS
    total, n = sum(raw.values()) + size / 2, sum(target.values())
    for i, own in features.items():
        want = sum(c * (math.log((target[b] + quality.SMOOTHING * (raw[b] + 0.5) / total) / (n + quality.SMOOTHING)) - math.log((raw[b] + 0.5) / total)) for b, c in own.items())
        assert math.isclose(got[i].log_ratio, want, rel_tol=1e-6, abs_tol=1e-6)
    kept = [r for r in got.values() if r.kept]
    assert min(r.key for r in kept) > max(r.key for r in got.values() if not r.kept)
    assert sum(i % 5 > 0 for i in (r.doc_id for r in kept)) >= 0.97 * 480 and not any(r.doc_id % 5 == 0 for r in kept)
    some = quality.importance_resampled(docs, labels, k=100).filter("kept")
    assert some.count() == 100 and {r.doc_id for r in some.collect()} == {r.doc_id for r in sorted(got.values(), key=lambda r: -r.key)[:100]}
    assert quality.importance_resampled(odd, labels.filter("false")).filter("kept").count() == 12
    assert quality.importance_resampled(none, labels).count() == 0


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, passage = [], " ".join(word() for _ in range(60))
    for g in range(40):
        base = [word() for _ in range(rng.randint(60, 200))]
        for edits in (0, 1, 2, 6, 25)[: 1 + g % 5]:
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text) + (" " + passage if g % 4 == 0 else ""), "en", "a"))
    rows += [(1000, rows[0][1].upper().replace(" ", "  "), "en", "a"), (1001, "two words", "en", "a"), (1002, "two words", "en", "a")]
    docs = docs_of(spark, rows)
    levels = near_dedup.idf_levels(docs)
    pack = lambda t: (lambda o, lv: ((o & ~np.uint64(63)) | lv.astype(np.uint64)).astype("<u8").tobytes())(*near_dedup.leveled(near_dedup.shingles(near_dedup.word_hashes(t)), levels))
    sets = {i: pack(t) for i, t, *_ in rows}
    over = {i: i for i in sets}

    def top(i):
        while over[i] != i:
            i = over[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and near_dedup.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                over[max(top(i), top(j))] = min(top(i), top(j))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: top(i) for i in sets}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    small = near_dedup.near_duplicates(odd).collect()
    classes = {r.doc_id: r.class_id for r in small}
    assert len(small) == 12 and classes[1] == classes[2] == 1 and classes[3] == classes[4] == classes[5] == 3 and classes[8] == 7
    assert sum(r.kept for r in small if r.doc_id == 7) == 1
    assert near_dedup.near_duplicates(none).count() == 0
    assert Counter(r.doc_id for r in near_dedup.drop_near_duplicates(odd).collect()) == Counter([1, 3, 6, 7, None, 9, 10])


def test_long_texts_near_duplicates_against_brute_force(spark):
    """Pairs of 20,000 to 200,000 words with repeated and common passages, which differ in the repeated ones alone."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.getrandbits(48)}" for _ in range(n)]
    common, rows, errors = words(2_000), [], []
    for size in (20_000, 20_000, 20_000, 60_000, 60_000, 60_000, 200_000):
        passages, plain = [words(50) for _ in range(size * 3 // 1000)], words(size * 6 // 10)
        changed = [words(50) if i < 0.34 * len(passages) else p for i, p in enumerate(passages)]
        for some in (passages, changed):
            rows.append((len(rows), " ".join(common + plain + sum(some, []) + sum(some[::-1], [])), "en", "a"))
    docs = docs_of(spark, rows)
    levels = near_dedup.idf_levels(docs)
    leveled = [near_dedup.leveled(near_dedup.shingles(near_dedup.word_hashes(text)), levels) for _, text, *_ in rows]
    sets = [((own & ~np.uint64(63)) | level.astype(np.uint64)).astype("<u8").tobytes() for own, level in leveled]
    samples = [near_dedup.weighted_samples(*both) for both in leveled]
    near = lambda i, j: near_dedup.weighted_jaccard(sets[i], sets[j])
    for i in range(0, len(rows), 2):
        assert 0.8 <= near(i, i + 1) < 0.86 and all(near(i, j) < 0.8 for j in range(i))
        errors.append((samples[i] == samples[i + 1]).mean() - near(i, i + 1))
    assert abs(sum(errors) / len(errors)) < 0.05 and max(map(abs, errors)) < 0.15, errors
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {i: i // 2 * 2 for i in range(len(rows))}


def test_open_buckets_are_united(spark):
    """A chain of texts, each near the next alone, that all share a passage."""
    rng = random.Random(6)
    text, rows = [f"w{rng.random()}" for _ in range(150)], []
    for i in range(60):
        rows.append((i, " ".join(text), "en", "a"))
        text[(i * 5) % 150] = f"w{rng.random()}"
        text[(i * 5 + 60) % 150] = f"w{rng.random()}"
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.class_id for r in got} == {0}


def test_pipeline_against_stage_rules(spark):
    from corpus_pipeline import STAGES
    from docweft.llm.shared import table, written

    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in STAGES[:-1]:
        after = written(stage(spark, docs, SF_DIR), name)
        assert after.columns == columns
        before, now = Counter(r.doc_id for r in docs.select("doc_id").collect()), Counter(r.doc_id for r in after.select("doc_id").collect())
        assert set(now) <= set(before) and max(now.values()) <= (2 if name == "mixing" else 1)
        docs = after
    assert docs.selectExpr("md5(text)").distinct().count() == docs.select("doc_id").distinct().count()
    pieces = STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == now
    assert all(r.offset + r.length <= 4096 for r in pieces)
