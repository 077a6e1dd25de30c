"""Operators on documents against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""


import itertools
import math
import os
import random
import re
import time

import numpy as np
import pyarrow as pa

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from bourselake.llm import cells, common, language_id, near_dedup, packing, quality, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, component string, x int, cleaned int"


def documents(spark, rows):
    """Rows (doc_id, text[, lang[, source]]); the other columns clash with names the operators use."""
    full = [(r[0], r[1], *(list(r[2:]) + [None] * (4 - len(r))), None if r[1] is None else len(r[1]), 0.5, "k", "c", 1, 2) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    """Near copies in chains and groups, copies, short, blank, null and long texts."""
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = sentence(rng, rng.choice([3, 12, 60, 150])).split()
        for _ in range(rng.choice([1, 3, 8])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = sentence(rng, 1)
            texts.append(" ".join(words))
    texts += ["one", "ONE", "One two", "one  two\n", "", "   \t", None, "a b c", sentence(rng, 3000), " x y"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + rows[:3] + [(None, "one"), (None, None), (None, "nowhere else at all"), (5, "a b c")]


def shingles(text, size):
    words = "" if text is None else "".join(c.lower() if c.isascii() else c for c in text)
    words = [w for w in common_split(words) if w]
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def common_split(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


def closed(nodes, links):
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, mixed, size):
    got = near_dedup.near_duplicates(documents(spark, mixed), size=size).collect()
    sets = [(i, shingles(t, size)) for i, t in mixed]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    groups = closed({i for i, _ in sets if i is not None}, links)
    equal = {}
    for i, s in sets:
        if i is not None and s:
            equal[s] = min(equal.get(s, i), i)
    want = sorted((i, len(s), groups[i] if i is not None else groups.get(equal.get(s))) for i, s in sets if i is not None)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    nameless = [r for r in got if r.doc_id is None]
    assert len(nameless) == 3 and all(r.kept is None for r in nameless)
    assert sum(r.component_id is not None for r in nameless) == 1


def test_texts_that_share_common_values_alone_do_not_move_to_cells(spark, monkeypatch, tmp_path):
    """Every pair of words stands in many texts, so all lists are mixed; only the likely members of a cell are sent with their texts."""
    rng = random.Random(11)
    words = [sentence(rng, 1) + str(i) for i in range(20)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(45))) for i in range(250)]
    base = " ".join(rng.choice(words) for _ in range(60)).split()
    for i in range(250, 262):
        copy = list(base)
        for p in rng.sample(range(60), 2):
            copy[p] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    whole = near_dedup.verify_cells

    def counted(batches, sets, percent):
        def seen():
            for batch in batches:
                with open(f"{tmp_path}/{os.getpid()}", "a") as f:
                    f.write("x" * len(batch))
                yield batch

        return whole(seen(), sets, percent)

    monkeypatch.setattr(near_dedup, "verify_cells", counted)
    got = near_dedup.near_duplicates(documents(spark, rows).repartition(3), size=2).collect()
    sets = {i: shingles(t, 2) for i, t in rows}
    links = [(i, j) for i, j in itertools.combinations(sorted(sets), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = closed(set(sets), links)
    assert len(links) > 10 and {r.doc_id: r.component_id for r in got} == groups
    assert sum(p.stat().st_size for p in tmp_path.iterdir()) < 1000


def test_near_duplicates_of_a_large_loose_group(spark, monkeypatch):
    """Members that the list's first one is not linked with are compared in cells."""
    monkeypatch.setattr(cells, "BLOCK", 4)
    rng = random.Random(5)
    base = sentence(rng, 80).split()
    rows = []
    for i in range(40):
        words = list(base)
        for p in rng.sample(range(80), rng.choice([2, 3])):
            words[p] = sentence(rng, 1, "klmnop")
        rows.append((i, " ".join(words)))
    sets = [shingles(t, 2) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(40), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert 20 < len(links) < 400
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, rows), size=2).collect()}
    assert got == closed(range(40), links)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert packing.best_fit(none).count() == 0
    trees = language_id.train(none)
    assert trees.langs == [] and language_id.predict(none, trees).count() == 0
    assert language_id.predict(documents(spark, [(1, "abc")]), trees).first()[1:] == ("und", 0.0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(none, quality.fit(none, labels)).count() == 0


def code_length(text, counts, order):
    """Bits of a text under PPM with escapes, step by step; counts[context][byte]."""
    data, bits = b"\0" * order + text.encode(), 0.0
    for i in range(order, len(data)):
        for length in range(order, -1, -1):
            seen = counts.get(data[i - length : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_are_exact(spark, order):
    rng = random.Random(order)
    learned = [(i, sentence(rng, 8, "abcde éß" if i % 2 else "defgh ü"), "a" if i % 2 else "b") for i in range(30)] + [(98, None, "a"), (99, "zz", None), (97, "", "a")]
    docs = documents(spark, learned)
    trees = language_id.train(docs, order=order)
    texts = [sentence(rng, 5), "é", "x", "日本 abc", sentence(rng, 400, "abcdefgh é")]
    for k, lang in enumerate(trees.langs):
        counts = {}
        for _, text, own in learned:
            if own == lang and text is not None:
                data = b"\0" * order + text.encode()
                for i in range(order, len(data)):
                    for length in range(order + 1):
                        seen = counts.setdefault(data[i - length : i], {})
                        seen[data[i]] = seen.get(data[i], 0) + 1
        joined = "".join(texts).encode()
        offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        got = trees.code_lengths(np.frombuffer(joined, np.uint8), offsets)[:, k]
        assert np.allclose(got, [code_length(t, counts, order) for t in texts], atol=1e-6)


def test_language_of_texts_without_letters(spark):
    docs = documents(spark, [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (2, "der hund und die katze", "de")])
    trees = language_id.train(docs)
    rows = documents(spark, [(1, "the dog"), (2, "die katze"), (3, None), (4, ""), (5, "12 !? 34"), (6, "—… ١٢"), (None, "und der"), (7, "the " * 50_000), (8, "é")])
    got = {r.doc_id: r for r in language_id.predict(rows, trees).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None, 7)] == ["en", "de", "und", "und", "und", "und", "de", "en"]
    assert got[8].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0
    assert language_id.predict(rows, trees, keep=("doc_id", "score0") if "score0" in rows.columns else ("doc_id", "kept")).columns == ["doc_id", "kept", "lang_pred", "score"]


def test_rare_languages_keep_their_trees(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, row)) for row in rng.integers(0x10000, 0x10FFFF, (200, 5000))]  # about 300,000 byte sequences
    docs = documents(spark, [(i, t, "many") for i, t in enumerate(texts)] * 2 + [(999, "die katze", "de")])
    trees = language_id.train(docs)
    assert trees.langs == ["de", "many"]
    assert [len(x[0][0]) for x in trees.levels] == [9, len({t[i : i + 3] for t in (b"\0\0" + t.encode() for t in texts) for i in range(len(t) - 2)})]
    rows = documents(spark, [(1, "katze"), (2, texts[0][:50] + " a")])
    assert {r.doc_id: r.lang_pred for r in language_id.predict(rows, trees).collect()} == {1: "de", 2: "many"}


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = language_id.predict(docs.filter(held), language_id.train(docs.filter(~held)), keep=("doc_id", "lang")).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.97


def brute_features(text):
    kinds = lambda c: 0 if c in b" \t\n\v\f\r" else 1 if chr(c).isalnum() and c < 128 or c > 127 else 2
    words = [bytes(g) for k, g in itertools.groupby((text or "").encode(), kinds) if k]
    one = lambda w: int(common.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), common.BYTE_AS_IS)[0])
    half = quality.BUCKETS // 2
    hashes = [one(w) for w in words]
    pairs = [int(common.shingle_hashes(np.array(p, np.uint64), 2)[0]) for p in itertools.pairwise(hashes)]
    return [h % half for h in hashes] + [p % half + half for p in pairs]


def test_resampling_weights_and_choice(spark):
    rng = random.Random(9)
    good = [(i, sentence(rng, rng.randint(5, 300)), "en") for i in range(40)]
    bad = [(100 + i, " ".join(w + "!!" for w in sentence(rng, 60).upper().split())) for i in range(10)]
    rows = [*good, *bad, (200, ""), (201, None), (None, "abc"), (3, good[3][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100, 0, 0), (5, 0, 0), (None, 1, 0), (7, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    ratio = quality.fit(docs, labels)
    targets = set(range(20)) - {5}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, text, *_ in rows:
        for f in brute_features(text):
            raw[f] += 1
            target[f] += i in targets
    half = quality.BUCKETS // 2
    want = np.concatenate([np.log(target[s] / target[s].sum()) - np.log(raw[s] / raw[s].sum()) for s in (slice(0, half), slice(half, None))])
    assert np.allclose(ratio, want)
    got = quality.resample(docs, ratio).toPandas()
    for r, (_, text, *_) in zip(got.sort_values("doc_id", kind="stable").itertuples(), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        f = brute_features(text)
        assert math.isclose(r.log_weight, want[f].sum() * min(1, quality.PASSAGE / max(len(f), 1)), abs_tol=1e-9)
    assert got["kept"].sum() == (got["log_weight"] >= quality.LEAST_WEIGHT).sum()
    assert got[got["doc_id"].isin(targets)]["kept"].all() and got[got["doc_id"].isin([200, 201])]["kept"].all()
    assert got[got["doc_id"].between(100, 110)]["log_weight"].max() < got[got["doc_id"].isin(targets)]["log_weight"].min()
    few = quality.resample(docs, ratio, k=7).toPandas()
    assert set(few[few["kept"]]["key"]) == set(few["key"].nlargest(7)) and np.allclose(sorted(few["key"]), sorted(got["key"]))
    assert not quality.resample(docs, ratio, k=0).filter("kept").count()


def test_gumbel_noise_and_kth_largest(spark):
    x = spark.range(20_000).select(quality.gumbel(1, F.col("id")).alias("g")).toPandas()["g"]
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - math.pi**2 / 6) < 0.1
    values = [*np.random.default_rng(1).normal(size=500).tolist(), *[0.25] * 300, 1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 400, 802):
        assert quality.kth_largest(df, "v", k, bins=7, few=20) == sorted(values, reverse=True)[k - 1]


def brute_pack(items, capacity):
    """The same rule, looking at every bin."""
    bins, out = [], set()
    pieces = []
    for i, (length, source, cluster) in enumerate(items):
        whole = length // capacity if length > capacity else 0
        out |= {(i, j * capacity, capacity) for j in range(whole)}
        if length - whole * capacity or not whole:
            pieces.append((-(length - whole * capacity), i, whole * capacity, source, cluster))
    for less, i, start, source, cluster in sorted(pieces):
        fits = [b for b in bins if b[0] >= -less and b[0] > 0 and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        best = min(fits, key=lambda b: (b[0], b[3]), default=None)
        if best is None:
            best = [capacity, set(), set(), len(bins)]
            bins.append(best)
        best[0] += less
        best[1].add(source)
        best[2].add(cluster)
        out.add((i, start, -less, best[3]))
    return out, len(bins)


def test_packing_follows_the_rule():
    rng = random.Random(2)
    for _ in range(30):
        items = [(rng.choice([0, 1, 5, 20, 64, 65, 130, rng.randint(1, 64)]), rng.choice([None, 0, 0, 0, 1, 2]), rng.choice([None, 0, 1, 2, 3, 4, 5])) for _ in range(60)]
        placed = packing.pack(items, 64)
        want, n = brute_pack(items, 64)
        fitted = {}
        for i, start, length, bin_, at in placed:
            fitted.setdefault(bin_, []).append((at, length, i, start))
        for pieces in fitted.values():
            pieces.sort()
            assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(pieces)) and pieces[-1][0] + pieces[-1][1] <= 64
            for column in (1, 2):
                held = [items[i][column] for _, length, i, _ in pieces if items[i][column] is not None and not (length == 64 and items[i][0] > 64)]
                assert len(held) == len(set(held))
        alone = [p for p in placed if p[2] == 64 and items[p[0]][0] > 64]
        assert len(placed) == len(want) and len(fitted) == n + len(alone)


def test_packing_of_a_table(spark):
    rows = [(i, "w " * (i % 37), None, f"s{i % 5}") for i in range(200)] + [(1, "w", None, None), (None, None), (300, "w " * 500, None, "s0")] + [(400, "same text", None, None)] * 3
    got = packing.best_fit(documents(spark, rows).repartition(3), capacity=100, together=64).toPandas()
    assert got.groupby("bin_id")["length"].sum().max() <= 100
    assert got[got["doc_id"] == 400]["bin_id"].nunique() == 3
    assert got[got["doc_id"] == 300].sort_values("part")[["start", "length"]].to_numpy().tolist() == [[100 * i, 100] for i in range(5)]
    assert len(got) == len(rows) + 4 and got["length"].sum() == sum(len((r[1] or "").split()) for r in rows)


def test_packing_is_the_same_however_rows_are_dealt(spark):
    rng = random.Random(4)
    rows = [(rng.choice([i, i, None, 7]), sentence(rng, rng.randint(0, 30)), None, rng.choice([None, "a", "b", f"s{i}"])) for i in range(300)]
    found = []
    for n in (1, 5):
        rng.shuffle(rows)
        found.append(sorted(map(str, packing.best_fit(documents(spark, rows).repartition(n), capacity=64, together=50).collect())))
    assert found[0] == found[1]
    assert packing.best_fit(documents(spark, rows), length=F.lit(None)).agg(F.sum("length")).first()[0] == 0


def test_packing_keeps_near_copies_apart(spark):
    rng = random.Random(8)
    words = sentence(rng, 60).split()
    rows = [(i, " ".join([*words[:50], f"edit{i}", *words[51:]]), "en", None if i % 2 else f"s{i}") for i in range(8)] + [(None, " ".join([*words[:50], "edit3", *words[51:]]), "en", "x")]
    rows += [(20 + i, sentence(rng, 5), "en", None) for i in range(4)] + [(30, "", "en", None), (31, "", "en", "y"), (32, None, "en", None)]
    docs = packing.clustered(documents(spark, rows)).coalesce(1)
    got = packing.best_fit(docs, length=F.col("words"), cluster=F.col("cluster")).collect()
    assert len(got) == len(rows)
    near = [r.bin_id for r in got if r.doc_id is None or r.doc_id < 8]
    assert len(set(near)) == len(near) == 9
    empty = [r.bin_id for r in got if r.doc_id in (30, 31)]
    assert len(set(empty)) == 2 and all(r.bin_id in near for r in got if (r.doc_id or 0) >= 20)


def test_cut_points_depend_on_near_words_only():
    rng = np.random.default_rng(1)
    passage = rng.integers(1, 2**63, 51, dtype=np.uint64)
    window, least = substring_dedup.WINDOW, substring_dedup.LEAST_WORDS
    for _ in range(300):
        hashes = []
        for _ in range(2):
            before, after = (rng.integers(1, 2**63, rng.integers(0, 90), dtype=np.uint64) for _ in range(2))
            words = np.concatenate((before, passage, after))
            starts = substring_dedup.cut_points(words)
            ends = np.append(starts[1:], len(words))
            inside = (starts >= len(before)) & (ends <= len(before) + 51)
            assert (ends - starts).max() <= window or len(words) <= window
            hashes.append({int(h): int(e - s) for h, s, e in zip(substring_dedup._of_runs(words, starts)[inside], starts[inside], ends[inside], strict=True)})
        assert sum(hashes[0][h] for h in hashes[0].keys() & hashes[1].keys()) >= least


def test_substring_dedup(spark):
    rng = random.Random(4)
    passage = sentence(rng, 60).capitalize() + "."
    line = sentence(rng, 100).split()
    changed = list(line)
    changed[50] = "other"
    own = [sentence(rng, 45) for _ in range(8)]
    rows = [
        (10, f"{own[0]}\n{own[1]} {passage} {own[2]}"),
        (11, f"{own[3]} é日 {passage} {own[4]}\nshort line"),
        (12, f"{own[5]}\n{' '.join(line)}"),
        (13, f"{' '.join(changed)}\n{own[6]}\nshort line"),
        (14, f"{own[7]}\n{own[7]}"),
        (15, None), (16, ""), (17, "the " * 3000), (18, "the " * 3000), (None, passage), (14, f"{own[7]}\n{own[7]}"),
    ]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    texts = dict(rows)
    for same in (10, 12, 14, 15, 16, 17, None):
        assert got[same].cleaned == texts[same] and got[same].removed == []
    cleaned, removed = got[11].cleaned, got[11].removed
    assert passage not in cleaned and own[3][:100] in cleaned and own[4][-100:] in cleaned and cleaned.endswith("\nshort line")
    rest, at = "", 0
    for x, y in removed:
        assert set(texts[11][x:y].lower().split()) <= set(passage.lower().split())
        rest, at = rest + texts[11][at:x], y
    assert rest + texts[11][at:] == cleaned
    assert sum(y - x for x, y in removed) > 0.5 * len(passage)
    assert got[13].cleaned == f"\n{own[6]}\nshort line"
    assert got[18].cleaned.strip() == ""


def test_repeated_passages_go_whole(spark):
    rng = random.Random(11)
    rows, passages = [], []
    for n in (41, 51, 60, 80, 200):
        passage = sentence(rng, n)
        passages.append(passage)
        for _ in range(3):
            rows.append((len(rows), f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}"))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    for doc, text in rows:
        begin = text.index(passages[doc // 3])
        assert got[doc].removed == ([] if doc % 3 == 0 else [[begin, begin + len(passages[doc // 3])]])


def test_one_row_of_each_group_of_copies_stays(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = sentence(rng, 60).split()
    edited = " ".join([*words[:50], "edit", *words[51:]])
    alone = sentence(rng, 30)
    rows = [(7, " ".join(words), "en"), (None, " ".join(words), "en"), (3, edited, "en"), (3, edited, "de"), (None, alone, "en"), (None, alone, "en"), (None, alone, "fr"), (5, "else where", "en"), (5, "else where", "en")]
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows).select(*corpus_pipeline.COLUMNS), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(3, edited), (0, alone), (5, "else where")])


def test_wrapped_paragraphs_are_compared(spark):
    rng = random.Random(12)
    wrap = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    words = sentence(rng, 72).split()
    edited = words[:35] + ["other"] + words[36:]
    own = [sentence(rng, 25) for _ in range(6)]
    rows = [
        (0, f"{own[0]}\n{wrap(words, 12)}\n{own[1]}"),
        (1, f"{own[2]}\n{wrap(edited, 10)}\n{own[3]}"),
        (2, f"{own[4]}\n\n{wrap(edited, 22)}\n\n{own[5]}"),
    ]
    got = {r.doc_id: r.cleaned for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: f"{own[2]}\n\n{own[3]}", 2: f"{own[4]}\n\n\n\n{own[5]}"}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 200), (250, 300), (7, 7), (None, 3), (400, 401), (401, 400)]
    rng.shuffle(links)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == closed({n for link in real for n in link}, real)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_are_of_words_alone():
    texts = ["Ab cd", "x\tab  CD\n", "", None, "cd", "É ab"]
    import pyarrow as pa

    found = []
    for _, data, offsets in common.text_slices(pa.array(texts), most_bytes=6):
        s, e, first = common.word_bounds(data, offsets)
        h = common.span_hashes(data, s, e)
        found += [h[a:b].tolist() for a, b in itertools.pairwise(first)]
    assert found[0] == found[1][1:] and found[2] == found[3] == [] and found[4] == found[0][1:] and found[5][1] == found[0][0]



def covered(texts, least):
    """For each text, in order, the words inside a window of ``least`` words that an earlier text has."""
    seen, out = set(), []
    for words in texts:
        windows = [tuple(words[i : i + least]) for i in range(len(words) - least + 1)]
        gone = [False] * len(words)
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + least] = [True] * least
        seen.update(windows)
        out.append(gone)
    return out


def stretches(flags):
    edges = [i for i in range(len(flags) + 1) if (i > 0 and flags[i - 1]) != (i < len(flags) and flags[i])]
    return list(zip(edges[::2], edges[1::2], strict=True))


def removed_words(text, spans):
    bounds = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [any(x <= a and b <= y for x, y in spans) for a, b in bounds]


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages_go_whole_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [[word() for _ in range(rng.choice([15, 25, 36, 41, 51, 60, 120]))] for _ in range(12)] + [["same"] * 70, (["x", "y"] * 40)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [word() for _ in range(rng.randint(30, 90))]
            passage = rng.choice(shared)
            cut = rng.choice([0, 0, rng.randrange(len(passage))])
            words += passage[cut : rng.choice([len(passage), len(passage), cut + 30])]
        words += [word() for _ in range(rng.choice([0, 40]))]
        texts.append(words)
    texts += [texts[3], texts[5] + [word() for _ in range(400)]]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    least, whole = substring_dedup.LEAST_WORDS, substring_dedup.LEAST_WORDS + substring_dedup.WINDOW + 1
    near = {i for i, t in enumerate(texts) for u in texts[:i] if 10 * len(shingles(" ".join(t), 5) & shingles(" ".join(u), 5)) >= 8 * len(shingles(" ".join(t), 5) | shingles(" ".join(u), 5))}
    short = 0
    for i, want in enumerate(covered(texts, least)):
        gone = removed_words(" ".join(texts[i]), [tuple(s) for s in got[i].removed])
        if i in near:
            assert all(gone)
            continue
        assert not [j for j, (a, b) in enumerate(zip(gone, want, strict=True)) if a and not b]
        for earlier in texts[:i]:
            for x, y in stretches(covered([earlier, texts[i]], least)[1]):
                assert y - x < whole or all(gone[x:y])
        short += sum(not all(gone[x:y]) for x, y in stretches(want))
    assert {60} <= near and short < 40


def test_repeated_passages_of_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fold = [["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] for r in docs]
    got = {r.doc_id: r.removed for r in substring_dedup.remove_repeats(spark.createDataFrame(docs)).collect()}
    whole = substring_dedup.LEAST_WORDS + substring_dedup.WINDOW + 1
    left = passages = 0
    for r, want in zip(docs, covered(fold, substring_dedup.LEAST_WORDS), strict=True):
        gone = removed_words(r.text or "", [tuple(s) for s in got[r.doc_id]])
        passages += len(stretches(want))
        left += sum(not all(gone[x:y]) for x, y in stretches(want))
        assert all(all(gone[x:y]) for x, y in stretches(want) if y - x >= 2 * whole)
    assert passages > 20 and left <= 0.15 * passages  # 20 to 35 words without an anchor


def test_cut_frees_the_shuffle_files_of_its_query(spark):
    def shuffled():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {str(blocks.apply(i).name()) for i in range(blocks.size()) if blocks.apply(i).isShuffle()}

    before = shuffled()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = common.cut(rows)
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    assert kept.count() == 7 and rows.count() == 7


def test_pipeline_stages_hand_texts_over_in_small_batches(spark):
    """40 texts of 1 MB in one partition, which one batch of ten thousand rows would hold."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    docs = documents(spark, [(i, "tree ", "en") for i in range(40)]).coalesce(1).withColumn("text", F.repeat("text", 200_000))
    spark.conf.unset(name)
    try:
        corpus_pipeline.language(spark, docs.limit(2), "")
        got = [r.n for r in docs.select("doc_id", "text").mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert sum(got) >= 40_000_000 and max(got) < 12_000_000
