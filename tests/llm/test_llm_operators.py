"""The ten operators against plain versions, on tables with every awkward case."""

from __future__ import annotations

import os
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from grainmill.llm import common, decontaminate, graph, merkle, pieces, quality, rendezvous, repeats, rules, simhash, substrings, suffixes, toxicity, vec  # noqa: E402

KEY = lambda r: tuple((x is not None, x) for x in r)


def same(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=KEY)
    assert got == sorted(want, key=KEY)


def test_vectors():
    buf, offs = vec.flat(pa.array(["a b", None, "", "b  a b", "é é"]))
    starts, ends, first = vec.words(buf, offs)
    words = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["a", "b", "b", "a", "b", "é", "é"] and first.tolist() == [0, 2, 2, 2, 5, 7]
    h = vec.span_hashes(buf, starts, ends)
    assert [h.tolist().index(x) for x in h] == [0, 1, 1, 0, 1, 5, 5]
    w = vec.window_hashes(h, 2)
    assert w[0] == w[3] and len(set(w.tolist())) == 5
    assert vec.window_starts(first, 2).tolist() == [True, False, True, True, False, True]
    keys = np.array([5, 7, 5, 9, 7, 1], np.uint64)
    assert vec.repeated(keys).tolist() == [True, True, True, False, True, False]
    for buf, offs in ((buf, offs),):
        assert [p[0] for p in vec.chunks(buf, offs, 3)] == [0, 3, 4]


def test_rules(spark):
    rows = cases.texts()
    same(rules.report(cases.frame(spark), rules.RULES), [(i, *cases.quality(t)) for i, t in rows])
    kept = rules.apply(cases.frame(spark), rules.fit(cases.frame(spark)))
    assert kept.columns == cases.frame(spark).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == sorted((i, t) for i, t in rows if i and cases.quality(t)[-1])
    assert rules.report(cases.empty(spark), rules.fit(cases.empty(spark))).count() == 0


def test_rule_order_is_by_rejection_per_cost():
    own = [rules.Rule(x, lambda s: np.zeros(s.n, bool)) for x in "abc"]
    cost = {"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (1.0, 0.9)}
    buf, offs = vec.flat(pa.array(["x y", "z"]))
    assert rules.order(own, buf, offs, lambda r, s: cost[r.name]) == [1, 2, 0]
    left = []
    halves = [rules.Rule("first", lambda s: np.arange(s.n) < 1), rules.Rule("rest", lambda s: np.ones(s.n, bool))]
    assert rules.order(halves, buf, offs, lambda r, s: left.append((r.name, s.n)) or (1.0, 0.5 if r.name == "first" else 0.4)) == [0, 1]
    assert left[-1] == ("rest", 1)  # measured on what the first one left


def labelled(spark, n=480):
    """Toxic texts hold one of three words; poor ones are shouted."""
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(n):
        toxic, poor = i % 4 == 0, i % 3 == 0
        w = rng.choice(vocab, 60).tolist()
        if toxic:
            w[int(rng.integers(60))] = ["scum", "idiot", "moron"][i % 3]
        t = " ".join(w)
        rows.append((i, t.upper() + "!!" if poor else t))
        marks.append((i, int(not poor), int(toxic)))
    marks += [(None, 1, 1), (5, None, None)]
    return cases.frame(spark, [*rows, (None, None), (9999, "")]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers(spark, kind):
    docs, labels = labelled(spark)
    if kind == "toxic":
        folds, held = 3, 1
        model = toxicity.fit(docs, labels)
        out = toxicity.score(docs, model)
    else:
        folds, held = 4, 2
        out = quality.score(docs, quality.train(*quality.sample(docs, labels, "quality", folds, held, 1000)))
    got = out.collect()
    assert len(got) == 482 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in got if r.doc_id is not None)
    truth = {r.doc_id: r[kind] for r in labels.dropna().collect()}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(right) > 0.9
    none = labels.limit(0)
    blind = toxicity.score(docs, toxicity.fit(docs, none)) if kind == "toxic" else quality.score(docs, quality.train(*quality.sample(docs, none, "quality", 4, 2, 10)))
    assert {r.score for r in blind.collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = labelled(spark)
    held = common.crc_mod(F.col("doc_id"), 3) == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


def test_trees_agree_with_their_margins():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.FEATURES))).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.train(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    slow = []
    for row in x[:50]:
        m = model.start
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[f[node]] >= t[node])
            m += v[node - (2**model.depth - 1)]
        slow.append(m)
    assert np.allclose(model.margin(x[:50]), slow)


def page_rows():
    return [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(0, 9000, 3)] + [(50, None, None), (3, "again", "again"), (None, "n", "null id")]


def test_merkle(spark):
    schema = "page_id long, url string, html string"
    rows = page_rows()
    a = spark.createDataFrame(rows, schema)
    assert merkle.audit(a, a.repartition(5)).count() == 0
    bad = [(i, u, "hurt" if i == 300 else h) for i, u, h in rows if i != 6000] + [(7001, "new", "new")]
    got = {r.page_id: r for r in merkle.audit(a, spark.createDataFrame(bad, schema)).collect()}
    assert {k: r.status for k, r in got.items()} == {300: "corrupt", 6000: "missing", 7001: "extra"}
    size = {}
    for r in a.select("page_id", F.octet_length(merkle.record(F.col("page_id"), F.col("url"), F.col("html"))).alias("n")).where("page_id IS NOT NULL").collect():
        size[r.page_id] = size.get(r.page_id, 0) + r.n
    for k in (300, 6000):
        assert (got[k].file, got[k].offset, got[k].length) == (k // 4096, sum(n for i, n in size.items() if i // 4096 == k // 4096 and i < k), size[k])
    lost = merkle.audit(a, a.limit(0))
    assert lost.count() == len({r[0] for r in rows}) and {r.status for r in lost.collect()} == {"missing"}
    assert merkle.audit(a.limit(0), a.limit(0)).count() == 0


def test_merkle_of_wide_and_negative_ids_and_clashing_columns(spark):
    ids = [-(2**62), -5000, -4097, -4096, -1, 0, 4095, 2**60, 2**60 + 4000, 2**60 + 4095, 2**60 + 4096, None]
    rows = [(i, f"u{i}", "b" * k * 1000 if k % 3 else None, "node", 7) for k, i in enumerate(ids)]
    a = spark.createDataFrame(rows, "page_id long, url string, html string, node string, length int")
    size = {r.page_id: r.n for r in a.select("page_id", F.octet_length(merkle.record(F.col("page_id"), F.col("url"), F.col("html"))).alias("n")).collect()}
    b = spark.createDataFrame([(i, u, (h or "") + "?", n, m) for i, u, h, n, m in rows], a.schema)
    got = {r.page_id: r for r in merkle.audit(a, b).collect()}
    assert set(got) == set(ids) and {r.status for r in got.values()} == {"corrupt"}
    for i in ids[:-1]:
        assert (got[i].file, got[i].offset, got[i].length) == (i // 4096, sum(n for j, n in size.items() if j is not None and j // 4096 == i // 4096 and j < i), size[i])


def test_merkle_descends_only_below_nodes_that_differ(spark):
    a = spark.createDataFrame([(i, "u", "b") for i in range(5000)], "page_id long, url string, html string")
    b = a.where("page_id <> 4500")
    trees = [merkle.tree(x, "t") for x in (a, b)]
    differ = [len({(r.node, r.hash) for r in x.collect()} ^ {(r.node, r.hash) for r in y.collect()}) for x, y in zip(*trees, strict=True)]
    assert differ == [1, 2, 2, 2, 2]  # a lost record changes its own branch only, though all later records move



def test_pieces_are_the_models_own_without_dropout():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.load()
    rows = [t or "" for _, t in cases.texts()] + [";\r\n  x", "   ", " a", "1234 é"]
    buf, offs = vec.flat(pa.array(rows))
    ids, ends = pieces.encode(v, buf, offs)
    for i, t in enumerate(rows):
        if pieces.SPACE_MARK not in t:
            assert ids[ends[i] : ends[i + 1]].tolist() == sp.encode(t)


def slow_merge(v, sp, unit: str, salt: int, drop: int) -> list[int]:
    """The agenda for one unit, one merge at a time."""
    parts = [(i, i + 1, int(v.char[ord(c)])) for i, c in enumerate(unit)]
    while True:
        best = None
        for k in range(len(parts) - 1):
            rank, into = pieces.lookup(v, np.array([parts[k][2]]), np.array([parts[k + 1][2]]))
            end = parts[k + 1][1] if parts[k + 1][1] < len(unit) else None
            if rank[0] == pieces.NONE:
                continue
            if drop:
                width = drop_width
                e = width + 1 if end is None else end
                h = vec.mix(np.array([(salt + parts[k][0] * 0x9E3779B97F4A7C15 + parts[k + 1][0] * 0xC2B2AE3D27D4EB4F + e * 0x165667B19E3779F9) % (1 << 64)], np.uint64))[0]
                if int(h) < drop:
                    continue
            if best is None or rank[0] < best[0]:
                best = (rank[0], k, into[0])
        if best is None:
            return [p[2] for p in parts]
        _, k, into = best
        parts[k : k + 2] = [(parts[k][0], parts[k + 1][1], int(into))]


drop_width = 0


def test_dropout_against_a_slow_agenda():
    global drop_width
    v = pieces.load()
    unit = " therefore"
    sym = v.char[[ord(c) for c in unit]][None, :].astype(np.int32)
    drop_width = sym.shape[1]
    for salt in range(40):
        for alpha in (0.0, 0.3, 0.8):
            drop = int(alpha * 2**64)
            m, left = pieces._merge(v, sym.copy(), np.array([len(unit)]), np.array([salt], np.uint64), np.uint64(drop))
            assert m[0][left[0]].tolist() == slow_merge(v, None, unit, salt, drop)
            m, left = pieces._agenda(v, sym[0], np.uint64(salt), np.uint64(drop))
            assert m[left].tolist() == slow_merge(v, None, unit, salt, drop)


def test_dropout_is_seeded_varied_and_lossless(spark):
    docs = cases.frame(spark)
    runs = [{r.doc_id: r for r in pieces.encode_table(docs, seed=s, alpha=0.3).collect()} for s in (1, 1, 2)]
    assert all(r.round_trip for run in runs for r in run.values())
    assert all(runs[0][k].ids == runs[1][k].ids for k in runs[0]) and any(runs[0][k].ids != runs[2][k].ids for k in runs[0])
    back = {r.doc_id: r.text for r in pieces.decode_table(pieces.encode_table(docs, alpha=0.3)).collect()}
    assert all(back[i] == (t or "") for i, t in cases.texts())
    assert all(r.decoded_sha256 == cases.sha((dict(cases.texts())[k] or "").encode()) for k, r in runs[0].items())
    assert pieces.encode_table(cases.empty(spark)).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks()
    assert len(masks) == 31
    rng = np.random.default_rng(0)
    for _ in range(20_000):
        flips = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("limit", [simhash.BUCKET, 2])
def test_simhash(spark, limit, monkeypatch):
    rows = cases.texts()
    monkeypatch.setattr(simhash, "links", lambda d, f=simhash.links: f(d, limit=limit))
    prints = [cases.fingerprint(t) for _, t in rows]
    root = cases.components(prints)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    got = simhash.cluster(cases.frame(spark)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((i, p, least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True))
    kept = simhash.representatives(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_simhash_of_crowded_buckets(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 4)
    values = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(62, int(rng.integers(0, 4)), replace=False)) for b in base for _ in range(120)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = cases.components(values)
    for limit in (1024, 5):
        label = {r.node: r.root for r in graph.components(simhash.links(df, limit=limit)).collect()}
        assert [label.get(v, v) for v in values] == [values[w] for w in want]
    assert simhash.cluster(cases.empty(spark)).count() == 0


def test_rendezvous(spark):
    docs = cases.frame(spark, cases.texts() + [(k, f"t{k}") for k in range(100, 900)])
    rows = cases.texts() + [(k, f"t{k}") for k in range(100, 900)]
    got = rendezvous.assign(docs, [1.0] * 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 50 < len(slots) < 160
    assert all(r.grown_shard in (r.shard, 8) for r in got) and 40 < sum(r.grown_shard == 8 for r in got) < 150
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    heavy = Counter(r.shard for r in rendezvous.assign(docs, [1.0, 3.0]).collect())
    assert 2 < heavy[1] / heavy[0] < 4.5
    assert rendezvous.assign(cases.empty(spark), [1.0] * 8).count() == 0


def test_rendezvous_of_one_key(spark):
    rows = [(7, f"t{k % 300}") for k in range(900)] + [(7, "same")] * 500 + [(None, None)] * 50
    got = rendezvous.assign(cases.frame(spark, rows), [1.0] * 8).collect()
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len(got) == len(rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t or "") + 1) for i, t in rows)


def test_decontamination(spark):
    rows = cases.texts()
    passage = rows[7][1]
    items = [(1, passage), (2, " ".join(passage.split()[5:25])), (3, "Two, words!"), (4, None), (5, "..."), (6, "never seen " * 6), (11, "ONE"), (12, "na na na na na na na na na na na na")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.report(cases.frame(spark), bench).drop("th"), cases.decontaminated(rows, items))
    bad = {r[0] for r in cases.decontaminated(rows, items) if r[-1]}
    clean = decontaminate.clean(cases.frame(spark), bench)
    assert clean.columns == cases.frame(spark).columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows if i not in bad}
    assert decontaminate.report(cases.empty(spark), bench).count() == 0
    assert not decontaminate.report(cases.frame(spark), bench.limit(0)).where("contaminated").count()


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows = cases.texts()
    items = [(1, rows[7][1]), (3, "Two, words!")]
    same(decontaminate.report(cases.frame(spark), spark.createDataFrame(items, "item_id long, text string")).drop("th"), cases.decontaminated(rows, items))


def test_sketch_never_undercounts():
    h = vec.mix(np.arange(5000, dtype=np.uint64))
    packed = repeats._pack(np.sort(repeats.cells(h, 0, 20)))
    assert repeats._unpack(packed).tolist() == np.sort(repeats.cells(h, 0, 20)).astype(int).tolist()


@pytest.mark.parametrize("bits", [None, 10])
def test_substrings(spark, bits, monkeypatch):
    if bits:  # a full sketch lets everything through
        monkeypatch.setattr(repeats, "bits_for", lambda *a: bits)
    rows = cases.texts()
    same(substrings.report(cases.frame(spark)), cases.substrings(rows))
    assert substrings.report(cases.empty(spark)).count() == 0


def test_substrings_clean(spark):
    rows = cases.texts()
    want = Counter((r[0], r[3]) for r in cases.substrings(rows))
    got = substrings.clean(cases.frame(spark))
    assert got.columns == cases.frame(spark).columns
    assert Counter((r.doc_id, cases.sha(" ".join(cases.SPACE.findall(r.text or "")).encode())) for r in got.collect()) == want
    assert all(r.n_chars == len(r.text) for r in got.where("text IS NOT NULL").collect())


def test_difference_cover():
    v, d = suffixes.difference_cover(2)
    assert {(a - b) % v for a in d for b in d} == set(range(v)) and v == suffixes.PERIOD


def test_suffixes(spark):
    rows = cases.texts()
    same(suffixes.report(cases.frame(spark)), cases.byte_strings(rows))
    assert suffixes.report(cases.empty(spark)).count() == 0


def test_suffixes_of_planted_passages(spark):
    """A passage of over 50 words goes from every text, whole, if it has 400 bytes; below that, and elsewhere, nothing goes."""
    rng = np.random.default_rng(11)
    say = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    rows, want = [], []
    for k, (size, odd) in enumerate([(399, "ab"), (400, "ab"), (399, "\u00e9\u0169"), (401, "ab"), (700, "ab"), (3000, "ab")]):  # the third's odd ones end in one byte, so it is 400
        passage = " ".join(say(5) for _ in range(size // 6 + 1))[: size - 1] + "."
        assert len(passage) == size and len(passage.split()) > 50
        gone = size + (odd != "ab") if size + (odd != "ab") >= 400 else 0
        for c, n in zip(odd, (30, 5000), strict=True):
            before, after = say(n) + c, c + say(700)
            rows.append((len(rows), before + passage + after.upper()))
            raw, at = rows[-1][1].encode(), len(before.encode()) - (odd != "ab")
            want.append((rows[-1][0], len(raw), gone, int(gone > 0), cases.sha(raw[:at] + raw[at + gone :] if gone else raw)))
    rows.append((len(rows), say(6000)))  # a text with none
    want.append((rows[-1][0], 6000, 0, 0, cases.sha(rows[-1][1].encode())))
    same(suffixes.report(cases.frame(spark, rows)), want)


def test_suffixes_beyond_their_bitmap(spark, monkeypatch):
    """Strings that occur once are not sent, though there are many more than the bitmaps have room for."""
    rng = np.random.default_rng(3)
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 8000)))) for i in range(60)]
    rows[7] = (7, rows[7][1][:3000] + rows[40][1][1111:1700] + rows[7][1][3000:])
    sent, exact = [], repeats.exact

    def look(texts, items, n):
        sent.append(len(items(*vec.flat(pa.array([r.text for r in texts.collect()]))).h1))
        return exact(texts, items, n)

    monkeypatch.setattr(repeats, "exact", look)
    monkeypatch.setattr(suffixes, "BITS", 14)
    same(suffixes.report(cases.frame(spark, rows)), cases.byte_strings(rows))
    assert 2 * 190 <= sent[0] < 2000  # of 457,000 strings


def test_suffixes_look_at_each_text_once_to_sort_it_out(spark, monkeypatch):
    """Whether a text has candidates is asked once, for clean texts and others together, and a clean text's hashes are summed once."""
    rows = cases.texts()
    asked, summed, clean, applied = spark.sparkContext.accumulator(0), [], suffixes.Finder.clean, repeats.applied

    def look(docs, found, n, each, schema, is_clean, copies):
        def count(buf, offs):
            asked.add(len(offs) - 1)
            return is_clean(buf, offs)

        return applied(docs, found, n, each, schema, count, copies)

    monkeypatch.setattr(repeats, "applied", look)
    same(suffixes.report(cases.frame(spark)), cases.byte_strings(rows))
    assert asked.value == len(rows)

    monkeypatch.setattr(vec, "sums", lambda buf, which=0, f=vec.sums: summed.append(len(buf)) or f(buf, which))
    none = repeats.Counted(64, 16, 1, {}, 0.0)
    buf, offs = vec.flat(pa.array([t for _, t in rows]))
    share = lambda x: type("Shared", (), {"value": x})
    assert clean(suffixes.Finder(share(none), share(none)), buf, offs).all() and summed == [len(buf)]


def test_candidates_are_what_samples_have_in_reach():
    """Against the definition, place by place; hashes against those of the strings alone."""
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (0, 5, 219, 220, 221, 399, 400, 401, 700, 0, 2500, 39_000)]
    buf, offs = vec.flat(pa.array([*texts, None]))
    want = [int(a) + i for a, t in zip(offs, texts, strict=False) for i in range(len(t) - suffixes.DEPTH + 1) if i % suffixes.PERIOD in suffixes.COVER]
    assert suffixes.samples(offs).tolist() == want
    some = np.sort(rng.choice(len(want), 60, replace=False))
    cover = type("Some", (), {"value": type("Few", (), {"maybe": staticmethod(lambda h: some)})})
    at, h = suffixes.Finder(cover).candidates(buf, offs)
    text = np.searchsorted(offs, np.array(want)[some], side="right") - 1
    reach = {p for s, t in zip(np.array(want)[some], text, strict=True) for p in range(max(s - suffixes.PERIOD + 1, offs[t]), s + 1) if p + suffixes.SIZE <= offs[t + 1]}
    assert at.tolist() == sorted(reach) and len(reach) > 2000
    alone = lambda p, which: suffixes._hashes(vec.sums(buf[p : p + suffixes.SIZE], which), np.zeros(1, int), suffixes.SIZE, which)[0]
    assert all(h[k] == alone(at[k], 0) for k in range(0, len(at), 97))
    second = suffixes._second(buf, at)
    assert all(second[k] == alone(at[k], 1) for k in range(0, len(at), 97))


def test_counted_marks_every_repeat(spark):
    h = vec.mix(np.arange(40_000, dtype=np.uint64))
    ids = lambda buf, offs: h[np.array([int(x) for x in buf.tobytes().split()])]
    rows = [(k, k, " ".join(map(str, [*range(400 * k, 400 * k + 400), 5, 7 + k % 50])) + " ") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, key long, text string").repartition(3)
    for items, most in ((40_000.0, 29), (4e9, 16)):  # few pages and many
        got = repeats.counted(df, ids, items, most).maybe(h)
        assert set(range(5, 57)) - {6} <= set(got.tolist()) and len(got) < 200
    assert len(repeats.counted(df.limit(0), ids, 1.0).maybe(h)) == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)]
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
