"""Operators on documents against brute force, on the small table and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import brown, curriculum, decontaminate, licenses, ngram_join, quality, shards, substring, toxicity
from tickloom.llm import queries as registered

from .conftest import shingles, words


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def components(sets):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for i in ids:
        for s in sets[i]:
            held.setdefault(s, []).append(i)
    for i in ids:
        both = Counter(j for s in sets[i] for j in held[s] if j < i)
        for j, k in both.items():
            if 4 * k >= 3 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_join_small_table(spark, sf_dir, table):
    want = {i: shingles(t) for i, t in rows_of(table("documents"))}
    root = components(want)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registered.op3_ngram_jaccard(spark, sf_dir).collect()}
    assert got == {i: (len(s), root[i]) for i, s in want.items()}


def test_join_chain_without_centre(make_docs):
    """A drifting chain: neighbours link, ends do not; and a crowd around one text."""
    base = [f"w{i}" for i in range(80)]
    chain = [(100 + k, " ".join(base[:3 * k] and [f"z{j}" for j in range(3 * k)] + base[3 * k:] or base), "a") for k in range(12)]
    crowd = []
    for k in range(60):
        w = [f"c{i}" for i in range(100)]
        for j in range(k % 6):
            w[(k * 7 + j * 17) % 100] = f"e{k}_{j}"
        crowd.append((300 + k, " ".join(w), "b"))
    rows = chain + crowd
    root = components({i: shingles(t) for i, t, _ in rows})
    got = {r.doc_id: r.component_id for r in ngram_join.link(make_docs(rows)).collect()}
    assert got == root
    assert len(set(root.values())) < len(rows)


def test_join_crowd(spark):
    """A crowd on one shingle: several centres a round, far fewer meetings than pairs; and cells
    of earlier roots still give every pair of different components."""
    rows = spark.range(50).selectExpr("1L AS token", "id AS node", "100 AS n", "0 AS i", "id AS root")
    one, several = ngram_join._star(rows, 1).count(), ngram_join._star(rows, 1, 8).count()
    assert one == 49 and 4 * one < several < 50 * 49 // 2 // 2
    cells = ngram_join._cells(rows)
    later = rows.withColumn("root", F.expr("CASE WHEN node < 30 THEN 0 ELSE node END"))
    got = {(r.a, r.b) for r in ngram_join._rest(later, cells).collect()}
    assert got == {(a, b) for a in range(50) for b in range(a) if a >= 30}


def test_join_odd_rows(odd_docs, no_docs):
    got = ngram_join.link(odd_docs).collect()
    assert len(got) == 15
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert [by_id[i].component_id for i in (1, 4, 5, 6, 7, 8, 9, 10)] == [1, 4, 5, 6, 6, 6, 9, 9]
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 6, 9, 11, 12]
    assert ngram_join.link(no_docs).count() == 0


def brute_substring(rows, window=35):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[s:s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s:s + window])] > 1:
                gone.update(range(s, s + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1000, 1])
def test_substring(spark, sf_dir, table, monkeypatch, limit):
    monkeypatch.setattr(substring, "KEY_SEGMENTS", limit)
    got = sorted((tuple(r) for r in registered.op8_substring_dedup(spark, sf_dir).collect()), key=str)
    assert got == brute_substring(rows_of(table("documents")))


def test_substring_odd_rows(odd_docs, no_docs):
    got = substring.remove(odd_docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_substring(rows_of(odd_docs))
    assert substring.remove(no_docs).count() == 0


def test_substring_hot_key(spark, make_docs, monkeypatch):
    """A line that many texts hold, and near copies of a passage: whole results, and of each
    segment a few blocks, not a row per window."""
    rng = random.Random(3)
    line = [f"common{i}" for i in range(20)]
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(160):
        own = [f"d{i}w{k}" for k in range(rng.randint(0, 60))]
        copy = list(passage)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append((i, " ".join(own + line + (copy if i % 2 else own[::-1])), "a"))
    docs = make_docs(rows + rows[:3])
    cut, made = substring._blocks, []

    def seen(parts, window, gram):
        out = substring.stored(cut(parts, window, gram))
        made.append((parts.count(), out.count(), out.agg(F.sum("windows")).first()[0]))
        return out

    monkeypatch.setattr(substring, "KEY_SEGMENTS", 5)
    monkeypatch.setattr(substring, "_blocks", seen)
    got = substring.remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_substring(rows_of(docs))
    segments, blocks, windows = made[0]
    assert segments > 200 and blocks <= 5 * segments and 3 * blocks < windows


def test_mix(spark, sf_dir, table):
    rows = registered.op2_curriculum_mix(spark, sf_dir).join(table("documents").select("doc_id", "source"), "doc_id").collect()
    size = {i: len(words(t)) for i, t in rows_of(table("documents"))}
    assert {r.doc_id: r["size"] for r in rows} == size
    sources = sorted({r.source for r in rows}, key=lambda s: s.encode())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    whole = Counter()
    for r in rows:
        whole[r.source] += r["size"]
    target, free = {}, set(sources)
    while True:  # share by weight, stop those above, share again
        rest = sum(whole.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * whole[s]}
        if not over:
            break
        target.update({s: 3 * whole[s] for s in over})
        free -= over
    target.update({s: level * weight[s] for s in free})
    taken = Counter()
    for r in rows:
        assert r.source_size == whole[r.source] and math.isclose(r.target, target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)


def test_mix_order_follows_schedule(make_docs):
    docs = make_docs([(i, "w " * 10, s) for s in ("a", "c") for i in range(200)])
    rows = curriculum.mix(docs).collect()
    # source a spends early (1.5 to 0.5), source c, second in turn, evenly
    for name, early in (("a", 0.625), ("c", 0.5)):
        at = [r.position for r in rows if r.source == name]
        assert abs(sum(p < 0.5 for p in at) / len(at) - early) < 0.02
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert {"taken", "copy", "position", *docs.columns} == set(curriculum.mix(docs).columns)


def test_mix_odd_rows(odd_docs, no_docs):
    rows = curriculum.plan(odd_docs).collect()
    assert len(rows) == 15 and all(r.mix.taken == 0 for r in rows if not words(r.text))
    assert all(r["size"] == "x" for r in rows)
    again = curriculum.plan(odd_docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.mix.taken) for r in rows) == sorted((str(r.doc_id), r.mix.taken) for r in again)
    assert curriculum.take_whole(odd_docs).columns == odd_docs.columns
    assert curriculum.plan(no_docs).count() == 0


def test_shards(spark, sf_dir, table):
    rows = registered.op10_stratified_shards(spark, sf_dir).join(table("documents"), "doc_id").collect()
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for shard in count:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(count[shard]))
    for r in rows:
        assert r["size"] == len(r.text.encode()) + 8 and r.text_crc32 == zlib.crc32(r.text.encode())
    for source, n in Counter(r.source for r in rows).items():
        each = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(each[s] - n / 24) <= 1.5 for s in range(24))


def test_shards_spread_copies(make_docs):
    docs = make_docs([(i, f"text {i}", "a") for i in range(200) for _ in range(3)])
    rows = shards.assign(docs).collect()
    held = {}
    for r in rows:
        held.setdefault(r.doc_id, []).append(r.shard)
    assert len(rows) == 600 and all(len(s) == 3 for s in held.values())
    assert sum(len(set(s)) == 3 for s in held.values()) > 150


def test_shards_odd_rows(odd_docs, no_docs):
    rows = shards.assign(odd_docs).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(i, 0) for i in range(15)]
    assert {r.doc_id: r["size"] for r in rows}[1] == 8
    assert shards.assign(no_docs).count() == 0


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeated = {k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated),
            len(w) < 10 or 100 * len(repeated) > 20 * len(w))


def test_quality(spark, sf_dir, table):
    rows = registered.op9_quality_rules(spark, sf_dir).collect()
    text = dict(rows_of(table("documents")))
    label = {r.doc_id: r.quality for r in table("labels").collect()}
    for r in rows:
        assert tuple(r)[1:7] == brute_quality(text[r.doc_id])
        assert not (r.kept and r.base_failed)
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if label.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_quality_ratio_is_the_multinomials(table):
    """The ratio of every bucket, from counts made without the operator."""
    import numpy as np

    docs, labels = table("documents"), table("labels")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    corpus, trusted = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in rows_of(docs):
        n = np.bincount(quality.gram_buckets(np.frombuffer((t or "").encode(), np.uint8)), minlength=quality.BUCKETS)
        corpus += n
        trusted += n * (i in good)
    expected = corpus * trusted.sum() / corpus.sum()
    want = np.round(np.log((trusted + quality.PRIOR) / (expected + quality.PRIOR)) * quality.SCALE)
    assert np.array_equal(quality.fit(docs, labels), want)


def test_quality_odd_rows(odd_docs, no_docs, table):
    ratio = quality.fit(odd_docs, table("labels").limit(0))
    assert not ratio.any()
    rows = quality.measure(odd_docs, ratio).collect()
    assert len(rows) == 15
    assert all(tuple(r)[1:7] == brute_quality(t) for r, (_, t) in zip(rows, rows_of(odd_docs)))
    assert sorted(str(r.doc_id) for r in quality.keep(odd_docs, ratio).collect()) == sorted(
        str(r.doc_id) for r in rows if r.kept)
    assert quality.measure(no_docs, ratio).count() == 0


def test_decontamination(spark, sf_dir, table):
    bag = lambda t: Counter(tuple(words(t, True)[i:i + 5]) for i in range(len(words(t, True)) - 4))
    items = {r.item_id: (len(words(r.text)), bag(r.text)) for r in table("benchmark").collect()}
    held = {}
    for i, (_, b) in items.items():
        for s in b:
            held.setdefault(s, set()).add(i)
    want = {}
    for doc, text in rows_of(table("documents")):
        w = words(text, True)
        sh = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        for i in {i for s in sh for i in held.get(s, ())}:
            n, b = items[i]
            best = max((sum((c & b).values()) / sum((c | b).values()), -s) for s in range(max(1, len(w) - n + 1))
                       for c in [Counter(sh[s:s + n - 4])])
            if best[0] >= 0.75:
                want[doc, i] = round(best[0], 6)
    got = {(r.doc_id, r.item_id): r.similarity for r in registered.op7_decontamination(spark, sf_dir).collect()}
    assert want and got == want


def test_decontamination_edited_passage(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(60))
    edited = item.replace("q30", "other")  # 51 of 61 shingles: 0.836
    docs = make_docs([(1, "x y z " + edited.upper().replace("Q", "q") + " tail", "a"), (2, item[:100], "a"), (3, None, "a"),
                      (None, item, "a"), (4, "clean words only in this text here", "a")])
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    got = decontaminate.matches(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in got] == [(1, 1, 3)]
    assert decontaminate.matches(docs, items.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, items).collect()) == ["2", "3", "4", "None"]


def test_decontamination_edited_ends_and_insertion(spark, make_docs):
    """The best window may start where no shared shingle stands in its place of the item."""
    sizes = (15, 37, 59, 59, 59)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate(sizes)]
    rows = []
    for k, item in enumerate(items):
        for cut in (len(item) // 3, 29):
            for more in (1, 2, 3):
                for lead in (0, 1, 7, 80):
                    text = ["first", *item[1:cut], *["new"] * more, *item[cut:-1], "last"]
                    rows.append((len(rows), " ".join([f"a{j}" for j in range(lead)] + text + [f"z{j}" for j in range(lead)]), "a"))
    table = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    bag = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    want = {}
    for doc, text, _ in rows:
        w = text.split()
        for k, item in enumerate(items):
            b, n = bag(item), len(item)
            best = max((sum((c & b).values()) / sum((c | b).values()), -s) for s in range(max(1, len(w) - n + 1))
                       for c in [bag(w[s:s + n])])
            if best[0] >= 0.75:
                want[doc, k] = (round(best[0], 6), -best[1])
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.start) for r in decontaminate.matches(make_docs(rows), table).collect()}
    assert any(s == round(48 / 62, 6) for s, _ in want.values()) and got == want


def test_licenses(spark, make_docs, odd_docs):
    long = dict((t, n) for n, t in licenses.NOTICES)
    rows = [(k, f"{'w ' * k}{t.upper()} and more words after it", "a") for k, t in enumerate(long)]
    got = licenses.scan(make_docs(rows), licenses.notices(spark)).collect()
    found = {(r.doc_id, r.template_id) for r in got}
    assert {(k, k) for k in range(len(rows))} <= found
    assert all(r.containment >= 0.75 for r in got)
    assert licenses.scan(odd_docs, licenses.notices(spark)).count() == 0


def test_language_model(spark, sf_dir, table):
    rows = registered.op4_brown_lm(spark, sf_dir).collect()
    docs = [(i, [w.encode() for w in words(t, True)] + [None]) for i, t in rows_of(table("documents"))]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    count = Counter(w for i, ws in docs if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in rows}
    for i, ws in docs:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_small_tables_agree(table):
    """The score does not depend on which words are at hand and which are joined."""
    docs = table("documents")
    train = docs.filter(~brown.held_out())
    scores = []
    for lookup in (20, brown.LOOKUP):
        model, known = brown.fit(train, head=100, suffixes=50, classes=8, lookup=lookup)
        scores.append({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in brown.score(docs, model, known).collect()})
    assert scores[0] == scores[1]


def test_exchange_gains_information():
    import numpy as np

    rng = np.random.default_rng(3)
    kind = np.arange(30) % 3  # words of three kinds that follow each other in turn
    pairs = np.zeros((31, 31), np.int64)
    for a in range(30):
        for b in range(30):
            pairs[a, b] = rng.poisson(20 if kind[b] == (kind[a] + 1) % 3 else 0.2)
    own = brown.exchange(pairs, classes=3, sweeps=20)
    assert all(len({own[i] for i in range(30) if kind[i] == k}) == 1 for k in range(3)) and own[30] == 3


def test_language_model_odd_rows(odd_docs, no_docs):
    model, known = brown.fit(odd_docs.filter(~brown.held_out()))
    rows = brown.score(odd_docs, model, known).collect()
    assert len(rows) == 15 and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    model, known = brown.fit(no_docs)
    assert brown.score(no_docs, model, known).count() == 0


def test_toxicity(spark, table):
    docs, labels = table("documents"), table("labels")
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"),
                         spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_odd_rows(odd_docs, no_docs, table):
    model = toxicity.fit(odd_docs, table("labels").limit(0))
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == 15 and len({r.score for r in rows}) == 1
    assert toxicity.score(no_docs, toxicity.fit(no_docs, table("labels"))).count() == 0


def test_restoration(spark):
    from tickloom.llm.deobfuscate import Restorer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    restore = Restorer(toxicity.character_model(docs))
    assert restore("1d10t") == ["idiot"] and restore("m0r0n") == ["moron"] and restore("cl0wn") == ["clown"]
    assert restore("stuuuupid") == ["stupid"] and restore("idiot", True) == ["idiot"]
