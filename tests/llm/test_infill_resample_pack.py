"""Fill in the middle, importance resampling and packing against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import cutting_stock, importance, infill, packing
from tickloom.llm import queries as registered
from tickloom.llm.rank_index import RankIndex
from tickloom.llm.span_crc import span_crcs
from tickloom.llm.token_ids import Ids

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# -- fill in the middle

@pytest.mark.parametrize("letters", ["ab ", "aé", "aé中😀", "中文", "😀a"])
@pytest.mark.parametrize("block", [7, 1 << 20])
def test_rank_index_is_exact(letters, block):
    draw = random.Random(letters)
    for n, error in ((0, 120), (1, 120), (300, 2), (4000, 120)):
        text = "".join(draw.choice(letters) for _ in range(n)) + "x" * n + "é" * (n // 3)
        index = RankIndex.fit(np.frombuffer(text.encode(), np.uint8), error, block)
        want = np.cumsum([0] + [len(c.encode()) for c in text])
        assert index.ranks == len(text) and np.abs(index.residual.astype(int)).max(initial=0) <= error + 1
        assert (index.offsets(np.arange(len(text) + 1)) == want).all()
        assert (index.rank_of(want) == np.arange(len(text) + 1)).all()


def test_rank_index_takes_few_segments():
    data = np.frombuffer(("hello wörld дом " * 50_000).encode(), np.uint8)
    assert len(RankIndex.fit(data).start) < 20


def in_the_middle(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def check_infill(docs):
    back = infill.restored(F.col("fim.output"), F.col("fim.form"))
    rows = infill.rearrange(docs).select("doc_id", "text", "fim", back.alias("back")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r.fim) == in_the_middle(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_infill_small_table(table):
    check_infill(table("documents"))


def test_infill_odd_rows(odd_docs, no_docs, make_docs):
    check_infill(odd_docs)
    assert infill.rearrange(no_docs).count() == 0
    marked = make_docs([(i, t, "a") for i, t in enumerate(
        ["a <P> b", "<S>", "x<M", "<", ">", "<P", "S>", "<<S", "M>>", "a\x00b", "中" * 50, "😀" * 999 + "a"] * 4)])
    check_infill(marked)
    named = odd_docs.withColumn("fim", F.lit("x"))
    assert infill.rearrange(named).columns == [*odd_docs.columns, "fim"]


# -- importance resampling

@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), max_size=30))
@settings(max_examples=60, deadline=None)
def test_span_crc_is_zlibs(data, spans):
    spans = [(min(a, len(data)), min(max(a, b), len(data))) for a, b in spans]
    held = np.frombuffer(data, np.uint8)
    got = span_crcs(held, np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def test_span_crc_of_long_spans():
    data = np.random.default_rng(3).integers(0, 256, 300_000).astype(np.uint8)
    ends = np.array([63, 64, 65, 127, 128, 129, 4095, 4097, 250_001, 300_000])
    for start in (0, 1, 63):
        got = span_crcs(data, np.full(len(ends), start), ends)
        assert got.tolist() == [zlib.crc32(data[start:e].tobytes()) for e in ends]


def grams(text, longest=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, buckets=10_000, longest=1, percent=10, least=20):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for r in docs for g in grams(r.text, longest)[1])
    t = Counter(bucket(g) for r in target for g in grams(r.text, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for r in docs:
        words, g = grams(r.text, longest)
        h = int(hashlib.sha256(f"2024:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in g)
        rows.append([r.doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "importance.*").collect()), key=str)


def test_resample_small_table(table):
    docs, target = table("documents"), table("benchmark")
    assert drawn(importance.resample(docs, target, keep=["doc_id"])) == resampled(docs.collect(), target.collect())


def test_resample_grams_and_odd_rows(odd_docs, no_docs, table):
    target = table("benchmark").limit(20)
    got = importance.resample(odd_docs.withColumn("importance", F.lit(1)), target, percent=50, least_words=3, buckets=500, longest=3)
    assert got.columns == [*odd_docs.columns, "importance"]
    want = resampled(odd_docs.collect(), target.collect(), 500, 3, 50, 3)
    assert drawn(got) == want
    assert importance.resample(no_docs, target).count() == 0
    alone = importance.resample(odd_docs, target.limit(0))
    assert alone.count() == odd_docs.count()


# -- packing

def test_token_ids_are_those_of_whole_texts():
    whole, ids = Tokenizer.from_file(VOCABULARY), Ids(VOCABULARY)
    draw = random.Random(5)
    parts = ["a", "B", "the", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​", "é", "中", "😀", "'s", "'",
             "1", "23", ".", "!?", "—", "<|", "|>", "endoftext", "<|endoftext|>", " <|endoftext|> ", "\x00"]
    texts = ["", ""] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(4000)] + [""]
    flat, ends = ids.of(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert flat[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids


def fewest(capacity, lengths):
    """The fewest bins for a handful of pieces, by trying all."""
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                put(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1:])
        put(i + 1, bins + [lengths[i]])

    put(0, [])
    return best[0]


def test_cutting_stock_bounds_the_fewest_sequences():
    draw = random.Random(8)
    for _ in range(25):
        lengths = sorted((draw.randint(5, 60) for _ in range(draw.randint(1, 9))), reverse=True)
        counts = Counter(lengths)
        found = cutting_stock.solve(64, counts, gap=0.0)
        best = fewest(64, lengths)
        assert found.bound <= best + 0.02 and found.amounts.sum() >= found.bound - 1e-6
        for pattern in found.patterns:
            assert sum(s * n for s, n in pattern.items()) <= 64
        # as a whole: the program holds every piece
        for s, n in counts.items():
            assert sum(p.get(s, 0) * x for p, x in zip(found.patterns, found.amounts)) >= n - 1e-6


def test_columns_are_generated_where_first_fit_wastes():
    draw = np.random.default_rng(1)
    counts = Counter(draw.integers(500, 1400, 20_000).tolist())
    start = cutting_stock.first_patterns(2048, np.array(sorted(counts)), np.array([counts[s] for s in sorted(counts)], float))
    found = cutting_stock.solve(2048, counts)
    assert found.rounds > 0 and found.amounts.sum() < sum(x for _, _, x in start)
    assert found.amounts.sum() <= found.bound * 1.001
    best, pattern = cutting_stock.best_filling(10, np.array([3, 4, 7]), np.array([3.0, 4.5, 8.0]))
    assert best == 11.0 and pattern == {0: 1, 2: 1}


@pytest.mark.parametrize("lengths", [
    [], [1], [2048], [2049], [5000] * 3, [1100] * 400, [2047] * 50, [1024] * 9, list(range(1, 2100, 7)), [3] * 3000 + [1500] * 900])
def test_plan_places_every_token_once(lengths):
    counts, fulls = Counter(n % 2048 for n in lengths), Counter()
    for n in lengths:
        fulls[n % 2048] += n // 2048
    made = packing.plan(2048, counts, fulls)
    rank, full, sequences = Counter(), Counter(), {}
    for n in lengths:
        s = n % 2048
        pieces = packing._pieces(made, n, rank[s], full[s], [7] * (n // 2048 + 1))
        rank[s] += 1
        full[s] += n // 2048
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1]] and sum(p[1] for p in pieces) == n
        for _, size, _, sequence, offset in pieces:
            sequences.setdefault(sequence, []).append((offset, size))
    padding = 0
    for held in sequences.values():
        end = 0
        for offset, size in sorted(held):
            assert offset == end
            end += size
        assert end <= 2048
        padding += 2048 - end if end & (end - 1) else 0
    assert padding <= 0.01 * sum(lengths)


def check_pack(docs, least_padding=0.01):
    whole = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(docs.withColumn("own", F.monotonically_increasing_id()), VOCABULARY).select("own", "doc_id", "piece.*").collect()
    texts = {r.own: r for r in docs.withColumn("own", F.monotonically_increasing_id()).collect()}
    held, sequences = {}, {}
    for r in rows:
        held.setdefault(r.own, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert held.keys() == texts.keys()
    for own, pieces in held.items():
        ids = np.array(whole.encode(texts[own].text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.doc_id == texts[own].doc_id
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        end = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= 2048
        padding += 2048 - end if end & (end - 1) else 0
    assert padding <= least_padding * sum(r.length for r in rows)


def test_pack_small_table(table):
    check_pack(table("documents"))


def test_pack_odd_rows(odd_docs, no_docs, make_docs):
    check_pack(odd_docs.withColumn("piece", F.lit(1)))
    assert packing.pack(no_docs, VOCABULARY).count() == 0
    # rests of one length fill no sequence: most are cut to fill the gaps of the others
    check_pack(make_docs([(i, "tok " * 1100, "a") for i in range(40)]))


def test_registered_columns(spark, sf_dir):
    assert registered.op11_fill_in_middle(spark, sf_dir).columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert registered.op12_importance_resampling(spark, sf_dir).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert registered.op13_cutting_stock_packing(spark, sf_dir).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
