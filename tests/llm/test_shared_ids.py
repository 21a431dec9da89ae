"""Rows that share a doc_id or have none, and broken pages."""

import random
import time

import pytest

from tickloom.llm import curriculum, main_text, ngram_join, shards
from tests.llm.conftest import shingles


def body(seed, n=60):
    return " ".join(f"s{seed}w{i}" for i in range(n))


def crowded(n=400):
    """Rows under doc_id 7 or none, with texts of different lengths."""
    r = random.Random(5)
    return [(7 if i % 2 else None, " ".join(f"x{i}" for _ in range(r.randint(1, 40))), "ab"[i % 3 == 0]) for i in range(n)]


@pytest.mark.parametrize("operator", ["mix", "shards"])
def test_any_partitioning_gives_the_same(make_docs, operator):
    got = []
    for parts, seed in ((1, 1), (5, 2), (13, 3)):
        rows = crowded()
        random.Random(seed).shuffle(rows)
        docs = make_docs(rows).repartition(parts)
        if operator == "mix":
            out = curriculum.plan(docs).selectExpr("doc_id", "text", "source", "mix.taken", "get(mix.passes, 0).position as at")
        else:
            out = shards.assign(docs)
        got.append(sorted(map(str, out.collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 400


def test_rows_without_doc_id_are_spread(make_docs):
    docs = make_docs(crowded()).filter("doc_id is null")
    hashes = docs.select(curriculum.seeded(17, content=curriculum.content_mark()).alias("h")).distinct().count()
    assert hashes == docs.select("text").distinct().count()


def test_many_repeats_of_a_row(make_docs):
    out = shards.assign(make_docs([(1, "same", "a")]).selectExpr("*", "explode(sequence(1, 9000)) as z").drop("z"))
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(counts) == 9000 and len(counts) == 24 and max(counts) - min(counts) <= 1


def test_each_text_of_a_doc_id_keeps_its_links(make_docs):
    rows = [(6, body(k), "a") for k in range(3)] + [(7 + k, body(k) + " tail", "b") for k in range(3)]
    rows += [(6, None, "a"), (20, body(9), "a"), (21, body(9) + " end", "a"), (21, body(8), None), (30, body(8), "c"),
             (40, "alone", "a"), (None, body(0), "a"), (6, body(0), "a")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.link(make_docs(rows)).collect())
    component = {6: 6, 7: 6, 8: 6, 9: 6, 20: 20, 21: 20, 30: 20, 40: 40, None: None}
    assert got == sorted((i or -1, len(shingles(t)), component[i]) for i, t, _ in rows)
    kept = sorted(r.doc_id or -1 for r in ngram_join.keep_one(make_docs(rows)).collect())
    assert kept == [-1, 6, 6, 6, 6, 6, 20, 40]


def test_quotes_outside_values():
    text = lambda page: " ".join(t for _, t in main_text.blocks(page))
    assert text("<article><p class=it's>Hello\n world</p><p>Don't go</p><p>third</p></article>") == "Hello world Don't go third"
    assert text('<article><p title="a>Hello') == "Hello"
    assert text("<article><p title='a > b' x = \"c > d\">Hello</p></article>") == "Hello"


def test_names_that_only_sound_like_parts():
    content = lambda page: " ".join(t for k, t in main_text.blocks(page) if k == main_text.CONTENT)
    page = "<article><div class='{}'>x</div><p>end</p></article>"
    for name in ("share-price", "search-results", "side-by-side"):
        assert content(page.format(name)) == "x end"
    for name in ("ad-slot", "social-share", "related-posts", "comment-list", "newsletter", "share_box", "ad-2"):
        assert content(page.format(name)) == "end"


@pytest.mark.parametrize("page", ["<p x " * 200_000 + '"', "<p>" * 100_000 + "</x>" * 100_000, '<p a="' * 150_000,
                                  "<b>" + "<p>" * 100_000 + "</b>" * 100_000])
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    main_text.blocks(page)
    assert time.process_time() - start < 5
