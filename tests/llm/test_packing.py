import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 30), st.lists(st.integers(1, 12), max_size=8))
def test_fill_is_the_fullest(room, sizes):
    got = P.fill(room, {s: sizes.count(s) for s in sizes})
    assert all(got.count(s) <= sizes.count(s) for s in got)
    best = max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room)
    assert sum(got) == best


def test_pack_holds_every_item_once_and_wastes_little():
    rnd = random.Random(2)
    sizes = [rnd.randrange(1, 900) for _ in range(1500)]
    bins = P.pack(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(1500))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= sum(sizes) // 2048 + 2


def test_documents(spark):
    texts = [None, "", "word " * 30, "word " * 10, "word " * 250, "a", "word " * 10, "x" * 300_000]
    df = spark.createDataFrame([(i if i != 5 else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id int, text string, container string, tokens int")
    rows = P.pack_documents(df, 100).collect()
    tokens = dict(enumerate(P.count_tokens(texts).tolist()))
    tokens[None] = tokens.pop(5)
    assert tokens[0] == tokens[1] == 0 and tokens[7] > 10_000
    for doc, n in tokens.items():
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert sum(r.tokens for r in mine) == n and len(mine) == -(-n // 100) == (mine[0].n_pieces if mine else 0)
        assert [r.first_token for r in mine] == [100 * i for i in range(len(mine))]
    by = {}
    for r in rows:
        by.setdefault(r.container, []).append(r)
    assert all(sum(r.tokens for r in v) == v[0].used <= 100 for v in by.values())
    assert P.pack_documents(df.limit(0), 100).count() == 0
    fill = P.fill_report(P.pack_documents(df, 100), 100).first()
    assert fill.tokens == sum(tokens.values()) and fill.containers == len(by) >= fill.least and abs(fill.fill - fill.tokens / (100 * fill.containers)) < 1e-12
    assert P.fill_report(P.pack_documents(df.limit(0), 100), 100).first().containers == 0


def test_rows_without_ids_are_spread(spark):
    df = spark.createDataFrame([(None if i % 3 else 7, "word " * (1 + i % 9)) for i in range(900)], "doc_id long, text string")
    rows = P.pack_documents(df, 64, group_docs=100).collect()
    assert len(rows) == 900 and len({r.container.split("-")[0] for r in rows}) == 9


def test_groups_only_add_a_container_each(spark):
    df = spark.createDataFrame([(i, "", 1 + i * 7 % 40) for i in range(2000)], "doc_id long, label string, tokens long")
    rows = P.pack_sizes(df, 64, 500).groupBy("container").count().count()
    assert rows <= sum(1 + i * 7 % 40 for i in range(2000)) / 64 + 5


def test_long_texts_are_cut_at_blanks():
    text = ("lorem ipsum " * 30_000) + "y" * 250_000
    assert "".join(P.count_tokens.__globals__["blocks"](text)) == text
