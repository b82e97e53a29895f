"""The mix and the URL filter on small made tables; the main cases are compared with SQL."""

from __future__ import annotations

import pytest

from chunkwell.llm import mixing, url_rules
from chunkwell.llm.components import connected_components
from chunkwell.llm.queries import REGISTRY


def test_mix_of_odd_rows(spark):
    rows = [(k, "w " * (k % 7), "abc"[k % 3]) for k in range(60)]
    rows += [(100, None, "a"), (101, "", None), (102, "one two three", None), (102, "one two three", None), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS size", "2 AS words")
    got = mixing.curriculum(docs, rows_per_group=5).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        mine = by_source.setdefault(r.source, [r.source_size, r.target, 0])
        mine[2] += r.taken
    assert abs(sum(t for _, t, _ in by_source.values()) - total) < 1e-6
    assert all(t <= 3 * s + 1e-9 and int(t) == taken for s, t, taken in by_source.values())
    # a tiny source wants more than three rounds: the rest is shared by the others
    assert by_source[None][1] == 3 * by_source[None][0]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.curriculum(docs.repartition(5)).collect()), key=str)
    order = mixing.training_order(mixing.curriculum(docs)).collect()
    assert sum(r.taken_words for r in order) == sum(r.taken for r in got)
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert mixing.curriculum(docs.limit(0)).collect() == []


def test_documents_come_in_training_order(spark, new_dir):
    rows = [(k, "w " * (k % 7), "abc"[k % 3]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.write.parquet(f"{(root := new_dir())}/documents.parquet")
    places = [r.position for r in REGISTRY["op6_mixing"](spark, root).collect()]
    taken = [p for p in places if p is not None]
    assert len(places) == 200 and taken and taken == sorted(taken)
    assert places[len(taken) :] == [None] * (200 - len(taken))


def test_weights_are_integrated_along_schedules(spark):
    assert mixing.integrated_weights((1, 2, 3), mixing.SCHEDULES) == [1, 2, 3]
    even, half = ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 1.0))
    assert mixing.integrated_weights((1, 2, 3), (even, half)) == [2, 2, 6, 1, 4, 3]
    docs = spark.createDataFrame([(k, "w x", "ab"[k % 2]) for k in range(40)], "doc_id bigint, text string, source string")
    got = {r.source: r.target for r in mixing.curriculum(docs, (1,), (even, half)).collect()}
    assert got["a"] == pytest.approx(160 / 3) and got["b"] == pytest.approx(80 / 3)


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, ((0.0, 0.0), (0.4, 2.0), (1.0, 0.0))])
def test_schedule_is_inverted(spark, schedule):
    def integral(t):
        area = 0.0
        for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]):
            x = min(max(t - t0, 0), t1 - t0)
            area += x * (r0 + (r0 + (r1 - r0) * x / (t1 - t0))) / 2
        return area

    df = spark.range(0, 101).selectExpr("id / 100.0D AS share")
    for share, t in df.select("share", mixing.invert_schedule(schedule, df.share)).collect():
        assert abs(integral(t) - share * integral(1.0)) < 1e-9


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (8, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 140)}


def test_block_decisions_follow_links(spark):
    rules = (("block", "bad.org", "/x"), ("allow", "good.org", "/"), ("block", "evil.net", "/"))
    link = '<link href="{}" rel="canonical">'.format
    pages = [
        (1, "http://bad.org/x/1", link("https://mirror.io/a?utm_source=z#t")),
        (2, "https://www.mirror.io/a/", None),
        (3, "http://mirror.io/b", '<META http-equiv=refresh content="0; url=/a">'),
        (4, "http://other.io/", link("//evil.net/q")),
        (5, "http://evil.net/q", link("http://good.org/z")),
        (6, "http://free.io/", ""),
        (7, None, link("http://evil.net/q")),
        (8, "no scheme", None),
        (9, "HTTP://EVIL.net", None),
        (6, "http://free.io/", ""),
    ]
    frame = spark.createDataFrame(pages, "page_id int, url string, html string").selectExpr("*", "1 AS rule", "2 AS alias")
    got = [(r.id, r.host, r.rule, r.verdict) for r in url_rules.filter_urls(frame, rules).collect()]
    assert sorted(got, key=lambda r: r[0]) == [
        (1, "bad.org", "bad.org/x", "block"),
        (2, "www.mirror.io", None, "block"),
        (3, "mirror.io", None, "block"),
        # joined with an allowed page: allowing wins for pages without a rule
        (4, "other.io", None, "allow"),
        (5, "evil.net", "evil.net/", "block"),
        (6, "free.io", None, "allow"),
        (6, "free.io", None, "allow"),
        (7, "", None, "allow"),
        (8, "", None, "allow"),
        (9, "evil.net", None, "allow"),
    ]
    known = spark.createDataFrame([("http://free.io", "http://bad.org/x/1")], "from_url string, to_url string")
    again = {r.id: r.verdict for r in url_rules.filter_urls(frame, rules, known).collect()}
    assert again[6] == "block"
    assert url_rules.filter_urls(frame.limit(0), rules).collect() == []


def test_a_link_to_its_own_page_counts(spark):
    rules = (("allow", "com", "/"), ("block", "net", "/es/"))
    pages = [(1, "http://a.net/es", '<link rel=canonical href="http://a.net/es/">'), (2, "http://b.net/es", None)]
    frame = spark.createDataFrame(pages, "page_id int, url string, html string")
    assert {r.id: (r.rule, r.verdict) for r in url_rules.filter_urls(frame, rules).collect()} == {1: (None, "block"), 2: (None, "allow")}


def test_very_many_rules(spark):
    rules = [("block" if k % 2 else "allow", f"h{k}.org", f"/p{k}/") for k in range(20_000)]
    rules += [("block", "org", "/"), ("allow", "org", "/"), ("block", "a.b.c.d", "/x"), ("allow", "c.d", "/x/y")]
    urls = ["http://h7.org/p7/x", "http://sub.h8.org/p8/", "http://h9.org/p10/", "http://a.b.c.d/x/y", "http://z.a.b.c.d/x", "http://b.c.d/x/yes",
            "http://" + "." * 2_000 + "h8.org/p8/", "http://org", "http://org/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.id: (r.rule, r.verdict) for r in url_rules.filter_urls(frame, rules, html_col=None).collect()}
    assert got == {
        0: ("h7.org/p7/", "block"), 1: ("h8.org/p8/", "allow"), 2: ("org/", "allow"), 3: ("a.b.c.d/x", "block"),
        4: ("a.b.c.d/x", "block"), 5: ("c.d/x/y", "allow"), 6: ("h8.org/p8/", "allow"), 7: (None, "allow"), 8: ("org/", "allow"),
    }
