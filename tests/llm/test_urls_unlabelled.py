from __future__ import annotations

from test_urls import LABELS, PAGES
from tidemark.llm import urls


def judged(spark, pages, labels):
    rows = urls.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(pages)
    return {r.page_id: r for r in rows}


def test_unlabelled_hosts_take_the_level_above(spark):
    """Every domain and suffix is all bad or all good."""
    hosts = [f"h{h}.bad.net" for h in range(10)] + [f"h{h}.good.net" for h in range(10)]
    hosts += [f"h{h}.d{h}.xyz" for h in range(10)] + [f"h{h}.e{h}.info" for h in range(30)]
    pages = [(i, f"http://{h}/{k}") for i, (h, k) in enumerate((h, k) for h in hosts for k in range(10))]
    labels = [(i, 0 if ".bad.net/" in u or ".xyz/" in u else 1, 0) for i, u in pages]
    new = {
        9000: "http://new.bad.net/x",
        9001: "http://new.good.net/x",
        9002: "http://new.unseen.xyz/x",
        9003: "http://new.unseen.info/x",
        9004: "http://new.unseen.biz/x",
        9005: None,
    }
    got = judged(spark, pages + list(new.items()), labels)
    assert {i: got[i].verdict for i in new} == {9000: "block", 9001: "allow", 9002: "block", 9003: "allow", 9004: "allow", 9005: "allow"}
    assert all(got[i].bound is not None for i in new)
    # Labelled hosts are judged as if the unlabelled ones were not there.
    alone = judged(spark, pages, labels)
    assert all(got[i].bound == alone[i].bound for i, _ in pages)


def test_strength_of_each_level(spark):
    """One labelled group a level, so each strength follows from eight bad pages."""
    pages = [(i, f"http://a.one.net/{i}") for i in range(8)] + [(100, "http://b.one.net/"), (101, "http://b.two.net/"), (102, "http://b.c.biz/")]
    got = judged(spark, pages, [(i, 0, 0) for i in range(8)])
    mean = 9 / 10
    for i, n in ((102, 0), (101, 1), (100, 2)):
        m = mean
        for _ in range(n):
            v = m * (1 - m)
            rho = ((8 - 8 * m) ** 2 - 8 * v) / (56 * v)
            s = 1 / min(max(rho, 0.01), 0.99) - 1
            m = (s * m + 8) / (s + 8)
        v = m * (1 - m)
        rho = ((8 - 8 * m) ** 2 - 8 * v) / (56 * v)
        s = 1 / min(max(rho, 0.01), 0.99) - 1
        assert abs(got[i].bound - (m - 1.645 * (v / (s + 1)) ** 0.5)) < 1e-4
