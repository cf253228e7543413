from __future__ import annotations

from tidemark.llm import urls

PAGES = "page_id long, url string"
LABELS = "doc_id long, quality int, toxic int"


def test_hosts_paths_and_rules(spark):
    given = {
        "HTTP://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://b.com/fr/://y": ("b.com", "/fr/://y", "com/fr/", "allow"),
        "http://b.com/de/\nz": ("b.com", "/de/\nz", "com/de/", "block"),
        "http://É.com?x": ("É.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], PAGES)
    got = urls.judge(pages, spark.createDataFrame([], LABELS)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(given.values())


def test_bad_hosts_are_blocked_and_few_outcomes_are_not_enough(spark):
    pages, labels = [], []
    for i in range(300):
        host = "bad.example.net" if i < 60 else "good.example.net" if i < 160 else f"h{i % 20}.other.info"
        pages.append((i, f"http://{host}/{i}"))
        labels.append((i, 0 if i < 60 or i % 10 == 0 else 1, 0))
    pages += [(1000, "http://one.example.net/x"), (1001, "http://bad.example.net/unlabelled"), (1002, "http://new.info/")]
    labels.append((1000, 0, 1))
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[0] == got[1001] == "block"
    assert got[100] == got[201] == got[1002] == "allow"
    assert len(got) == len(pages)


def test_domains(spark):
    rows = spark.createDataFrame([("u@www.a.co.uk:80",), ("b.example.net.",), ("localhost",), ("",)], "h string")
    bare = urls.bare_host(rows["h"])
    got = [tuple(r) for r in rows.select(urls.domain_of(bare), urls.suffix_of(bare)).collect()]
    assert got == [("a.co.uk", "co.uk"), ("example.net", "net"), ("localhost", "localhost"), ("", "")]


def test_null_labels_and_empty_pages(spark):
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (1, 1, 0)], LABELS)
    assert urls.judge(spark.createDataFrame([], PAGES), labels).count() == 0
    rows = urls.judge(spark.createDataFrame([(1, "http://q.net/"), (None, "http://q.net/")], PAGES), labels).collect()
    assert [r.verdict for r in rows] == ["allow", "allow"]
