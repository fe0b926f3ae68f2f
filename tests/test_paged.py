"""The paged source: interrupted runs give each item once, gaps are waited for, and providers' entries become items."""

import json

import pytest

from tidemark.sources import paged
from tidemark.streaming import ledger


def put(root, number, entries):
    folder = root / f"page={number}"
    folder.mkdir(parents=True)
    (folder / "part.json").write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries))
    (folder / "_SUCCESS").write_text("")


def entry(i):
    return {"objectID": i, "title": f"T{i}", "url": f"https://a.example/{i}" if i % 2 else None, "created_at": "2024-01-01"}


def test_runs_go_on_where_the_last_one_stopped(spark, tmp_path):
    root, out = tmp_path / "in", f"file://{tmp_path}/out"
    root.mkdir()
    run = lambda: ledger.to_table(paged.read_pages(spark, f"file://{root}", "search_by_date"), out)
    guids = lambda: sorted((int(r.guid), r.page) for r in run().collect())
    assert guids() == []
    put(root, 0, [entry(1), entry(2)])
    put(root, 1, [entry(3)])
    put(root, 3, [entry(9)])  # page 2 has not come yet
    assert guids() == [(1, 0), (2, 0), (3, 1)]
    put(root, 2, ["{broken"])
    with pytest.raises(Exception, match="(?i)json|expecting|stream"):
        run()
    (root / "page=2" / "part.json").write_text(json.dumps(entry(4)) + "\n\n" + json.dumps({"objectID": 5, "title": " "}))
    assert guids() == [(1, 0), (2, 0), (3, 1), (4, 2), (9, 3)]
    assert guids() == [(1, 0), (2, 0), (3, 1), (4, 2), (9, 3)]


def test_items():
    one = paged.PROVIDERS["search_by_date"]
    assert one.item(entry(2)) == ("2", "T2", "https://news.example/item?id=2", "2024-01-01", None)
    assert one.item(entry(3))[2] == "https://a.example/3" and one.item({"title": "no id"}) is None and one.item({"objectID": 1, "title": None}) is None
    assert paged.PROVIDERS["papers"].item({"id": "x", "title": "t", "links": {"abstract": "u"}})[2] == "u"
    assert paged.PROVIDERS["papers"].item({"id": "x", "title": "t", "links": "none"})[2] is None
