"""Every story leads to a candidate of the near pairs, and no different title is dropped."""

from tidemark.operators import dedup


def test_members(spark):
    rows = [(1, "a", "one two", 5), (2, "a", "one two", 5), (3, "a", "other title", 5), (4, "b", "one two", 5), (5, "b", "one two", 5), (6, "c", "far", 1 << 40)]
    stories = spark.createDataFrame(rows, "id long, source string, title string, sig long")
    assert {r.id: r.rep for r in dedup.first_stories(stories).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    pairs = {(r.id, r.other) for r in dedup.near_pairs(stories).collect()}
    assert {(1, 4), (3, 4)} <= pairs

    def judged(members, pairs):
        return {(x, y) for x, p in members.items() for y, q in members.items() if (min(p, q), max(p, q)) in pairs}

    members = {r.id: r.rep for r in dedup.first_stories(stories).collect()}
    near = {(a[0], b[0]) for a in rows for b in rows if a[1] != b[1] and 6 not in (a[0], b[0])}
    assert near <= judged(members, pairs)


def test_members_of_documents(spark):
    from tidemark.plans.documents import c2_near_titles, c2_title_members

    members = {r.id: r.rep for r in c2_title_members(spark, "/root/testdata/sf0.001").collect()}
    assert {x for r in c2_near_titles(spark, "/root/testdata/sf0.001").collect() for x in (r.id, r.other)} <= set(members.values())
    assert all(members[r] == r for r in members.values())
