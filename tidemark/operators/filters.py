"""The reader's filter language: one value that says which stories are wanted, and the clauses that it stands for.

A story has id, source, title, title_en, url, at (event time), lang, event_kind, is_tech, superseded_by, dismissed_at, prerelease,
importance, coverage, country and the arrays tags, companies and platforms. `Reader` holds the tables beside the stories: the taxonomy
(slug, parent, category, kind), its closure (root, member) or labels, first months and story counts of tags, categories of companies and channels of platforms.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import search
from tidemark.functions.gates import MONEY
from tidemark.operators.hierarchy import expand, inside

# Event classes, those shown where none is asked for, what a story may be about, and money lenses.
EVENT_KINDS = ("launch", "release", "change", "market", "article")
EVENT_DEFAULT = ("launch", "release", "change", "market")
ABOUT = ("tech", "tool", "company", "platform")
LENSES = tuple(dict(MONEY))
SORTS = ("newest", "firstseen", "importance", "rarest", "velocity", "coverage")


@dataclass(frozen=True)
class Filters:
    """A selection of stories. Empty values narrow nothing; several values of one field widen it."""

    q: str = ""
    stream: str = "all"
    source: tuple = ()
    tag: tuple = ()
    field: tuple = ()
    focus: tuple = ()
    category: tuple = ()
    type: tuple = ()
    company: tuple = ()
    ctype: tuple = ()
    platform: tuple = ()
    channel: tuple = ()
    country: tuple = ()
    money: tuple = ()
    kind: tuple = ()
    tracked: tuple = ()
    about: str = ""
    start: str = ""
    end: str = ""
    fresh: int | None = None
    coverage: int | None = None
    rare: int | None = None
    least: int | None = None
    days: int | None = None
    unread: bool = False
    sort: str = "newest"
    offset: int = 0


_MANY = tuple(f.name for f in fields(Filters) if f.default == ())
_NUMBERS = ("fresh", "coverage", "rare", "least", "days", "offset")
_ALLOWED = {"kind": EVENT_KINDS, "money": LENSES}


def _day(text: str) -> str:
    try:
        return text if date.fromisoformat(text).isoformat() == text else ""
    except ValueError:
        return ""


def parse(query: str, known: dict[str, tuple] | None = None) -> Filters:
    """A query string as filters. What is not known to a field with a closed vocabulary, malformed days and numbers
    count as not given; repeated values count once, in order."""
    allowed, given = _ALLOWED | (known or {}), {}
    for name, value in parse_qsl(query.lstrip("?")):
        given.setdefault(name, []).append(value.strip())
    out = {}
    for name in _MANY:
        values = tuple(dict.fromkeys(v for v in given.get(name, ()) if v and (name not in allowed or v in allowed[name])))
        if values and name not in ("focus", "tracked"):
            out[name] = values
    for name in _NUMBERS:
        value = given.get(name, [""])[0]
        if value.removeprefix("-").isdigit():
            out[name] = max(0, int(value)) if name == "offset" else int(value)
    for name, choices in (("about", ABOUT), ("sort", SORTS), ("stream", ("news", "new", "all"))):
        if (value := given.get(name, [""])[0]) in choices:
            out[name] = value
    for name in ("start", "end"):
        if day := _day(given.get(name, [""])[0]):
            out[name] = day
    return Filters(**out, q=given.get("q", [""])[0], unread=given.get("unread", [""])[0] == "1")


def encode(f: Filters) -> str:
    """The shortest query string that `parse` turns into these filters; preferences (focus, tracked) stay out of it."""
    pairs = []
    for x in fields(Filters):
        value = getattr(f, x.name)
        if value == x.default or x.name in ("focus", "tracked"):
            continue
        pairs += [(x.name, v) for v in value] if isinstance(value, tuple) else [(x.name, "1" if value is True else value)]
    return urlencode(pairs)


def toggled(f: Filters, name: str, value: str) -> Filters:
    """The value added if absent and removed if present, back on the first page. Event kinds start from what is shown, and the default set is written as none."""
    now = getattr(f, name) or (EVENT_DEFAULT if name == "kind" else ())
    now = tuple(v for v in now if v != value) if value in now else (*now, value)
    if name == "kind" and (not now or set(now) == set(EVENT_DEFAULT)):
        now = ()
    return replace(f, **{name: now, "offset": 0})


@dataclass
class Reader:
    """Tables beside the stories; those that no clause needs may be missing. `as_of` is the time that relative clauses start from."""

    as_of: str
    taxonomy: DataFrame | None = None
    closure: DataFrame | None = None
    labels: DataFrame | None = None
    first_month: DataFrame | None = None
    frequency: DataFrame | None = None
    companies: DataFrame | None = None
    platforms: DataFrame | None = None
    reads: DataFrame | None = None


def holding(stories: DataFrame, array: str, wanted: DataFrame) -> DataFrame:
    """Stories with an element of `array` in the one column of `wanted`: the elements are exploded to an equi-join."""
    key = wanted.columns[0]
    hit = stories.select("id", F.explode(array).alias(key)).join(wanted, key, "left_semi").select("id").distinct()
    return stories.join(hit, "id", "left_semi")


def overlapping(stories: DataFrame, array: str, values: tuple) -> DataFrame:
    return stories.filter(F.arrays_overlap(F.coalesce(array, F.array().cast("array<string>")), F.array(*map(F.lit, values))))


def under(stories: DataFrame, roots: tuple, reader: Reader) -> DataFrame:
    """Stories with a tag among the roots or below them; several roots widen, an unknown root is its own only member.

    Where the taxonomy is labelled and the stories hold their tags' `places`, that is a range test on each story; else its closure is joined.
    """
    if reader.labels is not None and "places" in stories.columns:
        return stories.filter(inside(F.col("places"), F.col("tags"), reader.labels, roots))
    spark = stories.sparkSession
    return holding(stories, "tags", expand(spark.createDataFrame([(r,) for r in roots], "slug string"), reader.closure))


def live() -> Column:
    """Neither superseded nor dismissed nor judged off topic; unjudged stories are live."""
    return F.col("superseded_by").isNull() & F.coalesce("is_tech", F.lit(True)) & F.col("dismissed_at").isNull()


def of_kinds(kinds: tuple = ()) -> Column:
    """Stories of the event classes, by default all but articles; unjudged ones pass."""
    kinds = kinds or EVENT_DEFAULT
    return F.lit(True) if len(kinds) == len(EVENT_KINDS) else F.col("event_kind").isNull() | F.col("event_kind").isin(*kinds)


def in_english() -> Column:
    return F.coalesce(F.col("lang") == "en", F.lit(False)) | F.col("title_en").isNotNull()


def shown_title() -> Column:
    return F.coalesce("title_en", "title")


def containing(column: Column, words: str) -> Column:
    """Whether the text holds these characters, whatever their case; % and _ stand for themselves."""
    return F.coalesce(F.contains(F.lower(column), F.lit(words.lower())), F.lit(False))


def with_text(q: str) -> Column:
    """Full text of title and summary, or the words as they stand in the title or address."""
    return F.coalesce(search.matches(shown_title(), q), F.lit(False)) | containing(shown_title(), q) | containing(F.col("url"), q)


def money_lens(lenses: tuple) -> Column:
    found = F.lit(False)
    for name, pattern in MONEY:
        if name in lenses:
            found = found | F.coalesce(shown_title().rlike(pattern), F.lit(False))
    return found


def months_back(as_of: str, months: int) -> Column:
    """First day of the month that lies so many months before that of `as_of`."""
    return F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), -months)


def fresh(stories: DataFrame, months: int, reader: Reader) -> DataFrame:
    return holding(stories, "tags", reader.first_month.filter(F.col("first_month") >= months_back(reader.as_of, months)).select("slug"))


def tracked_releases(stories: DataFrame, tracked: tuple, reader: Reader) -> DataFrame:
    """Releases only of what is tracked or below it; all else passes."""
    other = stories.filter(~F.col("event_kind").eqNullSafe("release"))
    return other.unionByName(under(stories.filter("event_kind = 'release'"), tracked, reader)) if tracked else other


def about(stories: DataFrame, what: str, reader: Reader) -> DataFrame:
    if what in ("company", "platform"):
        return stories.filter(F.size({"company": "companies", "platform": "platforms"}[what]) > 0)
    kind = {"tech": "stack", "tool": "tool"}[what]
    return holding(stories, "tags", reader.taxonomy.filter(F.col("kind") == kind).select("slug"))


def where(stories: DataFrame, f: Filters, reader: Reader, account: str | None = None) -> DataFrame:
    """The stories that the filters let through. Column clauses reach the scan together; each clause over another table is one semi-join."""
    keep = live() & of_kinds(f.kind) & in_english()
    if f.stream in ("news", "new"):
        keep = keep & ~F.coalesce("prerelease", F.lit(False))
    for name, column in (("source", "source"), ("country", "country")):
        if getattr(f, name):
            keep = keep & F.col(column).isin(*getattr(f, name))
    if f.q:
        keep = keep & with_text(f.q)
    if f.money:
        keep = keep & money_lens(f.money)
    if f.start:
        keep = keep & (F.col("at") >= F.lit(f.start).cast("timestamp_ntz"))
    if f.end:
        keep = keep & (F.col("at") < F.date_add(F.lit(f.end).cast("date"), 1).cast("timestamp_ntz"))
    if f.days:
        keep = keep & (F.col("at") > F.lit(reader.as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(f.days)))
    if f.coverage is not None:
        keep = keep & (F.col("coverage") <= f.coverage)
    if f.least is not None:
        keep = keep & (F.col("importance") >= f.least)
    out = stories.filter(keep)
    for array, values in (("companies", f.company), ("platforms", f.platform)):
        if values:
            out = overlapping(out, array, values)
    if f.unread and account:
        out = out.join(reader.reads.filter(F.col("account") == account).select(F.col("story").alias("id")), "id", "left_anti")
    if f.stream == "news":
        out = tracked_releases(out, f.tracked, reader)
    if f.stream == "new":
        out = fresh(out, 2, reader)
    for roots in (f.tag, f.field, f.focus):
        if roots:
            out = under(out, roots, reader)
    for values in (f.category, f.type):
        if values:
            out = holding(out, "tags", reader.taxonomy.filter(F.col("category").isin(*values)).select("slug"))
    if f.ctype:
        out = holding(out, "companies", reader.companies.filter(F.col("category").isin(*f.ctype)).select("slug"))
    if f.channel:
        out = holding(out, "platforms", reader.platforms.filter(F.col("channel").isin(*f.channel)).select("slug"))
    if f.about:
        out = about(out, f.about, reader)
    if f.fresh is not None:
        out = fresh(out, f.fresh, reader)
    if f.rare is not None:
        out = holding(out, "tags", reader.frequency.filter(F.col("stories") <= f.rare).select("slug"))
    return out


def _of_tags(stories: DataFrame, table: DataFrame, pick) -> DataFrame:
    """Stories with `_key`, what `pick` makes of the second column of `table` over their tags; null without one."""
    value = table.columns[1]
    keys = stories.select("id", F.explode("tags").alias("slug")).join(table, "slug").groupBy("id").agg(pick(value).alias("_key"))
    return stories.join(keys, "id", "left")


def ordering(stories: DataFrame, name: str, reader: Reader) -> tuple[DataFrame, list[Column]]:
    """The stories with what a named ordering needs, and its sort keys; the id breaks ties."""
    newest = [F.col("at").desc_nulls_last(), F.col("id").asc()]
    if name == "firstseen":
        return _of_tags(stories, reader.first_month, F.max), [F.col("_key").desc_nulls_last(), *newest]
    if name == "rarest":
        return _of_tags(stories, reader.frequency, F.min), [F.col("_key").asc_nulls_last(), *newest]
    if name == "velocity":
        hours = (F.unix_micros(F.lit(reader.as_of).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9
        return stories, [(F.col("coverage") / F.greatest(hours, F.lit(0.25))).desc_nulls_last(), F.col("id").asc()]
    first = {"newest": [], "importance": [F.col("importance").desc_nulls_last()], "coverage": [F.col("coverage").desc_nulls_last()]}[name]
    return stories, [*first, *newest]


def page(stories: DataFrame, f: Filters, reader: Reader, size: int = 20) -> DataFrame:
    """One page of the selection in its order."""
    keyed, keys = ordering(stories, f.sort, reader)
    return keyed.orderBy(*keys).offset(f.offset).limit(size)


def link_state(status: Column) -> Column:
    """State of a link by the status of its last answer; without one it is unreachable."""
    # States and the statuses behind them.
    return (
        F.when(status.between(200, 299), "ok").when(status.isNull(), "unreachable").when(status.isin(401, 403), "blocked")
        .when(status == 404, "missing").when(status.between(500, 599), "erroring").otherwise("odd")
    )


def link_moved(asked: Column, arrived: Column) -> Column:
    """Whether a link led to another host; false where it is not known to have led anywhere."""
    host = lambda u: F.regexp_extract(u, "^[^:]*://([^/]*)", 1)
    return F.coalesce(host(asked) != host(arrived), F.lit(False))
