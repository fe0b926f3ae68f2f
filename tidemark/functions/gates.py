"""Rule gates as column expressions: ordered tables of patterns, where the first that fits decides.

A table is a list of (verdict, pattern, unless); neighbouring rows with one verdict and exception are matched by one regular expression.
Null texts count as empty.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str, str | None]


def anywhere(*bodies: str) -> list[str]:
    """Patterns that stand between characters that are no letters or digits."""
    return [f"(?i)(^|[^a-z0-9])({b})([^a-z0-9]|$)" for b in bodies]


def opening(*bodies: str) -> list[str]:
    """Patterns at the start of a title, behind blanks and a quotation mark."""
    return [rf"(?i)^(\s*[\"'‘“]?)({b})([^a-z0-9]|$)" for b in bodies]


def rules(verdict: str, patterns: list[str], unless: str | None = None) -> list[Rule]:
    return [(verdict, p, unless) for p in patterns]


def joined(table: list[Rule]) -> list[Rule]:
    """The table with one row for each run of equal verdicts and exceptions."""
    return [(v, "|".join(f"(?:{p})" for _, p, _ in run), u) for (v, u), run in groupby(table, key=lambda r: (r[0], r[2]))]


def first_match(text: Column, table: list[Rule], default: Column) -> Column:
    text, out = F.coalesce(text, F.lit("")), None
    for verdict, pattern, unless in joined(table):
        fits = text.rlike(pattern) if unless is None else text.rlike(pattern) & ~text.rlike(unless)
        out = (F if out is None else out).when(fits, F.lit(verdict))
    return default if out is None else out.otherwise(default)


# Patterns of titles about what a thing costs, its licence and its end.
MONEY = [
    ("cost", r"(?i)(\bpricing\b|\bprice\b|price (cut|rise|increase|change)|\bfree tier\b|\bbilling\b|\bbilled\b|\bpaid plan\b|\bsubscription\b|[0-9]+% off|\bdiscount\b|\bcheaper\b|\bquota\b|\brate limit|\bsavings plan\b|\breserved instance|\bspot (price|instance)|\bcredits\b|\bper (month|seat|user|request|token)\b)"),
    ("licence", r"(?i)(licen[cs]e|licen[cs]ing|relicen[cs]|\bBUSL\b|\bBSL\b|\bSSPL\b|\bAGPL\b|\bELv2\b|source[- ]available|\bopen[- ]core\b|\btrademark\b|terms of service|\bToS\b|\bCLA\b)"),
    ("eol", r"(?i)(end[- ]of[- ]life|end of support|\bEOL\b|\bsunset|\bshut(ting)? down\b|\bshutdown\b|discontinu|\bretirement\b|\bretiring\b|will be retired|\bdeprecat|no longer (supported|available|maintained)|\barchived\b|(free tier|support|maintenance|service|plan)s? (ends|ending)|\bends (on|in)\b)"),
]

# Patterns of the event classes, in the order in which they are tried.
VERSION_TITLE = r"(?i)^(\S+|(\S+\s+){0,3}[vb]?\d[\w.\-+]*)$"
WHATS_NEW = r"(?i)^\s*[\"‘“]?what[’']?s\s+new\s+(in|for|with|at)\b"
INTERROGATIVE = r"(?i)(\?\s*$)|^\s*[\"‘“]?(how|why|what|when|where|which|who|should|is|are|can|does|do|will|if)\b"
DECLARED_ARTICLE = opening("article|presentation|podcast|interview|video|talk|webinar|slides", "quoting|link|note|til|ask hn|tell hn|poll", "opinion|editorial|column|newsletter|digest|roundup|weekly|monthly") + anywhere("news roundup|weekly roundup|link roundup|this week in|last week in")
RETROSPECTIVE = anywhere(r"\d+ years ago|years ago today|a (decade|century) ago|quarter of a century", r"anniversary|back in (19|20)\d{2}|history of|looking back")
LAUNCH = opening("introducing|announcing|presenting|meet") + anywhere(
    "introducing|announcing",
    "we('| a)?re (launching|releasing|open[- ]sourcing|shipping)",
    "(is|are) (now )?(here|live|out|available|open source)",
    "now (in )?(general(ly)? available|ga|public (beta|preview)|open beta)",
    "launch(es|ed|ing)?|debuts?|unveil(s|ed|ing)?|comes? out of stealth",
    r"first (public )?(release|version|preview|beta)|1\.0(\.0)?|v1\.0",
    "open[- ]sourc(e[sd]?|ing)",
)
POSITION = anywhere("market share|share of the market|overtakes?|leapfrogs?|dethrones?", "fastest[- ]growing|steep(est)? decline|in decline|losing ground|taking over", "most (popular|used|deployed|downloaded)|dominant|dominates?", r"adoption (of|is|has|grew|grows|doubles?)|now used by \d")
RELEASE = anywhere(
    "releas(e|ed|es|ing)",
    r"v?\d+\.\d+(\.\d+)?([-.][a-z0-9]+)?\s+(is\s+)?(out|here|released|available|ships?|shipping|landed?)",
    "(is|are|can|will) now",
    "now (available|supported|supports?|includes?|installs?|works?|runs?|ships?|accepts?|handles?|free|included|open)",
    "support (for|is) (now )?(here|available|added)|support on|support for",
    "lands? (in|on)|arrives? (in|on)|comes? to|rolling out|rolls? out",
    "changelog|patch (release|tuesday)|security release|hotfix|point release",
    r"lts|long[- ]term support|release candidate|rc\d|nightly build",
) + [r"(?i)(^|[^a-z0-9])(released?|ships?|shipping|out now|available)\s*:?\s*v?\d+\.\d+"]
CHANGE = anywhere(
    "deprecat(e|es|ed|ing|ion)|end[- ]of[- ]life|eol|sunset(s|ting|ted)?",
    "discontinu(e|ed|ing)|shut(ting)? down|shuts down|winding down|retired?",
    "breaking changes?|backwards[- ]incompatible|no longer supports?",
    "drops? support|removes? support|adds? support|now includes?|now ships with",
    r"add(s|ed|ing)? (a |an |the )?\w+ (support|api|backend|driver|integration|mode)",
    r"v?\d+\.\d+(\.\d+)?\s+\w*\s*(adds?|brings?|introduces?|includes?|gains?|gets?|drops?|removes?|deprecates?|supports?)",
    "relicens(e|ed|ing)|licen[cs]e change|changes? (its )?licen[cs]e|moves? to (the )?[a-z]+ licen[cs]e",
    "rewritten in|ported to|migrat(es|ed|ing) to|switch(es|ed|ing) to",
    r"moves? to (the )?(rust|go|c\+\+|typescript|python|java|zig|swift|wasm)",
    "renamed|rebrand(s|ed|ing)?|forks?|merged into|joins the",
    "price (increase|change)|pricing (change|update)|free tier|now free|raises? prices",
    "outage|incident|post-?mortem of|degraded service|status update",
    r"cve-\d{4}|security advisor(y|ies)|patched a|fixes? a (critical|severe|remote)",
    "vulnerabilit(y|ies)|zero[- ]day|exploited in the wild|actively exploited",
    r"reaches? (general availability|stable|v\d)|graduat(es|ed) (to|from)",
)
EARN = anywhere(
    r"(adds?|added|introduces?|enables?|opens?|expands?|brings?) [\w ]{0,24}(staking|restaking|rewards?|yield|payouts?|revenue share|monetisation|monetization|creator fund|tipping|earnings|subscriptions?)",
    r"(raises?|increases?|cuts?|lowers?|reduces?|changes?) [\w ]{0,24}(revenue share|payouts?|commissions?|fees?|rewards?|rates?)",
    r"(ships?|deploys?|activates?|completes?|rolls? out) [\w ]{0,24}(upgrade|hard ?fork|mainnet|testnet)",
    "(mainnet|testnet|hard ?fork) (is )?(live|launch(es|ed)?|goes live|activated)",
    "(grants?|bounty|bounties|rewards?|incentives?|airdrop) programs?",
    r"(launch(es|ed)?|opens?) [\w ]{0,24}(marketplace|payouts?|earning|rewards?)",
)
MARKET = anywhere(r"raise[sd]? [$£€]?\d[\d,.]*\s*(m|bn?|k|million|billion)?", r"series [a-j](\s|$)|seed round|funding round|new funding|led by", "valuation|valued at|ipo|goes public|files? to go public", "acquir(es|ed|ing)|acquisition of|bought by|buys|to buy|merges? with", "takes? a stake|majority stake|spins? out|spun out of")
ARTICLE_SHAPE = opening("how|why|what|when|where|which|who|should|is|are|can|does|do|will|if") + anywhere(
    "how (to|i|we|they|it)|why (i|we|you|it|they)",
    "lessons (from|learned)|what i learned|things i|my (experience|journey|take)",
    "a (guide|primer|tour|deep dive|beginner)|the case for|in defen[cs]e of",
    "tutorial|walkthrough|explained|understanding|demystif|cheat sheet",
    "review|hands[- ]on|benchmark(s|ed|ing)?|compared?|versus| vs ",
    "best practices|anti-?patterns?|considered harmful|you should",
    r"part \d|series|chapter \d|episode \d",
    "thoughts on|notes on|reflections|musings|rant",
)
RELEASE_KINDS = ("releases", "status")

#: Title grammar after the checks on money and version titles.
EVENTS: list[Rule] = [("change", WHATS_NEW, None), *rules("article", DECLARED_ARTICLE + RETROSPECTIVE), *rules("launch", LAUNCH), *rules("market", POSITION, INTERROGATIVE), *rules("release", RELEASE), *rules("change", CHANGE + EARN), *rules("market", MARKET)]

# What marks a build artefact.
TAG_PAGE = r"(?i)^https?://(?:www\.)?github\.com/[^/]+/[^/]+/releases/tag/"
MACHINE_TITLE = [r"(?i)^incrementing version\b", r"(?i)\broll [\w ]*pgo profile\b", r"(?i)^(?:chore|ci|build|fix|feat|refactor|docs|test)(?:\([^)]*\))?:", r"(?i)^[\w-]+/[0-9a-f]{12,40}\b", r"(?i)^viable/strict/", r"(?i)\bmerge pull request #\d+", r"(?i)^create [\w.]+\.json for branch\b", r"(?i)\bprototype-v?\d"]
PRERELEASE = r"(?i)(?:^|[\s.\-_])(?:rc\d*|alpha\d*|beta\d*|a\d+|b\d+|m\d+|nightly|snapshot|canary|insiders?|preview|prerelease|pre|unstable|experimental|dev|devel|edge|latest|head|tip|weekly|daily)(?:$|[\s.\-_+])"
TEMPLATED = [r"(?i)^automated release\b", r"(?i)^auto(?:matic)? (?:build|release|tag)\b", r"(?i)^release for\b", r"(?i)^see the changelog\b", r"(?i)^no (?:release )?notes\b"]
VERSION = r"v?\d+(?:\.\d+)+[0-9A-Za-z.\-+]*"
BARE_VERSION = r"^\s*v?\d+(?:\.\d+)+[0-9A-Za-z.\-+]*\s*$"
NAME_AND_VERSION = r"^\s*[@\w][\w.@/+-]*[ @v-]*\d+(?:[.+]\d+)+[0-9A-Za-z.\-+]*\s*$"
FEWEST_WORDS = 12


def money_classes(title: Column) -> Column:
    """Every class that a title falls under, in the order of `MONEY`; a title may be in several."""
    title = F.coalesce(title, F.lit(""))
    return F.array_compact(F.array(*[F.when(title.rlike(p), F.lit(name)) for name, p in MONEY]))


def event_kind(title: Column, source_kind: Column, first_party: Column) -> Column:
    """launch, release, change, market or article, read from the title alone.

    Money comes first, then a title that is a version where the publisher speaks of its own product or of releases; then the grammar.
    A first-party post that does not look like writing is a change.
    """
    head = F.trim(F.coalesce(title, F.lit("")))
    own = F.coalesce(first_party, F.lit(False))
    writing = head.rlike("|".join(f"(?:{p})" for p in ARTICLE_SHAPE))
    grammar = first_match(head, EVENTS, F.when(own & ~writing, F.lit("change")).otherwise(F.lit("article")))
    version = head.rlike(VERSION_TITLE) & (own | F.coalesce(source_kind.isin(*RELEASE_KINDS), F.lit(False)))
    return F.when(head == "", F.lit("article")).when(F.size(money_classes(head)) > 0, F.lit("change")).when(version, F.lit("release")).otherwise(grammar)


def build_noise(title: Column, body: Column, url: Column, from_release_feed: Column) -> Column:
    """Why an item is a build artefact: tag_page, no_content, machine, prerelease or templated; null where it is none."""
    t, b = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    cited = ~F.coalesce(from_release_feed, F.lit(False)) & F.coalesce(F.trim(url), F.lit("")).rlike(TAG_PAGE)
    version = F.regexp_extract(t, VERSION, 0)
    unfinished = F.when(version != "", version.rlike(PRERELEASE)).otherwise(t.rlike(PRERELEASE) & (F.size(F.split(t, r"\s+")) <= 3))
    words = F.when(b == "", 0).otherwise(F.size(F.split(b, r"\s+")))
    bare = (words < FEWEST_WORDS) & (t.rlike(BARE_VERSION) | t.rlike(NAME_AND_VERSION))
    machine, templated = ("|".join(f"(?:{p})" for p in x) for x in (MACHINE_TITLE, TEMPLATED))
    return F.when(cited, "tag_page").when(t == "", "no_content").when(t.rlike(machine), "machine").when(unfinished, "prerelease").when(b.rlike(templated), "templated").when(bare, "no_content")


def host_in(host: Column, hosts: list[str], keep: tuple[str, ...] = ()) -> Column:
    """Whether a host is one of `hosts` or below it, and none of `keep` or below it; lists are parameters."""
    h = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^www\.", "")
    # every suffix of the host at a label border: a lookup of a few values, however long the list
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    among = lambda names: F.arrays_overlap(suffixes, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)
    return (h != "") & among(hosts) & ~among(keep)


def longest_noun(definition: Column, nouns: dict[str, str]) -> Column:
    """The kind of the longest noun that a definition names as whole words, else null; ties go to the first in the alphabet."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(definition, F.lit(""))), F.lit(" "))
    order = sorted(nouns, key=lambda n: (-len(n), n))
    return F.coalesce(*[F.when(F.contains(padded, F.lit(f" {n} ")), F.lit(nouns[n])) for n in order], F.lit(None).cast("string"))


def linkblog(items: Column, domains: Column) -> Column:
    """Whether a source's links are so scattered that it only points elsewhere: six items, more than two domains and one for each three items at least."""
    return (items >= 6) & (domains > 2) & (domains / items > 1 / 3)
